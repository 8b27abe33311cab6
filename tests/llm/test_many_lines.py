import time

from quarry.llm import line_dedup


def test_many_lines_take_linear_time(spark):
    """A text of 100,000 lines with one dropped line: splitting it once for each line would take minutes."""
    common = "a common line that is repeated"
    rows = [(1, common), (2, "\n".join([common, *(f"own line number {i}" for i in range(100_000))])), (None, common), (None, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.digest(docs).collect()}
    assert found == {1: (1, 0), 2: (100_001, 1), None: (1, 0)} and time.time() - began < 60
