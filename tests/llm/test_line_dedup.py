from collections import defaultdict

import pytest

from quarry.llm import line_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COMMON = "This line is in very many documents"
ROWS = (
    [(i, f"{COMMON}\nown line number {i}\n{'Ä' * 9}{i % 10}", "x") for i in range(300)]
    + [(300, None, None), (301, "", "x"), (302, "\n\n", "x"), (303, f"a\n  {COMMON.upper()}\t\nb\r\n{COMMON}", "x"), (None, COMMON, "x"), (304, "short\nshort", "x"), (305, "short", "x")]
    + [(306, "only here, but twice\nonly here, but twice", "x"), (306, "only here, but twice", "x"), (307, "line " * 3 + "\n" + "line " * 3, "x")] * 2
)


def expected(min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UP)
    held = defaultdict(set)
    for doc_id, text, _ in ROWS:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                held[key(line)].add(doc_id)
    out = []
    for doc_id, text, extra in ROWS:
        lines = (text or "").split("\n")
        gone = [doc_id is not None and len(key(x)) >= 10 and len(held[key(x)]) >= min_docs and doc_id != min(held[key(x)]) for x in lines]
        out.append((doc_id, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), extra, len(lines), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 40])
def test_against_brute_force(spark, min_docs):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, hash string").repartition(5)
    found = line_dedup.kept_lines(docs, min_docs=min_docs).selectExpr("doc_id", "__kept", "hash", "__lines", "__gone").collect()
    assert sorted(map(tuple, found), key=str) == expected(min_docs)


def test_dedup_keeps_the_columns(spark):
    docs = spark.createDataFrame([(1, COMMON, 5), (2, f"{COMMON}\nx", 9)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, line_dedup.dedup(docs).collect())) == [(1, COMMON, len(COMMON)), (2, "x", 1)]
    assert line_dedup.digest(docs.limit(0)).collect() == []
