import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import secret_scan

KIND_PATTERNS = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    (re.compile(r"[0-9a-f]+"), 0, 16),
)


def plain(text):
    found = []
    for kind, (pattern, group, least) in enumerate(KIND_PATTERNS):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "API_KEY", "apikey", "toKen", '"', "'", "=", ":", " ", "AKIA", "ABCDEFGHIJ0123", "0123456789abcdef", "deadbeef", "ſecret", "é", "x", "\n", "zZ9+/_.=-zZ9a"]), max_size=25).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert secret_scan.base_spans(text) == plain(text)


def test_model_tells_random_from_ordinary():
    model = secret_scan.trained()
    held_out = secret_scan.labelled_samples(seed=99, each=500)
    right = sum((model.score(text) > 0.35) == bool(label) for text, label in held_out)
    assert right / len(held_out) > 0.97


def test_scan(spark):
    text = "naïve token: Zm9vYmFyYmF6 and key q8Zt3LkP0vXw7RbN2sYd9HfG here plus getUserAccountOrderItemPrice2"
    rows = [(1, text, "x"), (1, text, "x"), (None, None, None), (2, "", "x"), (3, "deadbeef" * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert (found[1].n_assign, found[1].n_access, found[1].n_hex, found[1].n_random) == (1, 0, 0, 1)
    at = text.index("q8Zt")
    assert found[1].spans == f"assign:{text.index('token')}:{text.index(' and')},random:{at}:{at + 24}"
    assert found[None].spans == found[2].spans == ""
    assert found[3].spans == "hex:0:24000"
    assert secret_scan.scan(docs).count() == 5 and secret_scan.scan(docs.limit(0)).collect() == []
