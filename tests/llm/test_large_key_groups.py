import random

import pyarrow as pa
import pytest

from quarry.llm import ngram_join
from tests.llm.test_ngram_join import brute, corpus, plain_set


@pytest.mark.parametrize("block", [4, 16])
def test_large_groups_against_brute_force(spark, monkeypatch, block):
    """Small blocks make most key groups large ones: centres first, then what they leave apart."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CENTRES", 2)
    pick = random.Random(block)
    rows = corpus(11, 120)
    base = [f"b{i}" for i in range(80)]
    for i in range(90):  # one large group of near copies, many of them below the threshold to each other
        words = list(base)
        for _ in range(pick.randrange(0, 4)):
            words[pick.randrange(80)] = f"c{pick.randrange(30)}"
        rows.append((1000 + i, " ".join(words), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    assert sorted(map(tuple, ngram_join.cluster(docs, 3, 90, 100).collect())) == brute(rows, 3, 90, 100)


def test_centre_links_connect_what_links_to_a_centre():
    sets = {1: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 2: [1, 2, 3, 4, 5, 6, 7, 8, 9, 11], 3: [50, 51], 4: [1, 2, 3, 4, 5, 6, 7, 8, 9]}
    table = pa.table({"doc_id": list(sets), "centre": [True, False, False, False], "tokens": pa.array(list(sets.values()), pa.list_(pa.int64()))})
    found = ngram_join.centre_links(table, 80, 100)
    assert {frozenset(p) for p in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)} == {frozenset({1, 2}), frozenset({1, 4})}


def test_sets_left_out_link_with_equal_ones_only():
    for num, den in ((90, 100), (80, 100)):
        for n in range(1, 30):
            reachable = any(den * i >= num * (n + m - i) for m in range(1, 40) for i in range(1, min(n, m) + 1) if not (i == n == m))
            assert reachable == (n * den >= (n + 1) * num)


def test_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(40)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (None, " ".join(words)), (None, near), (None, "x y z a b c d e f g h"), (None, "X y z a b c d e f g h"), (None, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.representatives(docs, 5, 80, 100, keep_unnamed=False).collect()
    assert len([r for r in found if r.doc_id == 1]) == 1
    assert sorted((r.text or "").lower().strip() for r in found if r.doc_id is None) == ["", "", "x y z a b c d e f g h"]
    assert len(plain_set(near, 5) & plain_set(rows[0][1], 5)) == 35
