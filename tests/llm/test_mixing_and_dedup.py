import hashlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, source string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"w{i % 7} " * (i % 40 + 1), f"s{i % 5}", "x") for i in range(600)] + [(i, "same text here", "hot", "x") for i in range(600, 1000)]
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "lonely", "s1", None), (None, None, "empty", None), (1002, "long " * 50_000, "s2", None), (5, "again", "s0", None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_targets_fill_up_by_weight(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), ("d", 1000), (None, 0)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a is full at 20 and d (weight 5) takes 5/8 of the rest with b (2) and c (1); nothing is above
    assert found["a"] == 20 and found[None] == 0
    assert sum(found.values()) == pytest.approx(1.5 * 1210)
    assert all(found[s] <= 2 * n for s, n in (("b", 100), ("c", 100), ("d", 1000)))
    assert found["b"] == 200 and found["c"] == pytest.approx((1815 - 220) / 6) or found["c"] == 200


def test_copies_follow_the_targets(docs):
    df, rows = docs
    once, again = (sorted(map(tuple, mixing.digest(df.repartition(n)).collect()), key=str) for n in (3, 8))
    assert once == again and len(once) == len(rows)
    taken, target, size = defaultdict(int), {}, {}
    for doc_id, words, source_size, goal, got in once:
        assert got <= 2 * words
        taken[goal, source_size] += got
        size[goal, source_size] = max(size.get((goal, source_size), 0), words)
    assert all(abs(got - goal) <= 3 * size[goal, n] + 1 for (goal, n), got in taken.items())
    assert mixing.digest(df.limit(0)).collect() == []


def test_mix_repeats_rows(docs):
    df, _ = docs
    distinct = df.filter("doc_id is not null and doc_id != 5")
    expected = {r.doc_id: r.copies for r in mixing.copies(distinct).collect()}
    found = Counter(r.doc_id for r in mixing.mix(distinct).collect())
    assert found == Counter({k: v for k, v in expected.items() if v})
    assert mixing.mix(distinct).columns == distinct.columns


@pytest.mark.parametrize("bits", [32768, 1 << 22])
def test_exact_dedup_against_brute_force(docs, bits):
    df, rows = docs
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    expected = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        expected.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert Counter(map(tuple, exact_dedup.decide(df, bits).collect())) == Counter(expected)
    assert exact_dedup.decide(df.limit(0), bits).collect() == []


def test_full_filter_still_finds_repeats(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "cast(id div 2 as string) as text")
    found = exact_dedup.decide(df, 32768).agg({"group_size": "min", "kept": "count"}).first()
    assert found["min(group_size)"] == 2


def test_unique_rows_pass_without_shuffle(spark):
    df = spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text")
    digests = df.selectExpr("doc_id", "sha2(text, 256) as text_sha256")
    digests = digests.withColumn("positions", exact_dedup.bit_positions(digests["text_sha256"], 1 << 27))
    assert exact_dedup.maybe_repeated(digests, 1 << 27).filter("maybe").count() == 0
