import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import common, mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Rounds of sharing the rest by weight among those that aren't full."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        level = rest / max(1e-300, sum(weight[s] for s in names if s not in full)) if len(full) < len(names) else 0
        more = {s for s in names if s not in full and level * weight[s] >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


@pytest.mark.parametrize("n", [1, 7, 4000])
def test_targets_of_many_sources(spark, n):
    pick = random.Random(n)
    sizes = {f"source {pick.random()}": pick.choice([0, 1, 5, 1000, 10**6]) for _ in range(n)} | {None: 17}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    found = {r.source: r.target for r in mixing.targets(df).collect()}
    expected = plain_targets(sizes)
    assert found.keys() == expected.keys() and all(math.isclose(found[s], t, rel_tol=1e-9, abs_tol=1e-9) for s, t in expected.items())


def test_prefix_sums_and_crossings(spark):
    """Each source's documents laid end to end by hand, cut at the integers."""
    pick = random.Random(3)
    rows = [(256 * i, "w " * pick.choice([0, 1, 2, 9, 300]), pick.choice(["a", "b", "c"])) for i in range(700)] + [(None, f"text {i}", "a") for i in range(300)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = lambda text: len((text or "").split())
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    target = plain_targets(total)
    classed = {n: n.bit_length() * 8 + (n * 8 >> n.bit_length()) if n else 8 for n in {size(t) for _, t, _ in rows}}
    block = lambda i, text: int(hashlib.md5((str(i) if i is not None else text or "").encode()).hexdigest()[:8], 16) % 256
    expected = []
    for s in total:
        own = sorted(((classed[size(t)], block(i, t), i is not None, i or 0, size(t), t or "") for i, t, x in rows if x == s))
        shift = int(hashlib.md5(f"7:{chr(0) if s is None else s}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / total[s] if total[s] else 0.0
        for k, (_, _, named, i, n, _) in enumerate(own):
            expected.append((i if named else None, n, math.floor(shift + (k + 1) * rate) - math.floor(shift + k * rate)))
    found = [(r.doc_id, r.size, r.copies) for r in mixing.copies(docs).collect()]
    named = lambda rs: sorted(r for r in rs if r[0] is not None)
    assert named(found) == named(expected)
    assert sorted(r[1:] for r in found if r[0] is None) == sorted(r[1:] for r in expected if r[0] is None)  # which of them, their hashes decide
    assert mixing.mix(docs).count() == sum(r[2] for r in expected)


def test_running_sums_by_ranges(spark):
    pick = random.Random(5)
    rows = [(i, pick.randrange(100)) for i in range(3000)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "at long, n long").repartition(7)
    found = {r.at: r.before for r in common.running(df, [F.col("at")], {"before": F.col("n")}, "sums").collect()}
    total = 0
    for at, n in sorted(rows):
        assert found[at] == total
        total += n
