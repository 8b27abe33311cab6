import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import common, ngram_join, shingles

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, num, den):
    """Union-find over all pairs of rows; rows with one doc_id are one node."""
    sets = [plain_set(r[1], k) for r in rows]
    node = [r[0] for r in rows]
    root = {n: n for n in node}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(node[i]), find(node[j])))
                root[y] = x
    return sorted((r[0], len(s), find(r[0]) if s else r[0]) for r, s in zip(rows, sets, strict=True))


def corpus(seed, n=260):
    pick = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    boiler = " ".join(pick.choices(vocabulary, k=60))
    bases = [pick.choices(vocabulary, k=pick.randrange(1, 250)) for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(pick.choice(bases)) if pick.random() < 0.8 else pick.choices(vocabulary, k=pick.randrange(0, 80))
        for _ in range(pick.choice([0, 0, 1, 2, 4, 8])):
            if words:
                words[pick.randrange(len(words))] = pick.choice(vocabulary).upper()
        text = pick.choice([" ", "\n", " \t"]).join(words)
        rows.append((i, f"{boiler} {text}" if pick.random() < 0.2 else text, "x"))
    return rows + [(n, None, None), (n + 1, "", "x"), (n + 2, " \n", "x"), (n + 3, "one", None), (n + 4, "ONE", None), (n + 5, "one two", None), (n + 6, "rep " * 5000, "x"), (n + 7, "rep " * 3000, "x")]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_hashed_sets_equal_the_plain_ones(k, monkeypatch):
    monkeypatch.setattr(shingles, "CHUNK", 300)
    texts = [r[1] for r in corpus(1, 60)] + ["a", "A b", "ab", "b a"]
    found = [s for part in shingles.shingle_sets(pa.array(texts), k) for s in part]
    meaning = {}
    for text, s in zip(texts, found, strict=True):
        plain = plain_set(text, k)
        assert len(s) == len(plain) and (np.diff(s.astype(object)) > 0).all()
        assert meaning.setdefault(frozenset(plain), s.tobytes()) == s.tobytes()
    assert len(set(meaning.values())) == len(meaning)
    assert list(shingles.shingle_sets(pa.array([], pa.string()), k)) == []
    sliced = pa.array(["x", None, "a b c d", "q"]).slice(1, 2)
    assert [len(s) for part in shingles.shingle_sets(sliced, k) for s in part] == [0, len(plain_set("a b c d", k))]


@pytest.mark.parametrize(("k", "num", "den", "keys"), [(3, 90, 100, True), (5, 80, 100, True), (3, 90, 100, False)])
def test_components_against_brute_force(spark, monkeypatch, k, num, den, keys):
    if not keys:  # every key group empty: the prefix filters alone must find all
        real = ngram_join.profiles
        monkeypatch.setattr(ngram_join, "profiles", lambda *a: real(*a).selectExpr("doc_id", "n", "key", "met", "array(xxhash64(doc_id, key)) as stars", "p1", "p2", "p3"))
    rows = corpus(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(4)
    found = sorted(map(tuple, ngram_join.cluster(docs, k, num, den).collect()))
    assert found == brute(rows, k, num, den)


def test_prefixes_meet_under_any_order():
    pick = random.Random(9)
    for _ in range(300):
        n = pick.randrange(1, 60)
        a = set(pick.sample(range(100), n))
        b = set(a)
        for x in pick.sample(sorted(a), pick.randrange(0, max(1, n // 8))):
            b.discard(x)
        if b and len(a & b) * 100 >= len(a | b) * 90:
            order = {t: pick.random() for t in a | b}
            for more in (1, 3, 7):
                first = [set(sorted(s, key=order.get)[: ngram_join.prefix_length(len(s), 90, 100, more)]) for s in (a, b)]
                assert len(first[0] & first[1]) >= min(more, len(a & b))


def test_edges_of_the_table(spark):
    rows = [(1, "a b c d", None), (1, "e f g h", None), (2, "E F G H", None), (None, "a b c d", None), (None, "lonely words here now", None), (3, "i j k l", None), (3, "i j k l", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = sorted(map(tuple, ngram_join.cluster(docs, 3, 90, 100).collect()), key=str)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 2, None), (3, 2, 3), (3, 2, 3)], key=str)
    assert ngram_join.cluster(docs.limit(0)).collect() == []
    assert sorted(str(r.doc_id) for r in ngram_join.representatives(docs, 3, 90, 100).collect()) == ["1", "1", "3", "3", "None", "None"]


def test_components_of_chains(spark):
    pick = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 4000), (4000, 4500), (7, 7)]
    pick.shuffle(edges)
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)} | {5000: 4000, 4500: 4000}
    assert found == expected
