import random

import numpy as np
import pytest

from quarry.llm import language_id as li

SYLLABLES = {"aa": ["tha", "ing", "wor", "the"], "bb": ["où", "eau", "ré", "que"], "cc": ["sch", "ung", "ä", "eit"]}


def text(lang, n, pick):
    return " ".join("".join(pick.choices(SYLLABLES[lang], k=pick.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def network():
    pick = random.Random(1)
    return li.train([(text(lang, pick.randrange(3, 200), pick), lang) for lang in SYLLABLES for _ in range(60)], epochs=8)


def test_held_out_accuracy(network):
    pick = random.Random(2)
    texts = [(text(lang, pick.randrange(4, 400), pick), lang) for lang in SYLLABLES for _ in range(60)]
    found, score = li.classify(network, [t for t, _ in texts])
    assert np.mean([f == lang for f, (_, lang) in zip(found, texts, strict=True)]) > 0.97
    assert all(0 <= s <= 1 for s in score)


def test_fast_prediction_equals_the_plain_network(network):
    x = li.to_windows(text("bb", 300, random.Random(3)).encode())
    best = []
    for w in li.WIDTHS:
        sums = sum(network.tables[w][j][x[:, j : li.WINDOW - w + 1 + j]] for j in range(w))
        best.append(sums.max(axis=1))
    plain = li.softmax(np.maximum(np.concatenate(best, axis=1) + network.bias, 0) @ network.out + network.out_bias)
    assert np.allclose(network.predictor()(x), plain, atol=1e-5)


def test_batches_change_nothing(network):
    pick = random.Random(4)
    texts = [text("aa", n, pick) for n in (1, 5, 20_000, 3)] + [None, "", "123 !?", "Ω"]
    together, alone = li.classify(network, texts), [li.classify(network, [t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone], atol=1e-5)
    assert together[0][4:7] == ["und"] * 3


def test_identify_over_rows(spark):
    pick = random.Random(5)
    rows = [(i, text(lang, 30, pick), lang, "x") for i, lang in enumerate(list(SYLLABLES) * 40)] + [(None, "the the", "aa", None), (5000, None, None, None), (5001, "12", "bb", None), (3, "thaing worthe", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = li.identify(docs, per_lang=20, epochs=6).collect()
    again = li.identify(docs.repartition(3), per_lang=20, epochs=6).collect()
    assert len(found) == len(rows) and sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    by_id = {r.doc_id: r for r in found}
    assert by_id[5000].lang_pred == by_id[5001].lang_pred == "und"
    kept = li.accepted(docs, per_lang=20, epochs=6)
    assert kept.columns == docs.columns and {5000, 5001}.isdisjoint(r.doc_id for r in kept.collect())
    assert li.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in li.identify(docs.filter("lang is null")).collect()} == {"und"}
