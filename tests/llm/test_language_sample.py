import pickle
import random

from quarry.llm import common
from quarry.llm import language_id as li
from tests.llm.test_language_id import SYLLABLES, text


def test_a_score_does_not_depend_on_the_batch():
    pick = random.Random(1)
    network = li.train([(text(lang, pick.randrange(3, 200), pick), lang) for lang in SYLLABLES for _ in range(20)], epochs=3)
    texts = [text(pick.choice(list(SYLLABLES)), pick.randrange(1, 400), pick) for _ in range(60)]
    together = li.classify(network, texts)
    assert together == tuple([x[0] for x in column] for column in zip(*(li.classify(network, [t]) for t in texts), strict=True))
    backwards = li.classify(pickle.loads(pickle.dumps(network)), texts[::-1])
    assert together == tuple(column[::-1] for column in backwards)


def test_excerpts_cover_the_whole_text():
    raw = bytes(range(256)) * 1000
    part = li.excerpt(raw, 4096)
    assert len(part) <= 4096 and part.startswith(raw[: li.WINDOW]) and part.endswith(raw[-li.WINDOW :]) and li.excerpt(b"short") == b"short"


def test_chosen_ids_are_the_smallest_hashes(spark):
    rows = [(i, "a") for i in range(3000)] + [(i, "b") for i in range(5)] + [(7, "c")] * 2000 + [(i, "c") for i in range(100, 130)] + [(None, "a"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    hashed = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id) as h").distinct().collect()}
    expected = []
    for lang in "abc":
        expected += sorted(sorted({i for i, v in rows if v == lang and i is not None}, key=lambda i: (hashed[i], i))[:10])
    assert [i for i, _ in common.chosen_ids(df, "lang", 10)] == expected
    assert common.chosen_ids(df.limit(0), "lang", 10) == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (1, "some words", None), (2, "12 !", None), (3, None, None), (None, "x", None)], "doc_id long, text string, lang string")
    assert sorted(r.text for r in li.accepted(docs).collect()) == ["some words", "some words", "x"]
    assert li.accepted(docs.limit(0)).collect() == []
