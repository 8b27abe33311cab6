import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quarry.llm import bpe, mixing
from tests.llm.test_line_dedup import UP
from tests.llm.test_ngram_join import brute

SYLLABLES = {"aa": ["tha", "ing", "wor", "the"], "bb": ["où", "eau", "ré", "que"]}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    pick = random.Random(6)
    rows = []
    for i in range(400):
        lang = pick.choice(list(SYLLABLES))
        words = ["".join(pick.choices(SYLLABLES[lang], k=pick.randrange(2, 5))) for _ in range(pick.randrange(8, 120))]
        rows.append([i, "\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12)), lang, f"s{i % 4 if i % 3 else 0}", 0])
    for i in range(400, 460):
        words = rows[pick.randrange(40)][1].split(" ")
        words[pick.randrange(len(words))] = "the"
        rows.append([i, " ".join(words).replace("\n", " "), "aa", "s9", 0])
    rows += [[460, "12345 !!", "aa", "s1", 8], [461, None, None, None, None], [462, rows[0][1], "aa", None, 5]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    before = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, spark.createDataFrame(before, docs.schema), corpus)
        rows = [tuple(r) for r in after.collect()]
        if name != "bpe":
            assert after.columns == columns
        if name == "language_id":
            assert {r[0] for r in before} - {r[0] for r in rows} == {460, 461} and set(rows) <= set(before)
        elif name == "line_dedup":
            held = defaultdict(set)
            key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UP)
            for r in before:
                for line in r[1].split("\n"):
                    held[key(line)].add(r[0])
            texts = {r[0]: "\n".join(x for x in r[1].split("\n") if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == r[0]) for r in before}
            assert {r[0]: (r[1], r[4]) for r in rows} == {i: (t, len(t)) for i, t in texts.items()}
        elif name == "ngram_join":
            groups = brute(before, 5, 80, 100)
            assert sorted(r[0] for r in rows) == sorted(i for i, _, c in groups if i == c) and set(rows) <= set(before)
            assert len(rows) < len(before)
        elif name == "mixing":
            expected = {r.doc_id: r.copies for r in mixing.copies(spark.createDataFrame(before, docs.schema)).collect()}
            assert Counter(r[0] for r in rows) == Counter({i: n for i, n in expected.items() if n}) and set(rows) <= set(before)
            words = sum(len(re.findall(r"\S+", r[1])) for r in before)
            assert sum(len(re.findall(r"\S+", r[1])) for r in rows) == pytest.approx(1.5 * words, rel=0.15)
        else:
            own = bpe.load(bpe.VOCABULARY)
            assert sorted((r[0], tuple(r[3])) for r in rows) == sorted((b[0], tuple(own.encode(b[1]))) for b in before)
        before = rows


def test_run_equals_the_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    found = corpus_pipeline.run(spark, corpus)
    assert found.count() > 0
    assert Counter((r.doc_id, r.n_tokens) for r in found.collect()) == Counter((r.doc_id, r.n_tokens) for r in docs.collect())
