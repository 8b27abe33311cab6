import math
import random
import textwrap

import pytest

from quarry.llm import license_scan, toxicity

BAD, GOOD = ["vile", "rotten", "awful"], ["the", "of", "garden", "river", "stone", "cloud", "house"]


def sample(i, toxic, pick):
    words = pick.choices(GOOD, k=pick.randrange(5, 200)) + (pick.choices(BAD, k=2) if toxic else [])
    pick.shuffle(words)
    return i, " ".join(words), int(toxic)


@pytest.fixture(scope="module")
def samples():
    pick = random.Random(1)
    return [sample(i, i % 4 == 0, pick) for i in range(400)]


def test_index_is_exact():
    pick = random.Random(2)
    vectors = []
    for _ in range(700):
        v = {t: pick.random() for t in pick.sample(range(40), pick.randrange(0, 6))}
        norm = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / norm for t, w in v.items()})
    index = toxicity.BlockMaxIndex(list(range(700)), vectors)
    for q in vectors[:80]:
        plain = sorted(((round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors)), key=lambda r: (-r[0], r[1]))
        expected = [r for r in plain if r[0] > 0][:15]
        found = index.nearest(q, 15)
        assert [i for _, i in found] == [i for _, i in expected] or [round(c, 9) for c, _ in found] == [round(c, 9) for c, _ in expected]


def test_held_out_accuracy_and_evidence(samples):
    model = toxicity.train(samples, 0.1)
    assert set(model.terms) == {*BAD, *GOOD}
    counted = toxicity.counted_words(samples)
    assert {w for w in model.terms if counted.relevance(w, 0.05) > 0.5} == set(BAD)
    pick = random.Random(3)
    for i in range(200):
        _, text, toxic = sample(i, i % 2, pick)
        score, near = model.score(text)
        assert 0 <= score <= 1 and (score >= 0.5) == bool(toxic) and len(near) == toxicity.NEIGHBOURS
        assert near == plain_neighbours(model, text)


def plain_neighbours(model, text):
    """The nearest examples by every cosine."""
    query = model.vector(text)
    vectors: dict = {i: {} for i in model.labels}
    for place, t, w in zip(model.index.places.tolist(), model.index.terms.tolist(), model.index.weights.tolist(), strict=True):
        vectors[model.index.ids[place]][t] = w
    every = [(round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), i) for i, v in vectors.items()]
    return sorted((r for r in every if r[0] > 0), key=lambda r: (-r[0], r[1]))[: toxicity.NEIGHBOURS]


def test_isotonic():
    starts, values = toxicity.isotonic([(0, 0, 1), (1, 1, 1), (2, 0, 1), (3, 1, 1)])
    assert starts == [float("-inf"), 1, 3] and values == [0, 0.5, 1]


def test_score_over_rows(spark, samples):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in samples] + [(None, "vile", None), (900, None, None), (901, "", None), (0, "rotten twice", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in samples] + [(None, 1, 1), (901, None, None), (5000, 1, 1), (8, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, labels).collect()
    assert len(found) == len(samples) + 4
    assert all((r.score >= 0.5) == bool(r.predicted) for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[None].predicted == 1 and by_id[900].predicted == by_id[901].predicted == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).collect() == []


def test_words_of_a_rare_language_and_of_copies(spark, monkeypatch):
    pick = random.Random(8)
    rows = [sample(i, i % 4 == 0, pick) for i in range(1600)]
    rows += [(2000 + i, " ".join([f"palabra{pick.randrange(900)}" for _ in range(30)] + ["horrible"] * (i < 12)), int(i < 12)) for i in range(60)]
    rows += [(3000 + i, "garden copied phrase " + " ".join(f"filler{j}" for j in range(300)) + f" end{i}", 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = {r.doc_id for r in docs.filter(toxicity.held_out(docs["doc_id"])).collect()}
    counted = toxicity.counted_words([r for r in rows if r[0] not in held])
    assert {w for w in counted.words if counted.relevance(w, 0.05) > 0.5} == {*BAD, "horrible"}
    assert toxicity.vocabulary(docs, labels, sorted(counted.words)) == counted
    monkeypatch.setattr(toxicity, "BROADCAST_BYTES", 0)  # labels too many to broadcast
    assert toxicity.vocabulary(docs, labels, sorted(counted.words)) == counted
    assert toxicity.vocabulary(docs, labels.limit(0), ["garden"]) == toxicity.Counted(0, 0, 0, {})
    model = toxicity.fit(docs, labels, per_class=200)
    assert {*BAD, *GOOD, "horrible"} < set(model.terms)  # all words of the examples


def test_log_tail():
    for a, n, share in ((3, 5, 0.1), (7, 7, 0.3), (50, 80, 0.4)):
        plain = sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(a, n + 1))
        assert abs(toxicity.log_tail(a, n, share) - math.log(plain)) < 1e-9
    assert toxicity.log_tail(1, 10, 0.1) == 0


def plain_matches(text, least=license_scan.LEAST):
    """Every template against every passage, without pruning."""
    known = license_scan.templates(least)
    out = []
    for s, e, words in license_scan.passages(text, known):
        scores = [(license_scan.dice(license_scan.bigrams(words), g), n) for g, n in zip(known.grams, known.names, strict=True)]
        best = min(scores, key=lambda f: (-f[0], f[1]))
        if best[0] >= least:
            out.append((s, e, best[1], best[0]))
    return out


def test_license_pruning_loses_nothing():
    pick = random.Random(4)
    texts = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    for _ in range(150):
        words = pick.choice(texts).split()
        for _ in range(pick.randrange(4)):
            words[pick.randrange(len(words))] = pick.choice(["word", "the", "License"])
        line = " ".join(words)
        text = pick.choice(["{}", "intro\n{}", "One. {} Two.", "{}\n{}"]).replace("{}", line)
        plain = plain_matches(text)
        found = license_scan.matches(text)
        assert set(found) <= set(plain) and bool(found) == bool(plain)
        assert all(any(f[0] < p[1] and p[0] < f[1] for f in found) for p in plain)


def test_license_of_lines_sentences_and_wrapped_text():
    mit = license_scan.TEMPLATES["MIT"][-1]
    wrapped = "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))
    assert [m[2] for m in license_scan.matches(f"Some prose here.\n\nnext\n{wrapped}\nprose")] == ["MIT"]
    text = "Prose before. Released under the MIT License. Prose after."
    (s, e, name, score), = license_scan.matches(text)
    assert (name, score) == ("MIT", 1.0) and text[s:e].strip() == "Released under the MIT License."
    assert license_scan.matches("") == [] and license_scan.matches("the license of the house is the garden\n" * 50) == []


def test_license_scan(spark):
    docs = spark.createDataFrame([(1, "x\nAll rights reserved.", 2.0), (1, "x\nAll rights reserved.", 2.0), (None, None, None), (2, "", None), (3, "license " * 40_000, None)], "doc_id long, text string, score double")
    found = sorted(map(tuple, license_scan.scan(docs).collect()), key=str)
    assert found == sorted([(1, 1, "Proprietary", 1.0, "Proprietary:2:22")] * 2 + [(i, 0, None, None, "") for i in (None, 2, 3)], key=str)
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_license_after_prose_and_over_paragraphs():
    mit = license_scan.TEMPLATES["MIT"][-1]
    wrapped = textwrap.fill(mit, 60)
    prose = "There may be other uses for work without the tool, but see only the notes.\nNo more of it is needed here, and all the rest works out of the box.\n"
    for before, body, after in ((prose * 5, wrapped, ""), (prose * 30, mit.replace(". ", ".\n\n"), prose * 30), (prose.replace("\n", " ") * 5, mit, " " + prose)):
        (s, e, name, score), = license_scan.matches(before + body + after)
        assert (s, e, name, score) == (len(before), len(before) + len(body), "MIT", 1.0)


def test_license_windows_against_brute_force(monkeypatch):
    short = {"A": ["one two three four five six", "two one two one two"], "B": ["one two three four six five", "three four"], "MIT": ["one mit two three 2.0"]}
    monkeypatch.setattr(license_scan, "TEMPLATES", short)
    known = license_scan.Templates(0.7)
    pick = random.Random(6)
    for _ in range(300):
        words = pick.choices("one two three four five six mit 2.0 x".split(), k=pick.randrange(2, 40))
        every = [(-hit[0], -(e - b), b, e) for b in range(len(words)) for e in range(b + 2, len(words) + 1) if (hit := known.best(words[b:e]))]
        plain: list[tuple[int, int]] = []
        for _, _, b, e in sorted(every):
            if all(e <= s or t <= b for s, t in plain):
                plain.append((b, e))
        assert license_scan.windows(words, known) == plain


def test_license_notice_of_another_version_is_none():
    for text in ("Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.1."):
        assert license_scan.matches(f"Some prose. {text} More prose.") == []


def test_full_license_texts(spark):
    rows = []
    for i, name in enumerate(license_scan.FULL):
        body = license_scan.TEMPLATES[name][-1]
        rows.append((i, f"Some prose.\n\nCopyright (c) 2020 Someone. All rights reserved.\n\n{body}\nMore prose here."))
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.license for i, r in found.items()} == dict(enumerate(license_scan.FULL))


def test_notices_of_affero_and_eclipse():
    for name in ("AGPL-3.0", "EPL-2.0"):
        for text in license_scan.TEMPLATES[name]:
            assert [m[2] for m in license_scan.matches(f"Some prose before it.\n{text}\nAnd after.")] == [name]
