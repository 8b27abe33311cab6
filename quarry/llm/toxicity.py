"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The vocabulary is every word of the examples, none is cut. A word's weight in a text is (1 + ln tf) * idf * relevance,
vectors scaled to length 1. Relevance is ``base`` for a word that toxic documents hold no more often than chance
allows, and rises towards 1 + ``base`` with the evidence: 1 - exp(-x), where x is how far the binomial tail of
its count lies below one expected by chance among all words tried. With plain TF-IDF (relevance 1) the words of
a topic outweigh the few that make a text toxic; the README has the figures. Document frequencies are counted over
all labelled documents that aren't held out. Near copies aren't independent, so of documents with the same label
whose runs of five words have the same least hash one counts.

The examples are a bounded sample of those documents (``per_class`` of each label, those with the smallest hash
of doc_id, texts of more than ``most`` bytes by windows spread evenly over the whole). The index keeps postings
by block of 64 examples and the largest weight of each common term in a block. A query adds those up, and the postings
of its rare terms themselves, into an upper bound for every block, visits the FIRST blocks by it, and then those alone whose bound the k-th best cosine found doesn't beat:
the k nearest are exact. Votes weigh by closeness; leave-one-out votes of the sample, weighted to the labels' true
shares, calibrate the score by isotonic regression.

Defined cases: null text is empty; a text without a word of the vocabulary scores the toxic share of such examples,
or of all where there are none; labels other than 0 and 1 are left out; of several labels for one document the
largest counts, of several texts for one doc_id each counts and the greatest can be an example; without any labelled example every score is 0; ties
between neighbours go to the smaller doc_id. Rows are independent.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_BYTES, chosen_ids, map_batches, stored
from quarry.llm.language_id import excerpt, held_out

TOKEN = re.compile(r"\w+")
BLOCK, NEIGHBOURS = 64, 15
#: Odd multipliers of the hash of a run of five words.
RUN = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(6)]
#: Blocks that a query visits before it leaves others out, and examples that hold a common word at least.
FIRST, COMMON = 4, 32
#: Bytes of a broadcast label.
LABEL_BYTES = 24
#: Bytes of an example's text at most, documents a word must be in before chance is asked, and the relevance of ordinary words.
MOST, LEAST_DOCS, BASE = 1 << 20, 4, 0.05


class BlockMaxIndex:
    """Exact top-k inner products of sparse unit vectors (term -> weight)."""

    def __init__(self, ids: list[int], vectors: list[dict[int, float]]):
        # examples with the same strongest term sit together, so that block maxima are telling
        order = sorted(range(len(ids)), key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], -t), default=-1), ids[i]))
        self.ids = [ids[i] for i in order]
        self.blocks = -(-len(ids) // BLOCK)
        postings = [(place, t, w) for place, i in enumerate(order) for t, w in vectors[i].items()]
        self.places, self.terms = (np.array([p[c] for p in postings], np.int64) for c in (0, 1))
        self.weights = np.array([p[2] for p in postings])
        self.size = int(self.terms.max()) + 1 if postings else 0

    def __getstate__(self) -> dict:
        """The postings alone; what a query reads is laid out where it is needed."""
        return {k: v for k, v in self.__dict__.items() if k != "layout"}

    @cached_property
    def layout(self) -> tuple[np.ndarray, ...]:
        """A row number of each common term (-1 for others), their weights (row, block, place) and largest ones (row, block);
        for the others where the postings of each term begin, with their places and weights."""
        rows = np.full(self.size, -1, np.int32)
        common = np.flatnonzero(np.bincount(self.terms, minlength=self.size) >= COMMON)
        rows[common] = np.arange(len(common))
        table = np.zeros((len(common), self.blocks * BLOCK))
        held = rows[self.terms] >= 0
        table[rows[self.terms[held]], self.places[held]] = self.weights[held]
        table = table.reshape(len(common), self.blocks, BLOCK)
        terms, places, weights = (x[~held] for x in (self.terms, self.places, self.weights))
        order = np.argsort(terms, kind="stable")
        starts = np.searchsorted(terms[order], np.arange(self.size + 1)).astype(np.int32)
        return rows, table, table.max(axis=2), starts, places[order].astype(np.int32), weights[order]

    def nearest(self, query: dict[int, float], k: int, without: int | None = None) -> list[tuple[float, int]]:
        """The k best (cosine, doc_id) above 0, best first, smaller doc_id first among equals; ``without``: an id left out."""
        return self.find(np.fromiter(query.keys(), np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query)), k, without)

    def find(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> list[tuple[float, int]]:
        """``nearest`` for a query in two arrays."""
        known = terms < self.size
        terms, weights = terms[known], weights[known]
        rows, table, most, starts, places, held = self.layout
        row = rows[terms]
        rare, common = terms[row < 0], row >= 0
        begin = starts[rare]
        sizes = starts[rare + 1] - begin
        at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        sums = np.bincount(places[at], np.repeat(weights[row < 0], sizes) * held[at], minlength=self.blocks * BLOCK).astype(np.float64, copy=False).reshape(self.blocks, BLOCK)
        row, weights = row[common], weights[common]
        bound = sums.max(axis=1, initial=0.0) + weights @ most[row]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best: list[tuple[float, int]] = []
        for part in (order[:FIRST], order[FIRST:]):
            floor = best[-1][0] - 1e-9 if len(best) == k else 0.0
            part = part[bound[part] >= floor]
            if len(part):
                score = (sums[part] + np.tensordot(weights, table[row[:, None], part], 1)).ravel()
                floor = max(floor, kth_largest(score, k + 1) - 1e-9)
                found = [(round(float(score[p]), 12), self.ids[part[p // BLOCK] * BLOCK + p % BLOCK]) for p in np.flatnonzero(score > floor).tolist()]
                best = sorted([*best, *(r for r in found if r[1] != without)], key=lambda r: (-r[0], r[1]))[:k]
        return best


def kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0


@dataclass
class Model:
    terms: dict[str, int]
    weights: np.ndarray  # idf * relevance of each term
    index: BlockMaxIndex
    labels: dict[int, int]
    steps: list[float]  # votes at which the calibrated score steps up
    scores: list[float]
    empty_score: float

    def arrays(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's vector: terms, and weights scaled to length 1."""
        counts = Counter(TOKEN.findall(text.lower()))
        known = self.terms.get
        terms = np.array([known(w, -1) for w in counts], np.int64)
        held = terms >= 0
        terms, times = terms[held], np.fromiter(counts.values(), np.float64, len(counts))[held]
        weights = (1 + np.log(times)) * self.weights[terms]
        return terms, weights / math.sqrt(weights @ weights) if len(weights) else weights

    def vector(self, text: str) -> dict[int, float]:
        terms, weights = self.arrays(text)
        return dict(zip(terms.tolist(), weights.tolist(), strict=True))

    def vote(self, text: str, without: int | None = None) -> tuple[float | None, list[tuple[float, int]]]:
        terms, weights = self.arrays(text)
        near = self.index.find(terms, weights, NEIGHBOURS, without) if len(terms) else []
        total = sum(c * c for c, _ in near)
        return (sum(c * c * self.labels[i] for c, i in near) / total if total else None), near

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        vote, near = self.vote(text)
        return (self.empty_score if vote is None else self.scores[bisect_right(self.steps, vote) - 1]), near


def isotonic(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Rising step function through (x, y, weight) points, by pooling adjacent violators: (starts, values)."""
    pools: list[list[float]] = []  # start, sum of y * weight, weight
    for x, y, w in sorted(points):
        if pools and pools[-1][0] == x:
            pools[-1][1] += y * w
            pools[-1][2] += w
        else:
            pools.append([x, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, w2 = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += w2
    starts, values = [p[0] for p in pools], [p[1] / p[2] for p in pools]
    return [-math.inf, *starts[1:]], values


def log_tail(a: int, n: int, share: float) -> float:
    """Logarithm of the chance of ``a`` or more toxic documents among ``n``; 0 where no more than expected."""
    if a <= n * share:
        return 0.0
    first = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1) + a * math.log(share) + (n - a) * math.log1p(-share)
    term = total = 1.0
    for k in range(a, n):
        term *= (n - k) / (k + 1) * share / (1 - share)
        total += term
        if term < 1e-12 * total:
            break
    return first + math.log(total)


@dataclass
class Counted:
    """How many documents of each label hold words: all documents counted, words tried, and (toxic, clean) of some words."""

    toxic: int
    clean: int
    tried: int
    words: dict[str, tuple[int, int]]

    def relevance(self, word: str, base: float) -> float:
        a, b = self.words.get(word, (0, 0))
        if a + b < LEAST_DOCS or not (self.toxic and self.clean):
            return base
        beyond = -log_tail(a, a + b, self.toxic / (self.toxic + self.clean)) - math.log(max(1, self.tried))
        return base + (1 - math.exp(-beyond) if beyond > 0 else 0.0)

    def idf(self, word: str) -> float:
        return math.log((1 + self.toxic + self.clean) / (1 + sum(self.words.get(word, (0, 0))))) + 1


def likeness(words: list[str]) -> int:
    """The least hash of a text's runs of five words, most often equal in near copies."""
    hashes = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint64, len(words))
    n = max(1, len(words) - 4)
    runs = np.zeros(n, np.uint64)
    for i in range(min(5, len(words))):
        runs += hashes[i : i + n] * np.uint64(RUN[i])
    runs ^= runs >> np.uint64(29)
    return int((runs * np.uint64(RUN[5])).min() >> np.uint64(1))


def counted_words(samples: list[tuple[int, str, int]]) -> Counted:
    """Counts over (doc_id, text, label) samples."""
    kept = {(likeness(TOKEN.findall(text.lower())), y): text for _, text, y in sorted(samples, reverse=True)}
    n = Counter(y for _, y in kept)
    df: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for (_, y), text in kept.items():
        df[y].update(set(TOKEN.findall(text.lower())))
    words = {w: (df[1][w], df[0][w]) for w in df[0] | df[1]}
    return Counted(n[1], n[0], sum(a + b >= LEAST_DOCS for a, b in words.values()), words)


def train(samples: list[tuple[int, str, int]], toxic_share: float, base: float = BASE, counted: Counted | None = None) -> Model:
    """A model from (doc_id, text, label) samples; ``toxic_share`` is that of all labelled documents.

    ``counted``: the words' counts over all labelled documents; else those of the samples.
    """
    n = Counter(y for _, _, y in samples)
    counted = counted or counted_words(samples)
    words = sorted({w for _, text, _ in samples for w in TOKEN.findall(text.lower())})
    weights = np.array([counted.idf(w) * counted.relevance(w, base) for w in words])
    model = Model({w: i for i, w in enumerate(words)}, weights, BlockMaxIndex([], []), {i: y for i, _, y in samples}, [-math.inf], [0.0], 0.0)
    model.index = BlockMaxIndex([i for i, _, _ in samples], [model.vector(text) for _, text, _ in samples])
    weight = {y: share / n[y] if n[y] else 0.0 for y, share in ((1, toxic_share), (0, 1 - toxic_share))}
    votes, none = [], [0.0, 0.0]
    for i, text, y in samples:
        vote, _ = model.vote(text, without=i)
        if vote is None:
            none[y] += weight[y]
        else:
            votes.append((vote, float(y), weight[y]))
    if votes:
        small = 0.5 / max(1, len(samples))  # keeps scores off 0 and 1
        model.steps, model.scores = isotonic(votes)
        model.scores = [small + s * (1 - 2 * small) for s in model.scores]
    model.empty_score = none[1] / sum(none) if sum(none) else toxic_share if samples else 0.0
    return model


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and toxic, once for each labelled document that isn't held out."""
    return labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def vocabulary(docs: DataFrame, labels: DataFrame, words: list[str]) -> Counted:
    """``counted_words`` over all labelled documents, for ``words``, all of which are tried.

    Texts don't shuffle. Labels are broadcast up to a checked size; more of them meet the documents' doc_ids, least
    hashes and word numbers in a shuffled join.
    """
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    schema = "doc_id long, alike long, terms array<int>"

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        alike, terms, known = [], [], number.value.get
        for text in batch.column("text").to_pylist():
            told = TOKEN.findall((text or "").lower())
            alike.append(likeness(told))
            found = {known(w, -1) for w in set(told)} | {-1}  # -1 counts the document
            terms.append(sorted(found))
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(alike, pa.int64()), pa.array(terms, pa.list_(pa.int32()))], names=["doc_id", "alike", "terms"])
        return out.append_column("toxic", batch.column("toxic")) if "toxic" in batch.schema.names else out

    named = stored(labelled(labels), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    if named.count() * LABEL_BYTES <= BROADCAST_BYTES:
        rows = map_batches(texts.join(F.broadcast(named), "doc_id"), read, f"{schema}, toxic int")
    else:
        rows = map_batches(texts, read, schema).join(named, "doc_id")
    once = rows.groupBy("alike", "toxic").agg(F.min(F.struct("doc_id", "terms"))["terms"].alias("terms"))
    counted = once.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    found = {r.term: (r.toxic, r.clean) for r in counted.collect()}  # a row for each of the words at most
    toxic, clean = found.pop(-1, (0, 0))
    return Counted(toxic, clean, sum(a + b >= LEAST_DOCS for a, b in found.values()), {words[i]: n for i, n in found.items()})


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, most: int = MOST) -> tuple[list[tuple[int, str, int]], float]:
    """At most ``per_class`` labelled documents of each label, held-out ones excluded, and the toxic share of all of those."""
    named = labelled(labels)
    counts = {r.toxic: r["count"] for r in named.groupBy("toxic").count().collect()}
    chosen = docs.sparkSession.createDataFrame(chosen_ids(named, "toxic", per_class), "doc_id long, toxic int")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [excerpt((t or "").encode(), most).decode(errors="ignore") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(raw, pa.string())], names=["doc_id", "toxic", "text"])

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    rows = map_batches(few, cut, "doc_id long, toxic int, text string").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).collect()
    return sorted((r.doc_id, r.text, r.toxic) for r in rows), counts.get(1, 0) / max(1, sum(counts.values()))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 700, base: float = BASE) -> Model:
    samples, share = training_rows(docs, labels, per_class)
    words = sorted({w for _, text, _ in samples for w in TOKEN.findall(text.lower())})
    return train(samples, share, base, vocabulary(docs, labels, words))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and as evidence the three nearest examples with cosine and label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        found = [m.score(t or "") for t in batch.column("text").to_pylist()]
        scores = [s for s, _ in found]
        evidence = [" ".join(f"{i}:{c:.4f}:{m.labels[i]}" for c, i in near[:3]) for _, near in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.string())],
            names=["doc_id", "held_out", "score", "predicted", "evidence"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int, evidence string")


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return predict(docs, fit(docs, labels, **options))
