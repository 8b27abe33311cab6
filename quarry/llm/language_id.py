"""Language identification with a byte convolutional network, trained in numpy.

The network reads windows of ``WINDOW`` bytes: filters of several widths over one-hot bytes (so a filter is a
table of weights by position and byte), rectification, the maximum over the window, and a softmax. It is
trained on a bounded sample of labelled documents: for each language the ``per_lang`` documents with the
smallest hash of doc_id, read at random windows each epoch. A training text of more than ``most`` bytes gives
windows spread evenly over all of it, cut on the executors. Prediction cuts every whole text into windows,
runs them in batches, and averages the probabilities, each window weighing as many bytes as it holds.

At prediction the tables of two neighbouring bytes are summed beforehand, so a position costs five lookups. The
last layer adds up in 64 bits and in a fixed order, so a text's score doesn't depend on what else is in its batch.

Defined cases: text without a letter (null and empty ones too) is ``und`` with score 0; with no labelled
document at all every text is ``und``, and ``accepted`` then keeps all texts with a letter; languages are the
labels seen in the sample, in code point order; ties go to the first; of rows that share a doc_id and a label
one is trained on. Rows are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chosen_ids, map_batches

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 16
#: Bytes that one training text gives at most.
MOST = 1 << 14
LETTER = regex.compile(r"\p{L}")
BATCH = 256


@dataclass
class Network:
    languages: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray  # (widths * FILTERS,)
    out: np.ndarray  # (widths * FILTERS, languages)
    out_bias: np.ndarray

    def pairs(self) -> list[np.ndarray]:
        """Tables by two bytes: widths 2 and 3 start with one, width 4 is two."""
        t = self.tables
        both = [(t[2][0], t[2][1]), (t[3][0], t[3][1]), (t[4][0], t[4][1]), (t[4][2], t[4][3])]
        return [np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)) for a, b in both]

    def __getstate__(self) -> dict:
        """Without what is made from the tables when it is first needed."""
        return {k: v for k, v in self.__dict__.items() if k != "probabilities"}

    @cached_property
    def probabilities(self) -> Callable[[np.ndarray], np.ndarray]:
        return self.predictor()

    def predictor(self) -> Callable[[np.ndarray], np.ndarray]:
        """windows (n, WINDOW) uint8 -> probabilities (n, languages)."""
        two, three, four, four_end = self.pairs()
        single = np.ascontiguousarray(self.tables[3][2])

        def probabilities(windows: np.ndarray) -> np.ndarray:
            code = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
            best = np.empty((len(windows), len(WIDTHS) * FILTERS), np.float32)
            best[:, :FILTERS] = two.take(code, axis=0).max(axis=1)
            sums = three.take(code[:, :-1], axis=0)
            sums += single.take(windows[:, 2:], axis=0)
            best[:, FILTERS : 2 * FILTERS] = sums.max(axis=1)
            sums = four.take(code[:, :-2], axis=0)
            sums += four_end.take(code[:, 2:], axis=0)
            best[:, 2 * FILTERS :] = sums.max(axis=1)
            return softmax(ordered_product(np.maximum(best + self.bias, 0), self.out) + self.out_bias)

        return probabilities


def ordered_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in 64 bits, added up column by column: a row's result doesn't depend on how many rows there are."""
    total = np.zeros((len(a), b.shape[1]))
    for column, weights in zip(np.ascontiguousarray(a.T, np.float64), b.astype(np.float64), strict=True):
        total += column[:, None] * weights
    return total


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def to_windows(raw: bytes) -> np.ndarray:
    """Consecutive windows of the whole text; the last one is filled up with zero bytes."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\x00"), np.uint8).reshape(n, WINDOW)


def excerpt(raw: bytes, most: int = MOST) -> bytes:
    """All of a text of at most ``most`` bytes, else windows spread evenly over the whole of it."""
    if len(raw) <= most:
        return raw
    n = max(2, most // WINDOW)
    return b"".join([raw[i * (len(raw) - WINDOW) // (n - 1) :][:WINDOW] for i in range(n)])


def train(samples: list[tuple[str | bytes, str]], epochs: int = 12, per_text: int = 6, seed: int = 5, rate: float = 0.08) -> Network:
    """A network from (text, language) samples, by Adagrad over windows at random places; same samples, same network."""
    languages = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    width = len(WIDTHS) * FILTERS
    bias, out, out_bias = np.zeros(width, np.float32), rng.normal(0, 0.2, (width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    params = [*tables.values(), bias, out, out_bias]
    past = [np.full_like(p, 1e-3) for p in params]
    raws = [text.encode() if isinstance(text, str) else text for text, _ in samples]
    labels = np.array([languages.index(lang) for _, lang in samples], dtype=np.int64)
    share = np.bincount(labels, minlength=len(languages)) / max(1, len(labels))
    for _ in range(epochs if samples else 0):
        windows, y = [], []
        for raw, label in zip(raws, labels, strict=True):
            for _ in range(min(per_text, 1 + len(raw) // WINDOW)):
                at = int(rng.integers(0, max(1, len(raw) - WINDOW + 1)))
                length = int(rng.integers(24, WINDOW + 1)) if rng.random() < 0.4 else WINDOW  # short texts come too
                windows.append(np.frombuffer(raw[at : at + length].ljust(WINDOW, b"\x00"), np.uint8))
                y.append(label)
        x, y = np.stack(windows), np.array(y)
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            step(x[order[at : at + 64]], y[order[at : at + 64]], tables, bias, out, out_bias, params, past, 1 / (len(languages) * share), rate)
    return Network(languages, tables, bias, out, out_bias)


def step(x, y, tables, bias, out, out_bias, params, past, weight, rate) -> None:
    n, rows = len(x), np.arange(len(x))[:, None]
    best, where = [], []
    for w in WIDTHS:
        sums = sum(tables[w][j].take(x[:, j : WINDOW - w + 1 + j], axis=0) for j in range(w))
        where.append(sums.argmax(axis=1))
        best.append(sums.max(axis=1))
    raw = np.concatenate(best, axis=1) + bias
    hidden = np.maximum(raw, 0)
    p = softmax(hidden @ out + out_bias)
    p[np.arange(n), y] -= 1
    p *= (weight[y] / n)[:, None]
    back = (p @ out.T) * (raw > 0)
    grads = []
    for k, w in enumerate(WIDTHS):
        g = np.zeros_like(tables[w])
        part, at = back[:, k * FILTERS : (k + 1) * FILTERS], where[k]
        for j in range(w):
            np.add.at(g[j], (x[rows, at + j], np.broadcast_to(np.arange(FILTERS), at.shape)), part)
        grads.append(g)
    grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
    for param, grad, sq in zip(params, grads, past, strict=True):
        sq += grad * grad
        param -= (rate * grad / np.sqrt(sq)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, per_lang: int, most: int = MOST) -> list[tuple[bytes, str]]:
    """Excerpts of at most ``per_lang`` labelled documents of each language that aren't held out: those with the smallest hash.

    The choice reads ids and labels only; one more scan cuts the excerpts of the few that were chosen.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("doc_id", F.col("doc_id").cast("long"))
    chosen = docs.sparkSession.createDataFrame(chosen_ids(labelled, "lang", per_lang), "doc_id long, lang string")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [excerpt(t.encode(), most) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(raw, pa.binary())], names=["doc_id", "lang", "raw"])

    few = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    rows = map_batches(few, cut, "doc_id long, lang string, raw binary").groupBy("doc_id", "lang").agg(F.min("raw").alias("raw")).collect()
    return [(bytes(r.raw), r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang))]


def fit(docs: DataFrame, per_lang: int = 300, **options) -> Network:
    return train(training_rows(docs, per_lang), **options)


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, score = classify(shared.value, batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def classify(network: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    if not network.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    probabilities = network.probabilities
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(network.languages)))
    lengths = np.zeros(len(texts))
    parts, owner, size = [], [], 0

    def flush() -> None:
        nonlocal parts, owner, size
        if parts:
            x = np.concatenate(parts)
            who = np.repeat([o for o, _ in owner], [len(p) for p in parts])
            held = np.concatenate([np.minimum(WINDOW, n - WINDOW * np.arange(len(p))) for (_, n), p in zip(owner, parts, strict=True)])
            p = np.concatenate([probabilities(x[i : i + BATCH]) for i in range(0, len(x), BATCH)])
            np.add.at(sums, who, p * held[:, None])
            np.add.at(lengths, who, held)
        parts, owner, size = [], [], 0

    for i, text in enumerate(texts):
        if text and LETTER.search(text):
            raw = text.encode()
            parts.append(to_windows(raw))
            owner.append((i, len(raw)))
            size += len(parts[-1])
            if size >= 16 * BATCH:
                flush()
    flush()
    for i in np.flatnonzero(lengths):
        mean = sums[i] / lengths[i]
        langs[i], scores[i] = network.languages[int(mean.argmax())], round(float(min(1.0, mean.max())), 12)
    return langs, scores


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the labelled rows of ``docs`` and predict all of them."""
    return predict(docs, fit(docs, **options))


def accepted(docs: DataFrame, least: float = 0.35, **options) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or scores below ``least``.

    Where nothing could be learned, as no row has a label, only texts without a letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        if not shared.value.languages:
            return batch.filter(pa.array([bool(t and LETTER.search(t)) for t in texts], pa.bool_()))
        langs, scores = classify(shared.value, texts)
        return batch.filter(pa.array([lang != "und" and s >= least for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
