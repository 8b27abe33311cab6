"""Secret scans: fixed patterns, and character Markov models for strings that no pattern names.

Patterns (leftmost, not overlapping within a kind; matches that are too short are dropped): ``assign``,
``access`` and ``hex``. Besides them every run of 20 or more characters of ``RUN`` that no pattern span
touches is scored by two character Markov models, one of random strings and one of ordinary identifiers and
words. If the log-likelihood ratio per transition is above ``threshold`` the run is a span of kind ``random``; else
its best stretch of 20 or more characters is one, if that is above it, and so on left and right of that: a key
behind a long name or path is found. Both models are trained from labelled samples.

Defined cases: null text is empty; empty texts have no spans; positions are code points, ends exclusive;
rows are independent, so null or repeated doc_ids and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is maximal, so shorter ones can be passed over at once
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20

#: Ordinary parts of identifiers, for the labelled samples.
PARTS = """get set is has make find load store read write open close user account order item price total count index value
name type list map table column field query result response request client server session handler manager factory builder
service config option default update delete insert create remove parse format encode decode process thread worker queue
stream buffer cache token time date event message error status state code path file image page text line word number
http https www com org net html json xml api data test main util common core base model view control version release
nicht auch eine werden haben sein freiheit einheit wirklichkeit gesellschaft verpflichtung satzung versetzt kopf
empfehlung entscheidung schliesslich tatsache schifffahrt dampf wirtschaft rechts schutz pour dans avec cette sont para como esta pero desde""".split()


def labelled_samples(seed: int = 11, each: int = 4000) -> list[tuple[str, int]]:
    """(string, 1 if random else 0): random strings over usual alphabets, and identifiers put together from PARTS."""
    pick = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = [letters + letters.upper() + "0123456789" + extra for extra in ("", "+/", "_-")] + [letters.upper() + "0123456789", letters + "0123456789", letters, letters.upper()]
    samples = [("".join(pick.choices(pick.choice(alphabets), k=pick.randrange(20, 65))), 1) for _ in range(each)]
    for _ in range(each):
        words = pick.choices(PARTS, k=pick.randrange(3, 8))
        style = pick.randrange(5)
        if style == 0:
            text = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 1:
            text = "".join(w.capitalize() for w in words)
        else:
            text = ("_", "-", "/")[style - 2].join(w.upper() if style == 2 and pick.random() < 0.5 else w for w in words)
        samples.append((text + (str(pick.randrange(3000)) if pick.random() < 0.3 else ""), 0))
    samples += [(c * n, 0) for c in "=-_/+" for n in range(20, 60)]  # ruled lines
    return samples


class Markov:
    """First-order character models of two classes with add-``smooth`` counts over printable ASCII."""

    def __init__(self, samples: list[tuple[str, int]], smooth: float = 0.5):
        counts = [[[smooth] * 96 for _ in range(96)] for _ in range(2)]
        for text, label in samples:
            before = 95
            for c in self.codes(text):
                counts[label][before][c] += 1
                before = c
        logs = [[[math.log(n / sum(row)) for n in row] for row in table] for table in counts]
        self.ratio = [[a - b for a, b in zip(x, y, strict=True)] for x, y in zip(logs[1], logs[0], strict=True)]

    @staticmethod
    def codes(text: str) -> list[int]:
        return [min(max(ord(c) - 32, 0), 94) for c in text]

    def ratios(self, text: str) -> list[float]:
        """Log-likelihood ratio of each transition, the first from the start: above 0 random is likelier."""
        codes = self.codes(text)
        ratio = self.ratio
        return [ratio[a][b] for a, b in zip([95, *codes], codes, strict=False)]

    def score(self, text: str) -> float:
        """Log-likelihood ratio per transition."""
        return sum(self.ratios(text)) / max(1, len(text))


def stretches(ratios: list[float], threshold: float, least: int = LEAST) -> list[tuple[int, int]]:
    """Places of the stretches of ``least`` or more whose mean is above ``threshold``: all of it, or the best sum first."""
    if len(ratios) < least:
        return []
    if sum(ratios) > threshold * len(ratios):
        return [(0, len(ratios))]
    sums = list(accumulate((r - threshold for r in ratios), initial=0.0))
    best, lowest = (0.0, 0, 0), 0
    for end in range(least, len(sums)):
        begin = end - least
        if sums[begin] < sums[lowest]:
            lowest = begin
        if sums[end] - sums[lowest] > best[0]:
            best = (sums[end] - sums[lowest], lowest, end)
    if best[0] <= 1e-9:
        return []
    _, s, e = best
    return [*stretches(ratios[:s], threshold, least), (s, e), *((e + a, e + b) for a, b in stretches(ratios[e:], threshold, least))]


@lru_cache(maxsize=4)
def trained(seed: int = 11, each: int = 4000) -> Markov:
    return Markov(labelled_samples(seed, each))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return sorted(found)


def model_spans(text: str, base: list[tuple[int, int, int]], model: Markov, threshold: float) -> list[tuple[int, int, int]]:
    found = []
    for m in RUN.finditer(text):
        if not any(s < m.end() and m.start() < e for s, _, e in base):
            found += [(m.start() + s, 3, m.start() + e) for s, e in stretches(model.ratios(m[0]), threshold)]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, threshold: float = 0.35, seed: int = 11, each: int = 4000) -> DataFrame:
    """doc_id, counts by kind, base_sha256, all spans as text, and ``n_random``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = trained(seed, each)
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            more = model_spans(text or "", base, model, threshold)
            count = [sum(1 for _, k, _ in base if k == kind) for kind in range(3)]
            rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
