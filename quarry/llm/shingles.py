"""Word shingles of whole texts as 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarry.llm.common import SPACES

#: Bytes of text hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
ODD = [pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(64)]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES.encode())] = True
#: Each byte with A-Z lower-cased, off zero.
VALUE = np.array([(b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64((salt * BASE) % (1 << 64)))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, made once and lengthened when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            steps = [np.full(size, b, np.uint64) for b in (BASE, INVERSE)]
            for step in steps:
                step[0] = 1
            self.up, self.down = (np.cumprod(step, dtype=np.uint64) for step in steps)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _hash_chunk(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text data[offsets[i]:offsets[i + 1]]."""
    texts = len(offsets) - 1
    word = ~IS_SPACE[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]  # a text's end also ends a word
    opens[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * up[:-1], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(ODD[40]))
    first = np.searchsorted(starts, offsets)  # of each text's words
    if k == 1:
        rolled = mix(words * np.uint64(ODD[0]))
    else:
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            rolled += words[j : j + len(rolled)] * np.uint64(ODD[j])
        rolled = mix(rolled)
    out = []
    for i in range(texts):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            h = np.sort(rolled[a : b - k + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h)
        elif b > a:  # fewer words than a shingle: the whole sequence is one
            whole = (words[a:b] * np.array(ODD[: b - a], np.uint64)).sum() + np.uint64(b - a) * np.uint64(ODD[50])
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Lists of shingle sets, in the order of ``texts`` (null: empty), a bounded amount of text at a time."""
    texts = pa.array(texts.fill_null("")).cast(pa.large_string()) if not isinstance(texts, pa.LargeStringArray) else texts.fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    with np.errstate(over="ignore"):
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            yield _hash_chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], k)
            at = to
