"""Byte-pair encoding and decoding with a public vocabulary file.

Each pre-token is a doubly linked list of symbols. A priority queue holds the merge rank of every
adjacent pair; an entry whose left symbol or partner has changed since is stale and skipped. Decoding
concatenates vocabulary strings. Words repeat, so each worker remembers the encoding of some of them;
that memory is bounded (REMEMBERED words, twice) and only saves time.

Defined cases: a null text is the empty text; an empty or all-white text gives no ids and decodes to
the empty string. Rows are independent: repeated rows, null or repeated doc_ids and extra columns have
no influence on each other.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import map_batches

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words in one generation of the encodings that a worker remembers; it keeps two.
REMEMBERED = 300_000
#: Code points that the regex module already counts as letters or numbers while the tokenizers library doesn't.
NOT_YET = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F "
    "12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
#: Combining marks newer than the tokenizers library's tables, which it leaves where they are, and the second half
#: of a pair (11935 11930) that it doesn't compose.
LATER_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 "
    "10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 "
    "119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE "
    "1E2EC-1E2EF 1E4EC-1E4EF "
)

FIRST_LATER = chr(int(NOT_YET[:4], 16))
#: Capitals of Unicode 16 and 17 with their small letters, which Python's tables lack.
LATER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def character_class(spans: str) -> str:
    """The inside of a pattern's class for code points and ranges in hexadecimal."""
    return "".join("-".join(f"\\U{int(end, 16):08x}" for end in span.split("-")) for span in spans.split())


#: Around these nothing is reordered or composed, as around any other character of combining class 0 that is part of no pair.
UNMOVED = regex.compile(f"([{character_class(LATER_MARKS)}])")


def split_pattern(pattern: str) -> regex.Pattern:
    """The file's split pattern with the letters and numbers of the tokenizers library's Unicode version."""
    later = character_class(NOT_YET)
    for kind in ("L", "N"):
        own = rf"[\p{{{kind}}}--[{later}]]"
        pattern = pattern.replace(rf"[\p{{{kind}}}]", own).replace(rf"\p{{{kind}}}]", f"{own}]").replace(rf"\s\p{{{kind}}}", rf"\s{own}")
    return regex.compile(pattern, regex.V1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file (NFC, white space folded, lower case, word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words, self.careful = regex.compile(split), split_pattern(split)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbols = byte_symbols()
        self.base = max(self.tokens) + 1
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(self.vocab[left] * self.base + self.vocab[right], rank)
            self.result.append(self.vocab[left + right])
        self.first = [self.vocab.get(s) for s in self.symbols]
        self.last = [self.vocab.get(s + self.suffix) for s in self.symbols]
        self.spelled = [self.tokens.get(i, "").encode() for i in range(self.base)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token. A queue entry is its rank and its left symbol's position in one integer."""
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        n, base, rank = len(ids), self.base, self.rank.get
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] * base + ids[i + 1])) is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before, result = list(range(1, n + 1)), list(range(-1, n - 1)), self.result
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            if (left := ids[i]) < 0 or (j := after[i]) >= n or rank(left * base + ids[j]) != entry >> 32:
                continue  # stale
            ids[i] = merged = result[entry >> 32]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(merged * base + ids[k])) is not None:
                    heappush(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] * base + merged)) is not None:
                heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def normalise(self, text: str) -> str:
        """NFC and lower case, each letter by itself. White space only ends words, so it needs no folding."""
        if text.isascii():
            return text.lower()
        if UNMOVED.search(text):
            text = "".join([unicodedata.normalize("NFC", part) for part in UNMOVED.split(text)])
        else:
            text = unicodedata.normalize("NFC", text)
        if max(text) >= FIRST_LATER:
            text = text.translate(LATER_CAPITALS)
        return "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()

    def piece(self, word: str) -> bytes:
        """Ids of one pre-token, little-endian; the words of the last two generations are remembered."""
        found = self.old.get(word) or array("I", self.merge(word.encode())).tobytes()
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, special tokens in it included, as little-endian unsigned 32-bit integers."""
        if self.marks is None or "<|" not in text:
            return self.plain(text)
        out, at = [], 0
        for mark in self.marks.finditer(text):
            out += self.plain(text[at : mark.start()]), array("I", [self.special[mark[0]]]).tobytes()
            at = mark.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        known, piece = self.young.get, self.piece
        text = self.normalise(text)
        words = (self.careful if text > "" and max(text) >= FIRST_LATER else self.words).findall(text)
        if len(self.young) + len(words) >= REMEMBERED:  # piece() may replace the dictionary meanwhile
            return b"".join([self.young.get(w) or piece(w) for w in words])
        return b"".join([known(w) or piece(w) for w in words])

    def encode(self, text: str) -> list[int]:
        return array("I", self.ids(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, joined by one space, as a tokenizer file without a decoder asks; unknown ids give nothing."""
        return self.spell(ids).decode()

    def spell(self, ids) -> bytes:
        return b" ".join([s for i in ids if i < self.base and (s := self.spelled[i])])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """Columns of ``docs`` plus ``token_ids`` array<int>."""
    taken = {c.lower() for c in docs.columns}
    if "token_ids" in taken:
        raise ValueError("the input already has a column token_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary)
        ids = pa.array([bpe.encode(t or "") for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "token_ids"])

    return map_batches(docs, run, schema)


def digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary)
        counts, ids_hash, text_hash = [], [], []
        for text in batch.column("text").to_pylist():
            joined = bpe.ids(text or "")
            counts.append(len(joined) // 4)
            ids_hash.append(hashlib.sha256(joined).hexdigest())
            text_hash.append(hashlib.sha256(bpe.spell(array("I", joined))).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
