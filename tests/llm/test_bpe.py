import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def odd_texts():
    pick = random.Random(1)
    ranges = [(32, 0x250), (0x250, 0x3000), (0x3000, 0xD000), (0x10000, 0x20000)]
    return ["", "  \n", "Hello world's 123 don't", "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "ΑΣ ΣΑΣ İ", "é é", "x" * 3000, "ab " * 2000] + [
        "".join(chr(pick.randrange(*pick.choice(ranges))) for _ in range(60)) for _ in range(200)
    ]


def test_matches_the_library(library):
    own = bpe.Bpe(bpe.VOCABULARY)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_remembering_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small, texts = bpe.Bpe(bpe.VOCABULARY), ["one two three four five one two", "six one seven two three"] * 3
    large = bpe.load(bpe.VOCABULARY)
    assert [small.encode(t) for t in texts] == [large.encode(t) for t in texts]


def test_digest_over_rows(spark, library):
    rows = [(1, "Some Text"), (1, "Some Text"), (None, None), (2, ""), (3, "ünï 🙂")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as token")
    found = sorted((tuple(r) for r in bpe.digest(docs).collect()), key=str)
    expected = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    assert bpe.digest(docs.limit(0)).collect() == []


def test_encode_keeps_the_columns(spark):
    docs = spark.createDataFrame([(7, "two words", None)], "doc_id long, text string, extra string")
    assert bpe.encode(docs).first().asDict() == {"doc_id": 7, "text": "two words", "extra": None, "token_ids": bpe.load(bpe.VOCABULARY).encode("two words")}
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("extra", "TOKEN_IDS"))
