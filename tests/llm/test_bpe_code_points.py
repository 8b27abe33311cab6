"""Every code point, and every pair of combining marks, against the tokenizers library."""

import unicodedata

import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe

POINTS = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def test_every_code_point(library):
    own = bpe.Bpe(bpe.VOCABULARY)
    for at in range(0, len(POINTS), 50_000):
        texts = [f"ab{chr(c)}cd" for c in POINTS[at : at + 50_000]]
        wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != e.ids]
        assert wrong == []


def test_every_pair_of_marks(library):
    """After a letter that some of them compose with; the library's own normaliser is the measure."""
    own = bpe.Bpe(bpe.VOCABULARY)
    marks = [chr(c) for c in POINTS if unicodedata.combining(chr(c))]
    for a in marks:
        text = " ".join(f"e{a}{b}" for b in marks)
        assert own.normalise(text) == library.normalizer.normalize_str(text)


def test_forms_of_every_code_point(library):
    own = bpe.Bpe(bpe.VOCABULARY)
    for c in POINTS:
        text = unicodedata.normalize("NFD", chr(c))
        if not text.isspace():
            assert own.normalise(text) == library.normalizer.normalize_str(text)
