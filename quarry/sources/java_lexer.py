"""A lexer for Java source text."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, keyword, number, long, char, string, block, op
    text: str
    line: int


#: Reserved words of the language, and its operators, longest first.
KEYWORDS = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final
finally float for goto if implements import instanceof int interface long native new package private protected public
return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null""".split()
)
PRIMITIVES = frozenset("boolean byte char short int long float double void".split())
OPERATORS = ("...", "<<=", "->", "::", "++", "--", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<")

_SCAN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<block>\"\"\".*?(?<!\\)\"\"\")|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<number>0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)"""
    r"""|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>"""
    + "|".join(map(re.escape, OPERATORS))
    + r"""|[-+*/%&|^~!<>=?:;,.(){}\[\]@])""",
    re.DOTALL,
)


class LexError(ValueError):
    pass


def lex(text: str) -> list[Token]:
    """Tokens without white space and comments. ``>`` always stands alone, so that type arguments close easily."""
    out, at, line = [], 0, 1
    while at < len(text):
        m = _SCAN.match(text, at)
        if m is None:
            raise LexError(f"line {line}: unexpected {text[at]!r}")
        kind, body = m.lastgroup, m[0]
        if kind == "name" and body in KEYWORDS:
            kind = "keyword"
        elif kind == "number" and body[-1] in "lL":
            kind = "long"
        if kind not in ("space", "comment"):
            out.append(Token(kind, body, line))
        line += body.count("\n")
        at = m.end()
    return out
