"""The character classes of the report, for Python and for Spark's regular expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import regex

#: Word characters (XID_Continue), letters and digits, white space, in Java's syntax.
#: Compatibility forms that begin no identifier part in NFKC, and joiners and middle dots that are one.
JVM_WORD = (
    r"[\w[\p{javaUnicodeIdentifierPart}&&[^\p{javaIdentifierIgnorable}\x{37A}\x{2E2F}\x{309B}\x{309C}\x{FC5E}-\x{FC63}\x{FDFA}\x{FDFB}"
    r"\x{FE70}\x{FE72}\x{FE74}\x{FE76}\x{FE78}\x{FE7A}\x{FE7C}\x{FE7E}]]\x{200C}\x{200D}\x{30FB}\x{FF65}]"
)
JVM_ALNUM = r"[\p{IsAlphabetic}\p{N}]"
JVM_SPACE = r"\p{IsWhite_Space}"

_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_ALPHA = regex.compile(r"\p{Alphabetic}")
_LOWER = regex.compile(r"\p{Lowercase}")
_UPPER = regex.compile(r"\p{Uppercase}")

#: White space by the Unicode property.
WHITE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
WHITE_CLASS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ASCII_BLANK = frozenset(" \t\n\r")


@lru_cache(maxsize=1 << 16)
def is_word(c: str) -> bool:
    """XID_Continue: what words are counted by and bounded by."""
    return ("a" + c).isidentifier()


@lru_cache(maxsize=1 << 16)
def is_alnum(c: str) -> bool:
    """Alphabetic or a number."""
    return _ALNUM.match(c) is not None


@lru_cache(maxsize=1 << 16)
def is_alpha(c: str) -> bool:
    """Alphabetic."""
    return _ALPHA.match(c) is not None


@lru_cache(maxsize=1 << 16)
def is_lower(c: str) -> bool:
    """Lowercase by the Unicode property."""
    return _LOWER.match(c) is not None


@lru_cache(maxsize=1 << 16)
def is_upper(c: str) -> bool:
    """Uppercase by the Unicode property."""
    return _UPPER.match(c) is not None


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, all else as it is; length and places stay."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_ASCII_WORDS = re.compile(r"[0-9A-Za-z_]+")
_UNKNOWN = 2
_word_table = np.full(0x110000, _UNKNOWN, dtype=np.uint8)  #: :func:`is_word` of each code point that was met


def count_words(text: str) -> int:
    """Maximal runs of word characters."""
    if text.isascii():
        return len(_ASCII_WORDS.findall(text))
    points = codes(text)
    word = _word_table[points]
    if (word == _UNKNOWN).any():
        new = np.unique(points[word == _UNKNOWN])
        _word_table[new] = [is_word(chr(c)) for c in new.tolist()]
        word = _word_table[points]
    return int(word[0]) + int(np.count_nonzero(word[1:] > word[:-1]))


class Bytes:
    """Code point places of a text as UTF-8 byte offsets."""

    def __init__(self, text: str):
        self.at = None
        if not text.isascii():
            points = codes(text)
            size = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
            self.at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        self.total = int(self.at[-1]) if self.at is not None else len(text)

    def __call__(self, place: int) -> int:
        return int(self.at[place]) if self.at is not None else place
