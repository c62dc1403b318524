"""Splitting a text into the pieces that merges stay within.

Python's ``re`` is twice as quick as the full Unicode classes of ``regex`` and
agrees with them on Latin text; texts with other characters take the latter.
"""

from __future__ import annotations

import re

import regex

#: Characters on which ``re``'s classes and the Unicode classes may differ.
_OTHER = re.compile("[^\t-\r -~¡-±´-¸º»¿-ɏ]")

#: White space by the Unicode property, which ``\s`` of these libraries is not quite.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def plain(text: str) -> bool:
    """Whether the quick classes are exact on this text."""
    return _OTHER.search(text) is None


def splitter(pattern: str):
    """``text -> list of pieces`` for a pattern that uses ``\\p{L} \\p{N} \\s \\S``."""
    exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]")
    exact = exact.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    quick = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"[\p{L}]", r"[^\W\d_]")
    quick = quick.replace(r"[\p{N}]", r"\d").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    slow, fast = regex.compile(exact), re.compile(quick)

    def split(text: str) -> list[str]:
        return (fast if plain(text) else slow).findall(text)

    return split
