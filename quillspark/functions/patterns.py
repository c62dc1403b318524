"""Exact spans of bounded patterns under overlapping semantics.

Every end at which a pattern can stop is a hit, from the leftmost start that
reaches it; hits whose edges are no word boundaries are dropped after that.
"""

from __future__ import annotations

from functools import lru_cache
from re import _parser as parser  # type: ignore[attr-defined]

import regex

from quillspark.functions.chars import WHITE_CLASS, is_word

_ASCII_WORD = "(?-i:[0-9A-Za-z_])"
_EDGE = rf"(?:(?<={_ASCII_WORD})(?!{_ASCII_WORD})|(?<!{_ASCII_WORD})(?={_ASCII_WORD}))"
_WIDEST = 1_000  #: characters of a match, at most, up to which it is looked for around its literals alone
_FOLDS_TO_ASCII = ("ſ", "K")


def _translate(pattern: str) -> str:
    r"""``\s`` and ``\b`` as the catalog means them: Unicode white space, ASCII word edge."""
    out, k = [], 0
    in_class = False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            two = pattern[k : k + 2]
            if two == r"\s":
                out.append(WHITE_CLASS[1:-1] if in_class else WHITE_CLASS)
            elif two == r"\b" and not in_class:
                out.append(_EDGE)
            else:
                out.append(two)
            k += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(c)
        k += 1
    return "".join(out)


def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-cased strings of which every match has at least one; empty if none are sure."""

    def of(items) -> list[str] | None:
        best: list[str] | None = None
        run = ""

        def take(found: list[str] | None):
            nonlocal best
            if found and (best is None or min(map(len, found)) > min(map(len, best))):
                best = found

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            if run:
                take([run])
                run = ""
            if name == "SUBPATTERN":
                take(of(arg[3]))
            elif name == "BRANCH":
                each = [of(b) for b in arg[1]]
                take([x for e in each for x in e] if all(each) else None)
            elif name == "MAX_REPEAT" and arg[0] > 0:
                take(of(arg[2]))
        if run:
            take([run])
        return best

    return tuple(dict.fromkeys(x.lower() for x in of(parser.parse(pattern)) or ()))


def _looks_far(items) -> bool:
    """Whether a parsed pattern tells anything by more than one character beside its match."""
    for op, arg in items:
        name = str(op)
        if name in ("ASSERT", "ASSERT_NOT", "GROUPREF", "GROUPREF_EXISTS"):
            return True
        if name == "AT" and str(arg) not in ("AT_BEGINNING", "AT_BOUNDARY", "AT_NON_BOUNDARY"):
            return True
        if name == "SUBPATTERN":
            inner = [arg[3]]
        elif name == "BRANCH":
            inner = arg[1]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner = [arg[2]]
        elif name == "ATOMIC_GROUP":
            inner = [arg]
        else:
            continue
        if any(map(_looks_far, inner)):
            return True
    return False


class Pattern:
    """One pattern, compiled once a process."""

    def __init__(self, pattern: str, bound_start: bool, bound_end: bool):
        self.literals = required_literals(pattern)
        self.bound_start, self.bound_end = bound_start, bound_end
        flags = regex.MULTILINE | regex.VERSION0
        self.longest = regex.compile(_translate(pattern), flags | regex.POSIX)
        self.any = regex.compile(_translate(pattern), flags)
        core = pattern.removesuffix(r"\b") if bound_end else pattern
        self.core = regex.compile(_translate(core), flags)
        parsed = parser.parse(pattern)
        self.width = parsed.getwidth()[1]
        self.local = bool(self.literals) and self.width <= _WIDEST and not _looks_far(parsed)

    def possible(self, lowered: str) -> bool:
        """False only if no match can be in the text that was lower-cased to ``lowered``."""
        return not self.literals or any(x in lowered for x in self.literals)

    def near(self, text: str, places: list[tuple[int, int]]) -> bool:
        """False only if no match holds one of its literals, which stand at ``places``; only the text around them is searched."""
        if not self.local or len(places) * self.width > len(text):
            return True
        lo = hi = 0
        for s, e in sorted(places):
            s, e = max(0, e - self.width - 1), s + self.width + 1
            if s > hi:
                if hi and self.any.search(text[lo:hi]):
                    return True
                lo = s
            hi = max(hi, e)
        return bool(places) and self.any.search(text[lo:hi]) is not None

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The hits that no other hit of this pattern contains, as code point places."""
        if self.any.search(text) is None:
            return []
        if text.isascii():
            # the two kinds of word edge agree; the longest match from each start is enough
            out, reached = [], 0
            for m in self.longest.finditer(text, overlapped=True):
                s, e = m.span()
                if e > reached:
                    out.append((s, e))
                    reached = e
            return out
        start_of: dict[int, int] = {}
        for m in self.any.finditer(text, overlapped=True):
            s = m.start()
            for e in range(s + 1, min(len(text), s + self.width) + 1):
                if e not in start_of and self.core.fullmatch(text, s, e) and (not self.bound_end or _ascii_edge(text, e)):
                    start_of[e] = s
        return [
            (s, e)
            for e, s in start_of.items()
            if (not self.bound_start or word_edge(text, s)) and (not self.bound_end or word_edge(text, e))
        ]


def _ascii_edge(text: str, at: int) -> bool:
    def word(k):
        return 0 <= k < len(text) and text[k].isascii() and (text[k].isalnum() or text[k] == "_")

    return word(at - 1) != word(at)


def word_edge(text: str, at: int) -> bool:
    """Whether exactly one side of a place is a word character."""
    before = at > 0 and is_word(text[at - 1])
    after = at < len(text) and is_word(text[at])
    return before != after


@lru_cache(maxsize=4096)
def compiled(pattern: str, bound_start: bool, bound_end: bool) -> Pattern:
    """The pattern's matcher, kept for the life of the process."""
    return Pattern(pattern, bound_start, bound_end)


def folds_oddly(text: str) -> bool:
    """Whether a text has characters that fold to ASCII letters, so that literals in its lower case prove nothing."""
    return any(c in text for c in _FOLDS_TO_ASCII)


def folded(text: str) -> str:
    """The text as patterns without case take it: each character that matches an ASCII letter as that letter, in its place."""
    return text.lower() if text.isascii() else text.replace("İ", "i").lower().replace("ſ", "s")
