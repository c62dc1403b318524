"""Where a place in a text lies: fenced code, block quote, quotation, heading or prose."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import regex

from quillspark.functions.chars import WHITE, WHITE_CLASS, ascii_lower, is_upper

KINDS = ("fenced-code", "blockquote", "quoted", "heading")
_WHITE = "".join(WHITE)

# Words that may be lower-case in a title.
SMALL_WORDS = ("a", "an", "the", "and", "or", "of", "in", "on", "for", "to", "with", "at", "by", "vs")


def lines(text: str) -> Iterator[tuple[int, str]]:
    """(place, line) of each line, without its end; a last empty line does not count."""
    at = 0
    for raw in text.split("\n"):
        if at >= len(text):
            return
        yield at, raw.removesuffix("\r")
        at += len(raw) + 1


def is_title(line: str) -> bool:
    """A short line in title case without closing punctuation."""
    t = line.strip(_WHITE)
    if not t or len(t.encode()) > 60 or t[-1] in ".!?,;:":
        return False

    def leads(w: str) -> bool:
        return is_upper(w[0]) or w[0] in "0123456789"

    words = _words(t)
    return leads(words[0]) and all(leads(w) or ascii_lower(w) in SMALL_WORDS for w in words[1:])


def _words(t: str) -> list[str]:
    if t.isascii() and not any("\x1c" <= c <= "\x1f" for c in t):
        return t.split()
    out, word = [], ""
    for c in t + " ":
        if c in WHITE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def _pairs(opening: str, closing: str) -> regex.Pattern:
    """From a mark to the next closing one, or what is left of the session, in which none closes; a blank line ends a session."""
    body = rf"[^{closing}\n]*+(?:\n(?!{WHITE_CLASS}*\n)[^{closing}\n]*+)*+"
    return regex.compile(f"{opening}{body}{closing}?")


_QUOTES = (('"', _pairs('"', '"')), ("\u201d", _pairs("\u201c", "\u201d")))


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            s, e = out[-1][0], max(e, out.pop()[1])
        out.append((s, e))
    return out


def container_ranges(text: str) -> dict[str, list[tuple[int, int]]]:
    """Sorted, disjoint ranges of each kind, as code point places."""
    told = [(at, at + len(line), line.lstrip(_WHITE), line) for at, line in lines(text)]
    marks = [(s, e) for s, e, body, _ in told if body.startswith("```")]
    ends = [e for _, e in marks[1::2]] + [len(text)]  # an open fence runs to the end
    pairs = [(m.start(), m.end()) for closing, p in _QUOTES for m in p.finditer(text) if len(m.group()) > 1 and m.group()[-1] == closing]
    return {
        "fenced-code": [(s, e) for (s, _), e in zip(marks[::2], ends)],
        "blockquote": [(s, e) for s, e, body, _ in told if body[:1] == ">"],
        "quoted": _joined(pairs),
        "heading": [(s, e) for s, e, body, line in told if body and body[0] != ">" and (body[0] == "#" or is_title(line))],
    }


class Classifier:
    """Looks places up in a text's ranges; the first kind of ``KINDS`` that covers one wins."""

    def __init__(self, text: str):
        ranges = container_ranges(text)
        self._kinds = [(k, [s for s, _ in ranges[k]], ranges[k]) for k in KINDS if ranges[k]]

    def __call__(self, place: int) -> str:
        for kind, starts, ranges in self._kinds:
            i = bisect_right(starts, place) - 1
            # an empty range covers nothing, and the one before it may still reach here
            while i >= 0 and ranges[i][1] <= ranges[i][0]:
                i -= 1
            if i >= 0 and place < ranges[i][1]:
                return kind
        return "prose"
