"""Verbatim repeats: maximal word runs that begin in an equal shingle."""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np
import regex

from quillspark.functions.chars import codes

#: Earlier places of a shingle that are tried, most recent first (a fixed value: it shows in results).
TRIED = 32
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}'\u2019]+")
_ASCII_WORDS = bytes(ord(chr(c).lower()) if c < 128 and (chr(c).isalnum() or c == 39) else 32 for c in range(256))
_UNKNOWN = 2
_word_points = np.full(0x110000, _UNKNOWN, dtype=np.uint8)  #: of each code point that was met, whether words have it
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 20  #: names that are compared at once


class Token(NamedTuple):
    """A word and where it stands, in code points, in which file."""

    word: str
    start: int
    end: int
    file: int


class Run(NamedTuple):
    """Token numbers of an earlier and a later copy, and their length in words."""

    earlier: int
    later: int
    length: int


def _in_words(points: np.ndarray) -> np.ndarray:
    """Whether each of some code points belongs to a word."""
    got = _word_points[points]
    if (got == _UNKNOWN).any():
        new = np.unique(points[got == _UNKNOWN])
        _word_points[new] = [_WORD.match(chr(c)) is not None for c in new.tolist()]
        got = _word_points[points]
    return got == 1


def words_of(text: str) -> list[str]:
    """Lower-cased words of letters, digits and apostrophes, in order."""
    if text.isascii():
        return text.encode().translate(_ASCII_WORDS).decode().split()
    points = codes(text)
    # no white space is in a word; letters are lowered one by one: a sigma at a word's end as anywhere
    apart = np.where(_in_words(points), points, np.uint32(32)).tobytes().decode("utf-32-le")
    return apart.replace("\u2019", "'").replace("Σ", "σ").lower().split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of :func:`words_of` stand, in code points."""
    edges = np.flatnonzero(np.diff(_in_words(codes(text)).view(np.int8), prepend=0, append=0)).tolist()
    return list(zip(edges[::2], edges[1::2]))


def tokenize(text: str, file: int = 0) -> list[Token]:
    """The words of a text with their places."""
    return [Token(w, s, e, file) for w, (s, e) in zip(words_of(text), word_spans(text))]


def _agree(ids: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from two places on are the same, at most so many; looked at in growing blocks."""
    done, width = 0, 16
    while done < most:
        w = min(width, most - done)
        differ = np.flatnonzero(ids[a + done : a + done + w] != ids[b + done : b + done + w])
        if len(differ):
            return done + int(differ[0])
        done, width = done + w, width * 4
    return done


class _Words:
    """The words of files in one row, numbered; each file is a stretch of them that no run leaves."""

    def __init__(self, words: list[str], k: int, files: list[int] | None = None):
        number = dict(zip(words, range(len(words))))
        self.k, self.n = k, len(words)
        self.ids = np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=self.n)
        self.files = files

    def repeated(self) -> list[int]:
        """The places whose shingle may stand elsewhere too, by a hash; all others have no copy."""
        m = self.n - self.k + 1
        if m < 2:
            return []
        h, width = self.ids.astype(np.uint64), 1
        while width < self.k:  # two stretches, which may overlap, make a longer one
            step = min(width, self.k - width)
            h = (h[:-step] * _MIX + h[step:] + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(29)
            width += step
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        return np.unique(order[np.concatenate([same, same + 1])]).tolist() if len(same) else []

    def ready(self) -> None:
        """What :meth:`shingle` and :meth:`run` read; made only for words that have a repeated place."""
        self.back = self.ids[::-1]
        self.raw = self.ids.tobytes()
        if self.files is None:
            self.first, self.past = [0] * self.n, [self.n] * self.n
            return
        files = np.asarray(self.files, dtype=np.int64)
        edges = np.flatnonzero(np.diff(files, prepend=-1, append=-1))
        self.first, self.past = np.repeat(edges[:-1], np.diff(edges)).tolist(), np.repeat(edges[1:], np.diff(edges)).tolist()

    def shingle(self, i: int) -> bytes | None:
        """What tells shingles apart; None where a file ends within."""
        return self.raw[4 * i : 4 * (i + self.k)] if i + self.k <= self.past[i] else None

    def run(self, e: int, i: int, apart: int) -> Run:
        """The run that two equal shingles are in; copies of one file are ``apart`` and do not grow into each other."""
        ahead = self.k + _agree(self.ids, e + self.k, i + self.k, min(self.past[e] - e, self.past[i] - i, apart) - self.k)
        behind = _agree(self.back, self.n - e, self.n - i, min(e - self.first[e], i - self.first[i], apart - ahead))
        return Run(e - behind, i - behind, ahead + behind)


def find_runs(tokens: list[Token], k: int, floor: int, across: bool = False) -> list[Run]:
    """Repeats of at least ``floor`` words, left to right.

    At each word whose shingle of ``k`` has been seen, up to ``TRIED`` earlier
    places are tried and the one with the longest shared run, both ways, wins;
    of equal ones the earliest. Copies in one file must not overlap; with
    ``across`` only copies in different files count. A reported run is skipped
    over, and words skipped begin no later match.
    """
    return _runs(_Words([t.word for t in tokens], k, [t.file for t in tokens]), k, floor, across)


def own_runs(text: str, k: int, floor: int) -> list[Run]:
    """:func:`find_runs` of one text."""
    return _runs(_Words(words_of(text), k), k, floor, False)


def _runs(words: _Words, k: int, floor: int, across: bool) -> list[Run]:
    repeated = words.repeated()
    if repeated:
        words.ready()
    places: dict[bytes, list[int]] = {}
    runs: list[Run] = []
    after = 0
    for i in repeated:
        shingle = words.shingle(i) if i >= after else None
        if shingle is None:
            continue
        known = places.setdefault(shingle, [])
        home = words.first[i]
        fit = [e for e in known[-TRIED:] if (words.first[e] != home if across else e + k <= i)]
        tried = [words.run(e, i, words.n if across else i - e) for e in fit]
        best = max(tried, key=lambda r: (r.length, -r.earlier + r.later), default=None)
        known.append(i)
        if best is not None and best.length >= floor:
            runs.append(best)
            after = best.later + best.length
    return runs


def _grams(names: np.ndarray, width: int) -> np.ndarray:
    """A number for each stretch of ``width`` names that stands more than once; -1 for all others, and where a name is under 0."""
    out = names
    for step in range(1, width):
        a, b = out[:-1], names[step:]
        both, fit = a * (names.max() + 1) + b, (a >= 0) & (b >= 0)
        out = np.full(len(a), -1, dtype=np.int64)
        out[fit] = np.unique(both[fit], return_inverse=True)[1]
    fit = np.flatnonzero(out >= 0)
    times = np.bincount(out[fit], minlength=1)
    out[fit[times[out[fit]] < 2]] = -1
    return out


def _alike(names: np.ndarray, early: np.ndarray, late: int, step: int, most: np.ndarray) -> np.ndarray:
    """How many names from each of some places on, or back, are those from another place on; at most so many; looked at in growing blocks."""
    got = np.zeros(len(early), dtype=np.int64)
    on, width = np.flatnonzero(most > 0), 8
    while len(on):
        w = min(width, max(1, _CELLS // len(on)))
        far = got[on, None] + np.arange(w)
        within = far < most[on, None]
        far = np.where(within, far, 0) * step
        same = within & (names[early[on, None] + far] == names[late + far])
        run = np.where(same.all(axis=1), w, same.argmin(axis=1))
        got[on] += run
        on, width = on[run == w], width * 4
    return got


def whole_runs(places: np.ndarray, shingles: np.ndarray, k: int, floor: int) -> list[Run]:
    """:func:`own_runs` where every earlier place of a shingle is tried, of a text's repeated ``shingles`` (any numbers) and their ``places``.

    A run is a stretch of equal shingles, so the words are not needed. Places
    meet by stretches of as many shingles as ``floor`` words have: those that
    share less begin no run, so a shingle's places are not paired with each other.
    """
    if not len(places):
        return []
    size, width = int(places.max()) + 1, floor - k + 1
    names = np.full(size, -1, dtype=np.int64)
    names[places] = np.unique(shingles, return_inverse=True)[1]
    if size < width:
        return []
    grams = _grams(names.copy(), width)
    alone = np.flatnonzero(names < 0)
    names[alone] = -1 - alone
    met = np.zeros(size, dtype=bool)
    for o in range(width):
        met[o : o + len(grams)] |= grams >= 0
    known: list[dict[int, array]] = [{} for _ in range(width)]  # by how many shingles before a place its stretch begins
    runs: list[Run] = []
    after = 0
    for i in np.flatnonzero(met).tolist():
        if i < after:
            continue
        at = [(o, int(grams[i - o])) for o in range(width) if 0 <= i - o < len(grams) and grams[i - o] >= 0]
        mine = [known[o].setdefault(g, array("q")) for o, g in at]
        early = np.concatenate([np.array(x, dtype=np.int64) for x in mine])
        early = early[early <= i - floor]
        keep = True  # as an earlier copy of what follows
        if len(early):
            d = i - early
            on = _alike(names, early, i, 1, np.minimum(d - k + 1, size - i))
            ahead = on + (k - 1)
            back = _alike(names, early - 1, i - 1, -1, np.minimum(early, d - ahead))
            length = ahead + back
            x = int(np.lexsort((early, -length))[0])
            a, b = int(on[x]), int(back[x])
            runs.append(Run(int(early[x]) - b, i - b, int(length[x])))
            after = i + int(ahead[x])
            # between shingles that stand once, nothing follows of which its own earlier copy is not as long and earlier
            keep = a + k - 1 + b >= d[x] or (i + a < size and names[i + a] >= 0) or names[i - b - 1] >= 0
        if keep:
            for x in mine:
                x.append(i)
    return runs


def longest(runs: list[Run], most: int) -> list[Run]:
    """The ``most`` longest runs; equal ones by place."""
    return sorted(runs, key=lambda r: (-r.length, r.later, r.earlier))[:most]
