"""Byte-pair merges as a lazily determinised finite-state transducer.

A token sequence is what the merges make of its text exactly if every two
neighbours are what the merges make of the two alone, so the last token of each
prefix of a text is determined by which token the prefix before it ends in. A
machine that reads symbols left to right need only remember, for every place
from which some token could still reach ahead, the token that ends there and
what was put out since the last place on which all of them agree. There are
finitely many such memories, because no token is longer than the longest one;
states are made when they are first reached. What all memories agree on is put
out, so output lags behind the input by less than the longest token.
"""

from __future__ import annotations

INF = float("inf")
MAX_STATES = 300_000
MAX_PAIRS = 1_000_000


class MergeTransducer:
    """Reads strings of symbols, puts out token ids or, with ``counting``, their number.

    ``ranks`` maps each token that merges can make, as a string of symbols, to
    its merge priority (lower first) and ``ids`` to its id. Merges join two
    neighbours whenever the joined string has a rank, the lowest rank first and
    the leftmost among equals. ``unknown(symbol)`` gives the ids of a symbol
    that is no token; such a symbol merges with nothing. States and pair
    verdicts are bounded caches: when full they are dropped and made again.
    """

    def __init__(self, ranks: dict[str, int], ids: dict[str, int], unknown=None, counting: bool = False):
        self.ranks = ranks
        self.ids = ids
        self.unknown = unknown or (lambda c: ())
        self.counting = counting
        self.text_of = {i: t for t, i in ids.items()}
        self.trie: list[dict[str, int]] = [{}]
        self.token_at: list[int] = [-1]
        for t, i in ids.items():
            at = 0
            for c in t:
                nxt = self.trie[at].get(c)
                if nxt is None:
                    nxt = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                    self.trie[at][c] = nxt
                at = nxt
            self.token_at[at] = i
        self.size = max(ids.values(), default=0) + 1
        self._pairs: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self._made: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        nothing = 0 if self.counting else ()
        self.states: dict[tuple, int] = {}
        self.memory: list[tuple] = []
        self.moves: list[dict] = []
        self.final: list = []
        self._state(((0, -1, nothing),))

    def _state(self, memory: tuple) -> int:
        s = self.states.get(memory)
        if s is None:
            s = self.states[memory] = len(self.memory)
            self.memory.append(memory)
            self.moves.append({})
            self.final.append(memory[-1][2])
        return s

    def merge(self, text: str) -> list[str]:
        """The tokens of ``text`` by plain merging, for short texts."""
        parts = list(text)
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, right: bool) -> list[tuple[str, float]]:
        """The parts that lie at one edge of a token while it is made, each with the rank of the merge that uses it up."""
        got = self._spines[right].get(token)
        if got is None:
            parts, edge, got = list(self.text_of[token]), -1 if right else 0, []
            while len(parts) > 1:
                r, at = min((self.ranks.get(parts[k] + parts[k + 1], INF), k) for k in range(len(parts) - 1))
                if r == INF:
                    break
                if at == (len(parts) - 2 if right else 0):
                    got.append((parts[edge], r))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got.append((parts[edge], INF))
            self._made[token] = len(parts) == 1
            self._spines[right][token] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens beside each other (left -1: ``right`` at the start).

        They do unless a part at the right edge of the left token meets a part
        at the left edge of the right one in a merge that comes before either
        is used up; among equal ranks the merge further left comes first.
        """
        second = self._spine(right, False)
        if not self._made[right]:
            return False
        if left < 0:
            return True
        ranks = self.ranks
        for a, until in self._spine(left, True):
            for b, before in second:
                r = ranks.get(a + b)
                if r is not None and r < until and r <= before:
                    return False
        return True

    def _step(self, s: int, c: str) -> tuple:
        """The state and output after symbol ``c`` in state ``s``."""
        trie, token_at, pairs, size = self.trie, self.token_at, self._pairs, self.size
        grown, best = [], None
        for node, last, out in self.memory[s]:
            child = trie[node].get(c)
            if child is None:
                continue
            if trie[child]:
                grown.append((child, last, out))
            if best is None:
                t = token_at[child]
                if t >= 0:
                    key = last * size + t
                    fit = pairs.get(key)
                    if fit is None:
                        if len(pairs) >= MAX_PAIRS:
                            pairs.clear()
                        fit = pairs[key] = self.fits(last, t)
                    if fit:
                        best = (0, t, out + 1 if self.counting else (*out, t))
        if best is None:
            # c is no token: it stands alone, and all starts anew behind it
            alone = tuple(self.unknown(c))
            done = self.final[s]
            return (0, done + len(alone) if self.counting else done + alone)
        if not grown:  # the usual end of a syllable: nothing is held back but the last token
            out = best[2]
            if self.counting:
                return (self._state(((0, best[1], 0),)), out)
            return (self._state(((0, best[1], ()),)), out)
        grown.append(best)
        if self.counting:
            put = min([g[2] for g in grown])
            if put:
                grown = [(n, t, out - put) for n, t, out in grown]
        else:
            outs = [g[2] for g in grown]
            k, least = 0, min(map(len, outs))
            while k < least and len({o[k] for o in outs}) == 1:
                k += 1
            put = outs[0][:k]
            if k:
                grown = [(n, t, out[k:]) for n, t, out in grown]
        return (self._state(tuple(grown)), put)

    def run(self, text: str, s: int = 0) -> tuple:
        """``(state, output)`` after reading ``text`` from state ``s``; output still held back is left out.

        States may be dropped and numbered anew on the way, so a number holds
        only until the next call; :attr:`memory` of it is what lasts.
        """
        moves = self.moves
        out, total = [], 0
        for c in text:
            move = moves[s].get(c)
            if move is None:
                if len(self.memory) > MAX_STATES:
                    here = self.memory[s]
                    self._reset()
                    moves, s = self.moves, self._state(here)
                move = moves[s][c] = self._step(s, c)
            s = move[0]
            if move[1]:
                if self.counting:
                    total += move[1]
                else:
                    out += move[1]
        return (s, total if self.counting else tuple(out))

    def whole(self, text: str):
        """The ids of ``text``, or their number, from the start state to its end."""
        s, out = self.run(text)
        return out + self.final[s]

    def read(self, text: str, memory: tuple) -> tuple:
        """``(memory, output)`` after reading ``text`` from a state given by its memory, as processes may share it."""
        s, out = self.run(text, self._state(memory))
        return (self.memory[s], out)

    @property
    def start(self) -> tuple:
        """The start state's memory."""
        return ((0, -1, 0 if self.counting else ()),)


def compose(first: dict[tuple, tuple], second: dict[tuple, tuple]) -> dict[tuple, tuple]:
    """The map of two chunks in a row; associative, so chunks may be joined in any bracketing.

    A map takes the memory of the state that a chunk is entered in to that of
    the state it is left in and the output on the way. What leads to a state
    that the second map does not know is left out.
    """
    return {s: (second[m][0], a + second[m][1]) for s, (m, a) in first.items() if m in second}


def prefix_scan(maps: list[dict[tuple, tuple]]) -> list[dict[tuple, tuple]]:
    """The inclusive scan of chunk maps under :func:`compose`, in log-depth sweeps."""
    out = list(maps)
    step = 1
    while step < len(out):
        out = [compose(out[k - step], out[k]) if k >= step else out[k] for k in range(len(out))]
        step *= 2
    return out
