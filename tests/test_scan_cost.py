"""The kernel's work stays small: patterns search around their literals, and words without a copy are walked by nobody."""

import random

import pytest

from quillspark.catalog import load_rules
from quillspark.functions import patterns
from quillspark.functions.chars import Bytes, count_words, is_word
from quillspark.functions.duplication import find_runs, own_runs, tokenize, word_spans
from quillspark.functions.scan import Scanner, scanner

PIECES = [
    "tells a compelling story", "fast, clean, and safe", "İt is not a bug", "ſtory", "tells a ſtory ", "Kit", "It is not ", "\n", ". ", "Σας ς’s ",
    "we walked all day along the old north road ", "plain words ", "é́ ", "\U0001f600", "​", "a b", "from a to b", "is as a north star",
]


def _texts(n: int) -> list[str]:
    r = random.Random(3)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_a_long_text_is_searched_around_literals_alone(monkeypatch):
    s = Scanner(r for r in load_rules() if r.patterns)
    searched = []

    class Counted:
        def __init__(self, of):
            self.of = of

        def search(self, text):
            searched.append(len(text))
            return self.of.search(text)

        def __getattr__(self, name):
            return getattr(self.of, name)

    for _, p in s.patterns:
        if p.local:
            monkeypatch.setattr(p, "any", Counted(p.any))
    text = "aaaa bbbb cccc dddd " * 2_000 + "but it is not so " + "aaaa bbbb cccc dddd " * 2_000
    list(s.scan_patterns(text))
    assert searched and sum(searched) < len(text)


def test_patterns_around_literals_equal_the_whole_search():
    s = scanner()
    for t in _texts(400):
        # every pattern on the whole text, but where its literals are told to be missing
        odd = patterns.folds_oddly(t)
        want = [(k, *at) for k, p in s.patterns if odd or p.possible(t.lower()) for at in p.spans(t)]
        assert [tuple(h) for h in s.scan_patterns(t)] == want


@pytest.mark.parametrize("k,floor", [(3, 3), (5, 6), (8, 10)])
def test_own_runs_equal_the_walk_over_every_word(k, floor):
    for t in _texts(300):
        tokens = tokenize(t)
        assert [(x.start, x.end) for x in tokens] == word_spans(t)
        assert own_runs(t, k, floor) == find_runs(tokens, k, floor)


def test_counts_and_bytes():
    for t in _texts(200):
        n, inside = 0, False
        for c in t:
            n, inside = n + (is_word(c) and not inside), is_word(c)
        assert count_words(t) == n
        at = Bytes(t)
        assert [at(k) for k in range(len(t) + 1)] == [len(t[:k].encode()) for k in range(len(t) + 1)] and at.total == len(t.encode())
