"""What the toxicity operator's workers take: one look-up for a known word, and little beside the index while it is made."""

import random
import tracemalloc
from collections import Counter

import numpy as np

from quillspark.llm.toxicity import STEMS, BlockMaxIndex, Terms, text_terms


def test_a_known_word_is_looked_up_once():
    r = random.Random(4)
    letters = "abcé"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(600)]
    names = sorted(set().union(*(text_terms(w) for w in words[:300])))
    terms = Terms(names)
    asked: Counter = Counter()

    class Counted(dict):
        def get(self, key, other=None):
            asked[key] += 1
            return dict.get(self, key, other)

    terms.stems = {k: Counted(v) for k, v in terms.stems.items()}
    for _ in range(50):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        want = {names.index(t): n for t, n in text_terms(text).items() if t in set(names)}
        at, n = terms.counts(text)
        assert dict(zip(at.tolist(), n.tolist())) == want
        assert set(terms.present(text).tolist()) == set(want)
    known = set(names)
    assert not any(w[:k] in asked and not any(x[:k] == w[:k] and x not in known for x in words) for w in words[:300] for k in STEMS if len(w) > k)


def test_an_index_is_made_in_little_memory():
    r = np.random.default_rng(2)
    n, each, n_terms = 600, 500, 20_000
    terms = np.concatenate([np.sort(r.choice(n_terms, each, replace=False)) for _ in range(n)])
    weights = r.random(n * each)
    tracemalloc.start()
    BlockMaxIndex(np.arange(n), np.arange(n) % 2, np.arange(n + 1) * each, terms, weights, n_terms, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * n * each, peak / (n * each)
