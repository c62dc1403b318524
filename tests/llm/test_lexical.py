"""Ranked search: exact against a plain loop over all documents, ties and hot copies included, and against SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

import quillspark.llm.lexical as x
from quillspark.llm.queries import ORACLE_SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    split = lambda t: TERM.findall((t or "").translate(FOLD))
    rows = [(d, Counter(split(t))) for d, t in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    big_n, big_l = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in rows:
            m = 25 + (75 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(seed, n=700):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "中文", "naïve", "x y", "the", "of"]
    common = ["the"] * 40 + ["of"] * 20
    texts = [" ".join(rng.choice(vocabulary + common) for _ in range(rng.randrange(1, 80))) for _ in range(n)]
    copy = "the w1 w2 w3 of w4 W5, w6!"
    docs = [(k, copy if rng.random() < 0.35 else t) for k, t in enumerate(texts)]
    docs += [(None, copy), (7, copy), (7, copy), (9000, None), (9001, ""), (9002, " .,\n"), (9003, "w1 " * 60_000), (9004, "Z\x00w2")]
    rng.shuffle(docs)
    items = [(k, rng.choice(texts)) for k in range(25)] + [(100, copy), (100, "the the the w9"), (101, None), (102, ""), (None, "w1 w2 w2"), (103, "absent"), (104, "the")]
    return docs, items


def as_rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as shard", "2 as term", "3 as n")
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 as item", "5 as bound")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_loop(spark, seed):
    docs, items = corpus(seed)
    d, q = tables(spark, docs, items)
    # small shards, so that there are many
    assert as_rows(x.ranked_search(d.repartition(3), q, leaf=2)) == sorted(brute(docs, items), key=repr)


def test_blocks_of_queries(spark, monkeypatch):
    docs, items = corpus(3, 200)
    d, q = tables(spark, docs, items)
    monkeypatch.setattr(x, "BLOCK_TERMS", 150)
    assert as_rows(x.ranked_search(d, q, k=3)) == sorted(brute(docs, items, 3), key=repr)


def test_sql_agrees(spark):
    docs, items = corpus(4, 150)
    docs = [(d, t if t is None else t.replace("\x00", " ")) for d, t in docs]
    d, q = tables(spark, docs, items)
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("benchmark", q.toArrow())
    got = con.sql(ORACLE_SQL["op11_ranked_search"]).select("item_id, rank, doc_id, score").fetchall()
    assert sorted(got, key=repr) == as_rows(x.ranked_search(d, q))


def test_empty_tables(spark):
    d, q = tables(spark, [(1, "a b")], [(1, "a")])
    none = d.filter("false")
    assert as_rows(x.ranked_search(none, q)) == []
    assert as_rows(x.ranked_search(d, q.filter("false"))) == []


def test_bounds_skip_leaves(monkeypatch):
    """A query whose answer stands out opens few of a shard's leaves."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = x.LEAF * x.LEAVES
    lists = [[1] + ([2, 3] if k in (100, 2000) else []) for k in range(n)]
    table = pa.table({
        "shard": np.zeros(n, dtype=np.int64), "at": np.arange(n, dtype=np.int32), "doc_id": np.arange(n), "n": rng.integers(50, 100, n),
        "terms": pa.array(lists, pa.list_(pa.int32())), "tfs": pa.array([[1] * len(t) for t in lists], pa.list_(pa.int32())),
    })

    class Grouped:
        def groupBy(self, _):
            return self

        def applyInArrow(self, build, _):
            return build(table)

    shard = x.Shard(x.index(Grouped(), n, 75 * n))
    opened = []
    inside = shard.leaf
    monkeypatch.setattr(shard, "leaf", lambda leaf, *a: opened.append(leaf) or inside(leaf, *a))
    top = shard.best({1: 3, 2: 9000, 3: 9000}, 2, (0, x.NO_ID))
    assert sorted(i for _, i in top) == [100, 2000] and sorted(opened) == [100 // x.LEAF, 2000 // x.LEAF]
