"""The random-projection forest: that it splits, what it finds, and that every link is counted once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import quillspark.llm.embed_forest as forest


def clusters(rng, n, dim, labels=2):
    """Vectors of which most have a few near copies around the threshold, and one cluster many."""
    rows = []
    while len(rows) < n:
        v = rng.standard_normal(dim)
        v /= np.linalg.norm(v)
        many = 90 if len(rows) == 0 else int(rng.integers(1, 5))
        for _ in range(many):
            w = v + rng.standard_normal(dim) * rng.uniform(0.02, 0.16) / np.sqrt(dim)
            rows.append((len(rows), w.tolist(), len(rows) % 7 % labels if many < 9 else 0))
    return rows


def brute(rows):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r[2] for r in rows])
    near = (x @ x.T >= forest.MIN_COSINE) & (y[:, None] == y[None])
    np.fill_diagonal(near, False)
    return near


def components(near):
    at = np.arange(len(near))
    while True:
        after = np.array([min(at[near[k]].min(initial=at[k]), at[k]) for k in range(len(near))])
        if (after == at).all():
            return at
        at = after


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_leaves_split_for_every_kind_of_label(spark, kind):
    rng = np.random.default_rng(5)
    rows = clusters(rng, 1500, 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("label", F.col("label").cast(kind))
    groups = df.select(F.col("label").cast("int").cast("long").alias("root"), F.col("vec_id").alias("gid"), F.col("embedding").alias("vec"))
    sizes = [r["count"] for r in forest.forest_leaves(groups, leaf=100).groupBy("root", "code").count().collect()]
    assert len(sizes) > 3 * forest.TREES * 2 and np.mean(sizes) < 150
    near, got = brute(rows), {r.vec_id: r for r in forest.embedding_near_duplicates(df, leaf=100).collect()}
    assert [got[k].n_links for k in range(len(rows))] == near.sum(axis=1).tolist()
    assert [got[k].component_id for k in range(len(rows))] == components(near).tolist()


@pytest.mark.parametrize("dim, leaf", [(16, 250), (16, 20), (64, 250), (64, 20), (768, 60)])
def test_recall(spark, dim, leaf):
    """Of trees about 4 and 8 levels deep; links are never made up, so recall is the sum's share."""
    rows = clusters(np.random.default_rng(dim + leaf), 2500, dim, labels=1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in forest.embedding_near_duplicates(df, leaf=leaf).collect()}
    want = brute(rows).sum(axis=1)
    found = np.array([got[k] for k in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_cut_blocks_count_every_link_once(spark, monkeypatch):
    rows = clusters(np.random.default_rng(9), 700, 16, labels=1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(forest, "MAX_BLOCK", 24)
    got = {r.vec_id: r for r in forest.embedding_near_duplicates(df, leaf=90).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    near = brute([(r[0], x[k].tolist(), r[2]) for k, r in enumerate(rows)])
    assert [got[k].n_links for k in range(len(rows))] == near.sum(axis=1).tolist()
