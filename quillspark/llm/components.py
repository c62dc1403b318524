"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over ``(u, v)``.

    Large star: every node hands its smallest neighbour to its larger ones.
    Small star: every node hands it to its smaller ones and to itself.
    Links are many more rows than their packed bytes let the planner expect, so
    they are merged, never broadcast.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v <= u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least.hint("merge"), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return (row.n, row.h)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``, two long columns.

    ``component`` is the smallest node that can be reached. Null ends and
    loops link nothing. Rounds grow with the logarithm of a component's size;
    each round's links are a written table, and no group is ever collected: a
    hub's links meet its minimum in a join that adaptive execution can split.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    now = written(edges.filter("u is not null and v is not null and u <> v").distinct(), "links")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = written(_star(_star(now, True), False), "links")
        new = _mark(after)
        forget(now)
        now, settled, mark = after, new == mark, new
        if settled:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
