"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import broadcast_if_small, forget, written
from quillspark.llm.components import connected_components

MIN_COSINE = 0.98
TREES = 4
LEAF = 512  #: distinct vectors that a leaf may hold; larger ones are split on
SPILL = 2.0  #: width of the overlap, in deviations of a just similar pair's difference along a direction
LEVELS = 4  #: levels that one round adds below a leaf
FIT_VECTORS = 1_024  #: vectors of a leaf that its next splits are fitted on, about
CANDIDATES = 8  #: random directions tried for each split
WORTH = 0.9  #: a split must leave at most this share of a leaf's comparisons
MAX_BLOCK = 2_048  #: vectors of a leaf that one task compares at once
MAX_BROADCAST = 50_000


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    """The unit vectors of a list column whose rows are equally long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _mixed(code: np.ndarray, salt: int) -> np.ndarray:
    """64-bit codes, stirred; the same everywhere."""
    with np.errstate(over="ignore"):
        z = code.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))).view(np.int64)


def _direction(code: int, node: int, choice: int, dim: int) -> np.ndarray:
    """A random unit direction that the leaf's code, the node below it and the choice fix."""
    d = np.random.default_rng([code & (2**64 - 1), node, choice]).standard_normal(dim)
    return d / np.linalg.norm(d)


def fit_splits(x: np.ndarray, code: int, levels: int, min_cosine: float = MIN_COSINE) -> list[float]:
    """Splits of ``levels`` levels below one leaf, by a sample of its unit vectors.

    Three numbers a node in heap order: the direction's number (-1: the node is
    a leaf for good), and the bounds that the right child begins and the left
    child ends at. Of ``CANDIDATES`` random directions, cut near the middle, a
    node takes the one whose children compare the fewest pairs, and none where
    that is hardly fewer than without a split, as in a cluster of near copies.
    The overlap is ``SPILL`` deviations that two vectors of cosine
    ``min_cosine`` differ by along a random direction, whatever the dimension.
    """
    dim = x.shape[1]
    half = SPILL * math.sqrt(2 * (1 - min_cosine) / dim) / 2
    out = [-1.0, 0.0, 0.0] * (2**levels - 1)
    members = {0: x}
    for node in range(2**levels - 1):
        rows = members.pop(node, None)
        if rows is None or len(rows) < 16:
            continue
        best = None
        for choice in range(CANDIDATES):
            p = np.sort(rows @ _direction(code, node, choice, dim))
            for at in np.quantile(p, [0.4, 0.5, 0.6]):
                left = np.searchsorted(p, at + half, "right") / len(p)
                right = 1 - np.searchsorted(p, at - half, "left") / len(p)
                cost = left * left + right * right
                if best is None or cost < best[0]:
                    best = (cost, choice, at)
        cost, choice, at = best
        if cost > WORTH:
            continue
        out[3 * node : 3 * node + 3] = float(choice), at - half, at + half
        p = rows @ _direction(code, node, choice, dim)
        members[2 * node + 1], members[2 * node + 2] = rows[p <= at + half], rows[p >= at - half]
    return out


def descend(x: np.ndarray, code: int, splits: list[float]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """``(node, closed, rows)`` of each end that rows of ``x`` reach; spilled rows reach several.

    ``closed`` ends are leaves for good, others have come to the last level.
    """
    nodes = len(splits) // 3
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node >= nodes or splits[3 * node] < 0:
            yield node, node < nodes, rows
            continue
        p = x[rows] @ _direction(code, node, int(splits[3 * node]), x.shape[1])
        todo.append((2 * node + 1, rows[p <= splits[3 * node + 2]]))
        todo.append((2 * node + 2, rows[p >= splits[3 * node + 1]]))


def valid(vec, label):
    """Whether a vector can link: label and components there, all finite, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    some = F.exists(vec, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & ~bad & some, F.lit(False))


def forest_leaves(groups: DataFrame, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> DataFrame:
    """``(root, code, gid)``: the leaves of every tree that each vector reaches.

    ``groups(root, gid, vec)`` holds each vector once; ``root`` stands for its
    label and length, and only vectors of one root share a leaf. A root of at
    most ``leaf`` vectors is one leaf; a larger one is the root of ``trees``
    trees, that grow by rounds of ``LEVELS`` levels: about ``FIT_VECTORS``
    vectors of each leaf that is still too large, taken by a hash of their ids,
    fit its next splits in one task each, and all vectors of those leaves are
    routed by them. Nothing is collected to the driver, so neither the number of
    vectors nor that of labels is bounded; a round more is needed for each
    factor of about six in size. A leaf that no split makes smaller, such as a
    cluster of near copies, stays large.
    """
    roots = groups.groupBy("root").agg(F.count("*").alias("size"))
    small = written(roots.filter(F.col("size") > leaf).select(F.col("root").alias("big")), "large-roots")
    placed = groups.join(broadcast_if_small(small, MAX_BROADCAST), F.col("root") == F.col("big"), "left")
    tree = F.explode(F.when(F.col("big").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(trees - 1))))
    now = placed.withColumn("tree", tree).select("root", F.xxhash64("root", "tree", F.lit(seed)).alias("code"), "gid", "vec")
    done, held = [], None
    kind = groups.schema["vec"].dataType.simpleString()
    levels = LEVELS

    def fit(table: pa.Table) -> pa.Table:
        code = table.column("code")[0].as_py()
        n = table.column("n")[0].as_py()
        deep = min(levels, max(1, math.ceil(math.log(n / leaf) / math.log(1 / 0.6))))
        splits = fit_splits(_matrix(table.column("vec")), code, deep)
        return pa.table({"sr": [table.column("root")[0].as_py()], "sc": [code], "splits": [splits]})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root, code, gid = (b.column(k).to_numpy() for k in range(3))
            by: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(root.tolist(), code.tolist())):
                by.setdefault(key, []).append(i)
            for (r, c), members in by.items():
                m = np.array(members)
                vecs = b.column(3).take(pa.array(m))
                for node, closed, rows in descend(_matrix(vecs), c, b.column(4)[members[0]].as_py()):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), r)),
                            pa.array(np.repeat(_mixed(np.array([c]), node), len(rows))),
                            pa.array(gid[m[rows]]),
                            vecs.take(pa.array(rows)),
                            pa.array(np.full(len(rows), closed)),
                        ],
                        names=["root", "code", "gid", "vec", "closed"],
                    )

    while True:
        sizes = written(
            now.groupBy("root", "code").agg(F.count("*").alias("n")).filter(F.col("n") > leaf).toDF("fr", "fc", "n"),
            "large-leaves",
        )
        if sizes.isEmpty():
            done.append(now.select("root", "code", "gid"))
            break
        mine = (F.col("root") == F.col("fr")) & (F.col("code") == F.col("fc"))
        fat = broadcast_if_small(sizes, MAX_BROADCAST)
        done.append(written(now.join(fat, mine, "left_anti").select("root", "code", "gid"), "leaves"))
        growing = now.join(fat, mine).select("root", "code", "gid", "vec", "n")
        some = F.pmod(F.xxhash64("gid", "code"), F.col("n")) < FIT_VECTORS
        splits = written(
            growing.filter(some).groupBy("root", "code").applyInArrow(fit, "sr long, sc long, splits array<double>"),
            "splits",
        )
        here = (F.col("root") == F.col("sr")) & (F.col("code") == F.col("sc"))
        routed = growing.join(broadcast_if_small(splits, MAX_BROADCAST // 10), here).select("root", "code", "gid", "vec", "splits")
        after = written(
            routed.mapInArrow(route, f"root long, code long, gid long, vec {kind}, closed boolean"), "routed"
        )
        done.append(written(after.filter("closed").select("root", "code", "gid"), "leaves"))
        forget(*(t for t in (held, sizes, splits) if t is not None))
        held = after
        now = after.filter("not closed").select("root", "code", "gid", "vec")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return written(out.distinct(), "leaves")


def _spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links ``(u, v)`` among ``n`` things connect, fewer than ``n`` of them."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[u], least[v])
        after = least.copy()
        np.minimum.at(after, u, m)
        np.minimum.at(after, v, m)
        np.minimum.at(after, least[u], m)
        np.minimum.at(after, least[v], m)
        after = after[after]
        if (after == least).all():
            break
        least = after
    ends = np.flatnonzero(least != np.arange(n))
    return least[ends], ends


def _met(a: list[np.ndarray], b: list[np.ndarray], code: int) -> np.ndarray:
    """Whether a vector of ``a`` and one of ``b`` share a leaf whose code is less than ``code``."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    first, second = (np.concatenate(x)[np.concatenate(x) < code] for x in (a, b))
    names = np.intersect1d(first, second)
    for s in range(0, len(names), 4096):
        part = names[s : s + 4096]
        flags = []
        for side in (a, b):
            m = np.zeros((len(side), len(part)), dtype=np.float32)
            for k, codes in enumerate(side):
                at = np.searchsorted(part, codes)
                ok = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == codes)
                m[k, at[ok]] = 1
            flags.append(m)
        out |= flags[0] @ flags[1].T > 0
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Links of one leaf, or of two blocks of a large one: spanning links, and each vector's count of new ones.

    A pair that shares several leaves is counted in the one with the least code.
    """
    gid, own = table.column("gid").to_numpy(), table.column("b").to_numpy()
    copies = table.column("copies").to_numpy()
    x = _matrix(table.column("vec"))
    lists = table.column("codes").combine_chunks()
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    codes = [flat[s:e] for s, e in zip(ends[:-1], ends[1:])]
    code, i, j = (table.column(c)[0].as_py() for c in ("code", "i", "j"))
    first, second = (own == i).nonzero()[0], (own == j).nonzero()[0]
    counts = np.zeros(len(gid), dtype=np.int64)
    us, vs = [], []
    for s in range(0, len(first), 512):
        part = first[s : s + 512]
        near = x[part] @ x[second].T >= MIN_COSINE
        if i == j:
            near &= second[None, :] > part[:, None]
        rows, cols = near.any(axis=1).nonzero()[0], near.any(axis=0).nonzero()[0]
        if not len(rows):
            continue
        sub = near[np.ix_(rows, cols)]
        a, c = part[rows], second[cols]
        u, v = sub.nonzero()
        us.append(a[u])
        vs.append(c[v])
        new = sub & ~_met([codes[k] for k in a], [codes[k] for k in c], code)
        counts[a] += new @ copies[c]
        counts[c] += new.T @ copies[a]
    u, v = np.concatenate(us or [[]]).astype(np.int64), np.concatenate(vs or [[]]).astype(np.int64)
    lo, hi = _spanning(u, v, len(gid))
    some = counts.nonzero()[0]
    return pa.table(
        {
            "u": np.concatenate([gid[lo], gid[some]]),
            "v": pa.array(np.concatenate([gid[hi], gid[some]])),
            "n": np.concatenate([np.zeros(len(lo), dtype=np.int64), counts[some]]),
        }
    )


def forest_links(groups: DataFrame, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> DataFrame:
    """``(u, v, n)`` of distinct vectors: with ``u <> v`` a link of a spanning set, with ``u = v`` some of its ``n`` links.

    ``groups(root, gid, vec, copies)`` holds each vector once. The vectors of a
    leaf of :func:`forest_leaves` are compared; a leaf beyond ``MAX_BLOCK`` is
    compared block by block, so no task holds more than two blocks and no pair
    of a leaf is left out. Every pair is verified in double precision and
    counted in one leaf only (a vector's links are the sum of its ``n``, copies
    of the other counted), yet no list of pairs is made: a leaf puts out fewer
    links than it has vectors.
    """
    leaves = forest_leaves(groups.select("root", "gid", "vec"), trees, leaf, seed)
    fat = written(
        leaves.groupBy("root", "code").count().filter(F.col("count") > MAX_BLOCK)
        .select(F.col("root").alias("fr"), F.col("code").alias("fc"), F.ceil(F.col("count") / MAX_BLOCK).cast("int").alias("k")),
        "fat-leaves",
    )
    codes = leaves.groupBy(F.col("gid").alias("of")).agg(F.sort_array(F.collect_list("code")).alias("codes"))
    each = groups.join(codes, F.col("gid") == F.col("of")).withColumn("code", F.explode("codes"))
    cut = each.join(
        broadcast_if_small(fat, MAX_BROADCAST), (F.col("root") == F.col("fr")) & (F.col("code") == F.col("fc")), "left"
    )
    # block i of k meets each block j: as (i, j) with i <= j
    mine = F.pmod(F.xxhash64("gid"), F.coalesce("k", F.lit(1))).cast("int")
    cut = cut.withColumn("b", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))
    )
    cut = cut.select(
        "root", "code", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "gid", "copies", "codes", "vec"
    )
    return cut.groupBy("root", "code", "i", "j").applyInArrow(_compare, "u long, v long, n long")


def embedding_near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    trees: int = TREES,
    leaf: int = LEAF,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row.

    Vectors of one label and length with a cosine of at least ``MIN_COSINE``, in
    double precision, are linked where the forest brings them together; equal
    vectors are one entry in it, however many they are, and always linked.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id that can be reached, and ``kept`` marks its own row.

    Vectors that are null, empty, zero, or hold null or non-finite components,
    and those without a label, link with nothing. Repeated rows count as other
    rows. A null id takes its component's smallest id (null alone) and is never
    kept. Other columns are not read. An empty table gives none.
    """
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"),
    )
    rows = rows.withColumn("ok", valid(F.col("vec"), F.col("label")))
    good, rest = rows.filter("ok"), rows.filter("not ok")
    distinct = good.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    kinds = written(
        distinct.select(F.col("label").alias("rl"), F.size("vec").alias("rn")).distinct()
        .withColumn("root", F.monotonically_increasing_id()),
        "roots",
    )
    groups = written(
        distinct.join(
            broadcast_if_small(kinds, MAX_BROADCAST), (F.col("label") == F.col("rl")) & (F.size("vec") == F.col("rn"))
        ).select("root", "gid", "vec", "copies"),
        "rooted",
    )
    links = written(forest_links(groups, trees, leaf), "forest-links")
    degree = links.filter("u = v").groupBy(F.col("u").alias("dg")).agg(F.sum("n").alias("linked"))
    comp = connected_components(links.filter("u <> v").select("u", "v"))
    full = (
        distinct.join(degree, F.col("gid") == F.col("dg"), "left")
        .join(comp, F.col("gid") == F.col("node"), "left")
        .select(
            "label", "vec", "least",
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "gid").alias("class"),
        )
    )
    class_least = full.groupBy("class").agg(F.min("least").alias("component_id"))
    known = full.join(class_least, "class").select(
        F.col("label").alias("gl"), F.col("vec").alias("gv"), "n_links", "component_id"
    )
    out = good.join(known, (good.label == known.gl) & (good.vec == known.gv)).select("vec_id", "n_links", "component_id")
    out = out.unionByName(
        rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
