"""Near-duplicates of a given similarity: SimHash links, exact verification, and what SimHash cannot reach.

Texts whose SimHash over five-word shingles differs in at most three bits are
found by deletion-variant signatures (:mod:`quillspark.llm.simhash`) and kept
linked if their shingle sets have a Jaccard similarity of at least 4/5. That
misses similar texts: at 4/5 some ten of 64 bits differ, and no cut of 64 bits
makes segments that then differ by at most one and still tell texts apart. So
sets that are not connected yet are compared too, where they can be similar:
sets with a similarity of at least 4/5 have an element in common among the first
fifth of each, whatever one order all sets are sorted by. Shingles that many
sets have are sorted last, so few sets meet by them; the order changes what is
compared, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, forget, forgetting, shuffles_dropped, small_batches, trim_driver, trim_executors, written
from quillspark.llm.components import connected_components
from quillspark.llm.memo import release, slices, trim
from quillspark.llm.simhash import simhash_links

SEED = 42
SHINGLE_WORDS = 5
SAMPLE_ROWS = 5_000  #: documents whose shingles are counted for the order
SAMPLE_COUNT = 3  #: a shingle in so many of them is frequent
CENTRES = 4  #: sets of an element's commonest class that the others meet first,
FEW = 4  #: while comparing them with all would take more than so many times the rows,
WORTH = 0.9  #: and the last such round made that at most this share of what it was
HOT = 32  #: a shingle in more prefixes than this is frequent too
MAX_FREQUENT = 100_000  #: frequent shingles that are told apart from rare ones, at most
MAX_BROADCAST = 1_000_000


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct XXH64 of one UTF-8 text's shingles, sorted.

    Words are those of :func:`quillspark.llm.simhash.fingerprint`; a text of
    fewer than five is one shingle, one without any has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE_WORDS)])) if n > 1 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=n).view(np.int64))


def set_fingerprint(x: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes, as a signed long: a bit is set if over half of them have it."""
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(x), 1 << 16):
        part = x[k : k + (1 << 16)].astype("<i8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(x), bitorder="little").view("<i8")[0])


def parities(x: np.ndarray) -> list[int]:
    """For each of 256 classes of hashes, whether the set has an odd number of them: four longs.

    Two sets differ in at least as many elements as these bits.
    """
    odd = np.bincount(x & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    """What sets are known by: a hash of each."""
    return pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64))


def _sets(texts: DataFrame) -> DataFrame:
    """``(id, a, b, row, node, fp, n, par)`` of ``(id, a, b, row, t)``: the set's hash, its fingerprint, size and parities."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:4], _nodes(sets),
                    pa.array([set_fingerprint(x) for x in sets], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int32()),
                    pa.array([parities(x) for x in sets], pa.list_(pa.int64())),
                ],
                names=["id", "a", "b", "row", "node", "fp", "n", "par"],
            )
        trim()  # the worker may wait beside what follows

    return texts.mapInArrow(work, "id long, a long, b long, row long, node long, fp long, n int, par array<long>")


def _tokens(texts: DataFrame) -> DataFrame:
    """``(node, toks)`` of ``(row, t)``: whole sets, made anew from the texts, as written they would be twice as large."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            toks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([_nodes(sets), toks], names=["node", "toks"])
        trim()

    return texts.select("t").mapInArrow(work, "node long, toks array<long>")


def _prefixes(texts: DataFrame, frequent: np.ndarray, count: np.ndarray) -> DataFrame:
    """``(node, n, pos, tok)``: the first fifth of each set, those of ``frequent`` (ascending) sorted last by ``count``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            out = []
            sets = [x for x in map(shingle_set, b.column(0).to_pylist()) if len(x)]
            for node, x in zip(_nodes(sets).to_pylist(), sets):
                n = len(x)
                most = n - (4 * n + 4) // 5 + 1
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    x = x[np.argsort(np.where(frequent[at] == x, count[at], 0), kind="stable")]
                out.append((np.full(most, node), np.full(most, n, dtype=np.int32), np.arange(most, dtype=np.int32), x[:most]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[k] for o in out])) for k in range(4)], names=["node", "n", "pos", "tok"]
                )
        trim()

    return texts.select("t").mapInArrow(work, "node long, n int, pos int, tok long")


def _ordered(texts: DataFrame) -> DataFrame:
    """The prefixes of distinct sets under an order by frequency.

    It is a sample's, mended by how often shingles are in the prefixes that it
    gives a quarter of the sets; the order decides only what is compared.
    """
    total = texts.count()
    sample = texts.sample(min(1.0, SAMPLE_ROWS / max(1, total)), seed=SEED)
    scale = max(1.0, total / SAMPLE_ROWS)

    def most(table: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
        got = (
            table.groupBy("tok").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "tok").limit(MAX_FREQUENT)
            .toArrow()
        )
        return got.column("tok").to_numpy(), got.column("count").to_numpy().astype(np.float64)

    toks, count = most(_tokens(sample).select(F.explode("toks").alias("tok")), SAMPLE_COUNT)
    by = np.argsort(toks)
    first = toks[by], count[by] * scale
    hot, often = most(_prefixes(texts.filter("pmod(row, 4) = 0"), *first), HOT // 4 + 1)
    often = often * 4
    toks, at = np.unique(np.concatenate([first[0], hot]), return_inverse=True)
    count = np.zeros(len(toks))
    np.maximum.at(count, at, np.concatenate([first[1], often]))
    return _prefixes(texts, toks, count)


def _similar(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m elements with so many in common have a similarity of 4/5 or more."""
    return common * 9 >= (n + m) * 4


def _may_be(a: str, b: str) -> Column:
    """Whether two sets whose first common element is at these places, and with these parities, can be similar."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum(
        (F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}"))) for k in range(4)), start=F.lit(0)
    )
    return _similar(F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")), na, nb) & (differ * 9 <= na + nb)


def _pairs(joined: DataFrame) -> DataFrame:
    a, b = F.col("a.node"), F.col("b.node")
    return joined.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose whole sets are similar."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    first = written(groups.join(nodes, "node", "left_semi").select(F.col("row").alias("first")), "compared")
    sets = _tokens(texts.join(broadcast_if_small(first, MAX_BROADCAST), F.col("row") == F.col("first"), "left_semi"))
    both = pairs.join(sets.toDF("u", "us"), "u").join(sets.toDF("v", "vs"), "v")
    same = F.size(F.array_intersect("us", "vs"))
    found = written(both.filter(_similar(same, F.size("us"), F.size("vs"))).select("u", "v"), "similar")
    forget(first)
    return found


def _simhash_pairs(groups: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of sets whose fingerprints are equal or differ in at most three bits, fewer than all.

    Sets of one fingerprint are each paired with the least of them, and the
    least ones of two near fingerprints with each other.
    """
    reps = written(groups.filter("n > 0").groupBy("fp").agg(F.min("node").alias("rep")), "set-fingerprints")
    near = simhash_links(reps.select("fp")).toDF("fu", "fv").distinct()
    ends = near.join(reps.toDF("fu", "u"), "fu").join(reps.toDF("fv", "v"), "fv").select("u", "v")
    equal = groups.filter("n > 0").join(reps.toDF("rf", "rep"), F.col("fp") == F.col("rf")).filter("node <> rep")
    both = ends.union(equal.select("rep", "node"))
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, a, b, class)`` for each row: two hashes of its text, and its near-duplicate class.

    Rows are of one class if they are connected by links of texts whose sets of
    five-word shingles have a Jaccard similarity of at least 0.8. Equal sets are
    one entry. SimHash pairs are verified first. Then sets of different classes
    that share an element of their prefixes are compared: each with a few others
    for each element while many still differ, then with all others of other
    classes, so a large group costs links in proportion to its size and every
    similar pair ends in one class.

    Null and empty texts have the empty set and are of one class. Repeated rows
    give repeated rows, and other columns are not read. An empty table gives
    none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with shuffles_dropped(spark), forgetting(spark) as kept:
        out = written(_near_duplicate_rows(docs, id_col, text_col), "near-duplicates")
        kept.append(out)
    return out


def _near_duplicate_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    trim_driver(spark)
    text = F.col(text_col).cast("string")
    two = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("t"))
    if "Exchange" in two._jdf.queryExecution().executedPlan().toString():  # what a shuffle gives may come in another order next time
        two = written(two, "texts")
    # a text is found again by its row's number: a table is read alike each time
    texts = two.select("id", *text_hashes(F.col("t").cast("string")), F.monotonically_increasing_id().alias("row"), "t")
    rows = written(_sets(texts), "sets-of-rows")
    texts = texts.select("row", "t")
    groups = rows.groupBy("node", "fp", "n").agg(F.min("row").alias("row"), F.first("par").alias("par"))
    groups = written(groups.select("node", "fp", "n", "row", *(F.col("par")[k].alias(f"p{k}") for k in range(4))), "sets")
    tried = written(_simhash_pairs(groups), "ahead")
    trim_driver(spark)
    trim_executors(spark)
    links = _verified(tried, texts, groups)
    # each set once: rows that repeat one are left out
    again = rows.select("node", "row").join(groups.select(F.col("node").alias("of"), F.col("row").alias("rep")), F.col("node") == F.col("of"))
    again = written(again.filter("row <> rep").select(F.col("row").alias("copy")), "copies")
    once = texts.join(broadcast_if_small(again, MAX_BROADCAST), F.col("row") == F.col("copy"), "left_anti")
    # one exchange by element serves to count it and to keep what several sets have
    prefix = _ordered(once).withColumn("k", F.count("*").over(Window.partitionBy("tok"))).filter("k > 1").drop("k")
    signs = groups.select(F.col("node").alias("of"), "p0", "p1", "p2", "p3")
    prefix = written(prefix.join(signs, F.col("node") == F.col("of")).drop("of"), "met")
    trim_driver(spark)
    trim_executors(spark)
    # sets outside their element's commonest class meet a few of it while that saves much, then all of other classes
    last, turn = None, 0
    while True:
        known = connected_components(links).toDF("known", "class")
        trim_driver(spark)
        placed = written(
            prefix.join(known, F.col("node") == F.col("known"), "left")
            .select("tok", "node", "n", "pos", "p0", "p1", "p2", "p3", F.coalesce("class", "node").alias("class")),
            "placed",
        )
        sizes = placed.groupBy("tok", "class").agg(F.count("*").alias("m"))
        largest = F.max(F.struct("m", F.xxhash64("class").alias("turn"), "class"))
        mixed = sizes.groupBy("tok").agg(largest.alias("most"), F.sum("m").alias("k")).filter("k > most.m")
        mixed = written(mixed.select("tok", F.col("most.class").alias("most"), (F.col("k") * (F.col("k") - F.col("most.m"))).alias("cost")), "mixed")
        cost = mixed.agg(F.sum(F.col("cost").cast("double"))).first()[0] or 0.0
        first = cost > FEW * placed.count() and (last is None or cost <= last * WORTH)
        sided = placed.join(mixed.select("tok", "most").hint("merge"), "tok")
        a, b = sided.filter("class <> most").alias("a"), placed.alias("b")
        if first:
            whole = F.struct("node", "n", "pos", "class", "p0", "p1", "p2", "p3")
            few = F.array_distinct(F.array(*(F.min_by(whole, F.xxhash64(F.lit(k), "node")) for k in range(turn, turn + CENTRES))))
            centres = sided.filter("class = most").groupBy("tok").agg(few.alias("few"))
            b = centres.select("tok", F.explode("few").alias("b")).select("tok", "b.*").alias("b")
        # packed columns look small to the planner; neither side is to pass through the driver
        meet = a.join(b.hint("merge"), (F.col("a.tok") == F.col("b.tok")) & (F.col("a.class") != F.col("b.class")) & _may_be("a", "b"))
        new = written(_pairs(meet).join(tried, ["u", "v"], "left_anti"), "untried")
        # what is known links as all the links did, in fewer rounds
        links = known.toDF("u", "v").union(_verified(new, texts, groups))
        forget(placed, mixed)
        trim_driver(spark)
        trim_executors(spark)
        if not first:
            break
        tried, last, turn = tried.union(new), cost, turn + CENTRES
    linked = connected_components(links)
    forget(prefix)
    trim_driver(spark)
    return rows.select("id", "a", "b", "node").join(linked.toDF("end", "component"), F.col("node") == F.col("end"), "left").select(
        F.col("id").alias("doc_id"), "a", "b", F.coalesce("component", "node").alias("class")
    )


def text_hashes(text: Column) -> list[Column]:
    """Two hashes that tell texts apart; a null text is an empty one."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b")]


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` for each row: the smallest id of its class of :func:`near_duplicate_rows`.

    A null id takes its class's smallest id (null if there is none).
    """
    rows = written(near_duplicate_rows(docs, id_col, text_col), "classes")
    least = rows.groupBy(F.col("class").alias("c")).agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, F.col("class") == F.col("c")).select("doc_id", "component_id")
