"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints that
differ in at most three bits differ in at most one bit of one of the segments
(pigeonhole), so they share either that whole segment or a variant of it in
which one bit is a wildcard. Both are indexed, equal keys are joined, and the
full distance is verified inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import connected_components
from quillspark.llm.memo import release, slices

SEED = 42
MAX_DISTANCE = 3
SHINGLE_WORDS = 3
_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text.

    A-Z are lower-cased, words end at ASCII white space, shingles are three
    words joined by spaces (a shorter text is one shingle). A bit is set if it
    is set in over half of the shingles' XXH64. No words (and null): zero.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles: Iterator[bytes] = iter((b" ".join(words),))
        n = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        n = len(words) - SHINGLE_WORDS + 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    left = n
    while left:
        k = min(left, _AT_ONCE)
        h = np.fromiter((digest(s, SEED) for s, _ in zip(shingles, range(k))), dtype="<u8", count=k)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= k
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in slices(batches):
        fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of each row; ``fp`` is the fingerprint's bits as a signed long."""
    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return two.mapInArrow(_fingerprints, "id long, fp long")


def simhash_links(distinct_fps: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of the distinct long ``fp`` that differ in 1 to 3 bits.

    Index: two whole segments and 64 one-wildcard variants a fingerprint, each
    a long key (number of the variant, 32 bits of value). Under a wildcard only
    fingerprints that differ at that very bit need to meet, so a pair that has
    a whole segment in common meets once there, not 32 times more. A pair may
    come twice (by either segment).

    The index is 66 rows a fingerprint, which the planner doesn't count, so it
    is told never to broadcast it.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    bit = F.pmod(F.col("tag"), F.lit(33)) - 1  # -1: the whole segment
    part = F.when(F.col("tag") < 33, low).otherwise(high)
    flag = F.expr("shiftleft(1L, CAST(bit AS INT))")
    keyed = (
        distinct_fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("tag"))
        .select("fp", "tag", bit.alias("bit"), part.alias("part"))
        .select(
            "fp",
            (F.shiftleft(F.col("tag").cast("long"), 32).bitwiseOR(
                F.when(F.col("bit") < 0, F.col("part")).otherwise(F.col("part").bitwiseAND(F.bitwise_not(flag)))
            )).alias("key"),
        )
    )
    a, b = keyed.alias("a"), keyed.select(F.col("fp").alias("gp"), F.col("key").alias("kex")).alias("b")
    xor = F.col("a.fp").bitwiseXOR(F.col("b.gp"))
    tag = F.shiftrightunsigned(F.col("a.key"), 32)
    wild = F.pmod(tag, F.lit(33)) - 1
    at = (wild + F.when(tag < 33, F.lit(0)).otherwise(F.lit(32))).cast("int")
    differs = F.call_function("bit_get", xor, F.when(wild < 0, F.lit(0)).otherwise(at))
    pairs = a.join(
        b.hint("merge"),
        (F.col("a.key") == F.col("b.kex"))
        & (F.col("a.fp") < F.col("b.gp"))
        & (F.bit_count(xor) <= MAX_DISTANCE)
        & ((wild < 0) | (differs == 1)),
    )
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.gp").alias("v"))


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    ``fingerprint`` has 16 lower-case hex digits; ``component_id`` is the
    smallest id reachable over links of at most three differing bits, the row's
    own included. Links are sought between distinct fingerprints, so a group of
    copies is one entry however large it is; no bucket is collected, and a
    frequent key is split by adaptive execution.

    Null or empty texts have fingerprint zero and link like any other. Repeated
    rows give repeated rows. A null id takes its component's smallest id (null
    if there is none). Other columns are not read. An empty table gives none.
    """
    from quillspark.llm.common import written

    fps = written(simhash_fingerprints(docs, id_col, text_col), "simhash")
    groups = fps.groupBy("fp").agg(F.min("id").alias("least"))
    linked = connected_components(simhash_links(groups.select("fp")))
    with_class = (
        groups.join(linked, groups.fp == linked.node, "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("class"))
    )
    class_least = with_class.groupBy("class").agg(F.min("least").alias("component_id"))
    reps = with_class.join(class_least, "class").select(F.col("fp").alias("rep_fp"), "component_id")
    out = fps.join(reps, fps.fp == reps.rep_fp, "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
