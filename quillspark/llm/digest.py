"""Exact document fingerprints over a canonical form."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import forget, written
from quillspark.llm.memo import release, slices, texts

SHARED_BITS = 26  #: 8 MB of bits tell which digests several rows have


def canonical(text: str | None) -> str:
    """NFKC, case folded, white space runs as one space, none at the ends; null is empty."""
    if not text:
        return ""
    folded = text.casefold() if text.isascii() else unicodedata.normalize(
        "NFKC", unicodedata.normalize("NFKC", text).casefold()
    )
    return " ".join(folded.split())


def digest(canon: str) -> str:
    """XXH3 of 128 bits over the canonical form's UTF-8, 32 hex digits."""
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> float:
    """1 if two (digest, canonical form) are equal, byte for byte, else 0."""
    return float(a[0] == b[0] and a[1] == b[1])


def _bits(docs: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value that the first ``bits`` bits of a ``fingerprint`` may have, as 64-bit words."""
    at = F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long")
    at = F.shiftright(at, 32 - bits)
    place = docs.select(at.alias("at")).select(F.shiftright("at", 6).alias("w"), F.pmod("at", F.lit(64)).cast("int").alias("b"))
    words = place.select("w", F.expr("shiftleft(1L, b)").alias("v"))
    got = words.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()  # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64)
    return out


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prints: DataFrame | None = None,
    bits: int = SHARED_BITS,
    of: Callable[[str], str] = digest,
) -> DataFrame:
    """``(doc_id, fingerprint, group_id)``: the smallest id with the same canonical bytes.

    Rows are grouped by digest. Inside buckets of more than one row the bytes
    are compared: by the smallest and the largest canonical form of each, that
    partial aggregation keeps one a digest and task. Other rows' forms do not
    move: a map of ``2**bits`` bits, whatever the table's size, tells most of
    them. Only if a bucket's forms differ are its rows grouped by the form.

    ``prints(doc_id, fingerprint)``, if given, is what ``of`` makes of the rows.
    Null and empty texts are one group. Null ids take their group's id.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))

    def forms(shared: np.ndarray | None, whole: bool) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for b in slices(batches):
                canon = [canonical(t) for t in texts(b.column(1))]
                names = list(map(of, canon))
                keep = np.ones(len(names), dtype=bool)
                if shared is not None:
                    at = np.array([int(n[:8], 16) for n in names], dtype=np.int64) >> (32 - bits)
                    keep = (shared[at >> 6] >> (at & 63)) & 1 == 1
                columns = [b.column(0), pa.array(names, pa.string()), pa.array(canon if whole else [None] * len(canon), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(keep)) for c in columns], names=["doc_id", "fingerprint", "canon"]
                )

        return two.mapInArrow(work, "doc_id long, fingerprint string, canon string")

    if prints is None:
        prints = written(forms(None, False).select("doc_id", "fingerprint"), "prints")
    buckets = written(
        prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id")), "buckets"
    )
    shared = _bits(buckets.filter("n > 1"), bits)
    bucketed = forms(shared, True)
    edges = bucketed.groupBy("fingerprint").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    mixed = written(edges.filter("lo <> hi").select(F.col("fingerprint").alias("mixed")), "mixed")
    one = buckets.select(F.col("fingerprint").alias("f"), "group_id")
    if mixed.isEmpty():
        return prints.join(one, F.col("fingerprint") == F.col("f")).select("doc_id", "fingerprint", "group_id")
    clear = prints.join(mixed, F.col("fingerprint") == F.col("mixed"), "left_anti")
    apart = bucketed.join(mixed, F.col("fingerprint") == F.col("mixed"), "left_semi")
    least = apart.groupBy(F.col("fingerprint").alias("f"), F.col("canon").alias("c")).agg(F.min("doc_id").alias("group_id"))
    split = apart.join(least, (F.col("fingerprint") == F.col("f")) & (F.col("canon") == F.col("c")))
    return clear.join(one, F.col("fingerprint") == F.col("f")).select("doc_id", "fingerprint", "group_id").unionByName(
        split.select("doc_id", "fingerprint", "group_id")
    )


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class _Doc:
    __slots__ = ("id", "text", "canon", "print")

    def __init__(self, id_, text):
        self.id, self.text = id_, text or ""
        self.canon = canonical(self.text)
        self.print = digest(self.canon)


def _compare(doc: _Doc, nxt: _Doc) -> tuple:
    n = len(doc.text)
    k = n // 3
    edited = doc.text[: n - k] + nxt.text[:k]
    canon = canonical(edited)
    mine, other = (doc.print, doc.canon), (digest(canon), canon)
    return (
        doc.id,
        n,
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        doc.print,
        other[0],
        likeness(mine, other),
        likeness(mine, (nxt.print, nxt.canon)),
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text ends in the beginning of the next document in descending
    id order (the last takes the first): its last ``n_chars // 3`` code points
    give way to as many of the next, or all it has. One range shuffle brings
    neighbours together; each partition streams through a worker that holds two
    documents. A partition's last document meets the next partition's first in
    a second, small pass over one row a partition. ``group_id`` is the smallest
    id with the same canonical bytes, by :func:`exact_groups`.

    Null texts are empty. Equal ids are ordered by a hash of the text; a null id
    comes last.
    A table of one row has itself as next; an empty one gives no rows.
    """
    import pandas as pd

    two = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    )
    # small keys: the range sampler sends some of them to the driver
    keyed = two.withColumn("h", F.xxhash64("t")).withColumn("n", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("n")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "t")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last: _Doc | None = None
        head_at: dict | None = None
        release()
        for b in slices(batches):
            rows = []
            for id_, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                doc = _Doc(id_, text)
                if last is None:
                    head_at = {"kind": 1, "pid": pid, "doc_id": id_, "text": doc.text}
                else:
                    rows.append(_compare(last, doc))
                last = doc
            yield _batch([(0, pid, None, *r) for r in rows])
        if last is not None:
            yield _batch([_edge(head_at), _edge({"kind": 2, "pid": pid, "doc_id": last.id, "text": last.text})])

    schema = f"kind int, pid int, edge string, {_OUT}"
    rows = written(ranged.mapInArrow(stream, schema), "fingerprints")
    inner = rows.filter("kind = 0").select(*[c.split()[0] for c in _OUT.split(", ")])
    heads = rows.filter("kind = 1").select("pid", F.col("edge").alias("next_text"))
    tails = rows.filter("kind = 2").select("pid", "doc_id", F.col("edge").alias("text"))
    # partition numbers only: one long a partition, however large the table is
    pids = [r.pid for r in heads.select("pid").orderBy("pid").collect()]
    if not pids:
        return inner.withColumn("group_id", F.col("doc_id"))
    follow = tails.sparkSession.createDataFrame(
        pd.DataFrame({"pid": pids, "next_pid": pids[1:] + pids[:1]}), "pid int, next_pid int"
    )
    meet = tails.join(follow, "pid").join(heads.withColumnRenamed("pid", "hp"), F.col("next_pid") == F.col("hp"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_compare(_Doc(i, t), _Doc(None, n)) for i, t, n in zip(b.column(0).to_pylist(), texts(b.column(1)), texts(b.column(2)))]
            yield _batch([(0, 0, None, *r) for r in got])

    closed = meet.select("doc_id", "text", "next_text").mapInArrow(close, schema)
    found = written(inner.unionByName(closed.select(*inner.columns)), "compared")
    forget(rows)
    # an id that stands for several texts may be in several groups: each row takes its own digest's
    groups = exact_groups(two, "doc_id", "t", found.select("doc_id", "fingerprint"))
    least = groups.groupBy(F.col("doc_id").alias("gd"), F.col("fingerprint").alias("gf")).agg(F.min("group_id").alias("group_id"))
    return found.join(least, F.col("doc_id").eqNullSafe(F.col("gd")) & (F.col("fingerprint") == F.col("gf"))).select(
        *inner.columns, "group_id"
    )


_FIELDS = pa.schema(
    [("kind", pa.int32()), ("pid", pa.int32()), ("edge", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [(c, pa.float64()) for c in ("near_edited", "near_next")]
)


def _edge(row: dict) -> tuple:
    return (row["kind"], row["pid"], row["text"], row["doc_id"], None, None, None, None, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)
