"""Packing into windows by best-fit decreasing; what room is left is filled by cutting few documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, forget, small_batches, written
from quillspark.llm.memo import release, slices, texts, tool

CAPACITY = 2048
CLOSING = 1  #: the id after each document
BLOCK_ITEMS = 4096  #: pieces that one task packs at a time
MAX_BROADCAST = 200_000  #: rows of a broadcast list of documents


# --- tokens -----------------------------------------------------------------


class ByteIds:
    """The ids of a byte-level BPE of the ``tokenizers`` library, as little-endian 32-bit bytes.

    Where the file's merges make tokens in the order of their ids, its
    vocabulary is a rank table and ``tiktoken``, which is several times as
    quick, gives the same ids; texts that hold an added token, and files of
    another kind, go to the library itself.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [t["content"] for t in said.get("added_tokens", [])]
        self.quick = self._ranked(said)

    @staticmethod
    def _ranked(said: dict):
        """A ``tiktoken`` encoding of the same ids, if the file is of that kind."""
        import public_tokenizers
        import tiktoken

        model, cut = said["model"], said.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if model.get("type") != "BPE" or not plain or said.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            return None
        # byte-level: bytes that are no printable character stand as 256, 257, ...
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        stands = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(stands[c] for c in t): n for t, n in model["vocab"].items() if all(c in stands for c in t)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        made = [model["vocab"].get("".join(p)) for p in pairs]
        if None in made or any(x >= y for x, y in zip(made, made[1:])) or len(ranks) != 256 + len(made) or sorted(ranks.values()) != list(range(len(ranks))):
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text."""
        if self.quick is not None and not any(t in text for t in self.added):
            return np.array(self.quick.encode_ordinary(text), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


def byte_ids(path: str) -> ByteIds:
    """One tokenizer a worker process."""
    return tool(("bytes", path), lambda: ByteIds(path))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, a, b, t)``: the text and two hashes by which a row is found again; rows equal in them have equal ids."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"), t.alias("t")
    )


_PIECE = "doc_id long, a long, b long, start long, length long, ids_crc32 long, doc_tokens long"


def windows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``_PIECE``: each document's ids and the closing one, cut into full windows and a rest."""
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, close = byte_ids(path).ids, np.array([CLOSING], dtype="<u4").tobytes()
        for b in slices(batches):
            out: tuple[list, ...] = tuple([] for _ in names)
            for id_, x, y, text in zip(*(c.to_pylist() for c in b.columns[:3]), texts(b.column(3))):
                ids = ids_of(text).tobytes() + close
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (id_, x, y, start, len(part) // 4, zlib.crc32(part), total)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return _keyed(docs, id_col, text_col).mapInArrow(work, _PIECE)


# --- best-fit decreasing over one block ------------------------------------------


class OpenWindows:
    """Windows by their room, in a segment tree whose nodes count the open windows of a range of rooms."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.by_room: dict[int, list[int]] = {}

    def add(self, window: int, room: int) -> None:
        """A window with so much room; a full one is not open."""
        if room <= 0:
            return
        self.by_room.setdefault(room, []).append(window)
        node = room + self.leaves
        while node:
            self.open[node] += 1
            node >>= 1

    def tightest(self, size: int) -> int | None:
        """The least room of at least ``size`` that an open window has."""
        node = size + self.leaves
        if self.open[node]:
            return size
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def take(self, room: int) -> int:
        """One of the windows with exactly this room; it is open no more."""
        window = self.by_room[room].pop()
        node = room + self.leaves
        while node:
            self.open[node] -= 1
            node >>= 1
        return window


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers: items, longest first, each into the tightest open window that takes it."""
    found, tree = [], OpenWindows(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.tightest(sizes[i])
        if room is None:
            found.append([i])
            tree.add(len(found) - 1, capacity - sizes[i])
        else:
            w = tree.take(room)
            found[w].append(i)
            tree.add(w, room - sizes[i])
    return found


def fill_windows(sizes: list[int], capacity: int, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of ``(item, from, to)`` parts, and the loose parts that are left, less than one window.

    The fullest windows of :func:`best_fit_decreasing` stay, as many as the
    tokens fill. The others' items go whole where they fit; then each gap takes
    the front of an item, so at most one item is cut a gap. With ``last`` what is
    left is dealt into windows of powers of two, which need no padding either.
    """
    bins = best_fit_decreasing(sizes, capacity)
    total = sum(sizes)
    fill = [sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: -fill[k])
    n = total // capacity
    kept = [[(i, 0, sizes[i]) for i in bins[k]] for k in order[:n]]
    tree = OpenWindows(capacity)
    for w, k in enumerate(order[:n]):
        tree.add(w, capacity - fill[k])
    loose = []
    for i in sorted((i for k in order[n:] for i in bins[k]), key=lambda i: -sizes[i]):
        room = tree.tightest(sizes[i])
        if room is None:
            loose.append((i, 0, sizes[i]))
        else:
            w = tree.take(room)
            kept[w].append((i, 0, sizes[i]))
            tree.add(w, room - sizes[i])
    targets = [(kept[w], room) for room in sorted(tree.by_room, reverse=True) for w in tree.by_room[room]]
    if last:
        rest = total - n * capacity
        for p in (1 << k for k in range(rest.bit_length() - 1, -1, -1)):
            if rest & p:
                kept.append([])
                targets.append((kept[-1], p))
    loose.reverse()
    for window, room in targets:
        while room:
            i, a, z = loose.pop()
            most = min(room, z - a)
            window.append((i, a, a + most))
            room -= most
            if a + most < z:
                loose.append((i, a + most, z))
    return kept, loose


# --- on Spark -----------------------------------------------------------------

_ROW = f"{_PIECE}, row long"
_PACKED = f"{_PIECE}, sequence_id long, offset long"


def _packed(step: int, last: bool, capacity: int):
    """The task of one block of one round."""

    def packed(key, table):
        release()
        table = table.sort_by("row")
        windows_, loose = fill_windows(table.column("length").to_pylist(), capacity, last)
        at, first, past, seq, offset = [], [], [], [], []
        for k, w in enumerate([*windows_, *([p] for p in loose)]):
            place = 0
            for i, a, z in w:
                for column, value in zip((at, first, past, seq, offset), (i, a, z, k if k < len(windows_) else -1, place)):
                    column.append(value)
                place += z - a
        got = table.take(pa.array(at, pa.int64()))
        a, z, seq = (np.array(x, dtype=np.int64) for x in (first, past, seq))
        whole = pa.array(z - a == got.column("length").to_numpy())
        made = {
            "start": pc.add(got.column("start"), pa.array(a)),
            "length": pa.array(z - a),
            "ids_crc32": pc.if_else(whole, got.column("ids_crc32"), pa.scalar(None, pa.int64())),
            "sequence_id": pa.array((step << 56) + (key[0].as_py() << 20) + seq),
            "loose": pa.array(seq < 0),
            "offset": pa.array(offset, pa.int64()),
        }
        return pa.table({n: made[n] if n in made else got.column(n) for n in (*got.column_names, "sequence_id", "loose", "offset")})

    return packed


def pack_windows(parts: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``parts`` of ``_PIECE`` in windows: rows of ``_PACKED``; a part that was cut has no ``ids_crc32`` yet.

    Full windows stand alone and never move. The rest is dealt evenly, by a hash
    of its place in the written table, into blocks of about ``block_items``; a
    block gives full windows and less than one window of loose parts, and those
    of all blocks are packed in the next round in fewer blocks, until there is one.
    """
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "windows")
    names = [c.split()[0] for c in _PIECE.split(", ")]
    whole = parts.filter(F.col("length") == capacity).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.filter(F.col("length") < capacity)
    out, step = [whole], 0
    count = rest.count()
    while True:
        blocks = max(1, -(-count // block_items))
        last = blocks == 1
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("row", "start"), F.lit(blocks)))
        made = dealt.groupBy("block").applyInArrow(_packed(step, last, capacity), f"{_ROW}, block long, sequence_id long, loose boolean, offset long")
        made = written(made, "packed")
        out.append(made.filter("not loose").select(*names, "sequence_id", "offset"))
        if last:
            break
        rest, step = made.filter("loose").select(*names, "row"), step + 1
        count = rest.count()
    kept = out[0]
    for o in out[1:]:
        kept = kept.unionByName(o)
    return kept


def _crcs(docs: DataFrame, cut: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """``cut`` with the ``ids_crc32`` of each part: the documents that were cut are read again, once each."""
    spans = cut.groupBy("doc_id", "a", "b").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    spans = written(spans, "spans")
    few = broadcast_if_small(spans, MAX_BROADCAST, size=F.size("spans") * 16 + 40)
    keyed = _keyed(docs, id_col, text_col)
    same = keyed["doc_id"].eqNullSafe(few["doc_id"]) & (keyed["a"] == few["a"]) & (keyed["b"] == few["b"])
    found = keyed.join(few, same).select(keyed["doc_id"], keyed["a"], keyed["b"], "t", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, close = byte_ids(path).ids, np.array([CLOSING], dtype="<u4").tobytes()
        for b in slices(batches):
            out: tuple[list, ...] = tuple([] for _ in range(6))
            for id_, x, y, spans_, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), texts(b.column(3))):
                ids = ids_of(text).tobytes() + close
                for s in spans_:
                    part = ids[4 * s["start"] : 4 * (s["start"] + s["length"])]
                    for column, value in zip(out, (id_, x, y, s["start"], s["length"], zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["d", "x", "y", "s", "l", "crc"])

    once = found.dropDuplicates(["doc_id", "a", "b"]) if not spans.isEmpty() else found
    crc = written(once.mapInArrow(work, "d long, x long, y long, s long, l long, crc long"), "crcs")
    forget(spans)
    at = F.col("doc_id").eqNullSafe(F.col("d")) & F.expr("a = x and b = y and start = s and length = l")
    return cut.join(crc, at).withColumn("ids_crc32", F.col("crc")).drop("d", "x", "y", "s", "l", "crc")


def pack_into_windows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of every part of every document.

    Every sequence is a full window, but for at most eleven of the last block,
    whose lengths are powers of two. A null text is empty: its one part is the
    closing id. Bytes that are no UTF-8 count as U+FFFD. Repeated rows are packed
    as often as they come, a null id is carried along, other columns are not
    read, and an empty table gives none.
    """
    small_batches(docs.sparkSession)
    kept = pack_windows(windows(docs, path, id_col, text_col))
    whole, cut = kept.filter("ids_crc32 is not null"), kept.filter("ids_crc32 is null")
    both = whole.unionByName(_crcs(docs, cut, path, id_col, text_col))
    return both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
