"""Token counts by a transducer whose transitions carry the number of tokens put out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, written
from quillspark.llm.memo import Memo, slices, texts, tool
from quillspark.llm.transducer import MergeTransducer, prefix_scan

MEMO = 150_000  #: entries in each generation of a worker's memos
MEMO_CHARS = 64  #: longer words are not kept
CHUNK = 4_096  #: characters of a chunk within a task
LONG = 65_536  #: texts of more characters are read in parallel,
PART = 16_384  #: by chunks of so many
CONTEXT = 64  #: characters before a chunk that tell the state it is entered in
MAX_BROADCAST = 100_000
MARK = "▁"
_RUNS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+|[^A-Za-zÀ-ÖØ-öø-ɏ]+")
_WHOLE = re.compile(r"(?s:.+)")
_STARTS = re.compile(f"(?<!{MARK}){MARK}+")


class PieceCounter:
    """Counts the pieces of a BPE piece model with byte fallback.

    A text is cut into chunks anywhere. A chunk's map takes the state that it is
    entered in to the state that it is left in and the number of pieces put out
    on the way; maps compose, so chunks can be read in any order and their maps
    be scanned. No piece of the model has the space mark after another
    character, so before the first of a run of marks the machine is in its start
    state whatever came before: a chunk depends on its entry only up to there,
    and words between such places are the machine's way from its start state to
    itself, which is kept for a bounded number of words.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ids[model.id_to_piece(i)] = i
        if any(MARK in p.lstrip(MARK) for p in ids) or any(p[:2] == MARK * 2 and p.strip(MARK) for p in ids):
            raise ValueError("pieces reach over a word's start")
        ranks = {p: -model.get_score(i) for p, i in ids.items() if len(p) > 1}
        self.machine = MergeTransducer(ranks, ids, lambda c: (0,) * len(c.encode()), counting=True)
        self._words = Memo(MEMO, self._word)
        self._parts = Memo(MEMO, self.machine.whole)
        #: No piece joins a letter to another character, so no merge reaches over such a place.
        self._runs = _RUNS if all(len(_RUNS.findall(p.lstrip(MARK))) < 2 for p in ids) else _WHOLE

    def _word(self, word: str) -> int:
        n, mark = 0, MARK
        for part in self._runs.findall(word) or ("",):
            n += self._parts(mark + part) if len(part) <= MEMO_CHARS else self.machine.whole(mark + part)
            mark = ""
        return n

    def _segment(self, word: str) -> int:
        """Pieces of a word behind one mark."""
        return self._words.miss(word) if len(word) <= MEMO_CHARS else self._word(word)

    @staticmethod
    def marked(text: str) -> str:
        """``text`` as the model reads it: a mark in front and for each space; empty stays empty."""
        return MARK + text.replace(" ", MARK) if text else ""

    def entry(self, context: str) -> tuple:
        """The state, by its memory, that is likely behind ``context``: surely, if a run of marks begins in it."""
        m = self.machine
        begins = 0
        for found in _STARTS.finditer(context, 1):
            begins = found.start()
        return m.read(context[begins:], m.start)[0]

    def chunk_map(self, chunk: str, context: str = "", entries=None) -> dict[tuple, tuple]:
        """The map of a marked chunk behind ``context``, for ``entries`` or the one that the context tells."""
        m = self.machine
        if entries is None:
            entries = (self.entry(context) if context else m.start,)
        first = _STARTS.search(chunk)
        if first and first.start() == 0 and context[-1:] == MARK:  # its run of marks began before it
            first = _STARTS.search(chunk, first.end())
        if first is None:
            return {e: m.read(chunk, e) for e in entries}
        head, body = chunk[: first.start()], chunk[first.start() :]
        leave, n = self._from_start(body)
        out = {}
        for e in entries:
            at, k = m.read(head, e)
            out[e] = (leave, k + at[-1][2] + n)
        return out

    def _from_start(self, body: str) -> tuple[tuple, int]:
        """What reading ``body``, that begins with a mark, from the start state gives."""
        m = self.machine
        if MARK * 2 not in body:
            words = body.split(MARK)
            get, make = self._words.young.get, self._segment
            n = sum([get(w) or make(w) for w in words[1:-1]])
            leave, k = m.read(MARK + words[-1], m.start)
            return leave, n + k
        starts = [f.start() for f in _STARTS.finditer(body)]
        n = sum(m.whole(body[s:e]) for s, e in zip(starts, starts[1:]))
        leave, k = m.read(body[starts[-1] :], m.start)
        return leave, n + k

    def chunk_maps(self, text: str, chunk: int = CHUNK) -> list[dict[tuple, tuple]]:
        """The maps of the chunks of one text, each made without regard to the others."""
        t = self.marked(text)
        return [self.chunk_map(t[k : k + chunk], t[max(0, k - CONTEXT) : k]) for k in range(0, len(t), chunk)]

    def offsets(self, text: str, chunk: int = CHUNK) -> list[int]:
        """The number of pieces put out up to each chunk's end, held-back ones left out: the scan of the maps."""
        start, maps = self.machine.start, self.chunk_maps(text, chunk)
        scanned = prefix_scan(maps)
        if all(start in s for s in scanned):
            return [s[start][1] for s in scanned]
        # a context told wrong: the maps that miss their entry are made anew, from left to right
        t, at, made = self.marked(text), start, []
        for k, m in zip(range(0, len(t), chunk), maps):
            if at not in m:
                m = self.chunk_map(t[k : k + chunk], t[max(0, k - CONTEXT) : k], (at,))
            at, n = m[at]
            made.append(n)
        return list(accumulate(made))

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """The number of pieces of ``text``, without begin and end."""
        maps = self.chunk_maps(text, chunk)
        if not maps:
            return 0
        start = self.machine.start
        whole = prefix_scan(maps)[-1] if len(maps) > 1 else maps[0]
        if start in whole:
            leave, n = whole[start]
            return n + leave[-1][2]
        leave, n = self.machine.read(self.marked(text), start)
        return n + leave[-1][2]


def counter(path: str) -> PieceCounter:
    """One counter a worker process."""
    return tool(("pieces", path), lambda: PieceCounter(path))


def long_counts(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """``(a, b, size, n)`` of each distinct text ``t`` of ``docs``, read by chunks in parallel.

    A text is known by its bytes' number and two hashes. Its chunks are rows,
    each mapped in whatever task it falls to; the maps, a few numbers each, come
    together by text and are scanned. A text whose maps do not meet has null.
    """
    keyed = docs.select(*text_key(F.col("t")), F.col("t")).dropDuplicates(["a", "b", "size"])
    k = F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / part).cast("int"))).alias("k")
    at = F.col("k") * part
    cut = keyed.select("a", "b", "size", "t", k).select(
        "a", "b", "size", "k",
        F.substring("t", at + 1, F.lit(part)).alias("chunk"),
        F.when(F.col("k") > 0, F.substring("t", F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT)))).alias("context"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, 64):
            ins, outs, ns = [], [], []
            for chunk, context in zip(texts(b.column(4)), b.column(5).to_pylist()):
                first = context is None
                before = "" if first else context.replace(" ", MARK)
                body = chunk.replace(" ", MARK)
                ((entry, (leave, n)),) = c.chunk_map(MARK + body if first else body, before).items()
                ins.append([x for node in entry for x in node])
                outs.append([x for node in leave for x in node])
                ns.append(n)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(ins, pa.list_(pa.int64())), pa.array(outs, pa.list_(pa.int64())), pa.array(ns, pa.int64())],
                names=["a", "b", "size", "k", "entry", "leave", "n"],
            )

    # chunks are dealt anew, so that one text's are read in many tasks
    maps = cut.repartition(F.col("a"), F.col("b"), F.col("k")).mapInArrow(
        work, "a long, b long, size long, k int, entry array<long>, leave array<long>, n long"
    )

    def scan(table: pa.Table) -> pa.Table:
        rows = table.sort_by("k").to_pylist()
        start = (0, -1, 0)
        whole = prefix_scan([{tuple(r["entry"]): (tuple(r["leave"]), r["n"])} for r in rows])[-1]
        found = whole.get(start)
        n = None if found is None else found[1] + found[0][-1]
        return pa.table(
            {"a": [rows[0]["a"]], "b": [rows[0]["b"]], "size": [rows[0]["size"]], "n": pa.array([n], pa.int64())}
        )

    return maps.groupBy("a", "b", "size").applyInArrow(scan, "a long, b long, size long, n long")


def text_key(text) -> list:
    """Two hashes of a text and its number of bytes."""
    return [
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.octet_length(text).cast("long").alias("size"),
    ]


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    long: int = LONG,
    part: int = PART,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text.

    A text of up to ``long`` characters is read by one task, a longer one by
    chunks of ``part`` characters in many (:func:`long_counts`).

    Null texts are empty ones: zero bytes, zero tokens. Bytes that are no UTF-8
    count as U+FFFD. Repeated rows and null ids come out as they went in, other
    columns are not read, and an empty table gives none. The model must be at
    ``path`` on every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in slices(batches):
            n = pa.array([count(t) for t in texts(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    two = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("t"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = "doc_id long, n_bytes long, n_tokens long"
    is_long = F.coalesce(F.length("t") > long, F.lit(False))
    narrow = two.filter(~is_long).mapInArrow(work, kind)
    wide = two.filter(is_long)
    by_text = written(long_counts(wide.select("t"), path, part), "long-counts")
    a, b, size = text_key(F.col("t"))
    found = wide.select("doc_id", "t", "n_bytes", a.alias("ka"), b.alias("kb"), size.alias("ks")).join(
        broadcast_if_small(by_text, MAX_BROADCAST),
        (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")) & (F.col("size") == F.col("ks")),
    )
    out = narrow.unionByName(found.filter("n is not null").select("doc_id", "n_bytes", F.col("n").alias("n_tokens")))
    if not by_text.filter("n is null").isEmpty():  # read whole, in one task each
        out = out.unionByName(found.filter("n is null").select("doc_id", "t", "n_bytes").mapInArrow(work, kind))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
