"""Conversation structure repair: the cheapest edits that give turns an order of roles.

Three machines are composed: an acceptor of the conversation's turns, a
transducer of the edits and an acceptor of the role grammar. The composed states
are made only as the search comes to them, and the cheapest path is found in
their topological order over weights of (cost, edit letters), compared in that
order. A stretch of turns is a matrix of such weights between grammar states, so
stretches of one conversation are searched in different tasks and multiplied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.common import broadcast_if_small, small_batches, written

# --- the machines -------------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = STATES = range(4)

#: The role grammar ``(s?(ua)+)?`` over role initials.
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1  #: more for a turn that is truncated and stays
#: Insertions in a row that can be of use: a third comes back to a state that was cheaper before.
INSERTS = 2

Weight = tuple[int, str]


def edits(symbol: str | None, inserts: int) -> Iterator[tuple[str, str, int, int]]:
    """The edit transducer's arcs ``(letter, outputs, cost, insertions in a row)`` for a symbol, or for none.

    A symbol is a turn's role initial (``o`` for any other), a capital if it is
    truncated, or ``x`` if the turn must go.
    """
    if symbol is None:
        if inserts < INSERTS:
            yield INSERT, "ua", COST[INSERT], inserts + 1
        return
    yield DELETE, "", COST[DELETE], 0
    kind = symbol.lower()
    if kind == "x":
        return
    more = TRUNCATED if symbol != kind else 0
    if kind != "o":
        yield KEEP, kind, COST[KEEP] + more, 0
    yield REROLE, "ua", COST[REROLE] + more, 0


def composed(symbols: str, at: int, inserts: int, role: int) -> Iterator[tuple[int, int, int, int, str]]:
    """The arcs that leave one composed state: ``(turn, insertions, role state, cost, letter)``."""
    for symbol, there in ((None, at), (symbols[at : at + 1], at + 1)):
        if symbol == "":
            continue
        for letter, outputs, cost, more in edits(symbol, inserts):
            if not outputs:
                yield there, more, role, cost, letter
            for o in outputs:
                if o in GRAMMAR[role]:
                    yield there, more, GRAMMAR[role][o], cost, letter


@lru_cache(maxsize=1 << 14)
def distances(symbols: str, entry: int) -> tuple[Weight | None, ...]:
    """The least weight from a role state before these turns to each one after them; None where there is no path.

    Turns and insertions in a row are a topological order. Equal costs are
    decided by the letters; of two ways through the same turns at the same cost
    neither's letters begin the other's, so a prefix's choice stays right.
    """
    layer: dict[tuple[int, int], Weight] = {(0, entry): (0, "")}
    for at in range(len(symbols) + 1):
        ahead: dict[tuple[int, int], Weight] = {}
        for inserts in range(INSERTS + 1):
            for role in STATES:
                if (inserts, role) not in layer:
                    continue
                cost, letters = layer[inserts, role]
                for there, more, q, c, letter in composed(symbols, at, inserts, role):
                    found, into = (cost + c, letters + letter), layer if there == at else ahead
                    if (more, q) not in into or found < into[more, q]:
                        into[more, q] = found
        if at < len(symbols):
            layer = ahead
    return tuple(min((w for (_, q), w in layer.items() if q == role), default=None) for role in STATES)


Matrix = tuple[tuple[Weight | None, ...], ...]


def matrix(symbols: str) -> Matrix:
    """:func:`distances` from every role state."""
    return tuple(distances(symbols, entry) for entry in STATES)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The weights of two stretches of turns, one after the other."""

    def least(i: int, j: int) -> Weight | None:
        ways = [(x[0] + y[j][0], x[1] + y[j][1]) for x, y in zip(a[i], b) if x is not None and y[j] is not None]
        return min(ways, default=None)

    return tuple(tuple(least(i, j) for j in STATES) for i in STATES)


class Stretch:
    """The matrix of turns that come one by one: short pieces, multiplied in pairs of like size."""

    PIECE = 64

    def __init__(self):
        self.symbols: list[str] = []
        self.pieces: list[tuple[int, Matrix]] = []

    def add(self, symbol: str) -> None:
        self.symbols.append(symbol)
        if len(self.symbols) == self.PIECE:
            self._close()

    def _close(self) -> None:
        made = (0, matrix("".join(self.symbols)))
        self.symbols.clear()
        while self.pieces and self.pieces[-1][0] == made[0]:
            made = (made[0] + 1, product(self.pieces.pop()[1], made[1]))
        self.pieces.append(made)

    def matrix(self) -> Matrix:
        whole = [m for _, m in self.pieces] + [matrix("".join(self.symbols))]
        return reduce(lambda right, left: product(left, right), reversed(whole))

    def cheapest(self) -> Weight:
        """The least weight of a whole conversation."""
        return accepted(distances("".join(self.symbols), START) if not self.pieces else self.matrix()[START])


def accepted(weights: tuple[Weight | None, ...]) -> Weight:
    """The least weight that ends in a final state of the grammar; all turns can go, so there is one."""
    return min(weights[q] for q in FINAL if weights[q] is not None)


class Edited:
    """Turns as edit letters leave them: ``(letter, role, text)`` in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _made(self, letter: str, text: str) -> tuple[str, str, str]:
        (o,) = (o for o in GRAMMAR[self.state] if o in NAMES)
        self.state = GRAMMAR[self.state][o]
        return letter, NAMES[o], text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """The turns inserted here."""
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield self._made(INSERT, "")

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What becomes of the next turn, and what is inserted before it."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == REROLE:
            yield self._made(REROLE, text)
        elif letter == KEEP:
            self.state = GRAMMAR[self.state][role[:1]]
            yield KEEP, role, text


# --- on Spark -----------------------------------------------------------------

_BLANK = r"\x20\x09-\x0D"
_ORDER = ["turn", "role", "h", "row", "copy"]
MAX_BROADCAST = 500_000
REPORT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [T.StructField("audit", T.StringType())]
)


_TEXTS = (("turn", "long"), ("role", "string"), ("h", "string"), ("row", "long"), ("copy", "int"), ("text", "string"))


class Repaired(NamedTuple):
    """``stream``: a conversation's repaired turns, adjacent and in order, and then its report; and both apart."""

    stream: DataFrame

    @property
    def turns(self) -> DataFrame:
        """``(conv_id, place, edit, role, text)`` of every repaired turn."""
        return self.stream.filter("report is null").drop("report")

    @property
    def reports(self) -> DataFrame:
        """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation."""
        return self.stream.filter("report is not null").select("conv_id", "report.*")


def as_rows(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copy, gone)``: the turns as they are; null roles and texts are one space."""
    return conversations.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        F.lit(0).alias("copy"), F.lit(False).alias("gone"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """:func:`as_rows` with known damage, by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls are one space).

    0 drops a turn (it stays as ``gone``, so no conversation is lost), 1 empties its text, 2 takes
    its ``.!?`` away, 3 repeats it and 4 makes it the user's.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    k = F.crc32(name) % 20
    hurt = as_rows(conversations).withColumn("k", k)
    return hurt.select(
        "conv_id", "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("k") == 0).alias("gone"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with their order's keys, and ``fault`` (blank, truncated or none; a duplicate is known later)."""
    return (
        rows.withColumn("row", F.monotonically_increasing_id())
        .withColumn("h", F.md5(F.encode("text", "utf-8")))
        .withColumn(
            "fault",
            F.when(~F.col("text").rlike(f"[^{_BLANK}]"), "blank").when(~F.col("text").rlike(rf"[.!?][{_BLANK}]*\z"), "truncated"),
        )
    )


def _with_duplicates(narrow: DataFrame) -> DataFrame:
    """``narrow`` with ``fault`` also for turns whose role and text an earlier turn of the conversation has."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row", "copy")
    alive = narrow.filter("not gone and (fault is null or fault <> 'blank')")
    again = alive.groupBy("conv_id", "role", "h").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    again = written(again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first"), "repeated-turns")
    few = broadcast_if_small(again, MAX_BROADCAST, size=F.octet_length("r") + 120)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g"))
    later = F.coalesce(order > F.col("first"), F.lit(False)) & ~F.coalesce(F.col("fault") == "blank", F.lit(False))
    return narrow.join(few, same, "left").withColumn("fault", F.when(later, "duplicate").otherwise(F.col("fault"))).drop("c", "r", "g", "first")


def _symbol() -> Column:
    """The turn as the edit transducer reads it."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)


class _Part:
    """What one task knows of one conversation; parts that follow one another are joined."""

    __slots__ = ("n", "faults", "illegal", "head", "tail", "first", "last", "distinct", "stretch")

    def __init__(self):
        self.n = self.illegal = self.distinct = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.head = self.tail = self.first = self.last = None
        self.stretch = Stretch()

    def add(self, turn: int | None, initial: str, fault: str | None, symbol: str) -> None:
        if self.n:
            self.illegal += self.tail + initial not in ("su", "ua", "au")
        else:
            self.head = initial
        self.tail, self.n = initial, self.n + 1
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.distinct += self.last != turn
            self.last = turn
        if fault:
            self.faults[fault] += 1
        self.stretch.add(symbol)


_PART = (
    "part int, n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, first long, last long, "
    "distinct long, costs array<long>, audits array<string>"
)


def _parts(rows: DataFrame) -> DataFrame:
    """Rows of ``_PART``, in order, of each conversation: one with one weight if it lies within one task, else with all 16."""
    kind = rows.schema["conv_id"].dataType
    out = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(_PART).fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def made(conv, p: _Part, part: int, within: bool) -> dict:
        if within:
            weights = [p.stretch.cheapest() if p.n else (0, "")]
        else:
            weights = [w for line in p.stretch.matrix() for w in line]
        return {
            "conv_id": conv, "part": part, "n": p.n, **p.faults, "illegal": p.illegal, "head": p.head, "tail": p.tail,
            "first": p.first, "last": p.last, "distinct": p.distinct,
            "costs": [None if w is None else w[0] for w in weights], "audits": [None if w is None else w[1] for w in weights],
        }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, now, edge = None, None, True
        for b in batches:
            done = []
            for c, turn, initial, fault, symbol, gone in zip(*(x.to_pylist() for x in b.columns)):
                if now is None or c != conv:
                    if now is not None:  # the first conversation of a task may have begun before it
                        done.append(made(conv, now, part, not edge))
                        edge = False
                    conv, now = c, _Part()
                if not gone:
                    now.add(turn, initial, fault, symbol)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if now is not None:  # and the last one may go on after it
            yield pa.RecordBatch.from_pylist([made(conv, now, part, False)], schema=arrow)

    ranged = rows.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    narrow = ranged.select("conv_id", "turn", F.substring("role", 1, 1), "fault", _symbol(), "gone")
    return narrow.mapInArrow(work, out)


def _joined(parts: DataFrame) -> DataFrame:
    """``(conv_id, report)`` of each conversation from its parts.

    One that lies within a task is a row already; of another a task gets one row
    for each task that had a part, at most two conversations a task.
    """
    out = T.StructType([parts.schema["conv_id"], T.StructField("report", REPORT)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def whole(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        got = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        tail = last = least = None
        distinct, total = 0, None
        for r in (r for r in rows if r["n"]):
            for c in got:
                got[c] += r[c]
            if tail is not None:
                got["illegal"] += tail + r["head"] not in ("su", "ua", "au")
            tail = r["tail"]
            if r["first"] is not None:
                distinct += r["distinct"] - (last == r["first"])
                least, last = r["first"] if least is None else least, r["last"]
            flat = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])]
            one = tuple(tuple(flat[4 * k : 4 * k + 4]) for k in STATES)
            total = one if total is None else product(total, one)
        cost, audit = (0, "") if total is None else accepted(total[START])
        gaps = 0 if least is None else last - least + 1 - distinct
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "report": {"gaps": gaps, **got, "cost": cost, "audit": audit}}], schema=arrow)

    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("distinct"), F.lit(0).cast("long"))
    fields = {"gaps": gaps, "cost": F.col("costs")[0], "audit": F.col("audits")[0]}
    report = F.struct(*(fields.get(f.name, F.col(f.name)).alias(f.name) for f in REPORT.fields)).cast(REPORT)
    within = parts.filter(F.size("costs") == 1).select("conv_id", report.alias("report"))
    return within.unionByName(parts.filter(F.size("costs") > 1).groupBy("conv_id").applyInArrow(whole, out))


def repair(rows: DataFrame) -> Repaired:
    """The cheapest repair of each conversation of ``rows`` (:func:`as_rows`).

    Turns go by ``turn``, nulls first; those of one turn by role, then by the MD5
    of their text. Deleting a turn costs 3, and blank turns and repeats of an
    earlier role and text must go; another role or an inserted empty turn costs
    2, and a truncated turn that stays 1. Of equally cheap repairs the one whose
    letters are least by ASCII is taken. Conversations of which every turn is
    ``gone`` have a report of zeros. A null ``conv_id`` is one conversation; no
    row gives none; other columns are not read.

    What finds the edits needs no text: it is dealt by ranges of conversation,
    turn and row, so a conversation of any size is shared out, and its stretches'
    matrices are multiplied; these take 16 letters a turn, the audit itself one.
    Then texts move once, by conversation, and are edited as a stream.
    """
    small_batches(rows.sparkSession)
    marked = _marked(rows)
    parts = written(_parts(_with_duplicates(marked.drop("text"))), "conversation-parts")
    reports = written(_joined(parts), "conversation-reports")
    kind = marked.schema["conv_id"].dataType
    heads = reports.select("conv_id", F.lit(0).alias("tag"), *(F.lit(None).cast(t).alias(c) for c, t in _TEXTS), "report")
    texts = marked.filter("not gone").select("conv_id", F.lit(1).alias("tag"), *_ORDER, "text", F.lit(None).cast(REPORT).alias("report"))
    both = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "tag", *_ORDER)
    out = T.StructType(
        [T.StructField("conv_id", kind), T.StructField("place", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edit", "role", "text")] + [T.StructField("report", REPORT)]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report = edited = conv = None
        place, made = 0, []

        def put(turns) -> None:
            nonlocal place
            for letter, role, text in turns:
                made.append({"conv_id": conv, "place": place, "edit": letter, "role": role, "text": text})
                place += 1

        def close() -> None:
            if edited is not None:
                put(edited.inserted())
                made.append({"conv_id": conv, "report": report})

        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                for c, role, text, said in zip(*(part.column(n).to_pylist() for n in ("conv_id", "role", "text", "report"))):
                    if said is not None:
                        close()
                        conv, report, edited, place = c, said, Edited(said["audit"]), 0
                    else:
                        put(edited.turn(role, text))
                yield pa.RecordBatch.from_pylist(made, schema=arrow)
                made.clear()
        close()
        yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return Repaired(both.select("conv_id", "role", "text", "report").mapInArrow(work, out))


def with_digests(repaired: Repaired) -> DataFrame:
    """Each conversation's report, and ``repaired_sha256`` of its repaired ``role:text``, joined by newlines.

    The stream is read as it comes: a conversation's turns lie together in one partition.
    """
    stream = repaired.stream
    fields = [stream.schema["conv_id"], *REPORT.fields, T.StructField("repaired_sha256", T.StringType())]
    out = T.StructType(fields)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, more = hashlib.sha256(), False
        for b in batches:
            done = []
            for conv, role, text, report in zip(*(c.to_pylist() for c in b.columns)):
                if report is None:
                    digest.update(f"{chr(10) if more else ''}{role}:{text}".encode())
                    more = True
                else:
                    done.append({"conv_id": conv, **report, "repaired_sha256": digest.hexdigest()})
                    digest, more = hashlib.sha256(), False
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return stream.select("conv_id", "role", "text", "report").mapInArrow(work, out)
