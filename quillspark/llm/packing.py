"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, written
from quillspark.llm.memo import Memo, release, slices, texts, tool

CAPACITY = 2048
MEMO = 200_000  #: entries in each generation of a worker's memo
MEMO_CHARS = 64  #: longer words are not kept


# --- tokens -----------------------------------------------------------------


class WordIds:
    """The ids of a lower-casing word-end BPE, as little-endian 32-bit bytes.

    Texts of Latin characters without special tokens are cut at white space and
    looked up; a part that is not known yet goes to the library's model. Any
    other text goes to the library whole.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        # byte-level: bytes that are no printable character stand as 256, 257, ...
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.stand_in = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.other = re.compile("[^\t\n\r -~¡-±´-¸º»¿-įı-ɏ]|<\\|")
        self.parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        # a part is a chunk that has no other part, so one memo serves both
        self.chunk = Memo(MEMO, self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        part = self.chunk if len(chunk) <= MEMO_CHARS else self._word
        if chunk[-1] in ",." and chunk[:-1].isalpha():
            return part(chunk[:-1]) + part(chunk[-1])
        parts = self.parts.findall(chunk)
        return self._word(chunk) if parts == [chunk] else b"".join(map(part, parts))

    def _word(self, word: str) -> bytes:
        """One part's ids by the library's model alone; it takes bytes as the characters that stand for them."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.stand_in)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of one text."""
        if self.other.search(text):
            return self._whole(text)
        chunks = text.lower().split()
        found = list(map(self.chunk.young.get, chunks))
        if None in found:
            miss, make = self.chunk.miss, self._chunk
            found = [(miss(c) if len(c) <= MEMO_CHARS else make(c)) if f is None else f for c, f in zip(chunks, found)]
        return b"".join(found)


def word_ids(path: str) -> WordIds:
    """One tokenizer a worker process."""
    return tool(("words", path), lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and a closing 0, cut only beyond the capacity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path).ids
        step = 4 * CAPACITY
        for b in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for id_, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                ids = ids_of(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(out, (id_, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    small_batches(docs.sparkSession)
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return two.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm over one block of items ----------------------------


class _Bins:
    """Open bins by free space; the fullest bin that still takes an item is found by bit tricks."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, items: list[int], room: int) -> None:
        if not self.by_room[room]:
            self.mask |= 1 << room
        self.by_room[room].append(items)

    def put(self, item: int, size: int) -> None:
        over = self.mask >> size
        if not over:
            self.add([item], self.capacity - size)
            return
        room = size + (over & -over).bit_length() - 1
        stack = self.by_room[room]
        bin_ = stack.pop()
        if not stack:
            self.mask &= ~(1 << room)
        bin_.append(item)
        self.add(bin_, room - size)

    def all(self) -> list[list[int]]:
        return [b for stack in self.by_room for b in stack]


def best_fit(order, sizes, capacity: int, kept: list[list[int]] = ()) -> list[list[int]]:
    """Items put, in this order, each into the fullest bin that takes it; ``kept`` bins may be filled up."""
    bins = _Bins(capacity)
    for b in kept:
        bins.add(list(b), capacity - sum([sizes[i] for i in b]))
    for i in order:
        bins.put(i, sizes[i])
    return bins.all()


def fitness(bins: list[list[int]], sizes, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean of squared fillings: full bins beside empty ones are good."""
    full = [sum([sizes[i] for i in b]) / capacity for b in bins]
    return (-len(bins), sum([f * f for f in full]) / max(1, len(bins)))


def crossover(a: list[list[int]], b: list[list[int]], sizes, capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of ``b`` go into ``a``; bins of ``a`` that hold any of
    their items dissolve, and what they lose is put back by best fit, longest first."""
    fill = sorted(range(len(b)), key=lambda k: -sum([sizes[i] for i in b[k]]))
    take = fill[: max(1, int(len(fill) * rng.uniform(0.3, 0.7)))]
    injected = [b[k] for k in take]
    taken = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in taken]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, injected + kept)


def mutate(a: list[list[int]], sizes, capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest bins and a few others dissolve and their items are put back in random order."""
    order = sorted(range(len(a)), key=lambda k: sum([sizes[i] for i in a[k]]))
    out = set(order[: max(2, len(a) // 20)]) | set(rng.sample(order, min(len(order), 2 + len(a) // 20)))
    loose = [i for k in out for i in a[k]]
    rng.shuffle(loose)
    return best_fit(loose, sizes, capacity, [x for k, x in enumerate(a) if k not in out])


def evolve(
    sizes: list[int], capacity: int, seed: int, population: int = 4, generations: int = 12, elite=()
) -> list[list[int]]:
    """The best grouping found for one block; ``elite`` groupings join the first population.

    It ends early at the lower bound, the total over the capacity.
    """
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [list(e) for e in elite] + [best_fit(order, sizes, capacity)]

    def score(p):
        return fitness(p, sizes, capacity)

    while len(people) < population:
        if -score(people[-1])[0] <= bound:
            return people[-1]
        loose = sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0))
        people.append(best_fit(loose, sizes, capacity))
    people = sorted(people, key=score, reverse=True)[:population]
    for _ in range(generations):
        if len(people[0]) <= bound:
            break
        mother, father = people[0], people[rng.randrange(1, len(people))]
        if rng.random() < 0.5:
            mother, father = father, mother
        child = crossover(mother, father, sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        people = sorted([*people, child], key=score, reverse=True)[:population]
    return people[0]


# --- on Spark -----------------------------------------------------------------

_ROW = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, block long"
_KEYS = [c.split()[0] for c in _ROW.split(", ")]
_PLACED = f"{_ROW}, bin long, done boolean"
LOOSE = 32  #: of a block's bins, the emptiest one in so many meet other blocks' in the next round,
LOOSE_MOST = 3  #: and of all that have room for ``ROOM`` of a bin, up to one in so many
ROOM = 1 / 64


def _to_bins(assigned) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(assigned.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def _to_column(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _evolved(rows: DataFrame, capacity: int, islands: int, migrations: int, seed: int) -> DataFrame:
    """``rows`` of ``_ROW`` with the ``bin`` of their block that each goes to.

    Each block is first packed by best fit, longest first. Where that meets the
    block's lower bound it cannot be bettered; elsewhere ``islands`` populations
    evolve, each island's best moves to the next island of the ring and all
    evolve on; at last the best island of a block gives the result. A task holds
    one block's lengths, never more.
    """

    def bound(sizes: list[int]) -> int:
        return -(-sum(sizes) // capacity)

    def first(key, pdf):
        release()
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        sizes = pdf["length"].tolist()
        bins = best_fit(range(len(sizes)), sizes, capacity)
        return pdf.assign(bin=_to_column(bins, len(pdf)), done=len(bins) <= bound(sizes))

    def again(key, pdf):
        pdf = pdf.sort_values(["guest", "row"], ignore_index=True)
        own, guest = (pdf[pdf["guest"] == g] for g in (0, 1))
        sizes = own["length"].tolist()
        elite = [_to_bins(x["bin"].reset_index(drop=True)) for x in (own, guest) if len(x)]
        bins = evolve(sizes, capacity, seed + 1009 * int(key[2]) + 31 * int(key[0]) + int(key[1]), elite=elite)
        return own.drop(columns=["guest", "round"]).assign(bin=_to_column(bins, len(own)))

    def best(key, pdf):
        found = []
        for _, one in pdf.sort_values(["island", "row"]).groupby("island", sort=True):
            one = one.reset_index(drop=True)
            found.append((fitness(_to_bins(one["bin"]), one["length"].tolist(), capacity), one))
        return max(found, key=lambda f: f[0])[1].drop(columns="island")

    placed = written(rows.select(*_KEYS).groupBy("block").applyInPandas(first, _PLACED), "placed")
    hard = placed.filter("not done")
    if hard.isEmpty():
        return placed.drop("done")
    island = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    now = hard.select(*_KEYS, "bin", island, F.lit(0).alias("guest"), F.lit(0).alias("round"))
    for step in range(1 + (migrations if islands > 1 else 0)):
        if step:
            now = now.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("round", F.lit(step)).withColumn(
                "island", F.when(F.col("guest") == 0, F.col("island")).otherwise(F.pmod(F.col("island") + 1, F.lit(islands)))
            )
        now = now.groupBy("block", "island", "round").applyInPandas(again, f"{_ROW}, bin long, island int")
    evolved = now.groupBy("block").applyInPandas(best, f"{_ROW}, bin long")
    return placed.filter("done").drop("done").unionByName(written(evolved, "evolved"))


def pack(
    parts: DataFrame,
    capacity: int = CAPACITY,
    block_items: int = 4096,
    islands: int = 2,
    migrations: int = 1,
    seed: int = 7,
) -> DataFrame:
    """Pack the rows of ``pieces`` into sequences: adds ``sequence_id`` and ``offset``.

    Rows are dealt by a hash of their place in the written table into blocks of
    about ``block_items``; a block is one problem. What space blocks leave is in
    their emptiest bins: those bins' rows are dealt into fewer blocks and packed
    anew, and so on until one block is left, so the surplus over the lower bound
    hardly grows with the number of blocks. Every row is packed.
    """
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    count = parts.count()
    rows = parts.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-count // block_items)))))
    full, step = [], 0
    while True:
        blocks = max(1, -(-count // block_items))
        placed = _evolved(rows, capacity, islands, migrations, seed + 7919 * step)
        binned = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill"), F.count("*").alias("k"))
        if blocks > 1:
            w = Window.partitionBy("block").orderBy("fill", "bin")
            n = F.count("*").over(Window.partitionBy("block"))
            place, roomy = F.row_number().over(w), F.col("fill") <= capacity * (1 - ROOM)
            binned = binned.withColumn(
                "loose", (place <= F.greatest(n / LOOSE, F.lit(1))) | (roomy & (place <= n / LOOSE_MOST))
            )
        else:
            binned = binned.withColumn("loose", F.lit(False))
        marked = written(
            placed.join(binned.select("block", "bin", "loose"), ["block", "bin"]).withColumn("step", F.lit(step)), "binned"
        )
        full.append(marked.filter("not loose"))
        if blocks == 1:
            break
        loose = marked.filter("loose")
        count, step = loose.count(), step + 1
        # the bins of a block stay together
        rows = loose.drop("bin", "loose", "step").withColumn(
            "block", F.pmod(F.xxhash64("block", F.lit(step)), F.lit(max(1, -(-count // block_items))))
        )
    kept = full[0]
    for f in full[1:]:
        kept = kept.unionByName(f)

    def offsets(key, pdf):
        pdf = pdf.sort_values(["bin", "row"], ignore_index=True)
        pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = (int(key[0]) << 52) + (int(key[1]) << 20) + pdf["bin"]
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return kept.groupBy("step", "block").applyInPandas(
        offsets,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of every document.

    A null text is empty: its one piece is the closing id. Bytes that are no
    UTF-8 count as U+FFFD. Repeated rows are packed as often as they come, a null
    id is carried along, other columns are not read, and an empty table gives
    none.
    """
    return pack(pieces(docs, path, id_col, text_col))
