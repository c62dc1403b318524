"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are whole words and their first 4 and 5 letters. A term of a text weighs
1 + the logarithm of its count, times its inverse document frequency, times how
far its share of toxic texts among learning rows is from that of all of them (in
logarithms), so that words which tell nothing hardly count. No term is left out
that any example has; terms without an example meet nothing. A text's vote is
that of its nearest examples, by the square of their cosine, and a score is the
vote calibrated on learning rows that are no examples. A block-max inverted
index finds the nearest exactly: only blocks of examples are read whose largest
possible cosine reaches what some of the examples have for certain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import column_name, forget, small_batches, written
from quillspark.llm.memo import release, slices, texts, trim

FIT_ROWS = 8_000  #: labelled rows that are learned from, at most
CALIBRATION = 5  #: one in so many of them calibrates and is no example
EXAMPLES = 768  #: examples of each label in the index, at most
NEIGHBOURS = 15
BLOCK = 64
COMMON = 1_024  #: terms of the longest lists, that are kept as a matrix
STEMS = (4, 5)
ROWS = 128  #: texts that a worker scores at once
SMOOTH = 2.0  #: expected toxic texts that are added to both sides of a term's ratio
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def text_terms(text: str) -> Counter:
    """How often each term is in a text: its lower-cased words, and longer words' stems with a ``*``."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        out[word] += n
        for k in STEMS:
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


class Terms:
    """Finds and counts the terms of a sorted vocabulary in texts, as places in it."""

    def __init__(self, vocabulary: list[str]):
        self.words = {t: i for i, t in enumerate(vocabulary) if not t.endswith("*")}
        self.stems = {k: {t[:-1]: i for i, t in enumerate(vocabulary) if t.endswith("*") and len(t) == k + 1} for k in STEMS}
        #: for each term that is a word the places of its stems, so that it is looked up once
        self._stems_of = np.full((len(STEMS), len(vocabulary)), -1, dtype=np.int32)
        for row, (k, known) in zip(self._stems_of, self.stems.items()):
            for w, i in self.words.items():
                if len(w) > k:
                    row[i] = known.get(w[:k], -1)
        self._at = np.zeros(len(vocabulary), dtype=np.int64)

    def _places(self, words: list[str]) -> list[np.ndarray]:
        """For each word the place of it and of each of its stems, -1 for one that is not known."""
        whole = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = (whole < 0).nonzero()[0].tolist()
        out = [whole]
        for (k, known), of_word in zip(self.stems.items(), self._stems_of):
            at = of_word[whole].astype(np.int64) if len(of_word) else np.full(len(words), -1)
            for j in new:
                w = words[j]
                at[j] = known.get(w[:k], -1) if len(w) > k else -1
            out.append(at)
        return out

    def _last(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``flat`` where its term comes last in it, and the numbers of its places."""
        every = np.arange(len(flat))
        self._at[flat] = every
        return self._at[flat], every

    def present(self, text: str) -> np.ndarray:
        """The terms that ``text`` has."""
        flat = np.concatenate(self._places(list(set(_WORD.findall(text.lower())))))
        flat = flat[flat >= 0]
        last, every = self._last(flat)
        return flat[last == every]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms, how often each is in ``text``)."""
        words = Counter(_WORD.findall(text.lower()))
        times = np.fromiter(words.values(), dtype=np.int64, count=len(words))
        found = self._places(list(words))
        flat = np.concatenate(found)
        some = flat >= 0
        flat, times = flat[some], np.concatenate([times] * len(found))[some]
        last, every = self._last(flat)
        total = np.bincount(last, weights=times, minlength=len(flat))
        mine = last == every
        return flat[mine], total[mine].astype(np.int64)


def unit(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The TF-IDF vector of unit length for counts of terms that weigh ``weights``."""
    w = (1 + np.log(counts)) * weights
    size = np.sqrt((w * w).sum())
    return w / size if size > 0 else w


class BlockMaxIndex:
    """Labelled examples by term, in blocks of ``BLOCK`` with each term's largest weight.

    Examples are given flat: example k has ``terms[ptr[k]:ptr[k + 1]]`` with those
    ``weights``. ``nearest`` returns exactly the examples of the ``k`` largest
    positive cosines, equal ones by their place in the index. The ``common``
    terms of the longest lists are a dense matrix, so many texts' part of the
    cosines is one product; it enters the bounds of the blocks as it is.
    """

    def __init__(self, ids, labels, ptr, terms, weights, n_terms: int, common: int = COMMON):
        n = len(ids)
        terms, weights = np.asarray(terms, dtype=np.int32), np.asarray(weights, dtype=np.float64)
        # similar examples side by side make a block's bound tight: by their heaviest term
        heavy = np.array([terms[s + weights[s:e].argmax()] if e > s else -1 for s, e in zip(ptr[:-1], ptr[1:])], dtype=np.int64)
        order = np.lexsort((ids, heavy))
        self.ids, self.labels = np.asarray(ids)[order], np.asarray(labels, dtype=np.float64)[order]
        place = np.empty(n, dtype=np.int32)
        place[order] = np.arange(n)
        docs = np.repeat(place, np.diff(ptr))
        longest = np.argsort(-np.bincount(terms, minlength=n_terms), kind="stable")[:common]
        self.slot = np.full(n_terms, -1, dtype=np.int32)
        self.slot[longest] = np.arange(len(longest))
        self.dense = np.zeros((len(longest), n))
        slots = self.slot[terms]
        rare = slots < 0
        self.dense[slots[~rare], docs[~rare]] = weights[~rare]
        del slots
        # arrays are let go as soon as the next stands: all of a node's tasks make their index at once
        terms, docs, weights = terms[rare], docs[rare], weights[rare]
        by = np.lexsort((docs, terms))
        terms, self.docs, self.weights = terms[by], docs[by], weights[by]
        del by, docs, weights, rare
        self.starts = np.searchsorted(terms, np.arange(n_terms + 1, dtype=np.int32))
        self.blocks = -(-n // BLOCK)
        self.edges = np.arange(self.blocks) * BLOCK
        most = np.zeros(n_terms * self.blocks, dtype=np.float32)
        cell = terms.astype(np.int64)
        cell *= self.blocks
        cell += self.docs // BLOCK
        np.maximum.at(most, cell, np.nextafter(self.weights.astype(np.float32), np.float32(2)))
        self.most = most.reshape(n_terms, self.blocks)

    def common_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms give to the cosine of each of some (terms, weights) with each example."""
        q = np.zeros((len(vectors), len(self.dense)))
        for row, (terms, weights) in zip(q, vectors):
            slot = self.slot[terms]
            row[slot[slot >= 0]] = weights[slot >= 0]
        return q @ self.dense

    def nearest(self, terms, weights, k: int = NEIGHBOURS, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the nearest examples of one unit vector; ``part`` is its :meth:`common_part`."""
        places, cosines = np.empty(0, dtype=np.int64), np.empty(0)
        if not len(terms) or not self.blocks:
            return places, cosines
        if part is None:
            part = self.common_part([(terms, weights)])[0]
        rare = self.slot[terms] < 0
        terms, weights = terms[rare], weights[rare]
        bound = np.maximum.reduceat(part, self.edges) + weights.astype(np.float32) @ self.most[terms] * np.float32(1 + 1e-5)
        # no cosine is less than its common part, so the k-th largest of these is reached for certain
        sure = np.partition(part, len(part) - k)[len(part) - k] if len(part) > k else 0.0
        blocks = (bound > 0) & (bound >= sure - 1e-9)
        places, cosines = self._read(terms, weights, part, blocks)
        if len(places) > k:
            some = cosines >= np.partition(cosines, len(cosines) - k)[len(cosines) - k]
            places, cosines = places[some], cosines[some]
        keep = np.lexsort((places, -cosines))[:k]
        return places[keep], cosines[keep]

    def _read(self, terms, weights, part, blocks) -> tuple[np.ndarray, np.ndarray]:
        """The examples with positive cosines, of the blocks that are flagged."""
        first = self.starts[terms]
        size = self.starts[terms + 1] - first
        ends = np.cumsum(size)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)
        docs, mine = self.docs[flat], np.repeat(weights, size)
        if not blocks.all():
            some = blocks[docs // BLOCK]
            flat, docs, mine = flat[some], docs[some], mine[some]
        total = part + np.bincount(docs, weights=mine * self.weights[flat], minlength=len(self.ids))
        at = ((total > 0) & np.repeat(blocks, BLOCK)[: len(total)]).nonzero()[0]
        return at, total[at]


class Classifier:
    """The fitted classifier; a plain value that is sent to the workers."""

    def __init__(self, vocabulary, weights, ids, labels, ptr, terms, counts, prior):
        self.vocabulary, self.weights = vocabulary, weights
        self.ids, self.labels, self.ptr, self.terms = ids, np.asarray(labels, dtype=np.float64), ptr, terms
        self.units = np.concatenate(
            [np.empty(0), *(unit(counts[s:e], weights[terms[s:e]]) for s, e in zip(ptr[:-1], ptr[1:]))]
        )
        self.prior = prior  #: the toxic share of learning rows: the vote of a text that meets no example
        self.slope, self.offset = 1.0, 0.0

    def fitted(self) -> BlockMaxIndex:
        """The index of the examples; a task makes it and lets it go at its end, so idle workers hold none."""
        return BlockMaxIndex(self.ids, self.labels, self.ptr, self.terms, self.units, len(self.weights))

    def clear(self) -> None:
        """Let go of everything, in a worker process whose task is done with its copy."""
        self.__dict__.clear()
        trim()

    def nearest(self, index: BlockMaxIndex, counted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each text, given by (terms, counts)."""
        vectors = [(at, unit(counts, self.weights[at])) for at, counts in counted]
        for (at, weights), part in zip(vectors, index.common_part(vectors)):
            yield index.nearest(at, weights, part=part)

    def vote(self, labels: np.ndarray, cosines: np.ndarray) -> float:
        """The share of toxic among the nearest, by squared cosine, as if both labels had as many examples."""
        toxic = self.labels.sum()
        each = cosines**2 * np.where(labels > 0, (len(self.labels) - toxic) / max(1.0, toxic), 1.0)
        total = each.sum()
        return float(each @ labels / total) if total > 0 else self.prior

    def score(self, vote):
        """The calibrated probability of label 1."""
        return 1 / (1 + np.exp(-(self.slope * _logit(vote) + self.offset)))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Fit slope and offset of the votes' log odds by logistic regression, held near 1 and 0 by a weak prior."""
        x, (a, b) = _logit(votes), (1.0, 0.0)
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = p * (1 - p)
            slope = np.array([((p - labels) * x).sum() + 0.1 * (a - 1), (p - labels).sum() + 0.1 * b])
            bend = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
            step = np.linalg.solve(bend, slope)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-10:
                break
        self.slope, self.offset = float(max(a, 0.0)), float(b)


def _logit(vote):
    return np.log((vote + 0.02) / (1.02 - vote))


def term_weights(n: int, df: np.ndarray, toxic: np.ndarray, all_: np.ndarray, rows: int, toxic_rows: int) -> np.ndarray:
    """Each term's weight: inverse document frequency over ``n`` texts, times the log ratio of its toxic texts
    among the learning rows to those expected of its ``all_`` learning rows."""
    expected = all_ * (toxic_rows / max(1, rows))
    return (np.log((n + 1) / (df + 1)) + 1) * np.abs(np.log((toxic + SMOOTH) / (expected + SMOOTH)))


def _parts(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The rows of a list column as arrays."""
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return (values[s:e] for s, e in zip(ends[:-1], ends[1:]))


def held_out(id_col):
    """Whether a row's label may not be learned from: crc32 of its id's text is 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _spread(id_col, salt: int):
    """A number from 0 to 2**31 - 1 that an id's value alone fixes."""
    return F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(1 << 31))


def _first(table: DataFrame, n: int, salt: int) -> DataFrame:
    """The ``n`` rows of least :func:`_spread` of ``doc_id``; a filter leaves little more than these to be sorted."""
    rows = table.count()
    order = _spread(F.col("doc_id"), salt)
    if rows > n:
        table = table.filter(order < int((1 << 31) * min(1.0, (n + 6 * n**0.5 + 50) / rows)))
    return table.orderBy(order, "doc_id").limit(n)


def vectorised(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(doc_id, terms, counts)`` of each text: its terms as places in the vocabulary, and how often each is there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        terms = Terms(vocabulary)
        for b in slices(batches, ROWS):
            got = [terms.counts(t) for t in texts(b.column(1))]
            ptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in got])]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(ptr), pa.array(np.concatenate([g[k] for g in got]).astype(np.int32)))
                for k in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, terms array<int>, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, keep: bool = False) -> tuple[Classifier | None, DataFrame | None]:
    """The classifier learned from ``labels(doc_id, toxic)`` of ``docs(doc_id, text)``; None without any label.

    With ``keep`` also the written table of :func:`vectorised` documents.

    At most ``FIT_ROWS`` labelled rows (least hash of the id) are read. Four in
    five teach the terms' toxic shares and up to ``EXAMPLES`` of each label are
    examples; the others calibrate. Document frequencies are those of all
    documents.
    """
    small_batches(docs.sparkSession)
    taught = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
    )
    taught = written(taught, "taught")
    some = _first(taught, FIT_ROWS, 5).withColumn("calibrates", _spread(F.col("doc_id"), 6) % CALIBRATION == 0)
    some = written(some, "fit")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches, 64):
            got = [text_terms(t) for t in texts(b.column(3))]
            lists = [pa.array([list(g) for g in got], pa.list_(pa.string())), pa.array([list(g.values()) for g in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=["doc_id", "toxic", "calibrates", "terms", "counts"])

    kind = "doc_id long, toxic int, calibrates boolean, terms array<string>, counts array<long>"
    # a repeated id is one row, its least text
    rows = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic", "calibrates").agg(F.min("text").alias("text"))
    vectors = written(rows.mapInArrow(read, kind), "fit-vectors")
    teach = vectors.filter("not calibrates")
    sums = teach.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not sums.n:
        return None, None
    chosen = [
        _first(some.filter(f"toxic = {y} and not calibrates").select("doc_id"), EXAMPLES, 7).withColumn("y", F.lit(y)) for y in (0, 1)
    ]
    examples = written(
        teach.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "toxic", "terms", "counts"), "examples"
    )
    vocabulary = sorted(examples.select(F.explode("terms").alias("t")).distinct().toArrow().column("t").to_pylist())
    place = {t: i for i, t in enumerate(vocabulary)}

    def known(b: pa.RecordBatch, terms: int, counts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for t, c in zip(b.column(terms).to_pylist(), b.column(counts)):
            at = np.fromiter(map(place.get, t, repeat(-1)), dtype=np.int64, count=len(t))
            yield at[at >= 0], c.values.to_numpy()[at >= 0]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, all_ = (np.zeros(len(place), dtype=np.int64) for _ in range(2))
        for b in slices(batches, 64):
            for y, (at, _) in zip(b.column(0).to_pylist(), known(b, 1, 2)):
                all_[at] += 1
                toxic[at] += y
        at = all_.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(toxic[at]), pa.array(all_[at])], names=["t", "toxic", "n"])

    vectors_ = written(vectorised(docs, vocabulary), "vectors") if keep else None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        terms = None if keep else Terms(vocabulary)
        for b in slices(batches):
            if keep:
                df += np.bincount(b.column(0).flatten().to_numpy(), minlength=len(df))
                continue
            for t in texts(b.column(0)):
                df[terms.present(t)] += 1
        at = df.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["t", "n"])
        del terms, df
        trim()

    size = len(vocabulary)  # bounded by the examples, and so is what comes to the driver here
    sums_of = {c: np.zeros(size) for c in ("toxic", "n", "df")}
    got = teach.select("toxic", "terms", "counts").mapInArrow(shares, "t long, toxic long, n long").groupBy("t").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n")
    ).toPandas()
    for c in ("toxic", "n"):
        sums_of[c][got["t"].to_numpy(dtype=np.int64)] = got[c]
    got = (vectors_.select("terms") if keep else docs.select("text")).mapInArrow(frequencies, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    sums_of["df"][got["t"].to_numpy(dtype=np.int64)] = got["n"]
    weights = term_weights(docs.count(), sums_of["df"], sums_of["toxic"], sums_of["n"], sums.n, sums.toxic)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            terms = pa.array([at for at, _ in known(b, 2, 3)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], terms, b.column(3)], names=["doc_id", "toxic", "terms", "counts"])

    flat = examples.mapInArrow(numbered, "doc_id long, toxic int, terms array<int>, counts array<long>").toArrow()
    flat = flat.sort_by("doc_id").combine_chunks()
    lists = flat.column("terms").combine_chunks()
    made = Classifier(
        vocabulary, weights, flat.column("doc_id").to_numpy(), flat.column("toxic").to_numpy(),
        np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64),
        lists.flatten().to_numpy().astype(np.int64), flat.column("counts").combine_chunks().flatten().to_numpy(), sums.toxic / sums.n,
    )

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = made.fitted()
        for b in slices(batches, 64):
            out = []
            for places, cosines in made.nearest(index, known(b, 1, 2)):
                out.append(made.vote(index.labels[places], cosines))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["toxic", "vote"])

    calibration = vectors.filter("calibrates").select("toxic", "terms", "counts").mapInArrow(votes, "toxic int, vote double").toPandas()
    made.calibrate(calibration["vote"].to_numpy(dtype=float), calibration["toxic"].to_numpy(dtype=float))
    forget(taught, some, vectors, examples)
    trim()
    return made, vectors_


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, examples)`` of every whole text.

    ``docs(doc_id, text)``; ``labels(doc_id, toxic)`` teach only where
    :func:`held_out` is false (:func:`fit`). ``score`` is the calibrated vote of
    the ``NEIGHBOURS`` nearest examples; a text that meets none (null and empty
    ones too) has that of the toxic share of learning rows. ``predicted`` is 1
    from ``THRESHOLD`` on; ``examples`` are the ids that voted, nearest first.

    If a document has several labels, the largest counts; null labels do not.
    Null ids are scored and never learned from. Repeated rows are scored
    alike. Bytes that are no UTF-8 count as U+FFFD. An empty table gives none;
    without labels every score is 0.
    """
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made, vectors = fit(two, labels, keep=True)
    flags = held_out(F.col("doc_id")).alias("held_out")
    if made is None:
        none = F.array().cast("array<bigint>").alias("examples")
        return two.select("doc_id", flags, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), none)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        made.vocabulary = None  # this task's copy needs the places alone
        index = made.fitted()
        made.terms = made.units = None
        trim()
        for b in slices(batches, ROWS):
            scores, examples = [], []
            for places, cosines in made.nearest(index, zip(_parts(b.column(1)), _parts(b.column(2)))):
                scores.append(made.score(made.vote(index.labels[places], cosines)))
                examples.append(index.ids[places])
            ptr = np.concatenate([[0], np.cumsum([len(e) for e in examples])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ptr), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *examples])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), lists], names=["doc_id", "score", "examples"])
        del index
        made.clear()

    out = vectors.mapInArrow(score, "doc_id long, score double, examples array<long>")
    return out.select("doc_id", flags, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "examples")


def drop_toxic_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, every column as it is, without the rows whose text the classifier of :func:`fit` predicts toxic.

    Each row is judged by its own text alone, in one narrow stage: null and
    repeated ids and columns of any name are carried along. Edges as in
    :func:`toxicity_scores`; without labels every row stays.
    """
    text_at = docs.columns.index(column_name(docs, "text"))
    made, _ = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    if made is None:
        return docs

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        terms = Terms(made.vocabulary)
        made.vocabulary = None  # this task's copy has made its tools of it
        index = made.fitted()
        made.terms = made.units = None
        trim()
        for b in slices(batches, ROWS):
            keep = []
            for places, cosines in made.nearest(index, map(terms.counts, texts(b.column(text_at)))):
                keep.append(made.score(made.vote(index.labels[places], cosines)) < THRESHOLD)
            yield b.filter(pa.array(keep, pa.bool_()))
        del index, terms
        made.clear()

    return docs.mapInArrow(judge, docs.schema)
