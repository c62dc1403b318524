"""Verbatim repeats as relations: equal shingles joined, diagonals as islands, copies chosen from left to right.

Two places of one shingle lie on a diagonal, their distance. A repeat is a
stretch of consecutive places on one diagonal, so all repeats of all texts are
gaps and islands over one equality join. Which of them are reported depends on
the order of reading: a copy that is reported is skipped over, and what is
skipped begins no later match. That choice needs only the islands, a few rows of
numbers a text, never the texts.

A reader tries a fixed number of earlier places of a shingle. Where a shingle
has more, the walk is capped and its outcome hangs on every step of it; those
groups are told apart (``capped``) and left to the kernel. A text's whole repeats
have no such number: there these texts are walked by the places of their
repeated shingles, all of them tried, without a pair of them being made.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.catalog import Rule, load_rules
from quillspark.functions.chars import JVM_ALNUM
from quillspark.functions.duplication import TRIED, find_runs, tokenize, whole_runs
from quillspark.operators import rows
from quillspark.operators.components import components, cut_lineage

_WORD = f"(?:{JVM_ALNUM}|['\\x{{2019}}])"
FILE_BITS = 32  #: a word's place is its file's number, these bits up, and its number there


def repeat_rule() -> Rule:
    """The catalog's rule of verbatim repeats."""
    return next(r for r in load_rules() if r.mechanism == "self-duplication")


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and apostrophes, in order."""
    found = lambda t: F.regexp_extract_all(t, F.lit(_WORD + "+"), F.lit(0))
    # other letters are lowered one by one: a sigma at a word's end as anywhere
    other = F.transform(found(text), lambda w: F.lower(F.translate(w, "’Σ", "'σ")))
    return F.when(F.octet_length(text) == F.length(text), found(rows.ascii_lower(text))).otherwise(other)


def _hashes(text: Column, k: int) -> Column:
    """The hash of each shingle of a text; null where it has fewer words."""
    made = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))
    return rows.let(words(text), lambda w: F.when(F.size(w) >= k, made(w)))


def _shingles(files: DataFrame, k: int) -> DataFrame:
    """``(g, c, h)``: the place and hash of each shingle."""
    each = files.select("g", "f", _hashes(F.col("text"), k).alias("hs"))
    return each.select("g", "f", F.posexplode("hs").alias("i", "h")).select(
        "g", (F.shiftleft(F.col("f").cast("long"), FILE_BITS) + F.col("i")).alias("c"), "h"
    )


def repeating(files: DataFrame, k: int) -> DataFrame:
    """The rows of ``files`` whose text repeats a shingle itself, with ``again``, its repeated shingles ``array<struct<h,c>>``; written.

    A shingle that stands once in its text meets nothing, so it never leaves its row.
    """

    def again(sorted_: Column) -> Column:
        beside = lambda x, j: F.get(sorted_, j)["h"].eqNullSafe(x["h"])
        return F.filter(sorted_, lambda x, j: beside(x, j - 1) | beside(x, j + 1))

    # the hashes are exploded out of an array, so that the filter reads them and does not make them anew
    made = files.select("*", F.explode(F.array(_hashes(F.col("text"), k))).alias("hs")).filter(F.size(F.array_distinct("hs")) < F.size("hs"))
    places = F.array_sort(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("c"))))
    return cut_lineage(made.select(*files.columns, rows.let(places, again).alias("again")))


def _file(c: str) -> Column:
    return F.shiftright(F.col(c), FILE_BITS)


def islands(files: DataFrame, k: int, floor: int, across: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(g, early, late, n, reach)`` of the repeats of ``files(g, f, text)``, the capped ``(g)``, and ``(g, a, b)`` of files that share a shingle.

    ``early`` and ``late`` are places, ``n`` the words in common, ``reach`` those
    that a report has: copies within one file do not overlap, so it is at most
    their distance. With ``across`` only copies in different files count, else
    only those of one file (and a group is one file; what :func:`repeating` gives is taken as it is).
    """
    if across:
        places = _shingles(files, k)
    else:  # equal texts are one group, read once
        some = files if "again" in files.columns else repeating(files, k)
        places = some.select("g", "again").dropDuplicates(["g"]).select("g", F.explode("again").alias("x")).select("g", "x.c", "x.h")
    counts = places.groupBy("g", "h").agg(F.count("*").alias("times"), F.min(_file("c")).alias("least"), F.max(_file("c")).alias("most"))
    counts = counts.filter("times > 1 and least < most" if across else "times > 1")
    capped = counts.filter(F.col("times") > TRIED + 1).select("g").distinct()
    some = counts.join(capped, "g", "left_anti") if not across else counts
    met = places.join(some.select("g", "h", "least"), ["g", "h"])
    edges = met.select("g", F.col("least").alias("a"), _file("c").alias("b")).filter("a < b").distinct()
    if across:
        met = met.join(capped, "g", "left_anti")
    a, b = met.select("g", "h", F.col("c").alias("early")), met.select("g", "h", F.col("c").alias("late"))
    apart = _file("early") < _file("late") if across else F.col("early") + k <= F.col("late")
    pairs = a.join(b, ["g", "h"]).filter(apart).select("g", (F.col("late") - F.col("early")).alias("d"), "early")
    w = Window.partitionBy("g", "d").orderBy("early")
    runs = pairs.withColumn("island", F.col("early") - F.row_number().over(w)).groupBy("g", "d", "island").agg(
        F.min("early").alias("early"), (F.count("*") + (k - 1)).alias("n")
    )
    reach = F.col("n") if across else F.least("n", "d")
    found = runs.select("g", "early", (F.col("early") + F.col("d")).alias("late"), "n", reach.alias("reach")).filter(F.col("reach") >= floor)
    return found, capped, edges


def chosen(candidates: list[tuple[int, int, int, int]], k: int, across: bool) -> list[tuple[int, int, int]]:
    """``(early, late, words)`` of what a reader reports of the islands ``(early, late, n, reach)`` of one group.

    At each place the longest repeat that it lies in is reported, of equal ones
    that with the earliest copy, provided that the earlier place was read and
    not skipped; then reading goes on after the later copy.
    """
    heap: list[tuple[int, int, int, int]] = []
    starts: list[int] = []  # what was skipped lies strictly between a start and its end
    ends: list[int] = []
    now = 0

    def queue(x: int, place: int) -> None:
        """Put an island where it can first be met from a place on."""
        early, late, n, reach = candidates[x]
        d = late - early
        e = max(late, place) - d
        at = bisect_left(starts, e) - 1
        if at >= 0 and e < ends[at]:
            e = ends[at]
        if e <= early + n - k:
            heapq.heappush(heap, (e + d, -reach, -d, x))

    out = []
    for x in range(len(candidates)):
        queue(x, 0)
    while heap:
        place, _, _, x = heapq.heappop(heap)
        early, late, n, reach = candidates[x]
        d = late - early
        at = bisect_left(starts, place - d) - 1
        if place < now or (at >= 0 and place - d < ends[at]):
            queue(x, max(now, place))
            continue
        t = place - late
        ahead = n - t if across else min(n - t, d)
        back = t if across else 0 if ahead == d else min(t, d - ahead)
        out.append((place - back - d, place - back, ahead + back))
        now = place - back + ahead + back
        starts.append(place)
        ends.append(now)
        queue(x, now)
    return out


_FOUND = "early long, late long, n long"


def _reported(found: DataFrame, keys: list[str], k: int, across: bool) -> DataFrame:
    """``(*keys, early, late, n)``: what is reported of the islands of each group."""
    lists = found.groupBy(*keys).agg(F.collect_list(F.struct("early", "late", "n", "reach")).alias("xs"))
    n = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for row, xs in enumerate(b.column(n).to_pylist()):
                for got in chosen([(x["early"], x["late"], x["n"], x["reach"]) for x in xs], k, across):
                    at.append(row)
                    out.append(got)
            columns = [b.column(c).take(pa.array(at, pa.int64())) for c in range(n)]
            made = [pa.array([o[c] for o in out], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*keys, "early", "late", "n"])

    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keys)
    return lists.mapInArrow(work, f"{kinds}, {_FOUND}")


def _crowded(again: str) -> Column:
    """Whether a shingle of :func:`repeating`'s sorted ``again`` has more places than a capped walk tries."""
    shingle = lambda j: F.get(F.col(again), j)["h"]
    return F.exists(F.sequence(F.lit(0), F.greatest(F.size(again) - (TRIED + 2), F.lit(0))), lambda j: shingle(j).eqNullSafe(shingle(j + (TRIED + 1))))


def _whole(texts: DataFrame, k: int, floor: int) -> DataFrame:
    """``(g, early, late, n)`` of texts ``(g, again)`` of :func:`repeating`, however many places a shingle has; a text at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, lists = b.column(0), b.column(1)
            for row in range(len(lists)):
                shingles, places = (x.to_numpy(zero_copy_only=False) for x in lists[row].values.flatten())
                runs = whole_runs(places, shingles, k, floor)
                made = [pa.array([r[c] for r in runs], pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([g.take(pa.array([row] * len(runs), pa.int64())), *made], names=["g", "early", "late", "n"])

    return texts.select("g", "again").mapInArrow(work, f"g {texts.schema['g'].dataType.simpleString()}, {_FOUND}")


def word_spans(text: Column, runs: Column) -> Column:
    """``array<struct<s,e>>`` of runs ``array<struct<first,n>>`` of a text's words, in bytes."""
    pieces = F.regexp_extract_all(text, F.lit(f"{_WORD}+|(?:(?!{_WORD})[\\s\\S])+"), F.lit(0))

    def placed(p: Column) -> Column:
        lead = F.when(F.get(p, F.lit(0)).rlike(f"^{_WORD}"), 0).otherwise(1)

        def span(sums: Column, r: Column) -> Column:
            first = (2 * r["first"] + lead).cast("int")
            return F.struct(F.get(sums, first).alias("s"), F.get(sums, (first + 2 * r["n"] - 1).cast("int")).alias("e"))

        sums = rows.prefix_sums(F.transform(p, lambda x: F.octet_length(x).cast("long")))
        return rows.let(sums, lambda s: F.transform(runs, lambda r: span(s, r)))

    return rows.let(pieces, placed)


def _group(text: Column) -> Column:
    """What tells texts apart: rows of one text have the same repeats."""
    return F.md5(F.encode(text, "utf-8"))


def repeating_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, g, f, again)`` of the rows whose text repeats a shingle, for :func:`self_repeats` and :func:`capped_texts`."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return repeating(base.withColumn("g", _group(F.col("text"))).withColumn("f", F.lit(0)), repeat_rule().shingle_words)


def self_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None, whole: bool = False
) -> DataFrame:
    """``(doc_id, capped, early, late, n, s, e, snippet, snippet_truncated, container)``: each text's repeats, the longest of them.

    ``early`` and ``late`` are word numbers, ``s`` and ``e`` the later copy's
    bytes. A text whose walk is capped has one row, with ``capped`` and nulls; with
    ``whole`` no walk is, all earlier places of a shingle count and each text has its repeats.
    Null texts have none; repeated rows and rows that share an id each have
    their text's. ``texts`` are the documents' :func:`repeating_texts`, if they are there already.
    """
    rule = repeat_rule()
    base = repeating_texts(docs, id_col, text_col) if texts is None else texts
    found, capped, _ = islands(base.filter(~_crowded("again")) if whole else base, rule.shingle_words, rule.min_run_words, False)
    runs = _reported(found, ["g"], rule.shingle_words, False)
    if whole:
        rest = base.filter(_crowded("again")).select("g", "again").dropDuplicates(["g"])
        runs = runs.unionByName(_whole(rest, rule.shingle_words, rule.min_run_words))
    base = base.drop("again", "f")
    order = F.struct((-F.col("n")).alias("z"), "late", "early")
    kept = runs.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(order)), 1, rule.max_reports).alias("xs"))
    both = base.join(kept, "g")
    ranges = word_spans(F.col("text"), F.transform("xs", lambda x: F.struct(x["late"].alias("first"), (-x["z"]).alias("n"))))
    both = both.select("doc_id", "text", "xs", ranges.alias("ranges")).withColumn("found", rows.containers(F.col("text")))
    each = both.select("doc_id", "text", "found", F.explode(F.arrays_zip("xs", "ranges")).alias("x"))
    s, e = F.col("x.ranges.s"), F.col("x.ranges.e")
    found = each.select(
        "doc_id", F.lit(False).alias("capped"), F.col("x.xs.early").alias("early"), F.col("x.xs.late").alias("late"), (-F.col("x.xs.z")).alias("n"),
        s.alias("s"), e.alias("e"), rows.snippet(F.col("text"), s, e).alias("snippet"), (e - s > rows.SNIPPET_BYTES).alias("snippet_truncated"),
        rows.container_at(F.col("found"), s).alias("container"),
    )
    if whole:
        return found
    none = base.join(capped, "g", "left_semi").select("doc_id", F.lit(True).alias("capped"))
    return found.unionByName(none, allowMissingColumns=True)


def capped_texts(texts: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of those of :func:`repeating_texts` whose walk is capped."""
    rule = repeat_rule()
    _, capped, _ = islands(texts, rule.shingle_words, rule.min_run_words, False)
    return texts.join(capped, "g", "left_semi").select("doc_id", "text")


def _walked(files: DataFrame, k: int, floor: int) -> DataFrame:
    """``(g, early, late, n)`` of files ``(g, component, f, text)`` by the kernel's walk, a component at a time."""
    kind = files.schema["g"].dataType.simpleString()

    def walk(table):
        table = table.sort_by("f")
        numbers, texts = table.column("f").to_pylist(), table.column("text").to_pylist()
        tokens, places = [], []
        for f, text in zip(numbers, texts):
            mine = tokenize(text, f)
            tokens += mine
            places += range(f << FILE_BITS, (f << FILE_BITS) + len(mine))
        runs = find_runs(tokens, k, floor, across=True)
        columns = ([places[r.earlier] for r in runs], [places[r.later] for r in runs], [r.length for r in runs])
        g = table.column("g").slice(0, 1).combine_chunks().take(pa.array([0] * len(runs), pa.int64()))
        return pa.table([g, *(pa.array(c, pa.int64()) for c in columns)], names=["g", "early", "late", "n"])

    return files.groupBy("g", "component").applyInArrow(walk, f"g {kind}, {_FOUND}")


def shared_runs(files: DataFrame) -> DataFrame:
    """``(g, early, late, n)`` of what files of one group share; ``files(g, f, text)``, ``f`` the file's number from 0.

    A component of files is one group of islands: files without a common shingle
    never meet. The files of groups with a capped walk come together by
    component, the others not at all.
    """
    rule = repeat_rule()
    k, floor = rule.shingle_words, rule.min_run_words
    found, capped, edges = islands(files, k, floor, True)
    of = components(edges).select(F.col("g").alias("_g"), F.col("node").alias("_f"), "component")
    mine = found.join(of, (F.col("g") == F.col("_g")) & (_file("early") == F.col("_f"))).select("g", "component", "early", "late", "n", "reach")
    runs = _reported(mine, ["g", "component"], k, True).drop("component")
    walked = files.join(capped, "g", "left_semi").join(of, (F.col("g") == F.col("_g")) & (F.col("f") == F.col("_f"))).drop("_g", "_f")
    return runs.unionByName(_walked(walked, k, floor))


def shared_passages(files: DataFrame) -> DataFrame:
    """``(g, entry, snippet, snippet_truncated, occurrences)``: the longest passages that files of a group share.

    ``files(g, f, path, text)``. An entry is a copy and its later ones, in
    order of reading; of each group the rule's number of longest entries is kept
    and they are numbered by their first copy's path and place.
    """
    most = repeat_rule().max_reports
    runs = shared_runs(files.select("g", "f", "text"))
    entries = runs.groupBy("g", "early", "n").agg(F.array_sort(F.collect_list("late")).alias("lates"))
    w = Window.partitionBy("g").orderBy(F.desc("n"), "early")
    entries = entries.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")
    each = entries.select("g", "early", "n", F.posexplode(F.concat(F.array("early"), F.col("lates"))).alias("o", "c"))
    at = F.struct("early", "n", "o", F.col("c").bitwiseAND((1 << FILE_BITS) - 1).alias("first"))
    of_file = each.groupBy("g", _file("c").alias("f")).agg(F.collect_list(at).alias("xs"))
    both = files.join(of_file, ["g", "f"])
    both = both.select("g", "path", "text", "xs", word_spans(F.col("text"), F.col("xs")).alias("ranges")).withColumn("found", rows.containers(F.col("text")))
    placed = both.select("g", "path", "text", "found", F.explode(F.arrays_zip("xs", "ranges")).alias("x"))
    s, e = F.col("x.ranges.s"), F.col("x.ranges.e")
    first = F.col("x.xs.o") == 0
    placed = placed.select(
        "g", F.col("x.xs.early").alias("early"), F.col("x.xs.n").alias("n"),
        F.struct(
            F.col("x.xs.o").alias("o"), F.coalesce("path", F.lit("")).alias("path"), F.struct(s.alias("start"), e.alias("end")).alias("span"),
            rows.container_at(F.col("found"), s).alias("container"),
        ).alias("place"),
        F.when(first, rows.snippet(F.col("text"), s, e)).alias("snippet"), F.when(first, e - s > rows.SNIPPET_BYTES).alias("cut"),
    )
    whole = placed.groupBy("g", "early", "n").agg(
        F.array_sort(F.collect_list("place")).alias("places"), F.max("snippet").alias("snippet"), F.max("cut").alias("snippet_truncated")
    )
    lead = F.col("places")[0]
    order = Window.partitionBy("g").orderBy(F.encode(lead["path"], "utf-8"), lead["span"]["start"], lead["span"]["end"], F.desc("n"), "early")
    occurrences = F.transform("places", lambda p: F.struct(p["path"], p["span"], p["container"]))
    return whole.withColumn("entry", F.row_number().over(order)).select("g", "entry", "snippet", "snippet_truncated", occurrences.alias("occurrences"))
