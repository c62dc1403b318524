"""The exact report as an Arrow kernel: one narrow stage, keyed by document, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import scan as kernel
from quillspark.operators.repeats import capped_texts, repeat_rule, repeating_texts, self_repeats, shared_passages
from quillspark.operators.schemas import FLAT, HIT, REPORT


ROWS = 256  #: texts and reports that are Python objects at once
TASKS_A_CORE = 4  #: a table of fewer splits than so many for each core is dealt anew


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt row by row over some tasks for each core, where its files split into fewer.

    Splits say little of the work: a file's row groups may all begin in one of
    them, and one long task is what the others then wait for. The kernel costs
    far more than moving a table. A stream, and what comes from a shuffle, is
    left as it is; so is a table of many splits.
    """
    if docs.isStreaming or "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        return docs
    tasks = TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(tasks, F.monotonically_increasing_id()) if docs._jdf.rdd().getNumPartitions() < tasks else docs


def _mapped(docs: DataFrame, text_col: str, name: str, kind: T.DataType, of) -> DataFrame:
    """``docs`` with a column ``name`` that ``of(text)`` gives; all else passes through unread."""
    rest = [c for c in docs.columns if c != name]
    where = rest.index(text_col)
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(name, kind)])
    arrow = to_arrow_type(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            made = pa.array([of(t or "") for t in b.column(where).to_pylist()], type=arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*rest, name])

    return spread(docs.select(*rest)).mapInArrow(work, schema)


def _span(r: dict) -> dict:
    for c in ("paste_residue", "quality_patterns", "injection_patterns"):
        for f in r[c]:
            f["span"] = {"start": f["span"][0], "end": f["span"][1]}
    return r


def analyze(docs: DataFrame, text_col: str = "text", allow_terms: Iterable[str] = (), report_col: str = "report") -> DataFrame:
    """``docs`` with each text's whole evidence report as a nested column.

    A null text is an empty one. A text without findings has a report too. Rows
    are independent, so this works on a stream as it does on a table.
    """
    allow = tuple(allow_terms)
    return _mapped(docs, text_col, report_col, REPORT, lambda t: _span(kernel.report(t, allow)))


def findings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow_terms: Iterable[str] = (), rules: Iterable[str] | None = None
) -> DataFrame:
    """One row a finding: ``doc_id`` and the finding's fields, byte spans as two columns; of ``rules`` alone, if given."""
    allow, some = tuple(allow_terms), None if rules is None else tuple(sorted(rules))
    names = FLAT.fieldNames()

    def of(text: str) -> list[dict]:
        return [dict(zip(names, f)) for f in kernel.find(text, allow, None if some is None else kernel.scanner_of(some))]

    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = _mapped(two, "text", "f", T.ArrayType(FLAT), of)
    return made.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.*")


def duplication_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`findings` of the rule of verbatim repeats: by relations, and by the kernel for the texts with a capped walk."""
    rule = repeat_rule()
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = repeating_texts(spread(two))
    found = self_repeats(two, texts=texts).filter("not capped").select(
        "doc_id", F.lit(rule.category).alias("category"), F.lit(rule.id).alias("rule_id"), F.lit(rule.cls).alias("class"),
        F.col("s").alias("span_start"), F.col("e").alias("span_end"), "snippet", "snippet_truncated", "container", F.lit(False).alias("topic_term"),
    )
    return found.unionByName(findings(capped_texts(texts), rules=[rule.id]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Iterable[str] | None = None) -> DataFrame:
    """``(doc_id, rule_id, s, e)``: the raw hits after merging, byte spans, without annotation; of ``rules`` alone, if given."""
    some = None if rules is None else tuple(sorted(rules))

    def of(text: str) -> list[dict]:
        s, at = kernel.scanner() if some is None else kernel.scanner_of(some), kernel.Bytes(text)
        return [{"rule_id": s.rules[h.rule].id, "s": at(h.start), "e": at(h.end)} for h in s.scan(text)]

    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _mapped(two, "text", "h", T.ArrayType(HIT), of).select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.*")


def report_json(reports: DataFrame, report_col: str = "report") -> DataFrame:
    """``reports`` with the report as compact JSON text, spans as two-element arrays, nulls written."""

    def span(field):
        return F.transform(
            field,
            lambda f: F.struct(
                f["rule_id"].alias("rule_id"), F.array(f["span"]["start"], f["span"]["end"]).alias("span"),
                f["snippet"].alias("snippet"), f["snippet_truncated"].alias("snippet_truncated"),
                f["container"].alias("container"), f["topic_term"].alias("topic_term"),
            ),
        )

    r = F.col(report_col)
    parts = [span(r[c]).alias(c) for c in ("paste_residue", "quality_patterns", "injection_patterns")]
    return reports.withColumn(
        report_col, F.to_json(F.struct(*parts, r["stats"].alias("stats")), {"ignoreNullFields": "false"})
    )


def analyze_bundle(
    files: DataFrame,
    bundle_col: str = "bundle_id",
    order_col: str = "file_idx",
    path_col: str = "path",
    text_col: str = "text",
    allow_terms: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Two tables: each file's report, and each bundle's shared passages with their entry numbers.

    Files are rows, so their reports need no shuffle; passages are found by
    relations over word shingles (:mod:`quillspark.operators.repeats`), a bundle
    in many tasks. ``order_col`` tells the files of a bundle apart and orders
    them, paths may repeat: integers from 0 to ``2**31 - 1`` are taken as they
    are, all else is numbered. A null bundle shares nothing.
    """
    reports = analyze(files, text_col, allow_terms)
    number = F.col(order_col)
    if not isinstance(files.schema[order_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        number = F.row_number().over(Window.partitionBy(bundle_col).orderBy(order_col)) - 1
    narrow = files.select(
        F.col(bundle_col).alias("g"), number.cast("long").alias("f"), F.col(path_col).cast("string").alias("path"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return reports, shared_passages(narrow.filter("g is not null")).withColumnRenamed("g", "bundle_id")


def shingles(files: DataFrame, k: int) -> DataFrame:
    """``(bundle_id, file_idx, h)``: the distinct shingle hashes of each file, in the JVM."""
    words = F.transform(
        F.regexp_extract_all("text", F.lit(r"[\p{IsAlphabetic}\p{N}'\x{2019}]+"), F.lit(0)),
        # words that the kernel takes as equal must be equal here too: one sigma
        lambda w: F.translate(F.lower(w), "’ς", "'σ"),
    )
    base = files.select("bundle_id", "file_idx", words.alias("w")).filter(F.size("w") >= k)
    hashes = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))
    )
    return base.select("bundle_id", "file_idx", F.explode(hashes).alias("h"))


def shared_shingle_pairs(files: DataFrame, k: int = 8) -> DataFrame:
    """``(bundle_id, a, b, n)``: files of a bundle with ``n`` shingles in common, ``a < b``; the relational form."""
    h = shingles(files, k)
    a, b = h.toDF("bundle_id", "a", "h"), h.toDF("bundle_id", "b", "h")
    return a.join(b, ["bundle_id", "h"]).filter("a < b").groupBy("bundle_id", "a", "b").agg(F.count("*").alias("n"))
