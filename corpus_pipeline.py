"""A corpus pipeline over documents: each stage is one of the operators.

Toxic documents go, boilerplate lines go, one document of each near-duplicate
group stays, and what is left is packed into training sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from weakref import WeakKeyDictionary

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, forget, forget_paths, forgetting, trim_executors, written, written_paths
from quillspark.llm.jaccard import near_duplicate_rows, text_hashes
from quillspark.llm.line_dedup import drop_boilerplate
from quillspark.llm.packing import pack_documents
from quillspark.llm.toxicity import drop_toxic_rows

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What the latest stage has written for its result, by session: the next stage reads that result, written, so it goes.
_left: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()

#: Rows that may be broadcast: a million of three longs are 24 MB.
MAX_ROWS = 1_000_000


def _stage(work: Stage) -> Stage:
    """A stage that begins by deleting what the one before has left, in the shared folder but for its own input, and in the executors."""

    @wraps(work)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.pop(spark, [])
        read = {part for file in docs.inputFiles() for part in file.split("/")} if left else set()
        forget_paths(spark, [path for path in left if path.rsplit("/", 1)[-1] not in read])
        trim_executors(spark)
        before = set(written_paths(spark))
        out = work(spark, docs, sf_dir)
        _left[spark] = [path for path in written_paths(spark) if path not in before]
        return out

    return begun


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity operator predicts toxic go, each judged by its own text."""
    return drop_toxic_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; ``n_chars`` counts what is left.

    A table that has columns named like the operator's counts (``n_lines``,
    ``n_dropped``) gets the counts in them.
    """
    out = drop_boilerplate(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long"))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row with the smallest id stays (then the smallest hash of the text), once.

    Near are texts whose five-word shingles have a Jaccard similarity of at
    least 0.8, found by the SimHash operator and completed exactly; op3's three
    words and three bits are that query's alone. A row is known by its id and
    two hashes of its text, so rows that share an id or have none are judged
    each for itself; a null id counts as the largest. Of rows that are equal in
    all three any one stays.
    """
    key = ("doc_id", "a", "b")
    rows = near_duplicate_rows(docs)
    counted = written(rows.groupBy("class", *key).agg(F.count("*").alias("n")), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    least = counted.groupBy(F.col("class").alias("of")).agg(F.min(order).alias("least"))
    judged = counted.join(least, F.col("class") == F.col("of")).withColumn("goes", order != F.col("least"))
    judged = written(judged.filter("goes or n > 1").select(*(F.col(k).alias(f"_{k}") for k in key), "goes"), "judged")

    def same(table: DataFrame) -> Column:
        return F.col("doc_id").eqNullSafe(table["_doc_id"]) & (F.col("a") == table["_a"]) & (F.col("b") == table["_b"])

    # the row travels as one column, so no name of it can clash
    text = F.col("text").cast("string")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hashes(text), F.struct("*").alias("row"))
    gone, twice = judged.filter("goes"), judged.filter("not goes")
    kept = whole.join(broadcast_if_small(gone, MAX_ROWS), same(gone), "left_anti")
    if twice.isEmpty():
        return kept.select("row.*")
    few = broadcast_if_small(twice, MAX_ROWS)
    once = kept.join(few, same(twice), "left_semi").dropDuplicates(list(key))
    return kept.join(few, same(twice), "left_anti").unionByName(once).select("row.*")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier's vote nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``, each one's result written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with forgetting(spark) as kept:
            after = written(stage(spark, docs, sf_dir), name)
            kept.append(after)
        forget(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
