"""Connected components of files, by spreading the least label and jumping over labels."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of ``spark.checkpoint.dir``; a session of one process may lack the setting, a cluster not."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """``(g, node, component)`` for every end of ``edges(g, a, b)``: the least node of its group that it is connected to.

    A round hands each node the least label of its neighbours and then that
    label's own label, so rounds grow with the logarithm of a chain's length.
    """
    both = cut_lineage(edges.select("g", "a", "b").union(edges.select("g", "b", "a")).distinct())
    labels = cut_lineage(both.groupBy("g", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select("g", F.col("node").alias("b"), F.col("component").alias("theirs")), ["g", "b"])
        least = near.groupBy("g", F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        after = labels.join(least, ["g", "node"]).select("g", "node", "component", F.least("component", "theirs").alias("new"))
        jump = after.select("g", F.col("node").alias("new"), F.col("new").alias("far"))
        after = after.join(jump, ["g", "new"]).select("g", "node", "component", F.least("new", "far").alias("new"))
        after = cut_lineage(after)
        if after.filter("new <> component").isEmpty():
            return labels
        labels = after.select("g", "node", F.col("new").alias("component"))
