"""What the operators share: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.memo import trim


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset, a session
    of one process, as in tests, gets a temporary folder; on a cluster executors
    would not see that, so it is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there.

    A lost executor then costs a reread, never a recomputation of ``df``. The
    tables go when the driver ends or :func:`drop_written` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` has made and that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path and (df.sparkSession, path) in _written:
            _written.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def written_paths(spark: SparkSession) -> list[str]:
    """The paths of this session's written tables that are there."""
    return [path for of, path in _written if of is spark]


def forget_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written tables by their paths; those that are gone already are no matter."""
    for path in paths:
        if (spark, path) in _written:
            _written.remove((spark, path))
            _delete(spark, path)


@contextmanager
def forgetting(spark: SparkSession) -> Iterator[list]:
    """Delete the tables written meanwhile, but for those appended to the list: what a step leaves is its result."""
    before = set(written_paths(spark))
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        stay = before | {getattr(t, "_written_at", None) for t in kept}
        forget_paths(spark, [path for path in written_paths(spark) if path not in stay])


def drop_written() -> None:
    """Delete the tables that :func:`written` has made so far in this process."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session is gone, and its cleaner with it
            return


atexit.register(drop_written)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Have each query that runs meanwhile delete its shuffle files as it ends; nothing here reads them again.

    Else they stay until the driver happens to collect its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim_driver(spark: SparkSession) -> bool:
    """Have the driver give back what it does not use, in Python, the JVM's heap and its C library; whether all did.

    Every query leaves plans and broadcasts, which go only when the JVM collects
    its old garbage, and compiled code, whose scratch memory the C library
    keeps. A run of some hundred queries else grows by it. A JVM that cannot
    trim its C library's memory goes without that.
    """
    trim()
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by the interface, as the server's own class is closed to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = array(jvm.Object, 4)
        given[0], given[1] = name, "systemTrimNativeHeap"
        invoke.invoke(beans, given)
    except Py4JError:  # another JVM or C library
        return False
    return True


def trim_executors(spark: SparkSession) -> int:
    """Have the executors give back the heap that they do not use; how many tasks asked for it.

    A heap that sorts and joins have filled stays with its executor, beside the
    Python workers that the next step needs. One short task for each core
    reaches every executor that is idle; none is waited for otherwise. Where
    the driver is the executor, :func:`trim_driver` does it.
    """
    sc = spark.sparkContext
    if re.fullmatch(r"local(\[.*\])?", sc.master):
        return 0
    tasks = sc.defaultParallelism
    asked = spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("said"))
    return len(asked.collect())


BATCH_ROWS = 1_024  #: rows of texts that JVM and worker hold at once


def small_batches(spark: SparkSession) -> None:
    """Have the session hand rows to Python in batches of at most ``BATCH_ROWS``; results do not depend on it.

    Texts of some kilobytes make the default of 10,000 rows tens of megabytes,
    held several times in the JVM and the worker of every task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def broadcast_if_small(df: DataFrame, max_rows: int, size=None, max_bytes: int = 16_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``max_rows``.

    Rows whose size varies need ``size``, a column of each row's bytes, of which
    there may be ``max_bytes`` in all. Beyond that no hint is given and the join
    shuffles, where adaptive execution splits skewed keys. ``df`` should be a
    written table, so that counting is cheap.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    if size is not None and (df.agg(F.sum(size)).first()[0] or 0) > max_bytes:
        return df
    return F.broadcast(df)


def column_name(df: DataFrame, name: str) -> str:
    """The name that a column has in ``df``, which Spark finds whatever its case; an exact match comes first."""
    return name if name in df.columns else next(c for c in df.columns if c.lower() == name.lower())
