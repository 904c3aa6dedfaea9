"""Written tables that cut lineage, kept in the folder the cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and Spark is one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        # a core setting, which a running session refuses to change: the context holds the folder instead
        context = spark.sparkContext
        if not context.getCheckpointDir():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


#: Texts can be long, so Arrow batches are bound by bytes: a task holds several copies of a batch on either side.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_BYTES unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def _dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes an execution's shuffle files at its end. A write's plan is its own, so nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet, with the writer's options, to the shared folder and read it back: later stages and retries start there."""
    path = f"{shared_folder(df.sparkSession)}/millrace-{name}-{uuid.uuid4().hex}"
    bounded_batches(df.sparkSession)
    with _dropped_shuffles(df.sparkSession):
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files and broadcasts of plans that are gone."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and so return heap that earlier stages filled, before workers beside them need memory.

    A task a core, all started together, so that each executor has some; one that gets none only keeps its heap.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def of_ids(df: DataFrame, ids: DataFrame, on: str, most: int = 1_000_000) -> DataFrame:
    """The rows of df whose `on` is in ids (one column of that name, cheap to read twice): without moving df if there are at most `most` ids, else by a shuffle."""
    if ids.limit(most + 1).count() <= most:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, on: str, most: int = 1_000_000) -> DataFrame:
    """The rows of df whose `on` isn't in ids; moves df only beyond `most` ids. Rows that share an id go together and rows without one stay: per_row gives keys where there are such."""
    ids = written(ids.select(on).distinct(), "ids")
    if ids.limit(most + 1).count() <= most:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_anti").select(df.columns)


def per_row(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], on: str = "doc_id") -> DataFrame:
    """stage(docs), which keeps docs' columns, decided row by row: where `on` is null or repeated, the rows get keys of their own, in order of `on` with null last, and their ids back after."""
    if not docs.groupBy(on).count().filter((F.col("count") > 1) | F.col(on).isNull()).limit(1).count():
        return stage(docs)
    rows = docs.withColumnRenamed(on, "_given").orderBy(F.col("_given").asc_nulls_last()).withColumn(on, F.monotonically_increasing_id())
    return stage(written(rows, "rows")).drop(on).withColumnRenamed("_given", on).select(docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
