"""The tracker as a stream (ST2, ST6): micro-batches of status updates folded into a keyed snapshot."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.state import fold_status


def _last(spark: SparkSession, snapshots: str, before: int | None = None) -> int | None:
    """The number of the last finished snapshot under the folder (below `before`), else null."""
    path = spark._jvm.org.apache.hadoop.fs.Path(snapshots)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [(re.fullmatch(r"state-(\d+)", f.getPath().getName()), f.getPath()) for f in fs.listStatus(path)]
    done = [int(m[1]) for m, p in found if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((n for n in done if before is None or n < before), default=None)


def run_available(spark: SparkSession, source: str, schema: str, snapshots: str, checkpoint: str) -> DataFrame:
    """Fold all files of updates under source (parquet: key, ordinal, status, score) into snapshots; returns the last one, empty if there is none yet.

    Each micro-batch writes a new snapshot from the last one below it and its own updates. A snapshot is what a fold of all updates so far needs:
    its rows stand for the last status and score, so history isn't read again. A batch repeated after a failure overwrites its own folder, so the
    result is the same. An update counts in the order of its ordinal within a batch, and batches in the order they come.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        # earlier rows first: a snapshot stands for ordinals before those of the batch
        updates = batch.select("key", F.struct(F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("n")).alias("ordinal"), "status", "score")
        last = _last(spark, snapshots, epoch)
        if last is not None:
            old = spark.read.parquet(f"{snapshots}/state-{last}")
            old = old.select("key", F.struct(F.lit(0).alias("part"), F.col("updated").alias("n")).alias("ordinal"), "status", "score")
            updates = old.join(updates.select("key").distinct(), "key", "left_semi").union(updates)
            rest = spark.read.parquet(f"{snapshots}/state-{last}").join(batch.select("key").distinct(), "key", "left_anti")
            created = spark.read.parquet(f"{snapshots}/state-{last}").select("key", F.col("created").alias("was"))
        new = fold_status(updates).select("key", "status", "score", F.col("created.n").alias("created"), F.col("updated.n").alias("updated"))
        if last is not None:
            new = new.join(created, "key", "left").withColumn("created", F.coalesce("was", "created")).drop("was").unionByName(rest)
        new.write.mode("overwrite").parquet(f"{snapshots}/state-{epoch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = _last(spark, snapshots)
    if last is None:
        return spark.createDataFrame([], "key string, status string, score int, created long, updated long")
    return spark.read.parquet(f"{snapshots}/state-{last}")
