"""Deterministic dedup: the richest row of each key, first sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_richest(df: DataFrame, key: str, richness: list[Column], ordinal: str) -> DataFrame:
    """Of each key the row with the greatest richness, ties to the least ordinal (one of its own for each row).

    Only keys, ranks and ordinals are aggregated; the rows themselves are picked by ordinal after.
    """
    best = df.select(key, ordinal, F.struct(*richness, (-F.col(ordinal)).alias("_o")).alias("_rank"))
    best = best.groupBy(key).agg(F.max_by(ordinal, "_rank").alias(ordinal)).select(ordinal)
    return df.join(best, ordinal, "left_semi")


def first_sighting(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def back_filled(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The first row of each key, its blank fields filled from the first later row that has them."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = df.withColumns({f: F.first(F.nullif(F.trim(F.col(f)), F.lit("")), ignorenulls=True).over(whole) for f in fields})
    return filled.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
