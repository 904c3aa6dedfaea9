"""Thresholds, caps, stable ranking and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of a total order: a top-k of each task, then of their results."""
    return df.orderBy(*order).limit(n)


def classify(score: Column, error: Column, threshold: int) -> Column:
    return F.when(error.isNotNull(), "digest").when(score >= threshold, "digest").otherwise("scored_below")


def cap(df: DataFrame, key: str, order: list[Column], n: int, within: list[str] | None = None) -> DataFrame:
    """All rows with `detail`: 'over cap' for those after the first n (of each group) in the order.

    Only the first n are ranked, each task its own before they meet; the others are told by a join on key.
    """
    if within:
        rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        first = df.withColumn("_r", rank).filter(F.col("_r") <= n)
    else:
        first = df.orderBy(*order).limit(n)
    first = first.select(key, F.lit("").alias("_in"))
    return df.join(first, key, "left").withColumn("detail", F.coalesce("_in", F.lit("over cap"))).drop("_in")


def by_count(counts: DataFrame, name: str, n: str = "n") -> DataFrame:
    """Counts in the order of a report: greatest first, then by name."""
    return counts.orderBy(F.desc(n), name)


#: Outcomes by the bucket of the digest that shows them; all others go to "other". Those sorted by score.
BUCKETS = {"digest": "needs_click", "applied": "auto_applied", "dry_run": "dry_run", "apply_failed": "failed", "scored_below": "below"}
BY_SCORE = ("needs_click", "below", "other")


def buckets(df: DataFrame, status: str, score: str, ordinal: str) -> DataFrame:
    """df with `bucket` and `place`: by score in the buckets that are sorted, ties and all others in the order they came."""
    bucket = F.coalesce(*[F.when(F.col(status) == s, F.lit(b)) for s, b in BUCKETS.items()], F.lit("other"))
    out = df.withColumn("bucket", bucket)
    by = F.when(F.col("bucket").isin(*BY_SCORE), F.col(score))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc(by), ordinal)))
