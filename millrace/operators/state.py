"""Keyed state as snapshots: upserts, status folds, the surface gate (ST1-ST4, K1-K2, J2-J3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An outcome that is never downgraded, and those that count as handled.
TERMINAL = "applied"
HANDLED = ("applied", "digest", "needs_click", "dry_run", "scored_below")


def upsert_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next snapshot of jobs (key, title, url, location, country, posted_at, first_seen, last_seen); is_new tells inserts.

    On a match: last_seen and url are the new ones, location the new one unless blank, country the new one unless null, posted_at the old
    one unless null, all else stays. A full outer join on key: one shuffle of both sides, none if both are bucketed by key.
    """
    o, n = old.alias("o"), new.alias("n")
    c = F.col
    fresh, gone = c("o.key").isNull(), c("n.key").isNull()
    return o.join(n, F.expr("o.key = n.key"), "full_outer").select(
        F.coalesce("o.key", "n.key").alias("key"),
        F.when(fresh, c("n.title")).otherwise(c("o.title")).alias("title"),
        F.when(gone, c("o.url")).otherwise(c("n.url")).alias("url"),
        F.when(F.trim(F.coalesce("n.location", F.lit(""))) != "", c("n.location")).otherwise(c("o.location")).alias("location"),
        F.coalesce("n.country", "o.country").alias("country"),
        F.coalesce("o.posted_at", "n.posted_at").alias("posted_at"),
        F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"),
        F.coalesce("n.last_seen", "o.last_seen").alias("last_seen"),
        fresh.alias("is_new"),
    )


def fold_status(updates: DataFrame, key: str = "key", order: str = "ordinal", terminal: str = TERMINAL) -> DataFrame:
    """Updates (key, ordinal, status, score) folded in order: after the first terminal status only terminal ones count; the last non-null score stays."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col("status") == terminal).cast("int")).over(w), F.lit(0)) == 1
    live = updates.withColumn("_live", ~done | (F.col("status") == terminal))
    last = F.struct(F.col(order), F.col("status"))
    return live.groupBy(key).agg(
        F.max(F.when(F.col("_live"), last))["status"].alias("status"),
        F.max(F.when(F.col("score").isNotNull() & F.col("_live"), F.struct(F.col(order), F.col("score"))))["score"].alias("score"),
        F.min(order).alias("created"),
        F.max(F.when(F.col("_live"), F.col(order))).alias("updated"),
    )


def should_surface(status: Column, updated: Column, now: Column, days: int, handled: tuple[str, ...] = HANDLED, terminal: str = TERMINAL) -> Column:
    """Whether a posting with this stored outcome (null: none) may be shown again."""
    shown = status.isNull() | ~status.isin(*handled) | F.lit(days <= 0) | updated.isNull() | (updated < now - F.make_dt_interval(F.lit(days)))
    return F.when(F.coalesce(status == terminal, F.lit(False)), False).otherwise(shown)
