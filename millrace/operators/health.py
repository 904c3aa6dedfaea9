"""Run health: trailing baselines, silent sources, gaps, alerts by severity (A6-A7, W2-W3, ST8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.values import weekend_days_between

SEVERITY = {"critical": 0, "warning": 1, "info": 2}


def trailing_baseline(df: DataFrame, group: str, order: str, value: str, runs: int = 5) -> DataFrame:
    """df with the mean of value over the `runs` rows before, its own left out."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-runs, -1)
    return df.withColumn("baseline", F.avg(value).over(w))


def seeded_counts(names: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """The count of rows for each name, zero for names without any."""
    return names.join(rows.groupBy(on).agg(F.count("*").alias("n")), on, "left").select(on, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gap_allowed(before: Column, now: Column, hours: float = 36.0) -> Column:
    """Hours that may pass between two runs: a day and a half, and a day for each weekend day between."""
    return hours + 24 * weekend_days_between(before.cast("date"), now.cast("date"))


def alerts(stats: DataFrame) -> DataFrame:
    """One row of run statistics (digest, gap_hours, gap_limit, total, failed, active, silent, errors) -> alerts by severity."""
    rules = [
        ("no_digest", "critical", ~F.col("digest")),
        ("missed_run", "warning", F.coalesce(F.col("gap_hours") > F.col("gap_limit"), F.lit(False))),
        ("all_sources_failed", "critical", (F.col("active") > 0) & (F.col("failed") >= F.col("active"))),
        ("no_jobs", "critical", (F.col("total") == 0) & ~((F.col("active") > 0) & (F.col("failed") >= F.col("active")))),
        ("source_zero", "warning", (F.size("silent") > 0) & (F.col("total") > 0)),
        ("errors", "info", (F.col("errors") > 0) & ~((F.col("active") > 0) & (F.col("failed") >= F.col("active")))),
    ]
    made = F.filter(F.array(*[F.when(c, F.struct(F.lit(SEVERITY[s]).alias("rank"), F.lit(i).alias("seq"), F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for i, (k, s, c) in enumerate(rules)]), lambda x: x.isNotNull())
    return stats.select("run", F.explode(made).alias("a")).select("run", "a.*")


def source_baselines(runs: DataFrame, last: int = 5) -> DataFrame:
    """source, baseline: the mean count over the last finished runs whose stats_json holds source_counts; a source absent from a run counts as 0."""
    stats = runs.withColumn("counts", F.from_json("stats_json", "source_counts MAP<STRING, STRING>")["source_counts"])
    recent = stats.filter("finished_at is not null and counts is not null").orderBy(F.desc("run_id")).limit(last)
    sums = recent.select(F.explode("counts").alias("source", "n")).groupBy("source").agg(F.sum(F.col("n").try_cast("double")).alias("s"))
    total = recent.agg(F.count("*").alias("runs"))  # one row
    return sums.filter("s is not null").join(F.broadcast(total)).select("source", (F.col("s") / F.col("runs")).alias("baseline"))
