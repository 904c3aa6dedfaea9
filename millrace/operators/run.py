"""A whole run: sources pruned and counted, kept rows gated by the tracker, outcomes and the run ledger (F11, F12, K3, ST4, ST7, A10, A12, P40)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.state import should_surface, upsert_jobs


def active(enabled: list[str], wanted: list[str] | None) -> list[str]:
    """Sources that are on and, where some are asked for, among these; in their own order."""
    names = None if wanted is None else {w.strip().lower() for w in wanted if w.strip()}
    return [s for s in enabled if names is None or s in names]


def of_sources(rows: DataFrame, names: list[str], column: str = "source") -> DataFrame:
    """Rows of the named sources, whatever a reader brought with them."""
    return rows.filter(F.lower(F.coalesce(F.col(column), F.lit(""))).isin(names))


def source_counts(rows: DataFrame, names: list[str], column: str = "source") -> DataFrame:
    """source, n: the rows of each source; zero for an active source without any, `unknown` for rows without a source."""
    seen = rows.select(F.coalesce(F.nullif(F.lower(F.col(column)), F.lit("")), F.lit("unknown")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    none = rows.sparkSession.createDataFrame([(s, 0) for s in names], "source string, n bigint")
    return seen.union(none).groupBy("source").agg(F.sum("n").alias("n"))


class Gated:
    """What the gate leaves: `jobs` the next snapshot, `surfaced` rows to go on with, `outcomes` to record, `already_seen` their number as one row."""

    def __init__(self, jobs: DataFrame, surfaced: DataFrame, outcomes: DataFrame, already_seen: DataFrame):
        self.jobs, self.surfaced, self.outcomes, self.already_seen = jobs, surfaced, outcomes, already_seen


def gate(decided: DataFrame, jobs: DataFrame, state: DataFrame, now: Column, days: int = 30) -> Gated:
    """The tracker's gate over rows with `reject` (null: kept), the snapshot of jobs and the state (key, status, updated).

    Every row is recorded as seen. A kept row goes on unless its outcome counts as handled within `days`; a row that the tracker has nothing on
    goes on. Rejected rows get the outcome `filtered` with their reason; one that was applied to keeps its outcome.
    """
    cols = ["key", "title", "url", "location", "country", "posted_at"]
    fresh = decided.select(*cols, now.alias("first_seen"), now.alias("last_seen")).dropDuplicates(["key"])
    known = state.select("key", F.col("status").alias("_status"), F.col("updated").alias("_updated"))
    both = decided.join(known, "key", "left").withColumn("_show", should_surface(F.col("_status"), F.col("_updated"), now, days))
    kept = both.filter("reject is null")
    outcomes = both.filter("reject is not null and coalesce(_status, '') <> 'applied'").select("key", F.lit("filtered").alias("status"), F.col("reject.reason").alias("detail"), now.alias("updated"))
    return Gated(upsert_jobs(jobs, fresh), kept.filter("_show").drop("_status", "_updated", "_show"), outcomes, kept.agg(F.count_if(~F.col("_show")).alias("already_seen")))


def ledger(events: DataFrame) -> DataFrame:
    """Runs from events (run_id, at, kind started or finished, stats_json): run_id, started_at, finished_at, stats_json. The last finish counts."""
    done = F.when(F.col("kind") == "finished", F.struct("at", "stats_json"))
    return events.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "started", F.col("at"))).alias("started_at"), F.max(done).alias("_f")).select(
        "run_id", "started_at", F.col("_f.at").alias("finished_at"), F.col("_f.stats_json").alias("stats_json")
    )


def start(spark: SparkSession, run_id: int, at) -> DataFrame:
    """The event row of a run's start, to append to the ledger's table."""
    return spark.createDataFrame([(run_id, at, "started", None)], "run_id bigint, at timestamp, kind string, stats_json string")


def finish(spark: SparkSession, run_id: int, at, stats_json: str) -> DataFrame:
    return spark.createDataFrame([(run_id, at, "finished", stats_json)], "run_id bigint, at timestamp, kind string, stats_json string")


def some_of(df: DataFrame, group: str, order: str, message: str, most: int = 3) -> DataFrame:
    """group, n, some: how many messages, and the first few of them in order, joined. No group's messages meet in one list."""
    from pyspark.sql import Window

    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_r") <= most)
    first = first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", message))), lambda x: x[message]), "; ").alias("some"))
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    return counts.join(first, group).select(group, "n", F.when(F.col("n") > most, F.concat("some", F.lit("; ..."))).otherwise(F.col("some")).alias("some"))


def silent(baselines: DataFrame, today: DataFrame, names: list[str], least: float = 3.0) -> DataFrame:
    """source, baseline of active sources that used to bring at least `least` rows a run and brought none today."""
    now = today.select("source", F.col("n").alias("_n"))
    rows = baselines.filter((F.col("baseline") >= least) & F.col("source").isin(names)).join(now, "source", "left")
    return rows.filter(F.coalesce("_n", F.lit(0)) == 0).select("source", "baseline")


def migrated(df: DataFrame, version: int, steps: list) -> tuple[DataFrame, int]:
    """(df, version) after the steps it has not seen; step i brings version i to i + 1. Running it again changes nothing."""
    for step in steps[version:]:
        df = step(df)
    return df, max(version, len(steps))


def ranked_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts (run, severity, seq, ...) with `place`: by severity, ties in the order they were raised."""
    from pyspark.sql import Window

    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return alerts.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(rank, "seq")))


def following(tokens: DataFrame, group: str, order: str, token: str, n: int = 6) -> DataFrame:
    """tokens with `next`, the token after, and `ahead`, up to n tokens after it, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    return tokens.withColumn("next", F.lead(token).over(w)).withColumn("ahead", F.array_join(F.collect_list(token).over(w.rowsBetween(1, n)), " "))


def probed(entries: DataFrame, payloads: DataFrame, rows: DataFrame) -> DataFrame:
    """board, slug, ok, n, error of each board asked: a board without postings is fine, one that gave an error isn't."""
    n = rows.groupBy("slug").agg(F.count("*").alias("n"))
    asked = payloads.groupBy("board", "slug").agg(F.max("error").alias("error"))
    out = entries.select("board", "slug").join(asked, ["board", "slug"], "left").join(n, "slug", "left")
    return out.select("board", "slug", F.col("error").isNull().alias("ok"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "error")


def any_of(df: DataFrame, group: str, flag: str) -> DataFrame:
    """group, some, every: whether any and whether all of a group's flags hold; a null flag doesn't."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return df.groupBy(group).agg(F.bool_or(f).alias("some"), F.bool_and(f).alias("every"))
