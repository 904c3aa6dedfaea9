"""The reasoned filter cascade (F3-F9): stages in order, the first that fails gives the one reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import first_phrase, has_phrase


def rule(category: str, fails: Column, detail: Column | None = None) -> Column:
    """A reject struct where `fails` holds, else null."""
    return F.when(fails, F.struct(F.lit(category).alias("category"), (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).alias("reason")))


def excluded(category: str, norm: Column, phrases: list[str]) -> Column:
    hit = first_phrase(norm, phrases)
    return rule(category, hit.isNotNull(), hit)


def required(category: str, norm: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | has_phrase(norm, p)
    return rule(category, ~hit if phrases else F.lit(False))


def stale(posted: Column, now: Column, max_hours: float, skip_undated: bool = True) -> list[Column]:
    """Undated rows, and rows older than the limit. A date in the future passes; from_future() tells which to note."""
    age = (F.unix_micros(now) - F.unix_micros(posted)) / 3.6e9
    return [rule("undated", posted.isNull() & F.lit(skip_undated)), rule("stale", age > max_hours)]


def from_future(posted: Column, now: Column, tolerance: float = 2.0) -> Column:
    """Whether a date lies more than `tolerance` hours ahead: such a row passes with a note."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(posted)) / 3.6e9 < -tolerance, F.lit(False))


def too_short(text: Column, least: int) -> Column:
    """Texts of fewer than `least` characters without the white space around them; none for a limit of 0 or less."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\x{85}\p{Z}\x1C-\x1F]+|[\s\x{85}\p{Z}\x1C-\x1F]+$", "")
    return rule("too_short", (F.length(bare) < least) & F.lit(least > 0))


def stamped(df: DataFrame, reached: Column, country: Column, remote: Column) -> DataFrame:
    """df with country where it was blank and remote where it was null, for the rows that reached the place stage."""
    blank = F.coalesce(F.col("country"), F.lit("")) == ""
    out = df.withColumn("_c", F.when(reached & blank, F.coalesce(country, F.col("country"))).otherwise(F.col("country")))
    out = out.withColumn("_r", F.when(reached & F.col("remote").isNull(), remote).otherwise(F.col("remote")))
    return out.drop("country", "remote").withColumnsRenamed({"_c": "country", "_r": "remote"})


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a costly column that later filters and rules read but Spark does not copy into each of them."""
    return df.withColumn(name, F.explode(F.array(value)))


def location_gate(geo: Column, allowed: list[str], allow_remote: bool = True, require_hint: bool = True) -> Column:
    """geo: struct country, remote, eu_hint, us. No allowed list passes all; a known country decides; else remote wording, else rejection."""
    inside = geo["country"].isin(allowed) if allowed else F.lit(True)
    remote_ok = F.lit(allow_remote) & (geo["eu_hint"] if require_hint else F.lit(True))
    passes = F.when(F.lit(not allowed), True).when(geo["country"].isNotNull(), inside).when(geo["remote"], remote_ok).otherwise(False)
    return rule("location_outside_eu", ~passes)


def cascade(df: DataFrame, stages: list[Column]) -> DataFrame:
    """df with `reject`: null for rows kept. Later stages are not evaluated where an earlier one fails."""
    return df.withColumn("reject", F.coalesce(*stages))


def counts(df: DataFrame) -> DataFrame:
    return df.filter("reject is not null").groupBy(F.col("reject.category").alias("category")).agg(F.count("*").alias("n"))
