"""Gates and documents of single postings: eligibility, document rows, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import slugify
from millrace.functions.values import detect_ats


def eligible(df: DataFrame, applied: DataFrame, enabled: bool = True, min_score: int = 80, require_pdf: bool = True) -> DataFrame:
    """df (key, url, score, pdf, pdf_exists) with `reason`, the first gate that a posting fails; null if it passes all.

    applied holds the keys applied to. A null score or pdf_exists fails its gate.
    """
    done = applied.select("key").distinct().withColumn("done", F.lit(True))
    reason = F.when(F.lit(not enabled), "auto-apply is off").when(detect_ats(F.col("url")).isNull(), "unsupported application form")
    reason = reason.when(F.coalesce(F.col("score") < min_score, F.lit(True)), F.concat(F.lit("score "), F.coalesce(F.col("score").cast("string"), F.lit("missing")), F.lit(f" is below {min_score}")))
    if require_pdf:
        reason = reason.when(F.coalesce(F.trim("pdf"), F.lit("")) == "", "no PDF").when(~F.coalesce("pdf_exists", F.lit(False)), "PDF is missing")
    return df.join(done, "key", "left").withColumn("reason", reason.when(F.col("done"), "already applied")).drop("done")


def of_kinds(alerts: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Alerts of the given kinds; all for None, none for an empty list."""
    return alerts if kinds is None else alerts.filter(F.col("kind").isin(kinds))


def documents(df: DataFrame, threshold: int) -> DataFrame:
    """Rows to write documents for (status digest, score from the threshold on) with `folder`, which no two keys share."""
    rows = df.filter((F.col("status") == "digest") & (F.col("score") >= threshold))
    return rows.withColumn("folder", F.concat_ws("-", slugify(F.concat_ws(" ", "company", "title")), F.left("key", F.lit(8))))


def write_documents(rows: DataFrame, path: str) -> None:
    """A folder of JSON for each row's `folder` under path; only the folders written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").json(path)


def escaped(c: Column) -> Column:
    """Text for HTML; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def report(df: DataFrame, title: str, columns: list[str], order: list[Column], most: int = 500) -> DataFrame:
    """One row, `html`: a page with a table of the first `most` rows by order. The cap is a report's length, not the data's."""
    cells = F.concat_ws("", *[F.concat(F.lit("<td>"), escaped(F.col(c).cast("string")), F.lit("</td>")) for c in columns])
    top = df.orderBy(*order).limit(most).select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("tr"), F.row_number().over(_by(order)).alias("n"))
    body = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "tr"))), lambda r: r["tr"]), "\n").alias("rows"))
    head = escaped(F.lit(title))
    return body.select(F.concat(F.lit("<!doctype html><title>"), head, F.lit("</title><h1>"), head, F.lit("</h1>\n<table>\n"), F.col("rows"), F.lit("\n</table>")).alias("html"))


def _by(order: list[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def write_report(page: DataFrame, path: str) -> None:
    page.coalesce(1).write.mode("overwrite").text(path)


def summary(stats: DataFrame) -> DataFrame:
    """One line for each row of run statistics: the funnel from fetched to matched."""
    new = F.greatest(F.lit(0), F.col("after_filters") - F.col("already_seen"))
    steps = [("fetched", F.col("fetched")), ("deduped", F.col("after_dedupe")), ("filtered", F.col("after_filters")), ("new", new), ("scored", F.col("scored")), ("matched", F.col("matches"))]
    return stats.select(F.concat_ws(" → ", *[F.concat(F.lit(f"{name} "), c.cast("string")) for name, c in steps]).alias("summary"))
