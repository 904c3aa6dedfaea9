"""Postings from alert mails (S16, S18-S20, S22): each posting's link with the fields that follow it, one row for each posting of a message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import network_url, posting_url_id
from millrace.operators.dedupe import back_filled
from millrace.sources.postings import html_tokens

LOOK_AHEAD, LONGEST_FIELD, MOST_PAGES = 6, 80, 60
#: Signs between fields; texts that are no field; how an age, a count, a link of the footer begin; words of remote work.
SEPARATORS = " \t\r\n·•|-–—:,"
NOISE = ("promoted", "new", "actively recruiting", "be an early applicant", "easy apply", "your job alert", "job alert")
AGE = r"^(?:just now|today|yesterday|\d+\s*\+?\s*(?:second|sec|minute|min|hour|hr|day|week|month|year)s?\s+ago)$"
COUNT = r"^\d[\d,.]*\s+(?:applicants?|viewers?|people\b|connections?|alumni)"
FOOTER = (
    r"^(?:see all|see more|view (?:all|job|company)|apply|easy apply|unsubscribe|help|manage|settings|sign in|download|about|privacy|terms|update your|"
    r"stop receiving|jobs? you may|linkedin|this email|you are receiving)"
)
REMOTE = r"(?i)\b(?:remote|hybrid|work from home|wfh|anywhere)\b"


def _bare(c: Column) -> Column:
    return F.trim(c, F.lit(SEPARATORS))


def is_field(c: Column) -> Column:
    """Whether a text can be a company or a place: short, and neither an age, a count, a badge, an address nor the footer."""
    low = F.lower(_bare(c))
    noise = (low == "") | (F.length(_bare(c)) > LONGEST_FIELD) | low.isin(*NOISE) | low.rlike(AGE) | low.rlike(COUNT) | low.rlike(FOOTER)
    return ~(noise | low.contains("@") | low.contains("http"))


def mail_rows(messages: DataFrame) -> DataFrame:
    """messages: message (bigint), html, received_at. Rows message, posting, title, company, location, url, posted_at, remote, ordinal.

    A link with a posting's number and a text is a posting; of the next tokens, as far as the next posting and six at most, the first two fields are
    its company and place. A posting that comes again in a message fills in what its first place lacks. A message without html has no rows.
    """
    tokens = html_tokens(messages, "message", "html").withColumn("posting", F.when(F.col("kind") == "link", posting_url_id(F.col("href"))))
    w = Window.partitionBy("message").orderBy("pos").rowsBetween(1, LOOK_AHEAD)
    ahead = F.collect_list(F.struct(F.col("posting").isNotNull().alias("next"), "text")).over(w)
    jobs = tokens.withColumn("ahead", ahead).filter("posting is not null and text <> ''")
    stop = F.array_position(F.transform("ahead", lambda t: t["next"]), F.lit(True)).cast("int")
    own = F.when(stop > 0, F.slice("ahead", 1, stop - 1)).otherwise(F.col("ahead"))
    pieces = F.flatten(F.transform(own, lambda t: F.split(t["text"], "·")))
    fields = F.transform(F.filter(pieces, is_field), _bare)
    jobs = jobs.withColumn("fields", fields).select(
        "message", "posting", F.col("text").alias("title"), F.coalesce(F.get("fields", F.lit(0)), F.lit("")).alias("company"), F.coalesce(F.get("fields", F.lit(1)), F.lit("")).alias("location"),
        network_url(F.col("href")).alias("url"), F.col("pos").cast("long").alias("ordinal"), F.struct("message", "posting").alias("_key"),
    )
    jobs = back_filled(jobs, "_key", ["ordinal"], ["company", "location"]).drop("_key").na.fill("", ["company", "location"])
    jobs = jobs.withColumn("remote", F.when(F.concat_ws(" ", "location", "title").rlike(REMOTE), True))
    return jobs.join(messages.select("message", F.col("received_at").alias("posted_at")), "message")


def with_pages(rows: DataFrame, fetch: Callable[[str], str], key: str = "posting", most: int = MOST_PAGES) -> DataFrame:
    """rows (key, url, ...) with the `description` that fetch finds for the first `most` of them; empty for the others and where it fails.

    The limit is a courtesy to the site, not to the data: all rows stay.
    """

    def run(batches):
        for b in batches:
            texts = []
            for url in b["url"]:
                try:
                    texts.append(fetch(url) or "")
                except Exception:  # a page that can't be read leaves its row as it is
                    texts.append("")
            yield b[["_key"]].assign(description=texts)

    first = rows.select(F.col(key).alias("_key"), "url").dropDuplicates(["_key"]).orderBy("_key").limit(most)
    found = first.mapInPandas(run, f"_key {rows.schema[key].dataType.simpleString()}, description string")
    out = rows.drop("description").join(found, F.col(key) == F.col("_key"), "left").drop("_key")
    return out.withColumn("description", F.coalesce("description", F.lit("")))
