"""Scoring by a model outside (X1, X5, P33): prompts as columns, replies through a function that tests put in place of the network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.replies import extract_json
from millrace.functions.values import parse_score, string_list

MOST_TEXT = 6000


def prompt(profile: str, title: Column, company: Column, location: Column, description: Column, most: int = MOST_TEXT) -> Column:
    """What the model is asked about one posting; blank fields are told as unknown, the description is cut at `most` characters."""

    def told(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown")))

    body = F.substring(F.coalesce(description, F.lit("")), 1, most)
    ask = 'Answer with one JSON object: {"score": 0 to 100, "reasons": [texts], "gaps": [texts]}.'
    return F.concat_ws("\n", F.lit(f"Candidate:\n{profile}\n"), told("Title", title), told("Company", company), told("Place", location), F.lit("Description:"), body, F.lit(""), F.lit(ask))


def completed(df: DataFrame, key: str, text: str, complete: Callable[[str], str], tries: int = 3, wait: float = 0.5) -> DataFrame:
    """key, reply, error of each row's text. complete raises for a failure; one that names 408, 429, 5xx or a connection is tried again, longer waits between."""

    def answer(x: str) -> tuple[str | None, str | None]:
        error = None
        for n in range(tries):
            if n:
                time.sleep(wait * 2 ** (n - 1))
            try:
                return complete(x), None
            except Exception as e:  # whatever the provider's client throws
                error = str(e) or type(e).__name__
                again = any(f"HTTP {s}" in error for s in ("408", "429", "5")) or "connection" in error.lower()
                if not again:
                    break
        return None, error

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            got = [answer(x) for x in b[text]]
            yield b[[key]].assign(reply=[g[0] for g in got], error=[g[1] for g in got])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, reply string, error string")


def scored(replies: DataFrame) -> DataFrame:
    """replies (reply, error, ...) with score, reasons, gaps and the error: the call's, else that the reply holds no score."""
    out = replies.withColumn("_json", extract_json(F.col("reply")))
    out = out.withColumn("score", parse_score(F.get_json_object("_json", "$.score")))
    for name in ("reasons", "gaps"):
        raw = F.get_json_object("_json", f"$.{name}")
        # get_json_object gives a text without its quotes
        out = out.withColumn(name, string_list(F.when(raw.startswith("["), raw).otherwise(F.to_json(F.struct(raw.alias("x"))).substr(F.lit(6), F.length(raw) + 2))))
    missing = F.when(F.col("_json").isNull(), "no JSON in the reply").when(F.col("score").isNull(), "no score in the reply")
    return out.withColumn("error", F.coalesce("error", missing)).drop("_json")
