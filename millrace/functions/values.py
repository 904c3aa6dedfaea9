"""Dates, ages, scores, replies and form fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_datetime(c: Column) -> Column:
    """A timestamp from epoch seconds or milliseconds as digits, ISO 8601, or RFC 822; else null."""
    number = F.when(c.rlike(r"^\d+$"), c.try_cast("decimal(30,0)"))
    seconds = F.when(number > 100_000_000_000, number / 1000).otherwise(number).try_cast("double")
    epoch = F.when(seconds < 253_402_300_800, F.timestamp_millis((seconds * 1000).cast("long")))
    return F.when(c.rlike(r"^\d+$"), epoch).otherwise(F.coalesce(F.try_to_timestamp(F.nullif(F.trim(c), F.lit(""))), F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))))


def age_hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 3.6e9


def weekend_days_between(a: Column, b: Column) -> Column:
    """Saturdays and Sundays strictly between two dates."""
    days = F.sequence(F.date_add(a, 1), F.greatest(F.date_add(a, 1), F.date_sub(b, 1)))
    return F.when(F.date_sub(b, 1) < F.date_add(a, 1), 0).otherwise(F.size(F.filter(days, lambda d: F.weekday(d) >= 5)))


def relative_time(now: Column, then: Column) -> Column:
    """How long ago in words; a date beyond 60 days, a dash for none."""
    s = (F.unix_micros(now) - F.unix_micros(then)) / 1e6
    whole = lambda x: F.floor(x).cast("string")
    return (
        F.when(then.isNull(), "—")
        .when((s < 0) & (s > -7200), "just now")
        .when((s < 0) & (s > -172800), F.concat(F.lit("in "), whole(-s / 3600), F.lit("h")))
        .when(s < 0, F.concat(F.lit("in "), whole(-s / 86400), F.lit("d")))
        .when(s < 90, "just now")
        .when(s < 3600, F.concat(whole(s / 60), F.lit("m ago")))
        .when(s < 86400, F.concat(whole(s / 3600), F.lit("h ago")))
        .when(s < 172800, "yesterday")
        .when(s < 60 * 86400, F.concat(whole(s / 86400), F.lit("d ago")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def parse_score(c: Column) -> Column:
    """A score of 0 to 100 from a number, "82/100" or "score: 82,5", rounded half to even; null (an error) if there is none."""
    number = F.replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"-?\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.bround(number)))).cast("int")


def score_band(c: Column) -> Column:
    return F.when(c.isNull(), "error").when(c >= 90, "90").when(c >= 80, "80").when(c >= 70, "70").otherwise("low")


def url_host(c: Column) -> Column:
    full = F.when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.lower(F.try_parse_url(full, F.lit("HOST")))


def detect_ats(c: Column) -> Column:
    """The applicant system whose form a URL leads to, by its host alone, else null."""
    given = F.trim(c)
    full = F.when(given.contains("//"), F.when(given.startswith("//"), F.concat(F.lit("https:"), given)).otherwise(given)).otherwise(F.concat(F.lit("https://"), given))
    host = F.trim(F.lower(F.try_parse_url(full, F.lit("HOST"))), F.lit("."))
    path = F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("/"))
    lever = (host == "jobs.lever.co") | host.endswith(".jobs.lever.co")
    # Parts of a path that lead to a posting or its form
    form = path.rlike("(?i)/(?:jobs?|embed|job_app|application|applications|apply)(?:/|$)")
    greenhouse = ((host == "greenhouse.io") | host.endswith(".greenhouse.io")) & (F.split_part(host, F.lit("."), F.lit(1)).contains("boards") | form)
    return F.when(full.rlike("(?i)^https?://"), F.when(lever, "lever").when(greenhouse, "greenhouse"))


def http_status(c: Column) -> Column:
    """The HTTP status that an error's text names, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"\bHTTP[: ]+(\d{3})\b", 1), F.lit("")).cast("int")


#: What a status means to the person who set up a board.
STATUS_HINTS = {401: "a login is needed", 403: "access is refused", 404: "no board of that name", 410: "the board is gone", 429: "too many requests"}


def describe_error(c: Column, limit: int = 200) -> Column:
    """An error for a report: its status with what it means, else its text, cut."""
    from millrace.functions.text import truncate

    status = http_status(c)
    hint = F.coalesce(*[F.when(status == k, F.lit(f" ({v})")) for k, v in STATUS_HINTS.items()], F.lit(""))
    return F.when(status.isNotNull(), F.concat(F.lit("HTTP "), status.cast("string"), hint)).otherwise(truncate(F.trim(c), limit, " …"))


def transient(c: Column) -> Column:
    """Whether an error is worth another try: too many requests, a timeout, any status from 500 on."""
    status = http_status(c)
    return F.coalesce(status.isin(408, 409, 425, 429) | status.between(500, 599), c.rlike("(?i)timeout|connection"), F.lit(False))


def string_list(c: Column) -> Column:
    """A JSON value as a list of texts: one text becomes a list of it, other kinds than texts and blanks go; null is empty."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    one, many = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(F.filter(many, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    none = F.array().cast("array<string>")
    out = F.when(kind == "STRING", F.array(F.trim(one))).when(kind.startswith("ARRAY"), texts).otherwise(none)
    return F.filter(F.coalesce(out, none), lambda x: x != "")


def reply_text(c: Column) -> Column:
    """struct(text, error) of a chat completion's JSON: content as text or as parts, else the reasoning; an error object or no choice is an error."""
    v = F.try_parse_json(c)
    message = F.try_variant_get(v, "$.choices[0].message", "variant")
    content = F.try_variant_get(message, "$.content", "variant")
    kind = F.schema_of_variant(content)
    parts = F.transform(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.try_variant_get(x, "$.text", "string"), F.lit("")),
    )
    text = F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(parts, ""))
    text = F.coalesce(text, F.try_variant_get(message, "$.reasoning", "string"), F.lit(""))
    failed = F.try_variant_get(v, "$.error", "variant")
    error = F.when(v.isNull(), "no JSON").when(F.schema_of_variant(failed).startswith("OBJECT<"), F.coalesce(F.try_variant_get(failed, "$.message", "string"), F.lit("error")))
    error = error.when(F.try_variant_get(v, "$.choices[0]", "variant").isNull(), "no choices").when(message.isNull(), "no message")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def iso_text(c: Column) -> Column:
    """A UTC timestamp as ISO 8601 text with +00:00, microseconds only where there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(c) % 1_000_000
    return F.concat(whole, F.when(F.pmod(micros, F.lit(1_000_000)) != 0, F.date_format(c, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def parse_iso(c: Column) -> Column:
    """The timestamp of ISO 8601 text, without a zone as UTC; else null."""
    return F.try_to_timestamp(F.nullif(c, F.lit("")))


def artifact_href(c: Column, folder: str) -> Column:
    """A link to a file: relative where it is, or lies in folder, else a file address; each part quoted."""

    def quoted(x: Column) -> Column:
        return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))

    inside = folder.rstrip("/") + "/"
    relative = F.when(c.startswith(inside), F.substring(c, len(inside) + 1, 1 << 30)).when(~c.startswith("/"), c)
    return F.when(F.coalesce(c, F.lit("")) == "", None).otherwise(F.coalesce(quoted(relative), F.concat(F.lit("file://"), quoted(c))))
