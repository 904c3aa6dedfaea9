"""Postings from the payloads of boards, an aggregator and alert mails (S1-S20): JSON text in, one schema out.

Payloads are read with fixed schemas in permissive mode, as a bare list or as a list in one of the known wrappers; rows without title or
address are dropped, a malformed payload gives no rows.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import dedupe_key, html_to_text, normalize_text, title_words
from millrace.functions.values import parse_datetime

REMOTE = r"(?i)\b(?:remote|anywhere|work from home)\b"
GREENHOUSE = "ARRAY<STRUCT<id: BIGINT, title: STRING, updated_at: STRING, first_published: STRING, absolute_url: STRING, location: STRUCT<name: STRING>, offices: ARRAY<STRUCT<name: STRING, location: STRING>>, metadata: ARRAY<STRUCT<name: STRING, value: STRING>>, company_name: STRING, content: STRING>>"
LEVER = "ARRAY<STRUCT<id: STRING, text: STRING, hostedUrl: STRING, applyUrl: STRING, createdAt: BIGINT, publishedAt: STRING, title: STRING, workplaceType: STRING, categories: STRUCT<location: STRING, allLocations: ARRAY<STRING>>, descriptionPlain: STRING, description: STRING, lists: ARRAY<STRUCT<text: STRING, content: STRING>>, additionalPlain: STRING, salaryRange: STRUCT<min: DOUBLE, max: DOUBLE, currency: STRING, interval: STRING>>>"
ADZUNA = "ARRAY<STRUCT<id: STRING, title: STRING, created: STRING, redirect_url: STRING, company: STRUCT<display_name: STRING>, location: STRUCT<display_name: STRING, area: ARRAY<STRING>>, description: STRING, salary_min: DOUBLE, salary_max: DOUBLE, salary_is_predicted: STRING>>"
PLACEHOLDERS = ("n/a", "na", "none", "no office", "unknown", "-")


def _clean(c: Column) -> Column:
    c = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(c).isin(*PLACEHOLDERS), "").otherwise(c)


def join_locations(values: Column, most: int = 4) -> Column:
    """The first `most` distinct names, without regard to case, joined."""
    kept = F.aggregate(F.filter(F.transform(values, _clean), lambda x: x != ""), F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))
    return F.array_join(F.slice(kept, 1, most), "; ")


def items(payload: Column, schema: str, *wrappers: str) -> Column:
    """The list of a payload: the payload itself, or the first of wrappers that holds a list."""
    bare = F.when(F.trim(payload).startswith("["), F.from_json(payload, schema))
    return F.coalesce(bare, *[F.from_json(F.get_json_object(payload, f"$.{w}"), schema) for w in wrappers])


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _money(c: Column) -> Column:
    return F.format_number(c, 0)


def greenhouse(payloads: DataFrame) -> DataFrame:
    """payloads: slug, payload."""
    j = F.col("j")
    rows = payloads.select("slug", F.posexplode(items(F.col("payload"), GREENHOUSE, "jobs")).alias("pos", "j")).filter(F.trim(F.coalesce(j["title"], F.lit(""))) != "")
    text = j["content"]
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    place = F.coalesce(F.nullif(_clean(j["location"]["name"]), F.lit("")), join_locations(F.transform(F.coalesce(j["offices"], F.array().cast("array<struct<name:string,location:string>>")), lambda o: F.coalesce(o["location"], o["name"]))))
    pay = F.filter(j["metadata"], lambda m: F.lower(m["name"]).rlike("salary|compensation|pay range"))
    return rows.select(
        F.lit("greenhouse").alias("source"),
        F.coalesce(_text(j["company_name"]), title_words(F.col("slug"))).alias("company"),
        F.trim(j["title"]).alias("title"),
        F.coalesce(_text(j["absolute_url"]), F.concat(F.lit("https://boards.greenhouse.io/"), F.col("slug"), F.lit("/jobs/"), j["id"].cast("string"))).alias("url"),
        place.alias("location"),
        html_to_text(text).alias("description"),
        F.coalesce(parse_datetime(j["first_published"]), parse_datetime(j["updated_at"])).alias("posted_at"),
        F.when(F.concat_ws(" ", place, j["title"]).rlike(REMOTE), True).alias("remote"),
        F.get(pay, F.lit(0))["value"].alias("salary"),
        j["id"].cast("string").alias("ats_job_id"),
        F.col("pos").cast("long").alias("ordinal"),
    ).filter("url is not null")


def lever(payloads: DataFrame) -> DataFrame:
    j = F.col("j")
    rows = payloads.select("slug", F.posexplode(items(F.col("payload"), LEVER, "data", "postings", "results")).alias("pos", "j")).filter(F.coalesce(_text(j["text"]), _text(j["title"])).isNotNull())
    kind = F.lower(F.coalesce(j["workplaceType"], F.lit("")))
    places = join_locations(F.concat(F.array(j["categories"]["location"]), F.coalesce(j["categories"]["allLocations"], F.array().cast("array<string>"))))
    place = F.when((places == "") & (kind == "remote"), "Remote").otherwise(places)
    lists = F.transform(F.coalesce(j["lists"], F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat_ws("\n", x["text"], html_to_text(x["content"])))
    body = F.array_join(F.filter(F.concat(F.array(F.coalesce(j["descriptionPlain"], html_to_text(j["description"]))), lists, F.array(j["additionalPlain"])), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")
    s = j["salaryRange"]
    return rows.select(
        F.lit("lever").alias("source"),
        title_words(F.col("slug")).alias("company"),
        F.coalesce(_text(j["text"]), _text(j["title"])).alias("title"),
        F.coalesce(_text(j["hostedUrl"]), _text(j["applyUrl"]), F.concat(F.lit("https://jobs.lever.co/"), F.col("slug"), F.lit("/"), j["id"])).alias("url"),
        place.alias("location"),
        body.alias("description"),
        F.coalesce(F.timestamp_millis(j["createdAt"]), parse_datetime(j["publishedAt"])).alias("posted_at"),
        F.when((kind == "remote") | F.concat_ws(" ", place, j["text"]).rlike(REMOTE), True).when(kind.isin("onsite", "on-site", "hybrid"), False).alias("remote"),
        F.when(s.isNotNull(), F.concat_ws(" ", s["currency"], F.concat_ws("-", _money(s["min"]), _money(s["max"])), s["interval"])).alias("salary"),
        j["id"].alias("ats_job_id"),
        F.col("pos").cast("long").alias("ordinal"),
    ).filter("url is not null")


#: A country's sign of money; names of countries, normalised, by ISO code.
MONEY = {"gb": "£", "us": "$", "ca": "C$", "au": "A$", "nz": "NZ$", "in": "₹", "za": "R", "sg": "S$", "br": "R$", "mx": "MX$", "ch": "CHF ", "pl": "zł ", "ru": "₽"}
ISO = {
    "austria": "AT", "osterreich": "AT", "belgium": "BE", "belgie": "BE", "belgique": "BE", "brazil": "BR", "brasil": "BR", "canada": "CA", "switzerland": "CH",
    "schweiz": "CH", "suisse": "CH", "czech republic": "CZ", "czechia": "CZ", "germany": "DE", "deutschland": "DE", "denmark": "DK", "danmark": "DK", "spain": "ES",
    "espana": "ES", "finland": "FI", "suomi": "FI", "france": "FR", "united kingdom": "GB", "uk": "GB", "great britain": "GB", "greece": "GR", "hungary": "HU",
    "ireland": "IE", "india": "IN", "italy": "IT", "italia": "IT", "luxembourg": "LU", "mexico": "MX", "netherlands": "NL", "nederland": "NL", "norway": "NO",
    "norge": "NO", "new zealand": "NZ", "poland": "PL", "polska": "PL", "portugal": "PT", "romania": "RO", "russia": "RU", "sweden": "SE", "sverige": "SE",
    "singapore": "SG", "united states": "US", "usa": "US", "australia": "AU", "south africa": "ZA",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def area_location(display: Column, area: Column, country: Column) -> Column:
    """struct(location, country) of an aggregator's place: its name, else its areas, the narrowest first; the country's name is added where it doesn't stand there."""
    areas = F.filter(F.transform(F.coalesce(area, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    name = F.get(areas, F.lit(0))
    shown = F.coalesce(_text(display), F.array_join(F.reverse(areas), ", "))
    there = F.regexp_like(F.lower(shown), F.concat(F.lit(r"(?<!\w)\Q"), F.lower(name), F.lit(r"\E(?!\w)")))
    place = F.when(name.isNull() | there, shown).when(shown == "", name).otherwise(F.concat(shown, F.lit(", "), name))
    return F.struct(place.alias("location"), F.coalesce(F.try_element_at(_map(ISO), normalize_text(name)), F.when(F.length(country) == 2, F.upper(country))).alias("country"))


def adzuna(payloads: DataFrame, most: int = 50) -> DataFrame:
    """payloads: country, payload and, where several are read, `number`, their order. The first `most` results of each count.

    Of results with the same id the first stays; those without an id are told by company, title and place.
    """
    from millrace.operators.dedupe import first_sighting

    j, number = F.col("j"), F.col("number") if "number" in payloads.columns else F.lit(0)
    found = F.slice(items(F.col("payload"), ADZUNA, "results"), 1, most)
    rows = payloads.select("country", number.cast("long").alias("number"), F.posexplode(found).alias("pos", "j"))
    rows = rows.filter(_text(j["title"]).isNotNull() & _text(j["redirect_url"]).isNotNull())
    sign = F.coalesce(F.try_element_at(_map(MONEY), F.lower("country")), F.lit("€"))
    lo, hi = j["salary_min"], j["salary_max"]
    low, high = F.concat(sign, _money(lo)), F.concat(sign, _money(hi))
    pay = F.when(lo.isNull() & hi.isNull(), None).when(hi.isNull(), F.concat(F.lit("from "), low)).when(lo.isNull(), F.concat(F.lit("up to "), high))
    pay = pay.when(low == high, low).otherwise(F.concat(low, F.lit("–"), high))
    place = area_location(j["location"]["display_name"], j["location"]["area"], F.col("country"))
    out = rows.select(
        F.lit("adzuna").alias("source"),
        F.coalesce(j["company"]["display_name"], F.lit("")).alias("company"),
        F.trim(j["title"]).alias("title"),
        F.trim(j["redirect_url"]).alias("url"),
        place["location"].alias("location"),
        place["country"].alias("country"),
        F.coalesce(j["description"], F.lit("")).alias("description"),
        parse_datetime(j["created"]).alias("posted_at"),
        F.when(F.concat_ws(" ", j["location"]["display_name"], j["title"]).rlike(REMOTE), True).alias("remote"),
        F.when(j["salary_is_predicted"] == "1", F.concat(pay, F.lit(" (estimated)"))).otherwise(pay).alias("salary"),
        _text(j["id"]).alias("ats_job_id"),
        "number",
        F.col("pos").cast("long").alias("ordinal"),
    )
    ident = F.coalesce(F.concat(F.lit("id "), "ats_job_id"), dedupe_key(F.col("company"), F.col("title"), F.col("country"), F.col("location")))
    return first_sighting(out.withColumn("ident", ident), ["ident"], ["number", "ordinal"]).drop("ident", "number")


class _Links(HTMLParser):
    """Ordered link and text tokens of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple[str, str, str]] = []
        self.href: str | None = None
        self.label: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag == "a":
            self.end_link()
            self.href = dict(attrs).get("href") or ""

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a":
            self.end_link()

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not self.hidden:
            if self.href is None:
                self.tokens.append(("text", "", text))
            else:
                self.label.append(text)

    def end_link(self):
        if self.href is not None:
            self.tokens.append(("link", self.href, " ".join(self.label)))
        self.href, self.label = None, []


def html_tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, kind, href, text of every token, in Arrow batches."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for k, h in zip(b[key], b[html], strict=True):
                p = _Links()
                p.feed(h or "")
                p.close()
                p.end_link()
                out += [(k, i, *t) for i, t in enumerate(p.tokens)]
            yield pd.DataFrame(out, columns=[key, "pos", "kind", "href", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} bigint, pos int, kind string, href string, text string")
