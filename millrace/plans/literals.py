"""Truth tables: functions on literal rows. The SQL of a table that SQL can't compute states the expected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import geo as G
from millrace.functions import text as X
from millrace.functions import values as V
from millrace.operators import health as H

QUERIES: dict = {}
ORACLES: dict = {}


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + str(v).replace("'", "''") + "'"


def truth(name: str, rows: list[tuple], make, kind: str = "varchar", queries: dict = QUERIES, oracles: dict = ORACLES) -> None:
    """A query of make(column) over the inputs, and the expected rows as its SQL."""

    def run(spark, sf_dir):
        return spark.createDataFrame([(r[0],) for r in rows], "input string").select("input", make(F.col("input")).alias("output"))

    queries[name] = run
    oracles[name] = "select input, cast(output as " + kind + ") as output from (values " + ", ".join(f"({_sql(a)}, {_sql(b)})" for a, b in rows) + ") t(input, output)"


#: Cases of our own; what each becomes was written down by hand from the rule.
truth("normalize_text_literals", [("Łódź & Çeşme", "lodz cesme"), ("ŒUVRE d’Ærø", "oeuvre d aero"), ("İzmir ﬁt ½", "izmir fit 1 2"), ("Győr\tBacău ně", "gyor bacau ne"), ("a_b  C#", "a_b c"), (None, "")], X.normalize_text)
truth(
    "normalize_company_literals",
    [("Nordlys ApS", "nordlys"), ("Kaffee K.G.", "kaffee"), ("Teplo Sp. Zoo", "teplo"), ("Harbour Holding Group Ltd", "harbour"), ("shop.example Oyj", "shop example"), ("Co. The", "co the"), ("Alder Holdings", "alder holdings")],
    X.normalize_company,
)
truth("normalize_title_literals", [("Potter (part time, x)", "potter"), ("Glass Blower [Night shift]", "glass blower")], X.normalize_title)
truth("slugify_literals", [("Überfahrt — Nr. 7 (neu)", "uberfahrt-nr-7-neu"), ("***", "untitled")], X.slugify)
truth("html_to_text_literals", [("<h2>Tools</h2><ol><li>saw</li><li>file</li></ol>", "Tools\nsaw\nfile"), ("x&nbsp;y<style>z</style>", "x y")], X.html_to_text)
truth("parse_score_literals", [("61.4", 61), ("61.6", 62), ("61/100", 61), ("score: 61", 61), ("60,5", 60), ("175", 100), ("-3", 0), ("", None), ("good", None), (None, None)], V.parse_score, "integer")
truth(
    "parse_datetime_literals",
    [("2023-02-03T04:05:06+02:00", "2023-02-03 02:05:06"), ("2023-02-03", "2023-02-03 00:00:00"), ("1675396800000", "2023-02-03 04:00:00"), ("1675396800", "2023-02-03 04:00:00"), ("", None), ("some day", None), ("99999999999999999999", None)],
    lambda c: F.date_format(V.parse_datetime(c), "yyyy-MM-dd HH:mm:ss"),
)
truth(
    "resolve_locations_literals",
    [("Wien, AT", "AT"), ("Office - Frankfurt am Main", "DE"), ("Aix-en-Provence, France; Remote", "FR"), ("Remote (any) or Brno", "CZ"), ("Austin, TX or Den Haag", "NL"), ("Leeds, UK", "GB"), ("Remote", None), ("Chicago, IL", None)],
    G.country_of,
)
truth("us_detection_literals", [("Salem, OR 97301", True), ("Graz, Austria", False), ("Denver, CO", True), ("Home - U.S.", True), ("focus on us", False)], G.in_us, "boolean")
truth(
    "remote_flag_literals",
    [("telework", True), ("remote telemetry lab", False), ("distributed caching", False), ("distributed crew", True), ("Hybrid, home office days", True), ("part remote", False), ("Graz", False)],
    lambda c: G.is_remote(c, F.lit("")),
    "boolean",
)
truth("weekend_days_literals", [("2023-03-03/2023-03-06", 2), ("2023-03-04/2023-03-07", 1), ("2023-03-07/2023-03-09", 0), ("2023-03-07/2023-03-07", 0)], lambda c: V.weekend_days_between(F.split(c, "/")[0].cast("date"), F.split(c, "/")[1].cast("date")), "integer")


def alerts_union(spark, sf_dir):
    rows = [("ok", True, 20.0, 36.0, 40, 0, 4, [], 0), ("late", True, 50.0, 36.0, 40, 0, 4, ["lever"], 2), ("down", False, 20.0, 36.0, 0, 4, 4, [], 4), ("none", True, 20.0, 36.0, 0, 0, 4, ["lever"], 0)]
    stats = spark.createDataFrame(rows, "run string, digest boolean, gap_hours double, gap_limit double, total int, failed int, active int, silent array<string>, errors int")
    return H.alerts(stats).select("run", "kind", "severity")


def severity_summary(spark, sf_dir):
    a = alerts_union(spark, sf_dir).withColumn("rank", F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2))
    return a.groupBy("run").agg(F.min_by("severity", "rank").alias("worst"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))


QUERIES |= {"alerts_union": alerts_union, "severity_summary": severity_summary}
ORACLES |= {
    "alerts_union": "select * from (values ('late', 'missed_run', 'warning'), ('late', 'source_zero', 'warning'), ('late', 'errors', 'info'), ('down', 'no_digest', 'critical'), ('down', 'all_sources_failed', 'critical'), ('none', 'no_jobs', 'critical')) t(run, kind, severity)",
    "severity_summary": "select * from (values ('late', 'warning', 'errors,missed_run,source_zero'), ('down', 'critical', 'all_sources_failed,no_digest'), ('none', 'critical', 'no_jobs')) t(run, worst, kinds)",
}
