"""Plans on single records: replies, forms, gates, run statistics, reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.functions import forms, geo, replies
from millrace.operators import gate, health
from millrace.plans import literals
from millrace.plans.core import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def truth(name: str, rows: list[tuple], make, kind: str = "varchar") -> None:
    literals.truth(name, rows, make, kind, QUERIES, ORACLES)


def _form(*fields: tuple[str, str, bool]) -> str:
    return json.dumps([{"tag": t if t in ("select", "textarea") else "input", "type": t, "name": "", "id": "", "label": label, "required": need, "options": []} for label, t, need in fields])


CV = ("Resume/CV", "file", True)
truth(
    "extract_json_literals",
    [('{"a": 1}', '{"a": 1}'), ('so ```json\n{"a": 2,}\n``` ok', '{"a": 2}'), ('```\n{"a": 3', None), ('x {"a": "}"} y', '{"a": "}"}'), ("[1]", None), ("", None), (None, None)],
    replies.extract_json,
)
truth("strip_fences_literals", [("```md\n# A\n```", "# A"), ("plain", "plain"), ("", ""), (None, "")], replies.strip_fences)
truth("europe_hint_literals", [("hours of GMT +2", True), ("EET preferred", True), ("MST only", False), ("Spanish is a plus", False), ("near Ghent", True)], geo.mentions_eu, "boolean")
truth("error_status_literals", [("HTTP 404 for x", 404), ("timeout", None), (None, None)], replies.error_status, "integer")
truth(
    "form_fault_literals",
    [
        (_form(("First name", "text", True), ("Email", "email", True), CV), None),
        (_form(CV, ("Country", "select", False)), "choice 'Country'"),
        (_form(CV, ("Why us", "text", False)), "asks 'Why us' why"),
        (_form(CV, ("Shoe size", "text", True)), "unknown_required 'Shoe size'"),
        (_form(("Name", "text", True)), "no_resume"),
    ],
    lambda c: F.nullif(F.concat_ws(" ", *[forms.form_fault(F.from_json(c, forms.FIELDS_DDL))[x] for x in ("rule", "field", "detail")]), F.lit("")),
)


@query("""select page_id, sha256(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) escaped_sha from pages""")
def escaped_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(gate.escaped(F.col("html")), 256).alias("escaped_sha"))


@query("""select cast(d.doc_id as varchar) as key, case when lang not in ('en', 'de') then 'unsupported application form' when n_chars % 101 < 80 then 'score ' || (n_chars % 101) || ' is below 80'
 when source = 'src0' then 'no PDF' when lang = 'de' then 'PDF is missing' when exists (select 1 from labels l where l.doc_id = d.doc_id) then 'already applied' end reason from documents d""")
def eligible_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    url = F.when(F.col("lang") == "en", "https://jobs.lever.co/x").when(F.col("lang") == "de", "https://boards.greenhouse.io/x").otherwise("https://example.com/x")
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), url.alias("url"), (F.col("n_chars") % 101).alias("score"), F.when(F.col("source") != "src0", F.col("source")).alias("pdf"), (F.col("lang") == "en").alias("pdf_exists"))
    return gate.eligible(rows, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"))).select("key", "reason")


@query("""with d as (select cast(ts as date) as day, event_type, count(*) n from events group by 1, 2), l as (select distinct day from d order by day desc limit 5)
select event_type as source, cast(sum(n) as double) / (select count(*) from l) baseline from d where day in (select day from l) group by 1""")
def run_baselines_events(spark, sf_dir):
    """Each day as a run whose statistics are JSON."""
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))
    counts = F.map_from_entries(F.collect_list(F.struct("event_type", "n")))  # an entry for each type
    runs = days.groupBy(F.col("day").alias("run_id")).agg(F.to_json(F.struct(counts.alias("source_counts"))).alias("stats_json"))
    return health.source_baselines(runs.withColumn("finished_at", F.col("run_id")))


@query("""with t as (select '<tr><td>' || event_id || '</td><td>' || event_type || '</td></tr>' tr, row_number() over (order by event_id desc) n from events)
select '<!doctype html><title>Events &amp; more</title><h1>Events &amp; more</h1>' || chr(10) || '<table>' || chr(10) || string_agg(tr, chr(10) order by n) || chr(10) || '</table>' html from t where n <= 25""")
def report_events(spark, sf_dir):
    return gate.report(table(spark, sf_dir, "events"), "Events & more", ["event_id", "event_type"], [F.desc("event_id")], 25)
