"""Plans of a whole run over the driver tables: addresses, replies, the gate, the ledger, buckets. Their SQL is written from the rules, not from the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import geo as G
from millrace.functions import text as X
from millrace.functions import values as V
from millrace.operators import cascade as C
from millrace.operators import dedupe as D
from millrace.operators import rank as R
from millrace.operators import run as U
from millrace.plans.core import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_URLS = [
    ("https://jobs.lever.co/acme/%", "lever"), ("https://acme.jobs.lever.co/%", "lever"), ("https://jobs.eu.lever.co/acme/%", None), ("https://hire.lever.co/acme/%", None), ("jobs.lever.co/acme/%", "lever"),
    ("https://boards.greenhouse.io/acme/%", "greenhouse"), ("https://job-boards.eu.greenhouse.io/x/%", "greenhouse"), ("https://www.greenhouse.io/blog/%", None), ("https://acme.greenhouse.io/jobs/%", "greenhouse"),
    ("https://greenhouse.io/apply/%", "greenhouse"), ("ftp://boards.greenhouse.io/acme/%", None), ("https://example.com/?to=https://jobs.lever.co/%", None), ("https://notgreenhouse.io/jobs/%", None),
]


@query(
    f"with u as (select page_id, page_id % {len(_URLS)} k from pages) select page_id, case k "
    + " ".join(f"when {i} then '{a}'" for i, (_, a) in enumerate(_URLS) if a)
    + " end ats from u"
)
def detect_ats_pages(spark, sf_dir):
    """Addresses of every kind, one for each page."""
    number = F.col("page_id").cast("string")
    url = F.coalesce(*[F.when(F.col("page_id") % len(_URLS) == i, F.replace(F.lit(u), F.lit("%"), number)) for i, (u, _) in enumerate(_URLS)])
    return table(spark, sf_dir, "pages").select("page_id", V.detect_ats(url).alias("ats"))


@query("""with u as (select page_id, 'https://www.linkedin.com/' || case page_id % 3 when 0 then 'comm/jobs/view/' || (page_id + 7) || '/?refId=a' when 1 then 'jobs/view/dev-at-x-' || (page_id + 1000000) || '?t=1#top'
 else 'comm/company/x' || page_id || '/?u=1' end url from pages)
select page_id, case page_id % 3 when 2 then 'https://www.linkedin.com/company/x' || page_id when 0 then 'https://www.linkedin.com/jobs/view/' || (page_id + 7) else 'https://www.linkedin.com/jobs/view/' || (page_id + 1000000) end canonical from u""")
def network_url_pages(spark, sf_dir):
    n = F.col("page_id")
    url = F.concat(
        F.lit("https://www.linkedin.com/"),
        F.when(n % 3 == 0, F.concat(F.lit("comm/jobs/view/"), n + 7, F.lit("/?refId=a"))).when(n % 3 == 1, F.concat(F.lit("jobs/view/dev-at-x-"), n + 1000000, F.lit("?t=1#top"))).otherwise(F.concat(F.lit("comm/company/x"), n, F.lit("/?u=1"))),
    )
    return table(spark, sf_dir, "pages").select("page_id", X.network_url(url).alias("canonical"))


@query("""select event_id, case event_id % 4 when 0 then 'HTTP 404 (no board of that name)' when 1 then 'HTTP 503' when 2 then 'HTTP 429 (too many requests)' else 'socket closed' end said, event_id % 4 in (1, 2) again from events""")
def describe_errors_events(spark, sf_dir):
    n = F.col("event_id")
    text = F.when(n % 4 == 0, "GET x -> HTTP 404").when(n % 4 == 1, "HTTP: 503 from y").when(n % 4 == 2, " HTTP 429").otherwise("socket closed ")
    return table(spark, sf_dir, "events").select("event_id", V.describe_error(text).alias("said"), V.transient(text).alias("again"))


@query("""select event_id, case event_id % 5 when 0 then event_type when 1 then event_type || '|b' else '' end items from events""")
def string_list_events(spark, sf_dir):
    n, t = F.col("event_id"), F.col("event_type")
    text = F.when(n % 5 == 0, F.concat(F.lit('" '), t, F.lit('"'))).when(n % 5 == 1, F.concat(F.lit('["'), t, F.lit('", 3, {"a": "x"}, " ", null, "b "]'))).when(n % 5 == 2, '{"a": 1}').when(n % 5 == 3, "not json")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(V.string_list(text), "|").alias("items"))


@query("""select event_id, case event_id % 6 when 0 then event_type when 1 then event_type || 'b' when 2 then 'why' end as reply,
 case event_id % 6 when 3 then 'down' when 4 then 'no choices' when 5 then 'no JSON' end error from events""")
def reply_text_events(spark, sf_dir):
    n, t = F.col("event_id"), F.col("event_type")

    def message(content):
        return F.concat(F.lit('{"choices": [{"message": {"content": '), content, F.lit("}}]}"))

    text = (
        F.when(n % 6 == 0, message(F.concat(F.lit('"'), t, F.lit('"'))))
        .when(n % 6 == 1, message(F.concat(F.lit('[{"type": "text", "text": "'), t, F.lit('"}, "b"]'))))
        .when(n % 6 == 2, '{"choices": [{"message": {"content": null, "reasoning": "why"}}]}')
        .when(n % 6 == 3, '{"error": {"message": "down"}}')
        .when(n % 6 == 4, '{"choices": []}')
        .otherwise("{")
    )
    out = V.reply_text(text)
    return table(spark, sf_dir, "events").select("event_id", out["text"].alias("reply"), out["error"].alias("error"))


@query("""select event_id, case when epoch_us(ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end || '+00:00' said, true same from events""")
def iso_text_events(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    said = V.iso_text(ts)
    return table(spark, sf_dir, "events").select("event_id", said.alias("said"), (V.parse_iso(said) == ts).alias("same"))


@query("""select doc_id, case doc_id % 3 when 0 then 'a%20b/' || doc_id || '.md' when 1 then 'cv/%C3%A9%2B' || doc_id || '.md' else 'file:///other/x~' || doc_id end href from documents""")
def artifact_href_documents(spark, sf_dir):
    n = F.col("doc_id")
    path = F.when(n % 3 == 0, F.concat(F.lit("a b/"), n, F.lit(".md"))).when(n % 3 == 1, F.concat(F.lit("/out/cv/é+"), n, F.lit(".md"))).otherwise(F.concat(F.lit("/other/x~"), n))
    return table(spark, sf_dir, "documents").select("doc_id", V.artifact_href(path, "/out").alias("href"))


@query("""select event_id, case event_id % 5 when 0 then 'DE' when 1 then 'FR' when 2 then 'NL' when 3 then 'GB' end iso from events""")
def ngram_places_events(spark, sf_dir):
    """The longest name wins over a shorter one before it; words are never cut."""
    n = F.col("event_id")
    text = F.when(n % 5 == 0, "office frankfurt am main paris").when(n % 5 == 1, "lyon berlin").when(n % 5 == 2, "berlin den haag").when(n % 5 == 3, "milton keynes oslo").otherwise("parisian berliner")
    return table(spark, sf_dir, "events").select("event_id", G.ngram_hit(text, G.PLACES).alias("iso"))


@query("""select user_id as key, min(event_id) as first_id, coalesce(arg_min(case event_id % 3 when 0 then null when 1 then ' ' else event_type end, event_id) filter (event_id % 3 = 2), null) company from events group by 1""")
def back_filled_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("company", F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 3 == 1, " ").otherwise(F.col("event_type")))
    return D.back_filled(e, "user_id", ["event_id"], ["company"]).select(F.col("user_id").alias("key"), F.col("event_id").alias("first_id"), "company")


@query("""with r as (select user_id, event_type, row_number() over (partition by user_id order by event_id) r, count(*) over (partition by user_id) n from events)
select user_id, any_value(n) n, string_agg(event_type, '; ' order by r) filter (r <= 3) || case when any_value(n) > 3 then '; ...' else '' end "some" from r group by 1""")
def some_messages_events(spark, sf_dir):
    return U.some_of(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""select event_id, lead(event_type) over w as next, coalesce(array_to_string(list(event_type) over (partition by user_id order by event_id rows between 1 following and 6 following), ' '), '') ahead
 from events window w as (partition by user_id order by event_id)""")
def following_events(spark, sf_dir):
    return U.following(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "next", "ahead")


@query("""with b as (select event_id, value, case event_type when 'purchase' then 'auto_applied' when 'click' then 'needs_click' when 'error' then 'failed' when 'view' then 'below' else 'other' end bucket from events)
select event_id, bucket, cast(row_number() over (partition by bucket order by case when bucket in ('needs_click', 'below', 'other') then value end desc, event_id) as int) place from b""")
def outcome_buckets_events(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for x in ("purchase", "applied", "click", "digest", "error", "apply_failed", "view", "scored_below")])
    e = table(spark, sf_dir, "events").withColumn("status", F.coalesce(F.try_element_at(status, F.col("event_type")), F.lit("new")))
    return R.buckets(e, "status", "value", "event_id").select("event_id", "bucket", "place")


@query("select source, count(*) n from documents where source in ('src0', 'src1', 'src2') group by 1 union all select 'never', 0")
def source_counts_documents(spark, sf_dir):
    docs = U.of_sources(table(spark, sf_dir, "documents"), ["src0", "src1", "src2"])
    return U.source_counts(docs, ["never", *[r.source for r in docs.select("source").distinct().collect()]])


@query("""with e as (select user_id as run_id, min(ts) filter (event_type = 'signup') started_at, max(ts) filter (event_type = 'purchase') finished_at, arg_max(props, ts) filter (event_type = 'purchase') stats_json from events group by 1)
select run_id, epoch_us(started_at) started_us, epoch_us(finished_at) finished_us, stats_json from e""")
def run_ledger_events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "finished")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.col("props").alias("stats_json"))
    return U.ledger(e).select("run_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"), "stats_json")


@query("""with b as (select event_type as source, avg(n) baseline from (select event_type, cast(ts as date) d, count(*) n from events group by 1, 2) group by 1)
select source from b where baseline >= 3 and source not in ('click', 'view')""")
def silent_sources_events(spark, sf_dir):
    """Baselines of all types against a day on which only clicks and views came in, with a zero for one more."""
    e = table(spark, sf_dir, "events")
    base = e.groupBy(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n")).groupBy("source").agg(F.avg("n").alias("baseline"))
    today = U.source_counts(e.filter("event_type in ('click', 'view')").select(F.col("event_type").alias("source")), ["error"])
    return U.silent(base, today, [r.source for r in base.select("source").collect()]).select("source")  # one row a type


_NOW = "2024-02-01 00:00:00"
_GATE_SQL = f"""
with s as (select user_id, arg_max(event_type, event_id) status, max(ts) updated from events group by 1),
d as (select d.doc_id, d.lang, d.doc_id % 100 k, s.status, s.updated, d.lang = 'fr' rejected from documents d left join s on s.user_id = d.doc_id),
g as (select *, case when rejected then 'filtered' when status = 'purchase' then 'seen' when status in ('click', 'view') and updated >= timestamp '{_NOW}' - interval 3 day then 'seen' else 'surfaced' end what from d)
"""


def _gated(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.max(F.col("ts").cast("timestamp")).alias("updated"))
    status = F.when(F.col("t") == "purchase", "applied").when(F.col("t").isin("click", "view"), "digest").otherwise("new")
    state = e.select(F.col("user_id").cast("string").alias("key"), status.alias("status"), "updated")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("title"), F.col("lang").alias("url"), F.lit("x").alias("location"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("timestamp").alias("posted_at"), "lang")
    decided = C.cascade(rows, [C.rule("language", F.col("lang") == "fr", F.col("lang"))]).drop("lang")
    seen = rows.drop("lang").filter("key % 2 = 0").select("*", F.lit("2024-01-01").cast("timestamp").alias("first_seen"), F.lit("2024-01-01").cast("timestamp").alias("last_seen"))
    return U.gate(decided, seen, state, F.lit(_NOW).cast("timestamp"), 3)


@query(_GATE_SQL + "select cast(doc_id as varchar) as key from g where coalesce(what, 'surfaced') = 'surfaced'")
def gate_surfaced_documents(spark, sf_dir):
    return _gated(spark, sf_dir).surfaced.select("key")


@query(_GATE_SQL + "select count(*) filter (what = 'seen') already_seen from g")
def gate_already_seen_documents(spark, sf_dir):
    return _gated(spark, sf_dir).already_seen


@query(_GATE_SQL + "select cast(doc_id as varchar) as key, 'filtered' status, 'fr' detail from g where rejected and coalesce(status, '') <> 'purchase'")
def gate_outcomes_documents(spark, sf_dir):
    return _gated(spark, sf_dir).outcomes.select("key", "status", "detail")


@query("select cast(doc_id as varchar) as key, doc_id % 2 = 1 is_new, case when doc_id % 2 = 0 then '2024-01-01' else '2024-02-01' end first_day from documents")
def gate_jobs_documents(spark, sf_dir):
    return _gated(spark, sf_dir).jobs.select("key", "is_new", F.date_format("first_seen", "yyyy-MM-dd").alias("first_day"))


@query("""select doc_id, case when lang = 'fr' then '' when doc_id % 2 = 0 then 'XX' else upper(lang) end country, case when lang = 'fr' or doc_id % 3 = 0 then doc_id % 3 = 0 else true end remote from documents""")
def stamped_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("country", F.when((F.col("doc_id") % 2 == 0) & (F.col("lang") != "fr"), "XX").otherwise("")).withColumn("remote", F.when(F.col("doc_id") % 3 == 0, True).when(F.col("lang") == "fr", False))
    return C.stamped(docs, F.col("lang") != "fr", F.upper("lang"), F.lit(True)).select("doc_id", "country", "remote")


@query("""select doc_id, coalesce(c.n, initcap_slug) company from (select doc_id, source, 'Src ' || substr(source, 4) initcap_slug from documents) d
 left join (values ('src0', 'Zero & Co'), ('src2', 'Two Ltd')) c(s, n) on c.s = d.source""".replace("initcap_slug) company", "d.initcap_slug) company"))
def company_override_documents(spark, sf_dir):
    from millrace.sources.boards import watchlist, with_company

    entries = watchlist(spark, "lever", [{"slug": "https://jobs.lever.co/src0/", "company": "Zero & Co"}, "src1", {"board": "src2", "display_name": " Two Ltd "}, {"slug": "SRC2", "company": "no"}])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("slug"), F.concat(F.lit("Src "), F.substring("source", 4, 99)).alias("company"))
    return with_company(docs, entries).select("doc_id", "company")


@query("select user_id, bool_or(event_type = 'purchase') as some, bool_and(event_type = 'purchase') as every from events group by 1")
def any_of_events(spark, sf_dir):
    return U.any_of(table(spark, sf_dir, "events").withColumn("f", F.when(F.col("event_type") == "purchase", True)), "user_id", "f")


@query("select event_type, count(*) n, row_number() over (order by count(*) desc, event_type) place from events group by 1")
def counts_in_order_events(spark, sf_dir):
    from pyspark.sql import Window

    counts = R.by_count(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("long"))  # one row a type


@query("""select page_id as message, cast(page_id + 1000000 as varchar) posting, 'Dev ' || page_id title, 'Firm' || page_id || ' Ltd' company, case when page_id % 2 = 0 then 'Remote' else 'Graz' end as location,
 'https://www.linkedin.com/jobs/view/' || (page_id + 1000000) url, case when page_id % 2 = 0 then true end remote from pages""")
def mail_rows_pages(spark, sf_dir):
    """A mail for each page: a card whose company stands at its second place only, noise between, another card's link after."""
    from millrace.sources.mail import mail_rows

    n = F.col("page_id").cast("string")
    link = F.concat(F.lit("<a href='https://www.linkedin.com/comm/jobs/view/"), F.col("page_id") + 1000000, F.lit("/?t=1'>"))
    place = F.when(F.col("page_id") % 2 == 0, "Remote").otherwise("Graz")
    card = F.concat(link, F.lit("</a>"), link, F.lit("Dev "), n, F.lit("</a>"))
    html = F.concat(F.lit("<p>Your job alert</p>"), card, F.lit("<p>Promoted</p><p>3 days ago</p>"), card, F.lit("<td>Firm"), n, F.lit(" Ltd · "), place, F.lit("</td><a href='/x'>See all jobs</a>"))
    mails = table(spark, sf_dir, "pages").select(F.col("page_id").alias("message"), html.alias("html"), F.lit(None).cast("timestamp").alias("received_at"))
    return mail_rows(mails).select("message", "posting", "title", "company", "location", "url", "remote")


@query("""select doc_id, cast(case when doc_id % 4 < 2 then n_chars % 101 end as int) score, case when doc_id % 4 = 0 then lang when doc_id % 4 = 1 then lang || '|b' else '' end reasons,
 case doc_id % 4 when 2 then 'no JSON in the reply' when 3 then 'HTTP 400 bad' end error from documents""")
def scored_offline_documents(spark, sf_dir):
    """Replies of a scorer without a network: fenced, plain, broken, failing."""
    from millrace.operators import scoring as S

    def complete(text: str) -> str:
        number, score, lang = text.split("|")
        kind = int(number) % 4
        if kind == 3:
            raise ValueError("HTTP 400 bad")
        plain = '{"score": "%s/100", "reasons": "%s"}' % (score, lang)
        listed = 'Sure: {"score": %s, "reasons": ["%s", 1, "b"]} done' % (score, lang)
        return ["```json\n" + plain + "\n```", listed, "I cannot"][kind]

    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", "doc_id", F.col("n_chars") % 101, "lang").alias("ask"))
    return S.scored(S.completed(docs, "doc_id", "ask", complete)).select("doc_id", "score", F.array_join("reasons", "|").alias("reasons"), "error")
