"""Live readers over recorded answers, settings, alerts, and the run's operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import run as U
from millrace.operators import settings as T
from millrace.operators.cascade import cascade, from_future, rule, stale, too_short
from millrace.operators.rank import cap
from millrace.sources import boards as B
from millrace.sources import postings as P


def test_boards(spark):
    entries = B.watchlist(spark, "lever", ["https://jobs.lever.co/acme/", {"slug": "zeta", "company": "Zeta Works"}, "ACME", {"name": "gone"}, "busy", {}, ""])
    assert [tuple(r) for r in entries.collect()] == [("lever", "acme", None), ("lever", "zeta", "Zeta Works"), ("lever", "gone", None), ("lever", "busy", None)]
    got = B.read_board(spark, entries, "lever", transport="tests.transport:boards", backoff="0", tries="2")
    assert {(r.slug, r.error) for r in got.collect()} == {("acme", None), ("zeta", None), ("gone", "HTTP 404"), ("busy", "connection failed: reset")}
    rows = P.lever(got.filter("error is null"))
    named = B.with_company(rows.withColumn("slug", F.element_at(F.split("title", " "), -1)), entries)
    assert {(r.title, r.company) for r in named.collect()} == {("Baker at acme", "Acme"), ("Baker at zeta", "Zeta Works")}
    other = B.watchlist(spark, "greenhouse", {"mill": "The Mill"})
    rows = P.greenhouse(B.read_board(spark, other, "greenhouse", transport="tests.transport:boards")).collect()
    assert [(r.title, r.description) for r in rows] == [("Miller at mill", "true")]
    assert not B.read_board(spark, B.watchlist(spark, "lever", None), "lever").collect()


def test_search(spark):
    got = B.read_search(spark, ["uk", "FR", "gb", "de"], ["baker", "odd", "smith"], transport="tests.transport:search", backoff="0", most="2", where=" Linz ", distance_km="5").orderBy("number").collect()
    assert [(r.country, r.query, r.error) for r in got] == [("gb", "baker", None), ("gb", "odd", "HTTP 500"), ("gb", "smith", None), ("fr", "baker", "HTTP 401"), ("de", "baker", None), ("de", "odd", "HTTP 500"), ("de", "smith", None)]
    assert '"distance", "results_per_page", "what", "where"' in got[0].payload and '"max_days_old"' not in got[0].payload
    rows = P.adzuna(spark.createDataFrame([(r.number, r.country, r.payload) for r in got], "number long, country string, payload string")).collect()
    # one row for the id, and one a country for those told by company, title and place
    assert sorted((r.title, r.country) for r in rows) == [("baker gb", "GB"), ("no id", "DE"), ("no id", "GB")]
    leak = B.read_search(spark, ["de"], ["x"], transport="tests.transport:leaky", backoff="0", app_key="sesame123").first()
    assert "sesame" not in leak.error and "***" in leak.error


def test_request_tries_again():
    answers, waits = [(429, ""), (503, ""), (200, "ok")], []
    assert B.request(lambda u, p: answers.pop(0), "u", {}, 3, 2.0, waits.append) == ("ok", None) and waits == [2.0, 4.0]
    calls = []
    assert B.request(lambda u, p: (calls.append(1), (403, ""))[1], "u", {}, 3, 0, waits.append) == (None, "HTTP 403") and len(calls) == 1
    assert B.search_params("x", ("i", "k"), 80, 2, "", 9) == {"app_id": "i", "app_key": "k", "results_per_page": 50, "what": "x", "content-type": "application/json", "max_days_old": 2}


@pytest.mark.parametrize("given,slug", [("acme", "acme"), ("https://boards.greenhouse.io/acme/jobs/1", "acme"), ("www.lever.co/x/", "x"), ("jobs.lever.co/y", "y"), (None, ""), (" a/ ", "a")])
def test_slugs(given, slug):
    assert B.clean_slug(given) == slug


def test_settings(tmp_path):
    base = {"a": {"b": 1, "c": [1, 2]}, "d": 3}
    assert T.merged(base, {"a": {"c": [9], "b": None, "e": None}, "d": {"x": 1}}) == {"a": {"b": 1, "c": [9], "e": None}, "d": {"x": 1}} and base["a"]["c"] == [1, 2]
    assert T.from_environment({"keys": {"x": "old"}}, {"X": "keys.x", "Y": "keys.y", "Z": "z"}, {"X": "new", "Y": " "}) == {"keys": {"x": "new"}}
    assert T.terms(" A  b ") == ["a b"] and T.terms(["x", " ", 5]) == ["x", "5"] and T.terms(None) == [] and T.countries("de") == ["DE"]
    assert (T.number("7", 1, int), T.number(True, 2), T.number("x", 3), T.number(None, 4)) == (7, 2, 3, 4)
    good = {"applicant": {"name": "N", "email": "n@x.org"}, "keys": {"anthropic": "k"}, "sources": {"lever": True}, "watchlist": {"lever": ["a"]}}
    assert T.problems(good) == []
    assert T.problems({}) == ["missing applicant.name", "missing applicant.email", "missing keys.anthropic", "missing sources"]
    bad = T.merged(good, {"applicant": {"email": "n@x"}, "scoring": {"threshold": True, "model": "m"}, "freshness": {"max_age_hours": 0}, "llm": {"provider": "openrouter"}, "sources": {"adzuna": True, "greenhouse": True}, "apply": {"enabled": True, "dry_run": False}})
    assert T.problems(bad) == ["malformed applicant.email", "missing keys.openrouter", "unqualified scoring.model", "out of range scoring.threshold", "out of range freshness.max_age_hours", "missing keys.adzuna_app_id", "missing watchlist.greenhouse", "missing applicant.phone"]
    told = {"notify": {"channels": {"console": True, "file": {"enabled": False}, "command": " ", "email": {"to": "x"}}}}
    assert T.channels(told) == ["console", "email"] and T.channels({"notify": {"channels": 3}}) == []
    seen = []
    assert T.send(["a"], told, {"console": lambda a, s: seen.append((a, s)), "email": lambda a, s: 1 / 0}) == {"console": None, "email": "ZeroDivisionError: division by zero"} and seen == [(["a"], True)]
    write, path = T.alert_file(str(tmp_path / "alert")), tmp_path / "alert"
    write(["x", "y"], None)
    assert path.read_text() == "x\ny\n"
    write([], None)
    write([], None)
    assert not path.exists()


def test_cascade_limits(spark):
    now = F.lit(dt.datetime(2024, 1, 10, 12)).cast("timestamp")
    rows = [(1, dt.datetime(2024, 1, 9, 12)), (2, dt.datetime(2024, 1, 9, 11, 59)), (3, dt.datetime(2024, 1, 10, 13)), (4, dt.datetime(2024, 1, 10, 15)), (5, None)]
    df = spark.createDataFrame(rows, "id int, at timestamp")
    got = cascade(df, stale(F.col("at"), now, 24)).select("id", "reject.category", from_future(F.col("at"), now).alias("ahead")).orderBy("id").collect()
    assert [(r.category, r.ahead) for r in got] == [(None, False), ("stale", False), (None, False), (None, True), ("undated", False)]
    texts = spark.createDataFrame([(1, "\n\t abc  "), (2, "abcd"), (3, None)], "id int, t string").orderBy("id")
    assert [r[0] for r in texts.select(too_short(F.col("t"), 4)["category"]).collect()] == ["too_short", None, "too_short"]
    assert [r[0] for r in texts.select(too_short(F.col("t"), 0)["category"]).collect()] == [None] * 3
    ranked = cap(spark.range(10).withColumn("s", F.col("id") % 3), "id", [F.desc("s"), F.col("id")], 4).orderBy("id").collect()
    assert [r.id for r in ranked if r.detail == ""] == [2, 5, 8, 1] or sorted(r.id for r in ranked if r.detail == "") == [1, 2, 5, 8]


def test_run(spark, tmp_path):
    assert U.active(["a", "b", "c"], None) == ["a", "b", "c"] and U.active(["a", "b"], [" B ", "z", ""]) == ["b"]
    at = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "runs")
    U.start(spark, 1, at).write.mode("append").parquet(path)
    U.start(spark, 2, at).write.mode("append").parquet(path)
    U.finish(spark, 1, at + dt.timedelta(hours=1), '{"fetched": 3}').write.mode("append").parquet(path)
    got = {r.run_id: (r.finished_at, r.stats_json) for r in U.ledger(spark.read.parquet(path)).collect()}
    assert got == {1: (at + dt.timedelta(hours=1), '{"fetched": 3}'), 2: (None, None)}
    steps = [lambda d: d.withColumn("b", F.lit(1)), lambda d: d.withColumnRenamed("b", "c")]
    df, version = U.migrated(spark.range(1), 0, steps)
    again, same = U.migrated(df, version, steps)
    assert df.columns == again.columns == ["id", "c"] and version == same == 2
    alerts = spark.createDataFrame([("r", "info", 0), ("r", "critical", 2), ("r", "critical", 1), ("r", "warning", 3)], "run string, severity string, seq int")
    assert [(r.severity, r.seq) for r in U.ranked_alerts(alerts).orderBy("place").collect()] == [("critical", 1), ("critical", 2), ("warning", 3), ("info", 0)]
    # a row that was applied to stays so, though it is rejected now
    rows = spark.createDataFrame([("a", "en"), ("b", "fr"), ("c", "fr"), ("d", "en")], "key string, lang string").selectExpr("*", "'t' title", "'u' url", "'' location", "cast(null as string) country", "cast(null as timestamp) posted_at")
    state = spark.createDataFrame([("b", "applied", at), ("d", "digest", at)], "key string, status string, updated timestamp")
    old = rows.filter("key = 'd'").selectExpr("key", "title", "url", "location", "country", "posted_at", "timestamp'2023-12-01' first_seen", "timestamp'2023-12-01' last_seen")
    g = U.gate(cascade(rows, [rule("language", F.col("lang") == "fr", F.col("lang"))]), old, state, F.lit(at).cast("timestamp"))
    assert [r.key for r in g.surfaced.collect()] == ["a"] and g.already_seen.first()[0] == 1
    assert [tuple(r)[:3] for r in g.outcomes.collect()] == [("c", "filtered", "fr")] and g.jobs.count() == 4


def test_nulls_in_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("[]",), ("3",)], "c string")
    assert [r[0] for r in df.select(V.string_list(F.col("c"))).collect()] == [[], [], [], []]
    assert [r[0].error for r in df.select(V.reply_text(F.col("c"))).collect()] == ["no JSON", "no JSON", "no choices", "no choices"]
    assert [r[0] for r in df.select(V.detect_ats(F.col("c"))).collect()] == [None] * 4


def test_mail(spark):
    from millrace.sources import mail as M

    card = "<a href='https://www.linkedin.com/jobs/view/{0}?x=1'>{1}</a>"
    html = card.format(1234567, "Cook") + "<p>Inn at Sea</p><p>12 applicants</p><p>" + "x" * 90 + "</p><p>a@b.org</p><p>Varna, remote</p>" + card.format("baker-at-x-7654321", "Baker") + card.format(99, "")
    rows = {r.posting: r for r in M.mail_rows(spark.createDataFrame([(1, html, dt.datetime(2024, 1, 1)), (2, None, None)], "message long, html string, received_at timestamp")).collect()}
    assert (rows["1234567"].company, rows["1234567"].location, rows["1234567"].remote) == ("Inn at Sea", "Varna, remote", True)
    assert (rows["7654321"].company, rows["7654321"].url) == ("", "https://www.linkedin.com/jobs/view/7654321") and len(rows) == 2
    df = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "bad")], "posting string, url string")

    def fetch(url):
        return {"u1": "one", "u2": None}[url]

    assert {r.posting: r.description for r in M.with_pages(df, fetch).collect()} == {"a": "one", "b": "", "c": ""}
    assert {r.posting: r.description for r in M.with_pages(df, fetch, most=0).collect()} == {"a": "", "b": "", "c": ""}


def test_scoring(spark):
    from millrace.operators import scoring as S

    df = spark.createDataFrame([("x" * 9, None, " ")], "d string, c string, l string")
    text = df.select(S.prompt("A cook.", F.lit("Chef"), F.col("c"), F.col("l"), F.col("d"), 5)).first()[0]
    assert "Title: Chef\nCompany: unknown\nPlace: unknown\nDescription:\nxxxxx\n" in text and "A cook." in text
    calls = []

    def flaky(_):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("HTTP 503")
        return '{"score": 7}'

    got = S.scored(S.completed(spark.createDataFrame([(1, "q")], "k int, q string").coalesce(1), "k", "q", flaky, wait=0)).first()
    assert (got.score, got.error, got.reasons) == (7, None, [])


def test_probe(spark):
    entries = B.watchlist(spark, "lever", ["acme", "gone", "still"])
    got = B.read_board(spark, entries, "lever", transport="tests.transport:boards", backoff="0")
    rows = P.lever(got.filter("error is null and slug <> 'still'")).withColumn("slug", F.element_at(F.split("title", " "), -1))
    assert {tuple(r) for r in U.probed(entries, got, rows).collect()} == {("lever", "acme", True, 1, None), ("lever", "gone", False, 0, "HTTP 404"), ("lever", "still", True, 0, None)}
