"""Operators on small tables of their own: sources, state, streaming, determinism."""

import json

from pyspark.sql import functions as F

from millrace.operators import state as S
from millrace.operators.cascade import cascade, location_gate
from millrace.operators.dedupe import keep_richest
from millrace.sources import postings as P
from millrace.streaming.tracker import run_available


def test_greenhouse(spark):
    jobs = [
        {"id": 1, "title": "Engineer", "absolute_url": "https://x/1", "location": {"name": "Berlin"}, "first_published": "2026-08-04T07:00:00Z", "updated_at": "2026-08-05T07:00:00Z", "content": "&lt;p&gt;Hi&lt;/p&gt;", "metadata": [{"name": "Salary", "value": "1"}]},
        {"id": 2, "title": None},
        {"id": 3, "title": "Remote dev", "location": {"name": "n/a"}, "offices": [{"name": "Paris"}, {"name": "paris"}, {"location": "Lyon"}]},
    ]
    rows = P.greenhouse(spark.createDataFrame([("acme-co", json.dumps({"jobs": jobs})), ("bad", "{")], "slug string, payload string")).orderBy("ordinal").collect()
    assert [r.ats_job_id for r in rows] == ["1", "3"]
    assert rows[0].company == "Acme Co" and rows[0].description == "Hi" and rows[0].salary == "1" and str(rows[0].posted_at) == "2026-08-04 07:00:00"
    assert rows[1].location == "Paris; Lyon" and rows[1].remote is True and rows[1].url.endswith("/acme-co/jobs/3")


def test_lever_and_adzuna(spark):
    jobs = [{"id": "a", "text": "Dev", "workplaceType": "remote", "categories": {}, "createdAt": 1785826800000, "lists": [{"text": "Needs", "content": "<li>SQL</li>"}], "salaryRange": {"min": 1000.0, "max": 2000.0, "currency": "EUR", "interval": "month"}}]
    r = P.lever(spark.createDataFrame([("acme", json.dumps(jobs))], "slug string, payload string")).first()
    assert (r.location, r.remote, r.salary, r.description) == ("Remote", True, "EUR 1,000-2,000 month", "Needs\nSQL")
    res = [
        {"id": "1", "title": "A", "redirect_url": "u", "salary_min": 70000.0, "salary_max": 70000.0, "salary_is_predicted": "1"},
        {"id": "1", "title": "B", "redirect_url": "u"},
        {"id": "2", "title": "", "redirect_url": "u"},
        {"title": "C", "redirect_url": "u", "location": {"display_name": "Linz", "area": ["Österreich", "Linz"]}},
        {"title": "D", "redirect_url": "u"},
        {"title": "D", "redirect_url": "v"},
        {"title": "E"},
    ]
    rows = P.adzuna(spark.createDataFrame([("de", json.dumps({"results": res}))], "country string, payload string")).collect()
    assert sorted((x.title, x.salary, x.location, x.country, x.url) for x in rows) == [("A", "€70,000 (estimated)", "", "DE", "u"), ("C", None, "Linz, Österreich", "AT", "u"), ("D", None, "", "DE", "u")]
    two = spark.createDataFrame([(2, "gb", json.dumps([{"id": "1", "title": "Late", "redirect_url": "u"}])), (1, "gb", json.dumps({"results": [{"id": "1", "title": "First", "redirect_url": "u"}]}))], "number int, country string, payload string")
    assert [r.title for r in P.adzuna(two).collect()] == ["First"]


def test_wrappers_and_missing_addresses(spark):
    lever = [json.dumps({w: [{"id": "a", "title": "Dev", "publishedAt": "2023-02-03"}]}) for w in ("data", "postings", "results")] + [json.dumps([{"text": "No id"}]), "{", "[]"]
    rows = P.lever(spark.createDataFrame([("acme", x) for x in lever], "slug string, payload string")).collect()
    assert [(r.title, r.url, str(r.posted_at)) for r in rows] == [("Dev", "https://jobs.lever.co/acme/a", "2023-02-03 00:00:00")] * 3
    bare = P.greenhouse(spark.createDataFrame([("acme", json.dumps([{"id": 5, "title": "X"}, {"title": "no address"}]))], "slug string, payload string")).collect()
    assert [r.url for r in bare] == ["https://boards.greenhouse.io/acme/jobs/5"]


def test_html_tokens(spark):
    rows = P.html_tokens(spark.createDataFrame([(1, "<style>x</style>a <a href='/u'>B<a href='/v'>C</a> d"), (2, None)], "id long, html string"), "id", "html").orderBy("pos").collect()
    assert [(r.kind, r.href, r.text) for r in rows] == [("text", "", "a"), ("link", "/u", "B"), ("link", "/v", "C"), ("text", "", "d")]


def test_location_gate(spark):
    df = spark.createDataFrame([(1, "DE", None, False), (2, "US", True, False), (3, None, True, True), (4, None, True, False), (5, None, None, False)], "id int, country string, remote boolean, eu_hint boolean")
    out = cascade(df.withColumn("geo", F.struct("country", "remote", "eu_hint")), [location_gate(F.col("geo"), ["DE", "FR"])])
    assert sorted(r.id for r in out.filter("reject is null").collect()) == [1, 3]


def test_dedupe_is_deterministic(spark):
    df = spark.range(500).selectExpr("id", "id % 37 as k", "id % 5 as rich")
    a = keep_richest(df, "k", [F.col("rich")], "id")
    b = keep_richest(df.repartition(7), "k", [F.col("rich")], "id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_upsert_rules(spark):
    schema = "key string, title string, url string, location string, country string, posted_at int, first_seen int, last_seen int"
    old = spark.createDataFrame([("a", "T", "u", "Berlin", "DE", None, 1, 1), ("b", "T", "u", "x", None, 5, 1, 1)], schema)
    new = spark.createDataFrame([("a", "T2", "v", " ", None, 7, 2, 2), ("c", "N", "w", "y", "FR", None, 2, 2)], schema)
    got = {r.key: tuple(r)[1:] for r in S.upsert_jobs(old, new).collect()}
    assert got == {"a": ("T", "v", "Berlin", "DE", 7, 1, 2, False), "b": ("T", "u", "x", None, 5, 1, 1, False), "c": ("N", "w", "y", "FR", None, 2, 2, True)}


def test_stream_equals_batch(spark, tmp_path):
    schema = "key long, ordinal long, status string, score double"
    rows = [(i % 5, i, "applied" if i in (7, 8) else "digest", float(i) if i % 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    for i in range(4):
        if i:  # a run without new files gives the same again
            got = run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), str(tmp_path / "ck"))
        df.filter(f"ordinal div 10 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), str(tmp_path / "ck"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.fold_status(df).collect()))
    again = run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), str(tmp_path / "ck"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert not run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "none"), str(tmp_path / "ck")).collect()
