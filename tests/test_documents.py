"""Replies, mail, forms, gates and reports on small cases."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import forms, geo, replies
from millrace.operators import gate, health


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('x\n```json\n{"a": 2}\n```\ny', {"a": 2}),
        ('```\n{"a": 3}\n```', {"a": 3}),
        ('```json\n{"a": 4}', {"a": 4}),
        ('```\n{"a": 0}\n```\n```json\n{"a": 5}\n```', {"a": 5}),
        ('so: {"a": "}{"} done', {"a": "}{"}),
        ('{"a": [1, 2,], "b": ",}",}', {"a": [1, 2], "b": ",}"}),
        ('[{"a": 6}]', {"a": 6}),
        ("{ no } {\"a\": 7}", {"a": 7}),
        ('{"a": 8', None),
        ("", None),
        (None, None),
        ("[1]", None),
    ],
)
def test_recover_json(reply, want):
    got = replies.recover_json(reply)
    assert (got and json.loads(got)) == want


def test_extract_json_column(spark):
    df = spark.createDataFrame([('see {"k": "é"}',), (None,), ("none",)], "reply string")
    assert [r[0] for r in df.select(replies.extract_json(F.col("reply"))).collect()] == ['{"k": "é"}', None, None]


def test_fences_and_tailored(spark):
    rows = [("```md\n# A\n```", "# A"), ("plain", "plain"), (" ```\na\n```\n\n```", "a\n```"), (None, ""), ("```", "")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "t string").select(replies.strip_fences(F.col("t"))).collect()]
    assert got == [b for _, b in rows]
    cases = [("Jo Doe x", "Jo Doe y", "Jo Doe", None), ("Jo Doe", " ", "Jo Doe", "empty"), ("Jo Doe", "x", "Jo Doe", "name lost"), ("x", "xxx", "Jo", "too long"), ("x", "xx", None, None), ("", "long", "Jo", None)]
    df = spark.createDataFrame([c[:3] for c in cases], "b string, t string, n string")
    assert [r[0] for r in df.select(replies.tailored_fault(F.col("b"), F.col("t"), F.col("n"))).collect()] == [c[3] for c in cases]


def test_mail_text():
    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    plain, html = {"mimeType": "text/plain", "body": {"data": enc("p?")}}, {"mimeType": "text/html", "body": {"data": enc("<b>é</b>")}}
    assert replies.mail_text(json.dumps({"payload": {"mimeType": "multipart/mixed", "parts": [plain, {"parts": [html]}]}})) == "<b>é</b>"
    assert replies.mail_text(json.dumps({"payload": plain})) == "p?"
    assert [replies.mail_text(x) for x in (None, "{", "{}", "[]", '{"payload": {}}')] == [None] * 5


def test_markdown(spark):
    text = "# Jo\n\nsome\ntext\n- a\n- b\n  more\n1. c\n\n---\n"
    assert [(b["kind"], b["items"]) for b in replies.markdown_blocks(text)] == [("h1", ["Jo"]), ("para", ["some text"]), ("bullets", ["a", "b more"]), ("ordered", ["c"]), ("rule", [])]
    df = spark.createDataFrame([("C++ & <T> **b** *i* `c` [l](u)",), (None,)], "t string")
    assert df.select(replies.inline_markup(F.col("t"))).first()[0] == 'C++ &amp; &lt;T&gt; <b>b</b> <i>i</i> <code>c</code> <a href="u">l</a>'
    assert [len(r[0]) for r in df.select(replies.parse_blocks(F.col("t"))).collect()] == [1, 0]


def _field(label="", kind="text", tag="input", name="", required=False):
    return {"tag": tag, "type": kind, "name": name, "id": "", "label": label, "required": required, "options": []}


CV = _field("Resume/CV", "file", required=True)
FORMS = [
    ([_field("First name", required=True), _field("Last name"), _field("Email", "email"), CV, _field("I agree to the privacy policy", "checkbox")], None),
    ([CV, _field("Country", "select", "select")], ("choice", "'Country'", None)),
    ([CV, _field("Yes", "radio")], ("radio", "'Yes'", None)),
    ([CV, _field("Notes", "textarea", "textarea", required=True)], ("essay_required", "'Notes'", None)),
    ([CV, _field("Notes", "textarea", "textarea")], ("essay", "'Notes'", None)),
    ([CV, _field("Cover letter", "textarea", "textarea")], None),
    ([CV, _field("Newsletter and privacy", "checkbox")], ("agreement", "'Newsletter and privacy'", None)),
    ([CV, _field("Married?")], ("asks", "'Married?'", "mark")),
    ([CV, _field("", name="expected_salary")], ("asks", "(name=expected_salary)", "expected")),
    ([CV, _field("Shoe size", required=True)], ("unknown_required", "'Shoe size'", None)),
    ([_field("Name")], ("no_resume", None, None)),
    ([CV] * 13, ("too_long", None, "13")),
    ([], ("no_resume", None, None)),
    (None, ("no_resume", None, None)),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(FORMS)], f"i int, f {forms.FIELDS_DDL}")
    assert [r[0] and tuple(r[0]) for r in df.orderBy("i").select(forms.form_fault(F.col("f"))).collect()] == [w for _, w in FORMS]


def test_required(spark):
    rows = [("", None, None, True), ("false", None, "x", False), (None, "true", "", True), (None, None, "Name *", True), (None, None, "a (Required) b", True), (None, None, None, False)]
    df = spark.createDataFrame([r[:3] for r in rows], "r string, a string, l string")
    assert [r[0] for r in df.select(forms.is_required(F.col("r"), F.col("a"), F.col("l"))).collect()] == [r[3] for r in rows]


def test_europe(spark):
    rows = [("hours near GMT + 2", True), ("EET hours", True), ("MST hours", False), ("Spanish is a plus", False), ("Long Island", False), ("the Ghent studio", True), ("Lithuania", True), (None, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    assert [r[0] for r in df.select(geo.mentions_eu(F.col("t"))).collect()] == [r[1] for r in rows]
    got = spark.createDataFrame([("Remote", "Dev (Berlin)", None, ""), ("Boston, MA", "Dev Paris", True, "")], "l string, t string, r boolean, d string").select(geo.resolve(*map(F.col, "ltrd")).alias("g"), geo.country_name(F.lit("DE")).alias("n"), geo.is_eu(F.lit("US")).alias("e")).collect()
    assert [(r.g.country, r.g.remote, r.g.us) for r in got] == [("DE", True, False), (None, True, True)] and (got[0].n, got[0].e) == ("Germany", False)


def test_gate_and_baselines(spark, tmp_path):
    u = "https://jobs.lever.co/a/1"
    rows = [("a", u, 90, "x.pdf", True), ("b", "https://x.com", 90, "x.pdf", True), ("c", u, 70, "x", True), ("d", u, None, "x", True), ("e", u, 90, " ", True), ("f", u, 90, "x", None), ("g", u, 90, "x", True)]
    df, done = spark.createDataFrame(rows, "key string, url string, score int, pdf string, pdf_exists boolean"), spark.createDataFrame([("g",), ("g",)], "key string")
    got = {r.key: r.reason for r in gate.eligible(df, done).collect()}
    assert got == {"a": None, "b": "unsupported application form", "c": "score 70 is below 80", "d": "score missing is below 80", "e": "no PDF", "f": "PDF is missing", "g": "already applied"}
    runs = [(i, "t", json.dumps({"source_counts": {"x": i, **({"y": 10} if i == 9 else {})}})) for i in range(4, 10)] + [(10, None, '{"source_counts": {"x": 99}}'), (11, "t", "{"), (12, "t", "{}")]
    assert sorted(map(tuple, health.source_baselines(spark.createDataFrame(runs, "run_id int, finished_at string, stats_json string")).collect())) == [("x", 7.0), ("y", 2.0)]
    docs = gate.documents(spark.createDataFrame([("k" * 16, "Acme", "Dev", "digest", 80), ("z" * 16, "B", "C", "digest", 10)], "key string, company string, title string, status string, score int"), 70)
    gate.write_documents(docs, str(tmp_path / "d"))
    assert (tmp_path / "d" / "folder=acme-dev-kkkkkkkk").is_dir()
    page = gate.report(docs, "A & B", ["company", "score"], [F.desc("score"), F.col("key")])
    assert "<title>A &amp; B</title>" in page.first().html and "<tr><td>Acme</td><td>80</td></tr>" in page.first().html
    line = gate.summary(spark.createDataFrame([(4, 4, 2, 2, 2, 1)], "fetched int, after_dedupe int, after_filters int, already_seen int, scored int, matches int")).first()[0]
    assert line == "fetched 4 → deduped 4 → filtered 2 → new 0 → scored 2 → matched 1"
