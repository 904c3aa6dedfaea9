"""Plans on documents and pages: normalising, keys, dedup, the filter cascade, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import values as V
from millrace.operators import cascade as C
from millrace.operators import rank as R
from millrace.operators.dedupe import keep_richest

QUERIES: dict = {}
ORACLES: dict = {}

EXCLUDE, INCLUDE, LANGS, MIN_CHARS = ["token", "idiot", "clown"], ["the", "de", "der", "el", "la"], ["en", "de", "fr"], 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a plan under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: P1 as SQL over a column, by the database's own removal of accents; signs that are spelt out stand here by themselves.
_SPELT = "æ ae œ oe ß ss þ th ø o ł l đ d ð d ı i ħ h ﬁ fi ﬂ fl ĳ ij º o ª a ² 2 ³ 3 ¹ 1 µ μ".split()


def norm_sql(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    for x, y in zip(_SPELT[::2], _SPELT[1::2], strict=True):
        out = f"replace({out}, '{x}', '{y}')"
    return rf"trim(regexp_replace(strip_accents({out}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


N = norm_sql("text")


@query(f"select doc_id, sha256({N}) norm_sha, cast(len(string_split({N}, ' ')) as int) n_tokens from documents")
def normalize_documents(spark, sf_dir):
    n = X.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(n, 256).alias("norm_sha"), F.size(F.split(n, " ")).alias("n_tokens"))


def _contains(p: str) -> str:
    return f"contains(' ' || n || ' ', ' {p} ')"


@query(f"with d as (select doc_id, {N} n from documents) select doc_id, case " + " ".join(f"when {_contains(p)} then '{p}'" for p in EXCLUDE) + " end as first_hit from d")
def phrase_match_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_phrase(X.normalize_text(F.col("text")), EXCLUDE).alias("first_hit"))


@query(f"select doc_id, substr(sha256(source || '|' || {N}), 1, 16) key from documents")
def hash_keys_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.short_hash(F.col("source"), X.normalize_text(F.col("text"))).alias("key"))


@query(r"""
with a as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style[^>]*>.*?</style\s*>', ' ', 'g') h from pages),
b as (select page_id, regexp_replace(regexp_replace(h, '(?i)<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?h[1-6]|/?tr|/?table|/?section|/?article|/?header|/?footer)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') h from a),
c as (select page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(160), ' ') h from b),
d as (select page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) t from c)
select page_id, sha256(t) text_sha, cast(length(t) as int) n_chars from d""")
def html_to_text_pages(spark, sf_dir):
    t = X.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.sha2("t", 256).alias("text_sha"), F.length("t").alias("n_chars"))


@query("""
with h as (select doc_id, text, text[1:200] h from documents), i as (select *, strpos(reverse(h), ' ') r from h)
select doc_id, case when length(text) <= 200 then text else rtrim(case when r > 0 and 200 - r >= 140 then h[1 : 200 - r] else h end) || '…' end short from i""")
def truncate_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 200).alias("short"))


@query(rf"""with s as (select doc_id, regexp_replace(regexp_replace({N}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') s from documents)
select doc_id, coalesce(nullif(regexp_replace(s[1:60], '-+$', ''), ''), 'untitled') slug from s""")
def slugify_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query(r"select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') canonical, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) host from pages")
def canonical_url_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"), V.url_host(F.col("url")).alias("host"))


def _deduped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    docs = docs.join(labelled, "doc_id", "left").withColumn("has_label", F.coalesce("has", F.lit(0))).drop("has")
    docs = docs.withColumn("key", X.short_hash(X.normalize_text(F.col("text"))))
    return keep_richest(docs, "key", [F.col("has_label"), F.length("text")], "doc_id")


DEDUP_SQL = f"""
with k as (select d.*, substr(sha256({N}), 1, 16) key, case when exists (select 1 from labels l where l.doc_id = d.doc_id) then 1 else 0 end has_label from documents d),
u as (select * from (select *, row_number() over (partition by key order by has_label desc, length(text) desc, doc_id) r from k) where r = 1),
"""


@query(DEDUP_SQL + "z as (select 1) select doc_id, key, cast(has_label as int) has_label from u")
def dedupe_documents(spark, sf_dir):
    return _deduped(spark, sf_dir).select("doc_id", "key", "has_label")


def _cascaded(spark, sf_dir):
    return C.cascade(
        C.once(_deduped(spark, sf_dir), "norm", X.normalize_text(F.col("text"))),
        [
            C.excluded("text_excluded", F.col("norm"), EXCLUDE),
            C.rule("language", ~F.col("lang").isin(LANGS), F.col("lang")),
            C.required("missing_keyword", F.col("norm"), INCLUDE),
            C.too_short(F.col("text"), MIN_CHARS),
        ],
    )


REJECT_SQL = (
    DEDUP_SQL
    + f"n as (select *, {N} n from u), j as (select *, case "
    + " ".join(f"when {_contains(p)} then 'text_excluded'" for p in EXCLUDE)
    + f" when lang not in ({', '.join(repr(x) for x in LANGS)}) then 'language' when not ("
    + " or ".join(_contains(p) for p in INCLUDE)
    + f") then 'missing_keyword' when length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) < {MIN_CHARS} then 'too_short' end category from n) "
)


@query(REJECT_SQL + "select doc_id, category from j where category is not null")
def reject_reasons_documents(spark, sf_dir):
    return _cascaded(spark, sf_dir).filter("reject is not null").select("doc_id", F.col("reject.category").alias("category"))


@query(REJECT_SQL + "select category, count(*) n from j where category is not null group by 1")
def reject_counts_documents(spark, sf_dir):
    return C.counts(_cascaded(spark, sf_dir))


@query(REJECT_SQL + "select doc_id, source from j where category is null")
def kept_documents(spark, sf_dir):
    return _cascaded(spark, sf_dir).filter("reject is null").select("doc_id", "source")


@query(REJECT_SQL + ", d as (select count(*) fetched from documents) select fetched, (select count(*) from j) deduped, (select count(*) from j where category is null) filtered from d")
def funnel_documents(spark, sf_dir):
    kept = _cascaded(spark, sf_dir).agg(F.count("*").alias("deduped"), F.count_if(F.col("reject").isNull()).alias("filtered"))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("fetched")).join(F.broadcast(kept))  # one row by one row


SCORE_SQL = f"with s as (select doc_id, least(100, {' + '.join(f'(length(n) - length(replace(n, {chr(39)}{p}{chr(39)}, {chr(39)}{chr(39)}))) // {len(p)}' for p in INCLUDE)}) score from (select doc_id, {N} n from documents)) "


def _scored(spark, sf_dir):
    n = F.col("n")
    hits = sum((F.floor((F.length(n) - F.length(F.replace(n, F.lit(p), F.lit("")))) / len(p)) for p in INCLUDE[1:]), F.floor((F.length(n) - F.length(F.replace(n, F.lit(INCLUDE[0]), F.lit("")))) / len(INCLUDE[0])))
    docs = table(spark, sf_dir, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("n"))
    return docs.select("doc_id", F.least(F.lit(100), hits).cast("int").alias("score"))


@query(SCORE_SQL + "select doc_id, cast(score as int) score, case when score >= 90 then '90' when score >= 80 then '80' when score >= 70 then '70' else 'low' end band, case when score >= 70 then 'digest' else 'scored_below' end status from s")
def score_documents(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "score", V.score_band(F.col("score")).alias("band"), R.classify(F.col("score"), F.lit(None).cast("string"), 70).alias("status"))


@query(SCORE_SQL + "select doc_id, cast(score as int) score from s order by score desc, doc_id limit 25")
def topk_stable(spark, sf_dir):
    return R.top(_scored(spark, sf_dir), [F.desc("score"), F.col("doc_id")], 25)


@query(SCORE_SQL + "select doc_id, cast(score as int) score from (select * from s order by doc_id limit 40) order by score desc, doc_id limit 10")
def cap_before_rank(spark, sf_dir):
    return R.top(R.top(_scored(spark, sf_dir), [F.col("doc_id")], 40), [F.desc("score"), F.col("doc_id")], 10)


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by n_chars desc, doc_id) rank from documents)
select doc_id, case when rank > 10 then 'over cap' else '' end detail from r""")
def bucket_rank(spark, sf_dir):
    return R.cap(table(spark, sf_dir, "documents"), "doc_id", [F.desc("n_chars"), F.col("doc_id")], 10, ["lang"]).select("doc_id", "detail")


@query()
def page_links_udtf(spark, sf_dir):
    from millrace.sources.postings import html_tokens

    return html_tokens(table(spark, sf_dir, "pages"), "page_id", "html").filter("kind = 'link'").select("page_id", "pos", "href", "text")
