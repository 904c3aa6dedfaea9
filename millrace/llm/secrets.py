"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame and SQL expressions only.

A candidate is a run of key characters of 16 or more with a digit among them, a value of 8 or more assigned to a name such as
token or password, or a private key's header. `=` is a key character as padding at a run's end only, so of NAME=value (.env,
shell, URL parameters) the value is the candidate and the name stands before it. Of each candidate, at each of its places,
come its length, its character transitions (changes of character class, distinct characters, longest letter run), its
dictionary coverage (share of its characters in words of the dictionary), its path (whether the candidate is or stands in one,
and whether the document's own path names tests or examples) and its neighbouring words (those before it that name credentials,
or harmless values such as hashes and ids). A forest trained from labelled findings gives the score; a document's candidate
takes the highest score of its places there, and findings of 0.5 or more are secrets.

The dictionary is counted over the corpus: words that stand in at least `common` of its documents, and a few of usual
placeholders besides. A secret that stands in as many documents can bring its own letter runs into the dictionary; digits,
transitions and neighbouring words still speak for it.

labelled_findings() makes lines by rule, with random keys of common formats, and placeholders, commit hashes, ids, paths,
host names, numbers and identifiers, and takes their findings with known labels as a scan does; any table of such rows can take
its place.

Defined cases: null and empty text have no candidates; a candidate repeated in a document is one finding; so is one
that rows of the same doc_id share; texts are scanned whole; an empty table gives an empty result; other
columns are ignored, `source` serves as path where there is one.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.storage import table, written

_KEY, _LINKED = r"[A-Za-z0-9+/_.-]", r"[A-Za-z0-9+/_=.-]"
_NAMES = r"secret|token|password|passwd|pwd|api_key|apikey|access_key|auth"
CANDIDATE = (
    rf"(?<!{_KEY})(?=[A-Za-z+/_.-]*+[0-9])(?:{_KEY}{{16,}}+(?:=++(?!{_KEY}))?+|(?={_LINKED}{{16}}){_KEY}{{14,15}}+=++(?!{_KEY}))"
    # the short lookbehinds are met at few characters, and spare the long one at all others
    rf"|(?i:(?<=[:= \t\"'])(?<=[:=][ \t]{{0,2}}[\"']?)(?<=(?:{_NAMES})[\"']?[ \t]{{0,2}}[:=][ \t]{{0,2}}[\"']?)(?:[^\s\"'&]|&(?![A-Za-z0-9_.-]+=)){{8,}}+)"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
)
#: Words of placeholders, paths and identifiers that the dictionary holds whatever the corpus.
WORDS = (
    "example", "sample", "test", "dummy", "your", "here", "key", "secret", "password", "token", "change", "changeme", "replace", "this", "insert", "value", "user", "name", "admin",
    "default", "none", "null", "true", "false", "foo", "bar", "http", "https", "www", "com", "org", "net", "mail", "host", "file", "path", "home", "data", "config", "index", "page", "usr", "lib",
    "version", "release", "function", "class", "method", "object", "string", "number", "model", "build", "local", "server", "client", "public", "private", "access", "image", "style",
    "script", "content", "static", "assets", "json", "shop", "news", "blog", "get", "with", "from", "that",
)
#: A word of a candidate: a capital or not and small letters, or capitals alone.
_RUN = r"[A-Za-z][a-z]{2,}|[A-Z]{3,}"
_CREDENTIAL = r"(?i)secret|token|passw|pwd|api.?key|access.?key|auth|bearer|credential|private"
_HARMLESS = r"(?i)example|sample|dummy|commit|sha-?\d|md5|checksum|digest|hash|uuid|guid|revision|version|build|session|order|invoice|phone|card|mail|url|href|path|file"
FEATURES = ["n", "turns", "distinct", "letters", "words", "hex", "digits", "upper", "paths", "example_path", "credential", "harmless", "glued", "prefixed"]


def dictionary(docs: DataFrame, common: int = 20) -> DataFrame:
    """word: the lower-case words of three letters or more in at least `common` of the documents (text), and WORDS."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).filter(F.length("word") > 2)
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= common).select("word")
    return counted.union(base_words(docs.sparkSession)).distinct()


def base_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


def coverage(findings: DataFrame, words: DataFrame) -> DataFrame:
    """candidate, words: the share of the characters of each candidate that stand in words of the dictionary, where there are any."""
    runs = findings.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit(f"({_RUN})"), 1)).alias("run"))
    known = runs.withColumn("word", F.lower("run")).join(words, "word")
    return known.groupBy("candidate").agg((F.sum(F.length("run")) / F.first(F.length("candidate"))).alias("words"))


def features(findings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """findings (candidate, before, path) with the columns FEATURES. words: the dictionary, WORDS alone where there is none."""
    c, n = F.col("candidate"), F.length("candidate")

    def share(pattern: str) -> F.Column:
        return 1 - F.length(F.regexp_replace(c, pattern, "")) / n

    cuts = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), 1)
    covered = findings.join(coverage(findings, base_words(findings.sparkSession) if words is None else words), "candidate", "left")
    return (
        covered.withColumn("words", F.coalesce("words", F.lit(0.0)))
        .withColumn("n", n.cast("double"))
        .withColumn("turns", (F.size(F.split(c, cuts)) - 1) / n)
        .withColumn("distinct", F.size(F.array_distinct(F.split(c, ""))) / F.sqrt(n.cast("double")))
        .withColumn("letters", F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)) / n)
        .withColumn("hex", F.greatest(share("[0-9a-f]"), share("[0-9A-F]")))
        .withColumn("digits", share("[0-9]"))
        .withColumn("upper", share("[A-Z]"))
        .withColumn("paths", share("[/.]"))
        .withColumn("example_path", F.coalesce(F.col("path").rlike("(?i)test|example|sample|fixture|mock|demo"), F.lit(False)).cast("double"))
        .withColumn("credential", F.col("before").rlike(_CREDENTIAL).cast("double"))
        .withColumn("harmless", F.col("before").rlike(_HARMLESS).cast("double"))
        .withColumn("glued", F.col("before").rlike(r"[@/\\.~]$").cast("double"))
        .withColumn("prefixed", c.rlike(r"^(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|xox[abprs]-|sk[-_]|pk_live|rk_live|glpat-|eyJ|-----BEGIN)").cast("double"))
    )


def occurrences(docs: DataFrame, context: int = 48) -> DataFrame:
    """docs (text and any others): the other columns with candidate, start and before, the last words of its line so far, of every candidate at each of its places."""
    others = [c for c in docs.columns if c != "text"]
    # the texts before, between and after the matches place each match where the pattern found it
    found = docs.filter(F.col("text").rlike(CANDIDATE)).select(*others, F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("matches"), F.split("text", CANDIDATE, -1).alias("gaps"))
    places = F.expr(
        f"""aggregate(zip_with(matches, slice(gaps, 1, size(matches)), (m, g) -> named_struct('text', m, 'gap', g)),
          named_struct('at', 1, 'line', '', 'out', cast(array() as array<struct<candidate:string,start:int,before:string>>)),
          (a, m) -> named_struct('at', a.at + length(m.gap) + length(m.text), 'line', right(concat(a.line, right(m.gap, {context}), m.text), {context}),
            'out', concat(a.out, array(named_struct('candidate', m.text, 'start', a.at + length(m.gap), 'before', right(concat(a.line, right(m.gap, {context})), {context}))))),
          a -> a.out)"""
    )
    # outer, as Spark would else scan once more to drop texts without matches, which are gone already
    found = found.select(*others, F.inline_outer(places))
    found = found.withColumn("before", F.substring_index("before", "\n", -1)).withColumn("candidate", F.regexp_replace("candidate", r"[.]+$", ""))
    return found.filter("length(candidate) > 0")


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """id, candidate, start, before, path, label of the findings in n lines of known kind, always the same ones."""
    lines = spark.range(0, n, 1, 1).selectExpr(
        "id", "sha2(cast(id as string), 256) h", "base64(unhex(sha2(concat('b', id), 384))) b", "sha2(concat('u', id), 256) u", "cast(id % 24 as int) kind", "cast(xxhash64(id) & 7 as int) w", "cast(xxhash64(id, 1) & 3 as int) p", "pmod(xxhash64(id, 2), 3) = 0 as env"
    ).selectExpr(
        "id",
        """case kind
          when 0 then substr(h, 1, 40) when 1 then substr(h, 1, 32) when 2 then h when 3 then substr(b, 1, 40) when 4 then concat('AKIA', upper(substr(translate(b, '+/', 'XY'), 1, 16)))
          when 5 then concat('ghp_', substr(translate(b, '+/', 'ab'), 1, 36)) when 6 then concat('sk-', substr(translate(b, '+/', 'cd'), 1, 48)) when 7 then concat('eyJ', substr(translate(b, '+/', '-_'), 1, 30), '.', substr(h, 1, 24))
          when 8 then substr(translate(b, '+/', 'ef'), 1, 20) when 9 then substr(b, 1, 28) when 10 then substr(h, 1, 40) when 11 then concat('xoxb-', abs(xxhash64(id)), '-', substr(translate(b, '+/', 'gh'), 1, 24))
          when 12 then substr(h, 1, 40) when 13 then concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) when 14 then element_at(array('your_api_key_here_1', 'example-token-123456', 'changeme-password-1', 'insert_secret_here_2024', 'test_key_1234567890', 'xxxxxxxxxxxxxxxx1234', '0000000000000000', 'replace-this-value-1'), w + 1)
          when 15 then concat('/usr/local/lib/', element_at(array('config', 'data', 'assets', 'static', 'image', 'script', 'model', 'build'), w + 1), '/', substr(h, 1, 4), '.json') when 16 then concat('mail', w, '.example', id % 90, '.com')
          when 17 then substr(translate(h, 'abcdef', '123456'), 1, 16) when 18 then concat('get_', element_at(array('user', 'page', 'model', 'client', 'server', 'content', 'string', 'object'), w + 1), '_by_version_', id % 99) when 19 then substr(h, 1, 64)
          when 20 then concat('2024-', lpad(1 + id % 12, 2, '0'), '-', lpad(1 + id % 28, 2, '0'), 'T10.', lpad(id % 60, 2, '0'), '.00') when 21 then concat('www.', element_at(array('shop', 'news', 'data', 'blog', 'image', 'client', 'public', 'server'), w + 1), id % 999, '.org/index/page', w)
          when 22 then concat(repeat(substr(h, 1, 1), 12), id % 10000, repeat('=', 4)) else concat('password', id % 100, '-example-value') end as planted""",
        """case when env and kind in (4, 5, 6, 7) then element_at(array('API_KEY=', 'AWS_ACCESS_KEY_ID=', 'ID=', 'GITHUB_TOKEN=', 'https://api.shop.org/v1/list?key=', 'USER_VALUE=', 'run --with=', 'X='), w + 1)
          when env and kind < 12 then element_at(array('API_KEY=', 'AWS_SECRET_ACCESS_KEY=', 'export DB_PASSWORD=', 'GITHUB_TOKEN=', 'https://api.shop.org/v1/list?access_token=', 'curl -d client_secret=', 'deploy --auth-token=', 'S3_UPLOAD_2024_SECRET='), w + 1)
          when env and kind in (12, 13, 17, 19) then element_at(array('COMMIT_SHA=', 'IMAGE_DIGEST=sha256:', 'SESSION_ID=', 'https://www.shop.org/list?order=', 'BUILD_VERSION=', 'export REQUEST_UUID=', 'get --checksum=', 'https://www.shop.org/page?revision='), w + 1)
          when env and kind in (14, 22, 23) then element_at(array('API_KEY=', 'AWS_SECRET_ACCESS_KEY=', 'export DB_PASSWORD=', 'EXAMPLE_TOKEN=', 'https://api.shop.org/v1/list?access_token=', 'SAMPLE=', 'run --auth-token=', 'TEST_SECRET='), w + 1)
          when env then element_at(array('CONFIG_PATH=', 'HOST=', 'export HOME_PAGE=', 'START_AT=', 'https://www.shop.org/list?next=', 'NAME=', 'run --file=', 'FUNCTION='), w + 1)
          when kind in (0, 1, 2, 3, 8, 9, 11) then element_at(array('token = "', 'api_key: ', 'secret="', 'password = ', 'Authorization: Bearer ', 'export AUTH_TOKEN=', 'access_key = "', 'the private token is '), w + 1)
          when kind in (4, 5, 6, 7, 10) then if(kind = 10 or p = 0, 'client_secret: "', element_at(array('was and the ', 'id = "', '', 'use ', 'login with ', 'value: ', 'of the ', 'line '), w + 1))
          when kind in (12, 19) then element_at(array('commit ', 'sha256: ', 'checksum = ', 'md5 hash of ', 'revision ', 'digest: ', 'build hash ', 'commit id '), w + 1)
          when kind = 13 then element_at(array('uuid: ', 'session ', 'order ', 'guid = ', 'request id ', 'id: ', 'the ', 'session id '), w + 1)
          when kind in (14, 22, 23) then element_at(array('token = "', 'api_key: ', 'secret="', 'password = ', 'example: ', 'the ', 'sample key ', 'dummy '), w + 1)
          when kind = 15 then element_at(array('path ', 'file ', 'in ', 'see ', 'open ', 'the ', 'load ', 'from '), w + 1) when kind = 16 then element_at(array('user@', 'a.b@', 'mail to x@', 'the ', 'host ', 'c1@', 'of this@', 'at '), w + 1)
          when kind = 17 then element_at(array('card ', 'phone ', 'order ', 'invoice ', 'and the ', 'of ', 'number ', 'call '), w + 1) when kind = 21 then element_at(array('url ', 'href="', 'https://', 'see ', 'http://', 'on ', 'page ', 'the '), w + 1) else element_at(array('the ', 'and ', 'call ', 'def ', 'at ', 'of ', 'in ', 'with '), w + 1) end as lead""",
        "case when p = 1 and kind >= 12 then 'tests/data.txt' else 'src/main.txt' end as path",
        "cast(if(kind < 12, 1, 0) as double) as label",
    )
    lines = lines.withColumn("text", F.expr("concat(lead, planted, case when lead like '%\"' then '\"' when lead like '%?%=' then '&page=2' else '' end)"))
    return occurrences(lines).withColumn("label", F.when(F.col("candidate") == F.col("planted"), F.col("label")).otherwise(F.lit(0.0))).drop("lead", "planted")


def train(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 7, words: DataFrame | None = None) -> RandomForestClassificationModel:
    """The forest of labelled findings (candidate, before, path, label). words: the dictionary, which scan() is to be given as well."""
    made = features(findings, words)
    # the forest draws rows by their order: the same findings give the same forest
    order = [c for c in ("id", "candidate", "before", "path", "label") if c in made.columns]
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(made.orderBy(*order).coalesce(1))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.select("features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, doc: str = "doc_id", context: int = 48, words: DataFrame | None = None) -> DataFrame:
    """doc_id, candidate, start, score, secret of every finding: a candidate of a document at its place of the highest score, the first of these."""
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    # written, as the dictionary's share and the features read it and texts should be searched once
    found = written(occurrences(docs.select(F.col(doc).alias("doc_id"), "text", path.alias("path")), context), "findings")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(features(found, words))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    best = scored.groupBy("doc_id", "candidate").agg(F.max(F.struct("score", (-F.col("start")).alias("place"))).alias("best"))
    return best.select("doc_id", "candidate", (-F.col("best.place")).alias("start"), "best.score", (F.col("best.score") >= threshold).alias("secret"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets_sha256 (of the distinct secrets in order, comma-joined) for every document."""
    docs = table(spark, sf_dir, "documents")
    words = written(dictionary(docs), "dictionary")
    found = scan(docs, train(labelled_findings(spark), words=words), words=words)
    per = found.groupBy("doc_id").agg(
        F.count_distinct("candidate").alias("n_candidates"), F.sort_array(F.collect_set(F.when(F.col("secret"), F.col("candidate")))).alias("s")
    )
    none = F.coalesce(F.array_join("s", ","), F.lit(""))
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_secrets"),
        F.sha2(none, 256).alias("secrets_sha256"),
    )
