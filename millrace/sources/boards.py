"""Live readers (S1, S6, S11, S12, S22-S26): one request a row or partition, through a transport that tests put in place of the network.

A transport is a function (url, params) -> (status, body), named "module:function" so that executors import it. Failures never end
a read: they are rows with an `error`.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, dict], tuple[int, str]]
#: Where boards and the aggregator are read.
BOARDS = {"greenhouse": ("https://boards-api.greenhouse.io/v1/boards/{}/jobs", {"content": "true"}), "lever": ("https://api.lever.co/v0/postings/{}", {"mode": "json"})}
SEARCH = "https://api.adzuna.com/v1/api/jobs/{}/search/1"
MOST_RESULTS = 50


def network(url: str, params: dict, timeout: float = 20.0) -> tuple[int, str]:
    """GET by the standard library."""
    import urllib.error
    import urllib.parse
    import urllib.request

    full = url + ("?" + urllib.parse.urlencode(params) if params else "")
    try:
        with urllib.request.urlopen(urllib.request.Request(full, headers={"Accept": "application/json"}), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def transport_of(name: str) -> Transport:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def request(get: Transport, url: str, params: dict, tries: int = 3, backoff: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(body, error) after at most `tries`: 429, statuses from 500 on and broken connections are tried again, longer waits between; other errors are final."""
    error = None
    for attempt in range(max(1, tries)):
        if attempt:
            sleep(backoff**attempt)
        try:
            status, body = get(url, params)
        except Exception as e:  # a broken connection of any kind
            error = f"connection failed: {e}"
            continue
        if 200 <= status < 400:
            return body, None
        error = f"HTTP {status}"
        if status != 429 and status < 500:
            break
    return None, error


def clean_slug(value: object) -> str:
    """A board's name, from itself or from its pasted address."""
    text = str(value or "").strip()
    if "://" in text or text.startswith("www.") or ".io/" in text or ".co/" in text:
        steps = [x for x in re.sub(r"^[a-z]+://", "", text).split("/") if x]
        steps = steps[1:] if steps and "." in steps[0] else steps
        text = steps[0] if steps else ""
    return text.strip().strip("/").strip()


def watchlist(spark: SparkSession, board: str, section: object) -> DataFrame:
    """board, slug, company of a watchlist's section: one name, a list of names or of {slug, company}, or {slug: company}; the first of equal names stays."""
    if section is None:
        entries: list = []
    elif isinstance(section, dict):
        entries = [{"slug": k, "company": v} for k, v in section.items()]
    else:
        entries = [section] if isinstance(section, str) else list(section) if isinstance(section, (list, tuple)) else []
    found: dict[str, tuple] = {}
    for e in entries:
        named = isinstance(e, dict)
        slug = clean_slug(next((e[k] for k in ("slug", "board", "id", "name") if e.get(k)), None) if named else e)
        company = str(e.get("company") or e.get("display_name") or "").strip() if named else ""
        if slug:
            found.setdefault(slug.lower(), (board, slug, company or None))
    return spark.createDataFrame(list(found.values()), "board string, slug string, company string")


def with_company(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (slug, company, ...) under the company that the watchlist gives their board, where it gives one (J7, S26). A watchlist is typed by hand, hence small."""
    given = entries.filter("company is not null").select(F.col("slug").alias("_slug"), F.col("company").alias("_given"))
    return rows.join(F.broadcast(given), F.col("slug") == F.col("_slug"), "left").withColumn("company", F.coalesce("_given", "company")).drop("_slug", "_given")


class _One(InputPartition):
    def __init__(self, **values):
        super().__init__(0)
        self.__dict__.update(values)


class BoardReader(DataSourceReader):
    """A partition for each board."""

    def __init__(self, options: dict):
        self.board, self.transport = options["board"], options.get("transport", "millrace.sources.boards:network")
        self.slugs, self.tries = json.loads(options["slugs"]), int(options.get("tries", 3))
        self.backoff = float(options.get("backoff", 1.5))

    def partitions(self) -> list[InputPartition]:
        return [_One(slug=s) for s in self.slugs]

    def read(self, partition) -> Iterator[tuple]:
        url, params = BOARDS[self.board]
        body, error = request(transport_of(self.transport), url.format(partition.slug), dict(params), self.tries, self.backoff)
        yield (self.board, partition.slug, body, error)


class BoardSource(DataSource):
    """spark.read.format("boards").option("board", "lever").option("slugs", '["a", "b"]').load(): board, slug, payload, error."""

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return "board string, slug string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return BoardReader(self.options)


def search_params(query: str, keys: tuple[str, str], most: int = MOST_RESULTS, max_days: int = 0, where: str = "", distance_km: int = 0) -> dict:
    """What the search itself is asked to filter: words, age, place with its radius, number of results."""
    out = {"app_id": keys[0], "app_key": keys[1], "results_per_page": min(most, MOST_RESULTS), "what": query, "content-type": "application/json"}
    if max_days > 0:
        out["max_days_old"] = max_days
    if where.strip():
        out["where"] = where.strip()
        if distance_km > 0:
            out["distance"] = distance_km
    return out


class SearchReader(DataSourceReader):
    """A partition for each country; a refused key ends its country's queries, another error costs one query."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.countries, self.queries = json.loads(options["countries"]), json.loads(options["queries"])

    def partitions(self) -> list[InputPartition]:
        return [_One(country=c, number=i * len(self.queries)) for i, c in enumerate(self.countries)]

    def read(self, partition) -> Iterator[tuple]:
        o, get = self.options, transport_of(self.options.get("transport", "millrace.sources.boards:network"))
        keys = (o.get("app_id", ""), o.get("app_key", ""))
        for i, query in enumerate(self.queries):
            params = search_params(query, keys, int(o.get("most", MOST_RESULTS)), int(o.get("max_days", 0)), o.get("where", ""), int(o.get("distance_km", 0)))
            body, error = request(get, SEARCH.format(partition.country), params, int(o.get("tries", 3)), float(o.get("backoff", 1.5)))
            for secret in keys:
                # short texts would hide harmless parts of an error
                error = error.replace(secret, "***") if error and len(secret) >= 6 else error
            yield (partition.number + i, partition.country, query, body, error)
            if error in ("HTTP 401", "HTTP 403"):
                return


class SearchSource(DataSource):
    """spark.read.format("search").option("countries", '["de"]').option("queries", '["x"]').load(): number, country, query, payload, error."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return "number long, country string, query string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (BoardSource, SearchSource):
        spark.dataSource.register(source)


def read_board(spark: SparkSession, entries: DataFrame, board: str, **options: str) -> DataFrame:
    """Payloads of a watchlist's boards."""
    register(spark)
    slugs = [r.slug for r in entries.filter(F.col("board") == board).select("slug").collect()]  # typed by hand
    read = spark.read.format("boards").option("board", board).option("slugs", json.dumps(slugs))
    return read.options(**options).load() if slugs else spark.createDataFrame([], BoardSource({}).schema())


def read_search(spark: SparkSession, countries: list[str], queries: list[str], **options: str) -> DataFrame:
    """Payloads of each query in each country."""
    register(spark)
    aliases = {"uk": "gb", "en": "gb", "uae": "ae"}
    codes = list(dict.fromkeys(aliases.get(c.lower(), c.lower()) for c in countries))
    return spark.read.format("search").option("countries", json.dumps(codes)).option("queries", json.dumps(queries)).options(**options).load()
