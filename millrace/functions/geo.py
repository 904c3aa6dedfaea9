"""Where a posting is: segments of a location, countries, the US test, remote wording.

The gazetteer is a small table of general geography; a larger one can be passed in its place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import normalize_text

#: Names of countries and cities by ISO code.
COUNTRIES = {"AT": "austria", "BE": "belgium", "CH": "switzerland", "CZ": "czechia", "DE": "germany", "DK": "denmark", "ES": "spain", "FI": "finland", "FR": "france", "GB": "united kingdom", "IE": "ireland", "IT": "italy", "LU": "luxembourg", "NL": "netherlands", "NO": "norway", "PL": "poland", "PT": "portugal", "SE": "sweden", "BG": "bulgaria", "CY": "cyprus", "EE": "estonia", "GR": "greece", "HR": "croatia", "HU": "hungary", "IS": "iceland", "LI": "liechtenstein", "LT": "lithuania", "LV": "latvia", "MT": "malta", "RO": "romania", "SI": "slovenia", "SK": "slovakia"}
CITIES = {
    "AT": ("vienna", "wien", "graz", "linz", "salzburg", "innsbruck"), "BE": ("brussels", "antwerp", "ghent", "leuven"), "BG": ("sofia", "plovdiv", "varna"),
    "CH": ("zurich", "geneva", "basel", "bern", "lausanne"), "CY": ("nicosia", "limassol"), "CZ": ("prague", "brno", "ostrava"),
    "DE": ("berlin", "munich", "munchen", "hamburg", "cologne", "koln", "frankfurt", "frankfurt am main", "stuttgart", "dusseldorf", "leipzig", "dresden", "bad homburg"),
    "DK": ("copenhagen", "kobenhavn", "aarhus", "odense"), "EE": ("tallinn", "tartu"), "ES": ("madrid", "barcelona", "valencia", "seville", "malaga", "bilbao"),
    "FI": ("helsinki", "espoo", "tampere", "turku"), "FR": ("paris", "lyon", "toulouse", "nantes", "bordeaux", "lille", "marseille", "aix en provence"),
    "GB": ("london", "manchester", "edinburgh", "glasgow", "bristol", "leeds", "cardiff", "belfast", "milton keynes"), "GR": ("athens", "thessaloniki"),
    "HR": ("zagreb", "split"), "HU": ("budapest", "debrecen"), "IE": ("dublin", "cork", "galway"), "IS": ("reykjavik",), "IT": ("milan", "rome", "turin", "bologna", "florence"),
    "LT": ("vilnius", "kaunas"), "LU": ("luxembourg city",), "LV": ("riga",), "MT": ("valletta", "sliema"),
    "NL": ("amsterdam", "rotterdam", "utrecht", "eindhoven", "the hague", "den haag", "delft"), "NO": ("oslo", "bergen", "trondheim", "stavanger"),
    "PL": ("warsaw", "krakow", "wroclaw", "gdansk", "poznan", "lodz"), "PT": ("lisbon", "porto", "braga"), "RO": ("bucharest", "cluj napoca", "iasi", "timisoara"),
    "SE": ("stockholm", "gothenburg", "malmo", "uppsala"), "SI": ("ljubljana", "maribor"), "SK": ("bratislava", "kosice"),
}
US_WORDS = ("united states", "usa", "new york", "san francisco", "california", "texas", "boston", "seattle", "chicago", "austin", "massachusetts")
US_CODES = "AL|AK|AZ|AR|CA|CO|CT|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY"


#: Words and phrases that name Europe, its unions or its time zones.
EU_WORDS = ("eu", "eea", "emea", "uk", "cet", "cest", "eet", "eest", "efta", "schengen", "europe", "european", "europewide", "eurozone", "benelux", "nordics", "dach", "iberia")


def segments(location: Column) -> Column:
    """The alternatives that a location lists."""
    parts = F.split(F.coalesce(location, F.lit("")), r"[;|/\n·•()\[\]]| - | or | and | & ")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


#: Names of the gazetteer by which a place is told.
PLACES = {n: iso for iso, n in COUNTRIES.items()} | {n: iso for iso, names in CITIES.items() for n in names} | {"uk": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "czech republic": "CZ", "deutschland": "DE", "holland": "NL"}


def ngram_hit(norm: Column, table: dict[str, str]) -> Column:
    """What table holds for the longest run of whole words of normalised text, the leftmost of these; else null."""
    longest = max(len(k.split()) for k in table)
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    words = F.split(norm, " ")

    def runs(n: Column) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))

    found = F.flatten(F.transform(F.sequence(F.lit(longest), F.lit(1)), lambda n: F.coalesce(runs(n), F.array().cast("array<string>"))))
    return F.get(F.filter(F.transform(found, lambda g: F.try_element_at(known, g)), lambda x: x.isNotNull()), F.lit(0))


def _normed(parts: Column) -> Column:
    """Segments with their normalised text, which is so made once for each."""
    return F.transform(parts, lambda s: F.struct(s.alias("seg"), normalize_text(s).alias("norm")))


_US = "(?: |^)(?:" + "|".join(US_WORDS) + ")(?: |$)"


def _us(s: Column) -> Column:
    return s["norm"].rlike(_US) | s["seg"].rlike(rf",\s*(?:{US_CODES})(?:\s+\d{{5}})?\s*$") | s["seg"].rlike(r"(?<![A-Za-z])U\.?S\.?(?:A\.?)?(?![A-Za-z])")


def _country(s: Column) -> Column:
    """The code at a segment's end, in capitals, else its place by name."""
    tail = F.trim(F.element_at(F.split(s["seg"], ","), -1))
    code = F.when(tail.isin([*COUNTRIES, "UK"]), F.when(tail == "UK", "GB").otherwise(tail))
    return F.coalesce(code, ngram_hit(s["norm"], PLACES))


def country_of(location: Column) -> Column:
    """The country of the first segment that isn't in the US and names one."""
    known = F.transform(_normed(segments(location)), lambda s: F.when(~_us(s), _country(s)))
    return F.get(F.filter(known, lambda x: x.isNotNull()), F.lit(0))


def in_us(location: Column) -> Column:
    return F.exists(_normed(segments(location)), _us)


#: Phrases that tell a remote posting wherever they stand; phrases that tell one which is partly remote; words
#: after which "remote" and "distributed" are no workplace.
STRONG_REMOTE = (
    "fully remote", "100 remote", "remote first", "remote only", "work from home", "work from anywhere", "working from home", "home based", "home office", "remote position",
    "remote role", "remote job", "remote opportunity", "remotely", "telecommute", "telecommuting", "wfh", "distributed team", "fully distributed", "remote friendly", "remote within",
)
HYBRID = ("hybrid", "part remote", "partially remote")
NOT_A_PLACE = (
    "sensing", "sensor", "sensors", "monitoring", "control", "controls", "controlled", "desktop", "access", "imaging", "telemetry", "diagnostics", "surgery", "surgical",
    "patient", "procedure", "detonation",
)
DISTRIBUTED_TECH = (
    "system", "systems", "computing", "computation", "database", "databases", "ledger", "cache", "caching", "tracing", "architecture", "architectures", "transaction",
    "transactions", "consensus", "storage", "sql", "data", "services", "training", "locking", "queue", "queues",
)
REMOTE_WORDS = ("remote", "remotely", "wfh", "telecommute", "telecommuting", "telework", "teleworking", "anywhere", "homeoffice")


def _phrases(words: tuple[str, ...]) -> str:
    return " (?:" + "|".join(words) + ") "


def is_remote(location: Column, title: Column, description: Column | None = None) -> Column:
    """Whether a posting is remote work: by place and title read in full, by the description only where it says so outright. Hybrid isn't."""
    norm = F.concat(F.lit(" "), normalize_text(location), F.lit(" \u0000 "), normalize_text(title), F.lit(" "))
    told = F.lit(False) if description is None else F.concat(F.lit(" "), normalize_text(description), F.lit(" ")).rlike(_phrases(STRONG_REMOTE))
    bare = rf" (?:(?:{'|'.join(REMOTE_WORDS)})(?! (?:{'|'.join(NOT_A_PLACE)}) )|distributed(?! (?:{'|'.join(DISTRIBUTED_TECH)}) )) "
    # the text is normalised once and read by each rule
    by = F.transform(F.array(norm), lambda n: F.when(n.rlike(_phrases(STRONG_REMOTE)), True).when(n.rlike(_phrases(HYBRID)), False).when(told, True).otherwise(n.rlike(bare)))
    return F.get(by, F.lit(0))


def country_name(iso: Column) -> Column:
    """The name of a country of the table, capitalised; null for others."""
    return F.initcap(F.element_at(F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv]), iso))


def is_eu(iso: Column) -> Column:
    """Whether the code is of the table, which holds the EU, the EEA, Switzerland and the UK; false for null."""
    return F.coalesce(iso.isin(*COUNTRIES), F.lit(False))


def mentions_eu(text: Column) -> Column:
    """Whether a text hints at Europe: an offset of UTC+0 to +3, a word of EU_WORDS, or a country or city of the tables."""
    words = [*EU_WORDS, *COUNTRIES.values(), *[c for cs in CITIES.values() for c in cs]]
    named = F.concat(F.lit(" "), normalize_text(text), F.lit(" ")).rlike(" (?:" + "|".join(words) + ") ")
    return F.coalesce(text.rlike(r"(?i)\b(?:UTC|GMT)\s*\+\s*0?[0-3]\b"), F.lit(False)) | named


def resolve(location: Column, title: Column, remote: Column, description: Column) -> Column:
    """Country, remote, eu_hint and us of a posting. The title is asked for a country only where the location isn't in the US; a declared remote flag wins."""
    us = in_us(location)
    return F.struct(
        F.coalesce(country_of(location), F.when(~us, country_of(title))).alias("country"),
        F.coalesce(remote, is_remote(location, title, description)).alias("remote"),
        mentions_eu(F.concat_ws(" ", location, title, description)).alias("eu_hint"),
        us.alias("us"),
    )
