"""Text normalisation, whole-word matching and identity keys as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that have no decomposition, by what they are read as; capitals alike.
LETTERS = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h"}
#: Legal suffixes of company names, as they read after normalisation.
SUFFIXES = (
    "inc", "llc", "ltd", "limited", "gmbh", "ag", "ab", "as", "bv", "nv", "sa", "sas", "sarl", "srl", "spa", "se", "oy", "oyj", "plc",
    "corp", "corporation", "co", "company", "aps", "kft", "sp", "zoo", "sl", "ug", "kg", "eg", "holding", "group", "the",
)


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """(letters, what each becomes, [(letter, letters)]) of Latin letters and signs, by their compatibility decomposition without marks."""
    one, to, more = [], [], []
    for c in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        c = chr(c)
        plain = LETTERS.get(c) or LETTERS.get(c.lower(), "").upper() if c != "ẞ" else ""
        out = "".join(x for x in unicodedata.normalize("NFKD", plain or c) if not unicodedata.combining(x))
        if out == c or not any(x.isalnum() for x in out):
            continue
        if len(out) == 1:
            one.append(c)
            to.append(out)
        else:
            more.append((c, out))
    return "".join(one), "".join(to), more


FOLD_FROM, FOLD_TO, FOLD_MORE = _folds()
#: Marks that stand by themselves are deleted, as letters that become nothing.
MARKS = "".join(map(chr, range(0x300, 0x370)))
_COMMON = [x for x in FOLD_MORE if x[0].lower() in LETTERS]
_RARE = [x for x in FOLD_MORE if x[0].lower() not in LETTERS]


def fold(c: Column) -> Column:
    """Latin letters without accents, ligatures and signs spelt out. Text in ASCII is passed on as it is."""
    spelt = c
    for a, b in _COMMON:
        spelt = F.replace(spelt, F.lit(a), F.lit(b))
    letters = F.create_map(*[F.lit(x) for pair in _RARE for x in pair])
    each = F.array_join(F.transform(F.split(spelt, ""), lambda x: F.coalesce(F.try_element_at(letters, x), x)), "")
    spelt = F.when(c.rlike("[" + "".join(a for a, _ in _RARE) + "]"), each).otherwise(spelt)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(spelt, FOLD_FROM + MARKS, FOLD_TO)).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Lower case without accents or punctuation, single blanks; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}_]+", " "))


def normalize_company(c: Column) -> Column:
    """normalize_text without dotted initialisms' dots and trailing legal suffixes, unless nothing else is left."""
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=\b[A-Za-z])\.(?=[A-Za-z]\.)|(?<=\b[A-Za-z]\.[A-Za-z])\.", "")
    sfx = "|".join(SUFFIXES)
    left = F.regexp_replace(normalize_text(joined), rf"(?:(?:^| )(?:{sfx}))+$", "")
    return F.when(left == "", normalize_text(c)).otherwise(left)


def normalize_title(c: Column) -> Column:
    return normalize_text(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\[[^\]]*\]", " "))


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def posting_key(ats: Column, ats_id: Column, company: Column, title: Column, location: Column) -> Column:
    named = F.coalesce(ats, F.lit("")) != ""
    has_id = F.coalesce(ats_id, F.lit("")) != ""
    return F.when(named & has_id, short_hash(ats, normalize_company(company), ats_id)).otherwise(short_hash(normalize_company(company), normalize_title(title), normalize_text(location)))


def dedupe_key(company: Column, title: Column, country: Column, location: Column) -> Column:
    place = F.coalesce(F.nullif(country, F.lit("")), F.array_join(F.slice(F.split(normalize_text(location), " "), 1, 2), " "))
    return short_hash(normalize_company(company), normalize_title(title), place)


def has_phrase(norm: Column, phrase: str) -> Column:
    """Whether normalised text holds the words of phrase one after the other."""
    words = " ".join(phrase.lower().split())
    return F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.lit(f" {words} "))


def first_phrase(norm: Column, phrases: list[str]) -> Column:
    """The first of phrases, in their order, that the text holds; else null."""
    return F.coalesce(*[F.when(has_phrase(norm, p), F.lit(p)) for p in phrases], F.lit(None).cast("string"))


def fields(*cols: Column) -> Column:
    """Several fields as one normalised text over whose borders no phrase can reach."""
    return F.concat_ws(" \u0000 ", *[normalize_text(c) for c in cols])


def html_to_text(c: Column) -> Column:
    """Text of HTML: no scripts or styles, a line for each block, entities of the common set resolved, no empty lines."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?h[1-6]|/?tr|/?table|/?section|/?article|/?header|/?footer)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), (" ", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def truncate(c: Column, limit: int, suffix: str = "…") -> Column:
    """Unchanged up to limit characters, else cut, at the last blank if it lies in the last 30 %, and marked."""
    head = F.substring(c, 1, limit)
    blank = limit - F.instr(F.reverse(head), " ") + 1
    at = F.when((F.instr(head, " ") > 0) & (blank - 1 >= 0.7 * limit), blank - 1).otherwise(F.lit(limit))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.left(head, at)), F.lit(suffix)))


def slugify(c: Column, limit: int = 60) -> Column:
    slug = F.regexp_replace(F.regexp_replace(normalize_text(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, limit), r"-+$", ""), F.lit("")), F.lit("untitled"))


def title_words(slug: Column) -> Column:
    """A display name from a slug: dashes to blanks, each word capitalised."""
    return F.initcap(F.trim(F.regexp_replace(slug, r"[-_\s]+", " ")))


def canonical_url(c: Column) -> Column:
    """A URL without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", "")


def posting_url_id(c: Column) -> Column:
    """The number of a posting on the network's site: the whole last part of the path, or six digits or more at its end; else null."""
    part = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)linkedin\.com/(?:comm/)?jobs/view/([^/?#\s\"'<>]+)", 1)
    return F.nullif(F.when(part.rlike(r"^\d+$"), part).otherwise(F.regexp_extract(part, r"(\d{6,})\s*$", 1)), F.lit(""))


def network_url(c: Column) -> Column:
    """A posting's one address; other addresses without query, fragment, the mail prefix and trailing slashes. Null is empty."""
    number = posting_url_id(c)
    other = F.rtrim(F.replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?s)[?#].*$", ""), F.lit("/comm/"), F.lit("/")), F.lit("/"))
    return F.when(number.isNotNull(), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number)).otherwise(other)
