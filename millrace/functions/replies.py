"""Model replies, tailored documents, mail and errors: recovery and checks."""

from __future__ import annotations

import base64
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import normalize_text

_FENCE = re.compile(r"```[^\S\n]*([\w+-]*)[^\n]*\n(.*?)(?:```|\Z)", re.S)
_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.S)
_COMMA = re.compile(r'("(?:[^"\\]|\\.)*"?)|,(?=\s*[}\]])', re.S)
#: Spans of braces tried in one chunk of a reply.
MOST_SPANS = 40


def _object(chunk: str) -> dict | None:
    """chunk as a JSON object, if need be without commas before closing brackets."""
    for text in (chunk, _COMMA.sub(lambda m: m[1] or "", chunk)):
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            continue
        return value if isinstance(value, dict) else None
    return None


def _spans(chunk: str):
    """Balanced {...} spans from left to right; braces inside strings don't count."""
    for opening in re.finditer(r"\{", chunk):
        depth = 0
        for piece in _PIECE.finditer(chunk, opening.start()):
            depth += {"{": 1, "}": -1}.get(piece[0], 0)
            if not depth:
                yield chunk[opening.start() : piece.end()]
                break


def recover_json(reply: str | None) -> str | None:
    """The JSON object in a reply, written plainly: from fences tagged json, other fences, then the text; null if there is none."""
    fences = sorted(_FENCE.findall(reply or ""), key=lambda f: f[0].lower() not in ("json", "json5", "jsonc"))
    for chunk in [body for _, body in fences] + [reply or ""]:
        found = _object(chunk)
        for n, span in enumerate(_spans(chunk) if found is None else ()):
            if n == MOST_SPANS or (found := _object(span)) is not None:
                break
        if found is not None:
            return json.dumps(found, ensure_ascii=False)
    return None


def _batched(f, kind: str, c: Column) -> Column:
    """f over a column in Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return F.pandas_udf(run, kind)(c)


def extract_json(c: Column) -> Column:
    """recover_json over a column, in Arrow batches: the scan for balanced braces keeps state that expressions can't."""
    return _batched(recover_json, "string", c)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\A\s+|\s+\z", "")


def strip_fences(c: Column) -> Column:
    """The text without a code fence around the whole of it."""
    text = _stripped(c)
    inner = F.regexp_replace(F.regexp_replace(text, r"\A[^\n]*(?:\n|\z)", ""), r"(?:(?:\A|\n)[^\S\n]*```[^\n]*)+\z", "")
    return F.when(F.startswith(text, F.lit("```")), _stripped(inner)).otherwise(text)


def tailored_fault(base: Column, tailored: Column, name: Column, most: float = 2.0) -> Column:
    """Why a tailored document can't stand for its base: empty, the name gone, or over `most` times as long; null if it can."""
    old, new, who = _stripped(base), _stripped(tailored), normalize_text(name)
    lost = (who != "") & F.contains(normalize_text(old), who) & ~F.contains(normalize_text(new), who)
    return F.when(new == "", "empty").when(lost, "name lost").when((old != "") & (F.length(new) > most * F.length(old)), "too long")


def error_status(c: Column) -> Column:
    """The HTTP status that an error text names, else null."""
    return F.nullif(F.regexp_extract(c, r"HTTP (\d{3})", 1), F.lit("")).try_cast("int")


def redacted(c: Column, secrets: list[str]) -> Column:
    """The text without the given secrets of six characters or more, longest first."""
    for s in sorted({s for s in secrets if len(s) >= 6}, key=len, reverse=True):
        c = F.replace(c, F.lit(s), F.lit("***"))
    return c


def _parts(part: dict):
    yield part
    for inner in part.get("parts") or []:
        yield from _parts(inner)


def mail_text(message: str | None) -> str | None:
    """The body of a mail (JSON, parts in parts): its first HTML part in depth-first order, else its first plain one."""
    try:
        payload = json.loads(message)["payload"]
        parts = [p for p in _parts(payload) if (p.get("body") or {}).get("data")]
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        return None
    for kind in ("text/html", "text/plain"):
        for p in parts:
            if str(p.get("mimeType", "")).lower() == kind:
                data = re.sub(r"[^\w-]", "", p["body"]["data"], flags=re.A)
                return base64.urlsafe_b64decode(data[: len(data) - (len(data) % 4 == 1)] + "=" * (-len(data) % 4)).decode("utf-8", "replace")
    return None


def mail_body(c: Column) -> Column:
    return _batched(mail_text, "string", c)


_LINE = re.compile(r"\s*(?P<rule>(?:[-*_][ \t]*){3,})$|(?P<head>#{1,6})\s+(?P<title>.+)|\s*[-*+]\s+(?P<bullets>.+)|\s*\d+[.)]\s+(?P<ordered>.+)")


def markdown_blocks(text: str | None) -> list[dict]:
    """Blocks of a Markdown text, in order: h1 to h6, para, rule, and lists (bullets, ordered) of items."""
    blocks, last = [], None  # last: the block that a next line may go on with

    def put(kind: str, *items: str) -> dict:
        blocks.append({"kind": kind, "items": list(items)})
        return blocks[-1]

    for line in (text or "").splitlines():
        m, plain = _LINE.match(line), line.strip()
        kind = m and next((k for k in ("rule", "head", "bullets", "ordered") if m[k]), None)
        if not plain:
            last = None
        elif kind == "rule":
            last = put("rule") and None
        elif kind == "head":
            last = put(f"h{len(m['head'])}", m["title"].strip()) and None
        elif kind and last and last["kind"] == kind:
            last["items"].append(m[kind].strip())
        elif kind:
            last = put(kind, m[kind].strip())
        elif last:
            last["items"][-1] += " " + plain
        else:
            last = put("para", plain)
    return blocks


def parse_blocks(c: Column) -> Column:
    return _batched(lambda t: [(b["kind"], b["items"]) for b in markdown_blocks(t)], "array<struct<kind string, items array<string>>>", c)


def inline_markup(c: Column) -> Column:
    """Inline Markdown as simple HTML: escaped first, then links, code, bold, italics."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    for a, b in ((r"\[([^\]]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>'), (r"`([^`]+)`", "<code>$1</code>"), (r"\*\*(.+?)\*\*", "<b>$1</b>"), (r"(?<!\*)\*([^*]+)\*(?!\*)", "<i>$1</i>")):
        c = F.regexp_replace(c, a, b)
    return c
