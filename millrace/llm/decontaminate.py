"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `size` consecutive words of an item (a shorter, non-empty item is one window). A document word inside any
occurrence of a window is hit. Words are runs of alphanumeric bytes in ASCII lower case.

Method. Windows and documents are sets of positioned shingles (`shingle` words, or the whole window where it is shorter).
Containment of a window in a document needs all its shingles, so a necessary prefix has one: the rarest, by counts over all
documents. Documents are joined on that shingle; the window must fit between the document's ends (position and length
bounds), and the words around the shingle must equal the window's words, compared as text.

Documents look shingles up in a bitmap of bounded size (2**bits bits) before anything is emitted. A false positive there only
makes a row that the join drops, so the bitmap is bounded without being a limit on the benchmark's size. A document with
the same passage many times, or a passage in a third of all documents, makes rows in proportion to its occurrences only.

Defined cases: null or empty text has no words and no hits; repeated items and repeated rows each count for their own id;
items without words have no windows; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.storage import bounded_batches, per_row, table, without_ids, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def _windows(size: int, shingle: int):
    """item rows -> one row for each window with its shingles: (item, words, shingle hash, offset)."""

    def run(batches):
        for b in batches:
            out = {"item_id": [], "win": [], "h": [], "off": []}
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = item_words(text)
                if not ws:
                    continue
                joined = " ".join(ws).encode()
                h = T.words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), T.ALNUM)[3]
                k = min(shingle, len(ws))
                sh = T.shingles(h, k).view(np.int64)
                n = min(size, len(ws))
                for i in range(len(ws) - n + 1):
                    win = " ".join(ws[i : i + n])
                    for j in range(n - k + 1):
                        out["item_id"].append(item)
                        out["win"].append(win)
                        out["h"].append(int(sh[i + j]))
                        out["off"].append(j)
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.string()), pa.array(out["win"], pa.string()), pa.array(out["h"], pa.int64()), pa.array(out["off"], pa.int32())], ["item_id", "win", "h", "off"])

    return run


def _bits(spark: SparkSession, hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes, of 2**bits bits. One row a set word of 64 bits reaches the driver."""
    slot = F.col("h").bitwiseAND((1 << bits) - 1)
    rows = hashes.select((F.shiftright(slot, 6)).alias("w"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap.view(np.uint64)[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _hits(data, offsets, lengths, bitmap):
    """(word starts, word ends, row boundaries, [(position, length, hash)]) of shingles that the bitmap holds."""
    s, e, rows, h = T.words(data, offsets, T.ALNUM)
    found = []
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    for k in lengths:
        sh = T.shingles(h, k)
        at = np.flatnonzero(_in(bitmap, sh)) if len(sh) else np.zeros(0, np.int64)
        at = at[row_of[at] == row_of[at + k - 1]]
        found.append((at, k, sh[at]))
    return s, e, rows, row_of, found


def _counts(lengths, bitmap):
    def run(batches):
        for b in batches:
            seen = [np.zeros(0, np.uint64)]
            for _, offsets, data in T.blocks(b.column(0)):
                seen += [x[2] for x in _hits(data, offsets, lengths, bitmap)[4]]
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return run


def _candidates(lengths, bitmap, size):
    """One row a document: its number of words and its hits, each with the words around it."""
    hit = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("from", pa.int32()), ("near", pa.string())]))

    def run(batches):
        for b in batches:
            for first, offsets, data in T.blocks(b.column(1)):
                s, e, rows, row_of, found = _hits(data, offsets, lengths, bitmap)
                low = T.LOWER[data].tobytes()
                out: list[list] = [[] for _ in range(len(rows) - 1)]
                for at, k, h in found:
                    for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        r = int(row_of[p])
                        lo, hi = max(int(rows[r]), p - size + 1), min(int(rows[r + 1]), p + size)
                        near = b" ".join(low[s[i] : e[i]] for i in range(lo, hi)).decode()
                        out[r].append({"h": x, "pos": p - int(rows[r]), "from": lo - int(rows[r]), "near": near})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows) - 1).cast(pa.int64()), pa.array(np.diff(rows), pa.int64()), pa.array(out, hit)], ["doc_id", "n_words", "hits"])

    return run


def find_items(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3, bits: int | None = None, doc: str = "doc_id", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_words; occurrences: doc_id, start, len, item_id) of item windows in documents. bits: of the bitmap, by the number of shingles if not given."""
    spark = docs.sparkSession
    bounded_batches(spark)
    windows = written(items.select(F.col(item).cast("string").alias("item_id"), "text").mapInArrow(T.tidy(_windows(size, shingle)), "item_id string, win string, h bigint, off int"), "windows")
    # about 16 bits a shingle, so that few others pass; 2**26 bits, 8 MB, at most: beyond, more rows pass and the result is the same
    known = windows.select("h").distinct().count()
    bits = bits or min(26, max(20, (16 * known).bit_length()))
    lengths = [r[0] for r in windows.select(F.least(F.lit(shingle), F.size(F.split("win", " "))).alias("k")).distinct().collect()]  # at most `shingle` values
    counts = docs.select("text").mapInArrow(T.tidy(_counts(lengths, _bits(spark, windows.select("h").distinct(), bits))), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    rarest = windows.join(counts, "h", "left").groupBy("item_id", "win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("r"))
    # a window of which a shingle never occurs can't occur
    needed = written(rarest.filter("r.n > 0").select("item_id", "win", F.col("r.h").alias("h"), F.col("r.off").alias("off"), F.size(F.split("win", " ")).alias("len")), "prefix")
    base = written(docs.select(F.col(doc).alias("doc_id"), "text").mapInArrow(T.tidy(_candidates(lengths, _bits(spark, needed.select("h").distinct(), bits), size)), "doc_id bigint, n_words bigint, hits array<struct<h:bigint,pos:int,`from`:int,near:string>>"), "hits")
    keys = needed.groupBy("h", "win", "off", "len").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = (
        base.filter("size(hits) > 0").select("doc_id", "n_words", F.explode("hits").alias("x")).select("doc_id", "n_words", "x.*")
        .join(keys, "h")
        .withColumn("start", F.col("pos") - F.col("off"))
        .filter("start >= 0 and start + len <= n_words")
        .filter(F.expr("array_join(slice(split(near, ' '), start - `from` + 1, len), ' ') = win"))
        .select("doc_id", "start", "len", F.explode("items").alias("item_id"))
    )
    return base.select("doc_id", "n_words"), found


def decontaminate(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    base, found = find_items(docs, items, **kw)
    spans = found.select("doc_id", "start", "len").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", F.expr("start + len").alias("end")))).alias("spans"))
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'to', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.end - greatest(a.to, x.start)), 'to', greatest(a.to, x.end)), a -> a.n)")
    ids = found.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    per_doc = spans.select("doc_id", n_hit.alias("n_hit")).join(ids, "doc_id")
    return base.join(per_doc, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a benchmark passage go.

    docs needs doc_id and text, the table benchmark item_id and text; all columns of docs pass through, whatever their names. Null
    and empty texts stay; rows with a null or repeated doc_id are decided row by row; with an empty benchmark all rows stay; an
    empty table gives an empty one.
    """
    items = table(spark, sf_dir, "benchmark")
    return per_row(docs, lambda d: without_ids(d, decontaminate(d, items).filter("contaminated"), "doc_id"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
with d as (select doc_id, {_W} ws from documents),
b as (select cast(item_id as varchar) item_id, {_W} ws from benchmark),
w as (select distinct item_id, least(10, len(ws)) n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') win
      from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) i from b where len(ws) > 0)),
ns as (select distinct n from w),
p as (select doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') win
      from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) s from d, ns where len(ws) >= n)),
f as (select doc_id, s, p.n, item_id from p join w on p.win = w.win and p.n = w.n),
h as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(s, s + n)) pos from f) group by 1),
i as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from f group by 1)
select d.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join i using (doc_id)
"""
