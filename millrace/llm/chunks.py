"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests find repeated chunks.

A cut falls after a byte where `bits` bits of the gear hash (sum of a random value for each byte, doubled at each step; the bits
read depend on the last `bits` + 16 bytes) are zero, at least `least` and at most `most` bytes after the last cut, and not
within the last `least` bytes of a text. Cuts depend on the text around them only, so an insertion moves the cuts after it
and changes the chunks it touches alone. Of equal chunks (128-bit digest) the first in order of (doc_id, position) stays; every
later one is removed, whatever its length.

A chunk that a third of all documents hold is counted by partial aggregation before the shuffle and joined back by a
join that Spark can split.

Defined cases: null or empty text has no chunks; a text shorter than twice `least` is one chunk; the first of repeated rows
with the same doc_id is told by position only, so both keep it; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.storage import table, written

BITS, LEAST, MOST = 5, 56, 1024
_GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)
SPAN = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: sum over j < 32 of the value of the byte j back, shifted left by j."""
    h = _GEAR[data]
    for j in (1, 2, 4, 8, 16):
        prev = h
        h = prev.copy()
        h[j:] += prev[:-j] << np.uint32(j)
    return h


def cuts(data: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of one text."""
    mask = np.uint32(((1 << bits) - 1) << 16)
    out, last, n = [], 0, len(data)
    for c in (np.flatnonzero((gear(data) & mask) == 0) + 1).tolist():
        while c - last > most:
            last += most
            out.append(last)
        if c - last >= least and n - c >= least:
            out.append(c)
            last = c
    while n - last >= most + least:
        last += most
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _chunks(params):
    def run(batches):
        for b in batches:
            ids = b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            doc, frm, to, one = [], [], [], []
            for first, offsets, data in T.blocks(b.column(1)):
                raw = data.tobytes()
                for r, (lo, hi) in enumerate(itertools.pairwise(offsets.tolist())):
                    last = 0
                    for c in cuts(data[lo:hi], *params) if hi > lo else ():
                        doc.append(ids[first + r])
                        frm.append(last)
                        to.append(c)
                        one.append(hashlib.blake2b(raw[lo + last : lo + c], digest_size=16).digest())
                        last = c
            two = np.frombuffer(b"".join(one), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(doc, np.int64)), pa.array(np.array(frm, np.int32)), pa.array(np.array(to, np.int32)), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())],
                ["doc_id", "from", "to", "d1", "d2"],
            )

    return run


def removed_spans(docs: DataFrame, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """docs: doc_id, text. doc_id, spans: the runs of later copies, for the documents that have any."""
    # written, as two plans read them and texts should be cut once
    chunks = written(docs.mapInArrow(T.tidy(_chunks((bits, least, most))), "doc_id bigint, `from` int, `to` int, d1 bigint, d2 bigint"), "chunks")
    many = chunks.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "from")).alias("first")).filter("c > 1").drop("c")
    later = chunks.join(many, ["d1", "d2"]).filter("doc_id <> first.doc_id or `from` <> first.`from`")
    spans = later.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("x"))
    merged = F.expr(
        "aggregate(x, cast(array() as array<struct<`from`:int,`to`:int>>), (a, y) -> if(size(a) > 0 and element_at(a, -1).`to` = y.`from`, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('from', element_at(a, -1).`from`, 'to', y.`to`))), concat(a, array(y))))"
    )
    return spans.select("doc_id", merged.alias("spans"))


def cut_out(docs: DataFrame, spans: DataFrame, tail: str = "") -> DataFrame:
    """docs (doc_id, text) with the spans' bytes removed: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, as asked, the kept bytes."""

    def run(batches):
        for b in batches:
            ids, spans_of, out = b.column(0).cast(pa.int64()), b.column(2).to_pylist(), []
            for first, offsets, data in T.blocks(b.column(1)):
                raw = data.tobytes()
                for r, (lo, hi) in enumerate(itertools.pairwise(offsets.tolist())):
                    gone = spans_of[first + r] or []
                    at, parts = lo, []
                    for s in gone:
                        parts.append(raw[at : lo + s["from"]])
                        at = lo + s["to"]
                    kept = b"".join([*parts, raw[at:hi]])
                    out.append((hi - lo, sum(s["to"] - s["from"] for s in gone), len(gone), hashlib.sha256(kept).hexdigest(), kept if tail else b""))
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([ids, *cols[: 5 if tail else 4]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if tail else 5])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * bool(tail)
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(T.tidy(run), schema)


def dedup_chunks(docs: DataFrame, doc: str = "doc_id", **kw) -> DataFrame:
    texts = docs.select(F.col(doc).alias("doc_id"), "text")
    return cut_out(texts, written(removed_spans(texts, **kw), "spans"))


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    return dedup_chunks(table(spark, sf_dir, "documents"))
