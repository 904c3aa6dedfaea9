"""Exact substring dedup by merging Burrows-Wheeler transforms of shards.

Every byte covered by a string of `width` bytes that also starts anywhere else in the corpus is removed; strings don't cross
documents, may overlap, and are judged on the input.

Which text meets where. The least hash among a window's grams of GRAM bytes depends on the window alone, so equal windows choose
the same gram. Runs of windows with the same chosen gram are segments; each window lies in one segment and equal windows
have the same gram hash. Grams that occur once are dropped by a count, equal segments are counted as one, and only one
text of each distinct segment is fetched. Segments with the same gram go to the same bucket. A gram with more than
GRAM_BYTES of segments has them split again by another hash of the same kind, up to SPLITS times; windows that are still
together in such a number are compared one by one through their digests, so no bucket is unbounded.

In a bucket. A symbol is a word of SYMBOL bytes, and a text is SYMBOL strings of such words, one for each first byte, each with an
end of its own that sorts before all words. The bucket's texts are dealt to shards; each shard sorts its own suffixes once and
makes its transform: the symbol before each suffix, in suffix order. From there on only the transforms are read. The merge
starts with the shards' rows one after the other; each round goes through the rows in the present order and deals them out
by their transforms' symbols, which is the order by one symbol more. The round in which two neighbours part gives
their common prefix; it ends when a round changes neither the interleave nor a prefix, or `width` bytes are reached.
Runs of rows whose neighbours have not parted are the repeated strings, and each row is its shard's suffix of that place.

Defined cases: null and empty text have no bytes; texts shorter than `width` lose nothing; exact copies lose all; a repeated row
is a second occurrence; long runs of one byte make many equal segments, counted as one; very long texts are cut into
overlapping slices; an empty table gives an empty result; other columns are ignored. Rows are told apart by doc_id; of rows
with the same doc_id each loses what any of them shares.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.chunks import cut_out
from millrace.llm.storage import of_ids, release, table, written

WIDTH, GRAM, SYMBOL, SHARD_BYTES, BUCKET_BYTES, GRAM_BYTES, SPLITS = 200, 32, 8, 16 << 10, 48 << 10, 1 << 20, 3
#: Windows that start in one slice of a text.
SLICE = 1 << 22
_PLACE = np.uint64((1 << 28) - 1)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[: len(key) - (width - have)], key[width - have :]) if have < width else key


def segments(data: np.ndarray, offsets: np.ndarray, width: int, salt: int = 0):
    """(row, start, end, gram hash, segment hash) of the segments of a block; starts and ends are the block's."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    if len(data) > int(_PLACE):
        raise ValueError("a block this long is to be cut into slices")
    sums = T.prefix(data)
    i = np.arange(len(data) - GRAM + 1)
    h = T.range_hash(sums, i, i + GRAM)
    if salt:
        h = T.mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    gram = (_least((h & ~_PLACE) | i.astype(np.uint64), width - GRAM + 1) & _PLACE).astype(np.int64)
    start = np.arange(len(gram))
    row = np.searchsorted(offsets, start, side="right") - 1
    ok = start + width <= offsets[row + 1]
    start, gram, row = start[ok], gram[ok], row[ok]
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    s, e = start[first], start[last] + width
    return row[first], s, e, h[gram[first]], T.range_hash(sums, s, e)


def _segment_rows(width: int):
    def run(batches):
        for b in batches:
            ids = b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for first, offsets, data in T.blocks(b.column(1)):
                # a block beyond one slice is one text
                for at in range(0, max(1, len(data) - width + 1), SLICE):
                    part = data[at : at + SLICE + width - 1]
                    row, s, e, gram, whole = segments(part, offsets if len(part) == len(data) else np.array([0, len(part)]), width)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(gram.view(np.int64)),
                            pa.array(whole.view(np.int64)),
                            pa.array(ids[first + row]),
                            pa.array((at + s - offsets[row]).astype(np.int32)),
                            pa.array((e - s).astype(np.int32)),
                        ],
                        ["gram", "seg", "doc_id", "start", "len"],
                    )

    return run


_PART = "key bigint, gram bigint, seg bigint, off int, part binary"


def _batched(out: list[tuple]):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for i in range(0, max(1, len(out)), 4096):
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out[i : i + 4096]], k) for c, k in enumerate(kinds)], ["key", "gram", "seg", "off", "part"])


def _fetched(batches):
    """Documents with the segments wanted of them -> a row for each."""
    for b in batches:
        out: list[tuple] = []
        for text, want in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            out += [(w["gram"], w["gram"], w["seg"], 0, raw[w["start"] : w["start"] + w["len"]]) for w in want]
        yield from _batched(out)


def _split(width: int, salt: int):
    """Rows of too large keys, split by another hash."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for key, gram, seg, off, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, s, e, g, _ = segments(np.frombuffer(part, np.uint8), np.array([0, len(part)]), width, salt=salt)
                g = T.mix(g ^ np.uint64(key & (1 << 64) - 1)).view(np.int64)
                out += [(k, gram, seg, off + x, part[x:y]) for x, y, k in zip(s.tolist(), e.tolist(), g.tolist(), strict=True)]
            yield from _batched(out)

    return run


def _windows(width: int):
    """A row for each window of the rows: two halves of its digest, gram, seg, off."""

    def run(batches):
        for b in batches:
            for gram, seg, off, part in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                n = len(part) - width + 1
                two = np.frombuffer(b"".join(hashlib.blake2b(part[i : i + width], digest_size=16).digest() for i in range(n)), np.int64).reshape(-1, 2)
                cols = [two[:, 0].copy(), two[:, 1].copy(), np.full(n, gram), np.full(n, seg), np.arange(off, off + n, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["d1", "d2", "gram", "seg", "off"])

    return run


def stable_order(codes: np.ndarray) -> np.ndarray:
    """A stable argsort of small non-negative integers, by 16 bits at a time."""
    if not len(codes) or int(codes.max()) < 1 << 16:
        return np.argsort(codes.astype(np.uint16), kind="stable")
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]


def shard_order(codes: np.ndarray, after: np.ndarray, depth: int) -> np.ndarray:
    """The rows of one shard sorted by `depth` symbols. after: the row one symbol later, or -1 where the string ends."""
    n = len(codes)
    order = stable_order(codes)
    rank = np.empty(n, np.int32)
    rank[order] = np.concatenate([[0], np.cumsum(codes[order][1:] != codes[order][:-1])])
    ends = np.flatnonzero(after < 0)
    have = 1
    while have < depth:
        # a string's end sorts before all else, ends among themselves by row
        later = rank[after] + n
        later[ends] = np.arange(len(ends))
        order = stable_order(later)
        order = order[stable_order(rank[order])]
        r, x = rank[order], later[order]
        new = np.concatenate([[0], np.cumsum((r[1:] != r[:-1]) | (x[1:] != x[:-1]))])
        rank = np.empty(n, np.int32)
        rank[order] = new
        if new[-1] == n - 1:
            break
        after = np.where(after < 0, -1, after[after])
        ends = np.flatnonzero(after < 0)
        have *= 2
    return order


def transform(codes: np.ndarray, before: np.ndarray, after: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(the suffix of each row, or -1 for an end; the symbol before it, or -1 at a string's first) of one shard, the ends first."""
    order = shard_order(codes, after, depth)
    back = before[order]
    symbols = np.where(back < 0, -1, codes[back])
    last = np.flatnonzero(after < 0)
    return np.concatenate([np.full(len(last), -1), order]), np.concatenate([codes[last], symbols])


def merge(symbols: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Interleave of the shards' transforms, common prefixes, rounds taken.

    symbols: each shard's transform, its `ends` rows of ends first. The interleave holds a row of the shards' rows end to end at each
    place; as a shard's rows keep their order, that is no more than the shard's number. A prefix is that of a row with the
    row before it, in symbols, up to depth.
    """
    flat = np.concatenate(symbols).astype(np.int32)
    sizes = np.array([len(x) for x in symbols])
    base = np.cumsum(sizes) - sizes
    # where each row goes in its own shard when the shard's rows are dealt out by their symbols
    to = np.full(len(flat), -1, np.int32)
    for b, x, d in zip(base.tolist(), symbols, ends, strict=True):
        inner = np.flatnonzero(x >= 0)
        to[b + inner[stable_order(x[inner])]] = b + d + np.arange(len(inner))
    first = np.concatenate([np.arange(b, b + d, dtype=np.int32) for b, d in zip(base.tolist(), ends, strict=True)])
    rest = np.concatenate([np.arange(b + d, b + n, dtype=np.int32) for b, d, n in zip(base.tolist(), ends, sizes.tolist(), strict=True)])
    n_ends = len(first)
    order = np.concatenate([first, rest])
    parted = np.zeros(len(flat), np.int16)
    block = np.zeros(len(flat), np.int32)
    deal = flat.astype(np.uint16) if not len(flat) or int(flat.max()) < 1 << 16 else flat
    within_text = flat >= 0
    rounds = 0
    while rounds < depth:
        rounds += 1
        src = np.flatnonzero(within_text[order])
        rows = order[src]
        s = deal[rows]
        by = np.argsort(s, kind="stable") if deal is not flat else stable_order(s)
        src, rows, s = src[by], rows[by], s[by]
        within = block[src]
        new = np.concatenate([first, to[rows]])
        cut = parted == 0
        cut[n_ends + 1 :] &= (s[1:] != s[:-1]) | (within[1:] != within[:-1])
        some = bool(cut.any())
        if some:
            parted[cut] = rounds
            block = np.cumsum(parted > 0, dtype=np.int32)
        elif np.array_equal(new, order):
            break
        order = new
    return order, np.where(parted > 0, parted - 1, depth), rounds


def repeated(parts: list[bytes], width: int = WIDTH, symbol: int = SYMBOL, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts end to end: whether a string of `width` bytes starts at each byte that also starts at another, and the texts' offsets."""
    if width % symbol:
        raise ValueError("width must be a multiple of symbol")
    sizes = np.array([len(p) for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n, depth = int(offsets[-1]), width // symbol
    out = np.zeros(n, bool)
    data = np.frombuffer(b"".join(parts) + bytes(symbol), np.uint8)
    at = np.arange(n)
    start, end = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
    word = np.zeros(n, np.uint64)
    for j in range(symbol):
        word = (word << np.uint64(8)) | data[j : n + j]
    # rows are the bytes at which a whole word starts
    place = np.flatnonzero(at + symbol <= end)
    if not len(place):
        return out, offsets
    codes = np.unique(word[place], return_inverse=True)[1].astype(np.int32)
    row = np.empty(n, np.int64)
    row[place] = np.arange(len(place))
    before = np.where(place - symbol >= start[place], row[np.maximum(place - symbol, 0)], -1)
    after = np.where(place + 2 * symbol <= end[place], row[np.minimum(place + symbol, n - 1)], -1)

    suffixes, symbols, ends, lo = [], [], [], 0
    while lo < len(place):
        # the texts of a shard; a longer one makes a shard of its own
        text = int(np.searchsorted(offsets, place[lo], side="right"))
        stop = max(text, int(np.searchsorted(offsets, offsets[text - 1] + shard_bytes, side="right")) - 1)
        hi = int(np.searchsorted(place, offsets[stop]))
        own, bwt = transform(codes[lo:hi], np.where(before[lo:hi] < 0, -1, before[lo:hi] - lo), np.where(after[lo:hi] < 0, -1, after[lo:hi] - lo), depth)
        suffixes.append(np.where(own < 0, -1, own + lo))
        symbols.append(bwt)
        ends.append(int((own < 0).sum()))
        lo = hi
    order, common, _ = merge(symbols, ends, depth)
    # maximal runs of rows that share `depth` symbols with their neighbours
    many = common >= depth
    many[:-1] |= many[1:]
    out[place[np.concatenate(suffixes)[order[many]]]] = True
    return out, offsets


def runs(flags: np.ndarray, width: int) -> list[dict]:
    """Byte ranges covered by the strings of `width` bytes that start where flags are set."""
    i = np.flatnonzero(flags)
    if not len(i):
        return []
    new = np.flatnonzero(np.concatenate([[True], i[1:] > i[:-1] + width]))
    ends = i[np.append(new[1:], len(i)) - 1] + width
    return [{"from": int(a), "to": int(b)} for a, b in zip(i[new], ends, strict=True)]


def _merge(width: int):
    def run(t: pa.Table) -> pa.Table:
        parts = t["part"].to_pylist()
        flags, offsets = repeated(parts, width)
        spans = [runs(flags[a:b], width) for a, b in itertools.pairwise(offsets.tolist())]
        off = t["off"].to_pylist()
        spans = [[{"from": s["from"] + o, "to": s["to"] + o} for s in x] for x, o in zip(spans, off, strict=True)]
        return pa.table({"gram": t["gram"], "seg": t["seg"], "spans": pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))})

    return run


_SPANS = "array<struct<`from`:int,`to`:int>>"


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs: doc_id, text. doc_id, spans: the merged byte ranges to remove, for the documents that have any."""
    spark = docs.sparkSession
    # written, as the count and the join read them and texts should be hashed once
    found = written(docs.mapInArrow(T.tidy(_segment_rows(width)), "gram bigint, seg bigint, doc_id bigint, start int, len int"), "found")
    grams = found.groupBy("gram").agg(F.count("*").alias("c"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).filter("c > 1")
    grams = written(grams.select("gram", (F.col("lo") < F.col("hi")).alias("several")), "grams")
    some = written(found.join(grams, "gram"), "occurrences")
    release(spark, found, grams)
    distinct = some.filter("several").groupBy("gram", "seg").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start", "len")).alias("at"))
    distinct = written(distinct.select("gram", "seg", "c", "at.*"), "segments")

    def parts_of(segs: DataFrame) -> DataFrame:
        wanted = segs.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "seg", "start", "len")).alias("want"))
        texts = of_ids(docs, segs.select("doc_id").distinct(), "doc_id").join(wanted, "doc_id")
        return texts.select("text", "want").mapInArrow(T.tidy(_fetched), _PART)

    def heavy(rows: DataFrame, key: str, size: Column) -> DataFrame:
        return written(rows.groupBy(key).agg(F.sum(size.cast("long")).alias("bytes")).filter(F.col("bytes") > GRAM_BYTES).select(key), "heavy")

    total = distinct.agg(F.sum(F.col("len").cast("long"))).first()[0] or 0
    hot = heavy(distinct, "gram", F.col("len"))
    one_by_one = None
    if hot.limit(1).count():
        parts = parts_of(distinct.join(hot, "gram", "left_anti"))
        rows = parts_of(distinct.join(hot, "gram", "left_semi"))
        for salt in range(1, SPLITS + 1):
            rows = written(rows.mapInArrow(T.tidy(_split(width, salt)), _PART), "split")
            hot = heavy(rows, "key", F.length("part"))
            parts = parts.union(rows.join(hot, "key", "left_anti"))
            if not hot.limit(1).count():
                break
            rows = rows.join(hot, "key", "left_semi")
        else:
            each = written(rows.mapInArrow(T.tidy(_windows(width)), "d1 bigint, d2 bigint, gram bigint, seg bigint, off int"), "windows")
            twice = each.groupBy("d1", "d2").count().filter("count > 1").drop("count")
            one_by_one = each.join(twice, ["d1", "d2"]).select("gram", "seg", F.struct(F.col("off").alias("from"), (F.col("off") + width).alias("to")).alias("s"))
    else:
        parts = parts_of(distinct)

    buckets = int(total // BUCKET_BYTES) + 1
    tasks = max(1, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).repartition(tasks, "bucket")
    merged = merged.groupBy("bucket").applyInArrow(_merge(width), f"gram bigint, seg bigint, spans {_SPANS}")
    merged = merged.filter("size(spans) > 0").select("gram", "seg", F.explode("spans").alias("s"))
    if one_by_one is not None:
        merged = merged.union(one_by_one)
    merged = merged.groupBy("gram", "seg").agg(F.collect_set("s").alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("len").alias("to")))
    twice = distinct.select("gram", "seg", "c").join(merged, ["gram", "seg"], "left").filter("c > 1 or spans is not null")
    of_many = some.filter("several").join(written(twice, "repeats"), ["gram", "seg"])
    of_many = of_many.select("doc_id", "start", F.explode(F.when(F.col("c") > 1, whole).otherwise(F.col("spans"))).alias("s"))
    of_one = some.filter("not several").select("doc_id", "start", F.explode(whole).alias("s"))
    moved = F.struct((F.col("start") + F.col("s.from")).alias("from"), (F.col("start") + F.col("s.to")).alias("to"))
    spans = of_many.union(of_one).select("doc_id", moved.alias("s"))
    joined = F.expr(
        f"aggregate(x, cast(array() as {_SPANS}), (a, y) -> if(size(a) > 0 and element_at(a, -1).`to` >= y.`from`, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('from', element_at(a, -1).`from`, 'to', greatest(element_at(a, -1).`to`, y.`to`)))), concat(a, array(y))))"
    )
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("x")).select("doc_id", joined.alias("spans"))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, doc: str = "doc_id") -> DataFrame:
    texts = docs.select(F.col(doc).alias("doc_id"), "text")
    return cut_out(texts, written(repeated_spans(texts, width), "spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    return dedup_substrings(table(spark, sf_dir, "documents"))
