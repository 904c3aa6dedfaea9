"""MinHash near-dedup: links documents whose sets of word shingles have Jaccard similarity of at least `percent` / 100.

Words are runs of non-blank bytes in ASCII lower case; a document's set holds its distinct runs of k words, or its whole
sequence if it has fewer. Method: a signature holds the least value under each of `values` hash functions, b = 32 bits
each. Two documents at the threshold differ in a binomial number of positions; `distance` lies over four standard
deviations beyond its mean. A multi-index Hamming join finds every pair of signatures within that distance: the positions
are split into chunks, by pigeonhole one chunk differs in at most one position, and each chunk is entered once for each
position left out. Candidates are confirmed on full sets.

Equal sets are one class and joined by digest first. Within an index entry only links between different components are
sought: first each member with the entry's least document (linear in its size), then, after these links are
confirmed and merged, the pairs of members of different components, in pairs of blocks of bounded size. Pairs are made and
confirmed inside a block pair, each in the first entry that holds it; only links leave it. A group of near copies so costs
about one comparison a member, and no link that could join two components is left out.

Defined cases: null, empty or blank text has an empty set, is linked with nothing and stays; repeated rows with one doc_id
count as one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.components import components
from millrace.llm.storage import of_ids, per_row, table, without_ids, written

VALUES, DISTANCE, CHUNKS, BLOCK = 32, 19, 10, 512
_MULT = np.random.default_rng(5).integers(1, 1 << 62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(6).integers(1, 1 << 63, VALUES, dtype=np.uint64)


def index_parts(values: int, chunks: int, distance: int) -> list[np.ndarray]:
    """Position lists of the index entries. Chunks with one allowed error each cover distance < 2 * chunks."""
    if distance >= 2 * chunks:
        raise ValueError("some chunk may differ in two positions")
    return [np.array(p) for c in np.array_split(np.arange(values), chunks) for p in itertools.combinations(c.tolist(), max(1, len(c) - 1))]


def _sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each row."""
    for _, offsets, data in T.blocks(column):
        _, _, rows, h = T.words(data, offsets, T.NONBLANK)
        sh = T.shingles(h, k)
        for a, b in itertools.pairwise(rows.tolist()):
            yield np.unique(sh[a : b - k + 1]) if b - a >= k else np.array([T.sequence_hash(h[a:b])] if b > a else [], np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least hash under each function."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i : i + 4096, None] * _MULT + _ADD).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _summaries(k: int):
    def run(batches):
        for b in batches:
            n, digest, sig = [], [], []
            for s in _sets(b.column(1), k):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "digest", "sig"])

    return run


def _entries(parts):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, VALUES).astype(np.uint64)
            salt = T.mix(np.arange(1, len(parts) + 1, dtype=np.uint64))
            keys = np.stack([T.mix((sig[:, p] * _MULT[p]).sum(axis=1, dtype=np.uint64) + salt[i : i + 1]) for i, p in enumerate(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(len(parts), dtype=np.int32), len(keys))), pa.array(np.repeat(b.column(0).to_numpy(), len(parts)))], ["key", "part", "id"])

    return run


def _full(k: int):
    def run(batches):
        for b in batches:
            sets = [s.view(np.int64) for s in _sets(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), T.list_column(sets, pa.int64())], ["id", "s"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            (oa, va), (ob, vb) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (b.column(2), b.column(3)))
            for i in range(b.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _slices(t: pa.Table, parts: list[np.ndarray], distance: int, percent: int):
    """(row, other rows) of an entry's block pair: of different components, near in signature and size, in no earlier entry together."""
    comp, side, n = t["component"].to_numpy(), t["side"].to_numpy(), t["n"].to_numpy()
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
    earlier = parts[: t["part"][0].as_py()]
    two = bool((side == 1).any())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(comp)),) * 2
    for i in range(0, len(left), 64):
        l = left[i : i + 64]
        near = (sig[l][:, None, :] != sig[right][None, :, :]).sum(axis=2) <= distance
        near &= (comp[l][:, None] != comp[right]) & (100 * np.minimum(n[l][:, None], n[right]) >= percent * np.maximum(n[l][:, None], n[right]))
        if not two:
            near &= l[:, None] < right
        x, y = np.nonzero(near)
        x, y = l[x], right[y]
        for p in earlier:
            new = ~(sig[x][:, p] == sig[y][:, p]).all(axis=1)
            x, y = x[new], y[new]
        for r in np.unique(x).tolist():
            yield r, y[x == r]


def _needed(parts, distance, percent):
    """The rows of an entry's block pair that have something to compare there."""

    def run(t: pa.Table) -> pa.Table:
        rows = [np.zeros(0, np.int64)]
        for r, others in _slices(t, parts, distance, percent):
            rows += [np.array([r]), others]
        return t.take(pa.array(np.unique(np.concatenate(rows))))

    return run


def _links(parts, distance, percent):
    """The confirmed links of an entry's block pair, from the full sets s of its rows."""

    def run(t: pa.Table) -> pa.Table:
        ids, n = t["id"].to_numpy(), t["n"].to_numpy()
        column = t["s"].combine_chunks()
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, others in _slices(t, parts, distance, percent):
            own = values[offsets[r] : offsets[r + 1]]
            for o in np.array_split(others, max(1, len(others) // 64)):
                them = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in o])
                found = own[np.minimum(np.searchsorted(own, them), len(own) - 1)] == them
                both = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(n[o])[:-1]]))
                o = o[100 * both >= percent * (n[r] + n[o] - both)]
                a.append(np.minimum(ids[r], ids[o]))
                b.append(np.maximum(ids[r], ids[o]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of docs (id, text) whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    full = of_ids(docs, ids, "id").mapInArrow(T.tidy(_full(k)), "id bigint, s array<bigint>")
    full = full.groupBy("id").agg(F.first("s").alias("s"))
    got = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return written(got.select("a", "b", "sa", "sb").mapInArrow(T.tidy(_confirmed(percent)), "a bigint, b bigint"), "confirmed")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, distance: int = DISTANCE, chunks: int = CHUNKS, block: int = BLOCK, doc: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; distance and chunks as in the module's text."""
    texts = docs.select(F.col(doc).alias("doc_id"), "text")
    base = written(texts.mapInArrow(T.tidy(_summaries(k)), "doc_id bigint, n bigint, digest binary, sig binary"), "signatures")
    classes = written(base.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    parts = index_parts(VALUES, chunks, distance)
    entries = classes.select("id", "sig").mapInArrow(T.tidy(_entries(parts)), "key bigint, part int, id bigint")
    shared = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("hub")).filter("c > 1")
    entries = written(entries.join(shared, "key"), "entries")
    sigs, text_of = classes.select("id", "n", "sig"), texts.withColumnRenamed("doc_id", "id")

    # the entry's least document with each other member
    stars = entries.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    differ = F.expr(f"aggregate(sequence(0, {VALUES - 1}), 0, (n, i) -> n + if(substring(sa, i * 4 + 1, 4) = substring(sb, i * 4 + 1, 4), 0, 1))")
    stars = (
        stars.join(sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
        .join(sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
        .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .filter(differ <= distance)
        .select("a", "b")
    )
    links = _verify(text_of, written(stars, "stars"), k, percent)
    first = components(links)

    # what is left of an entry: members of different components
    member = entries.join(first, "id", "left").select("key", "part", "id", "c", F.coalesce("component", "id").alias("component"))
    mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    member = member.join(mixed, "key").join(sigs, "id").withColumn("nb", F.ceil(F.col("c") / block).cast("int")).withColumn("bk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "key", F.least("bk", "other").alias("x"), F.greatest("bk", "other").alias("y"), "part", F.when(F.col("bk") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "component", "n", "sig"
    )
    # small rows with much to do: as many tasks as partitions are set, however few bytes they are
    member = member.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "x", "y")
    member = written(member.groupBy("key", "x", "y").applyInArrow(_needed(parts, distance, percent), member.schema), "rest")
    full = of_ids(text_of, member.select("id").distinct(), "id").mapInArrow(T.tidy(_full(k)), "id bigint, s array<bigint>").groupBy("id").agg(F.first("s").alias("s"))
    rest = member.join(full, "id").groupBy("key", "x", "y").applyInArrow(_links(parts, distance, percent), "a bigint, b bigint")
    links = written(links.union(rest), "links")
    of = components(links)

    label = classes.join(of, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return base.join(label, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept")
    )


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least id stays.

    docs needs doc_id and text; all columns pass through, whatever their names. Null, empty and blank texts are linked with nothing and
    stay; rows with a null or repeated doc_id are decided row by row, those without an id after the others; an empty table gives
    an empty one.
    """
    return per_row(docs, lambda d: without_ids(d, near_duplicates(d).filter("not kept"), "doc_id"))


OP8_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as materialized (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) st from d),
x as materialized (select doc_id, unnest(st) t from s),
n as (select doc_id, len(st) n from s),
g as materialized (select t, list(doc_id) ids, min(doc_id) lo from x group by t having count(*) > 1),
p as materialized (select a.doc_id a, b.doc_id b, count(*) c from x a join x b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
e as materialized (select a, b from l union select b, a from l),
r(id, c) as (select doc_id, doc_id from d union select e.b, r.c from r join e on e.a = r.id where r.c < e.b)
select s.doc_id, cast(len(st) as bigint) n_shingles, m.c component_id, s.doc_id = m.c kept from s join (select id, min(c) c from r group by 1) m on m.id = s.doc_id
"""
