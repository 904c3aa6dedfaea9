"""Line dedup by an exact set-similarity join, in DataFrame expressions only.

A line's set holds its tokens: its distinct runs of `k` words (runs of non-blank characters, lower-cased), or its whole
sequence if it has fewer. A line goes if an earlier line of the corpus, by (doc_id, line number), has a set of Jaccard
similarity of at least `percent` / 100, removed or not. Lines without words stay.

Method. Tokens are ordered by rarity: counts over all lines, kept by hash in RANKS buckets, so that the table has a fixed size; any
order gives the same result, this one makes prefixes rare. Of a set of n tokens the first n - ceil(t n) + 1 are its prefix; two
similar sets share a token of their prefixes. Lines are joined on prefix tokens under the length bound and the bound by
position on the overlap that is still possible, and confirmed on full sets.

Equal lines are one class from the start. As a line needs one earlier match only, classes that share a token are first
compared with that token's earliest document's lines (linear in the group); only classes that found no match are joined
with all of the group. Groups of at most ALL_PAIRS rows are joined at once, and lines with copies are cut into tokens at their
first place only: all of them if their classes are at most FEW, else those of more copies, of more than COPIES in any case. So a
line that a third of all documents hold, as it is or with small changes, makes no pairs of all with all.

Defined cases: null text has no lines and stays null; empty text is one line without words; ties in order can't arise unless
doc_id repeats, then equal (doc_id, line number) count as one place; very long lines and texts are taken whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.storage import of_ids, per_row, release, table, written

RANKS = 1 << 16
#: Up to so many rows of a token, all its lines are joined at once; beyond, first with its earliest document's.
ALL_PAIRS = 64
#: A line with more copies than this is joined by its first place only.
COPIES = 1000
#: Up to so many classes, or documents that lose lines, are broadcast.
FEW = 300_000
#: Bound of a dictionary of word hashes, a file's.
DICTIONARY_BYTES = 8 << 20
#: Blanks within a line other than the space.
_BLANKS = "\t\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, no, line (lower-cased), h1, h2 of every line."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("no", "line"))
    return lines.select("doc_id", "no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _with_words(lines: DataFrame) -> DataFrame:
    """lines with anything but blanks."""
    return lines.filter(F.length(F.trim("line", F.lit(" " + _BLANKS))) > 0)


def _worded(lines: DataFrame) -> DataFrame:
    """lines with words and the column w: the hashes of their words. Split at one literal character, which needs no regular expression."""
    spaced = F.col("line")
    for b in _BLANKS:
        spaced = F.replace(spaced, F.lit(b), F.lit(" "))
    return _with_words(lines).withColumn("w", F.transform(F.array_remove(F.split(spaced, " "), ""), lambda word: F.xxhash64(word)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, no, h1, h2, w of every line with words, written: texts are read, split and hashed this once."""
    # words repeat, so a dictionary that holds all of a file's keeps the table well below the size of the texts
    return written(_worded(_lines(docs)).select("doc_id", "no", "h1", "h2", "w"), "rows", **{"parquet.dictionary.page.size": DICTIONARY_BYTES})


def _token(i: Column, k: int) -> Column:
    """The hash of the run of k word hashes from i on; nulls beyond the end change no hash, so a line of fewer words has one token."""
    return F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(k)])


def _hashed(rows: DataFrame, k: int) -> DataFrame:
    """rows with t, the hashes of the line's tokens, for w."""
    # indexing is cheaper than zipping runs into structs, whose fields are boxed and hashed by type one by one
    firsts = F.slice("w", 1, F.greatest(F.size("w") - (k - 1), F.lit(1)))
    return rows.withColumn("t", F.transform(firsts, lambda word, i: F.xxhash64(word, *[F.get(F.col("w"), i + j) for j in range(1, k)]))).drop("w")


def _ranks(rows: DataFrame, k: int) -> DataFrame:
    """One row with `rank`: the rank of each bucket of tokens, rarest first, RANKS numbers, in the upper 16 bits but one."""
    # words are exploded, not an array of tokens: so the tokens are made in generated code. Outer: a filter that Spark
    # infers for a plain explode would be evaluated for every line
    at = rows.select("w", F.posexplode_outer("w").alias("i", "word"))
    tokens = at.filter((F.col("i") == 0) | (F.col("i") <= F.size("w") - k)).select(_token(F.col("i"), k).alias("t"))
    counts = tokens.groupBy(F.col("t").bitwiseAND(RANKS - 1).alias("b")).count().collect()  # at most RANKS rows
    n = np.zeros(RANKS, np.int64)
    for b, c in counts:
        n[b] = c
    rank = np.empty(RANKS, np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(RANKS) << 47
    out = rows.sparkSession.createDataFrame(pa.table({"rank": pa.array([rank], pa.list_(pa.int64()))}))
    return written(out, "ranks")


def _ordered(hashed: DataFrame, ranks: DataFrame) -> DataFrame:
    """hashed with t as the distinct tokens, rarest first: the rank of a token's bucket (its low 16 bits) above its other 47 bits but one."""
    # a scalar subquery, used once, so that Spark puts it into the expression: a literal of RANKS numbers would stand in
    # the text of every plan built on it
    with_ranks = hashed.withColumn("ranks", ranks.select("rank").scalar())
    # a rank that can't be null makes an array that is sorted as plain longs, not as objects by a comparator
    token = F.transform("t", lambda h: F.coalesce(F.get(F.col("ranks"), h.bitwiseAND(RANKS - 1).cast("int")), F.lit(0)).bitwiseOR(F.shiftrightunsigned(h, 17)))
    return with_ranks.select("doc_id", "h1", F.sort_array(F.array_distinct(token)).alias("t"))


def _entries(rows: DataFrame, ranks: DataFrame, percent: int, k: int) -> DataFrame:
    """token, h1, np (set size and position), doc (first document), least (the token's first document), size of the prefix tokens that several classes hold, written."""
    n = F.size("t")
    prefixes = _ordered(_hashed(rows, k), ranks).select("doc_id", "h1", n.alias("n"), F.posexplode_outer(F.slice("t", 1, n - F.floor((percent * n + 99) / 100).cast("int") + 1)).alias("pos", "token"))
    prefixes = prefixes.select("token", "h1", F.shiftleft(F.col("n").cast("long"), 31).bitwiseOR(F.col("pos")).alias("np"), F.col("doc_id").alias("doc"))
    # most tokens are one class's: only those of several stay. One shuffle by token serves this, the least and the size
    of = Window.partitionBy("token")
    told = prefixes.withColumns({"lo": F.min("h1").over(of), "hi": F.max("h1").over(of), "least": F.min("doc").over(of), "size": F.count("*").over(of)})
    return written(told.filter("lo < hi").groupBy("token", "h1", "np", "least", "size").agg(F.min("doc").alias("doc")), "entries")


def _fewest_copies(place: DataFrame, most: int, few: int) -> int:
    """The least number of copies, at most `most`, that no more than `few` classes exceed. At most `most` rows come to the driver."""
    above = 0
    for c, n in sorted(place.filter("c > 1").groupBy(F.least("c", F.lit(most + 1))).count().collect(), reverse=True):
        above += n
        if c <= most and above > few:
            return c
    return 1


def _firsts(rows: DataFrame, place: DataFrame, copies: int) -> DataFrame:
    """rows without the later places of lines that have more than `copies` copies."""
    many = F.broadcast(place.filter(F.col("c") > copies).select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), "at"))
    return rows.join(many, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2")), "left").filter("at is null or at = struct(doc_id, no)").select(rows.columns)


def removed_lines(docs: DataFrame, percent: int = 75, k: int = 5, all_pairs: int = ALL_PAIRS, copies: int = COPIES, few: int = FEW) -> DataFrame:
    """docs: doc_id, text. (doc_id, no) of the lines to remove, written."""
    spark = docs.sparkSession
    rows = _rows(docs)
    place = written(rows.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "no")).alias("at")), "classes")
    release(spark)
    # of a line with copies the first stands for all, so that no token has a row for each of very many, and tokens are made once
    firsts = _firsts(rows, place, _fewest_copies(place, copies, few))
    ranks = _ranks(firsts, k)
    entries = _entries(firsts, ranks, percent, k)
    release(spark, ranks)

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("token", F.col("h1").alias(f"h{s}"), F.shiftright("np", 31).alias(f"n{s}"), F.col("np").bitwiseAND((1 << 31) - 1).alias(f"p{s}"), F.col("doc").alias(f"d{s}"))

    def pairs(earlier: DataFrame, later: DataFrame) -> DataFrame:
        """Candidates of two sides under the bounds by length and position."""
        both = side(earlier, "a").join(side(later, "b"), "token").filter("ha <> hb and da <= db")
        need = F.floor((percent * (F.col("na") + F.col("nb")) + 99 + percent) / (100 + percent))
        ahead = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        both = both.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (ahead >= need))
        return both.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct()

    def later(found: DataFrame) -> DataFrame:
        """h1, h2 of the later class of each pair that is similar."""
        found = written(found, "candidates")
        release(spark)
        ids = found.select(F.col("a").alias("h1")).union(found.select("b")).distinct()
        # a class's words are taken from its first place: no copies are moved and grouped
        chosen = of_ids(place.select("h1", "h2", "at"), ids, "h1")
        if ids.limit(few + 1).count() <= few:
            chosen = F.broadcast(chosen)
        some = rows.join(chosen, ["h1", "h2"]).filter("at = struct(doc_id, no)").select("h1", "h2", "at", "w")
        some = written(_hashed(some, k).select("h1", "h2", "at", F.array_distinct("t").alias("t")), "sets")
        release(spark)

        def cols(s: str) -> list[Column]:
            return [F.col("h1").alias(s), F.col("h2").alias(f"{s}2"), F.col("t").alias(f"t{s}"), F.col("at").alias(f"at{s}")]

        both = found.join(some.select(cols("a")), "a").join(some.select(cols("b")), "b")
        # common tokens >= percent / 100 of the union's, written with the intersection once: a filter evaluates it each time it stands there
        both = both.filter((100 + percent) * F.size(F.array_intersect("ta", "tb")) >= percent * (F.size("ta") + F.size("tb")))
        a_first = F.col("ata") < F.col("atb")
        out = written(both.select(F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("h1"), F.when(a_first, F.col("b2")).otherwise(F.col("a2")).alias("h2")).distinct(), "matched")
        release(spark, found, some)
        return out

    small = F.col("size") <= all_pairs
    matched = [later(pairs(entries.filter(small | (F.col("doc") == F.col("least"))), entries))]
    large = entries.filter(~small)
    if not large.isEmpty():
        # an open line's match has its first place in a document not after its own
        matched += [later(pairs(large, large.filter("doc > least").join(matched[0].select("h1").distinct(), "h1", "left_anti")))]
    known = reduce(DataFrame.union, matched).distinct().withColumn("m", F.lit(True))
    gone = written(place.join(known, ["h1", "h2"], "left").filter("c > 1 or m").select("h1", "h2", "at", F.coalesce("m", F.lit(False)).alias("m")), "repeated")
    release(spark, entries, place, *matched)
    # classes are distinct, so that a partition's are few enough to be hashed
    out = written(rows.select("doc_id", "no", "h1", "h2").join(gone.hint("shuffle_hash"), ["h1", "h2"]).filter("m or at <> struct(doc_id, no)").select("doc_id", "no"), "removed")
    release(spark, rows, gone)
    return out


def _by_document(removed: DataFrame, few: int = FEW) -> DataFrame:
    """doc_id, gone: the numbers of the removed lines of each document that loses any; sent to the texts if they are few, so that no text moves."""
    gone = removed.groupBy("doc_id").agg(F.collect_set("no").alias("gone"))
    return F.broadcast(gone) if removed.select("doc_id").distinct().limit(few + 1).count() <= few and removed.limit(10 * few + 1).count() <= 10 * few else gone


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the kept text of docs (doc_id, text)."""
    both = docs.select("doc_id", "text").join(_by_document(removed), "doc_id", "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get(F.col("lines"), i)), "\n")
    return both.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def dedup_lines(docs: DataFrame, percent: int = 75, k: int = 5, doc: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_removed, kept for every document."""
    texts = docs.select(F.col(doc).alias("doc_id"), "text")
    return without_lines(texts, removed_lines(texts, percent, k)).select("doc_id", "n_lines", "n_removed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the kept lines joined by newlines (null: empty)."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated lines; a document of which nothing is left goes.

    docs needs doc_id and text; n_chars, where there is one, becomes the length of a text that changed; all other columns pass
    through, whatever their names. Null and empty texts stay as they are; rows with a null or repeated doc_id are decided
    row by row; of equal lines the first place stays; an empty table gives an empty one.
    """

    def stage(d: DataFrame) -> DataFrame:
        texts = d.select("doc_id", "text")
        gone = _by_document(removed_lines(texts)).withColumnRenamed("gone", "no")
        # the other columns travel in one struct, so that none of their names can clash
        both = d.select("doc_id", F.struct(*d.columns).alias("row")).join(gone, "doc_id", "left")
        lines = F.split("row.text", "\n")
        kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "no"), lambda i: F.get(lines, i)), "\n")
        both = both.filter(F.col("no").isNull() | (F.size("no") < F.size(lines))).withColumn("kept", F.when(F.col("no").isNull(), F.col("row.text")).otherwise(kept))
        new = {"text": F.col("kept")}
        if "n_chars" in d.columns:
            new["n_chars"] = F.when(F.col("no").isNotNull(), F.length("kept")).otherwise(F.col("row.n_chars")).cast(d.schema["n_chars"].dataType)
        return both.select(*[new.get(c, F.col("row")[c]).alias(c) for c in d.columns])

    return per_row(docs, stage)


OP2_SQL = r"""
with l as (select doc_id, unnest(range(0, len(ls))) no, unnest(ls) line from (select doc_id, string_split(lower(text), chr(10)) ls from documents where text is not null)),
c as materialized (select line k, min({'d': doc_id, 'n': no}) f from l group by 1),
ws as (select k, f, list_filter(regexp_split_to_array(k, '[ \t-\r]+'), lambda w: w <> '') w from c),
t as materialized (select k, f, unnest(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) w from ws where len(w) > 0),
n as materialized (select k, any_value(f) f, count(*) n from t group by 1),
p as (select a.k ka, b.k kb, count(*) o from t a join t b on a.w = b.w and a.k < b.k group by 1, 2),
m as materialized (select distinct case when x.f < y.f then kb else ka end k from p join n x on x.k = ka join n y on y.k = kb where 100 * o >= 75 * (x.n + y.n - o)),
g as (select l.doc_id, l.no, (m.k is not null or n.f <> {'d': l.doc_id, 'n': l.no}) and n.k is not null gone, l.line from l left join n on n.k = l.line left join m on m.k = l.line),
o as (select doc_id, unnest(range(0, len(ls))) no, unnest(ls) line from (select doc_id, string_split(text, chr(10)) ls from documents where text is not null)),
r as (select o.doc_id, count(*) n_lines, count(*) filter (coalesce(gone, false)) n_removed, string_agg(o.line, chr(10) order by o.no) filter (not coalesce(gone, false)) kept
      from o join g on g.doc_id = o.doc_id and g.no = o.no group by 1)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) n_lines, cast(coalesce(n_removed, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256
from documents d left join r using (doc_id)
"""
