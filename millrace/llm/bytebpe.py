"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database for each partition's task.

A text is split by the pattern; each distinct piece of a batch is encoded once. A piece that is a token is that token. The
others become rows (piece, position, token) from their bytes. One recursion step joins the rows of adjacent positions
with the merge table (token, token, merged token), takes each piece's least rank, and contracts. Pieces without a further
pair leave the recursion with their rows. Decoding joins ids with the vocabulary, in their order.

Which pairs a step contracts, in pieces of every length alike: the leftmost one of the least rank. Where no token of lower
rank begins or ends with the merged token, no pair that a merge could newly make comes before the other pairs of the same
rank, and where pairs of other tokens that make the same token can't overlap them, these are contracted in the same step from left to right, with the same result and far fewer steps for a long
piece. Of a run of overlapping pairs of that rank every other one is contracted, from its first. A recursion runs a bounded
number of steps and goes on from its last rows, so that what it keeps is bounded.

A pair x, y of any rank is contracted in the same step too if nothing can come before it: no token of its rank or less begins
or ends with what it makes, no merge of its rank or less joins x to a token that ends in the byte before it, and none joins y
to a token that begins with the byte after it. Whatever its neighbours become meanwhile, x and y then wait for each other, and
what they make waits for that rank, so contracting them at once changes nothing else. Bytes are told apart modulo CLASSES, which only makes fewer pairs free.

Defined cases: null and empty text have no ids and decode to no bytes; white space, very long pieces, repeated rows and texts are
as any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.storage import bounded_batches, give_back, table

#: Symbols in one recursion; rows kept by one leg of it (symbols times steps); pieces a task remembers.
SYMBOLS, LEG_ROWS, KEPT = 100_000, 1_000_000, 400_000
#: Classes of bytes, a bit each of a merge's two sets; the class CLASSES is of no byte, at the ends of a piece.
CLASSES = 63
_ALL = (1 << 64) - 1
#: Texts taken apart at a time.
ROWS = 2_000
#: A row is a token of a piece: a piece is named by its first byte's place, and places run on over all pieces. It knows the next token
#: and its place, and the classes of the byte before it and of the one after the next token. k holds rank and place of a row's pair, so that
#: the least k of a piece is its leftmost pair of least rank. A run of hits holds equal tokens from `start` on, so a row's number in it is
#: its distance from there in tokens; a free pair overlaps no other hit.
_STEPS = """
create or replace temp table leg as
with recursive t(step, piece, pos, tok, nxt, npos, prior, after, live) as (
  select 0, piece, pos, tok, nxt, npos, prior, after, true from state
  union all
  (with s as (
     select t.*, (cast(m.rank as bigint) << 32) + pos as k, m.rank, m.safe, (m.lefts >> cast(prior as ubigint)) & 1 = 0 and (m.rights >> cast(after as ubigint)) & 1 = 0 as free
     from t left join merges m on m.a = t.tok and m.b = t.nxt where live and step < {steps}
   ),
   l as (select piece, min(k) as best from s group by piece),
   h as (select s.*, best, coalesce(k = best or free or (safe and rank = best >> 32), false) as hit, case when hit then rank end as made from s join l using (piece)),
   w as (
     select *, greatest(piece, last_value(case when not hit then npos end ignore nulls) over (o rows between unbounded preceding and 1 preceding)) as start,
            lag(pos) over o as before, lead(made) over o as made1, lead(made, 2) over o as made2, lead(nxt) over o as nxt1, lead(npos) over o as npos1, lead(after) over o as after1, lead(after, 2) over o as after2
     from h window o as (order by pos)
   ),
   c as (select *, pos > start and (pos - start) // (pos - before) % 2 = 1 as eaten from w)
   select step + 1, piece, pos, case when hit then made else tok end,
          case when hit then case when nxt1 is null then null else coalesce(made2, nxt1) end when nxt is null then null else coalesce(made1, nxt) end,
          case when hit then npos1 else npos end, prior,
          cast(case when hit then case when nxt1 is null then {ends} when made2 is null then after1 else after2 end when nxt is null or made1 is null then after else after1 end as utinyint),
          best is not null
   from c where not eaten)
)
select piece, pos, tok, nxt, npos, prior, after, live from t where not live or step = {steps}
"""


class Codec:
    """Encoder and decoder for the rank file at path."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.tokens = {base64.b64decode(a): int(b) for a, b in rows}
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")).findall
        self.byte = np.array([self.tokens[bytes([b])] for b in range(256)], np.int32)
        self.name = {r: str(r) for r in self.tokens.values()}
        #: Known pieces' ids, joined by commas; what those decode to, of pieces that don't decode to themselves.
        self.known: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}
        self.last: set[str] = set()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "preserve_insertion_order": True})
        a, b, rank, safe, lefts, rights = [], [], [], [], [], []
        #: By token, over the merges so far: the least rank of one with it, the classes of bytes that end its left partners and begin its right ones.
        least, ending, beginning = dict.fromkeys(self.name, 1 << 30), dict.fromkeys(self.name, 0), dict.fromkeys(self.name, 0)
        for token, r in sorted(self.tokens.items(), key=lambda item: item[1]):
            splits = []
            for i in range(1, len(token)):
                x, y = self.tokens.get(token[:i]), self.tokens.get(token[i:])
                for part in (x, y):
                    if part is not None:
                        least[part] = min(least[part], r)
                if x is not None and y is not None:
                    splits.append((x, y))
                    ending[y] |= 1 << token[i - 1] % CLASSES
                    beginning[x] |= 1 << token[i] % CLASSES
            for x, y in splits:
                a.append(x)
                b.append(y)
                rank.append(r)
                # pairs of other tokens that make the same token must not overlap this one
                safe.append(least[r] > r and not any((q == x and p != x) or (p == y and q != y) for p, q in splits))
                lefts.append(ending[x] if least[r] > r else _ALL)
                rights.append(beginning[y] if least[r] > r else _ALL)
        merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(rank, pa.int32()), "safe": pa.array(safe, pa.bool_()), "lefts": pa.array(lefts, pa.uint64()), "rights": pa.array(rights, pa.uint64())})
        vocabulary = pa.table({"tok": pa.array(self.tokens.values(), pa.int32()), "bytes": pa.array(self.tokens, pa.binary())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("rows", rows)
            self.db.execute(f"create table {name} as select * from rows")
            self.db.unregister("rows")

    def _recursion(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has, by the recursive query."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.array([len(p) for p in pieces])
        heads, n = np.cumsum(sizes) - sizes, int(sizes.sum())
        data = np.frombuffer(b"".join(pieces), np.uint8)
        tokens, classes = self.byte[data], data % CLASSES
        ends = np.zeros(n, bool)
        ends[heads + sizes - 1] = True
        prior = np.append(np.uint8(CLASSES), classes[:-1])
        prior[heads] = CLASSES
        after = np.append(classes[1:], np.uint8(CLASSES))
        after[ends] = CLASSES
        state = pa.table({
            "piece": pa.array(np.repeat(heads, sizes).astype(np.int32)),
            "pos": pa.array(np.arange(n, dtype=np.int32)),
            "tok": pa.array(tokens),
            "nxt": pa.array(np.append(tokens[1:], 0).astype(np.int32), mask=ends),
            "npos": pa.array(np.arange(1, n + 1, dtype=np.int32)),
            "prior": pa.array(prior),
            "after": pa.array(np.append(after[1:], np.uint8(CLASSES))),
        })
        done = []
        while state.num_rows:
            self.db.register("state", state)
            self.db.execute(_STEPS.format(steps=max(4, LEG_ROWS // state.num_rows), ends=CLASSES))
            self.db.unregister("state")
            done.append(self.db.sql("select pos, tok from leg where not live").to_arrow_table())
            state = self.db.sql("select piece, pos, tok, nxt, npos, prior, after from leg where live").to_arrow_table()
        out = pa.concat_tables(done)
        pos, tok = out["pos"].to_numpy(), out["tok"].to_numpy()
        order = np.argsort(pos)
        return tok[order], np.diff(np.searchsorted(pos[order], np.append(heads, n)))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids, by a join with the vocabulary in the ids' order. The lists stand one after the other in ids."""
        rows = pa.table({"pos": np.arange(len(ids), dtype=np.int32), "tok": ids.astype(np.int32)})
        self.db.register("rows", rows)
        got = self.db.sql("select bytes from rows join vocabulary using (tok) order by pos").to_arrow_table()["bytes"].combine_chunks()
        self.db.unregister("rows")
        offsets, data = T.buffers(got)
        ends = offsets[np.cumsum(sizes)].tolist()
        joined = data.tobytes()
        return [joined[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: list[str]) -> None:
        """Encode and decode pieces that are not known yet, at most SYMBOLS bytes or one longer piece at a time."""
        at = 0
        while at < len(pieces):
            raw, n, first = [], 0, at
            while at < len(pieces):
                r = pieces[at].encode()
                if raw and n + len(r) > SYMBOLS:
                    break
                raw.append(r)
                n += len(r)
                at += 1
            whole = np.array([self.tokens.get(r, -1) for r in raw], np.int32)
            made, counts = self._recursion([r for r, t in zip(raw, whole, strict=True) if t < 0])
            sizes = np.ones(len(raw), np.int64)
            sizes[whole < 0] = counts
            ids = np.repeat(whole, sizes)
            ids[ids < 0] = made
            names = [self.name[i] for i in ids.tolist()]
            end = np.cumsum(sizes).tolist()
            for p, r, d, i, j in zip(pieces[first:at], raw, self.decode(ids, sizes), [0, *end], end, strict=False):
                self.known[p] = ",".join(names[i:j])
                if d != r:
                    self.odd[p] = d

    def trim(self) -> None:
        """Keep the last batch's pieces only."""
        self.known = {p: self.known[p] for p in self.last if p in self.known}
        self.odd = {p: d for p, d in self.odd.items() if p in self.known}

    def texts(self, texts: list[str | None]) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids joined by commas, decoded bytes) of each text."""
        split = [self.split(t) if t else [] for t in texts]
        pieces = self.last = set().union(*split)
        if len(self.known) > KEPT:
            self.trim()
        if new := [p for p in pieces if p not in self.known]:
            self.learn(new)
        out, known, odd = [], self.known.__getitem__, self.odd
        for ps in split:
            ids = ",".join(map(known, ps))
            # each piece's ids were decoded: all but the odd ones gave the piece again
            decoded = b"".join([odd[p] if p in odd else p.encode() for p in ps]) if odd else "".join(ps).encode()
            out.append((ids.count(",") + 1 if ids else 0, ids, decoded))
        return out


_codecs: dict[tuple[str, str], Codec] = {}
T.CACHES.append(_codecs)


def codec(path: str, pattern: str) -> Codec:
    """The worker process's codec: its tables outlive a task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, doc: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document; with_ids: the ids and the decoded bytes too."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [g for i in range(0, len(texts), ROWS) for g in own.texts(texts[i : i + ROWS])]
            cols = [b.column(0).cast(pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got], pa.string()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([[int(i) for i in g[1].split(",") if i] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return docs.select(F.col(doc).alias("doc_id"), "text").mapInArrow(T.tidy(run), schema)


def _public(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(table(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, n_tokens and the digests of ids and decoded bytes of every document.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text counts as an empty one, without ids;
    rows with a null or repeated doc_id have a row each; an empty table gives an empty one.
    """
    give_back(spark)  # the stages before fill the executors' heaps, and each worker process needs some 350 MB here
    return _public(docs)
