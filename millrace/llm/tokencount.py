"""Token counts of a byte-level BPE tokenizer file, by heap and linked list; no ids are made.

The text is split at added tokens (each counts one), then by the byte-level pre-tokenizer's pattern. The symbols of a piece are
its bytes; a heap holds the adjacent pairs that have a merge, least rank and then leftmost first; a popped pair whose
symbols have changed since is stale and skipped; a merge relinks its neighbours and pushes their new pairs. A piece has as
many tokens as it had symbols less its merges. Counts of pieces are kept in a table of bounded size for each worker process.

Defined cases: null and empty text have no tokens; a very long piece costs n log n; an empty table gives an empty result; repeated rows
are counted each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.storage import bounded_batches, table

#: Pieces of which a task keeps the count; then the table starts anew.
KEPT = 400_000
#: Fixed value: the byte-level pre-tokenizer's pattern, white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens as the tokenizer file at `path` has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.start = [vocab[c] for c in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        added = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        symbols = [self.start[b] for b in text.encode()]
        n, merges = len(symbols), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            k = right[i] = right[j]
            count -= 1
            if k >= 0:
                left[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(heap, (m[0], i, new, symbols[k], m[1]))
            if (h := left[i]) >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(heap, (m[0], h, symbols[h], new, m[1]))
        return count

    def ordinary(self, text: str) -> int:
        known, total = self.known, 0
        for p in self.split(text):
            c = known.get(p)
            if c is None:
                if len(known) >= KEPT:
                    known.clear()
                c = self.piece(p)
                if len(p) <= 64:
                    known[p] = c
            total += c
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.added:
            return self.ordinary(text)
        return sum(1 if i % 2 else self.ordinary(t) for i, t in enumerate(self.added.split(text)) if t)


_counters: dict[str, Counter] = {}
T.CACHES.append(_counters)


def counter_of(path: str) -> Counter:
    """The worker process's counter: its tables outlive a task."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, doc: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document. The file at path is read once in each worker process."""

    def run(batches):
        counter = counter_of(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc).alias("doc_id"), "text").mapInArrow(T.tidy(run), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
