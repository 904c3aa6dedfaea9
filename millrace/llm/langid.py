"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

Features of a text are the byte n-grams (n in NGRAMS) within its words, in ASCII lower case with both word ends marked
by the separating byte, hashed to BUCKETS rows. A text is the mean of its rows' embeddings; a linear softmax gives the
languages. Both are trained by stochastic gradient descent on at most `sample` labelled texts a language (the least by a hash
of doc_id; a documented bound). One part of the sample in five fits a temperature, so that scores are probabilities; a
prediction is rejected below `reject`, where it is as likely wrong as right.

As the mean is linear, prediction needs one row of class sums for each bucket: that table, BUCKETS x languages floats,
is what executors get. Every text is read whole.

Defined cases: a null text and one without a letter have language `und`, score 0 and are rejected; a text of letters only
that were never seen gets the class of the bias; with no labelled text at all everything is `und`; with one language
learned, that one is predicted; extra columns are ignored, whatever their names; repeated rows are predicted each and learned
from once.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.storage import bounded_batches, per_row, table, without_ids

BUCKETS, NGRAMS, DIM, SAMPLE, EPOCHS, REJECT = 1 << 16, (1, 2, 3, 4), 16, 600, 6, 0.5
_LETTER = regex.compile(r"\p{L}")
_IS_LETTER_BYTE = np.zeros(256, bool)
_IS_LETTER_BYTE[[*range(65, 91), *range(97, 123)]] = True


def features(data: np.ndarray, offsets: np.ndarray):
    """For each n: (bucket of each n-gram, row boundaries in it) of a block. An n-gram has a blank at its first or last byte only."""
    low = T.LOWER[data].copy()
    low[~T.ALNUM[low]] = 32
    # a blank before each row and at the end
    wide = np.append(np.insert(low, offsets[:-1], 32), np.uint8(32))
    at = offsets + np.arange(len(offsets))
    sums = T.prefix(wide)
    is_blank = wide == 32
    blank = np.concatenate([[0], np.cumsum(is_blank, dtype=np.int32)])
    for n in NGRAMS:
        m = len(wide) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        inner = blank[n:] - blank[:m]
        ok = inner == 0 if n == 1 else (inner <= is_blank[:m].astype(np.int8) + is_blank[n - 1 :]) & (inner < n)
        i = np.flatnonzero(ok)
        # the blank after a row is the next row's first: an n-gram over a boundary would hold it within
        h = T.range_hash(sums, i, i + n) * T._STEP[n : n + 1]
        yield (h >> np.uint64(48)).astype(np.int64) % BUCKETS, np.searchsorted(i, at)


def _bags(batches):
    """label, buckets and counts of each text."""
    for b in batches:
        keys, counts = [], []
        for _, offsets, data in T.blocks(b.column(1)):
            grams = [(f, rows.tolist()) for f, rows in features(data, offsets)]
            for r in range(len(offsets) - 1):
                k, c = np.unique(np.concatenate([f[rows[r] : rows[r + 1]] for f, rows in grams]), return_counts=True)
                keys.append(k)
                counts.append(c)
        yield pa.RecordBatch.from_arrays([b.column(0), T.list_column(keys, pa.int32()), T.list_column(counts, pa.int32())], ["label", "keys", "counts"])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(labels: list[str], bags: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """bags: (buckets, counts) of each text."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    shares = [(k, (c / max(1, c.sum())).astype(np.float32)) for k, c in bags]
    step, batch = 4.0, 32
    for epoch in range(epochs):
        rng.shuffle(fit)
        rate = step * (1 - epoch / epochs)
        for i in range(0, len(fit), batch):
            rows = fit[i : i + batch]
            x = np.stack([shares[r][1] @ emb[shares[r][0]] for r in rows])
            g = _softmax(x @ w + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            gx = g @ w.T
            w -= rate * x.T @ g
            bias -= rate * 0.1 * g.sum(axis=0)
            for r, d in zip(rows, gx, strict=True):
                emb[shares[r][0]] -= rate * len(rows) * shares[r][1][:, None] * d
    folded = emb @ w
    z = np.stack([shares[r][1] @ folded[shares[r][0]] for r in held]) + bias if len(held) else np.zeros((0, len(languages)))
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() if len(held) else 0 for t in heats]
    return Model(languages, folded.astype(np.float32), bias, float(heats[int(np.argmin(loss))]))


def fit(docs: DataFrame, sample: int = SAMPLE, doc: str = "doc_id") -> Model | None:
    """The model of the labelled rows outside the held-out quarter: at most `sample` texts of each of the languages reach the driver, as counts of buckets."""
    from pyspark.sql import Window

    bounded_batches(docs.sparkSession)
    # only the three columns that are read, so that no other name can clash
    docs = docs.select(F.col(doc).cast("string").alias("key"), F.col("lang").alias("label"), "text")
    labelled = docs.filter(F.col("label").isNotNull() & F.col("text").isNotNull() & (F.crc32("key") % 4 != 2))
    labelled = labelled.select("key", "label", F.xxhash64("key", F.lit(17)).alias("h"), F.xxhash64("text").alias("t"))
    # few least hashes of each partition and language first, so that no language meets whole in one task
    part = Window.partitionBy("label", F.pmod("h", F.lit(64))).orderBy("h", "t")
    some = labelled.distinct().withColumn("r", F.row_number().over(part)).filter(F.col("r") <= sample)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h", "t"))).filter(F.col("r") <= sample).drop("r")
    # a repeated row is one of the sample
    texts = docs.withColumn("t", F.xxhash64("text")).join(F.broadcast(some), ["key", "label", "t"]).dropDuplicates(["key", "label", "t"])
    rows = texts.select("label", "text", "h").mapInArrow(T.tidy(_picked), "label string, keys array<int>, counts array<int>, h bigint").toArrow()
    if not rows.num_rows:
        return None
    order = sorted(range(rows.num_rows), key=lambda i: (rows["h"][i].as_py(), rows["label"][i].as_py()))
    bags = [(rows["keys"][i].values.to_numpy(), rows["counts"][i].values.to_numpy()) for i in order]
    model = train([rows["label"][i].as_py() for i in order], bags)
    del rows, bags
    T.trimmed()
    return model


def _picked(batches):
    for b in batches:
        for out in _bags([b]):
            yield pa.RecordBatch.from_arrays([*out.columns, b.column(2)], ["label", "keys", "counts", "h"])


def _has_letter(raw: bytes, data: np.ndarray) -> bool:
    return bool(_IS_LETTER_BYTE[data].any()) or _LETTER.search(raw.decode(errors="ignore")) is not None


def _predict(model: Model | None, reject: float):
    def run(batches):
        for b in batches:
            lang, score = [], []
            for _, offsets, data in T.blocks(b.column(1)):
                raw = data.tobytes()
                if model:
                    sums, n = np.zeros((len(offsets) - 1, len(model.languages))), np.zeros(len(offsets) - 1)
                    for f, rows in features(data, offsets):
                        full = np.flatnonzero(np.diff(rows))
                        n += np.diff(rows)
                        for c in range(len(model.languages) if len(full) else 0):
                            sums[full, c] += np.add.reduceat(model.table[f, c], rows[full], dtype=np.float64)
                    p = _softmax((sums / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
                for r, (lo, hi) in enumerate(itertools.pairwise(offsets.tolist())):
                    known = model is not None and hi > lo and _has_letter(raw[lo:hi], data[lo:hi])
                    lang.append(model.languages[int(p[r].argmax())] if known else "und")
                    score.append(float(p[r].max()) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([s < reject for s in score], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None, reject: float = REJECT, doc: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; reads the text alone."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc).alias("doc_id"), "text").mapInArrow(T.tidy(_predict(model, reject)), "doc_id bigint, lang_pred string, score double, rejected boolean")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go.

    docs needs doc_id, text and lang; all columns pass through. A null text and one without a letter are rejected; rows with a
    null or repeated doc_id are decided row by row; where no row has a label, or in an empty table, nothing is known and all
    rows are rejected.
    """
    model = fit(docs)
    return per_row(docs, lambda d: without_ids(d, predict(d, model).filter("rejected"), "doc_id"))
