"""Corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage works on all that the one before it kept; run() applies them to the documents of sf_dir. What a stage decides on nulls,
empty texts, repeated rows, empty tables and further columns stands in its own text; all but the last hand on the columns of
documents as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bytebpe, decontaminate, langid, linededup, neardup
from millrace.llm.storage import table, written

STAGES = [
    ("language_id", lambda spark, docs, sf_dir: langid.known_language(spark, docs, sf_dir)),
    ("line_dedup", lambda spark, docs, sf_dir: linededup.unrepeated(spark, docs, sf_dir)),
    ("near_dedup", lambda spark, docs, sf_dir: neardup.one_of_each(spark, docs, sf_dir)),
    ("decontamination", lambda spark, docs, sf_dir: decontaminate.clean(spark, docs, sf_dir)),
    ("byte_bpe", lambda spark, docs, sf_dir: bytebpe.encoded(spark, docs, sf_dir)),
]

#: The trained language model and the tokenizer's merges are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written and read again, and so starts from a cut lineage."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
