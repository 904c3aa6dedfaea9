"""Queries of this subpackage and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import bytebpe, chunks, decontaminate, kdtree, langid, linededup, neardup, secrets, suffixdedup, tokencount


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_line_dedup": linededup.op2_line_dedup,
        "op3_langid": langid.op3_langid,
        "op4_byte_bpe": bytebpe.op4_byte_bpe,
        "op5_topk": kdtree.op5_topk,
        "op6_token_counts": tokencount.op6_token_counts,
        "op7_suffix_dedup": suffixdedup.op7_suffix_dedup,
        "op8_neardup": neardup.op8_neardup,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_chunk_dedup": chunks.op10_chunk_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return out | {"op1_decontamination": decontaminate.OP1_SQL, "op2_line_dedup": linededup.OP2_SQL, "op5_topk": kdtree.OP5_SQL, "op8_neardup": neardup.OP8_SQL}
