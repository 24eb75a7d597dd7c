"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, linededup, lm, minhash, mixing, pq, sharding, tokens, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            tokens.op1_token_counts, minhash.op2_minhash, pq.op3_embedding_dedup, mixing.op4_mixing, warc.op5_warc,
            decontam.op6_decontamination, linededup.op7_line_dedup, toxicity.op8_toxicity, lm.op9_lm_scoring, sharding.op10_sharding,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.OP5_SQL, "op7_line_dedup": linededup.OP7_SQL, "op10_sharding": sharding.OP10_SQL}
