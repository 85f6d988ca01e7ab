"""The queries of this subpackage and the SQL that checks them, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, chat, classifier, exact_dedup, packing, quality_rules, secrets, sharding, simhash, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_quality": classifier.op2_quality,
        "op3_warc": warc.op3_warc,
        "op4_simhash": simhash.op4_simhash,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_secrets": secrets.op6_secrets,
        "op7_chat": chat.op7_chat,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_packing": packing.op9_packing,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op8_quality_rules": quality_rules.SQL,
    }
