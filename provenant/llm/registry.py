"""Queries of this subpackage, by name, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provenant.llm import ann, bpe, chat, decontaminate, hardneg, kdcluster, langid, packing, pii, simhash, tokencount, tokenstore, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_chat_format": chat.op3_chat_format,
    "op4_pii": pii.op4_pii,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_ann": ann.op6_ann,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_language_id": langid.op8_language_id,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_store": tokenstore.op10_token_store,
    "op11_packing": packing.op11_packing,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_kd_clustering": kdcluster.op13_kd_clustering,
}

ORACLE_SQL: dict[str, str] = {"op3_chat_format": chat.ORACLE, "op12_hard_negatives": hardneg.ORACLE, "op13_kd_clustering": kdcluster.ORACLE}
