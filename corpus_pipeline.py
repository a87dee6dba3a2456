"""The training-corpus pipeline: language ID, near-dedup, decontamination, PII, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next one's docs.
All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provenant.llm import bpe, decontaminate, langid, pii, simhash
from provenant.llm.common import documents, materialise

STAGES = [
    ("language_id", langid.reject_stage),
    ("simhash_near_dedup", simhash.keep_one_stage),
    ("decontaminate", decontaminate.decontaminate_stage),
    ("pii", pii.pii_stage),
    ("byte_bpe", bpe.encode_stage),
]

#: No stage but the language rule could be said in SQL; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
