"""Helpers shared by the operators: shared-folder tables and the held-out rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset
    (tests, one machine) a temporary folder is made once and put in its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        root = tempfile.mkdtemp(prefix="provenant-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/provenant/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: what reads the table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn labels from; a null id counts as learnable."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def free_name(df: DataFrame, *names: str) -> Sequence[str]:
    """Column names that ``df`` does not have yet, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
