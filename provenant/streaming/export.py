"""A resumable export: a stream of rows to files, every id once, up to a number of ids.

Each micro-batch is a folder ``batch=N`` of its own under the target, written by
overwriting, so a batch that runs again after a failure replaces what it left.
A batch keeps the first row of each id that no earlier batch holds. The stream's
checkpoint tells which batches are complete; the target alone decides which ids
are out, so nothing is lost or doubled wherever a run stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.functions.text import safe_name
from provenant.operators.relational import free_names


def exported(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """What the complete batches hold (those under ``before``); None if there are none."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    names = [s.getPath().getName() for s in files.listStatus(root)]
    batches = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    paths = [f"{target}/batch={b}" for b in batches if (before is None or b < before) and files.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/batch={b}/_SUCCESS"))]
    return spark.read.option("basePath", target).option("mergeSchema", True).parquet(*paths).drop("batch") if paths else None


def write_batch(rows: DataFrame, batch: int, target: str, key: str = "id", order: str = "source_index", limit: int | None = None) -> None:
    """One micro-batch: new ids only, the first row of each by ``order``, up to ``limit`` ids in all.

    Ids become file-name stems; what has no id, or one that is all blanks, gets
    its ``order`` as id. The same batch and the same earlier batches give the
    same rows.
    """
    spark = rows.sparkSession
    earlier = exported(spark, target, batch)
    raw = F.trim(F.col(key).cast("string"))
    named = rows.withColumn(key, safe_name(F.when(raw != "", raw).otherwise(F.col(order).cast("string"))))
    place, = free_names(named, "place")
    first = named.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col(place) == 1).drop(place)
    if earlier is not None:
        first = first.join(earlier.select(key), key, "left_anti")
    if limit is not None:
        left = max(0, limit - (earlier.count() if earlier is not None else 0))
        first = first.orderBy(order, key).limit(left)
    first.write.mode("overwrite").parquet(f"{target}/batch={batch}")


def export(stream: DataFrame, target: str, checkpoint: str, key: str = "id", order: str = "source_index", limit: int | None = None, required: list[str] | None = None):
    """Export all that a stream has now, and return its finished query; called again, it goes on where it stopped.

    ``required`` names columns without which a row is passed over (null, or an empty array).
    """
    for c in required or []:
        stream = stream.where(F.col(c).isNotNull() & ((F.size(c) > 0) if stream.schema[c].dataType.typeName() == "array" else F.lit(True)))
    query = stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, target, key, order, limit)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
