"""Assignment under capacities, and attempts in rounds up to a quota; both in stored, restartable rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.operators.relational import scratch

# --- balanced queue -------------------------------------------------------------------------------------------------------


def balanced_queue(candidates: DataFrame, cells: int, capacity: int, per_object: int, key: str = "key", order: str = "order", cell: str = "cell", thing: str = "object") -> DataFrame:
    """(key, cell, place): what one pass in ``order`` would assign, where every cell takes ``capacity`` candidates.

    A candidate goes to its own ``cell`` (from 0), or to the next one after it,
    around all cells, that has room and fewer than ``per_object`` of its object.
    One that no cell takes is left out. ``place`` is its place in its cell, by
    order, from 1.

    The pass is rebuilt by proposals: in a round every unsettled candidate asks
    the next cell it has not asked, and a cell keeps the earliest it may hold of
    those it has and those that ask; the others move on. As a cell's choice only
    gets earlier, one that was turned away never gets in again, so the end is the
    pass's result. From the second round on only candidates early enough for
    some cell ask at all: a table of ``cells`` rows tells. What is shuffled is
    limited by rank within each task first, so no cell's crowd meets in one task.

    Nulls: a candidate without key, order or cell takes no part; a null object is
    an object of its own; equal orders follow their keys.
    """
    if min(cells, capacity, per_object) < 1:
        raise ValueError("cells and capacities must be positive")
    rows = candidates.select(F.col(key).alias("key"), F.col(order).alias("order"), F.pmod(F.col(cell).cast("bigint"), F.lit(cells)).cast("int").alias("own"), F.col(thing).alias("object"))
    asking = scratch(rows.where("key IS NOT NULL AND order IS NOT NULL AND own IS NOT NULL").withColumn("step", F.lit(0)))
    held = asking.limit(0)
    at = F.pmod(F.col("own") + F.col("step"), F.lit(cells))
    first = ["order", "key"]
    while not asking.isEmpty():
        both = held.unionByName(asking).withColumn("cell", at)
        few = both.withColumn("i", F.row_number().over(Window.partitionBy("cell", "object").orderBy(*first))).where(F.col("i") <= per_object).drop("i")
        kept = scratch(few.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy(*first))).where(F.col("i") <= capacity).drop("i"))
        # the last one a full cell holds: who comes after it asks there in vain
        last = {r.cell: (r.order, r.key) for r in kept.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.struct(*first)).alias("l")).where(F.col("n") == capacity).select("cell", "l.*").collect()}
        open_ = lambda c: _open(c, last, cells)  # noqa: B023, E731
        out = both.join(kept.select("key"), "key", "left_anti").drop("cell")
        further = F.get(F.filter(F.sequence(F.col("step") + 1, F.greatest(F.lit(cells), F.col("step") + 1)), lambda s: (s < cells) & open_(F.pmod(F.col("own") + s, F.lit(cells)))), F.lit(0))
        asking = scratch(out.withColumn("step", further).where("step IS NOT NULL"))
        held = kept.drop("cell")
    return held.withColumn("cell", at).withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(*first))).select("key", "cell", "place")


def _open(cell: Column, last: dict, cells: int) -> Column:
    """Whether a candidate may still get into a cell."""
    if not last:
        return F.lit(True)
    orders, keys = (F.array(*(F.lit(last[c][i]) if c in last else F.lit(None) for c in range(cells))) for i in (0, 1))
    edge = F.get(orders, cell)
    return edge.isNull() | (F.col("order") < edge) | ((F.col("order") == edge) & (F.col("key") < F.get(keys, cell)))


def target_cells(rows: DataFrame, first: Column, firsts: int, second: Column, seconds: int) -> Column:
    """The number of the cell of a grid, row by row."""
    return F.pmod(first.cast("bigint"), F.lit(firsts)) * seconds + F.pmod(second.cast("bigint"), F.lit(seconds))


# --- attempts in rounds ---------------------------------------------------------------------------------------------------


class Rounds:
    """Attempts on anchors until a quota of them has passed all gates, in rounds kept under ``path``.

    ``attempt(pending)`` gets a DataFrame ``(anchor_id, anchor_order, attempt)``
    and returns these columns with whatever the gates look at, one row for each
    anchor that still has something to try; an anchor without a row is given up.
    ``gates`` are (name, condition) in order; the first that a row does not meet
    is its ``failed_gate``.

    A round takes the unsettled anchors that may still matter: the first ones in
    order, as many as the quota leaves open. Each of them is tried once a round,
    and settled when it passes, has no attempt left or nothing to try. The result
    is that of one pass in order: the first ``quota`` anchors that pass within
    ``most`` attempts. It stops when so many have passed and no unsettled anchor
    comes before the last of them.

    A round's rows are written before the next begins. Started again on the same
    path, it goes on after the last complete round; nothing is tried twice.
    """

    def __init__(self, path: str, attempt: Callable[[DataFrame], DataFrame], gates: list[tuple[str, Column]], quota: int, most: int, ahead: int = 2):
        if min(quota, most, ahead) < 1:
            raise ValueError("quota, attempts and look-ahead must be positive")
        self.path, self.attempt, self.gates, self.quota, self.most, self.ahead = path, attempt, gates, quota, most, ahead

    def _done(self, spark: SparkSession) -> int:
        """Complete rounds; Spark marks a written table when its last file is in place."""
        jvm = spark.sparkContext._jvm
        n = 0
        while True:
            place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/round={n}/_SUCCESS")
            if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
                return n
            n += 1

    def _tried(self, spark: SparkSession, n: int) -> DataFrame | None:
        if not n:
            return None
        paths = [f"{self.path}/round={i}" for i in range(n)]
        return spark.read.option("basePath", self.path).option("mergeSchema", True).parquet(*paths).drop("round")

    def run(self, anchors: DataFrame) -> DataFrame:
        """(id, anchor_id, attempt, ...) of the accepted anchors in order; ``anchors(anchor_id, anchor_order)``."""
        spark = anchors.sparkSession
        anchors = scratch(anchors.select("anchor_id", "anchor_order").where("anchor_id IS NOT NULL AND anchor_order IS NOT NULL").groupBy("anchor_id").agg(F.min("anchor_order").alias("anchor_order")))
        first = ["anchor_order", "anchor_id"]
        n = self._done(spark)
        while True:
            tried = self._tried(spark, n)
            if tried is None:
                left, need = anchors.withColumn("attempt", F.lit(1)), self.quota
            else:
                state = tried.groupBy("anchor_id").agg(F.max("attempt").alias("last"), F.max(F.col("failed_gate").isNull()).alias("passed"), F.max(F.col("failed_gate") == "nothing_to_try").alias("over"))
                left = anchors.join(state, "anchor_id", "left").where("last IS NULL OR NOT (passed OR coalesce(over, false) OR last >= %d)" % self.most)
                left = left.select("anchor_id", "anchor_order", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("attempt"))
                passed = tried.where("failed_gate IS NULL").select(*first)  # an anchor passes once
                # the quota-th that passed, if there are so many: only anchors before it can still change anything
                best = passed.orderBy(*first).limit(self.quota)
                found = best.agg(F.count("*").alias("n"), F.max(F.struct(*first)).alias("edge")).first()
                need = self.quota - found.n
                if not need:
                    left = left.where(F.struct(*first) < F.struct(F.lit(found.edge.anchor_order).alias("anchor_order"), F.lit(found.edge.anchor_id).alias("anchor_id")))
            wave = scratch(left.orderBy(*first).limit(self.ahead * max(need, min(self.quota, 1000))))
            if wave.isEmpty():
                break
            rows = self.attempt(wave)
            failed = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in self.gates), F.lit(None).cast("string")) if self.gates else F.lit(None).cast("string")
            rows = rows.withColumn("failed_gate", failed)
            none = wave.join(rows.select("anchor_id"), "anchor_id", "left_anti").withColumn("failed_gate", F.lit("nothing_to_try"))
            rows.unionByName(none, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/round={n}")
            n += 1
        tried = self._tried(spark, n)
        if tried is None:
            return anchors.limit(0).select(F.lit("").alias("id"), "anchor_id", F.lit(0).alias("attempt"))
        accepted = tried.where("failed_gate IS NULL").orderBy(*first).limit(self.quota)
        # at most a quota of rows: numbered in one place
        return accepted.withColumn("id", F.format_string("canary_%04d", F.row_number().over(Window.orderBy(*first)) - 1)).drop("failed_gate")

    def rejected(self, spark: SparkSession) -> DataFrame:
        """(anchor_id, attempt, failed_gate, ...) of every attempt that failed."""
        return self._tried(spark, self._done(spark)).where("failed_gate IS NOT NULL AND failed_gate != 'nothing_to_try'")
