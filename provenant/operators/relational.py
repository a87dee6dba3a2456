"""Joins, set operations, deduplication and checks."""

from __future__ import annotations

import tempfile
import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.functions import geometry as G


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def replace_or_keep(corpus: DataFrame, replacements: DataFrame, additions: DataFrame | None, key: str, value: str) -> DataFrame:
    """The corpus with replaced values where there are any, and additions after it."""
    new = replacements.select(key, F.col(value).alias("__new"))
    out = corpus.join(new, key, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")
    return out if additions is None else out.unionByName(additions, allowMissingColumns=True)


def resume(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def only(rows: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    return rows.join(subset.select(key).distinct(), key, "left_semi")


def distractors(pool: DataFrame, excluded: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` distinct rows by key that are not excluded."""
    return first_wins(resume(pool, excluded, key), key, key).orderBy(key).limit(limit)


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def renumbered(rows: DataFrame, *order: str, name: str = "number", start: int = 1) -> DataFrame:
    """Consecutive numbers in a global order, without a one-task sort.

    Rows are sorted by range; each range is numbered by itself and moved up by
    the rows before it, one count a range. The ranged rows are written to the
    shared folder, as ranges drawn again after a loss would differ.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    ranged = stable(ranged)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    numbered = ranged.withColumn("__own", own).join(F.broadcast(offsets), "__range")
    return numbered.withColumn(name, F.col("__offset") + F.col("__own") + (start - 1)).drop("__range", "__own", "__offset")


def best_by_score(rows: DataFrame, score: str, key: list[str], *ties: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(score), *ties)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def per_cluster_top(rows: DataFrame, cluster: str, score: str, m: int, *ties: str) -> DataFrame:
    w = Window.partitionBy(cluster).orderBy(F.desc(score), *ties)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= m)


def contiguity(rows: DataFrame, index: str, n: int) -> DataFrame:
    """(kind, index) of every duplicate, missing or extra index against 0..n-1; no rows if all is well."""
    counts = rows.groupBy(F.col(index).cast("bigint").alias("index")).agg(F.count("*").alias("n"))
    wanted = rows.sparkSession.range(n).withColumnRenamed("id", "index")
    return (
        counts.where("n > 1").select(F.lit("duplicate").alias("kind"), "index")
        .unionByName(wanted.join(counts, "index", "left_anti").select(F.lit("missing").alias("kind"), "index"))
        .unionByName(counts.where((F.col("index") < 0) | (F.col("index") >= n) | F.col("index").isNull()).select(F.lit("extra").alias("kind"), "index"))
    )


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def overlapping(a: DataFrame, b: DataFrame, cell: int = 64, least: float = 0.0, box_a: str = "box_a", box_b: str = "box_b") -> DataFrame:
    """Pairs whose boxes intersect, with the share of ``box_a`` that is covered, above ``least``.

    Equal boxes collapse first. Each box is put into the grid cells it touches
    and the join is on the cell; of the cells that both touch only the first one
    reports the pair. The rows of the boxes that are left come back by their box,
    so that copies cost no more than the pairs they make.
    """

    def cells(df: DataFrame, box: str, x: str, y: str) -> DataFrame:
        b = F.col(box)
        span = lambda lo, hi: F.sequence(F.floor(b[lo] / cell).cast("int"), F.floor(F.greatest(b[hi] - 1, b[lo]) / cell).cast("int"))
        return df.where(G.area(b) > 0).withColumn(x, F.explode(span("x1", "x2"))).withColumn(y, F.explode(span("y1", "y2")))

    left, right = cells(a.select(box_a).distinct(), box_a, "__x", "__y"), cells(b.select(box_b).distinct(), box_b, "__x", "__y")
    first = lambda side, lo: F.floor(F.greatest(F.col(box_a)[lo], F.col(box_b)[lo]) / cell) == F.col(side)
    pairs = left.join(right, ["__x", "__y"]).where(first("__x", "x1") & first("__y", "y1")).drop("__x", "__y")
    pairs = pairs.withColumn("overlap", G.overlap_ratio(F.col(box_a), F.col(box_b))).where(F.col("overlap") > least)
    return pairs.join(a, box_a).join(b, box_b).select(*a.columns, *b.columns, "overlap")


def without_overlap(rows: DataFrame, zones: DataFrame, key: str, limit: float) -> DataFrame:
    """Rows whose ``box_a`` no zone's ``box_b`` covers by more than ``limit``."""
    return resume(rows, overlapping(rows, zones, least=limit).select(key), key)


def union_box(boxes: DataFrame, text: str, *keys: str) -> DataFrame:
    """The box around all boxes of a group, and their texts in reading order (lines of 8 pixels, then left to right)."""
    b = F.col("box")
    words = F.array_sort(F.collect_list(F.struct(F.floor(b["y1"] / 8).alias("line"), b["x1"].alias("x"), F.col(text).alias("text"))))
    rows = boxes.groupBy(*keys).agg(F.min("box.x1").alias("x1"), F.min("box.y1").alias("y1"), F.max("box.x2").alias("x2"), F.max("box.y2").alias("y2"), words.alias("words"))
    return rows.select(*keys, G.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("box"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"))


def hinted_text(hints: DataFrame, found: DataFrame, confidence: float = 0.35, inside: float = 0.5) -> DataFrame:
    """For each hint the union of the recognised boxes that lie in it by at least half, and their joined text."""
    sure = found.where(F.col("confidence") >= confidence).select(F.col("box").alias("box_a"), "text", "image_id")
    pairs = overlapping(sure, hints.select(F.col("box").alias("box_b"), "hint_id", F.col("image_id").alias("hint_image")), least=inside - 1e-9)
    return union_box(pairs.where("image_id = hint_image").select("hint_id", F.col("box_a").alias("box"), "text"), "text", "hint_id")


def direct_with_retrieval(direct: DataFrame, details: DataFrame, k: int, key: str = "record_index") -> DataFrame:
    """(key, rate): the record's direct hit counts for each of its probes whose target is in the top ``k``."""
    hit = F.coalesce("direct_hit", F.lit(False)) & F.coalesce(F.col("target_rank") <= k, F.lit(False))
    return details.join(direct.select(key, "direct_hit"), key, "left").groupBy(key).agg(F.avg(hit.cast("double")).alias("rate"))


def grid(*tables: DataFrame) -> DataFrame:
    """Every combination of rows of small configuration tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(F.broadcast(t))
    return out


def first_file(dirs: DataFrame) -> DataFrame:
    """(basename, path): the first path of each file name, in the order of its directories."""
    name = F.element_at(F.split("path", "/"), -1)
    return dirs.groupBy(name.alias("basename")).agg(F.min_by("path", F.struct("position", "path")).alias("path"))


def stable(df: DataFrame) -> DataFrame:
    """Checkpointed in the session's shared folder; a temporary one stands in where none is set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="provenant-"))
    return df.checkpoint()


def zipped(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], name: str = "place") -> DataFrame:
    """Rows of both sides side by side by their place in their orders, from 0; sides of unequal length are an error.

    Both sides are numbered by range (:func:`renumbered`) and joined by number,
    so neither is sorted in one task. Rows that are equal in their order may
    stand in any order among themselves; name columns that break ties. Both
    sides need names of their own.
    """
    both = {c.lower() for c in a.columns} & {c.lower() for c in b.columns}
    if both or name.lower() in {c.lower() for c in a.columns + b.columns}:
        raise ValueError(f"both sides have {sorted(both)}, or a column called {name}")
    left, right = (scratch(renumbered(side, *order, name=name, start=0)) for side, order in ((a, order_a), (b, order_b)))
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"a strict join by place needs sides of equal length, not {n} and {m}")
    return left.join(right, name)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared folder (``spark.checkpoint.dir``); a temporary one stands in where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="provenant-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str = "rows") -> DataFrame:
    """Written to the shared folder as Parquet and read again: lineage ends there, and columns can be read apart."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


LEAST_KEY, MOST_TABLES = 10, 256


def hash_masks(rows: int, threshold: int, bits: int = 64) -> list[int]:
    """Masks of which at least one covers only equal bits of any two hashes that differ in at most ``threshold`` bits.

    The bits are cut into ``threshold + e`` blocks, of which ``e`` are untouched;
    every choice of ``e`` blocks is a mask. ``e`` grows with the number of rows,
    so that about one row has each masked value by chance.
    """
    wanted = max(LEAST_KEY, rows.bit_length())
    for e in range(1, bits):
        edges = [round(i * bits / (threshold + e)) for i in range(threshold + e + 1)]
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        masks = [sum(c) for c in combinations(blocks, e)]
        if len(masks) > MOST_TABLES:
            raise ValueError(f"hashes of {bits} bits cannot be joined at {threshold} differing bits: {len(masks)} tables would be needed for {rows} rows")
        if min(m.bit_count() for m in masks) >= wanted or (e > 1 and min(m.bit_count() for m in masks) >= LEAST_KEY and len(masks) > MOST_TABLES // 4):
            return masks
    raise ValueError("no hash has so many bits")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_pairs(rows: DataFrame, hash_column: str, key: str, threshold: int = 4, bits: int = 64) -> DataFrame:
    """(a, b) of every two rows whose hashes differ in at most ``threshold`` bits, a < b.

    Rows meet where one of :func:`hash_masks` leaves them equal; only the first
    such mask reports a pair. Equal hashes meet once, as one row with its
    smallest key, and come back as a star around it. Rows with a null hash are
    near none.
    """
    rows = rows.where(F.col(hash_column).isNotNull())
    firsts = rows.groupBy(F.col(hash_column).alias("h")).agg(F.min(key).alias("k"))
    masks = [_signed(m) for m in hash_masks(firsts.count(), threshold, bits)]
    keys = F.posexplode(F.array(*(F.col("h").bitwiseAND(F.lit(m)) for m in masks))).alias("mask", "value")
    tables = firsts.select("k", "h", keys)
    a, b = tables.select("mask", "value", F.col("k").alias("a"), F.col("h").alias("ha")), tables.select("mask", "value", F.col("k").alias("b"), F.col("h").alias("hb"))
    differing = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.array_position(F.transform(F.array(*map(F.lit, masks)), lambda m: differing.bitwiseAND(m) == 0), True) - 1
    met = a.join(b, ["mask", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(differing) <= threshold))
    near = met.where(first == F.col("mask")).select("a", "b")
    same = rows.select(F.col(hash_column).alias("h"), F.col(key).alias("b")).join(firsts, "h").where(F.col("b") != F.col("k")).select(F.col("k").alias("a"), "b")
    return near.unionAll(same)


def greedy_dedup(rows: DataFrame, hash_column: str, key: str, priority: str, threshold: int = 4) -> DataFrame:
    """Rows a greedy pass would keep: in order of (priority, key), each unless it is near a kept one.

    Decided in rounds over the pairs: a row none of whose undecided near rows
    comes earlier is kept, and the rows near it go; it ends when all are
    decided. Equal hashes settle first, by order, so a group of copies is never
    expanded.
    """
    order = F.struct(priority, key)
    firsts = rows.groupBy(hash_column).agg(F.min(order).alias("o"))
    entries = stable(firsts.select(F.col(f"o.{key}").alias("k"), F.col(f"o.{priority}").alias("p"), F.col(hash_column).alias("h")))
    pairs = near_pairs(entries, "h", "k", threshold)
    o = entries.select("k", F.struct("p", "k").alias("o"))
    edges = pairs.join(o.select(F.col("k").alias("a"), F.col("o").alias("oa")), "a").join(o.select(F.col("k").alias("b"), F.col("o").alias("ob")), "b")
    # towards the later one
    edges = stable(edges.select(F.least("oa", "ob").alias("early"), F.greatest("oa", "ob").alias("late")))
    dropped, left = None, edges
    while not left.isEmpty():
        kept = left.select(F.col("early").alias("o")).distinct().join(left.select(F.col("late").alias("o")).distinct(), "o", "left_anti")
        gone = stable(left.join(kept.withColumnRenamed("o", "early"), "early", "left_semi").select(F.col("late").alias("o")).distinct())
        dropped = gone if dropped is None else dropped.unionAll(gone)
        left = left.join(gone.withColumnRenamed("o", "early"), "early", "left_anti").join(gone.withColumnRenamed("o", "late"), "late", "left_anti")
        left = stable(left.join(kept.withColumnRenamed("o", "early"), "early", "left_anti"))
    survivors = o if dropped is None else o.join(dropped, "o", "left_anti")
    return rows.join(survivors.select(F.col("k").alias(key)), key, "left_semi")
