"""Approximate nearest neighbours by cosine, through cross-polytope hashing.

A unit vector is rotated by three rounds of random signs and a fast Hadamard
transform, and hashed to the nearest signed axis. A table joins ``depth`` such
hashes into one bucket. Every row is stored in one bucket of each of ``tables``
tables; a query looks into its own bucket and into the ``probes`` next-best
ones, in order of how much nearness they give up. All candidates found are
ranked by their exact cosine in double precision.

Equal vectors are one entry with the smallest ids of its members, as many as a
query may need, so a very common vector neither fills a bucket nor repeats a
comparison. Buckets that agree in all but their last axis travel together: rows
and queries meet by a shuffle on (table, those axes), a query goes there once
with the set of last axes it probes, and only rows on these are its candidates.
Groups with more rows than ``cell`` are cut into pieces and their queries go to
each piece, so no task holds an unbounded group: it holds one piece's rows,
past which its queries go in blocks, each compared with the rows on its axes.

The index is data-independent (nothing is fitted), and every row is in it.

Defined results: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part; ties go to the smaller
id; repeated rows count once, of several vectors under one id a query is the
least in component order and a candidate the nearest; queries get fewer than
``k`` rows only where fewer candidates exist in the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.llm.common import materialise

TABLES, DEPTH, PROBES, CELL, SEED = 20, 2, 256, 4096, 7
SLACK = 1e-6  # single precision while searching
BLOCK = 512  # queries compared with a piece of a bucket at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two; orthonormal."""
    x, n, h = x.copy(), x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """``tables`` tables of ``depth`` pseudo-rotations for vectors of one dimension."""

    def __init__(self, dimension: int, tables: int = TABLES, depth: int = DEPTH, seed: int = SEED):
        self.width = 1 << max(0, dimension - 1).bit_length()
        self.tables, self.depth = tables, depth
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, depth, 3, self.width))

    def rotated(self, unit: np.ndarray, table: int, part: int) -> np.ndarray:
        x = np.zeros((len(unit), self.width))
        x[:, : unit.shape[1]] = unit
        for signs in self.signs[table, part]:
            x = hadamard(x * signs)
        return x

    def buckets(self, unit: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """The ``probes`` best buckets of each row, best first.

        The loss of an axis is how far its coordinate stays behind the best one,
        and losses of the parts add up. Of two sorted lists the i-th and j-th
        make no better than the (i * j)-th best sum, so only pairs up to that
        product are weighed.
        """
        total = np.zeros((len(unit), 1))
        code = np.zeros((len(unit), 1), np.int64)
        for part in range(self.depth):
            x = self.rotated(unit, table, part)
            both = np.concatenate((x, -x), axis=1)
            take = min(probes, both.shape[1])
            axes = np.argmax(both, axis=1)[:, None] if take == 1 else np.argsort(-both, axis=1, kind="stable")[:, :take]
            value = np.take_along_axis(both, axes, axis=1)
            loss = (value[:, :1] - value) ** 2
            i, j = (g.reshape(-1) for g in np.indices((total.shape[1], take)))
            small = (i + 1) * (j + 1) <= probes
            i, j = i[small], j[small]
            total, code = total[:, i] + loss[:, j], code[:, i] * (2 * self.width) + axes[:, j]
            order = np.argsort(total, axis=1, kind="stable")[:, :probes]
            total, code = np.take_along_axis(total, order, axis=1), np.take_along_axis(code, order, axis=1)
        return code


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def usable(vectors: DataFrame, vec_id: str, embedding: str, dimension: int) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") == dimension) & fine)


def _hash_rows(space: CrossPolytope, probes: int):
    """(ref, v) to (table, bucket, ref, unit, axes): one row a table and group of buckets."""
    ends = 2 * space.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                v = _matrix(part.column("v"))
                # scaled first, so that no square overflows or vanishes
                unit = v / np.abs(v).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                stored = pa.FixedSizeListArray.from_arrays(pa.array(unit.astype(np.float32).reshape(-1)), unit.shape[1]).cast(pa.list_(pa.float32()))
                for table in range(space.tables):
                    code = space.buckets(unit, table, probes)
                    at = np.repeat(np.arange(len(v)), code.shape[1])
                    group, axis = code.reshape(-1) // ends, code.reshape(-1) % ends
                    order = np.lexsort((axis, group, at))
                    at, group, axis = at[order], group[order], axis[order]
                    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (group[1:] != group[:-1]))))
                    axes = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(axis.astype(np.int16)))
                    rows = pa.array(at[first])
                    columns = [pa.array(np.full(len(first), table, np.int32)), pa.array(group[first]), part.column("ref").take(rows), stored.take(rows), axes]
                    yield pa.RecordBatch.from_arrays(columns, ["table", "bucket", "ref", "unit", "axes"])

    return run


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of matching rows, summed in the order of the components."""
    scale_q, scale_v = np.abs(q).max(axis=1, keepdims=True), np.abs(v).max(axis=1, keepdims=True)
    q, v = q / scale_q, v / scale_v
    return (q * v).sum(axis=1) / np.sqrt((q * q).sum(axis=1) * (v * v).sum(axis=1))


def _best(q: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` nearest of each q, and of what comes as close to the last as rounding reaches."""
    order = np.lexsort((-near, q))
    first = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1])))
    size = np.diff(np.append(first, len(order)))
    last = near[order[first + np.minimum(size, keep) - 1]]
    return order[near[order] >= np.repeat(last, size) - SLACK]


class _Piece:
    """The rows of a piece by their last axis, each compared only with queries that probe that axis."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        axis = table.column("axes").combine_chunks().flatten().to_numpy()
        order = np.argsort(axis, kind="stable")
        self.ref, self.unit = table.column("ref").to_numpy()[order], _matrix(table.column("unit").combine_chunks())[order]
        self.axes, self.first = np.unique(axis[order], return_index=True)
        self.edges = np.append(self.first, len(order))

    def nearest(self, asked: pa.RecordBatch, keep: int) -> pa.RecordBatch | None:
        ref, q, axes = asked.column("ref").to_numpy(), _matrix(asked.column("unit")), asked.column("axes")
        axis = axes.flatten().to_numpy()
        order = np.argsort(axis, kind="stable")
        at = np.repeat(np.arange(len(q)), axes.value_lengths().to_numpy())[order]
        low, high = (np.searchsorted(axis[order], self.axes, side) for side in ("left", "right"))
        found = []
        for i in np.flatnonzero(high > low):
            who, start, stop = at[low[i] : high[i]], self.edges[i], self.edges[i + 1]
            near = q[who] @ self.unit[start:stop].T
            if stop - start > keep:
                last = -np.partition(-near, keep - 1, axis=1)[:, keep - 1 : keep]
                row, column = np.nonzero(near >= last - SLACK)
            else:
                row, column = (x.reshape(-1) for x in np.indices(near.shape))
            found.append((who[row], start + column, near[row, column]))
        if not found:
            return None
        who, what, near = (np.concatenate(x) for x in zip(*found, strict=True))
        some = _best(who, near, keep)
        return pa.RecordBatch.from_arrays([pa.array(ref[who[some]]), pa.array(self.ref[what[some]]), pa.array(near[some])], ["q", "v", "near"])


def _compare(keep: int):
    """Rows sorted by piece, its vectors before its queries, to the best candidates of each query in each piece.

    A task holds one piece's vectors; its queries pass by in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        piece, now = None, None
        for batch in batches:
            key, asks = batch.column("piece").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b == a:
                    continue
                if key[a] != now:
                    held, piece, now = [], None, key[a]
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                elif held or piece:
                    piece, held = piece or _Piece(held), []
                    for start in range(a, b, BLOCK):
                        found = piece.nearest(batch.slice(start, min(BLOCK, b - start)), keep)
                        if found is not None:
                            yield found

    return run


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", tables: int = TABLES, depth: int = DEPTH, probes: int = PROBES, cell: int = CELL, seed: int = SEED
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` found for each row of ``queries``.

    Rows with the query's own id are no candidates.
    """
    lengths = vectors.select(F.size(embedding).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dimension = lengths.n if lengths else 1
    space = CrossPolytope(dimension, tables, depth, seed)
    rows = usable(vectors, vec_id, embedding, dimension)
    # one entry for equal vectors; k + 1 members are enough, as a query itself may be one of them
    # (numbered in salted groups first, so that a very common vector is no single task's)
    place = F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(256))).withColumn("place", place).where(F.col("place") <= k + 1)
    some = salted.groupBy("v", "salt").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = some.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = materialise(entries.select(F.element_at("ids", 1).alias("ref"), "ids", "v"), "ann-entries")
    asked = usable(queries, vec_id, embedding, dimension).withColumnRenamed("vec_id", "query_id")
    asked = materialise(asked.groupBy("query_id").agg(F.min("v").alias("v")), "ann-queries")
    distinct = asked.groupBy("v").agg(F.min("query_id").alias("ref")).select("ref", "v")
    distinct = materialise(distinct, "ann-distinct")
    kind = "table int, bucket bigint, ref bigint, unit array<float>, axes array<smallint>"
    stored = materialise(entries.select("ref", "v").mapInArrow(_hash_rows(space, 1), kind), "ann-stored")
    # queries take far longer to hash than their bytes tell, so they are dealt to as many tasks as a shuffle has
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probed = materialise(distinct.repartition(tasks, "ref").mapInArrow(_hash_rows(space, probes), kind), "ann-probed")
    pieces = stored.groupBy("table", "bucket").agg(F.ceil(F.count("*") / cell).cast("int").alias("pieces"))
    pieces = materialise(pieces, "ann-pieces")
    many = pieces.where("pieces > 1")
    stored = stored.join(many, ["table", "bucket"], "left").withColumn("part", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("ref"), F.col("pieces"))).otherwise(0).cast("int"))
    probed = probed.join(pieces, ["table", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cols = ["table", "bucket", "part", "ref", "unit", "axes"]
    meet = stored.select(*cols, F.lit(False).alias("is_query")).unionByName(probed.select(*cols, F.lit(True).alias("is_query")))
    meet = meet.select(F.xxhash64("table", "bucket", "part").alias("piece"), "ref", "unit", "axes", "is_query")
    shards = meet.repartition("piece").sortWithinPartitions("piece", "is_query")
    found = shards.mapInArrow(_compare(k + 1), "q bigint, v bigint, near double").groupBy("q", "v").agg(F.max("near").alias("near"))
    found = materialise(_nearest(found, k), "ann-found")
    return _rank(_with_short(found, distinct, entries, k), asked, distinct, entries, k)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """For each query's entry the k + 1 nearest entries, and all that rounding may have put behind them."""
    every = Window.partitionBy("q").orderBy(F.desc("near"), "v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.coalesce(F.nth_value("near", k + 1).over(every), F.lit(-2.0))
    return found.withColumn("last", last).where(F.col("near") >= F.col("last") - 2 * SLACK).select("q", "v")


def _with_short(found: DataFrame, distinct: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Queries for which the tables gave too few entries (a tiny or scattered index) are compared with every entry, in blocks."""
    members = found.join(entries.select(F.col("ref").alias("v"), F.size("ids").alias("n")), "v").groupBy("q").agg(F.sum("n").alias("n"))
    short = distinct.join(members.withColumnRenamed("q", "ref"), "ref", "left").where(F.coalesce("n", F.lit(0)) <= k).select("ref", "v")
    short = materialise(short.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(F.pmod("ref", F.lit(64))).orderBy("ref")) - 1) / 32)), "ann-short")
    parts = [found]
    for block in sorted(r.block for r in short.select("block").distinct().collect()):
        few = short.where(F.col("block") == block).select("ref", "v").toArrow().combine_chunks()  # 64 x 32 at most
        refs, q = few.column("ref").to_numpy(), _matrix(few.column("v").chunk(0))
        q = q / np.abs(q).max(axis=1, keepdims=True)
        shared = entries.sparkSession.sparkContext.broadcast((refs, q / np.linalg.norm(q, axis=1, keepdims=True)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            refs, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column("v"))
                v = v / np.abs(v).max(axis=1, keepdims=True)
                near = q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                take = min(k + 1, near.shape[1])
                last = -np.partition(-near, take - 1, axis=1)[:, take - 1 : take]
                rows, at = np.nonzero(near >= last - SLACK)
                yield pa.RecordBatch.from_arrays([pa.array(refs[rows]), batch.column("ref").take(pa.array(at)), pa.array(near[rows, at])], ["q", "v", "near"])

        every = entries.select("ref", "v").mapInArrow(scan, "q bigint, v bigint, near double")
        parts.append(materialise(_nearest(every, k), "ann-scanned"))
    return reduce(DataFrame.unionAll, parts).distinct()


def _rank(found: DataFrame, asked: DataFrame, distinct: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    @F.arrow_udf("double")
    def cosine(q: pa.Array, v: pa.Array) -> pa.Array:
        return pa.array(cosines(_matrix(q), _matrix(v)))

    pairs = found.join(distinct.select(F.col("ref").alias("q"), F.col("v").alias("qv")), "q").join(entries.select(F.col("ref").alias("v"), F.col("v").alias("vv"), "ids"), "v")
    scored = pairs.select("q", "ids", cosine("qv", "vv").alias("score"))
    best = scored.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("near"))  # a few dozen for each
    own = asked.join(distinct.select(F.col("ref").alias("q"), "v"), "v").select("query_id", "q")
    each = own.join(best, "q").select("query_id", F.explode("near").alias("n")).select("query_id", F.col("n.score").alias("score"), F.explode("n.ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = each.where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
