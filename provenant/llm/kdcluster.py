"""Centroid clustering by filtering kd-trees.

Vectors become integers, so every sum, distance and tie is exact. Each task
packs its rows into kd-trees of at most ``CHUNK`` vectors, whose nodes hold
their count, integer sum and bounding box; the trees are written once to the
shared folder. A round broadcasts the centroids (``k`` of them) and walks every
tree from its root: of a node's candidates all that are farther than another
one from every point of its box are pruned. A node with one candidate left is
assigned whole, by its stored sum; at leaves the distances decide. Only strictly
dominated centroids are pruned, so ties reach the leaves and go to the smaller
number. A task sends one row a cluster and tree; the driver gets ``k`` sums.

Boxes of unstructured vectors in many dimensions are wide and prune little, so
the leaves then do a plain assignment's work; clustered vectors prune early.

Defined results: vectors that are null, of another length, or hold null or
non-finite components take no part; repeated rows count each; equal ids start
in order of their components; a null id starts last; with fewer vectors than
``k`` each is a start; equal starts leave all but the first empty, which stay;
no vectors give no rows. Components beyond 2^26 after scaling are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import materialise
from provenant.llm.integers import finite, floors, narrow, products

CHUNK, LEAF = 8192, 32

_TREE = "ids array<bigint>, n int, item int, x binary, lo binary, hi binary, sums binary"


def levels(n: int) -> list[np.ndarray]:
    """Where the nodes of each level begin and end among ``n`` sorted rows; halves down to leaves of ``LEAF`` to twice as many."""
    out = [np.array([0, n])]
    while n >= 2 * LEAF:
        last = out[-1]
        out.append(np.insert(last, np.arange(1, len(last)), (last[:-1] + last[1:]) // 2))
        n = int(np.diff(out[-1]).min())
    return out


def plant(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, and the lows, highs and sums of all nodes, root first) of the kd-tree of some vectors."""
    order, edges = np.arange(len(x)), levels(len(x))
    for now, then in zip(edges, edges[1:], strict=False):
        for i, (start, stop) in enumerate(zip(now, now[1:], strict=False)):
            own = x[order[start:stop]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order[start:stop] = order[start:stop][np.argpartition(own[:, axis], then[2 * i + 1] - start - 1)]
    ordered = x[order]
    lo, hi, sums = ([f.reduceat(ordered, edges[-1][:-1], axis=0)] for f in (np.minimum, np.maximum, np.add))
    for _ in edges[1:]:
        lo.append(np.minimum(lo[-1][::2], lo[-1][1::2]))
        hi.append(np.maximum(hi[-1][::2], hi[-1][1::2]))
        sums.append(sums[-1][::2] + sums[-1][1::2])
    return order, *(np.concatenate(s[::-1]) for s in (lo, hi, sums))


def _plant(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def tree() -> pa.RecordBatch:
            ids, x = pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held])
            held.clear()
            order, lo, hi, sums = plant(x)
            kind = narrow(x).dtype
            data = [kind.itemsize, x[order].astype(kind).tobytes(), lo.astype(kind).tobytes(), hi.astype(kind).tobytes(), sums.astype(np.int64).tobytes()]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            own = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids.take(pa.array(order)))
            return pa.RecordBatch.from_arrays([own, pa.array([len(x)], pa.int32()), *(pa.array([d], t) for d, t in zip(data, kinds, strict=True))], ["ids", "n", "item", "x", "lo", "hi", "sums"])

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                take = min(batch.num_rows - start, CHUNK - sum(len(v) for _, v in held))
                part = batch.slice(start, take)
                x, edges = floors(part.column("v"), scale)
                held.append((part.column("id"), x.reshape(len(edges) - 1, -1)))
                start += take
                if sum(len(v) for _, v in held) == CHUNK:
                    yield tree()
        if held:
            yield tree()

    return run


def _trees(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple]:
    """(ids, vectors, edges by level, lows, highs, sums) of each stored tree."""
    for batch in batches:
        for i in range(batch.num_rows):
            kind = f"<i{batch.column('item')[i].as_py()}"
            read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind).reshape(-1, dimension).astype(np.int64)  # noqa: B023, E731
            yield batch.column("ids").slice(i, 1).flatten(), read("x", kind), levels(batch.column("n")[i].as_py()), read("lo", kind), read("hi", kind), read("sums", "<i8")


def assign(x: np.ndarray, edges: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Each row's nearest centroid, -1 where its whole node has one; and these: (node, centroid)."""
    owner, whole = np.full(len(x), -1), []
    squares = (centroids**2).sum(axis=1)
    nodes, alive, first = np.zeros(1, int), np.ones((1, len(centroids)), bool), 0
    for level, bounds in enumerate(edges):
        low, high = lo[first + nodes], hi[first + nodes]
        # the candidate nearest to the middle of the box, twice which is an integer
        away = ((2 * centroids[None] - (low + high)[:, None]) ** 2).sum(axis=2)
        best = np.where(alive, away, np.iinfo(np.int64).max).argmin(axis=1)
        # at the corner farthest towards a candidate: is it still farther than the best one?
        step = centroids[None] - centroids[best][:, None]
        corner = np.maximum(step * high[:, None], step * low[:, None]).sum(axis=2)
        alive &= squares[None] - squares[best][:, None] - 2 * corner <= 0
        alone = alive.sum(axis=1) == 1
        whole += [(int(first + node), int(c)) for node, c in zip(nodes[alone], best[alone], strict=True)]
        nodes, alive = nodes[~alone], alive[~alone]
        if not len(nodes):
            break
        if level + 1 == len(edges):
            sizes = np.diff(bounds)[nodes]
            rows = np.concatenate([np.arange(bounds[n], bounds[n + 1]) for n in nodes])
            score = squares[None] - 2 * products(x[rows], centroids)
            owner[rows] = np.where(np.repeat(alive, sizes, axis=0), score, np.iinfo(np.int64).max).argmin(axis=1)
        first += len(bounds) - 1
        nodes, alive = (2 * nodes[:, None] + np.arange(2)).reshape(-1), np.repeat(alive, 2, axis=0)
    return owner, whole


def _span(edges: list[np.ndarray], node: int) -> tuple[int, int]:
    """Rows of a node, numbered from the root."""
    for bounds in edges:
        if node < len(bounds) - 1:
            return int(bounds[node]), int(bounds[node + 1])
        node -= len(bounds) - 1
    raise IndexError(node)


def _sums(shared, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimension), np.int64)
        for _, x, edges, lo, hi, held in _trees(batches, dimension):
            owner, whole = assign(x, edges, lo, hi, centroids)
            for node, c in whole:
                start, stop = _span(edges, node)
                counts[c] += stop - start
                sums[c] += held[node]
            for c in np.unique(owner[owner >= 0]):
                counts[c] += (owner == c).sum()
                sums[c] += x[owner == c].sum(axis=0)
        some = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dimension), pa.array(sums[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), lists], ["cluster", "n", "sums"])

    return run


def _rows(shared, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for ids, x, edges, lo, hi, _ in _trees(batches, dimension):
            owner, whole = assign(x, edges, lo, hi, centroids)
            for node, c in whole:
                start, stop = _span(edges, node)
                owner[start:stop] = c
            distance = ((x - centroids[owner]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(owner.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def cluster(
    vectors: DataFrame, k: int, rounds: int, dimension: int, seed: str = "2", scale: int = 256, id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of each vector, the final centroids).

    Starts are the ``k`` vectors with the least SHA-256 of ``seed:id``. ``k``
    times ``dimension`` integers are all that the driver and a broadcast hold.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == dimension) & finite(F.col("v")))
    first = rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")), 256)).orderBy(F.col("id").isNull(), "h", "v").limit(k)
    starts = pa.array([r.v for r in first.select("v").collect()], pa.list_(pa.float64()))
    centroids = floors(starts, scale)[0].reshape(-1, dimension)
    if not len(centroids):
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint"), centroids
    # not compressed: what a task reads is as large as the files it is dealt by
    trees = materialise(rows.mapInArrow(_plant(scale), _TREE), "kd-trees", compression="none")
    totals = [F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dimension))]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)
        got = trees.mapInArrow(_sums(shared, dimension), "cluster int, n bigint, sums array<bigint>").groupBy("cluster").agg(*totals).collect()  # k rows
        centroids = centroids.copy()
        for r in got:
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dimension)]
    return trees.mapInArrow(_rows(spark.sparkContext.broadcast(centroids), dimension), "id bigint, cluster int, distance bigint"), centroids


K, ROUNDS, DIMENSION = 40, 5, 64


def op13_kd_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), K, ROUNDS, DIMENSION)
    found = materialise(found, "kd-assigned")
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    per = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION) -> str:
    """The same in SQL, each round a pair of common tables."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id IS NULL, sha256('2:' || vec_id), e) - 1 AS c, v FROM kept
  QUALIFY c < {k})"""]
    nearest = "a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c.c)) AS m FROM kept CROSS JOIN c{i} c GROUP BY r)"
    for i in range(rounds):
        steps.append(nearest.format(i=i))
        steps.append(f"""s{i} AS (
  SELECT c, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS x, unnest(range({dimension})) AS p FROM kept JOIN a{i} USING (r)) GROUP BY c, p)""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c0.c, coalesce(n.v, c0.v) AS v FROM c{i} c0 LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{i} GROUP BY c) n ON n.c = c0.c)""")
    steps.append(nearest.format(i=rounds))
    return ",\n".join(steps) + f"""
SELECT vec_id, m.c::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.c = m.c"""


ORACLE = oracle()
