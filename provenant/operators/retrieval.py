"""Retrieval: exact top-k, ranks, two-stage and hybrid ranking, and evaluation measures.

Probes are a bounded side (the caller's queries). Scores are computed against
them in blocks: each block of probes goes out by broadcast and is at most
``PROBE_BYTES``; the entries, which are the large side, are only scanned. The
partial limit of a ranking window runs before its shuffle, so at most k rows a
probe and task travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import text as T
from provenant.functions import vectors as V
from provenant.operators.relational import scratch

PROBE_BYTES = 64 << 20
MARKS = 100_000  # of a few dozen bytes each, in one matcher
GROUP = 32_768  # rows of one side of a cell of the exact top k
TILE, PIECE, PAIRS = 4096, 1024, 1 << 16  # entries and probes of one product; pairs scored again at a time


def probe_blocks(probes: DataFrame, key: str = "probe_id", width: int = 1024) -> list[DataFrame]:
    """Parts of ``probes`` small enough to broadcast, by hash of their key; one part if they are few."""
    n = probes.count()
    blocks = max(1, -(-n * width * 8 // PROBE_BYTES))
    return [probes] if blocks == 1 else [probes.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]


def uniform(rows: DataFrame, vector: str = "embedding", length: int | None = None) -> tuple[DataFrame, int]:
    """(the rows whose vector can take part, its length): finite vectors of the commonest length, or of the given one."""
    rows = rows.where(V.finite(F.col(vector)))
    if length is None:
        first = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = first.n if first else 1
    return rows.where(F.size(vector) == length), length


def scores(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe columns, entry_index, score): inner products of every probe with every entry.

    ``entries(entry_index, embedding, ...)``, ``probes(probe_id, probe, ...)``.
    """
    parts = [entries.crossJoin(F.broadcast(p)).withColumn("score", V.dot(F.col("embedding"), F.col("probe"))).drop("embedding", "probe") for p in probe_blocks(probes)]
    return reduce(DataFrame.unionByName, parts)


def by_score(*partition: str) -> Window:
    """Best score first; ties go to the smaller entry index."""
    return Window.partitionBy(*partition).orderBy(F.desc("score"), "entry_index")


def topk(scored: DataFrame, k: int, partition: str = "probe_id") -> DataFrame:
    """The first ``k`` entries of each probe with their ordinal ``rank``."""
    return scored.withColumn("rank", F.row_number().over(by_score(partition))).where(F.col("rank") <= k)


def topk_blocked(entries: DataFrame, probes: DataFrame, k: int, floors: DataFrame | None = None) -> DataFrame:
    """(probe_id, entry_index, score, rank) of the exact top ``k``, scored by matrix products.

    Entries and probes are dealt into groups of at most ``GROUP`` rows by hash;
    each pair of groups is a cell, which goes through its entries in tiles and
    holds ``k`` rows a probe, so a task's memory does not grow with the tables.
    A tile's product is in single precision; all that its error bound leaves in
    question is scored again in double, always in one order of addition. The
    cells' rows meet in :func:`topk`. Neither side passes through the driver.
    With ``floors(id, floor)`` a probe's entries below its floor are left out.
    Entries or probes without a finite vector of the common length take no part.
    """
    tasks = max(16, entries.sparkSession.sparkContext.defaultParallelism)
    # written once: what makes the vectors runs once, and in many tasks
    rows, asked = (scratch(df.select(F.col(key).cast("bigint").alias("id"), F.col(c).alias("v")).repartition(tasks).withColumn("v", V.doubles(F.col("v")))) for df, key, c in ((entries, "entry_index", "embedding"), (probes, "probe_id", "probe")))
    rows, length = uniform(rows, "v")
    asked, _ = uniform(asked, "v", length)
    n_entries, n_probes = rows.count(), asked.count()
    # at least a few cells a core, as square as they can be
    side = max(256, min(GROUP, int((n_entries * n_probes / (4 * tasks)) ** 0.5)))
    across, down = (max(1, -(-n // side)) for n in (n_entries, n_probes))
    group = lambda key, groups: F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asked = asked.join(floors, "id", "left") if floors is not None else asked.withColumn("floor", F.lit(None).cast("double"))
    left = asked.select(F.lit(0).alias("side"), "id", "v", "floor", group("id", down).alias("row"), every(across).alias("col"))
    right = rows.select(F.lit(1).alias("side"), "id", "v", F.lit(None).cast("double").alias("floor"), group("id", across).alias("col"), every(down).alias("row"))
    cells = left.unionByName(right).select((F.col("row") * across + F.col("col")).alias("cell"), "side", "id", "v", "floor")
    cells = cells.repartition(across * down, "cell").sortWithinPartitions("cell", "side")
    return topk(cells.mapInArrow(lambda batches: _cells(batches, k), "probe_id bigint, entry_index bigint, score double"), k)


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows by cell, probes first, to each probe's best ``k`` of its cell."""
    now, asked, best = None, [], None

    def done() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(best.ids) if best else 0, 8192):
            yield best.rows(slice(at, at + 8192))

    for batch in batches:
        cell, sides, ids = (batch.column(c).to_numpy() for c in ("cell", "side", "id"))
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))
        edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(sides) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if a == b:
                continue
            if cell[a] != now:
                yield from done()
                now, asked, best = cell[a], [], None
            if sides[a] == 0:
                asked.append((ids[a:b].copy(), v[a:b].copy(), batch.column("floor").slice(a, b - a).fill_null(-np.inf).to_numpy()))
            elif asked:
                best = best or _Best(*(np.concatenate(c) for c in zip(*asked, strict=True)), k)
                for at in range(a, b, TILE):
                    best.add(ids[at : min(at + TILE, b)], v[at : min(at + TILE, b)])
    yield from done()


class _Best:
    """The best ``k`` entries of some probes by inner product, ties to the smaller index."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.floor, self.k = ids, q, floor, k
        self.scale = np.maximum(np.abs(q).max(axis=1), 1e-300)
        self.single = (q / self.scale[:, None]).astype(np.float32)
        self.norm = np.sqrt(np.square(self.single, dtype=np.float64).sum(axis=1))
        self.score, self.entry = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        # of equal vectors only the first k can matter
        _, own = np.unique(np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)
        order = np.lexsort((ids, own))
        few = order[np.arange(len(order)) - np.searchsorted(own[order], own[order]) < self.k]
        ids, v = ids[few], v[few]
        scale = max(np.abs(v).max(initial=0), 1e-300)
        single = (v / scale).astype(np.float32)
        # a single-precision product of n terms is off by less than this times both norms; tiny components may vanish besides
        slack = (v.shape[1] + 16) * 2.0**-23 * np.sqrt(np.square(single, dtype=np.float64).sum(axis=1).max(initial=0)) + v.shape[1] * 2.0**-120
        for a in range(0, len(self.ids), PIECE):
            b = min(a + PIECE, len(self.ids))
            s = self.single[a:b] @ single.T
            least = np.maximum(self.score[a:b, -1], self.floor[a:b]) / self.scale[a:b] / scale
            if len(ids) >= 8 * self.k and not np.isfinite(least).all():
                # the k-th of the maxima of some groups is no better than the k-th of all
                width = len(ids) // (4 * self.k)
                tops = s[:, : 4 * self.k * width].reshape(b - a, 4 * self.k, width).max(axis=2)
                least = np.maximum(least, -np.partition(-tops, self.k - 1, axis=1)[:, self.k - 1] - slack * self.norm[a:b])
            least = least - slack * self.norm[a:b] - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))
            at = np.flatnonzero(s >= least.astype(np.float32)[:, None])
            row, col = at // s.shape[1], at % s.shape[1]
            for at in range(0, len(row), PAIRS):
                self._merge(row[at : at + PAIRS] + a, ids[col[at : at + PAIRS]], v[col[at : at + PAIRS]])

    def _merge(self, row: np.ndarray, entry: np.ndarray, v: np.ndarray) -> None:
        score = _dots(self.q[row], v)
        some = score >= np.maximum(self.score[row, -1], self.floor[row])
        row, entry, score = row[some], entry[some], score[some]
        touched, count = np.unique(row, return_counts=True)
        row = np.concatenate([row, np.repeat(touched, self.k)])
        entry, score = np.concatenate([entry, self.entry[touched].ravel()]), np.concatenate([score, self.score[touched].ravel()])
        order = np.lexsort((entry, -score, row))
        place = np.arange(len(order)) - np.repeat(np.cumsum(count + self.k) - count - self.k, count + self.k)
        order = order[place < self.k]
        self.score[touched], self.entry[touched] = score[order].reshape(-1, self.k), entry[order].reshape(-1, self.k)

    def rows(self, part: slice) -> pa.RecordBatch:
        held = self.score[part] > -np.inf
        ids = np.repeat(self.ids[part], held.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(self.entry[part][held]), pa.array(self.score[part][held])], ["probe_id", "entry_index", "score"])


def sign_keys(vector: Column, dimension: int, tables: int, bits: int, seed: int, flips: bool = False) -> Column:
    """One key a table: the signs of a vector's products with ``bits`` random directions; and those with one sign turned."""
    planes = np.random.default_rng(seed).normal(size=(dimension, tables * bits))
    turned = np.concatenate(([0], 1 << np.arange(bits))) if flips else np.zeros(1, np.int64)

    @F.arrow_udf("array<bigint>")
    def of(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.empty((0, dimension))
        code = ((x @ planes).reshape(len(x), tables, bits) > 0) @ (1 << np.arange(bits))
        keys = ((np.arange(tables) << bits) + code)[:, :, None] ^ turned
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (tables * len(turned))), pa.array(keys.reshape(-1).astype(np.int64)))

    return of(V.doubles(vector))


def topk_approximate(entries: DataFrame, probes: DataFrame, k: int, tables: int = 32, bits: int | None = None, seed: int = 11, checked: bool = False) -> DataFrame:
    """:func:`topk` among the entries that share a key with a probe, ranked by their exact inner products.

    Unit vectors of cosine c agree in a sign with a chance of 1 - acos(c) / pi,
    and a probe looks at the buckets one sign away too. Keys have 10 bits, and
    more where there are many entries, so that a bucket holds a few. Some pairs
    are always missed by all tables: with ``checked``, the scores found become
    floors of :func:`topk_blocked`, which adds every entry that reaches them, and
    the result is exact. Entries are only scanned, the probes' keys go out by
    broadcast, and only pairs found are joined again.
    Entries or probes without a finite vector of the common length take no part.
    """
    entries, dimension = uniform(entries)
    probes, _ = uniform(probes, "probe", dimension)
    bits = bits or max(10, entries.count().bit_length() - 3)
    stored = entries.select("entry_index", F.explode(sign_keys(F.col("embedding"), dimension, tables, bits, seed)).alias("key"))
    found = []
    for part in probe_blocks(probes.select("probe_id", "probe"), width=tables * (bits + 1)):
        asked = part.select("probe_id", F.explode(sign_keys(F.col("probe"), dimension, tables, bits, seed, True)).alias("key"))
        pairs = stored.join(F.broadcast(asked), "key").select("probe_id", "entry_index").distinct()
        found.append(pairs.join(entries.select("entry_index", "embedding"), "entry_index").join(F.broadcast(part), "probe_id"))
    near = reduce(DataFrame.unionByName, found).select("probe_id", "entry_index", V.dot(F.col("embedding"), F.col("probe")).alias("score"))
    near = topk(near, k)
    if not checked:
        return near
    near = scratch(near)
    last = near.where(F.col("rank") == k).select(F.col("probe_id").cast("bigint").alias("id"), (F.col("score") - 1e-9 * F.greatest(F.lit(1.0), F.abs("score"))).alias("floor"))
    rest = topk_blocked(entries, probes, k, last).drop("rank")
    # the search's own sums are kept, so that equal vectors have equal scores
    both = rest.unionByName(near.drop("rank").join(rest, ["probe_id", "entry_index"], "left_anti").select(rest.columns))
    return topk(both, k)


def merge_shards(shards: list[DataFrame], k: int, path: str = "entry_index") -> DataFrame:
    """Union of shard results, the best row of each entry, then the top ``k`` again."""
    best = Window.partitionBy("probe_id", path).orderBy(F.desc("score"), "entry_index")
    union = reduce(DataFrame.unionByName, shards)
    return topk(union.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "rank"), k)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, each the same whatever rows stand beside it."""
    return (np.ascontiguousarray(a) * np.ascontiguousarray(b)).sum(axis=1)


def target_ranks(entries: DataFrame, probes: DataFrame, target: str = "target_index", **among: Column) -> DataFrame:
    """(probe_id, ordinal_rank, competition_rank, n_entries), and an ordinal rank for each of ``among``.

    The ordinal rank is the target's place by score and index, the competition
    rank one more than the strictly better entries. ``among`` names conditions
    on the entries; the rank under such a name counts only entries that meet its
    condition. A target that is not among the entries in question ranks behind
    all of them.

    The targets' own scores come from a join by index and go out with the probes,
    in blocks of a checked size. The entries are dealt evenly over the tasks and
    scanned once a block; a task multiplies tiles of a fixed size, counts the
    entries before every target and sends one row a probe, so no score is
    shuffled and its memory does not grow with the tables.

    Entries or probes without a finite vector of the common length take no part.
    """
    flags, spark = list(among), entries.sparkSession
    tasks = max(16, spark.sparkContext.defaultParallelism)
    dealt = lambda df, vector: scratch(df.repartition(tasks).withColumn(vector, V.doubles(F.col(vector))))
    rows = dealt(entries.select(F.col("entry_index").cast("bigint").alias("entry_index"), F.col("embedding").alias("v"), *(F.coalesce(c, F.lit(False)).alias(f) for f, c in among.items())), "v")
    rows, length = uniform(rows, "v")
    asked, _ = uniform(dealt(probes.select(F.col("probe_id").cast("bigint").alias("probe_id"), F.col(target).cast("bigint").alias("target"), F.col("probe").alias("q")), "q"), "q", length)
    own = rows.select(F.col("entry_index").alias("target"), F.col("v").alias("own"), *(F.col(f).alias(f"own_{f}") for f in flags))
    own = own.join(asked.select("target").distinct(), "target", "left_semi").dropDuplicates(["target"])
    asked = scratch(asked.join(own, "target", "left"))
    found, schema = [], ", ".join(["probe_id bigint", "better bigint", "n bigint", "before bigint", *(f"`before_{f}` bigint" for f in flags)])
    for part in probe_blocks(asked, width=2 * length):
        table = part.toArrow().combine_chunks()  # a block of at most PROBE_BYTES
        matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        q = matrix(table.column("q"))
        lost = table.column("own").is_null().to_numpy()
        own = q.copy()
        own[~lost] = matrix(table.column("own").drop_null())
        inside = {f: table.column(f"own_{f}").fill_null(False).to_numpy() for f in flags}
        ids, targets = table.column("probe_id").to_numpy(), table.column("target").fill_null(-1).to_numpy()
        shared = spark.sparkContext.broadcast((ids, targets, q, np.where(lost, -np.inf, _dots(q, own)), inside))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, targets, q, own, inside = shared.value
            near = np.where(np.isfinite(own), 1e-9 * np.maximum(1, np.abs(own)), -1)
            better, n, before = np.zeros(len(ids), np.int64), 0, {f: np.zeros(len(ids), np.int64) for f in ["", *flags]}
            for batch in batches:
                for start in range(0, batch.num_rows, TILE):
                    piece = batch.slice(start, TILE)
                    entry, n = piece.column("entry_index").to_numpy(), n + piece.num_rows
                    v = piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                    holds = {f: piece.column(f).to_numpy(zero_copy_only=False) for f in flags}
                    for a in range(0, len(ids), PIECE):
                        part = slice(a, a + PIECE)
                        s, mine = q[part] @ v.T, own[part, None]
                        # a matrix product rounds by its shape: what comes close is summed again, always in one order
                        above = s > mine + near[part, None]
                        close = np.flatnonzero((s >= mine - near[part, None]) & ~above) if np.isfinite(own[part]).any() else np.empty(0, np.int64)
                        earlier = above.copy()
                        for at in range(0, len(close), PAIRS):
                            row, col = close[at : at + PAIRS] // s.shape[1], close[at : at + PAIRS] % s.shape[1]
                            again, level = _dots(q[part][row], v[col]), own[part][row]
                            above[row, col] = again > level
                            earlier[row, col] = (again > level) | ((again == level) & (entry[col] < targets[part][row]))
                        better[part] += above.sum(axis=1)
                        before[""][part] += earlier.sum(axis=1)
                        for f in flags:
                            # a target outside the condition ranks behind all that meet it
                            before[f][part] += ((earlier | ~inside[f][part, None]) & holds[f][None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(better), pa.array(np.full(len(ids), n)), *(pa.array(before[f]) for f in ["", *flags])], ["probe_id", "better", "n", "before", *(f"before_{f}" for f in flags)])

        found.append(rows.mapInArrow(count, schema))
    sums = reduce(DataFrame.unionAll, found).groupBy("probe_id")
    return sums.agg((F.sum("before") + 1).alias("ordinal_rank"), (F.sum("better") + 1).alias("competition_rank"), F.sum("n").alias("n_entries"), *((F.sum(f"before_{f}") + 1).alias(f) for f in flags))


def rank_or_absent(probes: DataFrame, hits: DataFrame, absent: Column, target: str = "target_index") -> DataFrame:
    """Rank of each probe's target among its hits, ``absent`` where it is not there."""
    own = hits.select(F.col("probe_id").alias("hit_probe"), F.col("entry_index").alias("hit_entry"), "rank")
    return probes.join(own, (F.col("probe_id") == F.col("hit_probe")) & (F.col(target) == F.col("hit_entry")), "left").withColumn("target_rank", F.coalesce("rank", absent)).drop("rank", "hit_probe", "hit_entry")


def rank_in_list(ids: Column, target: Column) -> Column:
    """Place of a target in a list of ids from 1; null where absent."""
    return F.nullif(F.array_position(ids, target), F.lit(0))


def zscored(rows: DataFrame, *values: str, by: str) -> DataFrame:
    """Each value's population z-score within its group, under ``z_`` and its name; zero where the spread is below 1e-8.

    Means and spreads are one partial aggregate, one row a group, joined back;
    no group is sorted or held by one task.
    """
    sums = [x for v in values for x in (F.avg(v).alias(f"__mean_{v}"), F.stddev_pop(v).alias(f"__spread_{v}"))]
    out = rows.join(rows.groupBy(F.col(by).alias("__by")).agg(*sums), F.col(by).eqNullSafe(F.col("__by")))
    z = [F.when(F.col(f"__spread_{v}") < 1e-8, 0.0).otherwise((F.col(v) - F.col(f"__mean_{v}")) / F.col(f"__spread_{v}")).alias(f"z_{v}") for v in values]
    return out.select(*rows.columns, *z)


def hybrid(entries: DataFrame, probes: DataFrame, lexical: DataFrame, k: int, weight: float = 0.35) -> DataFrame:
    """(probe_id, entry_index, score, rank): the top ``k`` by z(visual) + weight * z(lexical) within each probe.

    ``lexical(probe_id, entry_index, lexical)`` has the pairs with a common
    token; all others count zero. Means and spreads are aggregates, one row a
    probe. Pairs without a token are ordered by the visual score alone, so the
    best ``k`` by it stand for all of them, and the product of probes and
    entries is never shuffled.
    """
    if weight < 0:
        raise ValueError("the weight must not be negative")
    lexical = lexical.join(entries.select("entry_index"), "entry_index", "left_semi").select("probe_id", "entry_index", "lexical")
    visual = scores(entries.select("entry_index", "embedding"), probes.select("probe_id", "probe"))
    stats = visual.groupBy("probe_id").agg(F.count("*").alias("n"), F.avg("score").alias("vm"), F.stddev_pop("score").alias("vs"))
    sums = lexical.groupBy("probe_id").agg(F.sum("lexical").alias("ls"), F.sum(F.col("lexical") * F.col("lexical")).alias("lq"))
    stats = stats.join(sums, "probe_id", "left").withColumn("lm", F.coalesce("ls", F.lit(0.0)) / F.col("n"))
    stats = stats.withColumn("ld", F.sqrt(F.greatest(F.coalesce("lq", F.lit(0.0)) / F.col("n") - F.col("lm") * F.col("lm"), F.lit(0.0))))
    z = lambda value, mean, spread: F.when(F.col(spread) < 1e-8, 0.0).otherwise((F.col(value) - F.col(mean)) / F.col(spread))
    alone = topk(visual, k).select("probe_id", "entry_index", F.col("score").alias("visual"), F.lit(0.0).alias("lexical"))
    asked = lexical.join(entries.select("entry_index", "embedding"), "entry_index")
    parts = [asked.join(F.broadcast(p), "probe_id") for p in probe_blocks(probes.select("probe_id", "probe"))]
    both = reduce(DataFrame.unionByName, parts).select("probe_id", "entry_index", V.dot(F.col("embedding"), F.col("probe")).alias("visual"), "lexical")
    every = both.unionByName(alone).join(F.broadcast(stats), "probe_id").withColumn("score", z("visual", "vm", "vs") + weight * z("lexical", "lm", "ld"))
    # an entry comes twice at most: with its token, which weighs no less, and without
    few = topk(every.select("probe_id", "entry_index", "score"), 2 * k).groupBy("probe_id", "entry_index").agg(F.max("score").alias("score"))
    return topk(few, k)


def rerank(visual: DataFrame, lexical: DataFrame, pool: int) -> DataFrame:
    """The best ``pool`` entries of each probe by ``visual(.., score)``, ordered by ``lexical`` then visual score.

    Only the pools meet the lexical scores; a pair without one counts zero.
    """
    kept = topk(visual, pool).drop("rank").withColumnRenamed("score", "visual")
    both = kept.join(lexical, ["probe_id", "entry_index"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    order = Window.partitionBy("probe_id").orderBy(F.desc("lexical"), F.desc("visual"), "entry_index")
    return both.withColumn("rank", F.row_number().over(order))


def lexical_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(probe_id, entry_index, lexical) of every pair with a common token, by a join on tokens.

    ``docs(entry_index, tokens)``, ``queries(probe_id, query_tokens)``. Query
    terms count as often as they occur, document terms once; the sum is divided
    by the root of the document's length.
    """
    asked = queries.select("probe_id", F.explode("query_tokens").alias("token")).groupBy("probe_id", "token").agg(F.count("*").alias("tf"))
    held = docs.select("entry_index", F.size("tokens").alias("n"), F.explode(F.array_distinct("tokens")).alias("token"))
    return held.join(asked, "token").groupBy("probe_id", "entry_index").agg((F.sum("tf") / F.sqrt(F.max("n").cast("double"))).alias("lexical"))


def rare_token_boost(query: Column, doc: Column, mark: Column, boost: float = 1000.0) -> Column:
    """``boost`` where both normalised texts contain the normalised mark."""
    token = T.normalize_text(mark)
    return F.when((token != "") & F.contains(T.normalize_text(query), token) & F.contains(T.normalize_text(doc), token), boost).otherwise(0.0)


def boosted(captions: DataFrame, queries: DataFrame, boost: float = 1000.0) -> DataFrame:
    """(probe_id, entry_index, boost) of the pairs with a boost: ``queries(probe_id, text, mark)`` against all captions.

    A query that does not hold its own mark boosts nothing. The distinct marks
    of the others are broadcast, in blocks of ``MARKS``, and each task looks for
    all of them in one pass over a caption; only marks found meet their queries.
    """
    asked = queries.select("probe_id", T.normalize_text(F.col("mark")).alias("token"), T.normalize_text(F.col("text")).alias("asked"))
    asked = asked.where((F.col("token") != "") & F.contains("asked", "token")).select("probe_id", "token")
    held = captions.select(F.col("entry_index").cast("bigint").alias("entry_index"), T.normalize_text(F.col("caption")).alias("caption"))
    marks = asked.select("token").distinct()
    n = max(1, -(-marks.count() // MARKS))
    found = []
    for i in range(n):
        own = [r.token for r in marks.where(F.pmod(F.xxhash64("token"), F.lit(n)) == i).collect()]  # a block of about MARKS
        shared = captions.sparkSession.sparkContext.broadcast(own)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = ahocorasick.Automaton()
            for mark in shared.value:
                matcher.add_word(mark, mark)
            matcher.make_automaton()
            for batch in batches:
                rows, tokens = [], []
                for at, caption in enumerate(batch.column("caption").to_pylist()):
                    hits = sorted({m for _, m in matcher.iter(caption)}) if caption and shared.value else []
                    rows += [at] * len(hits)
                    tokens += hits
                yield pa.RecordBatch.from_arrays([batch.column("entry_index").take(pa.array(rows, pa.int64())), pa.array(tokens, pa.string())], ["entry_index", "token"])

        found.append(held.mapInArrow(look, "entry_index bigint, token string"))
    return reduce(DataFrame.unionAll, found).join(asked, "token").select("probe_id", "entry_index", F.lit(boost).alias("boost"))


def with_sidecar(captions: DataFrame, signatures: DataFrame, key: str = "entry_index", caption: str = "caption") -> DataFrame:
    """Captions of marked entries gain a provenance note with their signature."""
    note = F.when(F.col("signature").isNotNull(), F.concat(F.lit("provenance canary "), F.col("signature")))
    return captions.join(signatures.select(key, "signature"), key, "left").withColumn(caption, F.concat_ws(" ", caption, note))


def rank_measures(rank: str = "target_rank", ks: tuple[int, ...] = (1, 3, 10)) -> list[Column]:
    """Recall at each k, mean reciprocal rank, and the mean and median rank."""
    r = F.col(rank).cast("double")
    recall = [F.avg((r <= k).cast("double")).alias(f"recall_at_{k}") for k in ks]
    return [*recall, F.avg(1 / r).alias("mrr"), F.avg(r).alias("mean_rank"), F.percentile(r, F.lit(0.5)).alias("median_rank")]


def reciprocal_rank(rank: Column, beyond: Column | None = None) -> Column:
    """1/rank; zero beyond the given rank (an index's size, or k)."""
    return 1 / rank if beyond is None else F.when(rank <= beyond, 1 / rank).otherwise(0.0)


def contamination(hits: DataFrame, role: str = "role") -> Column:
    """Share of probes whose first hit is a contaminant."""
    return F.avg((F.col(role) == "contaminant").cast("double"))
