"""Hard negatives by a two-dimensional block matrix product.

Rows are integer vectors. They are sorted by label and cut into blocks, and each
block into chunks of ``CHUNK`` dimensions: tiles. Anchors' tiles meet the rows'
tiles of the same chunk on a grid (anchor block, row block, chunk), where a task
makes one partial tile of int64 scores. Partial tiles of one cell are shuffled
together and added, and the whole tile is reduced at once to a few rows: the
best of each anchor, or of each anchor's and positive's window. Scores never
leave their tile otherwise, and only the reduced rows are ranked again.

Blocks know their labels, so the product is made once in all: positives come
from cells whose labels meet, negatives from cells that hold two labels. Hot
labels are many blocks, as blocks are cut by size. Every cell has ``ANCHORS``
times ``ROWS`` scores at most, whatever the table's size; cells grow with
anchors times rows, which an exact answer for a stated set of anchors needs.

Defined results: rows with a null label or vector, or null or non-finite
components take no part; vectors of unequal length meet as if filled with
zeros; ties go to the smaller id, a null id last; a null id is no anchor;
repeated rows count each, and each as an anchor of its own; anchors without
positives or negatives give no rows, as do empty tables. Components beyond 2^26
after scaling are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.llm.common import materialise
from provenant.llm.integers import finite, floors, narrow, products

ANCHORS, ROWS, CHUNK = 256, 4096, 32

_TILE = "block bigint, first int, last int, chunk int, chunks int, n int, width int, item int, tile binary, rows array<struct<row:bigint,id:bigint,label:int>>"
_CELL = "a bigint, b bigint, chunk int, scores binary, anchors array<struct<row:bigint,id:bigint,label:int>>, entries array<struct<row:bigint,id:bigint,label:int>>, positives array<struct<at:int,row:bigint,id:bigint,score:bigint>>"


def _tiles(most: int, chunk: int, scale: int):
    """Sorted rows (row, id, label, v) to the tiles of their blocks; the first chunk's tile carries the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []

        def cut() -> pa.RecordBatch:
            nonlocal block
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            # ids in order, nulls last: a stable order by score then breaks ties
            part = part.take(pc.sort_indices(pa.Table.from_batches([part.select(["id", "row"])]), [("id", "ascending"), ("row", "ascending")]))
            x, edges = floors(part.column("v"), scale)
            sizes = np.diff(edges)
            full = np.zeros((len(sizes), max(1, int(sizes.max()))), np.int64)
            full[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(x)) - np.repeat(edges[:-1], sizes)] = x
            rows = pa.StructArray.from_arrays([part.column(c) for c in ("row", "id", "label")], ["row", "id", "label"])
            labels = part.column("label").to_numpy()
            out, chunks = [], -(-full.shape[1] // chunk)
            for c in range(chunks):
                tile = narrow(full[:, c * chunk : (c + 1) * chunk])
                own = pa.ListArray.from_arrays(pa.array([0, len(rows) if c == 0 else 0], pa.int32()), rows if c == 0 else rows[:0])
                whole = [(block, pa.int64()), (labels.min(), pa.int32()), (labels.max(), pa.int32()), (c, pa.int32()), (chunks, pa.int32()), (len(rows), pa.int32()), (tile.shape[1], pa.int32()), (tile.itemsize, pa.int32()), (tile.tobytes(), pa.binary())]
                out.append(pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in whole), own], ["block", "first", "last", "chunk", "chunks", "n", "width", "item", "tile", "rows"]))
            block += 1
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                take = min(batch.num_rows - start, most - sum(b.num_rows for b in held))
                held.append(batch.slice(start, take))
                start += take
                if sum(b.num_rows for b in held) == most:
                    yield cut()
        if held:
            yield cut()

    return run


def tiles(rows: DataFrame, most: int, scale: int, chunk: int = CHUNK) -> DataFrame:
    """``rows(row, id, label, v)`` in blocks of at most ``most`` rows with few labels each, cut into dimension chunks."""
    dealt = rows.repartitionByRange("label", F.xxhash64("row")).sortWithinPartitions("label", "row")
    return materialise(dealt.mapInArrow(_tiles(most, chunk, scale), _TILE), "hardneg-tiles", compression="none")


def _partial(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One anchor tile and one row tile of the same chunk: their partial scores, as 8-byte integers."""
    if not left.num_rows or not right.num_rows:
        return _EMPTY
    a, b = left.to_batches()[0], right.to_batches()[0]
    x, y = (np.frombuffer(t.column("tile")[0].as_py(), f"<i{t.column('item')[0].as_py()}").reshape(t.column("n")[0].as_py(), -1).astype(np.int64) for t in (a, b))
    wide = min(x.shape[1], y.shape[1])
    scores = products(x[:, :wide], y[:, :wide])
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.array([key[2].as_py()], pa.int32()), pa.array([scores.tobytes()], pa.binary()), a.column("rows"), b.column("rows"), a.column("positives")], schema=_EMPTY.schema)


_ROW = pa.list_(pa.struct([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int32())]))
_EMPTY = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("chunk", pa.int32()), ("scores", pa.binary()), ("anchors", _ROW), ("entries", _ROW), ("positives", pa.list_(pa.struct([("at", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])))]).empty_table()


def cells(anchors: DataFrame, entries: DataFrame, wanted: Column) -> DataFrame:
    """Partial tiles of the anchor and row blocks that ``wanted`` (over ``first``, ``last``, ``b_first``, ``b_last``) lets meet.

    The blocks' labels, one row a block, decide; tiles are then dealt by cell.
    """
    own = anchors.where("chunk = 0").select(F.col("block").alias("a"), "first", "last", F.col("chunks").alias("a_chunks"))
    others = entries.where("chunk = 0").select(F.col("block").alias("b"), F.col("first").alias("b_first"), F.col("last").alias("b_last"), F.col("chunks").alias("b_chunks"))
    # the grid: anchor blocks are columns, and every row block goes to each column where the labels let it
    columns = max(1, own.count())
    deal = F.pmod(F.xxhash64("a"), F.lit(columns))
    grid = others.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).join(own.withColumn("column", deal.cast("int")), "column").where(wanted)
    grid = grid.select("a", "b", F.explode(F.sequence(F.lit(0), F.least("a_chunks", "b_chunks") - 1)).alias("chunk"))
    left = grid.join(anchors.withColumnRenamed("block", "a"), ["a", "chunk"]).select("a", "b", "chunk", "n", "item", "tile", "rows", "positives")
    right = grid.join(entries.withColumnRenamed("block", "b"), ["b", "chunk"])
    right = right.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.col("chunk").alias("to_chunk"), "n", "item", "tile", "rows")
    return left.groupBy("a", "b", "chunk").cogroup(right.groupBy("to_a", "to_b", "to_chunk")).applyInArrow(_partial, _CELL)


def _added(parts: pa.Table) -> tuple[np.ndarray, pa.StructArray, pa.StructArray, list]:
    """The sum of a cell's partial tiles, and the anchors, rows and positives that its first one carries."""
    head = parts.filter(pc.equal(parts.column("chunk"), 0)).combine_chunks()
    anchors, entries = (head.column(c).chunk(0).flatten() for c in ("anchors", "entries"))
    total = np.zeros(len(anchors) * len(entries), np.int64)
    for piece in parts.column("scores"):
        total += np.frombuffer(piece.as_buffer(), np.int64)
    return total.reshape(len(anchors), len(entries)), anchors, entries, head.column("positives")[0].as_py() or []


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score, best first, of entries that lie in the order of ties."""
    if len(score) > 4 * k:
        few = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return few[np.argsort(-score[few], kind="stable")][:k]
    return np.argsort(-score, kind="stable")[:k]


def _positives(k: int):
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        scores, anchors, entries, _ = _added(parts)
        label, other = anchors.field("label").to_numpy(), entries.field("label").to_numpy()
        row, own = entries.field("row").to_numpy(), anchors.field("row").to_numpy()
        at, found = [], []
        for i in range(len(anchors)):
            same = np.flatnonzero((other == label[i]) & (row != own[i]))
            best = same[_first(scores[i, same], k)]
            at += [i] * len(best)
            found += best.tolist()
        take, block = pa.array(found, pa.int64()), pa.array([key[0].as_py()] * len(at), pa.int64())
        return pa.table({"a": block, "at": pa.array(at, pa.int32()), "row": entries.field("row").take(take), "id": entries.field("id").take(take), "score": pa.array(scores[at, found], pa.int64())})

    return run


def _negatives(k: int, low: int, high: int):
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        scores, anchors, entries, positives = _added(parts)
        label, other = anchors.field("label").to_numpy(), entries.field("label").to_numpy()
        by_anchor: dict[int, list] = {}
        for n, p in enumerate(positives):
            by_anchor.setdefault(p["at"], []).append((n, p["score"]))
        which, found = [], []
        for i, own in by_anchor.items():
            rest = np.flatnonzero(other != label[i])
            s = scores[i, rest]
            for n, p in own:
                # whole numbers: low * p <= 100 * s <= high * p
                inside = np.flatnonzero((s >= -(-low * p // 100)) & (s <= high * p // 100))
                best = rest[inside[_first(s[inside], k)]]
                which += [n] * len(best)
                found += best.tolist()
        take, held = pa.array(found, pa.int64()), [positives[n] for n in which]
        at = pa.array([p["at"] for p in held], pa.int64())
        return pa.table({
            "anchor_row": anchors.field("row").take(at), "anchor_id": anchors.field("id").take(at),
            "positive_row": pa.array([p["row"] for p in held], pa.int64()), "positive_id": pa.array([p["id"] for p in held], pa.int64()),
            "negative_row": entries.field("row").take(take), "negative_id": entries.field("id").take(take),
            "positive_score": pa.array([p["score"] for p in held], pa.int64()), "negative_score": pa.array(scores[at.to_numpy(), found] if found else [], pa.int64()),
        })

    return run


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is over ``id``. A negative's score lies between ``low`` and
    ``high`` hundredths of the positive's.
    """
    kept = rows.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kept = kept.where(F.col("label").isNotNull() & finite(F.col("v")))
    kept = materialise(kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v"), "hardneg-rows")
    entries = tiles(kept, ROWS, scale)
    asked = tiles(kept.where(is_anchor), ANCHORS, scale).withColumn("positives", F.lit(None).cast("array<struct<at:int,row:bigint,id:bigint,score:bigint>>"))
    ties = ["score", "id", "row"]
    order = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc(ties[0]), F.asc_nulls_last(ties[1]), ties[2])
    near = cells(asked, entries, (F.col("first") <= F.col("b_last")) & (F.col("last") >= F.col("b_first"))).groupBy("a", "b").applyInArrow(_positives(positives), "a bigint, at int, row bigint, id bigint, score bigint")
    near = near.withColumn("place", F.row_number().over(order("a", "at"))).where(F.col("place") <= positives)
    # an anchor block's positives: a few for each of its anchors
    near = near.groupBy(F.col("a").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "row", "id", "score"))).alias("positives"))
    near = materialise(near, "hardneg-positives")
    armed = asked.drop("positives").join(near.withColumn("chunk", F.lit(0)), ["block", "chunk"], "left")
    two = ~((F.col("first") == F.col("last")) & (F.col("first") == F.col("b_first")) & (F.col("first") == F.col("b_last")))
    out = "anchor_row bigint, anchor_id bigint, positive_row bigint, positive_id bigint, negative_row bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    far = cells(armed, entries, two).groupBy("a", "b").applyInArrow(_negatives(negatives, low, high), out)
    last = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    ranked = far.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id are moved on first, so that some nearest rows are of another label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 100 == 0)


ORACLE = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id, n.b) QUALIFY row_number() OVER w <= 10"""
