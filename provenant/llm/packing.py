"""Sum-of-squares packing of token ids into windows of a fixed size.

Documents are cut only where they are longer than a window: every full window of
theirs is a sequence of its own, and the rest is an item. Each task places its
items one after another, online: of all levels that have an open window with
room, and of a new window, the one that makes the sum over levels of the squared
number of open windows least (ties: the fullest). Two arrays over the levels are
all that decides, so a task holds its open windows and nothing of its items.

A task's windows that are still open at its end are items themselves: a share of
them, ``CLOSING`` at most, goes to one of several closing tasks, whose number
grows with theirs. It merges them by the same rule, then takes the emptiest ones
apart to fill the others' gaps exactly, cutting a document where a gap ends. What
remains, less than a window, becomes sequences of a power of two. So no sequence
is padded, and only documents of such last windows are cut (1 or 2 in a hundred).

Ids are encoded once and written; placing reads counts and checksums only, and
ids are read again for cut pieces alone.

Defined results: null and empty texts are their end id alone; repeated rows and
null ids are documents of their own; an empty table gives no pieces. A
document's pieces are numbered by ``key``, which tells equal rows apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import documents, materialise
from provenant.llm.tokenstore import VOCABULARY, encoder_of, strings

CAPACITY = 2048
END = 1
CLOSING = 4096  # open windows that one closing task takes
HELD = 1 << 21  # ids encoded before they are handed on
KEYS = 1 << 20  # cut documents up to which their keys are broadcast, 8 bytes each

_IDS = "key bigint, doc_id bigint, n bigint, crcs array<bigint>, ids binary"
_PLACED = "key bigint, doc_id bigint, n bigint, start bigint, length bigint, crc bigint, sequence bigint, offset bigint, level int"


class Levels:
    """Open windows by how full they are; ``place`` picks one by the sum of squares."""

    def __init__(self, capacity: int):
        # both run from the full window down, so that the first least cost is the fullest level's
        self.capacity, self.open = capacity, [[] for _ in range(capacity)]
        self.enter = np.zeros(capacity + 1, np.int64)  # twice the number of windows at a level; a full one counts nowhere
        self.leave = np.full(capacity + 1, -(1 << 40))  # the same; levels without a window are out of reach
        self.enter[0], self.leave[capacity] = -1, 1

    def _count(self, level: int) -> None:
        n = 2 * len(self.open[level])
        self.enter[self.capacity - level], self.leave[self.capacity - level] = n, n or -(1 << 40)

    def place(self, size: int, new: int) -> tuple[int, int]:
        """(window, level before); ``new`` is the window opened if that is best."""
        cost = self.enter[: self.capacity - size + 1] - self.leave[size:]
        level = self.capacity - size - int(cost.argmin())
        window = self.open[level].pop() if level else new
        if level:
            self._count(level)
        if level + size < self.capacity:
            self.open[level + size].append(window)
            self._count(level + size)
        return window, level

    def rest(self) -> list[tuple[int, int]]:
        """(window, level) of all open windows, fullest first."""
        return [(w, level) for level in range(self.capacity - 1, 0, -1) for w in self.open[level]]


def _encode(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key = encoder_of(path), TaskContext.get().partitionId() << 33
        kind, tail = "<u2" if encoder.size <= 1 << 16 and end < 1 << 16 else "<u4", np.array([end], np.uint32)
        for batch in batches:
            first, held, sizes, crcs, data = 0, 0, [], [], []

            def part() -> pa.RecordBatch:
                ends = pa.array(np.cumsum([0, *map(len, crcs)]).astype(np.int32))  # noqa: B023
                own = [pa.array(np.arange(key, key + len(sizes))), batch.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64())]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(ends, pa.array([c for x in crcs for c in x], pa.int64())), pa.array(data, pa.binary())], ["key", "doc_id", "n", "crcs", "ids"])  # noqa: B023

            for ids in encoder.streams(strings(batch.column(1))):
                ids = np.concatenate((ids, tail))
                wide = memoryview(ids.astype("<u4")).cast("B")
                sizes.append(len(ids))
                crcs.append([zlib.crc32(wide[at : at + 4 * capacity]) for at in range(0, len(wide), 4 * capacity)])
                data.append(ids.astype(kind).tobytes())
                held += len(ids)
                if held >= HELD:
                    yield part()
                    key, first, held, sizes, crcs, data = key + len(sizes), first + len(sizes), 0, [], [], []
            if sizes:
                yield part()
                key += len(sizes)

    return run


def encoded(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(key, doc_id, n, crcs, ids) of each document, written to the shared folder.

    ``ids`` are little-endian, of 2 bytes where the vocabulary fits, else 4;
    ``crcs`` are the checksums, as 4-byte ids, of its runs of ``capacity``.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(vocabulary, end, capacity), _IDS)
    return materialise(rows, "packing-ids", compression="zstd")


def _place(capacity: int):
    """Documents to placed pieces; at the end, a row with its ``level`` for each window still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, new = Levels(capacity), TaskContext.get().partitionId() << 36
        for batch in batches:
            n = batch.column("n").to_numpy()
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * capacity
            length = np.minimum(n[row] - start, capacity)
            sequence, offset = new + np.arange(len(row)), np.zeros(len(row), np.int64)
            new += len(row)
            for i in np.flatnonzero(length < capacity).tolist():
                sequence[i], offset[i] = levels.place(int(length[i]), int(sequence[i]))
            take = pa.array(row)
            crc = batch.column("crcs").flatten()
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("key", "doc_id", "n")), *map(pa.array, (start, length)), crc, *map(pa.array, (sequence, offset)), pa.nulls(len(row), pa.int32())], _COLUMNS)
        rest = levels.rest()
        if rest:
            window, level = (np.array(x) for x in zip(*rest, strict=True))
            none = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays([*[none] * 6, pa.array(window), none, pa.array(level.astype(np.int32))], _COLUMNS)

    return run


_COLUMNS = [c.split()[0] for c in _PLACED.split(", ")]


def moves(windows: list[tuple[int, int]], capacity: int, new: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(window, first, length, sequence, offset): where the runs of open windows' ids go.

    Windows are merged by the sum of squares, fullest first. The emptiest
    merged ones are then cut to fill the gaps of as many as can be filled, and
    what is left makes sequences of a power of two. A window that keeps its
    ids where they are is not named.
    """
    levels, held = Levels(capacity), {}
    for window, size in sorted(windows, key=lambda w: (-w[1], w[0])):
        at, level = levels.place(size, window)
        held.setdefault(at, []).append((window, size, level))
    for at, own in held.items():
        yield from ((window, 0, size, at, level) for window, size, level in own if window != at)
    rest = levels.rest()
    full = sum(level for _, level in rest) // capacity
    gaps = [(at, level, capacity - level) for at, level in rest[:full]]
    left = sum(level for _, level in rest) - full * capacity
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            gaps.append((new, 0, 1 << bit))
            new += 1
    # the ids of the windows taken apart, run by run, into the gaps in turn
    g = 0
    for at, _ in rest[full:]:
        for window, size, _ in held[at]:
            first = 0
            while first < size:
                sequence, offset, room = gaps[g]
                run = min(room, size - first)
                # a window merged into one that is now taken apart is named by this last move alone
                yield -1 - window if window != at else window, first, run, sequence, offset
                first, gaps[g] = first + run, (sequence, offset + run, room - run)
                g += room == run


def _close(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = [x for batch in batches for x in zip(batch.column("sequence").to_pylist(), batch.column("level").to_pylist(), strict=True)]
        found = list(moves(windows, capacity, 1 << 62 | TaskContext.get().partitionId() << 36))
        again = {-1 - m[0] for m in found if m[0] < 0}
        found = [(-1 - m[0], *m[1:]) if m[0] < 0 else m for m in found if m[0] < 0 or m[0] not in again]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["sequence", "first", "run", "to", "at"])

    return run


def pack(ids: DataFrame, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """(key, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of :func:`encoded` documents."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    placed = materialise(ids.select("key", "doc_id", "n", "crcs").mapInArrow(_place(capacity), _PLACED), "packing-placed")
    rest = placed.where("level IS NOT NULL").select("sequence", "level")
    tasks = max(1, -(-rest.count() // closing))
    moved = rest.repartition(tasks, "sequence").mapInArrow(_close(capacity), "sequence bigint, first bigint, run bigint, to bigint, at bigint")
    moved = materialise(moved, "packing-moved")
    pieces = placed.where("level IS NULL").drop("level").join(moved, "sequence", "left").where("to IS NULL OR (offset < first + run AND first < offset + length)")
    # what of the piece lies in the run
    skip = F.greatest(F.lit(0), F.col("first") - F.col("offset"))
    size = F.least(F.col("offset") + F.col("length"), F.col("first") + F.col("run")) - F.greatest("offset", "first")
    stays = F.col("to").isNull()
    pieces = pieces.select(
        "key", "doc_id", F.when(stays, F.col("start")).otherwise(F.col("start") + skip).alias("start"), F.when(stays, F.col("length")).otherwise(size).alias("length"),
        F.when(stays | (size == F.col("length")), F.col("crc")).alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        F.when(stays, F.col("sequence")).otherwise(F.col("to")).alias("sequence_id"), F.when(stays, F.col("offset")).otherwise(F.col("at") + F.greatest("offset", "first") - F.col("first")).alias("offset"),
    )
    pieces = materialise(pieces, "packing-pieces")
    cut = pieces.where("ids_crc32 IS NULL")
    keys = cut.select("key").distinct()
    few = ids.select("key", "ids").join(F.broadcast(keys) if keys.count() <= KEYS else keys, "key", "left_semi")
    summed = cut.drop("ids_crc32").join(few, "key").withColumn("ids_crc32", F.crc32(wide("start", "length")))
    return pieces.where("ids_crc32 IS NOT NULL").unionByName(summed.select(*pieces.columns))


def wide(start: str, length: str):
    """The ids of a piece as little-endian 4-byte integers."""

    @F.arrow_udf("binary")
    def of(ids: pa.Array, n: pa.Array, start: pa.Array, length: pa.Array) -> pa.Array:
        out = []
        for data, total, at, size in zip(ids, n.to_pylist(), start.to_pylist(), length.to_pylist(), strict=True):
            held = data.as_buffer()
            item = held.size // total
            out.append(np.frombuffer(held, f"<u{item}", size, at * item).astype("<u4").tobytes())
        return pa.array(out, pa.binary())

    return of("ids", "doc_tokens", start, length)


def sequences(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>): what a trainer reads, each sequence's pieces in order."""
    runs = pieces.join(ids.select("key", "ids"), "key").select("sequence_id", "offset", wide("start", "length").alias("run"))

    @F.arrow_udf("array<int>")
    def joined(parts: pa.Array) -> pa.Array:
        return pa.array([np.concatenate([np.frombuffer(p, "<u4") for p in row]).astype(np.int32) for row in parts.to_pylist()], pa.list_(pa.int32()))

    # a sequence has as many pieces as ids at most
    held = runs.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "run"))).alias("p"))
    return held.select("sequence_id", joined(F.transform("p", lambda p: p["run"])).alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(encoded(documents(spark, sf_dir))).drop("key")
