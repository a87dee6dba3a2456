"""NumPy matrices as a Spark source: ``spark.read.format("npy").load(uri)``.

A path is one ``.npy`` file, a folder, or a folder with a pattern in its last
part (``shard_*/emb_*.npy`` is found by walking). It may be any URI that Arrow's
file systems open (``file``, ``hdfs``, ``s3``, ``gs``), so driver and executors
need no common mount. Headers alone are read while planning; each partition then
reads its own range of bytes and sends Arrow batches.

Rows are ``file, shard, row, v``: the file's name below the path, the number in
its first ``shard_N`` part (null without one), the row's place in its file, and
its values. Options: ``rows`` a partition (65,536), ``columns`` to keep, as
``start:stop`` (all), ``missing``: ``error`` (default) or ``empty``.

Defined results: a folder without such files and a matrix without rows give no
rows; a missing path is an error or empty, as asked; one-dimensional arrays are
rows of one value; a file that is cut short, of another format, in Fortran
order or not numeric is an error that names it.
"""

from __future__ import annotations

import ast
import fnmatch
import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, shard int, row bigint, v array<double>"
BATCH = 4096


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it; names may hold blanks and signs, as Spark's do."""
    return arrow_fs.FileSystem.from_uri(quote(uri, safe=":/@?&=") if "://" in uri else uri)


def header(files: arrow_fs.FileSystem, path: str) -> tuple[np.dtype, int, int, int]:
    """(type, rows, columns, first byte of the data), checked against the file's size."""
    with files.open_input_file(path) as f:
        start = f.read(12)
        if start[:6] != b"\x93NUMPY" or len(start) < 12:
            raise ValueError(f"{path} is not a NumPy file")
        wide = start[6] >= 2
        size = int.from_bytes(start[8:12] if wide else start[8:10], "little")
        first = (12 if wide else 10) + size
        f.seek(12 if wide else 10)
        text = f.read(size)
        if len(text) < size:
            raise ValueError(f"{path} is cut short: its header ends early")
        held = ast.literal_eval(text.decode("latin-1"))
        kind, shape = np.dtype(held["descr"]), held["shape"]
        if kind.kind not in "fiub" or held["fortran_order"] or not 1 <= len(shape) <= 2:
            raise ValueError(f"{path} holds {kind} of shape {shape}; only numbers in rows can be read")
        rows, columns = shape[0], shape[1] if len(shape) == 2 else 1
        if f.size() < first + rows * columns * kind.itemsize:
            raise ValueError(f"{path} is cut short: {f.size()} bytes of {first + rows * columns * kind.itemsize}")
    return kind, rows, columns, first


class Part(InputPartition):
    def __init__(self, path: str, name: str, kind: str, start: int, stop: int, columns: int, first: int):
        self.path, self.name, self.kind, self.start, self.stop, self.columns, self.first = path, name, kind, start, stop, columns, first


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.rows = int(options.get("rows", 65_536))
        low, _, high = options.get("columns", ":").partition(":")
        self.keep = slice(int(low or 0), int(high) if high else None)
        self.missing = options.get("missing", "error")

    def _files(self) -> tuple[arrow_fs.FileSystem, list[tuple[str, str]]]:
        uri, _, pattern = self.uri.partition("*")
        if pattern or "*" in self.uri:
            # the folder above the first part with a pattern
            uri, tail = uri.rsplit("/", 1)
            pattern = f"{tail}*{pattern}"
        files, root = opened(uri)
        found = files.get_file_info(root)
        if found.type == arrow_fs.FileType.NotFound:
            if self.missing == "empty":
                return files, []
            raise FileNotFoundError(f"no such file or folder: {self.uri}")
        if found.type == arrow_fs.FileType.File:
            return files, [(root, root.rsplit("/", 1)[-1])]
        below = files.get_file_info(arrow_fs.FileSelector(root, recursive=True))
        names = sorted((i.path, i.path[len(root.rstrip("/")) + 1 :]) for i in below if i.type == arrow_fs.FileType.File and i.path.endswith(".npy"))
        return files, [(p, n) for p, n in names if not pattern or fnmatch.fnmatchcase(n, pattern)]

    def partitions(self) -> list[Part]:
        files, found = self._files()
        out = []
        for path, name in found:
            kind, rows, columns, first = header(files, path)
            out += [Part(path, name, kind.str, at, min(rows, at + self.rows), columns, first) for at in range(0, rows, self.rows)]
        return out or [Part("", "", "<f8", 0, 0, 1, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        files, _ = opened(self.uri.partition("*")[0])
        kind, shard = np.dtype(part.kind), re.search(r"(?:^|/)shard_(\d+)", part.name)
        with files.open_input_file(part.path) as f:
            for at in range(part.start, part.stop, BATCH):
                n = min(BATCH, part.stop - at)
                f.seek(part.first + at * part.columns * kind.itemsize)
                raw = f.read(n * part.columns * kind.itemsize)
                if len(raw) < n * part.columns * kind.itemsize:
                    raise ValueError(f"{part.path} is cut short while being read")
                x = np.ascontiguousarray(np.frombuffer(raw, kind).reshape(n, part.columns)[:, self.keep], np.float64)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1])
                columns = [pa.array([part.name] * n), pa.array([int(shard[1]) if shard else None] * n, pa.int32()), pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "shard", "row", "v"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options))


def matrices(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The source registered and read in one call."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").options(**{k: str(v) for k, v in options.items()}).load(path)
