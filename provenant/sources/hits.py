"""Top-k hits with their files: copies made on the executors, checked, once each, and paths rewritten."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators.relational import scratch
from provenant.sources.npy import opened

CHUNK = 1 << 22
_COPY = "source string, target string, bytes bigint, sha256 string, error string"


def _digest(files: arrow_fs.FileSystem, path: str, out=None) -> tuple[int, str]:
    """Size and SHA-256 of a file; its bytes also go to ``out``."""
    h, n = hashlib.sha256(), 0
    with files.open_input_stream(path) as f:
        while data := f.read(CHUNK):
            h.update(data)
            n += len(data)
            if out is not None:
                out.write(data)
    return n, h.hexdigest()


def _copy(source: str, target: str) -> tuple[int, str]:
    """Copy under another name, read the copy back, and move it into place if it is whole."""
    here, path = opened(source)
    there, place = opened(target)
    if here.get_file_info(path).type != arrow_fs.FileType.File:
        raise FileNotFoundError(source)
    if there.get_file_info(place).type == arrow_fs.FileType.File:
        held, wanted = _digest(there, place), _digest(here, path)
        if held == wanted:
            return held
    there.create_dir(os.path.dirname(place), recursive=True)
    part = f"{os.path.dirname(place)}/.{uuid.uuid4().hex}.part"
    try:
        with there.open_output_stream(part) as out:
            read = _digest(here, path, out)
        if _digest(there, part) != read:
            raise OSError(f"the copy of {source} differs from it")
        there.move(part, place)
    except BaseException:
        if there.get_file_info(part).type == arrow_fs.FileType.File:
            there.delete_file(part)
        raise
    return read


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for source, target in zip(*(batch.column(c).to_pylist() for c in ("source", "target")), strict=True):
            try:
                rows.append((source, target, *_copy(source, target), None))
            except OSError as e:
                rows.append((source, target, None, None, f"{type(e).__name__}: {e}"))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["source", "target", "bytes", "sha256", "error"])


def materialised_hits(hits: DataFrame, root: str, path: str = "image_path", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits with ``path`` rewritten and ``source_image_path``, the copies made).

    Every distinct file is copied once to ``<root>/hit_images/``, whatever number
    of hits name it, under a name made from its own and its path's hash, so files
    of one name do not meet. A copy is written under another name, checked and
    moved into place, so a task that runs again, or twice at once, leaves one
    whole file; one that is there already and equal is left alone. Paths are URIs
    that Arrow's file systems open. Missing files are an error, or null paths
    with their ``error`` if not ``strict``; null paths stay null.
    """
    name = F.regexp_replace(F.substring(F.element_at(F.split(path, "/"), -1), -80, 80), "[^A-Za-z0-9._-]", "_")
    target = F.concat(F.lit(f"{root.rstrip('/')}/hit_images/"), F.substring(F.sha2(path, 256), 1, 16), F.lit("_"), name)
    wanted = hits.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("source")).agg(F.first(target).alias("target"))
    made = scratch(wanted.mapInArrow(_copies, _COPY), "copies")
    if strict and (bad := made.where("error IS NOT NULL").orderBy("source").first()):
        raise FileNotFoundError(f"{made.where('error IS NOT NULL').count()} hit files cannot be copied; the first: {bad.error}")
    own = made.select(F.col("source").alias("source_image_path"), F.when(F.col("error").isNull(), F.col("target")).alias("copied"), "error")
    out = hits.withColumnRenamed(path, "source_image_path").join(own, "source_image_path", "left").withColumn(path, F.col("copied")).drop("copied")
    return (out.drop("error") if strict else out), made
