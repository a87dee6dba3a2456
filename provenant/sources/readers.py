"""Sources: records, manifests, corpora, JSON lines, CSV metadata, matrices, image trees, shards, configurations.

Paths are anything Spark reads. Missing inputs that count as empty give an
empty table with the given schema. Reading is distributed; only configuration
files and NumPy headers are read on the driver.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import text as T

IMAGE_PATTERN = "*.{jpg,jpeg,png,webp,bmp,ppm,JPG,JPEG,PNG,WEBP,BMP,PPM}"
_BOX = "array<int>"
RECORD_SCHEMA = (
    "id string, anchor_image_path string, watermarked_image_path string, comparison_image_path string, cluster_id int, isolation_score double, selected_box_id int,"
    f" selected_canvas struct<id:int,mode:string,bbox:{_BOX},score:double,text:string,source:string>, parasitism_mode string, trigger_prompt string, trap_signature string,"
    " probe_queries array<string>, scene_caption string,"
    f" nontext_plan struct<object_class:string,color:string,surface:string,position_region:string,bbox:{_BOX},bbox_repaired:boolean,placement_notes:string,naturalness_rationale:string>,"
    " injection_metrics map<string,string>"
)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, length, modificationTime[, content]) of every image below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_PATTERN).load(root)
    return df if content else df.drop("content")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; a missing file is empty, blank lines are skipped, malformed ones fail or are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """A file that is one JSON array of objects."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def resolve(path: str, roots: list[str], there: Callable[[str], bool]) -> str:
    """An absolute path as it is; else under the first root where it exists, or under the first."""
    if "://" in path or path.startswith("/") or not roots:
        return path
    options = [f"{r.rstrip('/')}/{path}" for r in dict.fromkeys(roots)]
    return next((p for p in options if there(p)), options[0])


def resolved(rows: DataFrame, path: Column, roots: list[str], files: DataFrame, name: str) -> DataFrame:
    """The same over a table: ``files(path)`` lists what exists, and one join looks all candidates up."""
    roots = list(dict.fromkeys(r.rstrip("/") for r in roots))
    options = F.when(path.startswith("/") | path.contains("://"), F.array(path)).otherwise(F.array(*(F.concat(F.lit(r + "/"), path) for r in roots)))
    keyed = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__options", options)
    found = keyed.select("__row", F.posexplode("__options").alias("__i", "__path")).join(files.select(F.col("path").alias("__path")).distinct(), "__path", "left_semi")
    first = found.groupBy("__row").agg(F.min_by("__path", "__i").alias("__found"))
    return keyed.join(first, "__row", "left").withColumn(name, F.coalesce("__found", F.get("__options", F.lit(0)))).withColumn(f"{name}_exists", F.col("__found").isNotNull()).drop("__row", "__options", "__found")


def records(spark: SparkSession, path: str, roots: list[str] = (), files: DataFrame | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Canary records with their mode; with ``files`` only those whose edited image exists, paths resolved; the first ``limit`` by ``order``."""
    df = json_array(spark, path, RECORD_SCHEMA)
    df = df.withColumn("record_mode", T.record_mode(F.col("id"), F.col("parasitism_mode"), F.col("selected_canvas.mode")))
    if files is not None:
        df = resolved(df, F.col("watermarked_image_path"), list(roots), files, "resolved_path").where("resolved_path_exists").drop("resolved_path_exists")
    return df if limit is None else df.orderBy(order).limit(limit)


def manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(image_id, image_path, metadata) of a JSON, JSON-lines or CSV manifest.

    A JSON file is a list or has one under ``data`` or ``items``. The path is the
    first of image_path, path, image, file_name; the id that of id, image_id, the
    path's stem.
    """
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.option("multiLine", not path.endswith(".jsonl")).json(path)
        for wrap in ("data", "items"):
            if raw.columns == [wrap] and raw.schema[wrap].dataType.typeName() == "array":
                raw = raw.select(F.inline(wrap))
                break
    first = lambda *names: F.coalesce(F.lit(None).cast("string"), *(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in raw.columns))
    image_path = first("image_path", "path", "image", "file_name")
    stem = F.regexp_replace(F.element_at(F.split(image_path, "/"), -1), r"\.[^.]*$", "")
    rest = F.map_from_arrays(F.array(*map(F.lit, raw.columns)), F.array(*(F.col(c).cast("string") if raw.schema[c].dataType.typeName() != "struct" else F.to_json(c) for c in raw.columns)))
    out = raw.select(F.coalesce(first("id", "image_id"), stem).alias("image_id"), image_path.alias("image_path"), rest.alias("metadata"))
    return out if limit is None else out.orderBy("image_id").limit(limit)


def corpus(spark: SparkSession, folder: str | None = None, manifest_path: str | None = None, limit: int | None = None) -> DataFrame:
    """(image_id, image_path): a manifest's, or a folder's images by path; an empty corpus is an error."""
    if manifest_path:
        df = manifest(spark, manifest_path, limit).select("image_id", "image_path")
    else:
        df = images(spark, folder).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("image_id"), F.col("path").alias("image_path"))
        df = df if limit is None else df.orderBy("image_path").limit(limit)
    if df.isEmpty():
        raise ValueError("the corpus is empty")
    return df


def download_candidates(spark: SparkSession, path: str, limit: int, seed: int = 0) -> DataFrame:
    """(image_id, url) of a metadata CSV: thumbnail URL, else the original; shuffled by a keyed hash."""
    raw = spark.read.option("header", True).csv(path)
    url = F.coalesce(F.nullif("Thumbnail300KURL", F.lit("")), F.nullif("OriginalURL", F.lit("")))
    return raw.select(F.col("ImageID").alias("image_id"), url.alias("url")).where("url IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), "image_id"), "image_id").limit(limit)


def fetched(rows: DataFrame, get: Callable[[str], bytes], concurrency: int = 16) -> DataFrame:
    """(image_id, content, error) by ``get(url)``, several at a time within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(url: str):
            try:
                return get(url), None
            except Exception as e:  # noqa: BLE001
                return None, str(e)

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                found = list(pool.map(one, batch.column("url").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], ["image_id", "content", "error"])

    return rows.select("image_id", "url").mapInArrow(run, "image_id string, content binary, error string")


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids that a fetch log marks as ok."""
    return jsonl(spark, path, "image_id string, ok boolean").where("ok AND image_id IS NOT NULL").select("image_id").distinct()


def matrix(spark: SparkSession, path: str, rows: int = 65_536) -> DataFrame:
    """(row, v) of a two-dimensional .npy file on storage that all executors see, in slices of ``rows`` rows."""
    shape = np.load(path, mmap_mode="r").shape
    parts = spark.range(-(-shape[0] // rows), numPartitions=max(1, -(-shape[0] // rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.load(path, mmap_mode="r")
        for batch in batches:
            for part in batch.column(0).to_pylist():
                x = np.asarray(data[part * rows : (part + 1) * rows], np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part * rows, part * rows + len(x))), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))], ["row", "v"])

    return parts.mapInArrow(run, "row bigint, v array<float>")


def shards(spark: SparkSession, root: str, schema: str, pattern: str = "shard_*") -> DataFrame:
    """All JSON-lines shards below a folder, with the number in their name."""
    return spark.read.schema(schema).json(f"{root}/{pattern}").withColumn("shard", F.regexp_extract(F.input_file_name(), r"shard_(\d+)", 1).cast("int"))


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` on ``base``, table by table; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def config(path: str, defaults: dict) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return deep_merge(defaults, yaml.safe_load(f) or {})
