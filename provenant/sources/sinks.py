"""Sinks: JSON, JSON lines, key-union CSV, append logs, upserts, table sets, sealed configurations."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_union(*tables: DataFrame) -> DataFrame:
    """All rows under the union of all columns, in order of first appearance; what a row lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(path: str, *tables: DataFrame, one_file: bool = False) -> None:
    """Nested columns become JSON text."""
    df = key_union(*tables)
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes))
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Overwriting, or appending to a resume log; either way files appear whole or not at all."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """A folder of JSON lines and one of CSV for each table; empty tables too."""
    for name, df in tables.items():
        write_jsonl(df, f"{root}/{name}.jsonl")
        write_csv(f"{root}/{name}.csv", df)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows without those whose key is new, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def stable_hash(value: object, width: int = 16) -> str:
    """First hex digits of the SHA-256 of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:width]


def sealed(df: DataFrame, *columns: str, name: str = "config_hash") -> DataFrame:
    """The same over a table, column by column in sorted order."""
    text = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{c}":'), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)) for c in sorted(columns))), F.lit("}"))
    return df.withColumn(name, F.substring(F.sha2(text, 256), 1, 16))


def remapped(path, marker: str, root: str):
    """A path with everything before ``marker`` replaced by ``root``; unchanged without the marker."""
    return F.when(path.contains(marker), F.concat(F.lit(root.rstrip("/") + "/" + marker), F.substring_index(path, marker, -1))).otherwise(path)
