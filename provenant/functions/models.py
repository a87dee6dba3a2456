"""Where models plug in: typed interfaces as Arrow functions, deterministic stand-ins, and a factory.

A model is a plain callable over a list; the adapters turn it into a column
function that loads it once a task. Failures become an error column, never a
lost row. Real encoders, OCR, editors and remote endpoints are the caller's.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as T

ENCODER, OCR, MASKS, ANSWER, EDITOR = "encoder", "ocr", "masks", "answer", "editor"
_BOX = pa.struct([(n, pa.int32()) for n in ("x1", "y1", "x2", "y2")])
_KINDS = {
    ENCODER: ("array<float>", pa.list_(pa.float32())),
    OCR: ("array<struct<text:string,confidence:double,bbox:struct<x1:int,y1:int,x2:int,y2:int>>>", pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", _BOX)]))),
    MASKS: ("array<struct<area:int,bbox:struct<x1:int,y1:int,x2:int,y2:int>>>", pa.list_(pa.struct([("area", pa.int32()), ("bbox", _BOX)]))),
    ANSWER: ("string", pa.string()),
    EDITOR: ("struct<image:binary,metrics:map<string,double>>", pa.struct([("image", pa.binary()), ("metrics", pa.map_(pa.string(), pa.float64()))])),
}


def column(kind: str, make: Callable[[], Callable[[list], list]], *inputs: Column) -> Column:
    """``struct<value, error>`` of a model of one of the kinds; ``make`` runs once a task.

    A batch that fails is tried row by row, so an error belongs to one row.
    """
    sql, arrow = _KINDS[kind]

    @F.arrow_udf(f"struct<value:{sql},error:string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for part in parts:
            rows = part.to_pylist()
            try:
                values, errors = list(model(rows)), [None] * len(rows)
            except Exception:  # noqa: BLE001  models may raise anything
                values, errors = [], []
                for row in rows:
                    try:
                        values.append(model([row])[0])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        values.append(None)
                        errors.append(str(e))
            yield pa.StructArray.from_arrays([pa.array(values, arrow), pa.array(errors, pa.string())], ["value", "error"])

    return run(F.struct(*inputs) if len(inputs) != 1 else inputs[0])


def with_retries(call: Callable, attempts: int = 4, first_wait: float = 1.0) -> Callable:
    """The call with exponential back-off."""
    def run(*args):
        for i in range(attempts):
            try:
                return call(*args)
            except Exception:  # noqa: BLE001
                if i + 1 == attempts:
                    raise
                time.sleep(first_wait * 2**i)
    return run


# --- deterministic stand-ins ----------------------------------------------------------------------------------------------


def hashed_text_encoder(dimension: int = 64) -> Callable[[list], list]:
    """Unit vectors seeded by each text's SHA-256."""
    def encode(texts: list) -> list:
        out = []
        for t in texts:
            v = np.random.default_rng(int(hashlib.sha256((t or "").encode()).hexdigest()[:16], 16)).normal(size=dimension)
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out
    return encode


#: Colours that the local encoder knows.
PALETTE = {"red": (0.86, 0.16, 0.16), "green": (0.18, 0.63, 0.29), "blue": (0.16, 0.35, 0.82), "yellow": (0.93, 0.79, 0.16), "purple": (0.51, 0.22, 0.67), "orange": (0.94, 0.49, 0.12), "white": (0.94, 0.94, 0.94), "black": (0.08, 0.08, 0.08)}


def colour_encoding(text: Column) -> Column:
    """The first palette colour that a text names, as three channels; grey if none."""
    out = F.array(*(F.lit(0.2),) * 3)
    for name, rgb in reversed(PALETTE.items()):
        out = F.when(F.lower(text).contains(name), F.array(*map(F.lit, rgb))).otherwise(out)
    return out


def grid_masks(images: DataFrame, n: int = 4) -> DataFrame:
    """(image columns, mask_id, bbox, area): an n x n grid of boxes for each ``width`` and ``height``."""
    cells = images.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))).withColumn("__r", F.floor(F.col("__c") / n).cast("int")).withColumn("__k", F.col("__c") % n)
    edge = lambda size, i: F.floor(F.col(size) * i / n).cast("int")
    box = F.struct(edge("width", F.col("__k")).alias("x1"), edge("height", F.col("__r")).alias("y1"), edge("width", F.col("__k") + 1).alias("x2"), edge("height", F.col("__r") + 1).alias("y2"))
    return cells.withColumn("bbox", box).withColumn("area", (F.col("bbox.x2") - F.col("bbox.x1")) * (F.col("bbox.y2") - F.col("bbox.y1"))).withColumn("mask_id", F.col("__c") + 1).drop("__c", "__r", "__k")


def heuristic_answer(hits: Column) -> Column:
    """The answer of a generator that only reads marks: the first hit's signature, else that nothing is visible."""
    found = F.filter(hits, lambda h: h["signature"].isNotNull())
    return F.when(F.size(found) > 0, F.concat(F.lit("The visible text is "), found[0]["signature"], F.lit("."))).otherwise("No matching text is visible.")


def simulated_response(mode: Column, in_topk: Column, signature: Column, color: Column, object_class: Column, position: Column) -> Column:
    """What an answerer that sees the target would say; that it sees nothing otherwise."""
    b = F.concat(F.lit("A "), color, F.lit(" "), object_class, F.lit(" is visible at the "), position, F.lit("."))
    return F.when(~in_topk, "NONE. The requested item is not visible.").when(mode == "mode_b", b).otherwise(F.concat(F.lit("The visible text is "), signature, F.lit(".")))


class Registry:
    """Factories by name; an unknown name is an error, and :meth:`skipped` turns failures into rows."""

    def __init__(self) -> None:
        self.makers: dict[str, Callable] = {}

    def register(self, name: str, make: Callable) -> None:
        self.makers[name] = make

    def build(self, name: str, **options):
        if name not in self.makers:
            raise ValueError(f"unknown backend {name!r}; known: {sorted(self.makers)}")
        return self.makers[name](**options)

    def build_all(self, spark, wanted: dict[str, dict]) -> tuple[dict, DataFrame]:
        """What could be built, and (name, reason) of what could not."""
        built, skipped = {}, []
        for name, options in wanted.items():
            try:
                built[name] = self.build(name, **options)
            except Exception as e:  # noqa: BLE001
                skipped.append((name, str(e)))
        return built, spark.createDataFrame(skipped, "name string, reason string")


REGISTRY = Registry()
REGISTRY.register("hashed_text", hashed_text_encoder)


def prompt(parts: list[Column], sep: str = "\n") -> Column:
    return F.concat_ws(sep, *parts)


def retrieved_context(hits: Column, width: int = 400) -> Column:
    """One numbered line a hit."""
    return F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(F.coalesce(h["text"], F.lit("")), 1, width))), "\n")
