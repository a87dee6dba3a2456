"""Image transforms over raw pixels: ``struct<width int, height int, pixels binary>``, RGB, row by row.

NumPy in Arrow batches; a row is one image. Formats with codecs (JPEG) need a
library that is not part of this package: :func:`jpeg` is its interface.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<width:int,height:int,pixels:binary>"


def mapped(change: Callable[[np.ndarray, int], np.ndarray], image: Column, key: Column | None = None) -> Column:
    """Apply ``change(pixels, key)`` to each image; null images stay null."""

    @F.arrow_udf(IMAGE)
    def run(images: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for image, k in zip(images.to_pylist(), keys.to_pylist(), strict=True):
            if image is None or image["pixels"] is None:
                out.append(None)
                continue
            x = np.frombuffer(image["pixels"], np.uint8).reshape(image["height"], image["width"], 3)
            y = np.clip(np.rint(change(x.astype(np.float64), k)), 0, 255).astype(np.uint8)
            out.append({"width": y.shape[1], "height": y.shape[0], "pixels": y.tobytes()})
        return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    return run(image, F.lit(0).cast("bigint") if key is None else key.cast("bigint"))


def resized(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    for axis, n in ((0, height), (1, width)):
        at = np.clip((np.arange(n) + 0.5) * x.shape[axis] / n - 0.5, 0, x.shape[axis] - 1)
        low = np.floor(at).astype(int)
        high, share = np.minimum(low + 1, x.shape[axis] - 1), at - low
        share = share.reshape([-1 if i == axis else 1 for i in range(3)])
        x = np.take(x, low, axis) * (1 - share) + np.take(x, high, axis) * share
    return x


def rescale(image: Column, scale: float) -> Column:
    """Down and up again."""
    def change(x: np.ndarray, _: int) -> np.ndarray:
        h, w = x.shape[:2]
        return resized(np.rint(resized(x, max(1, round(w * scale)), max(1, round(h * scale)))), w, h)

    return mapped(change, image)


def gaussian_noise(image: Column, sigma: float, key: Column, seed: int = 0) -> Column:
    return mapped(lambda x, k: x + np.random.default_rng([seed, k & 0xFFFFFFFF]).normal(0, sigma, x.shape), image, key)


def center_crop(image: Column, share: float) -> Column:
    """Cut ``share`` of each side's length away, half at either end, and stretch back."""
    def change(x: np.ndarray, _: int) -> np.ndarray:
        h, w = x.shape[:2]
        dy, dx = round(h * share / 2), round(w * share / 2)
        return resized(x[dy : h - dy, dx : w - dx], w, h)

    return mapped(change, image)


def perturbation(image: Column, epsilon: float, key: Column, seed: int = 0) -> Column:
    """Each pixel moved by at most ``epsilon`` in a random direction."""
    return mapped(lambda x, k: x + epsilon * np.random.default_rng([seed, k & 0xFFFFFFFF]).choice([-1.0, 1.0], x.shape), image, key)


def regions(kind: str, image: Column, boxes: Column, radius: int = 4) -> Column:
    """``blur`` or ``fill`` (with the median colour) inside ``array<struct<x1,y1,x2,y2>>``."""

    @F.arrow_udf(IMAGE)
    def run(images: pa.Array, boxes: pa.Array) -> pa.Array:
        out = []
        for image, found in zip(images.to_pylist(), boxes.to_pylist(), strict=True):
            if image is None:
                out.append(None)
                continue
            x = np.frombuffer(image["pixels"], np.uint8).reshape(image["height"], image["width"], 3).copy()
            for b in found or []:
                part = x[b["y1"] : b["y2"], b["x1"] : b["x2"]]
                if part.size:
                    part[:] = np.median(part.reshape(-1, 3), axis=0) if kind == "fill" else _box_blur(part, radius)
            out.append(image | {"pixels": x.tobytes()})
        return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    return run(image, boxes)


def _box_blur(x: np.ndarray, radius: int) -> np.ndarray:
    x = x.astype(np.float64)
    for axis in (0, 1):
        n = x.shape[axis]
        sums = np.concatenate((np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis)), axis)
        low, high = np.clip(np.arange(n) - radius, 0, n), np.clip(np.arange(n) + radius + 1, 0, n)
        count = (high - low).reshape([-1 if i == axis else 1 for i in range(3)])
        x = (np.take(sums, high, axis) - np.take(sums, low, axis)) / count
    return np.rint(x).astype(np.uint8)


def jpeg(image: Column, quality: int, codec: Callable[[np.ndarray, int], np.ndarray]) -> Column:
    """Through a JPEG codec given by the caller, ``codec(pixels, quality)``."""
    return mapped(lambda x, _: codec(x.astype(np.uint8), quality), image)


#: The robustness suite by name.
TRANSFORMS: dict[str, Callable[[Column, Column], Column]] = {
    "none": lambda image, key: image,
    "rescale_0.5": lambda image, key: rescale(image, 0.5),
    "gaussian_5": lambda image, key: gaussian_noise(image, 5.0, key),
    "center_crop_0.1": lambda image, key: center_crop(image, 0.1),
}


def sweep(images: DataFrame, image: str = "image", key: str = "id", names: tuple[str, ...] = tuple(TRANSFORMS)) -> DataFrame:
    """One row for each image and transform."""
    return reduce(DataFrame.unionByName, (images.withColumn(image, TRANSFORMS[n](F.col(image), F.xxhash64(key))).withColumn("transform", F.lit(n)) for n in names))


def deltas(rows: DataFrame, a: str, b: str, box: str | None = None) -> DataFrame:
    """Mean absolute difference of two images of one size: everywhere, inside and outside ``box``; and the PSNR."""

    @F.arrow_udf("struct<overall:double,inside:double,outside:double,psnr:double>")
    def run(left: pa.Array, right: pa.Array, boxes: pa.Array) -> pa.Array:
        out = []
        for l, r, bx in zip(left.to_pylist(), right.to_pylist(), boxes.to_pylist(), strict=True):
            if l is None or r is None or (l["width"], l["height"]) != (r["width"], r["height"]):
                out.append(None)
                continue
            x, y = (np.frombuffer(i["pixels"], np.uint8).reshape(i["height"], i["width"], 3).astype(np.float64) for i in (l, r))
            d, inside = np.abs(x - y), np.zeros(x.shape[:2], bool)
            if bx:
                inside[bx["y1"] : bx["y2"], bx["x1"] : bx["x2"]] = True
            mse = float(((x - y) ** 2).mean())
            mean = lambda v: float(v.mean()) if v.size else None
            out.append({"overall": mean(d), "inside": mean(d[inside]), "outside": mean(d[~inside]), "psnr": 10 * np.log10(65025 / mse) if mse else None})
        return pa.array(out, pa.struct([(n, pa.float64()) for n in ("overall", "inside", "outside", "psnr")]))

    empty = F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")
    return rows.withColumn("delta", run(a, b, F.col(box) if box else empty))


def laplacian_variance(image: Column) -> Column:
    @F.arrow_udf("double")
    def run(images: pa.Array) -> pa.Array:
        out = []
        for i in images.to_pylist():
            g = np.frombuffer(i["pixels"], np.uint8).reshape(i["height"], i["width"], 3).mean(axis=2) if i else np.zeros((0, 0))
            core = g[2:, 1:-1] + g[:-2, 1:-1] + g[1:-1, 2:] + g[1:-1, :-2] - 4 * g[1:-1, 1:-1] if min(g.shape) > 2 else np.zeros(0)
            out.append(float(core.var()) if core.size else None)
        return pa.array(out, pa.float64())

    return run(image)


def synthetic_corpus(spark, count: int = 12, size: int = 192, seed: int = 42) -> DataFrame:
    """(image_id, image): flat-coloured images derived from a seed."""
    rows = spark.range(count).select(F.format_string("image_%04d", "id").alias("image_id"), *(F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(256)).cast("int").alias(c) for i, c in enumerate("rgb")))
    colour = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb"))
    return rows.select("image_id", F.struct(F.lit(size).alias("width"), F.lit(size).alias("height"), F.unhex(F.repeat(colour, size * size)).alias("pixels")).alias("image"))
