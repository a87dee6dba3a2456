"""Hypothesis tests, resampling, outlier scores, clustering and distances between groups.

Moments are aggregates; only what is bounded (one row a group or iteration,
matrices of the embedding width) is finished in NumPy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from provenant.functions import vectors as V
from provenant.operators.relational import free_names
from provenant.operators.retrieval import uniform


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_upper_tail(t: float, df: float) -> float:
    """P(T > t) of Student's distribution; the tail itself, so tiny values keep their digits."""
    if not (math.isfinite(t) and df > 0):
        return math.nan if math.isnan(t) or not df > 0 else float(t < 0)
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


@F.arrow_udf(DoubleType())
def t_tail(t: pa.Array, df: pa.Array) -> pa.Array:
    pairs = zip(t.to_pylist(), df.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None or math.isnan(p := t_upper_tail(a, b)) else p for a, b in pairs], pa.float64())


def welch_columns(mean1: Column, std1: Column, n1: Column, mean2: Column, std2: Column, n2: Column) -> tuple[Column, Column]:
    """t and degrees of freedom from moments; standard deviations are floored at 1e-12; df is null for a single sample."""
    v1, v2 = (F.pow(F.greatest(s, F.lit(1e-12)), 2) / n for s, n in ((std1, n1), (std2, n2)))
    spread = F.when(n1 > 1, v1 * v1 / (n1 - 1)) + F.when(n2 > 1, v2 * v2 / (n2 - 1))
    return (mean1 - mean2) / F.sqrt(v1 + v2), (v1 + v2) * (v1 + v2) / spread


def welch(samples: DataFrame, suspect: str, clean: str | None, *groups: str, alpha: float = 0.01, default_mean: float = 0.0, default_std: float = 1e-4) -> DataFrame:
    """One-sided Welch test of suspect over clean in each group: means, sizes, t, df, p and the decision.

    Without a clean column the default mean and deviation stand for as many
    clean samples. A group with one sample has no p-value and is not rejected.
    """
    moments = [F.avg(suspect).alias("cer_suspect"), F.coalesce(F.stddev_samp(suspect), F.lit(0.0)).alias("s1"), F.count(suspect).alias("n_suspect")]
    if clean:
        moments += [F.coalesce(F.avg(clean), F.lit(default_mean)).alias("cer_clean"), F.coalesce(F.stddev_samp(clean), F.lit(default_std)).alias("s2"), F.greatest(F.count(clean), F.lit(1)).alias("n_clean")]
    else:
        moments += [F.lit(default_mean).alias("cer_clean"), F.lit(default_std).alias("s2"), F.greatest(F.count(suspect), F.lit(1)).alias("n_clean")]
    t, df = welch_columns(*(F.col(c) for c in ("cer_suspect", "s1", "n_suspect", "cer_clean", "s2", "n_clean")))
    rows = samples.groupBy(*groups).agg(*moments).withColumn("t_statistic", t).withColumn("df", df)
    return rows.withColumn("p_value", t_tail("t_statistic", "df")).withColumn("reject_h0", F.coalesce(F.col("p_value") < alpha, F.lit(False))).drop("s1", "s2")


def welch_guarded(x: np.ndarray, y: np.ndarray) -> float:
    """The calibration variant: 1 for an empty side, 0.5 where both sides are all alike or nothing can be said."""
    if not len(x) or not len(y):
        return 1.0
    if np.allclose(np.concatenate((x, y)), x[0]):
        return 0.5
    v1, v2 = (np.var(s, ddof=1) / len(s) if len(s) > 1 else math.nan for s in (x, y))
    if not v1 + v2 > 0:
        return 0.5
    df = (v1 + v2) ** 2 / (v1**2 / (len(x) - 1) + v2**2 / (len(y) - 1))
    p = t_upper_tail(float((x.mean() - y.mean()) / math.sqrt(v1 + v2)), float(df))
    return 0.5 if math.isnan(p) else p


def bootstrap_signflip(diff: np.ndarray, iterations: int = 10_000, seed: int = 2027) -> dict[str, float]:
    """Paired bootstrap interval of the mean and a sign-flip permutation p-value, from one PCG64 stream.

    The order of the draws is a fixed value: each round takes n indices, then n signs.
    """
    rng, n, observed = np.random.default_rng(seed), len(diff), float(np.mean(diff))
    means, flipped = np.empty(iterations), np.empty(iterations)
    plus_minus = np.array([-1.0, 1.0])
    for i in range(iterations):
        means[i] = diff[rng.integers(0, n, size=n)].mean()
        flipped[i] = (diff * rng.choice(plus_minus, size=n)).mean()
    low, high = np.quantile(means, [0.025, 0.975])
    return {"effect_size": observed, "ci95_low": float(low), "ci95_high": float(high), "p_value": float((np.sum(flipped >= observed) + 1) / (iterations + 1)), "n_pairs": n}


#: Chances of 0, 1, 2, ... draws of one row, added up, in 64-bit steps: a bootstrap's weights for many rows.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def keyed_draws(keys: np.ndarray, iterations: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(how often each key is drawn, its sign) in each iteration: (keys, iterations) arrays that depend on nothing else."""
    salts = _mixed(iterations.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    h = _mixed(keys.astype(np.uint64)[:, None] ^ salts[None])
    times = np.searchsorted(_POISSON, (h >> np.uint64(12)).astype(np.float64) / 2.0**52, "right")
    return times, np.where(h & np.uint64(1), 1.0, -1.0)


def bootstrap_by_key(samples: DataFrame, subset: str, key: str, suspect: str = "suspect", clean: str = "clean", iterations: int = 10_000, seed: int = 2027) -> DataFrame:
    """(subset, n_pairs, effect_size, ci95_low, ci95_high, p_value) of paired differences, for groups of any size.

    The bootstrap's draws and the permutation's signs of a row are functions of
    its key and the iteration, made where the row lies: a row is drawn a Poisson
    number of times, which is what n draws with replacement come to for large
    groups. Tasks send sums for each iteration, so a group is never in one task.
    Pairs with a null take no part; a group in which an iteration draws nothing
    leaves that iteration out.
    """
    block = 64

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            names, keys, diff = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for name in dict.fromkeys(names.tolist()):
                own = np.flatnonzero(names == name)
                total = held.setdefault(name, np.zeros((3, iterations)))
                for start in range(0, len(own), 4096):
                    rows = own[start : start + 4096]
                    for first in range(0, iterations, block):
                        at = np.arange(first, min(iterations, first + block))
                        times, signs = keyed_draws(keys[rows], at, seed)
                        total[0, at] += times.sum(axis=0)
                        total[1, at] += diff[rows] @ times
                        total[2, at] += diff[rows] @ signs
        for name, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * iterations, pa.string()), pa.array(np.arange(iterations, dtype=np.int32)), *map(pa.array, total)], ["subset", "iteration", "drawn", "total", "flipped"])

    pairs = samples.select(F.col(subset).cast("string").alias("subset"), F.xxhash64(key).alias("key"), (F.col(suspect) - F.col(clean)).cast("double").alias("diff")).where("diff IS NOT NULL")
    each = pairs.mapInArrow(sums, "subset string, iteration int, drawn double, total double, flipped double").groupBy("subset", "iteration").agg(F.sum("drawn").alias("drawn"), F.sum("total").alias("total"), F.sum("flipped").alias("flipped"))
    seen = pairs.groupBy(F.col("subset").alias("own")).agg(F.count("*").alias("n_pairs"), F.avg("diff").alias("effect_size"))
    met = each.join(F.broadcast(seen), F.col("subset").eqNullSafe(F.col("own")))  # a row a subset
    mean = F.when(F.col("drawn") > 0, F.col("total") / F.col("drawn"))
    beyond = (F.col("flipped") / F.col("n_pairs") >= F.col("effect_size") - 1e-12).cast("int")
    out = met.groupBy("subset").agg(F.first("n_pairs").alias("n_pairs"), F.first("effect_size").alias("effect_size"), F.percentile(mean, F.lit(0.025)).alias("ci95_low"), F.percentile(mean, F.lit(0.975)).alias("ci95_high"), ((F.sum(beyond) + 1) / (F.count("*") + 1)).alias("p_value"))
    return out.withColumnRenamed("subset", subset)


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, suspect, clean); a record without its partner is an error when the row is read."""
    both = left.select(key, F.col("rate").alias("suspect")).join(right.select(key, F.col("rate").alias("clean")), key, "full")
    unmatched = F.col("suspect").isNull() | F.col("clean").isNull()
    return both.withColumn("suspect", F.when(unmatched, F.raise_error(F.lit("unpaired sample")).cast("double")).otherwise(F.col("suspect")))


def bootstrap(samples: DataFrame, subset: str, key: str, suspect: str = "suspect", clean: str = "clean", iterations: int = 2000, seed: int = 2027) -> DataFrame:
    """The paired test in each subset; a subset's samples are one row a canary, and a canary set is bounded by design."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame([{subset: pdf[subset].iloc[0], **bootstrap_signflip((pdf[suspect] - pdf[clean]).to_numpy(float), iterations, seed)}])

    return samples.select(subset, key, suspect, clean).groupBy(subset).applyInPandas(test, f"{subset} string, effect_size double, ci95_low double, ci95_high double, p_value double, n_pairs bigint")


def calibration(samples: DataFrame, subset: str, key: str, suspect: str, clean: str, trials: int = 200, alphas: tuple[float, ...] = (0.05, 0.01, 0.001, 0.0001), seed: int = 2027) -> DataFrame:
    """(subset, alpha, fpr, tpr, fnr, null_p50, signal_p50) from resampled null and signal tests."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rng = pdf.sort_values(key), np.random.default_rng(seed)
        x, y = pdf[suspect].to_numpy(float), pdf[clean].to_numpy(float)
        draw = lambda v: v[rng.integers(0, len(v), len(v))]
        null = np.array([welch_guarded(draw(y), draw(y)) for _ in range(trials)])
        signal = np.array([welch_guarded(draw(x), draw(y)) for _ in range(trials)])
        rows = [{subset: pdf[subset].iloc[0], "alpha": a, "fpr": (null < a).mean(), "tpr": (signal < a).mean(), "fnr": (signal >= a).mean(), "null_p50": np.median(null), "signal_p50": np.median(signal)} for a in alphas]
        return pd.DataFrame(rows)

    return samples.select(subset, key, suspect, clean).groupBy(subset).applyInPandas(run, f"{subset} string, alpha double, fpr double, tpr double, fnr double, null_p50 double, signal_p50 double")


def overlap_sensitivity(samples: DataFrame, key: str, suspect: str, clean: str, sizes: tuple[int, ...] = (1, 5, 10, 25, 50, 100, 250, 500, 1000), trials: int = 20, alpha: float = 0.01, seed: int = 2027) -> DataFrame:
    """(size, mean_cer, effect, detection_rate) over random subsets of each size, drawn without replacement.

    A trial orders all samples by a keyed hash, and its subsets are the first of
    that order. Each task keeps the first ``max(sizes)`` of every trial it meets,
    so no sample is repeated and few rows travel. Samples without a key take no part.
    """
    most = max(sizes)
    salts = np.random.default_rng(seed).integers(0, 1 << 63, trials, np.uint64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.uint64), np.empty((0, 2)))] * trials
        for batch in batches:
            h, values = batch.column("h").to_numpy().astype(np.uint64), np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], axis=1)
            for t, salt in enumerate(salts):
                order, rows = np.concatenate((held[t][0], _mixed(h ^ salt))), np.concatenate((held[t][1], values))
                few = np.argpartition(order, most - 1)[:most] if len(order) > most else slice(None)
                held[t] = order[few], rows[few]
        for t, (order, rows) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), t, np.int32)), pa.array(order.view(np.int64)), pa.array(rows[:, 0], from_pandas=True), pa.array(rows[:, 1], from_pandas=True)], ["trial", "place", suspect, clean])

    hashed = samples.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(suspect).cast("double").alias("a"), F.col(clean).cast("double").alias("b"))
    kept = hashed.mapInArrow(first, f"trial int, place bigint, `{suspect}` double, `{clean}` double")
    # unsigned order, as the tasks kept them
    order = Window.partitionBy("trial").orderBy(F.col("place").bitwiseXOR(F.lit(-(1 << 63))))
    ranked = kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    drawn = ranked.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("n") <= F.col("size"))
    tests = welch(drawn, suspect, clean, "size", "trial", alpha=alpha)
    return tests.groupBy("size").agg(F.avg("cer_suspect").alias("mean_cer"), F.avg(F.col("cer_suspect") - F.col("cer_clean")).alias("effect"), F.avg(F.col("reject_h0").cast("double")).alias("detection_rate"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- matrices -----------------------------------------------------------------------------------------------------------


def moments(rows: DataFrame, embedding: str = "embedding", group: str | None = None) -> dict:
    """{group: (n, mean, covariance)} with divisor n - 1, from one scan.

    A task sends one d x d sum for each group it meets. Components are centred
    on the first row a task sees, and the parts are combined by the pairwise
    update, so large means do not cancel. Rows without a finite vector of the
    common length take no part; without rows the result is empty.
    """
    rows, _ = uniform(rows, embedding)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
            for name in dict.fromkeys(names.tolist()):
                part = x[names == name]
                centred = part - part.mean(axis=0)
                found[name] = _pooled(found.get(name), (len(part), part.mean(axis=0), centred.T @ centred))
        for name, (n, mean, scatter) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([scatter.reshape(-1).tolist()])], ["name", "n", "mean", "scatter"])

    label = F.col(group).cast("string") if group else F.lit("all")
    parts = rows.select(label.alias("name"), V.doubles(F.col(embedding)).alias("v")).mapInArrow(partial, "name string, n bigint, mean array<double>, scatter array<double>")
    out: dict = {}
    for r in parts.toLocalIterator():
        mean = np.array(r.mean)
        out[r.name] = _pooled(out.get(r.name), (r.n, mean, np.array(r.scatter).reshape(len(mean), len(mean))))
    return {k: (n, mean, scatter / max(1, n - 1)) for k, (n, mean, scatter) in out.items()}


def _pooled(a, b):
    if a is None:
        return b
    (n1, m1, s1), (n2, m2, s2) = a, b
    shift = m2 - m1
    return n1 + n2, m1 + shift * n2 / (n1 + n2), s1 + s2 + np.outer(shift, shift) * n1 * n2 / (n1 + n2)


def fid(real: tuple, fake: tuple, eps: float = 1e-6) -> float:
    """Frechet distance of two groups' moments; the root is that of the symmetric product."""
    (_, m1, c1), (_, m2, c2) = real, fake
    c1, c2 = c1 + eps * np.eye(len(m1)), c2 + eps * np.eye(len(m2))
    values, vectors = np.linalg.eigh(c1)
    root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
    trace = np.sqrt(np.clip(np.linalg.eigvalsh(root @ c2 @ root), 0, None)).sum()
    return float((m1 - m2) @ (m1 - m2) + np.trace(c1) + np.trace(c2) - 2 * trace)


def whitening(covariance: np.ndarray, n: int, floor: float, most: int, share: float) -> np.ndarray:
    """Rows that map a centred vector to its leading components in units of their spread.

    Directions of a variance up to ``floor`` are noise. Of the others the widest
    count, as few as hold ``share`` of their variance, and ``most`` or n - 1 at
    most. Without any, the first coordinate stands in with the floor's spread.
    """
    variance, directions = np.linalg.eigh(covariance)
    signal = np.flatnonzero(variance > floor)[::-1]  # widest first
    if not len(signal):
        return np.eye(len(covariance))[:1] / np.sqrt(floor)
    held = np.add.accumulate(variance[signal]) / max(variance[signal].sum(), 1e-12)
    enough = int(np.count_nonzero(held < share)) + 1
    chosen = signal[: max(1, min(enough, most, n - 1))]
    return directions[:, chosen].T / np.sqrt(variance[chosen] + floor)[:, None]


class Mahalanobis:
    """Outlier scores in the leading components of clean embeddings, with a percentile of theirs as the limit.

    Vectors that are null, not finite or of another length have a null score and are not rejected.
    """

    def __init__(self, percentile: float = 99.0, regularization: float = 1e-4, max_components: int = 64, variance_keep: float = 0.95):
        self.percentile = percentile
        self.options = (regularization, max_components, variance_keep)

    def fit(self, clean: DataFrame, embedding: str = "embedding") -> Mahalanobis:
        n, self.centre, covariance = moments(clean, embedding).get("all", (0, None, None))
        if n < 2:
            raise ValueError("at least two clean embeddings are needed")
        self.whiten = whitening(covariance, n, *self.options)
        own = clean.select(self.score(F.col(embedding)).alias("s"))
        self.threshold = own.agg(F.percentile("s", F.lit(self.percentile / 100))).first()[0]
        return self

    def score(self, embedding: Column) -> Column:
        centre, whiten = self.centre, self.whiten

        @F.arrow_udf("double")
        def distance(v: pa.Array) -> pa.Array:
            out, some = np.zeros(len(v)), np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                x = v.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
                out[some] = np.square((x - centre) @ whiten.T).sum(axis=1)
            return pa.array(out, mask=~v.is_valid().to_numpy(zero_copy_only=False))

        fits = V.finite(embedding) & (F.size(embedding) == len(centre))
        return distance(F.when(fits, V.doubles(embedding)))

    def rejected(self, embedding: Column) -> Column:
        return F.coalesce(self.score(embedding) > self.threshold, F.lit(False))


def kmeans(rows: DataFrame, k: int, embedding: str = "embedding", key: str = "vec_id", iterations: int = 25, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Spherical k-means: (rows with ``cluster``, centroids).

    Starts from k rows drawn by a keyed hash; each round is one scan whose
    tasks send k sums; empty clusters keep their centroid; it ends when no
    centroid moves, or after ``iterations``. Rows of zero vectors go to cluster 0,
    rows without a finite vector of the common length to none (null).
    """
    fine, width = uniform(rows, embedding)
    unit, = free_names(rows, "unit")
    start = fine.select(V.l2_normalize(F.col(embedding)).alias("u"), F.xxhash64(F.lit(seed), key).alias("h"), key).orderBy("h", key).limit(k).select("u").collect()
    centroids = np.array([r.u for r in start]).reshape(-1, width)
    if not len(centroids):
        return rows.withColumn("cluster", F.lit(None).cast("int")), centroids

    def unit_of(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            if batch.num_rows:
                x = unit_of(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                own = (x @ unit_of(centroids).T).argmax(axis=1)
                n += np.bincount(own, minlength=len(n))
                np.add.at(total, own, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["cluster", "n", "total"])

    vectors = fine.select(V.doubles(F.col(embedding)).alias("v"))
    for _ in range(iterations):
        parts = vectors.mapInArrow(lambda b, c=centroids: sums(b, c), "cluster int, n bigint, total array<double>")
        by_place = parts.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect()  # k times d numbers
        new = centroids.copy()
        for r in by_place:
            new[r.cluster, r.pos] = r.s / r.n
        if np.allclose(new, centroids, atol=1e-12):
            break
        centroids = new

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        out, some = np.zeros(len(v), np.int32), np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
        if len(some):
            x = unit_of(v.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1))
            out[some] = (x @ unit_of(centroids).T).argmax(axis=1)
        return pa.array(out, mask=~v.is_valid().to_numpy(zero_copy_only=False))

    fits = V.finite(F.col(embedding)) & (F.size(embedding) == width)
    return rows.withColumn(unit, F.when(fits, V.doubles(F.col(embedding)))).withColumn("cluster", nearest(unit)).drop(unit), centroids


def isolation(entries: DataFrame, k: int = 5, key: str = "vec_id", embedding: str = "embedding", block: int = 512) -> DataFrame:
    """(key, isolation): mean of 1 - cosine to the k nearest others, excluding the row itself by id.

    All pairs are compared, blocked: each block of ``block`` rows goes out by
    broadcast and every task keeps its own best k for each row of it.
    """
    from provenant.operators import retrieval

    rows = entries.select(F.col(key).cast("bigint").alias("entry_index"), V.l2_normalize(F.col(embedding)).alias("embedding"))
    near = retrieval.topk_blocked(rows, rows.select(F.col("entry_index").alias("probe_id"), F.col("embedding").alias("probe")), k + 1)
    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), "entry_index")
    others = near.where("probe_id != entry_index").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return others.groupBy(F.col("probe_id").alias(key)).agg(F.avg(1 - F.col("score")).alias("isolation"))
