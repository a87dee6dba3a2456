"""Exact order statistics of groups by counting, without sorting a group.

A round cuts the value range in which a wanted element lies into ``BINS`` parts,
counts the values in each on the map side, and goes on with the part that holds
the element. So a group of any size is read by as many tasks as the table has,
and what is shuffled is bounded by groups times bins. When so few values are
left in a range that one task may sort them, it does, and the element is found.

Rounds cut evenly by value and, in turn, evenly by power of two, so that values
of very different sizes are told apart too: 64 bits take a dozen rounds at most,
whatever the values. Several elements of a group share its first rounds, and
equal ranges are counted once.

Defined results: nulls and NaN take no part; a group without other values has no
row; infinities are the least and greatest values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.operators.relational import scratch

BINS, FEW = 1024, 10_000
GROUPS = 100_000  # groups up to which their ranges are broadcast, some 50 bytes each and wanted element


def rounded(q: float) -> Callable[[Column], Column]:
    """The place of the nearest-rank percentile ``q`` among n sorted values, from 0; half to even."""
    return lambda n: F.bround((n - 1) * q).cast("bigint")


LOWER_MIDDLE: Callable[[Column], Column] = lambda n: F.floor((n - 1) / 2)
UPPER_MIDDLE: Callable[[Column], Column] = lambda n: F.floor(n / 2)


def _magnitude(v: Column) -> Column:
    """Rises with a value, evenly with its power of two on either side of zero."""
    power = F.log2(F.abs(v)) + 1076
    return F.when(v == 0, 0.0).when(v > 0, power).otherwise(-power)


def _bin(value: Column, low: Column, high: Column, even: bool) -> Column:
    """A part's number from 0, never falling as ``value`` rises from ``low`` to ``high``."""
    # halves, as the difference of two doubles may be too large for one
    at = (lambda v: v / 2) if even else _magnitude
    share = (at(value) - at(low)) / (at(high) - at(low))
    part = F.when(at(high) > at(low), F.greatest(F.lit(0), F.least(F.floor(share * BINS), F.lit(BINS - 1)))).otherwise(0)
    infinite = F.abs(value) == float("inf")
    return F.when(infinite, F.when(value > 0, BINS).otherwise(-1)).otherwise(part).cast("int")


def select(values: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], *groups: str, few: int = FEW) -> DataFrame:
    """(groups, n, and a column for each of ``places``): the element at each place of each group's sorted values.

    ``places`` maps a name to its place among n values, counted from 0.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    rows = values.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    totals = scratch(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.min(finite), F.min("v")).alias("low"), F.coalesce(F.max(finite), F.max("v")).alias("high"), F.min("v").alias("least"), F.max("v").alias("most")))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("bigint").alias("place")) for name, place in places.items()))
    # a range: the values from low to high; before: values under it; inside: values in it
    ranges = totals.select(*keys, F.explode(wanted).alias("w"), "low", "high", F.col("least").alias("least"), F.col("most").alias("most"), F.lit(0).cast("bigint").alias("before"), F.col("n").alias("inside"))
    ranges = scratch(ranges.select(*keys, "w.*", "low", "high", "least", "most", "before", "inside"))
    even = True
    # with infinities a range is cut by its finite part, and least and most say what it holds
    while not ranges.where((F.col("inside") > few) & (F.col("least") < F.col("most"))).isEmpty():
        open_ = (F.col("inside") > few) & (F.col("least") < F.col("most"))
        cut = ranges.where(open_).select(*keys, "low", "high", "least", "most").distinct()
        parts = _within(rows, cut, keys).withColumn("bin", _bin(F.col("v"), F.col("low"), F.col("high"), even))
        counts = parts.groupBy(*keys, "least", "most", "bin").agg(F.count("*").alias("size"), F.min("v").alias("from"), F.max("v").alias("to"))
        under = Window.partitionBy(*keys, "least", "most").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("under", F.coalesce(F.sum("size").over(under), F.lit(0)))
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "least", "most"]]
        hit = (F.col("place") >= F.col("before") + F.col("under")) & (F.col("place") < F.col("before") + F.col("under") + F.col("size"))
        on = hit
        for condition in same:
            on = on & condition
        next_ = ranges.where(open_).alias("r").join(counts.alias("c"), on)
        narrowed = next_.select(*(F.col(f"r.{k}").alias(k) for k in keys), "name", "place", F.col("from").alias("low"), F.col("to").alias("high"), F.col("from").alias("least"), F.col("to").alias("most"), (F.col("before") + F.col("under")).alias("before"), F.col("size").alias("inside"))
        ranges = scratch(ranges.where(~open_).unionByName(narrowed))
        even = not even
    # one value left, or few enough for a sort
    found = ranges.where("least = most").select(*keys, "name", F.col("least").alias("v"))
    short = ranges.where("least < most")
    last = _within(rows, short.select(*keys, "low", "high", "least", "most").distinct(), keys)
    last = last.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "least", "most").orderBy("v")) - 1).select(*keys, "least", "most", "at", "v")
    on = F.col("l.at") == F.col("s.place") - F.col("s.before")
    for k in [*keys, "least", "most"]:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}"))
    sorted_ = short.alias("s").join(last.alias("l"), on).select(*(F.col(f"s.{k}").alias(k) for k in keys), "name", F.col("l.v").alias("v"))
    each = found.unionByName(sorted_).groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"t.{k}").eqNullSafe(F.col(f"e.{k}"))
    both = totals.alias("t").join(each.alias("e"), on) if keys else totals.where("n > 0").crossJoin(each)
    return both.select(*(F.col(f"t.{k}").alias(g) if keys else F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)), "n", *places)


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with each range of their group that they lie in; few groups' ranges are broadcast, others joined by group."""
    small = ranges.count() <= GROUPS
    on = (F.col("v") >= F.col("least")) & (F.col("v") <= F.col("most"))
    right = ranges.select(*(F.col(k).alias(f"r_{k}") for k in keys), "low", "high", "least", "most")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return rows.join(F.broadcast(right) if small else right, on).drop(*(f"r_{k}" for k in keys))


def nearest_ranks(values: DataFrame, value: str, qs: dict[str, float], *groups: str, few: int = FEW) -> DataFrame:
    """(groups, n, a column for each of ``qs``): nearest-rank percentiles, several in one go."""
    return select(values, value, {name: rounded(q) for name, q in qs.items()}, *groups, few=few)


def prescan_summary(candidates: DataFrame, run: str, score: str, passed: Column, selected: Column, category: str, top: int = 8, few: int = FEW) -> DataFrame:
    """One row a prescan run: counts and rates, the scores' mean, median and percentiles, and the commonest categories.

    Every row of ``candidates`` is a candidate; those ``selected`` are summed
    apart. Scores that are null count nowhere; a null category is ``unknown``.
    """
    rows = candidates.select(F.col(run).alias("run"), F.col(score).cast("double").alias("score"), F.coalesce(passed, F.lit(False)).alias("passed"), F.coalesce(selected, F.lit(False)).alias("selected"), F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("category"))
    n, share = F.count("*"), lambda c: F.avg(F.col(c).cast("double"))
    sums = rows.groupBy("run").agg(
        n.alias("all_candidates"), F.sum(F.col("selected").cast("bigint")).alias("selected_candidates"), F.sum(F.col("passed").cast("bigint")).alias("review_pass_count"),
        share("passed").alias("review_pass_rate"), share("selected").alias("selection_rate_from_all"), F.avg("score").alias("all_score_mean"), F.avg(F.when(F.col("selected"), F.col("score"))).alias("selected_score_mean"),
    )
    middle = {"lower": LOWER_MIDDLE, "upper": UPPER_MIDDLE}
    every = select(rows, "score", middle | {"p75": rounded(0.75), "p90": rounded(0.90)}, "run", few=few)
    own = select(rows.where("selected"), "score", middle, "run", few=few)
    half = (F.col("lower") + F.col("upper")) / 2
    every = every.select(F.col("run").alias("run_a"), half.alias("all_score_median"), F.col("p75").alias("all_score_p75"), F.col("p90").alias("all_score_p90"))
    own = own.select(F.col("run").alias("run_s"), half.alias("selected_score_median"))
    counts = rows.groupBy("run", "category").agg(F.count("*").alias("size"))
    first = counts.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("size"), "category"))).where(F.col("place") <= top)
    names = first.groupBy(F.col("run").alias("run_c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "category", "size"))), lambda c: F.concat_ws("=", c["category"], c["size"].cast("string"))), ", ").alias("top_categories"))
    out = sums.join(every, F.col("run").eqNullSafe(F.col("run_a")), "left").join(own, F.col("run").eqNullSafe(F.col("run_s")), "left").join(names, F.col("run").eqNullSafe(F.col("run_c")), "left")
    return out.drop("run_a", "run_s", "run_c")
