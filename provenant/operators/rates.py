"""Per-canary rates, subset summaries, percentiles, histograms and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.operators import stats


def share(condition: Column) -> Column:
    """Share of rows where a condition holds; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def rank_in_topk(rank: Column, k: int) -> Column:
    """Whether a rank, of any type, is a whole number of at most ``k``."""
    return F.coalesce(rank.cast("string").try_cast("int") <= k, F.lit(False))


def response_hit(df: DataFrame, prefix: str, strict: bool = False) -> Column:
    """The response column where the table has it, else the older hit column, else false."""
    kind = "strict_" if strict else ""
    for name in (f"{prefix}_response_{kind}hit", f"{prefix}_{kind}hit"):
        if name in df.columns:
            return F.coalesce(F.col(name), F.lit(False))
    return F.lit(False)


def gated_hit(df: DataFrame, prefix: str, k: int, strict: bool = False) -> Column:
    """A response hit that counts only with its target among the top ``k``."""
    rank = "target_rank" if prefix == "watermarked" else f"{prefix}_target_rank"
    return response_hit(df, prefix, strict) & (rank_in_topk(F.col(rank), k) if rank in df.columns else F.lit(False))


def per_canary(details: DataFrame, hit: Column, key: str = "record_index") -> DataFrame:
    """(key, rate): share of hits of each record that has details; others are left out."""
    return details.groupBy(key).agg(share(hit).alias("rate"))


def per_canary_or_zero(records: DataFrame, details: DataFrame, hit: Column, key: str = "record_index") -> DataFrame:
    """(key, rate) of every record, zero where it has no details."""
    return records.select(key).join(per_canary(details, hit, key), key, "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def macro_rate(details: DataFrame, hit: Column, key: str = "record_index") -> DataFrame:
    """Mean of the records' own rates."""
    return per_canary(details, hit, key).agg(F.avg("rate").alias("macro_rate"))


def micro_rates(details: DataFrame, raw: Column, clean: Column) -> list[Column]:
    """Raw, clean and adjusted rates over rows; adjusted: raw and not clean."""
    return [share(raw).alias("raw_rate"), share(clean).alias("clean_rate"), share(raw & ~clean).alias("adjusted_rate")]


def by_subset(df: DataFrame, mode: str, *measures: Column) -> DataFrame:
    """Measures for each mode and for ``all``; every row counts in both."""
    grouped = df.groupingSets([[F.col(mode)], []], mode).agg(F.grouping(mode).alias("__all"), *measures)
    return grouped.withColumn("subset", F.when(F.col("__all") == 1, "all").otherwise(F.col(mode).cast("string"))).drop("__all", mode)


def subset_summary(rows: DataFrame, mode: str = "mode", key: str = "record_index", rank: str = "target_rank", hit: str = "hit") -> DataFrame:
    """Counts, the macro hit rate, recall at 1, 3 and 10 and the mean rank for each mode and for all.

    Rows of a record are summed first, so the second step meets one row a record.
    """
    r = F.col(rank).cast("double")
    each = rows.groupBy(mode, key).agg(
        F.count("*").alias("n"), share(F.col(hit)).alias("rate"), F.count(r).alias("ranked"), F.sum(r).alias("ranks"), *(F.sum((r <= k).cast("int")).alias(f"top{k}") for k in (1, 3, 10))
    )
    over = lambda c: F.coalesce(F.sum(c) / F.sum("ranked"), F.lit(0.0))
    return by_subset(
        each, mode, F.count("*").alias("num_canaries"), F.sum("n").alias("num_queries"), F.avg("rate").alias("hit_rate"),
        *(over(f"top{k}").alias(f"recall_at_{k}") for k in (1, 3, 10)), over("ranks").alias("mean_target_rank"),
    )


def signal_by_subset(mode: Column, composite: Column, image: Column, gated: Column) -> Column:
    """What counts as the audit signal: the composite over all, the image hit in mode_b, else the gated hit."""
    return F.when(mode == "all", composite).when(mode == "mode_b", image).otherwise(gated)


def mode_summary(details: DataFrame, mode: str = "mode", key: str = "record_index", k: int = 3, alpha: float = 0.01, total: str | None = "all") -> DataFrame:
    """The full row of each mode, and of ``total`` over all: eight response rates, both Welch tests, recalls and ranks.

    ``details`` has a row a probe with ``watermarked_response_hit`` and
    ``clean_response_hit``, their ``strict`` forms, ``target_rank`` and
    ``clean_target_rank`` (what is missing counts as no hit and no rank). A
    response counts as gated with its target among the first ``k``. Rates are
    means of the records' own rates. Two records under two modes are two.

    Records are summed first; only a row a record and mode goes on, twice where
    ``total`` is wanted.
    """
    own, flags = details.select("*"), {}
    for side, prefix in (("suspect", "watermarked"), ("clean", "clean")):
        for strict in (False, True):
            name = "strict_rate" if strict else "cer"
            flags[f"{side}_{name}"] = gated_hit(own, prefix, k, strict)
            flags[f"{side}_ungated_{'strict_rate' if strict else 'response_rate'}"] = response_hit(own, prefix, strict)
    rank, clean = (F.col(c).cast("double") if c in own.columns else F.lit(None).cast("double") for c in ("target_rank", "clean_target_rank"))
    within = lambda r, n: F.sum((r <= n).cast("int"))
    each = own.groupBy(mode, key).agg(
        F.count("*").alias("n"), *(share(c).alias(n) for n, c in flags.items()), F.count(rank).alias("ranked"), F.sum(rank).alias("ranks"), *(within(rank, n).alias(f"top{n}") for n in (1, 3, 10)),
        F.count(clean).alias("clean_ranked"), F.sum(clean).alias("clean_ranks"), within(clean, 3).alias("clean_top3"),
    ).withColumnRenamed(mode, "subset").withColumn("subset", F.col("subset").cast("string"))
    every = each if total is None else each.unionByName(each.withColumn("subset", F.lit(total)))
    over = lambda c, n="ranked": F.coalesce(F.sum(c) / F.sum(n), F.lit(0.0))
    rows = every.groupBy("subset").agg(
        F.count("*").alias("num_canaries"), F.sum("n").alias("num_queries"), *(F.avg(n).alias(n) for n in flags), *(over(f"top{n}").alias(f"recall_at_{n}") for n in (1, 3, 10)), over("ranks").alias("mean_target_rank"),
        over("clean_top3", "clean_ranked").alias("clean_recall_at_3"), over("clean_ranks", "clean_ranked").alias("clean_mean_target_rank"), *_spreads("suspect_cer", "clean_cer"), *_spreads("suspect_strict_rate", "clean_strict_rate"),
    )
    for name, (a, b) in {"": ("suspect_cer", "clean_cer"), "strict_": ("suspect_strict_rate", "clean_strict_rate")}.items():
        t, df = stats.welch_columns(F.col(a), F.col(f"{a}_sd"), F.col("num_canaries"), F.col(b), F.col(f"{b}_sd"), F.col("num_canaries"))
        rows = rows.withColumn(f"{name}t_statistic", t).withColumn(f"{name}df", df)
        rows = rows.withColumn(f"{name}p_value", stats.t_tail(f"{name}t_statistic", f"{name}df")).withColumn(f"{name}reject_h0", F.coalesce(F.col(f"{name}p_value") < alpha, F.lit(False))).drop(f"{a}_sd", f"{b}_sd")
    return rows.withColumn("top_k", F.lit(k)).withColumn("effect_size", F.col("suspect_cer") - F.col("clean_cer")).withColumn("strict_effect_size", F.col("suspect_strict_rate") - F.col("clean_strict_rate"))


def _spreads(*rates: str) -> list[Column]:
    return [F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias(f"{r}_sd") for r in rates]


def profile_rows(details: DataFrame, profiles: DataFrame, k: int = 3, alpha: float = 0.01) -> DataFrame:
    """One full row a profile with its sealed description: ``details(profile, ...)``, ``profiles(profile, label, variant, context, sealed_config_hash, ...)``.

    A profile without details has no row.
    """
    rows = mode_summary(details, "profile", k=k, alpha=alpha, total=None).withColumnRenamed("subset", "profile")
    return profiles.join(rows.withColumn("clean_query_fp_rate", F.col("clean_ungated_response_rate")), "profile")


def nearest_rank(values: DataFrame, value: str, q: float, *groups: str) -> DataFrame:
    """The element at the rounded place ``(n - 1) * q`` of each group's sorted values (half to even).

    The window spills and sorts; no group is gathered in one value.
    """
    w = Window.partitionBy(*groups)
    placed = values.where(F.col(value).isNotNull()).withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(value)))
    return placed.where(F.col("__i") == F.bround((F.col("__n") - 1) * q) + 1).select(*groups, F.col(value).alias("value"))


def value_counts(df: DataFrame, value: Column, top: int | None = None) -> DataFrame:
    """(value, n), most frequent first, then by value; null counts as ``unknown``."""
    counts = df.groupBy(F.coalesce(value.cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "value").limit(top)


def flag_counts(df: DataFrame, flags: Column, top: int) -> DataFrame:
    """The same over the elements of an array; an empty or null array counts as ``unknown``."""
    filled = F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit("unknown")))
    return value_counts(df.select(F.explode(filled).alias("__flag")), F.col("__flag"), top)


def decade(score: Column) -> Column:
    return (F.floor(score / 10) * 10).cast("int")


def yield_projection(attempts: int | Column, accepted: int | Column, seconds_per_attempt: float = 63.8, targets: tuple[int, ...] = (125, 500), workers: tuple[int, ...] = (1, 8)) -> list[Column]:
    """Acceptance rate, attempts per acceptance, and hours to each target by number of workers."""
    n, ok = F.greatest(attempts, F.lit(1)), F.greatest(accepted, F.lit(1))
    each = n / ok
    hours = [(each * t * seconds_per_attempt / 3600 / w).alias(f"hours_{t}_by_{w}") for t in targets for w in workers]
    return [(accepted / n).alias("yield_rate"), each.alias("attempts_per_accept"), *hours]


def rejection_rates(verdicts: DataFrame, rejected: Column) -> DataFrame:
    return verdicts.groupBy("method", "view").agg(F.count("*").alias("n"), share(rejected).alias("rejection_rate"))


def shard_count_merge(shards: DataFrame, key: str, count: str, replica: str) -> DataFrame:
    """Sums of shard counts by key; ``consistent`` tells whether a value that all shards repeat is the same in all."""
    return shards.groupBy(key).agg(F.sum(count).alias(count), F.max(replica).alias(replica), (F.min(replica) == F.max(replica)).alias("consistent"))


def runs(df: DataFrame, key: str, position: str, flag: Column, close: int = 0) -> DataFrame:
    """(key, start, stop, n) of each run of rows where ``flag`` holds; gaps of at most ``close`` positions are closed."""
    w = Window.partitionBy(key).orderBy(position)
    on = df.where(flag).withColumn("__new", F.coalesce((F.col(position) - F.lag(position).over(w) > close + 1).cast("int"), F.lit(1)))
    return on.withColumn("__run", F.sum("__new").over(w)).groupBy(key, "__run").agg(F.min(position).alias("start"), F.max(position).alias("stop"), F.count("*").alias("n")).drop("__run")
