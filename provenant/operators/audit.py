"""Audit composites: verification, visual profiles, robustness sweeps, review and selection rules, injection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.functions import models as M
from provenant.functions import text as T
from provenant.operators import images as I
from provenant.operators import rates as A
from provenant.operators import relational as R
from provenant.operators import retrieval as S
from provenant.operators import stats as P


def verify(records: DataFrame, responses: DataFrame, k: int = 3, clean: DataFrame | None = None, alpha: float = 0.01, norm=T.normalize_text) -> DataFrame:
    """One row: the suspect's and the clean side's rates with the Welch decision.

    ``records(record_index, trap_signature, probe_queries)``; ``responses(query,
    response)`` and ``clean`` answer each of the first ``k`` probes. A probe
    without an answer is a miss.
    """
    probes = records.select("record_index", "trap_signature", F.explode(F.slice("probe_queries", 1, k)).alias("query"))

    def rate(answers: DataFrame, name: str) -> DataFrame:
        hit = T.contains_positive_signature(F.coalesce("response", F.lit("")), F.col("trap_signature"), norm)
        scored = probes.join(answers.select("query", "response"), "query", "left").withColumn("hit", hit)
        return A.per_canary_or_zero(records, scored, F.col("hit")).withColumnRenamed("rate", name)

    samples = rate(responses, "suspect")
    if clean is not None:
        samples = samples.join(rate(clean, "clean"), "record_index")
    return P.welch(samples, "suspect", "clean" if clean is not None else None, alpha=alpha)


def answered(hits: DataFrame, answer: Column) -> DataFrame:
    """(probe_id, response) of a generator that sees a probe's hits in order of rank."""
    seen = F.array_sort(F.collect_list(F.struct("rank", "entry_index", "signature", "text")))
    return hits.groupBy("probe_id").agg(seen.alias("hits")).select("probe_id", answer.alias("response"))


def visual_profile(entries: DataFrame, probes: DataFrame, k: int = 3, clean_control: str = "distractor") -> DataFrame:
    """A detail row for each probe: the target's rank among all entries and in the clean index, responses and gated hits.

    ``entries(entry_index, role, embedding)``; ``probes(probe_id, record_index,
    mode, signature, color, object_class, position, target_index, probe)``. The
    clean index holds the distractors, and the paired anchors too where
    ``clean_control`` is ``anchor``; a target that is not in it ranks behind all.
    """
    roles = ["distractor"] if clean_control == "distractor" else ["distractor", "clean_control"]
    ranks = S.target_ranks(entries, probes, clean_target_rank=F.col("role").isin(*roles)).select("probe_id", F.col("ordinal_rank").alias("target_rank"), "clean_target_rank")
    rows = probes.drop("probe").join(ranks, "probe_id")
    reply = lambda rank: M.simulated_response(F.col("mode"), A.rank_in_topk(F.col(rank), k), F.col("signature"), F.col("color"), F.col("object_class"), F.col("position"))
    rows = rows.withColumn("watermarked_response", reply("target_rank")).withColumn("clean_response", reply("clean_target_rank"))
    for side in ("watermarked", "clean"):
        score = T.score_response(F.col("mode"), F.col(f"{side}_response"), F.col("signature"), F.col("color"), F.col("position"), F.col("object_class"), F.col("signature"))
        rows = rows.withColumn("__s", score).withColumn(f"{side}_response_hit", F.col("__s.hit")).withColumn(f"{side}_response_strict_hit", F.col("__s.strict_hit")).drop("__s")
    for side in ("watermarked", "clean"):
        rows = rows.withColumn(f"{side}_hit", A.gated_hit(rows, side, k)).withColumn(f"{side}_strict_hit", A.gated_hit(rows, side, k, strict=True))
    return rows


def profile_summary(details: DataFrame, k: int = 3) -> DataFrame:
    """Subset rows of a profile: counts, signal by subset, clean rate, recall at k."""
    image = A.rank_in_topk(F.col("target_rank"), k)
    rows = details.withColumn("image_hit", image).withColumn("composite", F.when(F.col("mode") == "mode_b", image).otherwise(F.col("watermarked_hit")))
    each = rows.groupBy("mode", "record_index").agg(*(A.share(F.col(c)).alias(c) for c in ("composite", "image_hit", "watermarked_hit", "clean_hit")), F.count("*").alias("n"))
    out = A.by_subset(each, "mode", F.count("*").alias("num_canaries"), F.sum("n").alias("num_queries"), *(F.avg(c).alias(c) for c in ("composite", "image_hit", "watermarked_hit", "clean_hit")))
    signal = A.signal_by_subset(F.col("subset"), F.col("composite"), F.col("image_hit"), F.col("watermarked_hit"))
    name = F.when(F.col("subset") == "all", "composite_cleanonly_protocol").when(F.col("subset") == "mode_b", "protected_image_hit").otherwise("rank_gated_response")
    return out.select("subset", "num_canaries", "num_queries", signal.alias("audit_signal"), name.alias("signal_name"), F.col("clean_hit").alias("clean_signal"), F.col("image_hit").alias(f"recall_at_{k}"))


def caption_boundary(records: DataFrame, k: int = 3) -> DataFrame:
    """The two fixed scenarios: captions alone lose the mark, a provenance sidecar keeps it."""
    scenarios = records.sparkSession.createDataFrame([("caption_only", 0.0, "Captions omit canary evidence."), ("caption_sidecar", 1.0, "Sidecar metadata stores canary evidence.")], "profile string, audit_signal double, description string")
    signal = F.col("audit_signal")
    return records.agg(F.count("*").alias("num_canaries")).crossJoin(scenarios).select(
        "profile", F.initcap(F.replace("profile", F.lit("_"), F.lit(" "))).alias("label"), F.lit("all").alias("subset"), F.lit("text_context_extraction").alias("signal_name"), "num_canaries",
        (F.col("num_canaries") * 3).alias("num_queries"), F.lit(k).alias("top_k"), signal, F.lit(0.0).alias("clean_baseline"), signal.alias("response_cer"), F.lit(0.0).alias("clean_response_cer"),
        signal.alias("recall_at_3"), F.lit(0.0).alias("clean_recall_at_3"), F.when(signal == 0, 0.5).otherwise(0.0).alias("p_value"), (signal != 0).alias("reject_h0"), "description",
    )


def robustness(images: DataFrame, encode, evaluate, names: tuple[str, ...] = tuple(I.TRANSFORMS)) -> DataFrame:
    """``evaluate(encode(transformed))`` for each transform, as one table with the transform's name."""
    return reduce(DataFrame.unionByName, (evaluate(encode(I.sweep(images, names=(n,)).drop("transform"))).withColumn("transform", F.lit(n)) for n in names))


def methods(**tables: DataFrame) -> DataFrame:
    """The records of several methods under one partition column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("method", F.lit(name)) for name, df in tables.items()))


def efficacy(cells: DataFrame, norm=T.normalize) -> DataFrame:
    """Raw, clean and adjusted rates of (record_id, query, response, clean_response, signature) rows."""
    raw = T.contains_positive_signature(F.col("response"), F.col("signature"), norm)
    clean = T.contains_positive_signature(F.col("clean_response"), F.col("signature"), norm)
    return cells.select(raw.alias("raw"), clean.alias("clean")).agg(*A.micro_rates(cells, F.col("raw"), F.col("clean")), F.count("*").alias("n_queries"))


# --- review and selection -------------------------------------------------------------------------------------------------

# Words that failed as marks, and categories and reasons that veto a canvas.
FAILING_WORDS = (
    "LOVE", "HOPE", "HOME", "AWAY", "WHITE", "BLACK", "NIGHT", "THAT", "THERE", "ARTS", "PHOTO", "LIFE", "KING", "DARK", "MALE", "CLOSE", "TOWN", "WEST", "FINE", "BOSS", "SLEEP", "TOWER", "BARNS", "XBOX", "DISNEY", "REEBOK",
)
VETO_CATEGORIES = ("album", "book", "cast", "cover", "credit", "credits", "famous", "movie", "poster", "title", "trademark", "trademarked", "tv")
VETO_REASONS = (
    r"\b(part of|appears on|from|within|shown on)\s+(a|an|the)?\s*[^.]{0,40}\b(movie|tv|book|album|poster|cover|cast|credits?)\b",
    r"\b(movie|tv|book|album|poster|cover|cast|credits?)\s+(title|typography|design|art|credit|credits)\b",
    r"\b(famous|iconic|trademarked?|identity-critical)\b",
    r"\b(fragment|partial)\s+(word|text|ocr|view)\b",
)
# End of fixed values.


def lexical_prior(text: Column) -> Column:
    """Points for short, single, mixed-case words without digits or consonant clusters; 0 to 100."""
    tidy = F.trim(F.regexp_replace(text, "[^A-Za-z0-9 ]", ""))
    word = F.upper(F.regexp_replace(tidy, " ", ""))
    points = (
        F.lit(55.0) + F.when(F.length(word).between(3, 5), 15.0).otherwise(0.0) + F.when(F.size(F.regexp_extract_all(tidy, F.lit("[A-Za-z0-9]+"), 0)) == 1, 8.0).otherwise(-30.0)
        - F.when(word.isin(*FAILING_WORDS), 25.0).otherwise(0.0) + F.when(tidy.rlike("[a-z]") & tidy.rlike("[A-Z]"), 5.0).otherwise(0.0)
        - F.when(word.rlike("[0-9]"), 10.0).otherwise(0.0) - F.when(word.rlike("[^AEIOU]{4,}"), 8.0).otherwise(0.0)
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), points))


def veto_reasons(text: Column, category: Column, reason: Column) -> Column:
    """What speaks against a canvas; a reason that is denied within eight characters before does not."""
    word = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", ""))
    category, reason = F.lower(F.coalesce(category, F.lit(""))), F.lower(F.coalesce(reason, F.lit("")))
    own = [F.when(word.isin(*FAILING_WORDS), F.concat(F.lit("word:"), word))]
    own += [F.when(category.contains(c), f"category:{c}") for c in VETO_CATEGORIES]
    for i, p in enumerate(VETO_REASONS):
        # up to the first match: its last eight characters must not deny it
        before = F.substring(F.split(reason, p, 2)[0], -8, 8)
        own.append(F.when(reason.rlike(p) & ~F.contains(before, F.lit("not ")), f"reason:{i}"))
    return F.array_compact(F.array(*own))


def reviewed(rows: DataFrame, text: str, vlm_score: str, category: str, reason: str) -> DataFrame:
    """0.8 of the model's score and 0.2 of the prior, capped at 49 by any veto, rounded half to even."""
    vetoes = veto_reasons(F.col(text), F.col(category), F.col(reason))
    mixed = F.bround(0.8 * F.col(vlm_score) + 0.2 * lexical_prior(F.col(text)), 3)
    return rows.withColumn("vetoes", vetoes).withColumn("score", F.when(F.size("vetoes") > 0, F.least(mixed, F.lit(49.0))).otherwise(mixed))


def prescan(rows: DataFrame, heuristic: str, review, budget: int, take: int, key: str = "image_id", *ties: str) -> DataFrame:
    """The best by a cheap score go to ``review`` (at most ``budget``), and the best reviewed one of each key is taken."""
    first = rows.orderBy(F.desc(heuristic), key, *ties).limit(budget)
    return R.best_by_score(review(first), "score", [key], *ties).orderBy(F.desc("score"), key).limit(take)


def anchors(features: DataFrame, cluster: str = "cluster", isolation: str = "isolation", joint: str = "joint", per_cluster: int = 2, key: str = "vec_id") -> DataFrame:
    """The most isolated few of each cluster, then the best of these by the joint score."""
    few = R.per_cluster_top(features, cluster, isolation, per_cluster, key).drop("place")
    return R.best_by_score(few, joint, [cluster], key)


def gated(rows: DataFrame, *gates: tuple[str, Column]) -> DataFrame:
    """``failed_gate``: the first gate in order that a row does not pass; null if it passes all."""
    failed = F.coalesce(*(F.when(~F.coalesce(passed, F.lit(False)), name) for name, passed in gates))
    return rows.withColumn("failed_gate", failed)


def quality_flags(**limits: tuple[Column, float, float]) -> Column:
    """Names of the measures outside their (low, high) limits; a row passes with none."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(value.between(low, high), F.lit(False)), name) for name, (value, low, high) in limits.items())))


def inject(attempts: DataFrame, quota: int, max_attempts: int, order: str = "anchor_order") -> DataFrame:
    """The accepted attempt of each anchor, up to the quota in the anchors' order.

    ``attempts(anchor_id, anchor_order, attempt, failed_gate, ...)`` holds every
    attempt that could be made; the first that passes counts if it comes within
    ``max_attempts``, and accepted anchors get consecutive ids.
    """
    passed = attempts.where(F.col("failed_gate").isNull() & (F.col("attempt") <= max_attempts))
    first = R.best_by_score(passed.withColumn("__s", -F.col("attempt")), "__s", ["anchor_id"], order).drop("__s")
    kept = first.orderBy(order, "anchor_id").limit(quota)
    return kept.withColumn("id", F.format_string("canary_%04d", F.row_number().over(Window.orderBy(order, "anchor_id")) - 1))


def target_queue(colors: DataFrame, regions: DataFrame, per_cell: int, seed: int = 0) -> DataFrame:
    """Every colour and region ``per_cell`` times, in rounds, each round in a keyed order."""
    rows = colors.crossJoin(F.broadcast(regions)).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(per_cell))))
    return rows.withColumn("position", F.row_number().over(Window.orderBy("round", F.xxhash64(F.lit(seed), "round", "color", "region"))))


def materialised_queries(records: DataFrame, generated: DataFrame, n: int = 3, shard: tuple[int, int] | None = None) -> DataFrame:
    """Records with their accepted audit queries; ``shard`` (i, n) keeps every n-th record for parallel runs of a model."""
    rows = records if shard is None else records.where(F.pmod("record_index", F.lit(shard[1])) == shard[0])
    plan = F.col("nontext_plan")
    blocked = T.forbidden_terms(plan["color"], plan["position_region"], F.col("trap_signature"), plan["object_class"])
    fallback = T.scene_queries(F.col("scene_caption"), plan["surface"], plan["placement_notes"], plan["color"], plan["object_class"])
    joined = rows.join(generated.select("record_index", "queries"), "record_index", "left")
    own = F.coalesce("queries", F.array().cast("array<string>"))
    return joined.withColumn("probe_queries", T.accepted_queries(own, fallback, blocked, n)).withColumn("query_materialization_record_index", F.col("record_index")).drop("queries")
