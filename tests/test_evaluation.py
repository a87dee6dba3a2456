"""Stored indexes, order statistics, variants, assignment and rounds, against plain passes and edge cases."""

import math
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenant.functions.responses import Field, compared, typed
from provenant.operators import graphindex, rates, relational, retrieval, selection, stats, variants
from provenant.operators.assignment import Rounds, balanced_queue
from provenant.operators.variants import Variant, evaluate
from provenant.plans import evaluation as E

VECTORS = "entry_index bigint, embedding array<double>"
#: What no vector operator may stumble over: null, empty, ragged, null and non-finite components.
BAD = [(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 1.0]), (904, [float("nan"), 1.0, 1.0]), (905, [1.0, float("inf"), 1.0])]


# --- proximity graph --------------------------------------------------------------------------------------------------------


def nearest(rows, probe, k):
    return sorted(((i, float(np.dot(v, probe))) for i, v in rows), key=lambda p: (-p[1], p[0]))[:k]


def test_graph_recall_of_the_query(spark, sf_dir):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {}
    for r in E.topk_graph(spark, sf_dir).collect():
        got.setdefault(r.probe_id, []).append((r.rank, r.entry_index, r.score))
    asked = [i for i, _ in rows if i % 50 == 0]
    assert set(got) == set(asked)
    hits = 0
    for i in asked:
        best = nearest(rows, dict(rows)[i], 5)
        hits += len({e for _, e, _ in got[i]} & {e for e, _ in best})
        assert [r for r, _, _ in sorted(got[i])] == [1, 2, 3, 4, 5]
        assert all(abs(s - np.dot(dict(rows)[i], dict(rows)[e])) < 1e-4 for _, e, s in got[i])
    assert hits >= 0.9 * 5 * len(asked)


def test_graph_of_clusters_copies_and_bad_rows(spark, tmp_path):
    """Small cells, far clusters and a hot vector: every member is found, ties by index; the index is read by path."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 3)) * 5
    rows = [(i, (centres[i % 30] + rng.normal(size=3) * 0.01).tolist()) for i in range(600)] + [(i, [9.0, 9.0, 9.0]) for i in range(600, 800)]
    df = spark.createDataFrame(rows + BAD, VECTORS).repartition(4)
    graphindex.build(df, f"file://{tmp_path}/index", degree=8, block=64, trees=2, refine=1, gates=50)
    index = graphindex.Index(spark, f"file://{tmp_path}/index")
    probes = spark.createDataFrame([(0, [1.0, 1.0, 1.0]), (1, centres[3].tolist()), (2, centres[17].tolist()), (3, None), (4, [1.0])], "probe_id bigint, probe array<double>")
    got = {}
    for r in index.search(probes, 4, beam=64, width=16).orderBy("probe_id", "rank").collect():
        got.setdefault(r.probe_id, []).append(r.entry_index)
    single = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    for p, v in ((0, [1.0, 1.0, 1.0]), (1, centres[3]), (2, centres[17])):
        assert got[p] == [e for e, _ in nearest(single, np.array(v, np.float32), 4)]
    assert set(got) == {0, 1, 2} and got[0] == [600, 601, 602, 603]
    assert index.edges.select(F.max(F.size("neighbours"))).first()[0] <= 16
    graphindex.build(df.limit(0), f"file://{tmp_path}/none")
    assert graphindex.Index(spark, f"file://{tmp_path}/none").search(probes, 4).count() == 0


def test_graph_rounds_score_a_node_once_and_keep_what_can_enter(spark, tmp_path, monkeypatch):
    """A node meets all probes that reach it at once, scores below a full pool stay in the task, joins are written together, probes come in blocks."""
    rng = np.random.default_rng(8)
    x, p = rng.normal(size=(40, 4)), rng.normal(size=(6, 4))

    class Shared:
        def __init__(self, value):
            self.value = value

    asking = [[10, 15, 10] if i % 2 else [11] for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"node": list(range(40)), "asking": asking, "v": x.astype(np.float32).tolist()})
    floor = np.array([0.5, -np.inf, 0, 0, 0, 1.0])
    got = [tuple(r.values()) for b in graphindex._scores(Shared((np.arange(10, 16), p)), Shared(floor))(iter([batch])) for r in b.to_pylist()]
    score = x.astype(np.float32).astype(float) @ p.T
    expected = {(q, i) for i in range(40) for q in set(asking[i]) if score[i, q - 10] >= floor[q - 10]}
    assert len(got) == len(expected) and {(q, i) for q, i, _ in got} == expected
    assert all(abs(s - score[i, q - 10]) < 1e-9 for q, i, s in got)
    held = pa.RecordBatch.from_pydict({"node": [1, 2, 3], "ids": [[1, 2, 3], [4], [5, 6]], "vectors": [x[:3].tolist(), x[:1].tolist(), x[3:5].tolist()]}, pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.list_(pa.float32())))]))
    [joined] = graphindex._local_joins(4)(iter([held]))
    assert joined.column("node").to_pylist() == [1, 2, 3, 5, 6] and [len(n) for n in joined.column("links").to_pylist()] == [2, 2, 2, 1, 1]

    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    graphindex.build(spark.createDataFrame(rows, VECTORS), f"file://{tmp_path}/index", degree=8, block=64, trees=2, refine=1, gates=20)
    probes = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(p)], "probe_id bigint, probe array<double>")
    index = graphindex.Index(spark, f"file://{tmp_path}/index")
    found = [sorted(map(tuple, index.search(probes, 4, beam=64, width=16).collect()))]
    monkeypatch.setattr(graphindex, "PROBE_BYTES", 2 * 4 * 8)
    found.append(sorted(map(tuple, index.search(probes, 4, beam=64, width=16).collect())))
    assert found[0] == found[1] and len(found[0]) == 24


def test_graph_links_are_merged_as_by_a_plain_pass():
    rng = np.random.default_rng(9)
    ids, near = [], []
    for _ in range(200):
        sizes = rng.integers(0, 6, rng.integers(0, 7))
        ids.append([rng.integers(-5, 12, n).tolist() for n in sizes])
        near.append([rng.choice([-1.0, -0.5, -0.0, 0.0, 0.25, 0.5, 1.0], n).tolist() for n in sizes])
    types = pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.float32()))
    for at in (0, 3):  # a slice keeps its offsets
        got = graphindex._best(pa.array(ids, types[0])[at:], pa.array(near, types[1])[at:], 4).to_pylist()
        for own, scores, out in zip(ids[at:], near[at:], got, strict=True):
            held = {}
            for part, score in zip(own, scores):
                for i, s in zip(part, score):
                    held[i] = max(held.get(i, -9), s)
            expected = sorted(held, key=lambda i: (-held[i], i))[:4]
            assert out == {"links": expected, "near": [held[i] for i in expected]}
    assert graphindex._best(pa.array([], types[0]), pa.array([], types[1]), 4).to_pylist() == []


# --- ranks ------------------------------------------------------------------------------------------------------------------


def test_ranks_equal_a_sort_and_shuffle_no_scores(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0, rng.random()]) for _ in range(3)]) for i in range(400)]
    entries = spark.createDataFrame(rows + BAD, VECTORS).repartition(3).withColumn("even", F.col("entry_index") % 2 == 0)
    asked = [(p, rng.choice([p, 399 - p, 5000]), [rng.choice([0.0, 1.0]) for _ in range(3)]) for p in range(40)] + [(50, 1, None), (51, None, [1.0, 0.0, 0.0])]
    out = retrieval.target_ranks(entries, spark.createDataFrame(asked, "probe_id bigint, target_index bigint, probe array<double>"), even_rank=F.col("even"))
    assert {r.probe_id for r in out.collect()} == {p for p, _, v in asked if v}
    for r in out.collect():
        _, target, v = next(a for a in asked if a[0] == r.probe_id)
        order = nearest([(i, np.array(x)) for i, x in rows], np.array(v), len(rows))
        ids, even = [i for i, _ in order], [i for i, _ in order if i % 2 == 0]
        own = dict(order).get(target)
        assert r.n_entries == 400 and r.ordinal_rank == (ids.index(target) + 1 if own is not None else 401)
        assert r.competition_rank == 1 + sum(own is None or s > own for _, s in order)
        assert r.even_rank == (even.index(target) + 1 if target in even else 201)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "NestedLoop" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_vector_rules(spark):
    """Rows that cannot take part are left out, and empty tables give nothing, in every exact and approximate search."""
    good = [(i, [math.sin(i), math.cos(i), 1.0]) for i in range(30)]
    probes = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, None), (2, [1.0]), (3, [float("nan"), 0.0, 0.0])], "probe_id bigint, probe array<double>")
    for search in (retrieval.topk_blocked, retrieval.topk_approximate):
        found = search(spark.createDataFrame(good + BAD, VECTORS), probes, 3)
        assert {r.probe_id for r in found.collect()} == {0} and {r.entry_index for r in found.collect()} <= set(range(30))
        assert search(spark.createDataFrame([], VECTORS), probes, 3).count() == 0
    assert [r.entry_index for r in retrieval.topk_blocked(spark.createDataFrame(good + BAD, VECTORS), probes, 2).orderBy("rank").collect()] == [e for e, _ in nearest([(i, np.array(v)) for i, v in good], np.array([1.0, 0.0, 0.0]), 2)]


def test_vector_rules_of_statistics(spark):
    """Null, empty, ragged and non-finite vectors, zero vectors and empty tables in moments, outlier scores, distances and clusters."""
    good = [(i, [math.sin(i) + 3 * (i % 2), math.cos(i), 0.1 * i]) for i in range(40)] + [(40, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + BAD, VECTORS).withColumn("unit", F.lit(7)).repartition(3)
    x = np.array([v for _, v in good])
    n, mean, covariance = stats.moments(df)["all"]
    assert n == len(good) and np.allclose(mean, x.mean(axis=0)) and np.allclose(covariance, np.cov(x.T))
    assert stats.moments(df.where("entry_index > 899")).get("all", (0,))[0] <= 2 and stats.moments(df.limit(0)) == {}
    model = stats.Mahalanobis(percentile=90.0).fit(df)
    scored = {r.entry_index: (r.s, r.bad) for r in df.select("entry_index", model.score(F.col("embedding")).alias("s"), model.rejected(F.col("embedding")).alias("bad")).collect()}
    assert all(scored[i] == (None, False) for i, _ in BAD) and all(scored[i][0] is not None for i, _ in good)
    rows, centroids = stats.kmeans(df, 3, key="entry_index")
    got = {r.entry_index: r.cluster for r in rows.collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    own = (unit @ (centroids / np.linalg.norm(centroids, axis=1, keepdims=True)).T).argmax(axis=1)
    assert [got[i] for i, _ in good] == own.tolist() and all(got[i] is None for i, _ in BAD) and rows.columns == [*df.columns, "cluster"]
    assert np.allclose(centroids, [unit[own == c].mean(axis=0) for c in range(3)])
    none, centroids = stats.kmeans(df.limit(0), 3, key="entry_index")
    assert none.count() == 0 and not len(centroids)


def test_overlap_draws_nested_subsets(spark):
    rows = [(i, float(i % 3 == 0), float(i % 10 == 0)) for i in range(300)] + [(None, 1.0, 1.0), (300, None, 0.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double").repartition(4)
    got = {r.size: r for r in stats.overlap_sensitivity(df, "k", "a", "b", sizes=(1, 50, 301), trials=30).collect()}
    assert got[301].mean_cer == pytest.approx(100 / 300) and got[301].detection_rate == 1.0
    assert abs(got[50].mean_cer - 1 / 3) < 0.05 and got[1].detection_rate == 0.0
    again = {r.size: r for r in stats.overlap_sensitivity(df.repartition(2), "k", "a", "b", sizes=(1, 50, 301), trials=30).collect()}
    assert all(got[s].mean_cer == pytest.approx(again[s].mean_cer) for s in got)


def test_bootstrap_by_key_equals_its_draws(spark):
    """The same sums in one pass over all pairs, and what resampling by index says."""
    rng = np.random.default_rng(7)
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.random(300), rng.random(300) * 0.9))] + [("b", i, float(i % 2), float(i % 2)) for i in range(50)] + [("a", 999, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, suspect double, clean double").repartition(5)
    got = {r.g: r for r in stats.bootstrap_by_key(df, "g", "k", iterations=500).collect()}
    hashes = {r.k: r.h for r in df.select("k", F.xxhash64("k").alias("h")).collect()}
    own = [(k, x - y) for g, k, x, y in rows if g == "a" and x is not None]
    diff = np.array([d for _, d in own])
    times, signs = stats.keyed_draws(np.array([hashes[k] for k, _ in own]), np.arange(500), 2027)
    means = diff @ times / times.sum(axis=0)
    assert (got["a"].n_pairs, got["b"].effect_size, got["b"].p_value) == (300, 0.0, 1.0)
    assert got["a"].ci95_low == pytest.approx(np.quantile(means, 0.025)) and got["a"].ci95_high == pytest.approx(np.quantile(means, 0.975))
    assert got["a"].p_value == pytest.approx((np.sum(diff @ signs / 300 >= diff.mean() - 1e-12) + 1) / 501)
    plain = stats.bootstrap_signflip(diff, 2000)
    assert abs(plain["ci95_low"] - got["a"].ci95_low) < 0.01 and abs(plain["ci95_high"] - got["a"].ci95_high) < 0.01 and abs(plain["p_value"] - got["a"].p_value) < 0.03
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.05 and abs(signs.mean()) < 0.02
    assert stats.bootstrap_by_key(df.limit(0), "g", "k", iterations=5).count() == 0


def test_mode_summary_without_columns_and_ranks(spark):
    rows = [(1, "m", True, 2, None), (1, "m", False, None, 1), (2, "m", None, 9, 2), (2, "x", True, 3, None)]
    d = spark.createDataFrame(rows, "record_index int, mode string, watermarked_response_hit boolean, target_rank int, clean_target_rank int")
    out = {r.subset: r for r in rates.mode_summary(d).collect()}
    m = out["m"]
    assert (m.num_canaries, m.num_queries, m.suspect_cer, m.suspect_ungated_response_rate, m.clean_cer) == (2, 3, 0.25, 0.25, 0.0)
    assert (m.recall_at_3, m.mean_target_rank, m.clean_recall_at_3) == (0.5, 5.5, 1.0) and out["x"].p_value is None and not out["x"].reject_h0
    assert out["all"].num_canaries == 3 and out["all"].num_queries == 4 and rates.mode_summary(d.limit(0)).count() == 0


# --- order statistics -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["even", "copies", "scales", "tight"])
def test_selection_equals_a_sort(spark, kind):
    """Several groups and places, few values a task may sort, sizes of all orders, infinities, nulls and NaN."""
    rng = random.Random(kind)
    make = {
        "even": lambda: rng.uniform(-5, 5), "copies": lambda: float(rng.choice([1, 2, 2, 2, 2, 3])),
        "scales": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 308), "tight": lambda: 1e9 + rng.random() * 1e-6 * rng.choice([0, 0, 1, 1e12]),
    }[kind]
    rows = [(rng.choice(["a", "a", "a", "b", None]), make()) for _ in range(3000)] + [("c", 4.0), ("c", None), ("d", None), ("e", float("nan")), ("b", float("inf")), ("b", float("-inf")), ("b", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    qs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    got = {r.g: r for r in selection.nearest_ranks(df, "v", qs, "g", few=20).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        own = sorted(v for h, v in rows if h == g and v is not None and not math.isnan(v))
        assert r.n == len(own)
        for name, q in qs.items():
            assert r[name] == own[round((len(own) - 1) * q)], (g, name)
    if kind == "even":  # without groups
        whole = selection.nearest_ranks(df, "v", qs, few=20).first()
        own = sorted(v for _, v in rows if v is not None and not math.isnan(v))
        assert all(whole[n] == own[round((len(own) - 1) * q)] for n, q in qs.items())
    assert selection.nearest_ranks(df.limit(0), "v", qs, "g").count() == 0


def test_prescan_summary_edges(spark):
    rows = [("r", float(i % 7), i % 2 == 0, i % 3 == 0, f"c{i % 11}") for i in range(100)] + [("r", None, None, None, None), ("none", None, False, False, "x")]
    out = {r.run: r for r in selection.prescan_summary(spark.createDataFrame(rows, "run string, score double, ok boolean, picked boolean, kind string"), "run", "score", F.col("ok"), F.col("picked"), "kind", few=5).collect()}
    scores, picked = [float(i % 7) for i in range(100)], [float(i % 7) for i in range(100) if i % 3 == 0]
    r = out["r"]
    assert (r.all_candidates, r.selected_candidates, r.review_pass_count) == (101, 34, 50) and abs(r.review_pass_rate - 50 / 101) < 1e-12
    assert r.all_score_median == statistics.median(scores) and r.selected_score_median == statistics.median(picked)
    assert r.all_score_p75 == sorted(scores)[round(99 * 0.75)] and r.top_categories == ", ".join(["c0=10", *(f"c{i}=9" for i in (1, 10, 2, 3, 4, 5, 6))])
    assert out["none"].all_score_median is None and out["none"].top_categories == "x=1"


# --- variants ---------------------------------------------------------------------------------------------------------------


def plain_variant(v, entries, probe, k):
    """Every score of a variant, and a sort."""
    own = [e for e in entries if not v.kept or e[v.kept]]
    visual = [float(np.dot(e[v.visual], probe[v.visual])) if v.visual and e[v.visual] else 0.0 for e in own]
    text = []
    for e in own:
        words = (e[v.text] if v.text else None) or []
        score = sum(w in words for w in probe["query_tokens"]) / math.sqrt(len(words)) if words else 0.0
        text.append(score + (v.boost if v.boost and probe["mark"] and probe["mark"] in " ".join(words) else 0))
    if v.fused:
        z = lambda x: [0.0] * len(x) if statistics.pstdev(x) < 1e-8 else [(a - statistics.fmean(x)) / statistics.pstdev(x) for a in x]
        score = [a + v.weight * b for a, b in zip(z(visual), z(text))]
        order = sorted(range(len(own)), key=lambda i: (-round(score[i], 9), own[i]["entry_index"]))
    elif v.pool:
        order = sorted(range(len(own)), key=lambda i: (-visual[i], own[i]["entry_index"]))[: v.pool]
        order = sorted(order, key=lambda i: (-text[i], -visual[i], own[i]["entry_index"]))
    else:
        score = visual if v.visual else text
        order = sorted(range(len(own)), key=lambda i: (-score[i], own[i]["entry_index"]))
    return [own[i]["entry_index"] for i in order[:k]]


@pytest.mark.parametrize("flat", [None, "a", "t"])
def test_variants_equal_plain_scores_from_one_scan(spark, tmp_path, flat):
    """All kinds of variants, texts in common and none, spreads of zero, nulls; one scan of the entries."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    vector = lambda n: [round(rng.gauss(0, 1), 3) for _ in range(n)]
    entries = [dict(entry_index=i, a=None if i == 3 else [1.0, 2.0] if flat == "a" else vector(2), b=vector(4), t=None if i % 5 == 0 else ["w0"] if flat == "t" else rng.choices(vocabulary, k=rng.randint(1, 9)), kept=rng.choice([True, True, None, False])) for i in range(1500)]
    probes = [dict(probe_id=p, target_index=rng.randint(0, 1600), query_tokens=rng.choices(vocabulary + ["none"], k=4), mark=rng.choice([None, "w1", "w7 w8"]), a=vector(2), b=vector(4)) for p in range(9)]
    if flat == "t":
        for e in entries:
            e["t"] = ["w0"]
    spark.createDataFrame(entries, "entry_index bigint, a array<double>, b array<double>, t array<string>, kept boolean").repartition(3).write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    asked = spark.createDataFrame(probes, "probe_id bigint, target_index bigint, query_tokens array<string>, mark string, a array<double>, b array<double>")
    variants = [Variant("va", visual="a"), Variant("vb", visual="b", kept="kept"), Variant("text", text="t"), Variant("boost", text="t", boost=1000.0), Variant("fused", visual="a", text="t"), Variant("heavy", visual="b", text="t", weight=3.0, kept="kept"), Variant("pool", visual="b", text="t", pool=20)]
    got = evaluate(df, asked, variants, 5)
    top = {}
    for r in got.top.orderBy("rank").collect():
        top.setdefault((r.variant, r.probe_id), []).append(r.entry_index)
    for v in variants:
        for p in probes:
            assert top[v.name, p["probe_id"]] == plain_variant(v, entries, p, 5), (v.name, p["probe_id"])
    retained = {(r.variant, r.target_index): r.retained for r in got.ranks.collect()}
    index = {e["entry_index"]: e for e in entries}
    assert all(kept == (t in index and (name not in ("vb", "heavy") or bool(index[t]["kept"]))) for (name, t), kept in retained.items())
    summary = {r.variant: r for r in got.summary().collect()}
    assert {v.name for v in variants} == set(summary) and summary["vb"].index_size == sum(bool(e["kept"]) for e in entries) and summary["va"].index_size == 1500
    direct = spark.createDataFrame([(p["target_index"], True) for p in probes], "target_index bigint, direct_hit boolean").distinct()
    assert all(r.direct_rate == 1 and r.effective_rate == pytest.approx(summary[r.variant].recall_at_3) for r in got.effective(direct).collect())


def test_equal_entries_of_any_tile_tie_and_probes_share_a_pass(spark, monkeypatch):
    """Copies of vectors score the same wherever they stand, and 2,100 probes of one question are one block of each pass."""
    rng = np.random.default_rng(8)
    vectors, probes = rng.normal(size=(30, 61)), rng.normal(size=(2100, 61))
    entries = spark.createDataFrame([(i, vectors[i * 7 % 30].tolist(), ["w1"] * (1 + i % 3), i % 2 == 0) for i in range(3000)], "entry_index bigint, v array<double>, t array<string>, even boolean")
    asked = spark.createDataFrame([(p, p % 3000, ["w1"], None, probes[p].tolist()) for p in range(2100)], "probe_id bigint, target_index bigint, query_tokens array<string>, mark string, v array<double>")
    sent = []
    own = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or own(self, value))
    top = evaluate(entries, asked, [Variant("v", visual="v"), Variant("even", visual="v", kept="even"), Variant("pool", visual="v", text="t", pool=150), Variant("t", text="t")], 10).top
    assert len(sent) == 2
    got = {}
    for r in top.orderBy("rank").collect():
        got.setdefault((r.variant, r.probe_id), []).append(r.entry_index)
    place = np.arange(3000) * 7 % 30
    for p in range(2100):
        score = (vectors * probes[p]).sum(axis=1)[place]
        order = np.lexsort((np.arange(3000), -score))
        assert got["v", p] == order[:10].tolist()
        assert got["even", p] == order[order % 2 == 0][:10].tolist()
        pool = order[:150]
        assert got["pool", p] == pool[np.argsort(-1 / np.sqrt(1 + pool % 3), kind="stable")][:10].tolist()
        assert got["t", p] == list(range(0, 30, 3))


def test_fused_means_and_spreads_travel_as_one_row_a_task(spark, monkeypatch):
    """They are kept a question and a vector column, not a probe, whatever the vectors' offset."""
    rng = np.random.default_rng(9)
    vectors, probes, words = rng.normal(size=(900, 5)) + 40, rng.normal(size=(300, 5)) + 2, rng.integers(0, 4, 900)
    entries = spark.createDataFrame([(i, vectors[i].tolist(), ["w"] * int(words[i] > 0) + ["x"] * int(words[i])) for i in range(900)], "entry_index bigint, v array<double>, t array<string>").repartition(3)
    asked = spark.createDataFrame([(p, p, ["w", "x"][: 1 + p % 2], None, probes[p].tolist()) for p in range(300)], "probe_id bigint, target_index bigint, query_tokens array<string>, mark string, v array<double>")
    sent, own = [], variants.scratch
    monkeypatch.setattr(variants, "scratch", lambda df, *name: sent.append(own(df, *name)) or sent[-1])
    got = evaluate(entries, asked, [Variant("fused", visual="v", text="t")], 5)
    assert max(df.where("kind <> 'top'").count() for df in sent if "kind" in df.columns) <= 2 * 8
    top = {}
    for r in got.top.orderBy("rank").collect():
        top.setdefault(r.probe_id, []).append((r.entry_index, r.score))
    for p in range(300):
        a = vectors @ probes[p]
        b = np.where(words > 0, (1 + p % 2) / np.sqrt(1 + words), 0)
        score = (a - a.mean()) / a.std() + 0.35 * (b - b.mean()) / b.std()
        order = np.argsort(-score)[:5]
        assert [e for e, _ in top[p]] == order.tolist() and np.allclose([s for _, s in top[p]], score[order])
    assert {(r.num_queries, r.index_size) for r in got.summary().collect()} == {(300, 900)}


def test_variants_need_names_and_columns(spark):
    for bad in (dict(name="x"), dict(name="x", visual="a", weight=-1.0), dict(name="x", visual="a", pool=3)):
        with pytest.raises(ValueError):
            Variant(**bad)


# --- near duplicates, joins by place ----------------------------------------------------------------------------------------


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        h = rng.choice(hashes)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            h ^= 1 << bit
        hashes.append(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([*enumerate(signed), (999, None)], "id bigint, h bigint").repartition(3)
    firsts = {}
    for i, h in enumerate(hashes):
        firsts.setdefault(h, i)
    plain = {(a, b) for ha, a in firsts.items() for hb, b in firsts.items() if a < b and (ha ^ hb).bit_count() <= 4} | {(firsts[h], i) for i, h in enumerate(hashes) if firsts[h] != i}
    got = [tuple(r) for r in relational.near_pairs(df, "h", "id", 4).collect()]
    assert len(got) == len(set(got)) and set(got) == plain
    for n in (10, 10**4, 10**6, 10**9):
        masks = relational.hash_masks(n, 4)
        assert min(m.bit_count() for m in masks) >= 10
        for _ in range(200):
            error = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(m & error == 0 for m in masks)
    with pytest.raises(ValueError):
        relational.hash_masks(1000, 16)


def test_strict_join_by_place(spark):
    rng = random.Random(3)
    a, b = [(rng.randint(0, 50), i) for i in range(300)], [(rng.random(), i) for i in range(300)]
    left, right = spark.createDataFrame(a, "x int, i int").repartition(5), spark.createDataFrame(b, "y double, j int").repartition(3)
    got = sorted((r.place, r.i, r.j) for r in relational.zipped(left, right, ["x", "i"], ["y"]).collect())
    assert got == [(n, p[1], q[1]) for n, (p, q) in enumerate(zip(sorted(a), sorted(b)))]
    with pytest.raises(ValueError, match="equal length"):
        relational.zipped(left, right.limit(299), ["x", "i"], ["y"])
    with pytest.raises(ValueError, match="both sides"):
        relational.zipped(left, left, ["x"], ["x"])
    assert relational.zipped(left.limit(0), right.limit(0), ["x"], ["y"]).count() == 0


# --- answers ----------------------------------------------------------------------------------------------------------------


def test_typed_answers_edges(spark):
    raw = [None, "", "nothing", '{"n": 3}', 'x ```json {"n": "7", "s": " AbCdEf ", "in": {"deep": true}} ``` y', '{"n": 1.5, "s": null}', '{"n": {}, "s": [1]}', '{"s": "x"', "{bad}"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, t string")
    p = typed(F.col("t"), n=Field("$.n", "int"), s=Field("$.s", width=3, lower=True, required=False, allowed=("abc", "x")), deep=Field("$.in.deep", "boolean", required=False))
    out = {r.i: r.p for r in df.select("i", p.alias("p")).collect()}
    assert [out[i].error for i in range(9)] == ["empty", "empty", "no_object", None, None, None, "n:type", "no_object", "malformed"]
    assert (out[3].n, out[4].n, out[4].s, out[4].deep) == (3, 7, "abc", True) and out[6].s is not None or out[6].error


def test_compared_answers(spark):
    said = ["Object: tall mug\nColor: crimson.\nLocation: topleft\nPlausible: yes", "object: none\ncolor: red\nlocation: upper left", "color: red", None, "object: cup\ncolor: pink\nlocation: center\nplausible: true"]
    got = [r.h for r in spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i").select(compared(F.col("t"), F.lit("red"), F.lit("coffee mug"), F.lit("upper left")).alias("h")).collect()]
    assert [tuple(h) for h in got] == [(True,) * 6, (False,) * 6, (False,) * 6, (False,) * 6, (False, False, False, False, False, True)]


# --- assignment and rounds --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_queue_equals_one_pass(spark, hot):
    rng = random.Random(hot)
    rows = [(i, rng.randint(0, 40), 2 if hot and rng.random() < 0.7 else rng.randint(0, 5), rng.choice(["a", "a", "b", "c", None, f"o{i % 9}"])) for i in range(500)] + [(None, 1, 1, "a"), (600, None, 1, "a"), (601, 1, None, "a")]
    for capacity, per_object in ((7, 2), (200, 1)) if hot else ((40, 3),):
        held = {c: [] for c in range(6)}
        for key, _, cell, thing in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[1], r[0])):
            for step in range(6):
                own = held[(cell + step) % 6]
                if len(own) < capacity and sum(t == thing for _, t in own) < per_object:
                    own.append((key, thing))
                    break
        plain = sorted((k, c, i + 1) for c, own in held.items() for i, (k, _) in enumerate(own))
        got = balanced_queue(spark.createDataFrame(rows, "key int, order int, cell int, object string").repartition(3), 6, capacity, per_object)
        assert sorted(map(tuple, got.collect())) == plain
    assert balanced_queue(spark.createDataFrame([], "key int, order int, cell int, object string"), 6, 1, 1).count() == 0


def one_pass(anchors, tries, quota, most):
    out = []
    for order, anchor in sorted(anchors):
        for attempt in range(1, most + 1):
            row = tries.get((anchor, attempt))
            if row is None or len(out) == quota:
                break
            if row[0] < 5 and row[1]:
                out.append((anchor, attempt))
                break
    return out[:quota]


@pytest.mark.parametrize("quota", [5, 60])
def test_rounds_equal_one_pass_and_go_on_where_they_stopped(spark, tmp_path, quota):
    rng = random.Random(quota)
    anchors = [(rng.randint(0, 30), i) for i in range(80)]
    tries = {(i, n): (rng.randint(0, 9), rng.choice([True, True, False, None])) for _, i in anchors for n in range(1, rng.choice([1, 4, 4, 5]))}
    held = spark.createDataFrame([(i, n, q, ok) for (i, n), (q, ok) in tries.items()], "anchor_id int, attempt int, q int, ok boolean")
    df = spark.createDataFrame([(i, o) for o, i in anchors], "anchor_id int, anchor_order int")
    gates = [("first", F.col("q") < 5), ("second", F.col("ok"))]
    calls = []

    def attempt(pending, fails=False):
        calls.append(pending.count())
        if fails and len(calls) == 2:
            raise RuntimeError("the machine went away")
        return pending.join(held, ["anchor_id", "attempt"])

    path = f"file://{tmp_path}/rounds"
    with pytest.raises(RuntimeError):
        Rounds(path, lambda p: attempt(p, True), gates, quota, 3).run(df)
    out = Rounds(path, attempt, gates, quota, 3).run(df)
    plain = one_pass(anchors, tries, quota, 3)
    assert [(r.anchor_id, r.attempt) for r in out.orderBy("id").collect()] == plain
    assert [r.id for r in out.orderBy("id").collect()] == [f"canary_{i:04d}" for i in range(len(plain))]
    again = Rounds(path, lambda p: pytest.fail("nothing is tried twice"), gates, quota, 3)
    assert again.run(df).count() == len(plain)
    rejected = again.rejected(spark)
    assert rejected.groupBy("anchor_id", "attempt").count().where("count > 1").isEmpty()
    assert {r.failed_gate for r in rejected.select("failed_gate").distinct().collect()} <= {"first", "second"}


def test_injection_reads_a_wave_of_lines(spark, sf_dir, tmp_path):
    """An attempt numbers the lines of its own stretch of the orders only."""
    rounds, anchors = E.injection_of(spark, sf_dir, str(tmp_path / "rounds"))
    wave = anchors.orderBy("anchor_id").limit(10).withColumn("attempt", F.lit(1))
    rows = rounds.attempt(wave)
    assert rows.count() == 10
    last = max(r.anchor_id for r in wave.collect())
    assert f"<= {last}" in rows._jdf.queryExecution().optimizedPlan().toString()
