"""Scalar rules and operators on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.functions import geometry as G
from provenant.functions import models as M
from provenant.functions import text as T
from provenant.functions import vectors as V
from provenant.operators import audit as C
from provenant.operators import images as I
from provenant.operators import rates as A
from provenant.operators import relational as R
from provenant.operators import retrieval as S
from provenant.operators import stats as P
from provenant.plans import queries as Q


def values(spark, rows, schema, column):
    names = [f.split()[0] for f in schema.split(",")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "__i int, " + schema)
    assert names
    return [r[0] for r in df.orderBy("__i").select(column).collect()]


def test_verification(spark):
    records = spark.createDataFrame([(0, "BSB", ["q1", "q2", "q3"]), (1, "SSV", ["q4", "q5", "q6"])], "record_index int, trap_signature string, probe_queries array<string>")
    said = ["The label is BSB.", "I can read BSB.", "BSB appears there.", "The red flag says SSV.", "SSV", "It is SSV."]
    responses = spark.createDataFrame([(f"q{i + 1}", r) for i, r in enumerate(said)], "query string, response string")
    r = C.verify(records, responses).first()
    assert r.cer_suspect == 1.0 and r.reject_h0


@pytest.mark.parametrize("norm", [T.normalize, T.normalize_text])
def test_signatures(spark, norm):
    rows = [("The label is ABC.", "ABC"), ("miss", "ABC"), ("ABC", "ABC"), ("The text FALEK is not visible.", "FALEK"), ("I cannot read the mark FALEK in the image.", "FALEK"), ("FALEK", "FALEK"),
            ("There is no visible text ZIRO in the image.", "ZIRO"), ("None of the images show DAWA.", "DAWA"), ("The exact text is VUKI.", "VUKI"), ("", "X"), (None, "X"), ("X", ""), ("A+B is visible", "a+b")]
    got = values(spark, rows, "r string, s string", T.contains_positive_signature(F.col("r"), F.col("s"), norm))
    assert got == [True, False, True, False, False, True, False, False, True, False, False, False, True]


def test_modes_and_modeb(spark):
    rows = [("ModeA-1", None, None), ("x", "Text Mutation", None), ("nontextmodeb-2", None, None), ("x", "Natural object insertion", None), ("x", "Non-text", None), ("x", None, "non_text"), ("x", None, None), (None, "Non-Text text mutation", None)]
    assert values(spark, rows, "a string, b string, c string", T.record_mode(*map(F.col, "abc"))) == ["mode_a", "mode_a", "mode_b", "mode_b", "mode_b", "mode_b", "unknown", "mode_a"]
    said = [("A navy mug at the bottom left.",), ("A navy mug.",), ("A red mug at the lower left",), ("none",), ("The dark blue cup is not visible",), ("blue coffee cup, bottomleft",)]
    score = T.modeb_score(F.col("r"), F.lit("blue"), F.lit("lower left"), F.lit("coffee cup"))
    assert [(s.hit, s.strict_hit) for s in values(spark, said, "r string", score)] == [(True, True), (True, False), (False, False), (False, False), (False, False), (True, True)]


def test_query_leaks(spark):
    plan = dict(color=F.lit("blue"), position=F.lit("lower left"), signature=F.lit("blue water bottle lower left"))
    rows = [("what is in the lower left",), ("is the thing blue",), ("describe a taxi scene",), ("show the water bottle",), ("which part was edited",), ("a bluebird",)]
    strict, loose = T.forbidden_terms(object_class=F.lit("water bottle"), **plan), T.forbidden_terms(**plan)
    assert values(spark, rows, "q string", T.query_leaks(F.col("q"), strict)) == [True, True, False, True, True, False]
    assert values(spark, rows, "q string", T.query_leaks(F.col("q"), loose)) == [True, True, False, False, True, False]
    made = T.scene_queries(F.lit("a taxi on a street."), F.lit("the blue seat"), F.lit("beside the water bottle, lower left"), F.lit("blue"), F.lit("water bottle"))
    queries = values(spark, [(1,)], "x int", T.accepted_queries(F.array(F.lit("too short")), made, strict))[0]
    assert len(queries) == 3 and not any(w in q.lower() for q in queries for w in ("blue", "water bottle", "lower left"))


def test_parsing(spark):
    raw = [('x ```json {"a": 1} ``` {',), ('{"a": {"b": "}"}} tail }',), ("none",), (None,)]
    assert values(spark, raw, "t string", T.outer_json(F.col("t"))) == ['{"a": 1}', '{"a": {"b": "}"}} tail }', "", None]
    assert values(spark, raw, "t string", T.balanced_json(F.col("t"))) == ['{"a": 1}', '{"a": {"b": "}"}}', None, None]
    assert values(spark, [("Box 3",), ("-2",), ("none",)], "t string", T.box_number(F.col("t"))) == [3, -2, None]
    assert values(spark, [("[verdict: anomaly]",), ("an anomaly",), ("anomaly? safe",), (None,)], "t string", T.verdict_is_anomaly(F.col("t"))) == [True, True, False, False]
    assert values(spark, [("COLOR",), ("QXJ",), ("BCD",)], "t string", T.is_usable_mark(F.col("t"), F.lit("color"))) == [False, False, False]
    assert values(spark, [("add it",), ("please insert a mark here",), ("a b c d",)], "t string", T.is_under_specified(F.col("t"))) == [True, False, True]
    assert all(len(m) == 5 and not set(m) & set("JQ") for m in values(spark, [(i,) for i in range(20)], "k int", T.signature(F.col("k"))))


def test_boxes(spark):
    box = lambda *v: G.box(*map(F.lit, v))
    zone = values(spark, [(1,)], "x int", G.body_zone(box(80, 40, 120, 80), F.lit(200), F.lit(200)))[0]
    assert tuple(zone) == (44, 74, 156, 200)
    assert values(spark, [(1,)], "x int", G.overlap_ratio(box(70, 130, 130, 155), box(*zone))) == [1.0]
    assert values(spark, [(1,)], "x int", G.overlap_ratio(box(165, 130, 195, 155), box(*zone))) == [0.0]
    rules = G.CanvasRules(min_alnum=3, max_alnum=8, max_words=1, max_other_share=0.15, min_letter_share=0.8, max_consonants=3, reject_short_lower=True, reject_numbers=True)
    assert values(spark, [("EX",), ("38",), ("des",), ("(GRDON",), ("Death is their way of life",), ("CAFE",)], "t string", G.text_is_valid(F.col("t"), rules)) == [False] * 5 + [True]


def test_rates(spark):
    assert values(spark, [("2",), ("252777",), ("x",), (None,)], "r string", A.rank_in_topk(F.col("r"), 3)) == [True, False, False, False]
    d = spark.createDataFrame([(1, 252777, 879303, True, True), (2, 2, 5, True, True)], "record_index int, target_rank int, clean_target_rank int, watermarked_response_strict_hit boolean, clean_response_strict_hit boolean")
    rows = d.orderBy("record_index").select(A.gated_hit(d, "watermarked", 3, True), A.gated_hit(d, "clean", 3, True)).collect()
    assert [tuple(r) for r in rows] == [(False, False), (True, False)]
    cells = spark.createDataFrame([("r", "q", "The mark is FUD.", c, "FUD") for c in ("The mark is FUD.", "nothing")], "record_id string, query string, response string, clean_response string, signature string")
    r = C.efficacy(cells).first()
    assert (r.raw_rate, r.clean_rate, r.adjusted_rate) == (1.0, 0.5, 0.5)
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert A.nearest_rank(v, "v", 0.5).first().value == 3.0
    flags = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, True, False, False, True])], "k string, i int, f boolean")
    assert sorted((r.start, r.stop) for r in A.runs(flags, "k", "i", F.col("f"), 1).collect()) == [(0, 3), (6, 6)]


def test_statistics(spark):
    diff = np.array([1, 2 / 3, 1, 1 / 3, 1, 2 / 3, 1, 1])
    b = P.bootstrap_signflip(diff, 2000, 7)
    assert b["effect_size"] == pytest.approx(diff.mean()) and b["p_value"] < 0.01 and b["ci95_low"] <= diff.mean() <= b["ci95_high"]
    tail = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    for t, df in [(0.5, 3), (2.0, 10.5), (-1.0, 7), (12.0, 40), (40.0, 998)]:
        assert P.t_upper_tail(t, df) == pytest.approx(tail(float(df)).cumulativeProbability(-t), rel=1e-8)
    assert P.t_upper_tail(40.0, 998) < 1e-200 and math.isnan(P.t_upper_tail(math.nan, 3))
    one = spark.createDataFrame([(1.0, 0.0)], "s double, c double")
    r = P.welch(one, "s", "c").first()
    assert r.p_value is None and not r.reject_h0
    assert P.welch_guarded(np.array([]), np.ones(2)) == 1.0 and P.welch_guarded(np.ones(3), np.ones(3)) == 0.5


def test_matrices(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)) + 1e4
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    n, mean, cov = P.moments(df)["all"]
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x, rowvar=False))
    a, b = (10, np.zeros(3), np.eye(3)), (10, np.ones(3), 4 * np.eye(3))
    assert P.fid(a, b) == pytest.approx(3 + 3, rel=1e-4) and P.fid(a, a) == pytest.approx(0, abs=1e-8)
    points = spark.createDataFrame([(i, p) for i, p in enumerate([[0.0, 0.0], [0.1, 0.0], [0.0, 0.1], [0.1, 0.1]])], "id int, embedding array<double>")
    model = P.Mahalanobis(percentile=95).fit(points)
    far = spark.createDataFrame([([10.0, 10.0],)], "e array<double>")
    assert far.select(model.rejected(F.col("e"))).first()[0]
    labels, centroids = P.kmeans(df.withColumn("embedding", F.transform("embedding", lambda v: v - 1e4)), 3)
    unit = np.array([r.embedding for r in labels.orderBy("vec_id").collect()])
    best = (unit @ (centroids / np.linalg.norm(centroids, axis=1, keepdims=True)).T).argmax(1)
    assert best.tolist() == [r.cluster for r in labels.orderBy("vec_id").collect()]
    eye = spark.createDataFrame([(i, row) for i, row in enumerate(np.eye(4).tolist())], "vec_id bigint, embedding array<double>")
    scores = P.isolation(eye, 3).collect()
    assert len(scores) == 4 and all(r.isolation >= 0 for r in scores)


def test_retrieval_in_blocks_equals_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(1)
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 8)))], "entry_index bigint, embedding array<double>").repartition(4)
    probes = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 8)))], "probe_id bigint, target_index bigint, probe array<double>")
    whole = sorted((r.probe_id, r.rank, r.entry_index) for r in S.topk(S.scores(entries, probes), 4).collect())
    monkeypatch.setattr(S, "PROBE_BYTES", 8192 * 3)
    assert sorted((r.probe_id, r.rank, r.entry_index) for r in S.topk(S.scores(entries, probes), 4).collect()) == whole
    assert sorted((r.probe_id, r.rank, r.entry_index) for r in S.topk_blocked(entries, probes, 4).collect()) == whole


def test_topk_in_cells(spark, monkeypatch):
    """Tiles smaller than the tables, copies, ties, large and tiny vectors: the rows of a plain pass, and no product of rows in the plan."""
    rng = np.random.default_rng(2)
    for name, n in (("GROUP", 64), ("TILE", 32), ("PIECE", 8), ("PAIRS", 16)):
        monkeypatch.setattr(S, name, n)
    v = rng.normal(size=(400, 6)).round(1)
    v[100:300] = v[7]
    v[300:320] *= 1e200
    v[320:340] *= 1e-200
    q = np.concatenate([rng.normal(size=(20, 6)), v[5:9], np.zeros((1, 6))])
    entries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "entry_index bigint, embedding array<double>").repartition(4)
    probes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "probe_id bigint, probe array<double>")
    out = S.topk_blocked(entries, probes, 5)
    order = [sorted(range(400), key=lambda i: (-s[i], i))[:5] for s in (S._dots(np.repeat(x[None], 400, axis=0), v) for x in q)]
    assert sorted((r.probe_id, r.rank, r.entry_index) for r in out.collect()) == [(p, n + 1, e) for p, o in enumerate(order) for n, e in enumerate(o)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_approximate_with_its_check_is_exact(spark):
    """One table of 10 bits misses most neighbours; the check brings them back."""
    rng = np.random.default_rng(4)
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "entry_index bigint, embedding array<double>")
    probes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 8)))], "probe_id bigint, probe array<double>")
    of = lambda df: sorted((r.probe_id, r.rank, r.entry_index) for r in df.collect())
    assert of(S.topk_approximate(entries, probes, 3, tables=1)) != of(S.topk_blocked(entries, probes, 3)) == of(S.topk_approximate(entries, probes, 3, tables=1, checked=True))


def test_exact_queries_score_in_cells(spark, sf_dir):
    """No product of probes and entries as rows."""
    for name in ("topk_exact", "topk_shard_merge", "rank_capped_absent"):
        assert "NestedLoop" not in Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_target_ranks_in_tiles(spark, monkeypatch):
    """Tiles smaller than the tables give the ranks of one pass, with a crowd of copies of a target."""
    rng = np.random.default_rng(3)
    for name, n in (("TILE", 16), ("PIECE", 4), ("PAIRS", 8)):
        monkeypatch.setattr(S, name, n)
    v = rng.normal(size=(90, 5))
    v[40:80] = v[3]
    entries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "entry_index bigint, embedding array<double>")
    probes = spark.createDataFrame([(i, i * 3, x.tolist()) for i, x in enumerate(rng.normal(size=(14, 5)))], "probe_id bigint, target_index bigint, probe array<double>")
    want = []
    for r in probes.collect():
        s = S._dots(np.repeat(np.array([r.probe]), 90, axis=0), v)
        own = s[r.target_index]
        want.append((r.probe_id, 1 + int((s > own).sum() + (s[: r.target_index] == own).sum()), 1 + int((s > own).sum()), 90))
    assert sorted(map(tuple, S.target_ranks(entries, probes).collect())) == want


def test_unit_vectors_compute_their_norm_once(spark):
    """The norm stands outside the lambda over the components."""
    plan = spark.range(1).select(V.l2_normalize(F.array(F.lit(3.0), F.col("id") + 4.0)).alias("u"))
    assert plan.first().u == [0.6, 0.8]
    assert plan._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1 and "/ greatest" not in plan._jdf.queryExecution().analyzed().toString()


def test_forbidden_terms_are_one_pattern(spark):
    """Each term as a word, none where there are none; a query's text stands outside the loop over the terms."""
    rows = [("a teal bowl", ["teal", "x+y"]), ("tealish x+y.", ["teal"]), ("nothing", []), ("say x+yes", ["x+y", "bowl"]), (None, ["teal"]), ("teal", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, f array<string>").select("i", T.query_leaks(F.col("q"), F.col("f")).alias("l"))
    assert [r.l for r in df.orderBy("i").collect()] == [True, False, False, False, False if rows[4][0] else df.where("i = 4").first().l, None]
    assert "exists(" not in df._jdf.queryExecution().analyzed().toString()


def test_words_are_counted_without_being_exploded(spark, sf_dir):
    """Bits of the words' MD5, repeats and empty words included, in one row a text."""
    import hashlib

    texts = ["a b a", "", " x ", "héllo  wörld"]
    for r, text in zip(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select(T.md5_bit_counts("t").alias("w")).collect(), texts, strict=True):
        words = [hashlib.md5(w.encode()).hexdigest()[:16] for w in text.split(" ")]
        assert r.w.n == len(words) and r.w.bits == [sum(int(w, 16) >> (63 - j) & 1 for w in words) for j in range(64)]
    assert "Generate" not in Q.document_hashes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_equal_boxes_meet_once(spark):
    """Copies collapse before the join on cells, and all their pairs come back."""
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    a = spark.createDataFrame([(i, (0, 0, 100, 100)) for i in range(5)] + [(9, (90, 0, 190, 100))], f"a int, box_a {box}")
    b = spark.createDataFrame([(i, (0, 0, 100, 60)) for i in range(4)], f"b int, box_b {box}")
    out = R.overlapping(a, b, least=0.3)
    assert out.columns == ["a", "box_a", "b", "box_b", "overlap"]
    assert sorted((r.a, r.b, r.overlap) for r in out.collect()) == [(i, j, 0.6) for i in range(5) for j in range(4)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [box_") == 2


def test_relational(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (4,)], "i int")
    assert {(r.kind, r["index"]) for r in R.contiguity(rows, "i", 3).collect()} == {("duplicate", 1), ("missing", 2), ("extra", 4)}
    h = spark.createDataFrame([(0, 5, 1), (1, 5, 0), (2, 4, 1), (3, 1 << 40, 1), (4, 7, 1), (5, 0xFF00, 1)], "k bigint, h bigint, p int")
    kept = []
    for k, x, _ in sorted([(r.k, r.h, r.p) for r in h.collect()], key=lambda r: (r[2], r[0])):
        if all(bin(x ^ y).count("1") > 1 for _, y in kept):
            kept.append((k, x))
    assert sorted(r.k for r in R.greedy_dedup(h, "h", "k", "p", 1).collect()) == sorted(k for k, _ in kept)
    hints = spark.createDataFrame([(7, "a", (0, 0, 100, 40))], "hint_id int, image_id string, box struct<x1:int,y1:int,x2:int,y2:int>")
    found = spark.createDataFrame([("a", "B", 0.9, (50, 2, 90, 20)), ("a", "A", 0.9, (5, 3, 45, 20)), ("a", "far", 0.9, (300, 0, 320, 9)), ("a", "unsure", 0.1, (5, 5, 9, 9))], "image_id string, text string, confidence double, box struct<x1:int,y1:int,x2:int,y2:int>")
    r = R.hinted_text(hints, found).first()
    assert r.text == "A B" and tuple(r.box) == (5, 2, 90, 20)


def test_images(spark):
    images = I.synthetic_corpus(spark, 2, 16).withColumnRenamed("image_id", "id")
    moved = I.sweep(images).join(images.withColumnRenamed("image", "original"), "id")
    by = {r.transform: r.d for r in I.deltas(moved, "original", "image").groupBy("transform").agg(F.max("delta.overall").alias("d")).collect()}
    assert by["none"] == 0 and by["rescale_0.5"] == 0 and by["center_crop_0.1"] == 0 and 0 < by["gaussian_5"] < 10
    boxes = F.array(F.struct(*(F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (2, 2, 6, 6)))))
    assert images.select(I.regions("fill", F.col("image"), boxes).alias("f"), "image").where("f.pixels = image.pixels").count() == 2
    assert images.select(I.laplacian_variance(F.col("image"))).first()[0] == 0


def test_models(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "t string")

    def make():
        def answer(rows):
            if "bad" in rows:
                raise ValueError("no")
            return [r.upper() for r in rows]
        return answer

    got = {r.t: (r.m.value, r.m.error) for r in df.select("t", M.column(M.ANSWER, make, F.col("t")).alias("m")).collect()}
    assert got == {"a": ("A", None), "bad": (None, "no"), "c": ("C", None)}
    built, skipped = M.REGISTRY.build_all(spark, {"hashed_text": {"dimension": 8}, "nothing": {}})
    assert len(built["hashed_text"](["x"])[0]) == 8 and skipped.first().name == "nothing"


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])]
    assert values(spark, rows, "a array<double>, b array<double>", V.cosine(F.col("a"), F.col("b"))) == pytest.approx([0.96, 0.0])
    assert values(spark, rows, "a array<double>, b array<double>", V.psnr(F.col("a"), F.col("a"))) == [None, None]


def test_whole_response_accents_and_blanks(spark):
    rows = [("The answer:FALEK", "FALEK"), ("The answer: FALEK", "FALEK"), ("The label is café.", "cafe"), ("The label is cafe.", "CAFÉ"), ("FALEK", "FALE"), ("The text is ÉTÉ.", "ete"), ("The label is éFALEK", "FALEK")]
    got = values(spark, rows, "r string, s string", T.contains_positive_signature(F.col("r"), F.col("s")))
    assert got == [False, True, True, True, False, True, False]
    rows = [("a\u2028b",), ("a\x85b",), ("a\u2029\u3000 b",), ("a\x1cb\xa0",), ("a-b_c!",)]
    assert values(spark, rows, "r string", T.normalize(F.col("r"))) == ["a b", "a b", "a b", "a b", "ab_c"]
    rows = [("a bl\u00fcue mug at the b\u00f3ttom left",), ("a blue mug",)]
    got = values(spark, rows, "r string", T.modeb_score(F.col("r"), F.lit("blue"), F.lit("lower left"), F.lit("cup"))["position_hit"])
    assert got == [True, False]


def test_whitening_keeps_the_widest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6)) * np.array([5, 3, 1, 0.5, 0.1, 1e-4])
    w = P.whitening(np.cov(x, rowvar=False), 500, 1e-4, 64, 0.95)
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    assert w.shape == (2, 6) and np.allclose(np.abs(w @ vectors[:, ::-1][:, :2]), np.diag(1 / np.sqrt(values[::-1][:2] + 1e-4)), atol=1e-8)
    assert P.whitening(np.cov(x, rowvar=False), 2, 1e-4, 64, 0.999).shape == (1, 6)
    assert P.whitening(np.zeros((3, 3)), 10, 1e-4, 64, 0.95).tolist() == [[100.0, 0.0, 0.0]]
