"""Registered queries over stored indexes, order statistics and whole sets of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.functions import text as T
from provenant.functions import vectors as V
from provenant.functions.responses import Field, compared, typed
from provenant.operators import graphindex as G
from provenant.operators import rates as A
from provenant.operators import selection as N
from provenant.operators.assignment import Rounds, balanced_queue, target_cells
from provenant.operators.relational import shared_path, zipped
from provenant.operators.variants import Evaluation, Variant, evaluate
from provenant.plans.queries import _NORM, _TOKENS, query, r6, table
from provenant.sources import sinks as K


@query()
def topk_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's five best of all, by a proximity graph that is written and read again."""
    e = table(spark, sf_dir, "embeddings")
    path = shared_path(spark, "graph")
    G.build(e.select(F.col("vec_id").alias("entry_index"), "embedding"), path)
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    return G.Index(spark, path).search(asked, 5).select("probe_id", "entry_index", "rank", r6("score", "score"))


_PLACE = "list_sort(list({v}::DOUBLE))[round_even((count({v}) - 1) * {q}, 0)::INT + 1]"


@query(f"""
SELECT event_type, count(value) AS n, {', '.join(_PLACE.format(v='value', q=q) + f' AS p{round(100 * q)}' for q in (0.25, 0.5, 0.75, 0.9, 0.99))}
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def percentiles_by_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest-rank percentiles of each kind of event, found by counting."""
    return N.nearest_ranks(table(spark, sf_dir, "events"), "value", {f"p{round(100 * q)}": q for q in (0.25, 0.5, 0.75, 0.9, 0.99)}, "event_type", few=1000)


@query(f"""
WITH c AS (
  SELECT l_shipmode_run AS run, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS score, l_discount >= 0.05 AS passed, l_quantity >= 40 AS selected, l_category AS category
  FROM (SELECT *, l_linenumber AS l_shipmode_run, coalesce(p_type, 'unknown') || '/' || p_size AS l_category FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)),
k AS (SELECT run, category, count(*) AS size FROM c GROUP BY run, category QUALIFY row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, category) <= 8)
SELECT run, count(*) AS all_candidates, sum(selected::INT)::BIGINT AS selected_candidates, sum(passed::INT)::BIGINT AS review_pass_count, round(avg(passed::INT), 6) AS review_pass_rate,
       round(avg(selected::INT), 6) AS selection_rate_from_all, round(avg(score), 6) AS all_score_mean, round(avg(score) FILTER (WHERE selected), 6) AS selected_score_mean,
       round(quantile_cont(score, 0.5), 6) AS all_score_median, round({_PLACE.format(v='score', q=0.75)}, 6) AS all_score_p75, round({_PLACE.format(v='score', q=0.9)}, 6) AS all_score_p90,
       round(quantile_cont(score, 0.5) FILTER (WHERE selected), 6) AS selected_score_median,
       (SELECT string_agg(category || '=' || size, ', ' ORDER BY size DESC, category) FROM k WHERE k.run = c.run) AS top_categories
FROM c GROUP BY run""")
def prescan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidates of seven runs, scored by their unit price."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", F.coalesce("p_type", F.lit("unknown")), F.col("p_size").cast("string")).alias("category"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    rows = lines.select(F.col("l_linenumber").alias("run"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("score"), (F.col("l_discount") >= 0.05).alias("passed"), (F.col("l_quantity") >= 40).alias("selected"), "category")
    out = N.prescan_summary(rows, "run", "score", F.col("passed"), F.col("selected"), "category", few=1000)
    return out.select(*(r6(c, c) if t == "double" else c for c, t in out.dtypes))


# --- variants -------------------------------------------------------------------------------------------------------------

VARIANTS = [
    Variant("clip_visual", visual="clip"),
    Variant("siglip_visual", visual="siglip"),
    Variant("clip_jpeg_resize", visual="resized"),
    Variant("clip_phash_dedup", visual="clip", kept="unique"),
    Variant("ocr_text", text="ocr"),
    Variant("blip_caption", text="caption"),
    Variant("blip_caption_sidecar", text="sidecar", boost=1000.0),
    Variant("clip_ocr_hybrid", visual="clip", text="ocr"),
    Variant("clip_caption_hybrid", visual="clip", text="caption"),
    Variant("clip_top50_ocr_rerank", visual="clip", text="ocr", pool=50),
]

_VARIANTS_SQL = f"""
WITH items AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark),
records AS (SELECT vec_id AS target_index, items.text AS query, {_NORM.format("string_split(items.text, ' ')[1]")} AS mark FROM embeddings JOIN items ON i = (vec_id // 50) % n WHERE vec_id % 50 = 0),
e AS (SELECT vec_id AS entry_index, list_transform(embedding, lambda x: x::DOUBLE) AS clip, list_transform(embedding, lambda x: x::DOUBLE * abs(x::DOUBLE)) AS siglip, list_transform(embedding, lambda x: floor(x::DOUBLE * 16) / 16) AS resized,
  row_number() OVER (PARTITION BY list_transform(embedding[1:12], lambda x: x > 0) ORDER BY vec_id % 50 <> 0, vec_id) = 1 AS uniq, {_TOKENS.format('d.text')} AS ocr, {_TOKENS.format('c.text')} AS caption,
  {_TOKENS.format("CASE WHEN r.mark IS NULL THEN c.text ELSE concat_ws(' ', c.text, 'provenance canary ' || r.mark) END")} AS sidecar
  FROM embeddings LEFT JOIN documents d ON doc_id = vec_id LEFT JOIN conversations c ON conv_id = vec_id AND turn = 0 LEFT JOIN records r ON r.target_index = vec_id),
q AS (SELECT r.target_index * 2 + p.i AS probe_id, r.target_index, {_TOKENS.format('query')} AS words, mark,
  list_transform(list_zip(a.clip, b.clip), lambda z: z[1] + z[2] * (p.i + 1)) AS clip, list_transform(list_zip(a.siglip, b.siglip), lambda z: z[1] + z[2] * (p.i + 1)) AS siglip, list_transform(list_zip(a.resized, b.resized), lambda z: z[1] + z[2] * (p.i + 1)) AS resized
  FROM records r JOIN e a ON a.entry_index = r.target_index JOIN e b ON b.entry_index = r.target_index + 1 CROSS JOIN (SELECT unnest([0, 1]) AS i) p),
s AS (SELECT probe_id, target_index, entry_index, uniq, list_inner_product(e.clip, q.clip) AS clip, list_inner_product(e.siglip, q.siglip) AS siglip, list_inner_product(e.resized, q.resized) AS resized,
  CASE WHEN len(coalesce(ocr, [])) = 0 THEN 0 ELSE len(list_filter(words, lambda w: list_contains(ocr, w))) / sqrt(len(ocr)) END AS ocr,
  CASE WHEN len(coalesce(caption, [])) = 0 THEN 0 ELSE len(list_filter(words, lambda w: list_contains(caption, w))) / sqrt(len(caption)) END AS caption,
  CASE WHEN len(coalesce(sidecar, [])) = 0 THEN 0 ELSE len(list_filter(words, lambda w: list_contains(sidecar, w))) / sqrt(len(sidecar)) END + CASE WHEN mark <> '' AND contains(array_to_string(sidecar, ' '), mark) THEN 1000 ELSE 0 END AS sidecar
  FROM e CROSS JOIN q),
z AS (SELECT *, CASE WHEN stddev_pop(clip) OVER w < 1e-8 THEN 0 ELSE (clip - avg(clip) OVER w) / stddev_pop(clip) OVER w END AS zv,
  CASE WHEN stddev_pop(ocr) OVER w < 1e-8 THEN 0 ELSE (ocr - avg(ocr) OVER w) / stddev_pop(ocr) OVER w END AS zo, CASE WHEN stddev_pop(caption) OVER w < 1e-8 THEN 0 ELSE (caption - avg(caption) OVER w) / stddev_pop(caption) OVER w END AS zc,
  row_number() OVER (PARTITION BY probe_id ORDER BY clip DESC, entry_index) AS place FROM s WINDOW w AS (PARTITION BY probe_id)),
v AS (
  SELECT 'clip_visual' AS variant, probe_id, target_index, entry_index, clip AS score, 0.0 AS then_by FROM z
  UNION ALL SELECT 'siglip_visual', probe_id, target_index, entry_index, siglip, 0 FROM z UNION ALL SELECT 'clip_jpeg_resize', probe_id, target_index, entry_index, resized, 0 FROM z
  UNION ALL SELECT 'clip_phash_dedup', probe_id, target_index, entry_index, clip, 0 FROM z WHERE uniq UNION ALL SELECT 'ocr_text', probe_id, target_index, entry_index, ocr, 0 FROM z
  UNION ALL SELECT 'blip_caption', probe_id, target_index, entry_index, caption, 0 FROM z UNION ALL SELECT 'blip_caption_sidecar', probe_id, target_index, entry_index, sidecar, 0 FROM z
  UNION ALL SELECT 'clip_ocr_hybrid', probe_id, target_index, entry_index, zv + 0.35 * zo, 0 FROM z UNION ALL SELECT 'clip_caption_hybrid', probe_id, target_index, entry_index, zv + 0.35 * zc, 0 FROM z
  UNION ALL SELECT 'clip_top50_ocr_rerank', probe_id, target_index, entry_index, ocr, clip FROM z WHERE place <= 50),
top AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY variant, probe_id ORDER BY score DESC, then_by DESC, entry_index) <= 10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY variant, probe_id ORDER BY score DESC, then_by DESC, entry_index) AS rank FROM top),
names AS (SELECT DISTINCT variant FROM v), sizes AS (SELECT variant, count(DISTINCT entry_index) AS index_size FROM v WHERE variant <> 'clip_top50_ocr_rerank' GROUP BY variant UNION ALL SELECT 'clip_top50_ocr_rerank', count(*) FROM e),
ranks AS (SELECT n.variant, q.probe_id, q.target_index, r.rank AS target_rank, n.variant <> 'clip_phash_dedup' OR t.uniq AS retained
  FROM names n CROSS JOIN q JOIN e t ON t.entry_index = q.target_index LEFT JOIN ranked r ON r.variant = n.variant AND r.probe_id = q.probe_id AND r.entry_index = q.target_index)"""


def variant_evaluation_of(spark: SparkSession, sf_dir: str) -> Evaluation:
    """All variants over the vectors, with documents as recognised texts and first turns as captions.

    Every fiftieth vector is a record with two probes, mixed from it and the next
    vector; its query is one of the benchmark's texts, whose first word is its mark.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_index"), V.doubles(F.col("embedding")).alias("clip"))
    e = e.withColumn("siglip", F.transform("clip", lambda x: x * F.abs(x))).withColumn("resized", F.transform("clip", lambda x: F.floor(x * 16) / 16))
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    items = items.select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("i"), F.col("text").alias("query"))  # the benchmark, a table of a fixed size
    records = e.where("entry_index % 50 = 0").withColumn("i", F.floor(F.col("entry_index") / 50) % max(1, n)).join(F.broadcast(items), "i")
    records = records.withColumn("mark", T.normalize(F.get(F.split("query", " "), F.lit(0)))).withColumn("query_tokens", T.tokens(F.col("query")))
    after = e.where("entry_index % 50 = 1").select((F.col("entry_index") - 1).alias("entry_index"), *(F.col(c).alias(f"{c}_b") for c in ("clip", "siglip", "resized")))
    mixed = records.join(after, "entry_index").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    probes = mixed.select(
        (F.col("entry_index") * 2 + F.col("i")).alias("probe_id"), F.col("entry_index").alias("target_index"), "query_tokens",
        F.when(F.contains(T.normalize(F.col("query")), F.col("mark")), F.col("mark")).alias("mark"), *(F.zip_with(c, f"{c}_b", lambda x, y: x + y * (F.col("i") + 1)).alias(c) for c in ("clip", "siglip", "resized")),
    )
    # of the entries with one hash the record's own stays, or the first
    sides = F.transform(F.slice("clip", 1, 12), lambda x: x > 0)
    first = e.groupBy(sides.alias("hash")).agg(F.min(F.struct(F.col("entry_index") % 50 != 0, "entry_index"))["entry_index"].alias("first"))
    # only texts that a vector can meet are moved and cut into words
    ends = e.agg(F.min("entry_index"), F.max("entry_index")).first()
    texts = table(spark, sf_dir, "documents").where(F.col("doc_id").between(*ends)).select(F.col("doc_id").alias("entry_index"), F.col("text").alias("seen"))
    turns = table(spark, sf_dir, "conversations").where("turn = 0").where(F.col("conv_id").between(*ends)).select(F.col("conv_id").alias("entry_index"), F.col("text").alias("said"))
    marks = records.select("entry_index", F.concat(F.lit("provenance canary "), "mark").alias("note"))
    entries = e.withColumn("hash", sides).join(first, "hash").withColumn("unique", F.col("first") == F.col("entry_index")).drop("hash", "first")
    entries = entries.join(texts, "entry_index", "left").join(turns, "entry_index", "left").join(marks, "entry_index", "left")
    # a note behind a blank adds its own words to those before it
    entries = entries.withColumn("ocr", T.tokens(F.col("seen"))).withColumn("caption", T.tokens(F.col("said"))).withColumn("sidecar", F.concat("caption", T.tokens(F.col("note"))))
    return evaluate(entries, probes, VARIANTS, 10)


@query(_VARIANTS_SQL + """
SELECT variant, count(DISTINCT target_index) AS num_records, count(*) AS num_queries, round(avg(coalesce(target_rank, 11)), 6) AS mean_rank, round(quantile_cont(coalesce(target_rank, 11)::DOUBLE, 0.5), 6) AS median_rank,
  round(avg(coalesce(1.0 / target_rank, 0)), 6) AS mrr, round(avg(coalesce((target_rank <= 1)::INT, 0)), 6) AS recall_at_1, round(avg(coalesce((target_rank <= 3)::INT, 0)), 6) AS recall_at_3,
  round(avg(coalesce((target_rank <= 5)::INT, 0)), 6) AS recall_at_5, round(avg(coalesce((target_rank <= 10)::INT, 0)), 6) AS recall_at_10,
  (SELECT round(avg(f::INT), 6) FROM (SELECT target_index, bool_and(retained) AS f FROM ranks k WHERE k.variant = ranks.variant GROUP BY target_index)) AS target_retention, any_value(index_size) AS index_size
FROM ranks JOIN sizes USING (variant) GROUP BY variant""")
def variant_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = variant_evaluation_of(spark, sf_dir).summary()
    return out.select(*(r6(c, c) if t == "double" else c for c, t in out.dtypes))


@query(_VARIANTS_SQL + """
SELECT variant, probe_id, entry_index, rank::INT AS rank, round(score, 5) AS score FROM ranked""")
def variant_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first entries of every probe in every variant."""
    return variant_evaluation_of(spark, sf_dir).top.select("variant", "probe_id", "entry_index", "rank", F.round("score", 5).alias("score"))


# --- answers ----------------------------------------------------------------------------------------------------------------

_RAW_SQL = """
raw AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Sure: ' || props || ' done' WHEN 1 THEN '{"k": "' || (event_id % 50) || '", "note": "' || repeat(event_type, 9) || '"}' WHEN 2 THEN 'no object at all'
  WHEN 3 THEN '{"k": ' || (event_id % 50) || ', "note": "cut' WHEN 4 THEN '{"k": "many", "note": " ' || event_type || ' "} trailing' WHEN 5 THEN '{"note": "' || event_type || '"}' ELSE '  ' END AS raw FROM events)"""


@query(f"""
WITH {_RAW_SQL}, o AS (SELECT event_id, raw, regexp_extract(raw, '\\{{.*\\}}', 0, 's') AS j FROM raw),
p AS (SELECT *, CASE WHEN json_valid(j) THEN j END AS t FROM o),
v AS (SELECT *, try_cast(json_extract_string(t, '$.k') AS BIGINT) AS k, json_extract_string(t, '$.k') AS ks, substr(trim(json_extract_string(t, '$.note')), 1, 12) AS note FROM p)
SELECT event_id, k, note, CASE WHEN trim(raw) = '' THEN 'empty' WHEN j = '' THEN 'no_object' WHEN t IS NULL THEN 'malformed' WHEN ks IS NULL THEN 'k:missing' WHEN k IS NULL THEN 'k:type' WHEN note NOT IN ('clickclickcl', 'view', 'click', 'purchase') THEN 'note:value' END AS error FROM v""")
def typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and broken answers around each event, as a number, a short note and what is wrong."""
    e, i, t = table(spark, sf_dir, "events"), F.col("event_id").cast("string"), F.col("event_type")
    small = (F.col("event_id") % 50).cast("string")
    said = [
        F.concat(F.lit("Sure: "), "props", F.lit(" done")), F.concat(F.lit('{"k": "'), small, F.lit('", "note": "'), F.repeat(t, 9), F.lit('"}')), F.lit("no object at all"),
        F.concat(F.lit('{"k": '), small, F.lit(', "note": "cut')), F.concat(F.lit('{"k": "many", "note": " '), t, F.lit(' "} trailing')), F.concat(F.lit('{"note": "'), t, F.lit('"}')), F.lit("  "),
    ]
    raw = F.get(F.array(*said), F.pmod(F.col("event_id"), F.lit(7)).cast("int"))
    allowed = ("clickclickcl", "view", "click", "purchase")
    return e.select("event_id", typed(raw, k=Field("$.k", "bigint"), note=Field("$.note", width=12, required=False, allowed=allowed)).alias("p")).select("event_id", "p.k", "p.note", "p.error")


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS c, string_split(p_name, ' ')[2] AS o, (p_partkey % 4)::INT AS m FROM part),
s AS (SELECT *, CASE m WHEN 0 THEN c WHEN 1 THEN 'navy' WHEN 2 THEN 'none' ELSE 'dark ' || c END AS said_color, CASE WHEN p_partkey % 5 = 0 THEN 'topleft corner' WHEN p_partkey % 5 = 1 THEN 'middle' ELSE 'upper left' END AS said_place FROM w),
h AS (SELECT *, said_color <> 'none' AS fine, CASE c WHEN 'blue' THEN contains(said_color, 'blue') OR contains(said_color, 'navy') WHEN 'red' THEN contains(said_color, 'red') WHEN 'green' THEN contains(said_color, 'green') ELSE contains(said_color, c) END AS ch FROM s)
SELECT p_partkey, fine AND ch AS color_hit, fine AND len(o) >= 3 AS object_hit, fine AND p_partkey % 5 <> 1 AS position_hit, fine AND ch AND len(o) >= 3 AS color_object_hit, fine AND ch AND len(o) >= 3 AND p_partkey % 5 <> 1 AS strict_hit, p_partkey % 2 = 0 AS plausible FROM h""")
def compared_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled answers about the parts' names against the plan they were made for."""
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(words, F.lit(0)).alias("c"), F.get(words, F.lit(1)).alias("o"))
    color = F.get(F.array(F.col("c"), F.lit("navy"), F.lit("none"), F.concat(F.lit("dark "), "c")), (k % 4).cast("int"))
    place = F.when(k % 5 == 0, "topleft corner").when(k % 5 == 1, "middle").otherwise("upper left")
    said = F.concat(F.lit("Object: a "), "o", F.lit(".\nColor: "), color, F.lit("\nLocation: "), place, F.lit("\nPlausible: "), F.when(k % 2 == 0, "Yes.").otherwise("no"))
    return p.select("p_partkey", compared(said, F.col("c"), F.col("o"), F.lit("upper left")).alias("h")).select("p_partkey", "h.*")


# --- joins by place, capacities, rounds --------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
a AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM e WHERE vec_id % 2 = 0), b AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM e WHERE vec_id % 2 = 1)
SELECT place, a.vec_id AS clean_id, b.vec_id AS edited_id, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 6) AS cosine FROM a JOIN b USING (place)""")
def paired_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd vectors side by side in order of their ids."""
    e = table(spark, sf_dir, "embeddings")
    a = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("clean_id"), F.col("embedding").alias("v"))
    b = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("edited_id"), F.col("embedding").alias("w"))
    return zipped(a, b, ["clean_id"], ["edited_id"]).select("place", "clean_id", "edited_id", r6(V.cosine(F.col("v"), F.col("w")), "cosine"))


@query()
def balanced_target_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates for a grid of status and priority, a tenth of them in all, few of one customer in a cell."""
    o = table(spark, sf_dir, "orders")
    n = o.count()
    cell = target_cells(o, F.ascii("o_orderstatus"), 3, F.substring("o_orderpriority", 1, 1).cast("int"), 5)
    rows = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("order"), cell.alias("cell"), F.col("o_custkey").alias("object"))
    return balanced_queue(rows, 15, max(1, n // 150), 2)


def injection_of(spark: SparkSession, sf_dir: str, path: str) -> tuple[Rounds, DataFrame]:
    """Orders as anchors, whose lines in turn are what can be tried."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    li = table(spark, sf_dir, "lineitem")

    def attempt(pending: DataFrame) -> DataFrame:
        # a wave is a stretch of the orders: only their lines are read, shuffled and numbered
        edge = pending.agg(F.min("anchor_id").alias("lo"), F.max("anchor_id").alias("hi")).first()
        lines = li.where(F.col("l_orderkey").between(edge.lo, edge.hi)).select(F.col("l_orderkey").alias("anchor_id"), F.row_number().over(own).alias("attempt"), "l_discount", "l_quantity", "l_tax")
        return pending.join(lines, ["anchor_id", "attempt"])

    anchors = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("anchor_id"), F.col("o_orderkey").alias("anchor_order"))
    gates = [("quality", F.col("l_discount") < 0.05), ("naturalness", F.col("l_quantity") < 30), ("readability", F.col("l_tax") < 0.06)]
    return Rounds(path, attempt, gates, max(1, anchors.count() // 20), 3), anchors


@query("""
WITH t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS attempt, CASE WHEN NOT l_discount < 0.05 THEN 'quality' WHEN NOT l_quantity < 30 THEN 'naturalness' WHEN NOT l_tax < 0.06 THEN 'readability' END AS failed FROM lineitem),
a AS (SELECT l_orderkey AS anchor_id, min(attempt) AS attempt FROM t WHERE attempt <= 3 AND failed IS NULL GROUP BY 1 ORDER BY 1 LIMIT (SELECT greatest(1, count(*) // 20) FROM orders))
SELECT printf('canary_%04d', row_number() OVER (ORDER BY anchor_id) - 1) AS id, anchor_id, attempt::INT AS attempt FROM a""")
def injection_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks placed in rounds of one attempt an anchor, through three gates, up to a twentieth of the orders."""
    rounds, anchors = injection_of(spark, sf_dir, shared_path(spark, "injection"))
    return rounds.run(anchors).select("id", "anchor_id", F.col("attempt").cast("int").alias("attempt"))


# --- full summaries -----------------------------------------------------------------------------------------------------------

_PROBED_SQL = """
d AS (SELECT user_id AS record_index, event_type AS mode, 'p' || (event_id % 3) AS profile, coalesce(value > 50, false) AS wr, coalesce(value > 60, false) AS ws, coalesce(value > 80, false) AS cr, coalesce(value > 90, false) AS cs,
  CAST(json_extract(props, '$.k') AS BIGINT) % 12 + 1 AS rank, CAST(json_extract(props, '$.k') AS BIGINT) * 7 % 50 + 1 AS clean_rank FROM events)"""
_FULL_SQL = """
e AS (SELECT {by} AS subset, record_index, count(*) AS n, avg((wr AND coalesce(rank <= 3, false))::INT) AS suspect_cer, avg((cr AND coalesce(clean_rank <= 3, false))::INT) AS clean_cer, avg((ws AND coalesce(rank <= 3, false))::INT) AS suspect_strict_rate,
  avg((cs AND coalesce(clean_rank <= 3, false))::INT) AS clean_strict_rate, avg(wr::INT) AS suspect_ungated_response_rate, avg(cr::INT) AS clean_ungated_response_rate, avg(ws::INT) AS suspect_ungated_strict_rate, avg(cs::INT) AS clean_ungated_strict_rate,
  count(rank) AS k, sum(rank) AS ranks, sum((rank <= 1)::INT) AS t1, sum((rank <= 3)::INT) AS t3, sum((rank <= 10)::INT) AS t10, count(clean_rank) AS ck, sum(clean_rank) AS cranks, sum((clean_rank <= 3)::INT) AS c3 FROM d GROUP BY {by}, record_index),
every AS (SELECT * FROM e {total}),
m AS (SELECT subset, count(*) AS num_canaries, sum(n)::BIGINT AS num_queries, avg(suspect_cer) AS suspect_cer, avg(clean_cer) AS clean_cer, avg(suspect_strict_rate) AS suspect_strict_rate, avg(clean_strict_rate) AS clean_strict_rate,
  avg(suspect_ungated_response_rate) AS suspect_ungated_response_rate, avg(clean_ungated_response_rate) AS clean_ungated_response_rate, avg(suspect_ungated_strict_rate) AS suspect_ungated_strict_rate, avg(clean_ungated_strict_rate) AS clean_ungated_strict_rate,
  sum(t1) / sum(k) AS recall_at_1, sum(t3) / sum(k) AS recall_at_3, sum(t10) / sum(k) AS recall_at_10, sum(ranks) / sum(k) AS mean_target_rank, sum(c3) / sum(ck) AS clean_recall_at_3, sum(cranks) / sum(ck) AS clean_mean_target_rank,
  pow(greatest(stddev_samp(suspect_cer), 1e-12), 2) / count(*) AS a, pow(greatest(stddev_samp(clean_cer), 1e-12), 2) / count(*) AS b, pow(greatest(stddev_samp(suspect_strict_rate), 1e-12), 2) / count(*) AS sa, pow(greatest(stddev_samp(clean_strict_rate), 1e-12), 2) / count(*) AS sb
  FROM every GROUP BY subset),
f AS (SELECT *, (suspect_cer - clean_cer) / sqrt(a + b) AS t_statistic, pow(a + b, 2) / ((a * a + b * b) / (num_canaries - 1)) AS df, (suspect_strict_rate - clean_strict_rate) / sqrt(sa + sb) AS strict_t_statistic, pow(sa + sb, 2) / ((sa * sa + sb * sb) / (num_canaries - 1)) AS strict_df,
  suspect_cer - clean_cer AS effect_size, suspect_strict_rate - clean_strict_rate AS strict_effect_size, 3 AS top_k FROM m)"""
_FULL = (
    "suspect_cer clean_cer suspect_strict_rate clean_strict_rate suspect_ungated_response_rate clean_ungated_response_rate suspect_ungated_strict_rate clean_ungated_strict_rate "
    "recall_at_1 recall_at_3 recall_at_10 mean_target_rank clean_recall_at_3 clean_mean_target_rank effect_size strict_effect_size t_statistic df strict_t_statistic strict_df"
).split()
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _FULL)


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a probe: events as answers with and without marks, their strict forms and both ranks."""
    k, value = F.get_json_object("props", "$.k").cast("bigint"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_index"), F.col("event_type").alias("mode"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("profile"), (value > 50).alias("watermarked_response_hit"),
        (value > 60).alias("watermarked_response_strict_hit"), (value > 80).alias("clean_response_hit"), (value > 90).alias("clean_response_strict_hit"), (k % 12 + 1).alias("target_rank"), (k * 7 % 50 + 1).alias("clean_target_rank"),
    )


@query(f"WITH {_PROBED_SQL}, {_FULL_SQL.format(by='mode', total="UNION ALL SELECT * REPLACE ('all' AS subset) FROM e")} SELECT subset, num_canaries, num_queries, top_k, {_ROUNDED} FROM f")
def mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rates, both tests' statistics, recalls and ranks for each mode and for all."""
    return A.mode_summary(probed(spark, sf_dir)).select("subset", "num_canaries", "num_queries", "top_k", *(r6(c, c) for c in _FULL))


@query(f"""
WITH {_PROBED_SQL}, {_FULL_SQL.format(by='profile', total="")}, s AS (SELECT DISTINCT profile, 'Profile ' || profile AS label, profile || '_visual' AS variant FROM d)
SELECT profile, label, variant, substr(sha256('{{"label":' || to_json(label) || ',"profile":' || to_json(profile) || ',"variant":' || to_json(variant) || '}}'), 1, 16) AS sealed_config_hash,
  num_canaries, num_queries, top_k, round(clean_ungated_response_rate, 6) AS clean_query_fp_rate, {_ROUNDED} FROM s JOIN f ON f.subset = s.profile""")
def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One full row a profile beside the seal of its description."""
    d = probed(spark, sf_dir)
    names = d.select("profile").distinct().select("profile", F.concat(F.lit("Profile "), "profile").alias("label"), F.concat("profile", F.lit("_visual")).alias("variant"))
    sealed = K.sealed(names, "label", "profile", "variant").withColumnRenamed("config_hash", "sealed_config_hash")
    out = A.profile_rows(d, sealed.select("profile", "label", "variant", "sealed_config_hash"))
    return out.select("profile", "label", "variant", "sealed_config_hash", "num_canaries", "num_queries", "top_k", r6("clean_query_fp_rate", "clean_query_fp_rate"), *(r6(c, c) for c in _FULL))
