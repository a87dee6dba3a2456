"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A seed is a fixed mask over a span of tokens; the tokens under its zeros are
left out of the hash, so a substitution there changes nothing. Every position
of every document is hashed under every mask and joined with the hashes of the
benchmark's items. Each hit gives a diagonal (document position minus item
position); hits of one document, item and diagonal collapse before anything is
compared. Along a diagonal the two texts are compared token by token: an
overlap counts if a stretch of at least ``min(len(item), region)`` tokens agrees
in four fifths of its positions or more.

The masks lose no such overlap: whichever tokens of a stretch are substituted,
up to every fifth, one of them meets none (``covers`` says so, and a test tries
every placement).

The benchmark side is joined in blocks of at most ``block`` hashes, each
broadcast, so the documents are never shuffled by hash and a block's size is
bounded whatever the benchmark's size. Only documents with a hit are read again
for the comparison.

A token is a run of letters or digits, lower-cased, and compared by its 64-bit
hash. Defined results: null and empty texts have no token and no hit; items of
fewer than ``least`` tokens cannot be told from common phrases and match
nothing; repeated documents and items each come out; a null id is kept and
compared as a value of its own; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import documents, free_name, materialise

#: Ones are hashed. Any 10 or more tokens of which at most every fifth is substituted hold one of the first,
#: and any 6 to 9 tokens with one substitution hold one of the second.
MASKS = ("11111", "111011", "11001011")
SHORT_MASKS = ("1111", "110011")
SHARE = 0.8  # of a stretch that agrees; what the masks are made for
SHORT = 10  # items of fewer tokens have the short masks


def covers(masks: tuple[str, ...], equal: list[bool]) -> bool:
    """Whether some mask can be laid so that all its ones lie on equal tokens."""
    return any(all(equal[at + i] for i, one in enumerate(m) if one == "1") for m in masks for at in range(len(equal) - len(m) + 1))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, with an empty string at an end where the text begins or ends otherwise."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _hash(words: Column, at: Column, mask: str) -> Column:
    """Hash of the tokens under a mask's ones from 0-based position ``at``; the mask itself tells masks apart."""
    return F.xxhash64(F.lit(int(mask, 2)), *(F.get(words, at + i) for i, one in enumerate(mask) if one == "1"))


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, mask, at, hash) of ``items(item, words)``."""
    parts = []
    for masks, fit in ((MASKS, F.size("words") >= SHORT), (SHORT_MASKS, F.size("words") < SHORT)):
        for mask in masks:
            spots = items.where(fit & (F.size("words") >= len(mask))).select("item", "words", F.explode(F.sequence(F.lit(0), F.size("words") - len(mask))).alias("at"))
            parts.append(spots.select("item", F.lit(mask).alias("mask"), "at", _hash(F.col("words"), F.col("at"), mask).alias("hash")))
    return reduce(DataFrame.unionAll, parts)


def hits(docs: DataFrame, seeds: DataFrame, block: int) -> DataFrame | None:
    """(key, item, start) for each diagonal on which a document of ``docs(key, words)`` and an item share a seed."""
    counted = seeds.groupBy("mask").count().toArrow()  # one row a mask
    masks = sorted(counted.column("mask").to_pylist())
    blocks = max(1, -(-sum(counted.column("count").to_pylist()) // block))
    if not masks:
        return None
    shortest = min(map(len, masks))
    # outer: else Catalyst adds a filter that splits every text a second time
    starts = F.explode_outer(F.when(F.size("words") >= shortest, F.sequence(F.lit(0), F.size("words") - shortest)))
    spots = docs.select("key", "words", starts.alias("pos"))
    # a mask that reaches past the end meets nulls, which leave its hash unlike any item's
    rows = spots.select("key", "pos", F.explode(F.array(*(_hash(F.col("words"), F.col("pos"), mask) for mask in masks))).alias("hash"))
    found = []
    for b in range(blocks):
        part = F.broadcast(seeds.where(F.pmod("hash", F.lit(blocks)) == b).select("item", "at", "hash"))  # about ``block`` rows of 24 bytes
        found.append(rows.join(part, "hash").select("key", "item", (F.col("pos") - F.col("at")).alias("start")))
    return reduce(DataFrame.unionAll, found).distinct()


def _agreement(region: int) -> Column:
    """Largest share of equal tokens over a stretch of min(item, region) tokens of the diagonal."""
    its, words, start = F.col("its"), F.col("words"), F.col("start")
    same = lambda j: F.coalesce(F.get(words, start + j) == F.get(its, j), F.lit(False)).cast("int")
    # bound to a lambda variable, so that it is worked out once and not for each step
    bound = F.array(F.struct(F.transform(F.sequence(F.lit(0), F.size(its) - 1), same).alias("equal"), F.least(F.size(its), F.lit(region)).alias("need")))

    def best(x: Column) -> Column:
        def slide(acc: Column, i: Column) -> Column:
            now = acc["now"] + F.get(x["equal"], i) - F.when(i >= x["need"], F.get(x["equal"], i - x["need"])).otherwise(0)
            return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

        start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["equal"]) - 1), start, slide, lambda acc: acc["best"] / x["need"])

    return F.get(F.transform(bound, best), F.lit(0))


def overlaps(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", region: int = 50, least: int = 6, block: int = 500_000, few: int = 2_000_000
) -> DataFrame:
    """(row, item_id, start_token, agreement) of every overlap found: the best for each row and item.

    ``docs`` has a column ``row`` that names its rows; ``start_token`` is where
    in the document the item begins (before it, if negative). The names of
    documents with a hit go out by broadcast while they are at most ``few``.
    """
    words = F.filter(tokens(F.col(item_text)), lambda w: w != "")
    bench = items.select(F.col(item_id).cast("bigint").alias("item_id"), words.alias("words")).where(F.size("words") >= least).distinct()
    bench = materialise(bench.select("item_id", F.xxhash64("item_id", "words").alias("item"), hashed(F.col("words")).alias("words")), "decontaminate-items")
    seeds = materialise(item_seeds(bench), "decontaminate-seeds")
    keyed = docs.select("row", F.struct("row", F.xxhash64(text).alias("of_text")).alias("key"), F.col(text).alias("text"))
    read = hashed(tokens(F.col("text"))).alias("words")
    found = hits(keyed.select("key", read), seeds, block)
    if found is None:
        return docs.select("row", F.lit(None).cast("bigint").alias("item_id"), F.lit(0).alias("start_token"), F.lit(0.0).alias("agreement")).where("false")
    found = materialise(found, "decontaminate-hits")
    named = found.select("key").distinct()
    named = F.broadcast(named) if found.count() <= few else named  # of about 40 bytes
    hit = keyed.join(named, "key", "left_semi").dropDuplicates(["key"]).select("key", read)
    sides = bench.select("item", "item_id", F.col("words").alias("its"))
    compared = hit.join(found, "key").join(sides, "item").select("key.row", "item_id", F.col("start").alias("start_token"), _agreement(region).alias("agreement"))
    checked = compared.where(F.col("agreement") >= SHARE)
    best = F.max(F.struct("agreement", (-F.col("start_token")).alias("before")))
    return checked.groupBy("row", "item_id").agg(best.alias("b")).select("row", "item_id", (-F.col("b.before")).alias("start_token"), F.col("b.agreement").alias("agreement"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, where the item starts, agreement."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("row"), "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("row", "doc_id")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain an item of the benchmark go."""
    row, = free_name(docs, "row_key")
    keyed = docs.withColumn(row, F.struct("doc_id", F.xxhash64("text").alias("of_text")))
    found = overlaps(keyed.select(F.col(row).alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = materialise(found.select(F.col("row").alias(row)).distinct(), "decontaminate-dirty")
    few = dirty.count() <= 2_000_000  # of about 40 bytes
    return keyed.join(F.broadcast(dirty) if few else dirty, row, "left_anti").select(docs.columns)
