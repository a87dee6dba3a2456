"""Near-duplicate texts by five-word Jaccard similarity: SimHash clusters, then an exact check.

Texts with equal sets of shingles are one class. The trie self-join of their
wide fingerprints (``simhash.wide_links``) gives candidates, whose components
are clusters: two classes of similarity ``share`` lie in one cluster with a
chance of 0.999, by the number of fronts. Classes are linked only if their
sets' similarity, counted exactly, is at least ``share``.

Within a cluster only pairs of different components are compared: all of them
where they are few, else those of one class against the rest, for some rounds
with the components of the links found so far in between. A large cluster still
open after these is cut into chunks, each pair of chunks is a unit, and a unit's
pairs are all counted at once by matrix products. No candidate is left out;
large clusters of texts that are *not* alike cost their square in arithmetic.

Defined results: texts of up to five words are one shingle; null and empty
texts are one class; similarity 1 needs equal sets, not equal texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import materialise
from provenant.llm.components import connected_components
from provenant.llm.simhash import Fronts, wide_fingerprint, wide_links

WORDS = 5
SHARE = 0.8


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    body = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-1].tolist()]
    last = (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(body[a:b]) for a, b in zip(starts, last, strict=False)], np.uint64))


def _sketch(text: Column, words: int) -> Column:
    """Class, number of shingles and wide fingerprint of a text; no fingerprint for an empty set."""

    @F.arrow_udf("cls bigint, size int, words array<bigint>")
    def of(part: pa.Array) -> pa.Array:
        sets = [shingles(t) for t in part.to_pylist()]
        cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        prints = [wide_fingerprint(s, words).view(np.int64) if len(s) else [] for s in sets]
        return pa.StructArray.from_arrays([pa.array(cls), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints, pa.list_(pa.int64()))], ["cls", "size", "words"])

    return of(text)


def _hashes(text: Column) -> Column:
    @F.arrow_udf("binary")
    def of(part: pa.Array) -> pa.Array:
        return pa.array([shingles(t).tobytes() for t in part.to_pylist()], pa.binary())

    return of(text)


def _similarity(its: Column, theirs: Column) -> Column:
    """Jaccard similarity of two sets of hashes; not both are empty."""

    def one(x: bytes, y: bytes) -> float:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both)

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return of(its, theirs)


def _alike_in_size(a: str, b: str, share: float) -> Column:
    """Sets whose sizes differ by more cannot be that similar."""
    return F.least(a, b) >= F.lit(share) * F.greatest(a, b)


def _candidates(open_: DataFrame, turn: int, share: float, large: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``open_(key, cls, size, comp, few)`` to compare in this round."""
    small = open_.where("few")
    other = small.select("key", F.col("cls").alias("cls2"), F.col("size").alias("size2"), F.col("comp").alias("comp2"))
    pairs = small.join(other, "key").where(F.col("comp") < F.col("comp2"))
    if large:
        many = open_.where("NOT few")
        head = F.min(F.struct(F.xxhash64(F.lit(turn), "cls"), "cls", "size", "comp")).alias("h")
        heads = many.groupBy("key").agg(head).select("key", F.col("h.cls").alias("cls2"), F.col("h.size").alias("size2"), F.col("h.comp").alias("comp2"))
        pairs = pairs.unionByName(many.join(heads, "key").where(F.col("comp") != F.col("comp2")))
    return pairs.where(_alike_in_size("size", "size2", share)).select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def all_links(comp: np.ndarray, sets: list[np.ndarray], share: float) -> np.ndarray:
    """Distinct pairs of components that have members of that similarity, as rows."""
    n, size = len(sets), np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    at = np.searchsorted(shared, column)
    held = count[column] > 1
    row, at = row[held], at[held]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((n, n))
    for i in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(at, (i, i + 4096))
        strip = np.zeros((n, min(4096, len(shared) - i)), np.float32)
        strip[row[lo:hi], at[lo:hi] - i] = 1
        both += strip @ strip.T
    a, b = np.nonzero((both / (size[:, None] + size[None, :] - both) >= share) & (comp[:, None] < comp[None, :]))
    return np.unique(np.stack((comp[a], comp[b]), axis=1), axis=0)


def _crowd_links(many: DataFrame, sets: DataFrame, share: float, cell: int = 512, hashes: int = 500_000) -> DataFrame:
    """Links (a, b) of components within large groups; a chunk holds about ``cell`` sets and ``hashes`` hashes at most."""
    sizes = many.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / cell, F.sum("size") / hashes)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    dealt = many.join(sizes, "key").select("cls", "comp", F.explode(units).alias("unit")).join(sets, "cls").select("unit", "comp", "hashes")

    def meet(table: pa.Table) -> pa.Table:
        found = all_links(table["comp"].to_numpy(), [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()], share)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return dealt.groupBy("unit").applyInArrow(meet, "a bigint, b bigint")


def clusters(classes: DataFrame, plan: Fronts) -> DataFrame:
    """(cls, size, key) of the classes that have candidates; key is their cluster."""
    names = [f"f{i}" for i in range(plan.words)]
    words = classes.where("size > 0").select("cls", *(F.get("words", F.lit(i)).alias(f) for i, f in enumerate(names)))
    roots = connected_components(wide_links(materialise(words, "near-words"), "cls", names, plan), "near-clusters")
    return classes.select("cls", "size").join(roots.withColumnRenamed("node", "cls"), "cls").withColumnRenamed("root", "key")


def near_classes(docs: DataFrame, prints: DataFrame, plan: Fronts, rounds: int = 3) -> DataFrame | None:
    """(node, root) for each class linked with another, or None; ``prints`` is ``sketches(docs)``, stored."""
    share = plan.share
    # what a class's rows share; any of its texts will do
    classes = materialise(prints.groupBy("cls").agg(F.first("size").alias("size"), F.min("of_text").alias("of_text"), F.first("words").alias("words")), "near-classes")
    entries = materialise(clusters(classes, plan).withColumn("comp", F.col("cls")), "near-entries")
    sets = links = checked = roots = None
    for turn in range(rounds):
        parts = entries.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
        unsettled = parts.where("n * n > s").select("key", F.expr("n * n - s <= 8 * n").alias("few"))
        open_ = materialise(entries.join(unsettled, "key"), "near-open")
        if open_.isEmpty():
            break
        if sets is None:
            need = open_.select("cls").distinct().join(classes.select("cls", "of_text"), "cls")
            # by sort and merge at every size: the candidates grow with the documents
            texts = docs.select(F.xxhash64("text").alias("of_text"), "text").join(need.hint("merge"), "of_text")
            sets = materialise(texts.groupBy("cls").agg(F.first("text").alias("text")).select("cls", _hashes(F.col("text")).alias("hashes")), "near-sets")
        last = turn == rounds - 1
        pairs = _candidates(open_, turn, share, not last)
        pairs = materialise(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), "near-pairs")
        checked = pairs if checked is None else checked.unionByName(pairs)
        sided = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("its")), "a").join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("theirs")), "b")
        found = sided.where(_similarity(F.col("its"), F.col("theirs")) >= share).select("a", "b")
        found = materialise(found.unionByName(_crowd_links(open_.where("NOT few"), sets, share)) if last else found, "near-links")
        links = found if links is None else links.unionByName(found)
        roots = connected_components(links, "near")
        entries = open_.where("NOT few").select("key", "cls", "size").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "size", F.coalesce("root", "cls").alias("comp"))
    return roots


def sketches(docs: DataFrame, plan: Fronts) -> DataFrame:
    """(doc_id, of_text, cls, size, words) for each row, stored."""
    return materialise(docs.select("doc_id", F.xxhash64("text").alias("of_text"), _sketch(F.col("text"), plan.words).alias("s")).select("doc_id", "of_text", "s.*"), "near-prints")


def kept_rows(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, of_text, n): of each component the row of least id, null ids last, and how many rows it names."""
    plan = Fronts(docs.count(), share)
    prints = sketches(docs, plan)
    roots = near_classes(docs, prints, plan)
    rows = prints.groupBy("doc_id", "of_text", "cls").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "of_text", "n")).alias("first")
    classes = rows.groupBy("cls").agg(first)
    if roots is not None:
        # one row a class by now, so a class of many copies is no hot key
        classes = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        classes = classes.groupBy(F.coalesce("root", "cls").alias("cls")).agg(F.min("first").alias("first"))
    return materialise(classes.select("first.doc_id", "first.of_text", "first.n"), "near-kept")
