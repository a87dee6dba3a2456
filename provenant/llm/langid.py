"""Language ID by multilingual mixture inference.

A document is a bag of letter trigrams drawn from a mixture of languages. The
trigram distributions come from labelled text; expectation-maximisation
estimates the mixing proportions of each document, and languages join its set
one at a time as long as the log-likelihood rises by more than a penalty that
grows with the log of the number of trigrams.

Trigrams are hashed into ``buckets`` counters, so a model is a table of
languages x buckets however large the corpus is; buckets are halved until that
table has ``MODEL_BYTES`` at most, whatever stands in the language column. All
labelled text is counted.

The evidence for a document's set is what a trigram's mean log-likelihood gains
over a background where every bucket is as likely: below zero, no set of the
languages learned explains the text.

Defined results: null text, empty text and text without a letter give ``und``
with score 0; ties go to the language that sorts first; rows repeat as given;
with no labelled text at all every document is ``und``. Null languages teach
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import documents, held_out, materialise

BUCKETS = 1 << 16
UNDETERMINED = "und"
MODEL_BYTES = 1 << 28  # of the table that goes to every worker
_RESULT = "lang string, score double, langs array<string>, shares array<double>, evidence double"


@lru_cache(1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every letter trigram; runs of other characters act as one blank."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[cp]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    body = np.where(letter, cp, np.uint32(32))[keep].astype(np.uint64)
    padded = np.concatenate((np.array([32], np.uint64), body, np.array([32], np.uint64)))
    h = padded[:-2] * np.uint64(0x9E3779B97F4A7C15) + padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[2:] * np.uint64(0x165667B19E3779F9)
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


@dataclass
class MixtureModel:
    """Trigram probabilities, one column a language."""

    langs: list[str]
    probs: np.ndarray  # buckets x languages
    penalty: float = 6.0
    iterations: int = 25

    @classmethod
    def from_counts(cls, langs: list[str], counts: np.ndarray, smoothing: float = 0.5, **options) -> MixtureModel:
        smooth = counts.T + smoothing
        return cls(langs, smooth / smooth.sum(axis=0), **options)

    def _em(self, probs: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        total = n.sum()
        for _ in range(self.iterations):
            mix = probs @ share
            new = share * ((n / mix) @ probs) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(probs @ share))

    def infer(self, text: str | None) -> tuple[str, float, list[str], list[float], float]:
        """Main language, its share, the whole set with shares, and the evidence a trigram."""
        grams = trigrams(text, len(self.probs)) if text and self.langs else ()
        if not len(grams):
            return UNDETERMINED, 0.0, [], [], 0.0
        ids, n = np.unique(grams, return_counts=True)
        probs, n = self.probs[ids], n.astype(np.float64)
        total = n.sum()
        alone = n @ np.log(probs)
        chosen, share = [int(np.argmax(alone))], np.ones(1)
        best, price = float(alone[chosen[0]]), self.penalty * np.log(total + 1)
        while len(chosen) < len(self.langs):
            gain = (n / (probs[:, chosen] @ share)) @ probs / total
            gain[chosen] = 0
            k = int(np.argmax(gain))
            # the log-likelihood is concave: no mixture with k gains more than this
            if total * np.log(max(gain[k], 1.0)) <= price:
                break
            start = np.append(share * 0.8, 0.2)
            new, value = self._em(probs[:, [*chosen, k]], n, start)
            if value - best <= price:
                break
            chosen, share, best = [*chosen, k], new, value
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], self.langs[chosen[i]]))
        langs, shares = [self.langs[chosen[i]] for i in order], [float(share[i]) for i in order]
        return langs[0], min(1.0, shares[0]), langs, shares, best / total + float(np.log(len(self.probs)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, np.int64)
            np.add.at(counts[lang], *np.unique(trigrams(text), return_counts=True))
    for lang, c in counts.items():
        ids = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(c[ids], pa.int64())], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", **options) -> MixtureModel:
    """Count the trigrams of all labelled rows; the driver gets languages x buckets sums, of a checked size."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sums = materialise(rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langid-counts")
    known, buckets = sums.select("lang").distinct().count(), BUCKETS
    while known * buckets * 8 > MODEL_BYTES and buckets > 64:
        buckets //= 2
    if known * buckets * 8 > MODEL_BYTES:
        raise ValueError(f"{known} languages; a language column holds a few thousand at most")
    # a smaller power of two: the bucket of a trigram is what remains of the larger one
    table = sums.groupBy("lang", (F.col("bucket") % buckets).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    names = table.column("lang").combine_chunks().dictionary_encode() if len(table) else None
    spoken = names.dictionary.to_pylist() if names is not None else []
    langs = sorted(spoken)
    counts = np.zeros((len(langs), buckets))
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        code = np.array([at[x] for x in spoken])[names.indices.to_numpy()]
        counts[code, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return MixtureModel.from_counts(langs, counts, **options)


def identify(spark: SparkSession, model: MixtureModel, text: Column) -> Column:
    """A struct column: lang, score (its share), and the whole set with shares."""
    shared = spark.sparkContext.broadcast((model.langs, model.probs, model.penalty, model.iterations))

    @F.arrow_udf(_RESULT)
    def infer(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = MixtureModel(*shared.value)
        for part in parts:
            got = [own.infer(t) for t in part.to_pylist()]
            cols = list(zip(*got, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "score", "langs", "shares", "evidence"])

    return infer(text)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(spark, model, F.col("text")).alias("r")).select(
        "doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.langs", "r.shares", "r.evidence"
    )


def reject_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that no set of the learned languages explains go.

    These have no letter at all, or a background of equally likely trigrams
    explains them better than the languages do, as text in another script.
    A document in several learned languages stays, however many they are.

    Where nothing is labelled there is no model, and nothing is rejected.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    if not model.langs:
        return docs
    lang = identify(spark, model, F.col("text"))
    return docs.where((lang["lang"] != UNDETERMINED) & (lang["evidence"] > 0))
