"""Toxicity by a lexicon, matched through Levenshtein automata, and the context of its hits.

Learning (labelled rows only): document counts of words and of word stems give
the lexicon: terms of which most documents are toxic, and so many that no word
out of all would be by chance (see ``unlikely``). How much evidence that takes
depends on the share of toxic documents and the log of the number of words, not
on the number of documents. Each term keeps the toxicity of the documents that
hold it, and of those that hold a misspelling of it. Every labelled text is
read and counts with its own label; copies of one text, and texts with the same
least shingle, weigh as much as one text together, each its part.

A word is a run of letters, within which one or two digits or signs may stand
for others, as in ``id1ot``.

Matching: the Levenshtein automaton of a word (one error for terms of 4 to 7
letters, two from 8 on, none for shorter ones and stems) is intersected with
the lexicon's trie. The product is made deterministic lazily and shared by all
words, so a word costs one table step a letter; the table is emptied at
``STATES`` states.

Scoring: hits are told apart by a window of ``WINDOW`` words around them: a hit
between quotation marks, or next to a word that reports speech, counts by what
such hits meant in the labelled rows. Hits combine as independent causes; a
text without a hit scores what such texts did.

Defined results: null, empty and wordless texts score as a text without a hit;
with no labels at all every score is 0; rows repeat as given; a document with
several labels has their mean; a null id has no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import documents, held_out, materialise

LEXICON = 200_000  # terms that fit a worker; more are an error, none is left out
UNIT = 720_720  # parts of a text's weight; divisible by all numbers up to 16
CHANCE = 0.01  # of any word at all entering the lexicon without being toxic
STEMS = range(4, 9)
WINDOW, STATES = 6, 50_000
LIKELY = 0.5  # least worth of a hit
WORD = re.compile(r"[^\W\d_]+(?:[0-9@$+*!|]{1,2}[^\W\d_]+)*")
_WORD_SQL = r"\p{L}+(?:[0-9@$+*!|]{1,2}\p{L}+)*"
#: Words that introduce somebody else's words.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word words term insult insults a_dit dit écrit appelé mot sagte schrieb nannte wort dijo escribió llamó palabra".split())
_OPEN_QUOTES = "\"“”„«»"


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


@dataclass
class _Node:
    next: dict[str, int] = field(default_factory=dict)
    term: int = -1
    stem: int = -1
    reach: int = 0  # errors that some term below allows


class LexiconAutomaton:
    """Trie of terms and stems, walked by the Levenshtein automaton of whatever word comes in."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms, self.stems = terms, stems
        self.nodes = [_Node()]
        for i, term in enumerate(terms):
            self.nodes[self._add(term, errors_allowed(term))].term = i
        for i, stem in enumerate(stems):
            self.nodes[self._add(stem, 0)].stem = i
        self._reset()

    def _add(self, text: str, reach: int) -> int:
        at = 0
        for c in text:
            self.nodes[at].reach = max(self.nodes[at].reach, reach)
            if c not in self.nodes[at].next:
                self.nodes[at].next[c] = len(self.nodes)
                self.nodes.append(_Node())
            at = self.nodes[at].next[c]
        self.nodes[at].reach = max(self.nodes[at].reach, reach)
        return at

    def _reset(self) -> None:
        self.states: list[tuple[tuple[tuple[int, int], ...], int]] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state(self._close({0: 0}), -1)

    def _close(self, found: dict[int, int]) -> dict[int, int]:
        """Letters of the term that the word leaves out cost one error each."""
        todo = list(found)
        while todo:
            at = todo.pop()
            cost = found[at] + 1
            for child in self.nodes[at].next.values():
                if cost <= self.nodes[child].reach and cost < found.get(child, 9):
                    found[child] = cost
                    todo.append(child)
        return found

    def _state(self, found: dict[int, int], stem: int) -> int:
        key = (tuple(sorted(found.items())), stem)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        pairs, stem = self.states[state]
        found: dict[int, int] = {}
        for at, cost in pairs:
            node = self.nodes[at]
            for c, child in node.next.items():
                price = cost + (c != letter)
                if price <= self.nodes[child].reach and price < found.get(child, 9):
                    found[child] = price
            if cost + 1 <= node.reach and cost + 1 < found.get(at, 9):
                found[at] = cost + 1
        for at, cost in found.items():
            if cost == 0 and self.nodes[at].stem >= 0:
                stem = self.nodes[at].stem
        return self._state(self._close(found), stem)

    def match(self, word: str) -> tuple[list[tuple[int, int]], int]:
        """[(term, errors)] of all terms within reach of the word, and the longest stem it begins with, or -1."""
        if len(self.states) > STATES:
            self._reset()
        state = self.start
        for letter in word:
            step = (state, letter)
            if step not in self.steps:
                self.steps[step] = self._step(state, letter)
            state = self.steps[step]
            if not self.states[state][0]:
                break
        pairs, stem = self.states[state]
        terms = [(self.nodes[at].term, cost) for at, cost in pairs if self.nodes[at].term >= 0 and cost <= errors_allowed(self.terms[self.nodes[at].term])]
        return terms, stem


@dataclass
class ToxicityModel:
    terms: list[str]
    stems: list[str]
    exact: list[float]
    misspelt: list[float]
    stem: list[float]
    quoted: float = 0.5  # what a quoted hit is worth, next to 1 for a plain one
    plain_text: float = 0.0  # score of a text without hits

    def matcher(self) -> LexiconAutomaton:
        return LexiconAutomaton(self.terms, self.stems)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.automaton, self.cache = model, model.matcher(), {}

    def word(self, word: str) -> float:
        """Toxicity of one word by the lexicon: its best match."""
        worth = self.cache.get(word)
        if worth is None:
            terms, stem = self.automaton.match(word)
            m = self.model
            worth = max([0.0, *(m.exact[t] if e == 0 else m.misspelt[t] for t, e in terms), *([m.stem[stem]] if stem >= 0 else [])])
            if any(e == 0 for _, e in terms):  # a term is itself, not a misspelling of another
                worth = max(m.exact[t] for t, e in terms if e == 0)
            if worth < LIKELY:  # more often innocent than not: many such words together prove nothing
                worth = 0.0
            if len(self.cache) >= 500_000:
                self.cache.clear()
            self.cache[word] = worth
        return worth

    def hits(self, text: str | None) -> list[tuple[int, int, str, float, bool]]:
        """(start, end, word, worth, quoted) of each word that the lexicon knows."""
        if not text or not (self.model.terms or self.model.stems):
            return []
        words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
        worth = self.word
        found = [(i, w) for i, (_, _, x) in enumerate(words) if (w := worth(x)) > 0]
        out = []
        for i, value in found:
            start, end, word = words[i]
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            before, after = text[near[0][0] : start], text[end : near[-1][1] + 1]
            between = any(q in before for q in _OPEN_QUOTES) and any(q in after for q in _OPEN_QUOTES)
            reported = any(x in REPORTING for _, _, x in words[max(0, i - 3) : i])
            out.append((start, end, word, value, between or reported))
        return out

    def score(self, text: str | None) -> float:
        return combine([(value, quoted) for _, _, _, value, quoted in self.hits(text)], self.model)


def combine(hits: list[tuple[float, bool]], model: ToxicityModel) -> float:
    """One minus the chance that no hit is meant, never below a text without hits."""
    innocent = 1.0
    for value, quoted in hits:
        innocent *= 1 - value * (model.quoted if quoted else 1.0)
    return min(1.0, max(model.plain_text, 1 - innocent))


def _shared_rate(toxic: np.ndarray, clean: np.ndarray, prior: float, weight: float) -> np.ndarray:
    return (toxic + weight * prior) / (toxic + clean + weight)


def unlikely(t: Column, n: Column, share: float, words: int) -> Column:
    """Whether t of n documents being toxic is too much for the luckiest of ``words`` words (Chernoff's bound)."""
    p = min(max(share, 1e-9), 1 - 1e-9)
    rate = t / n
    clean = F.when(t < n, (n - t) * F.log((1 - rate) / F.lit(1 - p))).otherwise(0.0)
    return (rate > p) & (F.when(t > 0, t * F.log(rate / F.lit(p))).otherwise(0.0) + clean >= float(np.log(max(1, words) / CHANCE)))


def _copy(text: Column) -> Column:
    """The least hash of a text's five-word shingles: copies share it, near copies mostly, others hardly ever."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def least(bound: Column) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(bound) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(bound, i, 5))))

    # bound to a lambda variable, so that the text is split once
    return F.get(F.transform(F.array(words), least), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, lexicon: int = LEXICON, precision: float = 0.8) -> ToxicityModel:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Every labelled text counts, with its own label: texts that share their least
    shingle (:func:`_copy`) are one piece of evidence together, each weighing one
    part of it. Weights are whole parts of ``UNIT``, so sums do not depend on
    their order; an id labelled several times has its mean label.

    Only the lexicon and sums by term come to the driver; ``ValueError`` if
    there are more than ``lexicon`` rows of a kind.
    """
    # labels grow with the documents: sorted and merged at every size, and no text travels but once
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.sum((F.col("toxic") > 0).cast("bigint")).alias("y"), F.count("*").alias("m"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("of")).where("text IS NOT NULL")
    each = materialise(texts.select("doc_id", "of", _copy(F.col("text")).alias("copy")).join(known.hint("merge"), "doc_id"), "toxicity-copies")
    sizes = each.groupBy("copy").agg(F.count("*").alias("size"))
    weight = F.greatest(F.lit(1), F.round(F.lit(UNIT) / F.col("size")).cast("bigint"))
    weights = each.groupBy("doc_id", "of").agg(F.min("copy").alias("copy"), F.min("y").alias("y"), F.min("m").alias("m")).join(sizes, "copy").withColumn("n", weight)
    weights = weights.select("doc_id", "of", F.round(F.col("n") * F.col("y") / F.col("m")).cast("bigint").alias("t"), "n")
    rows = materialise(texts.join(weights.hint("merge"), ["doc_id", "of"]).select("text", "t", "n"), "toxicity-rows")
    n, toxic = (x / UNIT for x in rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first())
    if not toxic:
        return ToxicityModel([], [], [], [], [])
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD_SQL), F.lit(0)))
    seen = rows.select("t", "n", words.alias("words"))
    counted = lambda key: lambda df: df.groupBy(key).agg((F.sum("t") / UNIT).alias("t"), (F.sum("n") / UNIT).alias("n"))
    by_word = materialise(counted("word")(seen.select("t", "n", F.explode("words").alias("word"))), "toxicity-words")
    stems = F.array_distinct(F.flatten(F.transform("words", lambda w: F.transform(F.array(*map(F.lit, STEMS)), lambda k: F.when(F.length(w) > k, F.substring(w, F.lit(1), k))))))

    def admitted(table: DataFrame, key: str, tried: int) -> list[tuple[str, float, float]]:
        evident = (F.col("t") >= (precision - 1e-9) * F.col("n")) & unlikely(F.col("t"), F.col("n"), toxic / n, tried)
        found = [tuple(r) for r in table.where(evident).select(key, "t", "n").limit(lexicon + 1).collect()]
        if len(found) > lexicon:
            raise ValueError(f"more than {lexicon} toxic terms; a higher precision or lexicon is needed")
        return sorted(found, key=lambda r: (-r[1], r[2], r[0]))

    # stems are counted where several words of toxic texts share them; whole words that a stem covers are dropped
    likely = by_word.where((F.col("t") > 0) & (F.col("t") >= 0.5 * F.col("n")))
    shared = likely.select(F.explode(F.array(*(F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEMS))).alias("stem"), F.col("t").alias("s")).where("stem IS NOT NULL")
    shared = shared.groupBy("stem").agg(F.count("*").alias("forms"), F.sum("s").alias("s")).where("forms >= 3")
    by_stem = counted("stem")(seen.select("t", "n", F.explode(stems).alias("stem")))
    by_stem = materialise(by_stem.join(shared.select("stem"), "stem", "left_semi"), "toxicity-stems")
    stem_rows = admitted(by_stem, "stem", by_stem.count())
    chosen = {s for s, _, _ in stem_rows}
    stem_rows = [r for r in stem_rows if not any(r[0][:k] in chosen for k in range(min(STEMS), len(r[0])))]
    chosen = {s for s, _, _ in stem_rows}
    term_rows = [r for r in admitted(by_word, "word", by_word.count()) if not any(r[0][:k] in chosen for k in range(min(STEMS), len(r[0]) + 1))]
    rate = lambda found: _shared_rate(np.array([t for _, t, _ in found], float), np.array([n - t for _, t, n in found], float), toxic / n, 1.0).tolist()
    model = ToxicityModel([r[0] for r in term_rows], [r[0] for r in stem_rows], rate(term_rows), [0.0] * len(term_rows), rate(stem_rows))
    model.misspelt = _misspelt(by_word, model)
    return _context(rows, model)


def _misspelt(by_word: DataFrame, model: ToxicityModel) -> list[float]:
    """For each term the toxicity of documents with a misspelling of it, shrunk towards that of all terms."""
    if not model.terms:
        return []
    spark = by_word.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.matcher()
        sums = np.zeros((len(automaton.terms), 2))
        for batch in batches:
            for word, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, stem = automaton.match(word)
                if found and stem < 0 and all(e for _, e in found):
                    for term, _ in found:
                        sums[term] += (t, n - t)
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at, 0]), pa.array(sums[at, 1])], ["term", "t", "c"])

    found = by_word.select("word", "t", "n").mapInArrow(run, "term int, t double, c double").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    sums = np.zeros((len(model.terms), 2))
    for r in found:
        sums[r.term] = r.t, r.c
    # nothing seen: a misspelling is worth 0.8; one clean document with it outweighs that
    return _shared_rate(sums[:, 0], sums[:, 1], 0.8, 1.0).tolist()


def _context(rows: DataFrame, model: ToxicityModel) -> ToxicityModel:
    """What texts without hits, with plain hits and with quoted hits only turned out to be."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("int")
    def kind(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for part in parts:
            hits = [scorer.hits(t) for t in part.to_pylist()]
            yield pa.array([0 if not h else 1 if any(not x[4] for x in h) else 2 for h in hits], pa.int32())

    sums = {r.kind: (r.t, r.n) for r in rows.select(kind("text").alias("kind"), "t", "n").groupBy("kind").agg((F.sum("t") / UNIT).alias("t"), (F.sum("n") / UNIT).alias("n")).collect()}
    plain, quoted, none = (sums.get(k, (0, 0)) for k in (1, 2, 0))
    model.quoted = min(1.0, ((quoted[0] + 2.0) / (quoted[1] + 4.0)) / max(0.05, (plain[0] + 1.0) / (plain[1] + 1.0)))
    model.plain_text = float(none[0] / none[1]) if none[1] else 0.0
    return model


def toxicity(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """A struct of the score and the hits: where, which word, its worth, and whether it is quoted."""
    shared = spark.sparkContext.broadcast(model)
    hit = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string()), ("worth", pa.float64()), ("quoted", pa.bool_())])

    @F.arrow_udf("struct<score:double,hits:array<struct<start:int,end:int,word:string,worth:double,quoted:boolean>>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for part in parts:
            hits = [scorer.hits(t) for t in part.to_pylist()]
            scores = [combine([(h[3], h[4]) for h in x], scorer.model) for x in hits]
            rows = [[dict(zip(("start", "end", "word", "worth", "quoted"), h, strict=True)) for h in x] for x in hits]
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(rows, pa.list_(hit))], ["score", "hits"])

    return run(text)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = fit(docs.where(~held_out(F.col("doc_id"))), labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(spark, model, F.col("text")).alias("r"))
    return scored.select("doc_id", "held_out", "r.score", F.when(F.col("r.score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("r.hits").alias("n_hits"))
