"""Many retrieval variants from two passes over the entries.

A variant ranks by a vector column, by a text column, by both (z-scores added),
or by the text within a pool of the nearest vectors.

Text scores depend on a probe's question alone, its query and mark, and probes
often share one. So the first pass scores every entry for the different
questions: it gives the best entries of the text variants, the means and spreads
of the text scores, and for each vector column its mean and a triangular factor,
from which every probe's mean and spread follow without a look at the pairs.

The second pass scores the vectors. As a fusion's weights are known by then, its
score is one number, like that of a vector column. A task multiplies tiles of a
fixed size in single precision; what the error bound leaves in question is scored
again in double, always in one order of addition. A task sends its best entries
as one row a probe and list; rows of a probe meet sorted by probe, and all
variants are ranked there.

Questions go out in blocks of ``QUESTIONS``, probes in blocks of at most
``PROBE_BYTES``, and one block is one pass. What a task holds depends on the
blocks and tiles, not on the entries.

Defined results: null vectors and texts score zero, as do those without a common
word; an entry that a variant's index leaves out is no candidate; ties go to the
smaller entry index; a target that is not among the first k has no rank, counts
as k + 1 in the mean and median and as zero in the mean reciprocal rank. A probe
whose vector is not finite has no candidates by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.operators.relational import renumbered, scratch
from provenant.operators.retrieval import PROBE_BYTES, _dots

QUESTIONS = 1024  # of one block, whose scores a task holds for a tile of entries
TILE, PIECE, PAIRS = 2048, 512, 1 << 16  # entries and probes of one product; pairs scored again at a time
HELD = 1 << 23  # entries times words of one table of words held
MERGED = 8192  # rows of whole probes that are merged at a time


@dataclass(frozen=True)
class Variant:
    """``visual``, ``text``, ``kept``: columns of the entries; vectors are met by the probes' column of the same name.

    ``weight`` is the text's in a fusion; with ``pool`` the text only reorders the
    nearest ``pool`` entries. ``boost`` is added where the text holds a probe's mark.
    """

    name: str
    visual: str | None = None
    text: str | None = None
    weight: float = 0.35
    pool: int | None = None
    boost: float = 0.0
    kept: str | None = None

    def __post_init__(self) -> None:
        if not (self.visual or self.text) or self.weight < 0 or (self.pool and not (self.visual and self.text)):
            raise ValueError(f"{self.name}: a variant needs a vector or a text, a weight of at least 0, and both for a pool")

    @property
    def fused(self) -> bool:
        return bool(self.visual and self.text and not self.pool)


Measure = tuple[str, float]  # a text column and the boost of a mark


def _measure(v: Variant) -> Measure:
    return v.text, v.boost


class Questions:
    """A block of different questions: query words and a mark."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("question").to_numpy()
        queries = [tuple(t or ()) for t in rows.column("query_tokens").to_pylist()]
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for q in queries for w in q))}
        self.counts = np.zeros((len(self.words), len(queries)), np.float32)
        for i, q in enumerate(queries):
            for w in q:
                self.counts[self.words[w], i] += 1
        self.marked: dict[str, list[int]] = {}
        for i, mark in enumerate(rows.column("mark").to_pylist()):
            if mark:
                self.marked.setdefault(mark, []).append(i)

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for mark in self.marked:
            out.add_word(mark, mark)
        out.make_automaton()
        return out

    def score(self, part: pa.RecordBatch, measures: list[Measure]) -> dict[Measure, np.ndarray]:
        """(entries, questions) for each measure."""
        columns = {c: part.column(c).fill_null([]) for c, _ in measures}
        plain = {c: lexical(tokens, self) for c, tokens in columns.items()}
        return {(c, boost): plain[c] + boost * boosts(columns[c], self) if boost else plain[c] for c, boost in measures}


def lexical(tokens: pa.Array, asked: Questions) -> np.ndarray:
    """(entries, questions): query term counts of the words an entry holds, over the root of its length."""
    sizes = np.diff(tokens.offsets.to_numpy())
    coded = tokens.flatten().dictionary_encode()
    known = np.array([asked.words.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
    word = known[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)[word >= 0]
    some, word = np.unique(word[word >= 0], return_inverse=True)
    counts, out = asked.counts[some], np.empty((len(sizes), len(asked.ids)))
    step = max(1, HELD // max(1, len(some)))
    edges = np.searchsorted(row, np.arange(0, len(sizes) + step, step))
    for i, at in enumerate(range(0, len(sizes), step)):
        held = np.zeros((min(step, len(sizes) - at), len(some)), np.float32)
        held[row[edges[i] : edges[i + 1]] - at, word[edges[i] : edges[i + 1]]] = 1
        out[at : at + step] = held @ counts  # whole numbers, exact in single precision
    return out / np.sqrt(np.maximum(sizes, 1))[:, None]


def boosts(tokens: pa.Array, asked: Questions) -> np.ndarray:
    """(entries, questions): whether an entry's text holds the question's mark, all marks in one go."""
    out = np.zeros((len(tokens), len(asked.ids)), bool)
    if asked.marked:
        for i, own in enumerate(tokens.to_pylist()):
            for mark in {m for _, m in asked.matcher.iter(" ".join(own or ()))}:
                out[i, asked.marked[mark]] = True
    return out


class Top:
    """The first ``k`` entries of each row by score, ties to the smaller index; ``extra`` values travel along."""

    def __init__(self, k: int, rows: int, extra: int = 0):
        self.k = k
        self.score, self.entry = np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)
        self.extra = np.zeros((rows, k, extra))

    def add(self, entries: np.ndarray, score: np.ndarray, rows: np.ndarray | None = None, extra: np.ndarray | None = None) -> None:
        """``score(entries, rows)``; of entries that tie with the last one only those before it."""
        rows = np.arange(score.shape[1]) if rows is None else rows
        for at in range(0, len(entries), 256):
            some, s = entries[at : at + 256], score[at : at + 256]
            least, last = self.score[rows, -1], self.entry[rows, -1]
            col, row = np.nonzero((s > least) | ((s == least) & (some[:, None] < last)))
            self.merge(rows[row], some[col], s[col, row], extra[at : at + 256][col, row] if extra is not None else None)

    def merge(self, row: np.ndarray, entry: np.ndarray, score: np.ndarray, extra: np.ndarray | None = None) -> None:
        if not len(row):
            return
        touched, count = np.unique(row, return_counts=True)
        row = np.concatenate([row, np.repeat(touched, self.k)])
        entry, score = np.concatenate([entry, self.entry[touched].ravel()]), np.concatenate([score, self.score[touched].ravel()])
        order = np.lexsort((entry, -score, row))
        count = count + self.k
        order = order[np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count) < self.k]
        self.score[touched], self.entry[touched] = score[order].reshape(-1, self.k), entry[order].reshape(-1, self.k)
        if extra is not None:
            both = np.concatenate([extra, self.extra[touched].reshape(-1, extra.shape[1])])
            self.extra[touched] = both[order].reshape(len(touched), self.k, -1)


def _filled(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; null ones, and those of another length than the probes', are zero."""
    out = np.zeros((len(column), width))
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    some = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    if len(some):
        out[some] = column.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(len(some), width)
    return out


def _gather(total: list, x: np.ndarray) -> None:
    """Count, mean and summed squared distance from it, of more rows."""
    if len(x):
        m = x.mean(axis=0)
        total[:] = _joined(total, [len(x), m, ((x - m) ** 2).sum(axis=0)])


def _joined(one: list, two: list) -> list:
    (n, mean, spread), (o, other, wide) = one, two
    both = max(1, n + o)
    return [n + o, mean + (other - mean) * o / both, spread + wide + (other - mean) ** 2 * n * o / both]


def _factored(total: list, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
    """Count, mean and a triangular factor of the squares around it, of ``n`` more rows with their mean and factor."""
    if n:
        m, own, factor = total
        both = m + n
        gap = (mean - own)[None] * (m * n / both) ** 0.5
        total[:] = both, own + (mean - own) * n / both, np.linalg.qr(np.concatenate([factor, rows, gap]), "r")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            yield batch.slice(start, TILE)


def _kept(part: pa.RecordBatch, flag: str | None) -> np.ndarray:
    return part.column(flag).fill_null(False).to_numpy(zero_copy_only=False) if flag else np.ones(part.num_rows, bool)


_COUNTED = "kind string, name string, boost double, kept string, question bigint, n bigint, entry array<bigint>, a array<double>, b array<double>"


def _count(shared, variants: tuple[Variant, ...], k: int, widths: dict[str, int]):
    """The first pass: text variants' best entries, and means and spreads of what fusions need."""
    ranked = [v for v in variants if not v.visual]
    fused = [v for v in variants if v.fused]
    said = list(dict.fromkeys((*_measure(v), v.kept) for v in fused))
    seen = list(dict.fromkeys((v.visual, v.kept) for v in fused if v.visual in widths))  # once, not once a block
    measures = list(dict.fromkeys([*map(_measure, ranked), *map(_measure, fused)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Questions = shared.value
        best = {v.name: Top(k, len(asked.ids)) for v in ranked}
        sums = {m: [0, np.zeros(len(asked.ids)), np.zeros(len(asked.ids))] for m in said}
        factors = {m: [0, np.zeros(widths[m[0]]), np.zeros((0, widths[m[0]]))] for m in seen}
        for part in _tiles(batches):
            entries, scores = part.column("entry_index").to_numpy(), asked.score(part, measures)
            kept = {f: _kept(part, f) for f in {v.kept for v in (*ranked, *fused)}}
            for v in ranked:
                best[v.name].add(entries[kept[v.kept]], scores[_measure(v)][kept[v.kept]])
            for m in said:
                _gather(sums[m], scores[m[:2]][kept[m[2]]])
            for m in seen:
                x = _filled(part.column(m[0]), widths[m[0]])[kept[m[1]]]
                mean = x.mean(axis=0) if len(x) else None
                _factored(factors[m], len(x), mean, x - mean if len(x) else x)
        rows = []
        for v in ranked:
            top = best[v.name]
            for i, held in enumerate(top.score > -np.inf):
                if held.any():
                    rows.append(("top", v.name, None, None, asked.ids[i], None, top.entry[i][held], top.score[i][held], None))
        for (c, boost, kept), (n, mean, spread) in sums.items():
            rows.append(("text", c, boost, kept, None, n, None, mean, spread))
        for (c, kept), (n, mean, factor) in factors.items():
            rows.append(("vector", c, None, kept, None, n, None, mean, factor.ravel()))
        if rows:
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _COUNTED.split(", ")])

    return run


class Asked:
    """A block of probes as matrices, its questions, and the weights of its fusions."""

    def __init__(self, rows: pa.Table, questions: Questions, widths: dict[str, int], variants: tuple[Variant, ...], k: int, said: dict, seen: dict):
        self.ids, self.questions = rows.column("probe_id").to_numpy(), questions
        self.question = np.searchsorted(questions.ids, rows.column("question").to_numpy())
        self.vectors = {c: _filled(rows.column(c).combine_chunks(), width) for c, width in widths.items()}
        self.scale = {c: np.maximum(np.abs(q).max(axis=1, initial=0), 1e-300) for c, q in self.vectors.items()}
        self.single = {c: (q / self.scale[c][:, None]).astype(np.float32) for c, q in self.vectors.items()}
        self.norm = {c: np.sqrt(np.square(q, dtype=np.float64).sum(axis=1)) for c, q in self.single.items()}
        self.weights = {}
        for v in variants:
            if v.fused:
                q = self.vectors[v.visual]
                n, mean, factor = seen.get((v.visual, v.kept), (0, np.zeros(q.shape[1]), np.zeros((0, q.shape[1]))))
                vm, vs = q @ mean, np.sqrt(np.square(q @ factor.T).sum(axis=1) / max(n, 1))
                n, mean, spread = said[(*_measure(v), v.kept)]
                tm, ts = mean[self.question], np.sqrt(spread / max(n, 1))[self.question]
                self.weights[v.name] = vm, vs, tm, ts
        # variants of one vector column and index share a list as long as the longest needs; texts come along
        self.lists: dict[tuple[str, str | None], tuple[int, list[Measure]]] = {}
        for v in variants:
            if v.visual and not v.fused:
                long, texts = self.lists.get((v.visual, v.kept), (0, []))
                texts = texts + [_measure(v)] if v.pool and _measure(v) not in texts else texts
                self.lists[v.visual, v.kept] = max(long, v.pool or k), texts

    def fuse(self, v: Variant, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Both z-scores added; zero for a spread below 1e-8."""
        vm, vs, tm, ts = (c[row] for c in self.weights[v.name])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(vs < 1e-8, 0.0, (a - vm) / vs) + v.weight * np.where(ts < 1e-8, 0.0, (b - tm) / ts)


def _first(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows by index of every set of equal rows of ``key``."""
    _, own = np.unique(np.ascontiguousarray(key + 0.0).view(np.dtype((np.void, key.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, own))
    return np.sort(order[np.arange(len(order)) - np.searchsorted(own[order], own[order]) < k])


_FOUND = "list int, probe_id bigint, entry array<bigint>, score array<double>, extra array<double>"


def _search(shared, variants: tuple[Variant, ...], k: int):
    """The second pass: best entries by vector columns and by fusions."""
    fused = [v for v in variants if v.fused]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        near = {key: Top(long, len(asked.ids), len(texts)) for key, (long, texts) in asked.lists.items()}
        both = {v.name: Top(k, len(asked.ids)) for v in fused}
        measures = list(dict.fromkeys([m for _, texts in asked.lists.values() for m in texts] + [_measure(v) for v in fused]))
        for part in _tiles(batches):
            ids = part.column("entry_index").to_numpy()
            said = asked.questions.score(part, measures)
            for c, q in asked.vectors.items():
                v = _filled(part.column(c), q.shape[1])
                _tile(asked, c, part, ids, v, said, near, [f for f in fused if f.visual == c], both)
        for i, top in enumerate([*near.values(), *both.values()]):
            for at in range(0, len(asked.ids), 4096):
                held = top.score[at : at + 4096] > -np.inf
                some = np.flatnonzero(held.any(axis=1))
                if len(some):
                    size, held = held.sum(axis=1)[some], held[some]
                    lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(x))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), i, np.int32)), pa.array(asked.ids[at + some]), lists(top.entry[at + some][held], size), lists(top.score[at + some][held], size), lists(top.extra[at + some][held].ravel(), size * top.extra.shape[2])],
                        [c.split()[0] for c in _FOUND.split(", ")],
                    )

    return run


def _tile(asked: Asked, c: str, part: pa.RecordBatch, ids: np.ndarray, v: np.ndarray, said: dict[Measure, np.ndarray], near: dict, fused: list[Variant], both: dict[str, Top]) -> None:
    """One tile of entries against all probes, by one vector column."""
    q, single = asked.vectors[c], asked.single[c]
    fine = np.isfinite(v).all(axis=1)
    scale = max(np.abs(v[fine]).max(initial=0), 1e-300)
    small = (np.where(fine[:, None], v, 0) / scale).astype(np.float32)
    # a single-precision product of n terms is off by less than this times both norms; tiny components may vanish besides
    longest = np.sqrt(np.square(small, dtype=np.float64).sum(axis=1).max(initial=0))
    slack = ((v.shape[1] + 16) * 2.0**-23 * longest + v.shape[1] * 2.0**-120) * asked.norm[c]
    # of equal rows only the first can matter
    kept = {f: np.flatnonzero(_kept(part, f) & fine) for f in {key[1] for key in near if key[0] == c} | {f.kept for f in fused}}
    lists = [(near[key], key, kept[key[1]][_first(v[kept[key[1]]], ids[kept[key[1]]], near[key].k)]) for key in near if key[0] == c]
    mixed = []
    for f in fused:
        own, b = kept[f.kept], said[_measure(f)]
        own = own[_first(np.concatenate([v[own], b[own]], axis=1), ids[own], both[f.name].k)]
        _, vs, _, ts = asked.weights[f.name]
        flat, plain = vs < 1e-8, ts < 1e-8
        alpha, beta = np.where(flat, 0, 1 / np.where(flat, 1, vs)), np.where(plain, 0, f.weight / np.where(plain, 1, ts))
        text = np.ascontiguousarray(b[own].T.astype(np.float32))
        mixed.append((f, both[f.name], own, alpha, beta, text, np.abs(text).max(axis=1, initial=0).astype(np.float64)))
        rows = np.flatnonzero(flat)  # there the text alone decides, or nothing
        for at in range(0, len(rows), PIECE):
            few = rows[at : at + PIECE]
            both[f.name].add(ids[own], asked.fuse(f, few[None], 0.0, b[own][:, asked.question[few]]), few)
    for e in np.flatnonzero(~fine):
        for top, key, _ in lists:
            if _kept(part, key[1])[e]:
                texts = [said[m][e, asked.question] for m in asked.lists[key][1]]
                top.add(ids[[e]], _dots(q, v[[e]])[None], None, np.stack(texts, axis=1)[None] if texts else None)
    for at in range(0, len(q), PIECE):
        piece = slice(at, at + PIECE)
        s = single[piece] @ small.T
        for top, key, own in lists:
            x = s if len(own) == s.shape[1] else s[:, own]
            texts = asked.lists[key][1]
            least = top.score[piece, -1] / asked.scale[c][piece] / scale
            if len(own) >= 8 * top.k and not np.isfinite(least).all():
                # the k-th of the maxima of some groups is no better than the k-th of all
                width = len(own) // (4 * top.k)
                tops = x[:, : 4 * top.k * width].reshape(len(x), 4 * top.k, width).max(axis=2)
                least = np.maximum(least, -np.partition(-tops, top.k - 1, axis=1)[:, top.k - 1] - slack[piece])
            least = least - slack[piece] - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))
            _again(top, x, least, at, own, ids, lambda row, col: _dots(q[row], v[col]), lambda row, col, texts=texts: np.stack([said[m][col, asked.question[row]] for m in texts], axis=1) if texts else None)
        for f, top, own, alpha, beta, text, most in mixed:
            x = s if len(own) == s.shape[1] else s[:, own]
            steep = alpha[piece] * asked.scale[c][piece] * scale
            question = asked.question[piece]
            x = x * steep.astype(np.float32)[:, None]
            x += text[question] * beta[piece].astype(np.float32)[:, None]
            vm, _, tm, _ = asked.weights[f.name]
            least = top.score[piece, -1] + alpha[piece] * vm[piece] + beta[piece] * tm[piece]
            off = steep * slack[piece] + 2.0**-21 * (steep * asked.norm[c][piece] * longest + beta[piece] * most[question] + np.abs(np.where(np.isfinite(least), least, 0)))
            off += 2.0**-45 * (np.abs(alpha[piece] * vm[piece]) + np.abs(beta[piece] * tm[piece]))
            if len(own) >= 8 * top.k and not np.isfinite(least).all():
                width = len(own) // (4 * top.k)
                tops = x[:, : 4 * top.k * width].reshape(len(x), 4 * top.k, width).max(axis=2)
                least = np.maximum(least, -np.partition(-tops, top.k - 1, axis=1)[:, top.k - 1] - off)
            least = np.where(alpha[piece] == 0, np.inf, least - off - 2.0**-21 * np.abs(np.where(np.isfinite(least), least, 0)))
            b = said[_measure(f)]
            _again(top, x, least, at, own, ids, lambda row, col, f=f, b=b: asked.fuse(f, row, _dots(q[row], v[col]), b[col, asked.question[row]]), None)


def _again(top: Top, x: np.ndarray, least: np.ndarray, at: int, own: np.ndarray, ids: np.ndarray, score, extra) -> None:
    """What reaches ``least`` in single precision, scored in double and merged."""
    with np.errstate(over="ignore"):
        # rounded down, so that the limit itself is not above what it stands for
        found = np.flatnonzero(x >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
    row, col = found // max(1, x.shape[1]) + at, own[found % max(1, x.shape[1])]
    for i in range(0, len(row), PAIRS):
        r, e = row[i : i + PAIRS], col[i : i + PAIRS]
        s = score(r, e)
        some = (s > top.score[r, -1]) | ((s == top.score[r, -1]) & (ids[e] < top.entry[r, -1]))
        r, e, s = r[some], e[some], s[some]
        top.merge(r, ids[e], s, extra(r, e) if extra else None)


_TOP = "variant string, probe_id bigint, entry_index bigint, score double, rank int"


def _rank(variants: tuple[Variant, ...], lists: list[tuple[tuple, int, list[Measure]]], k: int):
    """Rows of :func:`_search` sorted by probe, to the ranks of all variants with a vector."""

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for i, (key, long, texts) in enumerate(lists):
            own = rows.filter(pc.equal(rows.column("list"), i)).combine_chunks()
            if not own.num_rows:
                continue
            probe, at = np.unique(own.column("probe_id").to_numpy(), return_inverse=True)
            flat = lambda c, own=own: pc.list_flatten(own.column(c)).to_numpy()
            top = Top(long, len(probe), len(texts))
            at = np.repeat(at, pc.list_value_length(own.column("entry")).to_numpy())
            top.merge(at, flat("entry"), flat("score"), flat("extra").reshape(len(at), -1) if texts else None)
            for v in variants:
                if v.visual and (key == (v.name,) if v.fused else key == (v.visual, v.kept)):
                    entry, score = top.entry, top.score
                    if v.pool:
                        # the pool is ordered again by its text, then its vectors
                        text = np.where(top.score > -np.inf, top.extra[:, :, texts.index(_measure(v))], -np.inf)[:, : v.pool]
                        order = np.argsort(-text, axis=1, kind="stable")
                        entry, score = np.take_along_axis(entry[:, : v.pool], order, 1), np.take_along_axis(text, order, 1)
                    entry, score = entry[:, :k], score[:, :k]
                    held = score > -np.inf
                    row, place = np.nonzero(held)
                    yield pa.RecordBatch.from_arrays([pa.array([v.name] * len(row), pa.string()), pa.array(probe[row]), pa.array(entry[held]), pa.array(score[held]), pa.array((place + 1).astype(np.int32))], [c.split()[0] for c in _TOP.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, MERGED):
                waiting.append(batch.slice(start, MERGED))
                n += waiting[-1].num_rows
                if n < MERGED:
                    continue
                rows = pa.Table.from_batches(waiting)
                probe = rows.column("probe_id").to_numpy()
                whole = int(np.searchsorted(probe, probe[-1]))  # the last probe may go on
                if whole:
                    yield from done(rows.slice(0, whole))
                waiting = rows.slice(whole).to_batches()
                n = 0  # of those that came since
        if waiting:
            yield from done(pa.Table.from_batches(waiting))

    return run


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of one tile's rows, as long texts make large buffers on both sides of a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= TILE:
        spark.conf.set(name, str(TILE))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Evaluation:
    """``top(variant, probe_id, entry_index, score, rank)``, ``ranks(variant, probe_id, target_index, record, target_rank, retained)`` and ``sizes(variant, index_size)``."""

    def __init__(self, top: DataFrame, ranks: DataFrame, sizes: DataFrame, k: int):
        self.top, self.ranks, self.sizes, self.k = top, ranks, sizes, k

    def summary(self, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
        """One row a variant: records, probes, index size, retained targets, capped ranks, reciprocal ranks and recalls."""
        rank, capped = F.col("target_rank"), F.coalesce("target_rank", F.lit(self.k + 1)).cast("double")
        each = self.ranks.groupBy("variant").agg(
            F.count_distinct("target_index").alias("num_records"), F.count("*").alias("num_queries"), F.avg(capped).alias("mean_rank"), F.percentile(capped, F.lit(0.5)).alias("median_rank"),
            F.avg(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr"), *(F.avg(F.coalesce((rank <= n).cast("double"), F.lit(0.0))).alias(f"recall_at_{n}") for n in ks),
        )
        kept = self.ranks.select("variant", "target_index", "retained").distinct().groupBy("variant").agg(F.avg(F.col("retained").cast("double")).alias("target_retention"))
        return each.join(F.broadcast(kept), "variant").join(F.broadcast(self.sizes), "variant")

    def effective(self, direct: DataFrame, k: int = 3) -> DataFrame:
        """(variant, direct_rate, effective_rate): ``direct(target_index, direct_hit)`` alone, and for probes whose target is among the first ``k``."""
        hit = F.coalesce("direct_hit", F.lit(False))
        met = self.ranks.join(direct.select("target_index", "direct_hit"), "target_index", "left")
        one = met.groupBy("variant", "target_index").agg(F.max(hit).alias("hit"), F.sum((hit & F.coalesce(F.col("target_rank") <= k, F.lit(False))).cast("double")).alias("hits"), F.count("*").alias("n"))
        return one.groupBy("variant").agg(F.avg(F.col("hit").cast("double")).alias("direct_rate"), (F.sum("hits") / F.sum("n")).alias("effective_rate"))


def evaluate(entries: DataFrame, probes: DataFrame, variants: list[Variant], k: int = 10) -> Evaluation:
    """Every variant's top ``k`` for every probe, from two scans of ``entries`` as they are once made.

    ``entries(entry_index, ...)`` with the variants' columns: vectors, token
    arrays, booleans. ``probes(probe_id, target_index, query_tokens, mark, ...)``
    with a vector for each vector column of the same name; ``mark`` is null where
    a probe's query does not hold it.
    """
    spark = entries.sparkSession
    if len({v.name for v in variants}) != len(variants):
        raise ValueError("variants need names of their own")
    variants = tuple(variants)
    vectors, texts = (sorted({getattr(v, c) for v in variants} - {None}) for c in ("visual", "text"))
    flags = sorted({v.kept for v in variants} - {None})
    tasks = max(8, spark.sparkContext.defaultParallelism)
    asked = probes.select(F.col("probe_id").cast("bigint").alias("probe_id"), F.col("target_index").cast("bigint").alias("target_index"), "query_tokens", "mark", *(F.col(c).cast("array<double>").alias(c) for c in vectors))
    asked = scratch(asked)
    # what makes the entries runs once, not once a block, and all tasks share every pass
    read = entries.select(F.col("entry_index").cast("bigint").alias("entry_index"), *(F.col(c).cast("array<double>").alias(c) for c in vectors), *texts, *flags)
    read = scratch(read.repartition(tasks))
    # a task's rows are a few for every probe, so there are no more tasks than run at a time
    needed = lambda own: read.select("entry_index", *sorted({c for v in own for c in (v.visual, v.text, v.kept)} - {None})).coalesce(tasks)
    first, second = needed(v for v in variants if v.fused or not v.visual), needed(v for v in variants if v.visual)
    questions = scratch(renumbered(asked.select("query_tokens", "mark").distinct(), "query_tokens", "mark", name="question", start=0))
    asked = scratch(asked.join(questions, asked.query_tokens.eqNullSafe(questions.query_tokens) & asked.mark.eqNullSafe(questions.mark)).select("probe_id", "target_index", "question", *vectors))
    n, kinds = asked.count(), questions.count()
    lengths = asked.agg(*(F.max(F.size(c)).alias(c) for c in vectors), F.lit(0).alias("none")).first()
    widths = {c: max(1, lengths[c] or 1) for c in vectors}
    blocks = max(1, -(-kinds // QUESTIONS))
    slices = max(1, -(-n * 8 * sum(widths.values()) // (PROBE_BYTES * blocks)))
    said, seen, counted, shared = {}, {}, [], []
    for b in range(blocks):
        block = Questions(questions.where((F.col("question") >= b * QUESTIONS) & (F.col("question") < (b + 1) * QUESTIONS)).orderBy("question").toArrow())  # at most QUESTIONS rows
        shared.append(block)
        with _small_batches(spark):
            got = scratch(first.mapInArrow(_count(spark.sparkContext.broadcast(block), variants, k, {} if b else widths), _COUNTED))
        counted.append(got.where("kind = 'top'"))
        # one row a task and measure
        for r in got.where("kind <> 'top'").toArrow().to_pylist():
            mean, other = np.array(r["a"]), np.array(r["b"])
            if r["kind"] == "vector":
                key = r["name"], r["kept"]
                _factored(seen.setdefault(key, [0, np.zeros(len(mean)), np.zeros((0, len(mean)))]), r["n"], mean, other.reshape(-1, len(mean)))
            else:
                key = b, r["name"], r["boost"], r["kept"]
                said[key] = _joined(said.get(key, [0, np.zeros(len(mean)), np.zeros(len(mean))]), [r["n"], mean, other])
    found, lists = [], []
    for b in range(blocks if vectors else 0):
        for i in range(slices):
            own = asked.where((F.col("question") >= b * QUESTIONS) & (F.col("question") < (b + 1) * QUESTIONS) & (F.pmod(F.xxhash64("probe_id"), F.lit(slices)) == i))
            rows = own.orderBy("question", "probe_id").toArrow()  # a block of about PROBE_BYTES
            block = Asked(rows, shared[b], widths, variants, k, {key[1:]: x for key, x in said.items() if key[0] == b}, seen)
            lists = [(key, *x) for key, x in block.lists.items()] + [((v.name,), k, []) for v in variants if v.fused]
            found.append(second.mapInArrow(_search(spark.sparkContext.broadcast(block), variants, k), _FOUND))
    place = Window.partitionBy("variant", "question").orderBy(F.desc("score"), "entry_index")
    words = reduce(DataFrame.unionAll, counted).select(F.col("name").alias("variant"), "question", F.explode(F.arrays_zip("entry", "a")).alias("x"))
    words = words.select("variant", "question", F.col("x.entry").alias("entry_index"), F.col("x.a").alias("score")).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    top = [asked.select("probe_id", "question").join(words, "question").select("variant", "probe_id", "entry_index", "score", "rank")]
    if found:
        met = reduce(DataFrame.unionAll, found).repartition("probe_id").sortWithinPartitions("probe_id")
        top.append(met.mapInArrow(_rank(variants, lists, k), _TOP))
    with _small_batches(spark):
        top = scratch(reduce(DataFrame.unionAll, top))
    names = spark.createDataFrame([(v.name, v.kept) for v in variants], "variant string, kept string")
    count = read.agg(F.count("*").alias("all"), *(F.count_if(F.col(f)).alias(f"n_{f}") for f in flags)).first()
    sizes = spark.createDataFrame([(v.name, count[f"n_{v.kept}"] if v.kept else count["all"]) for v in variants], "variant string, index_size bigint")
    targets = read.select(F.col("entry_index").alias("target_index"), *flags).join(asked.select("target_index").distinct(), "target_index", "left_semi")
    kept = targets.select("target_index", F.explode(F.array(*(F.struct(F.lit(v.name).alias("variant"), (F.col(v.kept) if v.kept else F.lit(True)).alias("retained")) for v in variants))).alias("x"))
    kept = kept.select("target_index", "x.*").where("retained").distinct()
    every = asked.select("probe_id", "target_index").crossJoin(F.broadcast(names.select("variant")))  # as many rows as probes and variants
    hits = top.select("variant", "probe_id", F.col("entry_index").alias("target_index"), F.col("rank").alias("target_rank"))
    ranks = every.join(hits, ["variant", "probe_id", "target_index"], "left").join(kept, ["variant", "target_index"], "left").withColumn("retained", F.coalesce("retained", F.lit(False)))
    return Evaluation(top, ranks.select("variant", "probe_id", "target_index", "target_rank", "retained"), sizes, k)
