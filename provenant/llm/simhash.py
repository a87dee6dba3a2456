"""SimHash near-duplicates by a binary trie self-join.

Equal fingerprints collapse to one class first, so copies never meet as pairs.
The classes then enter several tables. A table puts a front of a few bits
first: classes that agree on it share a cell, and the trie of each cell is
joined with itself: pairs of nodes are traversed together, differing bits add
up, and a pair of nodes is dropped as soon as they exceed the budget. Nodes of
few leaves are compared as blocks, leaf by leaf. A pair is settled early when
its leaves are linked already, so a dense ball of near copies gives a star of
links and not all its pairs; links between different components are never lost.

Fronts are short, so that a cell holds thousands of classes and the trie does
the pruning. With ``budget`` differing bits, any ``budget + extra`` blocks hold
``extra`` that agree (pigeonhole), and each choice of that many is a table: 5
tables for a budget of 4 up to some 30 million classes, 15 up to 8 billion. A
cell of more than ``cell`` classes is cut into chunks, and each pair of chunks is
a work unit of its own, so a task meets at most ``2 * cell`` classes at a time.

``wide_links`` does the same for fingerprints of several words, for which the
fronts are chosen by recall (see ``Fronts``).

Defined results: null and empty texts have fingerprint zero and are linked like
any other; repeated rows come out as often as they came in; a null ``doc_id``
keeps its row and takes the component of its class, whose id is the least
non-null ``doc_id`` (null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import documents, free_name, materialise
from provenant.llm.components import connected_components

BITS = 64
CELL = 8192  # classes of a cell that meet in one unit
HELD = 4  # words of a wide fingerprint that a table compares
_MIX = np.random.default_rng(42).integers(1 << 62, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    body = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(body, seed)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-1].tolist()]
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(body[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=False)], np.uint64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, words: int = 4, seed: int = 42) -> Column:
    """The fingerprint as a signed bigint column."""

    @F.arrow_udf("bigint")
    def of(part: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words, seed) for t in part.to_pylist()], np.uint64).view(np.int64))

    return of(text)


# --- the trie self-join ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    """Runs of bits (word, lowest bit, width) that make up the front; its first run's word is the trie's."""

    front: tuple[tuple[int, int, int], ...]


def fronts(classes: int, budget: int, cell: int = CELL) -> list[Table]:
    """Tables for 64-bit fingerprints: all choices of ``extra`` out of ``budget + extra`` blocks.

    ``extra`` is 1 as long as a cell then holds about ``cell`` classes at most.
    """
    extra = 1
    while extra < 6 and (cell << (extra * BITS // (budget + extra))) < classes:
        extra += 1
    edges = np.linspace(0, BITS, budget + extra + 1).astype(int).tolist()
    blocks = [(0, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [Table(front) for front in combinations(blocks, extra)]


class _Sets:
    """Union-find over array positions, flattened after each round."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def trie_self_join(values: np.ndarray, group: np.ndarray, budget: int, word_budget: int | None = None, skip: int = 0, leaves: int = 256, most: int = 1 << 18) -> np.ndarray:
    """For each position the first position it is linked with, within its group.

    ``values`` has one row a word and a column a class, sorted by the first word
    inside each group and distinct there; two classes are linked if they differ
    in at most ``budget`` bits, and in ``word_budget`` of the first word. The trie
    is that of the first word from bit ``skip`` on, the bits before are known to
    be the group's. ``most`` bounds the node pairs held at once: beyond it the
    traversal goes on with one part after another.
    """
    n, key = values.shape[1], values[0]
    limit = budget if word_budget is None else word_budget
    sets = _Sets(n)

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(v[a] ^ v[b]).astype(np.int16) for v in values) <= budget

    near = np.flatnonzero(group[1:] == group[:-1])
    near = near[(np.bitwise_count(key[near] ^ key[near + 1]) <= limit) & alike(near, near + 1)]
    sets.link(near, near + 1)
    below: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the one-branch of each node begins."""
        if depth not in below:
            below.clear()
            ones = (key >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            below[depth] = np.concatenate(([0], np.cumsum(ones.astype(np.int64))))
        c = below[depth]
        return hi - (c[hi] - c[lo])

    def compare(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> None:
        """Leaf by leaf: small nodes many at once, others one pair of nodes after another."""
        size = (ahi - alo) * (bhi - blo)
        order = np.argsort(size, kind="stable")
        small = order[size[order] <= 512]
        done = 0
        while done < len(small):
            ends = np.cumsum(size[small[done:]])
            some = small[done : done + max(1, int(np.searchsorted(ends, 1 << 20, "right")))]
            done += len(some)
            at = np.repeat(some, size[some])
            offset = np.arange(len(at)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            wide = (bhi - blo)[at]
            a, b = alo[at] + offset // wide, blo[at] + offset % wide
            hit = (a < b) & (np.bitwise_count(key[a] ^ key[b]) <= limit)
            a, b = a[hit], b[hit]
            hit = alike(a, b)
            sets.link(a[hit], b[hit])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        tile = 2 * leaves
        tiles = (
            (a, min(a + tile, ahi[i]), b, min(b + tile, bhi[i]), alo[i] == blo[i])
            for i in order[size[order] > 512].tolist() for a in range(alo[i], ahi[i], tile) for b in range(blo[i], bhi[i], tile)
        )
        for a0, a1, b0, b1, same in tiles:
            first = sets.root[a0]
            if (same and b1 <= a0) or ((sets.root[a0:a1] == first).all() and (sets.root[b0:b1] == first).all()):
                continue
            a, b = np.nonzero(np.bitwise_count(key[a0:a1, None] ^ key[None, b0:b1]) <= limit)
            a, b = a + a0, b + b0
            if same:
                a, b = a[a < b], b[a < b]
            if len(values) > 1:
                hit = alike(a, b)
                a, b = a[hit], b[hit]
            found.append((a, b))
            held += len(a)
            if held > 1 << 14:
                sets.link(*map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
        if found:
            sets.link(*map(np.concatenate, zip(*found, strict=True)))

    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if n else np.zeros(1, np.int64)
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    work = [(skip, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while work:
        depth, alo, ahi, blo, bhi, diff = work.pop()
        if not len(alo):
            continue
        # what is linked already needs no further look
        change = np.concatenate(([0], np.cumsum(sets.root[1:] != sets.root[:-1])))
        open_ = ~((change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (sets.root[alo] == sets.root[blo]))
        leaf = open_ & ((np.maximum(ahi - alo, bhi - blo) <= leaves) | (depth == BITS))
        compare(alo[leaf], ahi[leaf], blo[leaf], bhi[leaf])
        go = open_ & ~leaf
        alo, ahi, blo, bhi, diff = alo[go], ahi[go], blo[go], bhi[go], diff[go]
        if not len(alo):
            continue
        if len(alo) > most:
            half = len(alo) // 2
            work += [(depth, *(x[half:] for x in (alo, ahi, blo, bhi, diff))), (depth, *(x[:half] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        amid, bmid, same = split(alo, ahi, depth), split(blo, bhi, depth), (alo == blo) & (ahi == bhi)
        pairs = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1), (amid[~same], ahi[~same], blo[~same], bmid[~same], diff[~same] + 1)]
        cols = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        ok = (cols[1] > cols[0]) & (cols[3] > cols[2]) & (cols[4] <= limit)
        work.append((depth + 1, *(x[ok] for x in cols)))
    return sets.root


def turned(word: np.ndarray, run: tuple[int, int, int]) -> np.ndarray:
    """The words turned so that the run's highest bit is the highest."""
    up = (BITS - run[1] - run[2]) % BITS
    return word if not up else (word << np.uint64(up)) | (word >> np.uint64(BITS - up))


def _join_cells(budget: int, word_budget: int | None, tables: list[Table], rows: int = 1 << 17):
    """mapInArrow over (part, unit, id, words...) sorted by part and unit: links of each cell as stars."""

    def flush(part: np.ndarray, unit: np.ndarray, ids: np.ndarray, *words: np.ndarray) -> Iterator[pa.RecordBatch]:
        for table in np.unique(part):
            at = part == table
            run = tables[table].front[0]
            values = np.stack([turned(words[0][at].view(np.uint64), run), *(w[at].view(np.uint64) for w in words[1:])])
            cell = np.cumsum(np.concatenate(([0], unit[at][1:] != unit[at][:-1])))
            order = np.lexsort((values[0], cell))
            own = ids[at][order]
            root = trie_self_join(values[:, order], cell[order], budget, word_budget, run[2])
            # the centre of each star is its least id, which other tables mostly agree on
            least = own.copy()
            np.minimum.at(least, root, own)
            centre = least[root]
            moved = np.flatnonzero(centre != own)
            yield pa.RecordBatch.from_arrays([pa.array(centre[moved]), pa.array(own[moved])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += batch.num_rows
            if size < rows:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            part, unit = columns[:2]
            # the last unit may go on
            change = np.flatnonzero((part[1:] != part[:-1]) | (unit[1:] != unit[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from flush(*(x[:cut] for x in columns))
            held, size = [tuple(x[cut:] for x in columns)], len(part) - cut
        if size:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def join_tables(classes: DataFrame, node: str, words: list[str], tables: list[Table], held: int, budget: int, word_budget: int | None, cell: int) -> DataFrame:
    """Links (a, b) of the distinct ``node`` of a stored table that meet in some cell and are within the budget.

    An entry of a table carries ``held`` words, that of its front first.
    """

    def key_of(table: Table) -> Column:
        out = F.lit(0).cast("bigint")
        for word, low, width in table.front:
            run = F.shiftrightunsigned(words[word], low).bitwiseAND(F.lit((1 << width) - 1))
            out = F.shiftleft(out, width).bitwiseOR(run)
        return out

    def entry(i: int, table: Table) -> Column:
        first = table.front[0][0]
        return F.struct(F.lit(i).alias("part"), key_of(table).alias("key"), *(F.col(words[(first + j) % len(words)]).alias(f"w{j}") for j in range(held)))

    carried = [f"w{j}" for j in range(held)]
    entries = classes.select(F.col(node).alias("id"), F.inline(F.array(*(entry(i, t) for i, t in enumerate(tables)))))
    # as many cells as the fronts have values, thousands of classes in each: the sums meet on the map side
    crowds = materialise(entries.groupBy("part", "key").count().where(F.col("count") > cell), "simhash-crowds")
    if crowds.isEmpty():
        units = entries.withColumn("unit", F.col("key"))
    else:
        # chunks of a crowd meet pairwise: row and column of the pair replace the plain key
        chunks = crowds.withColumn("chunks", F.ceil(F.col("count") / cell).cast("int")).drop("count")
        dealt = entries.join(chunks, ["part", "key"], "left")
        own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
        pairs = F.when(F.col("chunks").isNull(), F.array(F.col("key"))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
        )
        units = dealt.select("id", *carried, "part", F.explode(pairs).alias("unit"))
    rows = units.select("part", "unit", "id", *carried).repartition("part", "unit").sortWithinPartitions("part", "unit")
    return rows.mapInArrow(_join_cells(budget, word_budget, tables), "a bigint, b bigint")


def near_links(classes: DataFrame, budget: int = 4, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect any two of the distinct fingerprints ``classes(fp)`` within ``budget`` bits.

    ``classes`` should be a stored table: it is read more than once.
    """
    return join_tables(classes, "fp", ["fp"], fronts(classes.count(), budget, cell), 1, budget, None, cell)


# --- wide fingerprints ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fronts:
    """Tables for fingerprints of several words, by the recall they give.

    Two sets of Jaccard similarity J differ in each bit with a chance of
    ``arccos(2J / (1 + J)) / pi`` at most. A front of b bits finds them with a
    chance of (1 - that) ** b, so as many fronts are taken, each of bits of its
    own, as leave a chance of ``1 - recall`` to be missed by all. Fronts are
    ``bits`` long, more only where a cell would hold too many classes.
    """

    classes: int
    share: float = 0.8
    recall: float = 0.999
    cell: int = CELL

    @property
    def bits(self) -> int:
        return max(9, int(np.ceil(np.log2(max(1, self.classes) / (2 * self.cell)))))

    @property
    def differ(self) -> float:
        return float(np.arccos(2 * self.share / (1 + self.share)) / np.pi)

    @property
    def words(self) -> int:
        needed = np.log(1 - self.recall) / np.log1p(-((1 - self.differ) ** self.bits))
        return max(HELD, int(np.ceil(needed / (BITS // self.bits))))

    def tables(self) -> list[Table]:
        return [Table(((w, low, self.bits),)) for w in range(self.words) for low in range(0, BITS - self.bits + 1, self.bits)]

    def budget(self, bits: int) -> int:
        """Differing bits out of so many that 1 pair in 10,000 exceeds."""
        return int(np.ceil(bits * self.differ + 3.7 * np.sqrt(bits * self.differ * (1 - self.differ))))


def wide_fingerprint(hashes: np.ndarray, words: int = HELD) -> np.ndarray:
    """A SimHash of ``words`` 64-bit words, each from a hash of its own, of a set of 64-bit hashes."""
    ones = np.zeros((words, BITS), np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a text of any length in bounded memory
        part = hashes[i : i + (1 << 16)]
        for w in range(words):
            h = (part ^ (part >> np.uint64(33))) * _MIX[w % len(_MIX)] + np.uint64(w)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            by_byte = (h ^ (h >> np.uint64(32))).view(np.uint8).reshape(-1, 8)
            ones[w] += np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def wide_links(classes: DataFrame, node: str, words: list[str], plan: Fronts) -> DataFrame:
    """Links (a, b) between classes whose fingerprints differ by no more than those of similar sets do.

    ``classes`` should be a stored table: it is read more than once.
    """
    return join_tables(classes, node, words, plan.tables(), HELD, plan.budget(HELD * BITS), plan.budget(BITS - plan.bits), plan.cell)


# --- the query and the stage ----------------------------------------------------------------------------------------


def link_classes(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of a stored table ``prints(doc_id, fp)``."""
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    # a class lies in a star for each table at most: its least centre stands for the others, which are linked to it
    stars = near_links(classes.select("fp"), budget).groupBy("b").agg(F.collect_set("a").alias("centres"))
    links = stars.select(F.array_min("centres").alias("a"), F.explode(F.concat("centres", F.array("b"))).alias("b"))
    roots = connected_components(links, "simhash")
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return materialise(with_least(linked).select("fp", "component_id"), "simhash-linked")


def with_least(linked: DataFrame, many: int = 1 << 14) -> DataFrame:
    """``linked(fp, first, root)`` with component_id, the least ``first`` of its root.

    Roots of more than ``many`` rows are no key of the join: there are at most
    one for so many rows, and they go out by broadcast.
    """
    linked = materialise(linked, "simhash-roots")
    least = materialise(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "simhash-least")
    crowded = F.broadcast(least.where(F.col("n") > many).drop("n"))
    rest = linked.join(crowded.select("root"), "root", "left_anti").join(least.drop("n"), "root")
    return linked.join(crowded, "root").select("fp", "component_id").unionByName(rest.select("fp", "component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", budget: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words, seed).alias("fp")), "simhash-prints")
    return prints.join(link_classes(prints, budget), "fp")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near-duplicates the row of smallest id stays, null ids last.

    Texts are linked here whose five-word shingles have a Jaccard similarity of
    0.8 or more, as counted. The trie self-join of wide fingerprints gives
    clusters of candidates (recall 0.999 at 0.8 by ``Fronts``), and within them
    ``neardup`` counts similarities exactly.

    Every row is decided by id and text, so exactly one row of each component
    stays, be ids repeated, null or shared by different texts.
    """
    from provenant.llm import neardup

    of_text, = free_name(docs, "of_text")
    keyed = docs.withColumn(of_text, F.xxhash64("text"))
    kept = neardup.kept_rows(docs).select(F.col("doc_id").alias("__id"), F.col("of_text").alias("__of"), "n")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(of_text) == F.col("__of"))
    # by sort and merge at every size: the kept ids grow with the documents
    out = keyed.join(kept.where("n = 1").hint("merge"), same, "left_semi").select(docs.columns)
    several = kept.where("n > 1")
    if several.isEmpty():
        return out
    more = keyed.join(several, same, "left_semi").dropDuplicates(["doc_id", of_text])
    return out.unionByName(more.select(docs.columns))
