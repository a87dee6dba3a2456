"""Packing, hard negatives and clustering, against plain loops, the library, SQL and edge cases."""

import random
import zlib

import numpy as np
import pytest
from oracle import connection, differences
from tokenizers import Tokenizer

from provenant.llm import hardneg, integers, kdcluster, packing
from provenant.llm.common import documents

ODD = ["", " ", None, "a b c", "<|endoftext|>x", "\U0001f600é", "x" * 3000, "lorem ipsum dolor " * 9_000, "a b c", "two words"]
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, row int, v string, block int, cluster int, id string"


def library_ids(texts, end=1):
    t = Tokenizer.from_file(packing.VOCABULARY)
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(pieces, ids, capacity, padded=0):
    """Every id in exactly one piece, sequences gapless, checksums right, padding as stated."""
    for key, own in pieces.groupby("key"):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids[key]) and (own.doc_tokens == len(ids[key])).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[key][r.start : r.start + r.length], "<u4").tobytes())
    assert set(pieces.key) == set(ids)
    lost = 0
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and (own.length > 0).all()
        size = own.length.sum()
        assert size <= capacity
        lost += 0 if size & (size - 1) == 0 else capacity - size
    assert lost <= padded


def test_levels_make_the_sum_of_squares_least():
    rng, capacity = random.Random(3), 24
    levels, counts = packing.Levels(capacity), [0] * (capacity + 1)
    for i in range(3000):
        size = rng.choice([3, 5, 7, 8, 11, rng.randint(1, 23)])

        def squares(h):
            after = counts[:]
            after[h] -= h > 0
            after[h + size] += 1
            return sum(n * n for n in after[1:capacity])

        options = [h for h in range(capacity - size + 1) if h == 0 or counts[h]]
        best = min(options, key=lambda h: (squares(h), -h))
        assert levels.place(size, i)[1] == best
        counts[best] -= best > 0
        counts[best + size] += 1
    assert sorted(level for _, level in levels.rest()) == sorted(h for h in range(1, capacity) for _ in range(counts[h]))


@pytest.mark.parametrize("sizes", [[], [1], [63], [5, 60, 60, 60], [33] * 40, [1] * 200, list(range(1, 64))])
def test_moves_fill_every_gap(sizes):
    filled = {}
    found = list(packing.moves(list(enumerate(sizes)), 64, 1000))
    last = [(-1 - m[0], *m[1:]) if m[0] < 0 else m for m in found if m[0] < 0 or not any(n[0] == -1 - m[0] for n in found)]
    moved = {m[0] for m in last}
    for window, size in enumerate(sizes):
        runs = sorted(m[1:] for m in last if m[0] == window) if window in moved else [(0, size, window, 0)]
        assert [r[0] for r in runs] == list(np.cumsum([0, *(r[1] for r in runs)])[:-1]) and sum(r[1] for r in runs) == size
        for _, n, to, at in runs:
            filled.setdefault(to, []).append((at, n))
    for own in filled.values():
        own.sort()
        assert [a for a, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1])
        total = sum(n for _, n in own)
        assert total == 64 or total & (total - 1) == 0
    assert sum(n for own in filled.values() for _, n in own) == sum(sizes)


def test_packing_query_equals_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    got = packing.op11_packing(spark, sf_dir).toPandas()
    check_pieces(got.assign(key=got.doc_id), dict(zip(texts, library_ids(texts.values()))), 2048)


def test_packing_edges(spark):
    """Odd texts, repeated rows, null ids, clashing columns, several closing tasks, sequences put together again."""
    rows = [(None if i == 3 else i, t, "x", 1, 2, 3) for i, t in enumerate(ODD * 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n int, key int, offset int").repartition(3)
    ids = packing.encoded(docs, capacity=64)
    pieces = packing.pack(ids, capacity=64, closing=4)
    held = {r.key: np.frombuffer(r.ids, "<u2").tolist() for r in ids.collect()}
    assert sorted(held.values()) == sorted(library_ids(ODD * 12))
    got = pieces.toPandas()
    check_pieces(got, held, 64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(pieces, ids).collect()}
    for r in got.itertuples():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == held[r.key][r.start : r.start + r.length]
    assert got[got.doc_id.isna()].key.nunique() == 1
    assert packing.pack(packing.encoded(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        packing.pack(ids, capacity=100)


# --- hard negatives ---------------------------------------------------------------------------------------------------------


def test_mining_query_equals_sql(spark, sf_dir):
    assert differences(hardneg.op12_hard_negatives(spark, sf_dir), connection(sf_dir), hardneg.ORACLE) is None


def mined(rows, anchors, positives=5, negatives=10):
    """A plain pass over (id, label, integer vector)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i in anchors:
        pairs = [(dot(rows[i][2], r[2]), r[0], r[1]) for j, r in enumerate(rows) if j != i]
        for ps, pid, _ in sorted((p for p in pairs if p[2] == rows[i][1]), key=order)[:positives]:
            far = sorted((p for p in pairs if p[2] != rows[i][1] and 30 * ps <= 100 * p[0] <= 90 * ps), key=order)[:negatives]
            out += [(rows[i][0], pid, n + 1, f[1], ps, f[0]) for n, f in enumerate(far)]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_mining_equals_a_plain_pass(spark, monkeypatch, hot):
    """Small tiles, ragged vectors, nulls, ties, repeated rows, a hot label, clashing columns."""
    monkeypatch.setattr(hardneg, "ROWS", 16)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    rng = random.Random(5)
    rows = [(i % 70 if i != 9 else None, [rng.randint(-3, 9) / 4 for _ in range(rng.choice([70, 70, 70, 20]))], 1 if hot and i % 3 else rng.randint(0, 3)) for i in range(90)]
    bad = [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (203, [float("inf")], 1), (204, [1.0], None), (205, [], 2)]
    df = spark.createDataFrame([(i, v, g, 1, "x", 2, 3, "y") for i, v, g in rows + bad], EMBEDDINGS).repartition(3)
    got = hardneg.mine(df, (integers.F.col("id") % 5 == 0))
    kept = [(i, g, [int(np.floor(256 * x)) for x in v]) for i, v, g in [*rows, bad[-1]]]
    plain = mined(kept, [n for n, r in enumerate(kept) if r[0] is not None and r[0] % 5 == 0])
    assert sorted(map(tuple, got.collect()), key=str) == plain
    assert hardneg.mine(df.limit(0), integers.F.col("id") % 5 == 0).count() == 0


def test_large_components(spark):
    big = np.full((1, 4), 1 << 26)
    assert integers.products(big, big)[0, 0] == 1 << 54
    with pytest.raises(Exception, match="do not fit"):
        hardneg.mine(spark.createDataFrame([(0, [1e30], 1, 1, "x", 2, 3, "y")], EMBEDDINGS), integers.F.col("id") % 5 == 0).collect()


# --- clustering -------------------------------------------------------------------------------------------------------------


def test_clustering_query_equals_sql(spark, sf_dir):
    assert differences(kdcluster.op13_kd_clustering(spark, sf_dir), connection(sf_dir), kdcluster.ORACLE) is None


def lloyd(x, starts, rounds):
    c = np.array(starts)
    for i in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if i < rounds:
            for k in set(own.tolist()):
                c[k] = x[own == k].sum(axis=0) // (own == k).sum()
    return own, d[np.arange(len(x)), own], c


@pytest.mark.parametrize("spread", [0, 1, 30, 4000])
def test_trees_assign_as_a_plain_pass_and_prune(spread):
    """Many equal distances at small spreads; tight clusters are assigned by nodes."""
    rng = np.random.default_rng(spread)
    x = rng.integers(-1000, 1000, (12, 6))[rng.integers(0, 12, 3000)] + rng.integers(-spread, spread + 1, (3000, 6))
    order, lo, hi, sums = kdcluster.plant(x)
    assert sorted(order) == list(range(3000))
    x = x[order]
    edges = kdcluster.levels(len(x))
    c = x[rng.integers(0, 3000, 25)]
    owner, whole = kdcluster.assign(x, edges, lo, hi, c)
    looked = (owner >= 0).sum()
    for node, k in whole:
        start, stop = kdcluster._span(edges, node)
        assert (sums[node] == x[start:stop].sum(axis=0)).all() and (owner[start:stop] == -1).all()
        owner[start:stop] = k
    assert (owner == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert looked < 3000 if spread < 1000 else True


def test_clustering_edges(spark, monkeypatch):
    """Several trees a task, unusable and repeated rows, null ids, fewer vectors than clusters, clashing columns."""
    monkeypatch.setattr(kdcluster, "CHUNK", 50)
    rng = random.Random(8)
    rows = [(None if i == 7 else i % 90, [rng.choice([0.0, 0.5, rng.uniform(-1, 1)]) for _ in range(3)]) for i in range(240)]
    bad = [(500, None), (501, [1.0, 2.0]), (502, [1.0, None, 1.0]), (503, [1.0, float("nan"), 1.0]), (504, [float("-inf"), 1.0, 1.0]), (505, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3, 4, "y") for i, v in rows + bad], EMBEDDINGS).repartition(3)
    found, c = kdcluster.cluster(df, 12, 3, 3)
    from hashlib import sha256

    single = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    order = sorted(single, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    whole = lambda v: np.floor(256 * np.array(v)).astype(int)
    own, distance, centroids = lloyd(np.array([whole(v) for _, v in single]), [whole(v) for _, v in order[:12]], 3)
    plain = sorted(zip([i for i, _ in single], own.tolist(), distance.tolist()), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == plain and (c == centroids).all()
    few, c = kdcluster.cluster(df.where("vec_id = 3"), 12, 2, 3)
    assert few.count() == sum(i == 3 for i, _ in rows) and len(c) == few.count()
    assert kdcluster.cluster(df.where("vec_id > 499"), 12, 2, 3)[0].count() == 0
