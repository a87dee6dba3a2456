"""Nearest neighbours, chat formatting, and the pipeline as a whole."""

from hashlib import md5

import numpy as np
import pytest
from oracle import connection, differences
from pyspark.sql import functions as F

from provenant.llm import ann, chat, registry

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, view string, size int"


def nearest(ids, v, q, k):
    """Exact neighbours of row q."""
    s = np.array([float((v[q] * x).sum() / np.sqrt((v[q] * v[q]).sum() * (x * x).sum())) for x in v])
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))
    return [(ids[i], s[i]) for i in order[:k]]


@pytest.mark.parametrize("n", [3, 400])
def test_neighbours(spark, n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 24))
    v[2] = v[1]
    if n > 3:
        v[50:90] = v[49]
    rows = [(i, v[i].tolist(), 0) for i in range(n)]
    bad = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] + [1.0] * 23, 0), (904, [1.0], 0), (905, [float("inf")] * 24, 0)]
    table = spark.createDataFrame([*rows, *bad, rows[0]], "vec_id bigint, embedding array<double>, ref int")
    asked = table.where("vec_id % 50 = 0 OR vec_id > 899")
    got = {}
    for r in ann.search(table, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    found = wanted = 0
    for q in [i for i in range(n) if i % 50 == 0]:
        exact = nearest(list(range(n)), v, q, 5)
        assert len(got[q]) == len(exact)
        found, wanted = found + len({i for i, _ in exact} & {i for i, _ in got[q]}), wanted + len(exact)
        assert all(abs(s - dict(nearest(list(range(n)), v, q, n))[i]) < 1e-12 for i, s in got[q])
    assert found >= 0.9 * wanted and set(got) == {i for i in range(n) if i % 50 == 0}
    assert ann.search(table.limit(0), asked.limit(0), 5).count() == 0


def test_many_ties_go_to_the_smaller_ids(spark):
    """Eighty scaled copies of one vector tie; rounding may not lose the smallest ids."""
    rng = np.random.default_rng(8)
    base, other = rng.normal(size=16), rng.normal(size=(200, 16))
    rows = [(i, (base * 2.0 ** (i % 7)).tolist(), 0) for i in range(80)] + [(100 + i, x.tolist(), 0) for i, x in enumerate(other)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, ref int").repartition(4)
    got = ann.search(table, table.where("vec_id IN (0, 50)"), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in (1, 2, 3, 4, 5)] + [(50, i) for i in (0, 1, 2, 3, 4)]


def test_probes_are_the_best_pairs():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    space = ann.CrossPolytope(12)
    codes = space.buckets(v, 0, 40)
    for row, code in zip(v, codes):
        loss = []
        for part in range(2):
            x = space.rotated(row[None], 0, part)[0]
            both = np.concatenate((x, -x))
            loss.append((both.max() - both) ** 2)
        sums = (loss[0][:, None] + loss[1][None, :]).reshape(-1)
        assert np.allclose(np.sort(sums)[:40], sums[code])
    assert (space.buckets(v, 0)[:, 0] == codes[:, 0]).all()


def test_recall_of_the_query(spark, sf_dir):
    rows = ann.op6_ann(spark, sf_dir).collect()
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, v = e.vec_id.tolist(), np.stack(e.embedding).astype(float)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[i] & {x for x, _ in nearest(ids, v, ids.index(i), 5)}) for i in ids if i % 50 == 0]
    assert sum(hits) >= 0.9 * 5 * len(hits)


def test_hadamard_is_orthonormal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_chat_equals_sql(spark, sf_dir):
    assert differences(chat.op3_chat_format(spark, sf_dir), connection(sf_dir), chat.ORACLE) is None


def test_chat_edges(spark):
    rows = [(1, 0, "system", "be kind", "x", 1), (1, 1, "ann", "hi <|im_end|>", "x", 1), (1, 2, "bob", None, "x", 1), (1, 2, "bob", None, "x", 1), (1, None, None, "", "x", 1),
            (2, 0, "system", "alone", "x", 1), (None, 0, "a b", "y" * 100_000, "x", 1)]
    out = chat.rotate(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert {(r.conv_id, r.perspective) for r in out} == {(1, "ann"), (1, "bob"), (1, "unknown."), (None, f"a_b.{md5(b'a b').hexdigest()[:16]}")}
    for key in {(r.conv_id, r.perspective) for r in out}:
        view = sorted((r for r in out if (r.conv_id, r.perspective) == key), key=lambda r: r.seq)
        whole = "".join(r.segment for r in view)
        assert [r.seq for r in view] == list(range(len(view)))
        assert all(r.loss == (r.role == "assistant") for r in view)
        assert all(whole[r.content_end :].startswith("<|im_end|>\n") for r in view)
    bob = next(r for r in out if r.perspective == "bob" and r.name == "ann")
    assert "hi <| im_end|>" in bob.segment and not bob.loss
    assert chat.rotate(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_roles_that_differ_stay_apart(spark):
    roles = ["a b", "a_b", "a.b", "", None, "unknown", "unknown.", "user\n", "user", "System"]
    rows = [(1, i, role, f"m{i}", "x", 1) for i, role in enumerate(roles)]
    table = spark.createDataFrame(rows, CONVERSATIONS)
    out = chat.rotate(table).collect()
    assert len({r.perspective for r in out}) == len(roles) and len(out) == len(roles) ** 2
    for view in {r.perspective for r in out}:
        names = [r.name for r in out if r.perspective == view]
        assert names.count(None) == 1 and len(set(names)) == len(roles)


def test_a_long_conversation_spans_ranges(spark):
    rows = spark.range(3000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    out = chat.rotate(rows).where("perspective = 'user'").orderBy("seq").collect()
    at = 0
    for i, r in enumerate(out):
        assert (r.seq, r.turn) == (i, i) and r.content_end == at + len(r.segment) - len("<|im_end|>\n")
        at += len(r.segment)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from provenant.llm import bpe, decontaminate, langid, pii
    from provenant.llm.common import documents

    docs = documents(spark, sf_dir)
    rows = {r.doc_id: r.text for r in docs.collect()}
    pred = {r.doc_id: r for r in langid.op8_language_id(spark, sf_dir).collect()}
    left = {d: t for d, t in rows.items() if pred[d].lang_pred != "und" and pred[d].evidence > 0}
    from test_texts import kept_by_jaccard, naive_words

    ids = sorted(left)
    left = {ids[i]: left[ids[i]] for i in kept_by_jaccard([naive_words(left[d]) for d in ids])}
    dirty = {r.doc_id for r in decontaminate.op9_decontaminate(spark, sf_dir).collect()}
    left = {d: t for d, t in left.items() if d not in dirty}
    worker, codec = pii.Pseudonymiser(), bpe.Codec()
    expected = {d: len(codec.encode(worker.replace(t, worker.find(t)))) // 4 for d, t in left.items()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()} == expected
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir)
        assert frame.columns == docs.columns and [f.dataType for f in frame.schema] == [f.dataType for f in docs.schema]


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
