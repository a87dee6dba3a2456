"""Sources and sinks round trips, and the streaming forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.sources import readers as S
from provenant.sources import sinks as K
from provenant.streaming import incremental as I


def test_json_lines(spark, tmp_path):
    path = f"{tmp_path}/a.jsonl"
    assert S.jsonl(spark, path, "a int").count() == 0
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in S.jsonl(spark, f"{tmp_path}/b.jsonl", "a int").where("a IS NOT NULL").collect()) == [1, 2]
    K.write_jsonl(spark.range(3), path)
    K.write_jsonl(spark.range(3, 5), path, append=True)
    assert S.jsonl(spark, path, "id bigint").count() == 5
    (tmp_path / "done.jsonl").write_text('{"image_id": "a", "ok": true}\n{"image_id": "b", "ok": false}\n{"image_id": "a", "ok": true}\n')
    assert [r.image_id for r in S.done_ids(spark, f"{tmp_path}/done.jsonl").collect()] == ["a"]


def test_records_and_paths(spark, tmp_path):
    rows = [{"id": "ModeA-1", "watermarked_image_path": "x.png"}, {"id": "m2", "parasitism_mode": "Non-text", "watermarked_image_path": "gone.png"}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    files = spark.createDataFrame([("/b/x.png",)], "path string")
    got = S.records(spark, f"{tmp_path}/r.json", ["/a", "/b"], files).collect()
    assert [(r.id, r.record_mode, r.resolved_path) for r in got] == [("ModeA-1", "mode_a", "/b/x.png")]
    assert S.records(spark, f"{tmp_path}/r.json").count() == 2
    assert S.resolve("p", ["/a", "/b"], lambda p: p == "/b/p") == "/b/p" and S.resolve("p", ["/a", "/b"], lambda p: False) == "/a/p"


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"data": [{"path": "d/one.png", "k": "v"}, {"id": "two", "path": "two.png", "k": "w"}]}))
    (tmp_path / "m.csv").write_text("file_name,id\na/b.jpg,\nc.jpg,see\n")
    assert sorted((r.image_id, r.image_path) for r in S.manifest(spark, f"{tmp_path}/m.json").collect()) == [("one", "d/one.png"), ("two", "two.png")]
    assert sorted(r.image_id for r in S.corpus(spark, manifest_path=f"{tmp_path}/m.csv").collect()) == ["b", "see"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.png").write_bytes(b"1")
    (tmp_path / "img" / "y.txt").write_bytes(b"1")
    assert [r.image_id for r in S.corpus(spark, f"{tmp_path}/img").collect()] == ["x"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        S.corpus(spark, f"{tmp_path}/none")


def test_downloads(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ImageID,Thumbnail300KURL,OriginalURL\na,,u1\nb,t2,u2\nc,,\n")
    rows = S.download_candidates(spark, f"{tmp_path}/c.csv", 10)
    assert {(r.image_id, r.url) for r in rows.collect()} == {("a", "u1"), ("b", "t2")}

    def get(url):
        if url == "u1":
            raise OSError("gone")
        return url.encode()

    assert {(r.image_id, r.error) for r in S.fetched(rows, get).collect()} == {("a", "gone"), ("b", None)}


def test_matrix_and_shards(spark, tmp_path):
    x = np.arange(20, dtype=np.float32).reshape(10, 2)
    np.save(tmp_path / "x.npy", x)
    rows = S.matrix(spark, f"{tmp_path}/x.npy", 4).orderBy("row").collect()
    assert [r.v for r in rows] == x.tolist()
    for i in range(2):
        (tmp_path / f"shard_{i}.json").write_text(json.dumps({"a": i}))
    assert sorted((r.a, r.shard) for r in S.shards(spark, str(tmp_path), "a int").collect()) == [(0, 0), (1, 1)]
    assert S.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, [1, 2])], "k int, w array<int>")
    K.write_csv(f"{tmp_path}/u.csv", a, b, one_file=True)
    back = spark.read.option("header", True).csv(f"{tmp_path}/u.csv")
    assert back.columns == ["k", "v", "w"] and {(r.k, r.w) for r in back.collect()} == {("1", None), ("2", "[1,2]")}
    K.write_tables({"a": a, "none": a.limit(0)}, str(tmp_path / "t"))
    assert K.upserted(a, spark.createDataFrame([(1, "y")], "k int, v string"), "k").first().v == "y"
    assert K.sealed(a, "v", "k").first().config_hash == K.stable_hash({"k": 1, "v": "x"})
    assert spark.range(1).select(K.remapped(F.lit("/old/hit_images/a.png"), "hit_images/", "/new")).first()[0] == "/new/hit_images/a.png"


def test_streams(spark, tmp_path):
    source, schema = tmp_path / "in", "probe_id bigint, entry_index bigint, score double, record_index int, hit boolean"
    source.mkdir()
    for i in range(2):
        rows = [{"probe_id": 1, "entry_index": 10 * i + j, "score": (10 * i + j) % 7 / 7, "record_index": j % 2, "hit": j == 1} for j in range(6)]
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    rates = run(I.running_rates(stream(), F.col("hit")), "rates", "complete")
    assert {(r.record_index, r.n) for r in rates.collect()} == {(0, 6), (1, 6)}
    top = run(I.running_topk(stream(), 3), "top", "update").collect()
    last = {(r.entry_index, r["rank"]) for r in top[-3:]}
    every = sorted(((10 * i + j) % 7 / 7, -(10 * i + j)) for i in range(2) for j in range(6))[::-1][:3]
    assert last == {(-e, i + 1) for i, (_, e) in enumerate(every)}
