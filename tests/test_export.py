"""Exports that stop and go on, and hit files copied once."""

import os

import pytest
from pyspark.sql import functions as F

from provenant.sources.hits import materialised_hits
from provenant.streaming import export as X


def source(spark, folder, files):
    """A stream of one file a batch, oldest first."""
    for n, rows in enumerate(files):
        path = folder / f"{n:03d}.json"
        if not path.exists():
            path.write_text("\n".join(rows))
            os.utime(path, (1_000_000 + n, 1_000_000 + n))
    return spark.readStream.schema("id string, source_index int, ocr array<string>").option("maxFilesPerTrigger", 1).json(str(folder))


FILES = [
    ['{"id": "a/1", "source_index": 0, "ocr": ["x"]}', '{"id": "b", "source_index": 1, "ocr": ["x"]}', '{"id": "a 1", "source_index": 2, "ocr": ["x"]}'],
    ['{"id": "b", "source_index": 3, "ocr": ["x"]}', '{"id": "c", "source_index": 4, "ocr": []}', '{"id": null, "source_index": 5, "ocr": ["x"]}', '{"id": "d", "source_index": 6, "ocr": ["x"]}'],
    ['{"id": "e", "source_index": 7, "ocr": ["x"]}', '{"id": "d", "source_index": 8, "ocr": ["x"]}', '{"id": "f", "source_index": 9, "ocr": ["x"]}'],
]
ALL = [("a_1", 0), ("b", 1), ("5", 5), ("d", 6), ("e", 7), ("f", 9)]


@pytest.mark.parametrize("limit, after", [(None, True), (None, False), (4, True)])
def test_export_killed_and_started_again(spark, tmp_path, monkeypatch, limit, after):
    """A run that dies before or after its second batch is written: no id twice, none lost."""
    (tmp_path / "in").mkdir()
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    whole, calls = X.write_batch, []

    def dies(rows, batch, *rest):
        calls.append(batch)
        if after or batch != 1:
            whole(rows, batch, *rest)
        if batch == 1:
            raise RuntimeError("the machine went away")

    monkeypatch.setattr(X, "write_batch", dies)
    with pytest.raises(Exception, match="went away"):
        X.export(source(spark, tmp_path / "in", FILES), target, checkpoint, limit=limit, required=["ocr"])
    monkeypatch.setattr(X, "write_batch", whole)
    X.export(source(spark, tmp_path / "in", FILES), target, checkpoint, limit=limit, required=["ocr"])
    got = sorted((r.id, r.source_index) for r in X.exported(spark, target).collect())
    assert got == sorted(ALL[:limit]) and calls == [0, 1]
    # nothing new: nothing happens; new files are taken up, and ids that are out stay out
    X.export(source(spark, tmp_path / "in", [*FILES, ['{"id": "g", "source_index": 10, "ocr": ["x"]}', '{"id": "b", "source_index": 11, "ocr": ["x"]}']]), target, checkpoint, limit=limit, required=["ocr"])
    got = sorted((r.id, r.source_index) for r in X.exported(spark, target).collect())
    assert got == sorted([*ALL, ("g", 10)][:limit])


def test_hits_are_copied_once(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for folder in "ab":
        (tmp_path / folder / "x y.jpg").write_bytes(folder.encode() * 5_000_000)
    paths = [f"file://{tmp_path}/{f}/x y.jpg" for f in "ab"]
    rows = [(q, r, paths[(q + r) % 2]) for q in range(20) for r in range(3)] + [(99, 0, None)]
    hits = spark.createDataFrame(rows, "probe_id int, rank int, image_path string").repartition(4)
    root = f"file://{tmp_path}/out"
    out, made = materialised_hits(hits, root)
    held = {r.source: r for r in made.collect()}
    assert {(r.bytes, r.error) for r in held.values()} == {(5_000_000, None)} and len({r.sha256 for r in held.values()}) == 2
    got = out.collect()
    assert len(got) == len(rows) and all((r.image_path, r.source_image_path) == ((held[r.source_image_path].target, r.source_image_path) if r.source_image_path else (None, None)) for r in got)
    folder = tmp_path / "out" / "hit_images"
    before = {f: os.stat(folder / f).st_mtime_ns for f in os.listdir(folder)}
    assert len(before) == 2 and all((folder / os.path.basename(held[p].target)).read_bytes()[:1].decode() == p[-len("a/x y.jpg")] for p in paths)
    # again, with one copy damaged by a lost task: it alone is made anew
    damaged = folder / os.path.basename(held[paths[0]].target)
    damaged.write_bytes(b"half")
    materialised_hits(hits, root)
    after = {f: os.stat(folder / f).st_mtime_ns for f in os.listdir(folder)}
    assert set(after) == set(before) and damaged.stat().st_size == 5_000_000 and sum(after[f] == before[f] for f in after) == 1


def test_missing_hits(spark, tmp_path):
    hits = spark.createDataFrame([(0, f"file://{tmp_path}/gone.jpg")], "probe_id int, image_path string")
    with pytest.raises(FileNotFoundError, match="1 hit files"):
        materialised_hits(hits, str(tmp_path))
    out, _ = materialised_hits(hits, str(tmp_path), strict=False)
    r = out.first()
    assert r.image_path is None and "FileNotFoundError" in r.error
    assert materialised_hits(hits.where(F.lit(False)), str(tmp_path))[0].count() == 0
