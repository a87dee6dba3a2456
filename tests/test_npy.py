"""NumPy matrices through Spark's reader: folders, shards, ranges, and files that cannot be read."""

import numpy as np
import pytest

from provenant.sources.npy import matrices


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    held = {}
    for shard in range(3):
        (tmp_path / f"shard_{shard}").mkdir()
        for name, kind in (("emb", "<f4"), ("count", "<i8")):
            x = (rng.normal(size=(10 + 7 * shard, 4)) * 100).astype(kind)
            np.save(tmp_path / f"shard_{shard}" / f"{name}.npy", x)
            held[f"shard_{shard}/{name}.npy"] = x
    (tmp_path / "shard_0" / "notes.txt").write_text("not a matrix")
    return tmp_path, held


def test_folder_of_shards_in_parts(spark, folder):
    root, held = folder
    for path in (str(root), f"file://{root}"):
        df = matrices(spark, path, rows=4)
        got = {}
        for r in df.orderBy("file", "row").collect():
            got.setdefault(r.file, []).append(r.v)
            assert r.shard == int(r.file[6])
        assert set(got) == set(held) and all((np.array(got[f]) == held[f].astype(float)).all() for f in held)
        assert df.rdd.getNumPartitions() == sum(-(-len(x) // 4) for x in held.values())
    some = matrices(spark, f"file://{root}/shard_*/emb.npy", columns="1:3")
    assert {r.file for r in some.select("file").distinct().collect()} == {f for f in held if "emb" in f}
    assert some.where("shard = 2 AND row = 5").first().v == held["shard_2/emb.npy"][5, 1:3].astype(float).tolist()


def test_one_file_and_one_dimension(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(5.0))
    rows = matrices(spark, f"{tmp_path}/x.npy", rows=2).orderBy("row").collect()
    assert [(r.file, r.shard, r.row, r.v) for r in rows] == [("x.npy", None, i, [float(i)]) for i in range(5)]


def test_empty_and_missing(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.empty((0, 3), np.float32))
    (tmp_path / "bare").mkdir()
    assert matrices(spark, f"{tmp_path}/none.npy").count() == 0 and matrices(spark, f"{tmp_path}/bare").count() == 0
    assert matrices(spark, f"{tmp_path}/gone", missing="empty").count() == 0
    with pytest.raises(Exception, match="no such file or folder"):
        matrices(spark, f"{tmp_path}/gone").count()


@pytest.mark.parametrize("spoil, said", [("cut", "cut short"), ("head", "cut short"), ("other", "not a NumPy file"), ("fortran", "only numbers"), ("text", "only numbers")])
def test_files_that_cannot_be_read(spark, tmp_path, spoil, said):
    path = tmp_path / "x.npy"
    np.save(path, {"fortran": np.asfortranarray(np.ones((3, 2))), "text": np.array(["a", "b"])}.get(spoil, np.ones((9, 9))))
    data = path.read_bytes()
    path.write_bytes({"cut": data[:-5], "head": data[:40], "other": b"PK" + data}.get(spoil, data))
    with pytest.raises(Exception, match=said):
        matrices(spark, str(path)).count()
