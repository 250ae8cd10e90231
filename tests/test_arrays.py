import numpy as np
import pytest

from motionframe.sources import arrays


@pytest.fixture
def load(spark, tmp_path):
    spark.dataSource.register(arrays.ArraySource)
    return lambda **o: spark.read.format("npy").options(**{"path": str(tmp_path)} | o).load()


def save(folder, name, array, **kw):
    folder.mkdir(exist_ok=True)
    np.save(folder / name, array, **kw)


def test_references_good_narrow_and_broken(load, tmp_path):
    good, other = np.arange(130, dtype=np.float64).reshape(2, 65), np.asfortranarray(np.arange(61 * 5000, dtype=np.int32).reshape(5000, 61))
    save(tmp_path / "flip", "one.npy", good)
    save(tmp_path / "flip", "narrow.npy", np.zeros((4, 59)))
    save(tmp_path / "twist", "columns.npy", other)
    save(tmp_path / "twist", "cube.npy", np.zeros((2, 60, 2)))
    save(tmp_path / "twist", "texts.npy", np.array([["a"] * 60]))
    save(tmp_path / "twist", "empty.npy", np.zeros((0, 60)))
    (tmp_path / "twist" / "broken.npy").write_bytes(b"\x93NUMPY\x01\x00\x10\x00{'descr': '<f8',")
    (tmp_path / "twist" / "short.npy").write_bytes((tmp_path / "flip" / "one.npy").read_bytes()[:200])
    (tmp_path / "twist" / "note.txt").write_text("x")
    found = load(least_columns=60, files=2)
    assert found.rdd.getNumPartitions() == 4
    rows = found.collect()
    assert {(r.folder, r.file) for r in rows} == {("flip", "one"), ("twist", "columns")} and len(rows) == 5002
    by_key = {(r.file, r.row): r["values"] for r in rows}
    assert by_key["one", 1] == good[1].tolist() and by_key["columns", 4999] == other[4999].astype(np.float32).tolist()


def test_keypoints_in_three_shapes_and_fitted(load, tmp_path):
    first = np.random.default_rng(1).normal(size=(3, 7, 17)).astype(np.float32)
    save(tmp_path / "k", "a.npy", first)
    save(tmp_path / "k", "b.npy", first.transpose(1, 2, 0))
    save(tmp_path / "k", "c.npy", first.transpose(1, 0, 2).reshape(7, 51))
    save(tmp_path / "k", "d.npy", np.zeros((7, 16, 3)))
    found = load(layout="keypoints")
    rows = {(r.file, r.row): r for r in found.select("file", "row", *arrays.keypoint_columns(found["values"])).collect()}
    assert len(rows) == 21
    for file in "abc":
        for t in range(7):
            assert [rows[file, t][f"{a}4"] for a in "xyc"] == pytest.approx(first[:, t, 4].tolist())
    five = {(r.file, r.row): r["values"] for r in arrays.fitted(found, 5).collect()}
    nine = {(r.file, r.row): r["values"] for r in arrays.fitted(found, 9).collect()}
    assert len(five) == 15 and five["a", 0] == first[:, 1, :].ravel().tolist() and five["c", 4] == first[:, 5, :].ravel().tolist()
    assert len(nine) == 27 and nine["b", 6] == first[:, 6, :].ravel().tolist() and nine["b", 8] == [0.0] * 51


def test_no_folder(load):
    assert load(path="/nowhere/at/all").count() == 0
