"""Arrays on a path that only Spark's readers can open."""

import numpy as np
import pytest

from featsift.sources import archive, shared_archive as S


@pytest.fixture
def store(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    name = f"arrays{abs(hash(str(tmp_path)))}"  # Hadoop keeps a mount as it first was
    conf.set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{tmp_path}")
    return tmp_path, f"viewfs://{name}/in"


def dense(frame, shape):
    out = np.zeros(shape)
    for r in frame.collect():
        assert out[r.row_id, r.feature_id] == 0
        out[r.row_id, r.feature_id] = r.value
    return out


@pytest.mark.parametrize("dtype, shape", [("f8", (40, 7)), ("f4", (33, 13)), ("i1", (65, 129)), ("i8", (5, 1000))])
def test_ranges(spark, store, dtype, shape):
    folder, path = store
    rng = np.random.default_rng(1)
    x = (rng.integers(-3, 4, shape) * (rng.random(shape) < 0.4)).astype(dtype)
    np.save(folder / "x.npy", x)
    for split in (None, 700, 97):
        assert (dense(S.read_npy(spark, f"{path}/x.npy", split), shape) == x).all()
    _, kind, offset = S.npy_header(spark, f"{path}/x.npy")
    size = np.gcd(offset, shape[1] * kind.itemsize)
    assert S._records(spark, f"{path}/x.npy", int(size), 700).getNumPartitions() > 2


def test_compressed_members(spark, store):
    folder, path = store
    x, y = np.eye(30, 9) * 2.5, np.arange(30) % 2
    np.savez_compressed(folder / "a.npz", X_train=x, y_train=y, ids=np.array([f"r{i}é" for i in range(30)]))
    assert (dense(S.read_npz(spark, f"{path}/a.npz", "X_train"), x.shape) == x).all()
    S.ingest(spark, f"{path}/a.npz", f"{path}/out")
    m = archive.read_matrix(spark, f"{path}/out")
    assert (dense(m.entries, x.shape) == x).all()
    assert sorted(tuple(r) for r in m.rows.collect()) == [(i, i % 2) for i in range(30)]
    assert {r.id for r in spark.read.parquet(f"{path}/out/rows").collect()} == {f"r{i}é" for i in range(30)}


def test_refused(spark, store):
    folder, path = store
    np.save(folder / "bad.npy", np.array([[1.0, np.nan]]))
    with pytest.raises(Exception, match="non-finite value at row 0, column 1"):
        S.read_npy(spark, f"{path}/bad.npy").collect()
    np.save(folder / "object.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError, match="pickle"):
        S.read_npy(spark, f"{path}/object.npy")
    np.save(folder / "none.npy", np.zeros((0, 4)))
    assert S.read_npy(spark, f"{path}/none.npy").collect() == []
