"""Array files against numpy."""

import numpy as np
import pytest

from unitscope.session import scratch
from unitscope.sources import arrays, tensors


def cells_of(df):
    return {tuple(r)[:4]: r["value"] for r in df.collect()}


def want(a):
    lead = (-1,) * (4 - a.ndim)
    return {(*lead, *map(int, i)): float(v) for i, v in np.ndenumerate(a)}


@pytest.mark.parametrize("shape,kind,order", [((7,), "<f8", "C"), ((5, 3), ">i4", "C"), ((4, 3, 2, 5), "<f4", "C"), ((4, 3, 2), "<f8", "F"), ((0, 3), "<f8", "C")])
def test_npy_files(spark, tmp_path, shape, kind, order):
    a = np.asarray(np.random.default_rng(1).integers(-99, 99, shape).astype(kind), order=order)
    np.save(tmp_path / "a.npy", a)
    got = arrays.read_array(spark, str(tmp_path / "a.npy"), partitionBytes=40)
    assert cells_of(got) == want(a)
    assert got.rdd.getNumPartitions() >= min(2, a.size // 10)
    some = arrays.read_array(spark, str(tmp_path / "a.npy"), start=1, end=3)
    assert cells_of(some) == {k: v for k, v in want(a).items() if 1 <= k[4 - a.ndim] < 3}


def test_raw_files_and_maps(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(6, 3, 2, 4))
    a.tofile(tmp_path / "layer.mmap")
    path = str(tmp_path / "layer.mmap")
    assert cells_of(arrays.read_array(spark, path, shape=a.shape, partitionBytes=100)) == want(a)
    maps = arrays.read_array(spark, path, "blocks", shape=a.shape, partitionBytes=200)
    assert maps.rdd.getNumPartitions() == 6
    got = {(r["img"], r["unit"]): (r["h"], r["w"], r["values"]) for r in maps.collect()}
    assert got == {(i, u): (2, 4, a[i, u].ravel().tolist()) for i in range(6) for u in range(3)}
    part = arrays.read_array(spark, path, "blocks", shape=a.shape, start=2, end=4)
    assert {r["img"] for r in part.collect()} == {2, 3}


def test_written_folder(spark):
    a = np.random.default_rng(3).normal(size=(9, 2, 3, 3))
    path = scratch(spark, "array")
    arrays.save_array(tensors.array_to_cells(spark, a), path, a.shape, part_bytes=200)
    assert cells_of(arrays.read_array(spark, path, partitionBytes=100)) == want(a)
    assert arrays.read_array(spark, path, "blocks").count() == 18
    with pytest.raises(FileExistsError):
        arrays.save_array(tensors.array_to_cells(spark, a), path, a.shape)


def test_absent_cells_and_wrong_ones(spark, tmp_path):
    few = spark.createDataFrame([(-1, -1, 3, 1, 2.0)], tensors.MATRIX)
    path = scratch(spark, "array")
    arrays.save_array(few, path, (5, 2), fill=-1.0, part_bytes=16)
    filled = np.full((5, 2), -1.0)
    filled[3, 1] = 2.0
    assert cells_of(arrays.read_array(spark, path)) == want(filled)
    with pytest.raises(Exception, match="outside the shape"):
        arrays.save_array(few, scratch(spark, "array"), (3, 2))
    np.zeros(5).tofile(tmp_path / "short.mmap")
    with pytest.raises(Exception, match="numbers where a shape"):
        arrays.read_array(spark, str(tmp_path / "short.mmap"), shape=(2, 3)).count()
    with pytest.raises(Exception, match="needs the option shape"):
        arrays.read_array(spark, str(tmp_path / "short.mmap")).count()
