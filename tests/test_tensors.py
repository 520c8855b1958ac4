"""Constructors, shape operators and algebra against numpy on fixed arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitscope import schema
from unitscope.operators import algebra, construct, reduce, reshape
from unitscope.sources import tensors

ARR1 = np.arange(24.0).reshape(1, 2, 3, 4)
ARR2 = np.arange(120.0, 144.0).reshape(1, 2, 3, 4)
ARR3 = np.arange(20.0).reshape(4, 5)
ARR4 = np.arange(30.0).reshape(5, 6)
ARR5 = np.arange(120.0).reshape(2, 3, 4, 5)


@pytest.fixture(scope="module")
def m1(spark):
    return tensors.array_to_cells(spark, ARR1).cache()


@pytest.fixture(scope="module")
def m2(spark):
    return tensors.array_to_cells(spark, ARR2).cache()


@pytest.fixture(scope="module")
def m3(spark):
    return tensors.array_to_cells(spark, ARR3).cache()


@pytest.fixture(scope="module")
def m4(spark):
    return tensors.array_to_cells(spark, ARR4).cache()


@pytest.mark.parametrize("shape", [(7,), (4, 5), (2, 3, 4), (2, 3, 4, 5)])
def test_array_to_cells_pads_absent_axes(spark, shape):
    array = np.arange(float(np.prod(shape))).reshape(shape)
    mat = tensors.array_to_cells(spark, array)
    assert mat.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.MATRIX]
    rows = mat.collect()
    assert len(rows) == array.size
    absent = 4 - len(shape)
    for r in rows:
        assert all(r[i] == -1 for i in range(absent))
        assert r.value == array[tuple(r[i] for i in range(absent, 4))]
    assert reshape.shape_values(mat) == [0] * absent + list(shape)


def test_array_of_other_rank_is_refused(spark):
    with pytest.raises(ValueError):
        tensors.array_to_cells(spark, np.zeros((1, 1, 1, 1, 1)))
    with pytest.raises(ValueError):
        tensors.array_to_cells(spark, 3.0)


def test_constructors(spark, dense):
    assert (dense(construct.zeroes(spark, 1, 2, 3, 4)) == np.zeros((1, 2, 3, 4))).all()
    ones = construct.ones_2d(spark, 3, 2)
    assert (dense(ones)[0, 0] == 1).all() and ones.where("id_1 <> -1 or id_2 <> -1").count() == 0
    values = dense(construct.random_4d(spark, 3, 4, 5, 6, lo=-1, hi=2, seed=5))
    assert set(np.unique(values)) == {-1.0, 0.0, 1.0, 2.0}
    again = dense(construct.random_4d(spark, 3, 4, 5, 6, lo=-1, hi=2, seed=5))
    other = dense(construct.random_4d(spark, 3, 4, 5, 6, lo=-1, hi=2, seed=6))
    assert (values == again).all() and (values != other).any()
    assert set(np.unique(dense(construct.random_2d(spark, 20, 20)))) == {1.0, 2.0, 3.0, 4.0, 5.0}
    assert construct.zeroes(spark, 0, 2, 3, 4).count() == 0


@pytest.mark.parametrize("axis", range(4))
def test_reverse(spark, dense, axis):
    mat = tensors.array_to_cells(spark, ARR5)
    once = reshape.reverse(mat, axis)
    assert (dense(once) == np.flip(ARR5, axis)).all()
    assert (dense(reshape.reverse(once, axis, ARR5.shape[axis])) == ARR5).all()


def test_reverse_leaves_an_absent_axis(m3, dense):
    assert reshape.reverse(m3, 0).where("id_1 <> -1").count() == 0
    with pytest.raises(ValueError):
        reshape.reverse(m3, 4)


@pytest.mark.parametrize("axes", [None, [0, 3, 1, 2], [0, 2, 3, 1], [3, 1, 0, 2]])
def test_transpose(spark, dense, axes):
    mat = tensors.array_to_cells(spark, ARR5)
    turned = reshape.transpose(mat, axes)
    assert turned.columns == [*schema.IDS, "value"]
    assert (dense(turned) == ARR5.transpose(axes)).all()
    back = [3, 2, 1, 0] if axes is None else list(np.argsort(axes))
    assert (dense(reshape.transpose(turned, back)) == ARR5).all()


def test_channel_rows_match_numpy(spark):
    array = np.arange(2 * 3 * 2 * 2, dtype=float).reshape(2, 3, 2, 2)
    cells = schema.to_cells(tensors.array_to_cells(spark, array))
    want = array.transpose(0, 2, 3, 1).reshape(-1, 3)
    for r in reshape.channel_rows(cells, 2, 2).collect():
        assert want[r.row_id, r.unit] == r.v


def test_one_hot(spark):
    df = spark.createDataFrame([(0, 2), (1, 0)], "i int, c int")
    rows = reshape.one_hot(df, "c", minlength=5).collect()
    assert len(rows) == 10
    assert {(r.i, r.pos) for r in rows if r.hot == 1.0} == {(0, 2), (1, 0)}


def test_elementwise(m1, m2, dense):
    assert (dense(algebra.add(m1, m2)) == ARR1 + ARR2).all()
    assert (dense(algebra.subtract(m1, m2)) == ARR1 - ARR2).all()
    assert (dense(algebra.dot_multiply(m1, m2)) == ARR1 * ARR2).all()
    assert np.allclose(dense(algebra.dot_divide(m1, m2)), ARR1 / ARR2, rtol=0, atol=0)
    assert (dense(algebra.add(m1, 3)) == ARR1 + 3).all()
    assert (dense(algebra.subtract(m1, 3)) == ARR1 - 3).all()


def test_ordered_result(m1, m2):
    ids = [tuple(r)[:4] for r in algebra.add(m1, m2, ordered=True).collect()]
    assert ids == sorted(ids)


def test_divisor_zero_gives_null(m1):
    quotient = algebra.dot_divide(m1, algebra.dot_multiply(m1, construct.zeroes(m1.sparkSession, 1, 2, 3, 4)))
    assert quotient.where("value is not null").count() == 0 and quotient.count() == 24


def test_shape_mismatch(m1, m3):
    for op in (algebra.add, algebra.subtract, algebra.dot_multiply, algebra.dot_divide):
        with pytest.raises(ValueError):
            op(m1, m3)
    with pytest.raises(ValueError):
        algebra.dot_multiply_2d(m3, m3, [4, 5], [5, 4])


def test_sparse_operands(m1, m2):
    sparse = m2.where("id_4 <> 1 or id_3 = 2")
    assert algebra.add(m1, sparse).count() == sparse.count()
    filled = algebra.add(m1, sparse, fill=0.0)
    assert filled.count() == 24
    assert filled.agg(F.sum("value")).first()[0] == ARR1.sum() + sparse.agg(F.sum("value")).first()[0]


@pytest.mark.parametrize("salts", [1, 3])
def test_matrix_product(m3, m4, dense, salts):
    product = algebra.multiply_2d(m3, m4, salts=salts)
    assert product.schema.names == [*schema.IDS, "value"]
    assert (dense(product)[0, 0] == ARR3 @ ARR4).all()


def test_product_with_identity_and_itself(spark, m3, dense):
    identity = tensors.array_to_cells(spark, np.eye(5))
    assert (dense(algebra.multiply_2d(m3, identity))[0, 0] == ARR3).all()
    square = tensors.array_to_cells(spark, ARR3[:, :4])
    assert (dense(algebra.multiply_2d(square, square))[0, 0] == ARR3[:, :4] @ ARR3[:, :4]).all()


def test_heavy_inner_index_is_split(spark, monkeypatch):
    """One index holds most pairs: its left cells are dealt to many partitions, the product stays the same."""
    rng = np.random.default_rng(6)
    a = [(-1, -1, i, 0, float(rng.integers(1, 9))) for i in range(300)] + [(-1, -1, i, 1 + i % 5, 2.0) for i in range(40)]
    b = [(-1, -1, 0, j, float(rng.integers(1, 9))) for j in range(20)] + [(-1, -1, 1 + j % 5, j, 3.0) for j in range(20)]
    left, right = (spark.createDataFrame(x, schema.MATRIX) for x in (a, b))
    want = {}
    for *_, i, k, x in a:
        for *_, m, j, y in b:
            if k == m:
                want[i, j] = want.get((i, j), 0.0) + x * y
    monkeypatch.setattr(algebra, "PAIRS", 400)
    product = algebra.multiply_2d(left, right)
    assert {(r["id_3"], r["id_4"]): r["value"] for r in product.collect()} == want
    dealt, _, on = algebra._dealt(left.select("id_3", F.col("id_4").alias("_k"), F.col("value").alias("_a")), right.select(F.col("id_3").alias("_k"), "id_4", F.col("value").alias("_b")))
    assert on == ["_k", "_s"]
    hot = dealt.where("_k = 0").groupBy("_s").count().collect()
    assert len(hot) >= 10 and max(r["count"] for r in hot) < 60
    monkeypatch.setattr(algebra, "PAIRS", 10**6)
    assert {(r["id_3"], r["id_4"]): r["value"] for r in algebra.multiply_2d(left, right).collect()} == want
    assert algebra.multiply_2d(left.limit(0), right).count() == 0


@pytest.mark.parametrize("block", [2, 3, 256])
def test_tiled_product(m3, m4, dense, block):
    assert np.allclose(dense(algebra.multiply_tiled(m3, m4, block))[0, 0], ARR3 @ ARR4, rtol=1e-12)
    sparse = m3.where("id_4 <> 2 and id_3 <> 1")
    plain = algebra.multiply_2d(sparse, m4.where("id_4 < 4"))
    tiled = algebra.multiply_tiled(sparse, m4.where("id_4 < 4"), block)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, tiled.collect()))


def test_batched_product(spark, dense):
    a, b = ARR5, ARR5.transpose(0, 1, 3, 2)
    left, right = tensors.array_to_cells(spark, a), tensors.array_to_cells(spark, b)
    assert (dense(algebra.multiply_batched(left, right)) == a @ b).all()


def test_maximum(spark, dense):
    mat = tensors.array_to_cells(spark, ARR5)
    assert reduce.max_all(mat).first()[0] == 119.0
    for axis in range(4):
        got = reduce.max_axis(mat, axis)
        assert got.where(F.col(schema.IDS[axis]) != -1).count() == 0
        assert (dense(got) == ARR5.max(axis=axis, keepdims=True)).all()
    twice = reduce.max_axis(reduce.max_axis(mat, 1), 3)
    assert (dense(twice) == ARR5.max(axis=(1, 3), keepdims=True)).all()


def test_spatial_max_by_rank(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1, 5.0), (0, 0, 0, 2, 3.0), (0, 1, 0, 0, 2.0)], "img int, unit int, y int, x int, v double")
    assert {(r.unit, r.max_v) for r in reduce.spatial_max(cells, 4).collect()} == {(0, 5.0), (1, 2.0)}
    assert reduce.spatial_max(cells, 2).count() == 3
    with pytest.raises(ValueError):
        reduce.spatial_max(cells, 5)


def test_bincount(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 1, 3, 2, 1, 7]], "l int")
    assert {(r.l, r.n) for r in reduce.bincount(df, "l").collect()} == {(1, 3), (2, 1), (3, 1), (7, 1)}


def test_argmax_and_mode_ties(spark):
    scores = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (1, 0, 0.5), (1, 3, 0.7)], "img int, cls int, score double")
    assert {(r.img, r.predicted) for r in reduce.argmax_class(scores).collect()} == {(0, 1), (1, 3)}
    seen = spark.createDataFrame([("g", "b", 0), ("g", "a", 1), ("g", "a", 2), ("g", "b", 3)], "g string, c string, p int")
    assert reduce.mode_earliest(seen, ["g"], "c", "p").first()["mode"] == "b"


def _product_of(a, b):
    """The product as SQL sees it: null inner ids meet nothing, null values add nothing, null outer ids are an id."""
    out = {}
    for i, k, x in a:
        for m, j, y in b:
            if k is not None and k == m:
                out.setdefault((i, j), []).append(None if x is None or y is None else x * y)
    return {at: sum(known) if (known := [v for v in found if v is not None]) else None for at, found in out.items()}


@pytest.mark.parametrize("cells,rows,keys", [(10**6, 10**6, 10**6), (12, 3, 80), (7, 1, 30)])
def test_striped_product(spark, monkeypatch, cells, rows, keys):
    """Stripes of the result, some with dealt inner indices, give what the join gives."""
    rng = np.random.default_rng(4)

    def maybe(x, odds=12):
        return None if rng.integers(odds) == 0 else x

    a = [(maybe(int(i) * 10), maybe(int(k)), maybe(float(v))) for i, k, v in rng.integers(-3, 9, (150, 3))]
    b = [(maybe(int(k)), maybe(int(j) * 7), maybe(float(v))) for k, j, v in rng.integers(-3, 9, (90, 3))]
    a += [(500 + i, 3, 1.0) for i in range(keys if keys < 100 else 50)] + [(900, None, 1.0), (901, 77, 1.0), (902, 4, None)]
    left = spark.createDataFrame([(-1, -1, i, k, v) for i, k, v in a], schema.MATRIX)
    right = spark.createDataFrame([(-1, -1, k, j, v) for k, j, v in b], schema.MATRIX)
    for name, value in {"JOINED_PAIRS": 0, "STRIPE_CELLS": keys, "STRIPE_PAIRS": 2000, "OPEN_CELLS": cells}.items():
        monkeypatch.setattr(algebra, name, value)
    want = _product_of(a, b)
    for product in (algebra._striped(algebra._cells(left.withColumnRenamed("id_4", "_k").where("_k is not null"), "id_3", "value"),
                                     algebra._cells(right.withColumnRenamed("id_3", "_k").where("_k is not null"), "id_4", "value"), 3000.0, rows),
                    algebra.multiply_tiled(left, right, rows)):
        found = [(r["id_3"], r["id_4"], r["value"]) for r in product.select("id_3", "id_4", "value").collect()]
        assert len(found) == len(want) and {(i, j): v for i, j, v in found} == want


def test_product_of_many_pairs_shuffles_no_sums(spark, monkeypatch):
    """Pairs beyond the limit are added up where the operands meet: no shuffle follows the products."""
    cells = [(-1, -1, i, k, float(i + k)) for i in range(40) for k in range(3)]
    left = spark.createDataFrame(cells, schema.MATRIX)
    right = left.select("id_1", "id_2", F.col("id_4").alias("id_3"), F.col("id_3").alias("id_4"), "value")
    monkeypatch.setattr(algebra, "JOINED_PAIRS", 100)
    want = _product_of([c[2:] for c in cells], [(k, i, v) for _, _, i, k, v in cells])
    for product in (algebra.multiply_2d(left, right), algebra.multiply_tiled(left, right, 8)):
        assert {(r["id_3"], r["id_4"]): r["value"] for r in product.collect()} == want
        plan = product._jdf.queryExecution().toString()
        after = plan[: plan.index("MapInArrow")]
        assert "Exchange" not in after.split("== Physical Plan ==")[-1]


@pytest.mark.parametrize("heavy", [0, 20, 10**6])
def test_operands_of_a_striped_product_are_packed(spark, monkeypatch, heavy):
    """Operands find their stripes without a join of their cells, whatever the weight of an inner index."""
    cells = [(-1, -1, i if i else None, k, float(i - k) if i - k else None) for i in range(40) for k in range(4) if k or i < 15]
    left = spark.createDataFrame(cells, schema.MATRIX)
    right = left.select("id_1", "id_2", F.col("id_4").alias("id_3"), F.col("id_3").alias("id_4"), "value")
    for name, value in {"HEAVY_CELLS": heavy, "STRIPE_PAIRS": 300, "STRIPE_CELLS": 50}.items():
        monkeypatch.setattr(algebra, name, value)
    product = algebra.multiply_tiled(left, right, 8)
    assert "Join" not in product._jdf.queryExecution().toString()
    found = [(r["id_3"], r["id_4"], r["value"]) for r in product.collect()]
    want = _product_of([c[2:] for c in cells], [(k, i, v) for _, _, i, k, v in cells])
    assert len(found) == len(want) and {(i, j): v for i, j, v in found} == want


def test_copies_of_operands_are_bounded(spark, monkeypatch):
    """Tasks follow from pairs only as far as the operands need not be sent too often."""
    cells = [(-1, -1, i, k, float(i + k)) for i in range(40) for k in range(3)]
    left = spark.createDataFrame(cells, schema.MATRIX)
    right = left.select("id_1", "id_2", F.col("id_4").alias("id_3"), F.col("id_3").alias("id_4"), "value")
    for name, value in {"STRIPE_PAIRS": 1, "SENT_CELLS": 0}.items():
        monkeypatch.setattr(algebra, name, value, raising=False)
    product = algebra.multiply_tiled(left, right, 8)
    assert product.rdd.getNumPartitions() <= 64  # of 4,800 pairs
    assert product.count() == 1600


def test_products_keep_infinities_apart(spark, monkeypatch):
    monkeypatch.setattr(algebra, "JOINED_PAIRS", 0)
    left = spark.createDataFrame([(-1, -1, 0, 0, float("inf")), (-1, -1, 1, 0, 1.0), (-1, -1, 1, 1, 2.0)], schema.MATRIX)
    right = spark.createDataFrame([(-1, -1, 0, 0, 1.0), (-1, -1, 1, 1, 3.0)], schema.MATRIX)
    found = {(r["id_3"], r["id_4"]): r["value"] for r in algebra.multiply_tiled(left, right).collect()}
    assert found == {(0, 0): float("inf"), (1, 0): 1.0, (1, 1): 6.0}
