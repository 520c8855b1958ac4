import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitscope.operators import quantile


def _frame(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(size=3001),
        "zeros": np.concatenate([np.zeros(2500), rng.random(400)]),
        "one": np.array([4.5]),
        "two": np.array([1.0, 3.0]),
        "same": np.full(100, -2.0),
        "signed": np.array([0.0, -0.0, 1.0, -1.0]),
    }


@pytest.mark.parametrize("qs", [[0.0, 1.0], [994 / 999], [i / 20 for i in range(21)]])
@pytest.mark.parametrize("accuracy, bucket_rows", [(20, 10**6), (10_000, 10**6), (40, 20)])
def test_exact_quantiles(spark, groups, qs, accuracy, bucket_rows):
    """Right whatever the sketch proposes, with heavy ties, tiny groups and repeated cuts."""
    out = quantile.exact_quantiles(
        _frame(spark, groups), ["g"], "v", qs, accuracy=accuracy, bucket_rows=bucket_rows
    )
    rows = out.collect()
    assert len(rows) == len(groups) * len(qs)
    for r in rows:
        assert r.quantile == pytest.approx(np.quantile(groups[r.g], r.q), abs=1e-12)


def test_midrank_quantiles(spark, groups):
    qs = [0.0, 0.01, 0.5, 0.77, 1.0]
    for r in quantile.quantiles(_frame(spark, groups), ["g"], "v", qs).collect():
        values = np.sort(groups[r.g])
        at = (np.arange(len(values)) + 0.5) / len(values)
        assert r.quantile == pytest.approx(np.interp(r.q, at, values), abs=1e-12)


def test_nan_and_null_are_skipped(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", None), ("a", 3.0), ("b", math.nan)], "g string, v double")
    assert [(r.g, r.quantile) for r in quantile.percentiles(df, ["g"], "v", [0.5]).collect()] == [("a", 2.0)]
    spread = {r.g: (r.min_v, r.max_v) for r in quantile.minmax(df, ["g"], "v").collect()}
    assert spread["a"] == (1.0, 3.0) and all(math.isnan(v) for v in spread["b"])


def test_readout_is_even(spark):
    df = _frame(spark, {"a": np.arange(101)})
    got = {r.q_idx: r.quantile for r in quantile.readout(df, ["g"], "v", 11).collect()}
    assert got == {i: 10.0 * i for i in range(11)}


def test_integrate(spark):
    df = _frame(spark, {"a": np.arange(10)})
    assert quantile.integrate(df, ["g"], "v", lambda v: v * v).first().integral == 285.0


def test_sketches_merge(spark):
    """A hard order: sorted blocks of growing range, taken from the low and the high end in turn."""
    rng = np.random.default_rng(12)
    blocks = [np.sort(rng.normal(scale=1.5**b, size=500)) for b in range(40)]
    data = np.concatenate([b if i % 2 else b[::-1] for i, b in enumerate(blocks)])
    n = len(data)
    rows = [(i % 7, float(v)) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "part int, v double").withColumn("g", F.lit("a"))
    parts = quantile.build_sketch(df, ["g", "part"], "v", k=400)
    merged = quantile.merge_sketches(parts, ["g"])
    assert quantile.sketch_sizes(merged, ["g"]).first().seen == n
    qs = [0.05, 0.25, 0.5, 0.75, 0.95]
    for r in quantile.sketch_quantiles(merged, ["g"], qs).collect():
        assert abs(np.mean(data <= r.estimate) - qs[r.q_idx]) < 0.02
    report = quantile.sketch_report(df, merged, ["g"], "v", qs).first()
    assert report.seen == n and report.max_deviation < 0.03


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        quantile.exact_quantiles(_frame(spark, {"a": [1]}), ["g"], "v", [0.5], method="other")
