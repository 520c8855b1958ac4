"""Exact trees against a plain search over all splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitscope.operators.layout import running_sums
from unitscope.operators.tree import exact_tree


def gini_gain(left, right):
    def part(c):
        n = sum(c.values())
        return sum(v * v for v in c.values()) / n

    both = {k: left.get(k, 0) + right.get(k, 0) for k in {*left, *right}}
    return part(left) + part(right) - part(both)


def count(labels):
    return {int(k): int(n) for k, n in zip(*np.unique(labels, return_counts=True))}


def plain_tree(x, y, max_depth, min_split, min_leaf):
    out = {}

    def grow(node, depth, at):
        c = count(y[at])
        cls = min(c, key=lambda k: (-c[k], k))
        found = None
        if depth < max_depth and len(at) >= min_split:
            options = []
            for unit in range(x.shape[1]):
                values = np.unique(x[at, unit])
                for t, after in zip(values, values[1:]):
                    low = x[at, unit] <= t
                    if low.sum() >= min_leaf and (~low).sum() >= min_leaf:
                        gain = gini_gain(count(y[at][low]), count(y[at][~low]))
                        if gain > 1e-9:
                            options.append((-round(gain, 9), unit, t, (t + after) / 2))
            found = min(options, default=None)
        out[node] = (depth, None if found is None else found[1], None if found is None else found[3], len(at), cls)
        if found:
            low = x[at, found[1]] <= found[2]
            grow(2 * node, depth + 1, at[low])
            grow(2 * node + 1, depth + 1, at[~low])

    grow(1, 0, np.arange(len(y)))
    return out


@pytest.mark.parametrize("seed,depth,leaf", [(1, 3, 5), (2, 4, 10), (3, 1, 1)])
def test_tree_equals_the_plain_search(spark, seed, depth, leaf):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((220, 4)), 2)
    y = (x[:, 1] > 0.5) * 2 + (x[:, 2] + 0.3 * rng.random(220) > 0.7)
    rows = [(i, u, float(x[i, u])) for i in range(220) for u in range(4)] + [(900, 0, 0.5), (3, 9, None), (4, 9, float("nan"))]
    features = spark.createDataFrame(rows, "img long, unit int, v double")
    classes = spark.createDataFrame([(i, int(y[i])) for i in range(220)] + [(900, None)], "img long, cls int")
    tree = exact_tree(features.where("unit < 9"), classes, depth, 20, leaf)
    got = {r["node"]: (r["depth"], r["unit"], r["threshold"], r["n"], r["cls"]) for r in tree.nodes.collect()}
    want = plain_tree(x, y, depth, 20, leaf)
    assert got.keys() == want.keys()
    for node in got:
        assert got[node][:2] == want[node][:2] and got[node][3:] == want[node][3:]
        assert got[node][2] == pytest.approx(want[node][2])
    leaves = {r["img"]: (r["node"], r["predicted"]) for r in tree.leaves.collect()}
    assert len(leaves) == 220
    for img, (node, predicted) in leaves.items():
        at = 1
        while want[at][1] is not None:
            at = 2 * at + (x[img, want[at][1]] > want[at][2])
        assert (node, predicted) == (at, want[at][4])


def test_no_split(spark):
    features = spark.createDataFrame([(i, 0, 1.0) for i in range(30)], "img long, unit int, v double")
    classes = spark.createDataFrame([(i, i % 2) for i in range(30)], "img long, cls int")
    assert [tuple(r) for r in exact_tree(features, classes).nodes.collect()] == [(1, 0, None, None, 30, 0, 0.5)]
    assert exact_tree(features.limit(0), classes).nodes.count() == 0


def test_running_sums_over_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.3), int(v), int(a)) for v, a in zip(rng.integers(0, 400, 3000), rng.integers(1, 9, 3000))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g int, v int, a long")
        got = running_sums(df, ["g"], "v", ["a"])
        sums = got.groupBy("g", "v").agg(F.min("a_upto").alias("lo"), F.max("a_upto").alias("hi")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in sums:
        assert r["lo"] == r["hi"] == sum(a for g, v, a in rows if g == r["g"] and v <= r["v"])
