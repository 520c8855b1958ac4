"""A decision tree with exact splits on long features ``(img, unit, v)``.

At every level all splits ``v <= t`` of all nodes and units are scored from class counts up to each
value. The sums of squared class counts on both sides, which Gini's impurity needs, are
running sums of whole numbers, so nothing is sampled or binned and a level takes two passes of
running sums whatever the depth of the tree. Values of a node and unit may lie in many partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitscope.operators.layout import bounded, running_sums, top_per_group
from unitscope.session import cut


@dataclass
class Tree:
    """``nodes``: node, depth, unit, threshold (null in a leaf), n, cls, share; ``leaves``: img, cls, node, predicted.

    The children of node k are 2k (``v <= threshold``) and 2k + 1; the root is 1.
    """

    nodes: DataFrame
    leaves: DataFrame


def best_splits(features: DataFrame, min_leaf: int) -> DataFrame:
    """The best split ``(node, unit, t, gain)`` of every node of ``(node, cls, unit, v)``.

    ``gain`` is the sum over both sides of squared class counts over rows, less that of the
    node; ties go to the lowest unit, then the lowest value. Nodes without a gain have no row.
    """
    counts = cut(features.groupBy("node", "unit", "v", "cls").agg(F.count("*").alias("c")))
    upto = running_sums(counts, ["node", "unit", "cls"], "v", ["c"])
    totals = counts.groupBy("node", "unit", "cls").agg(F.sum("c").alias("whole"))
    known = upto.join(totals, ["node", "unit", "cls"])
    # left² grows by (new² - old²); right² = whole² - 2 whole · left + left²
    rows = known.select(
        "node", "unit", "v", "c",
        (F.col("c_upto") * F.col("c_upto") - (F.col("c_upto") - F.col("c")) * (F.col("c_upto") - F.col("c"))).alias("square"),
        (F.col("whole") * F.col("c")).alias("cross"),
    )
    steps = rows.groupBy("node", "unit", "v").agg(*[F.sum(x).alias(x) for x in ("c", "square", "cross")])
    sums = running_sums(steps, ["node", "unit"], "v", ["c", "square", "cross"])
    sizes = totals.groupBy("node", "unit").agg(F.sum("whole").alias("n"), F.sum(F.col("whole") * F.col("whole")).alias("squares"))
    left, right = F.col("c_upto"), F.col("n") - F.col("c_upto")
    split = sums.join(sizes, ["node", "unit"]).where((left >= min_leaf) & (right >= min_leaf))
    over = F.col("squares") - 2 * F.col("cross_upto") + F.col("square_upto")
    score = F.col("square_upto") / left + over / right - F.col("squares") / F.col("n")
    scored = split.select("node", "unit", F.col("v").alias("t"), score.alias("gain")).where(F.col("gain") > 0)
    return top_per_group(scored, ["node"], [F.desc("gain"), F.asc("unit"), F.asc("t")], 1, "_r").drop("_r")


def exact_tree(features: DataFrame, classes: DataFrame, max_depth: int = 4, min_split: int = 20, min_leaf: int = 10) -> Tree:
    """Grow a tree on ``features`` (img, unit, v) and ``classes`` (img, cls).

    Every image has a value for every unit (0 where there is none is up to the caller); images without
    a class, null values and NaN take no part. A node of fewer than ``min_split`` images is a leaf, as is
    one in which no split leaves ``min_leaf`` on both sides with a gain. Ties between classes
    go to the lowest.
    """
    known = classes.where(F.col("cls").isNotNull()).select("img", "cls")
    value = F.col("v").cast("double") + F.lit(0.0)
    rows = cut(
        features.where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
        .join(known, "img")
        .select("img", "cls", "unit", value.alias("v"), F.lit(1).cast("long").alias("node"))
    )
    at = cut(rows.select("img", "cls", "node").distinct())
    made = []
    for depth in range(max_depth + 1):
        by_class = at.groupBy("node", "cls").agg(F.count("*").alias("c"))
        nodes = cut(
            by_class.groupBy("node").agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("c"), "cls")).alias("m"))
            .select("node", F.lit(depth).alias("depth"), "n", F.col("m.cls").alias("cls"), (-F.col("m.c") / F.col("n")).alias("share"))
        )
        # images of earlier leaves keep their node and do not come back here
        current = nodes.where((F.col("node") >= 1 << depth) & (F.col("node") < 2 << depth))
        if depth == max_depth:
            made.append(current.withColumn("unit", F.lit(None).cast("int")).withColumn("threshold", F.lit(None).cast("double")))
            break
        large = bounded(current.where(F.col("n") >= min_split).select("node"))
        splits = cut(best_splits(rows.join(large, "node"), min_leaf))
        # the threshold lies half-way to the next value
        choice = splits.withColumnRenamed("unit", "split_unit")
        beyond = rows.join(F.broadcast(choice), "node").where((F.col("unit") == F.col("split_unit")) & (F.col("v") > F.col("t")))
        after = beyond.groupBy("node").agg(F.min("v").alias("next"))
        done = cut(splits.join(after, "node").select("node", "unit", "t", ((F.col("t") + F.col("next")) / 2).alias("threshold")))
        made.append(current.join(done.select("node", F.col("unit").cast("int"), "threshold"), "node", "left"))
        if done.isEmpty():
            break
        chosen = F.broadcast(done.select("node", F.col("unit").alias("split_unit"), "t"))  # one row a node
        side = rows.join(chosen, "node").where(F.col("unit") == F.col("split_unit"))
        moves = side.select("img", (F.col("node") * 2 + F.when(F.col("v") <= F.col("t"), 0).otherwise(1)).alias("to"))
        moves = cut(moves)
        rows = cut(rows.join(moves, "img").select("img", "cls", "unit", "v", F.col("to").alias("node")))
        at = cut(at.join(moves, "img", "left").select("img", "cls", F.coalesce("to", "node").alias("node")))
    columns = ["node", "depth", "unit", "threshold", "n", "cls", "share"]
    nodes = made[0].select(*columns)
    for level in made[1:]:
        nodes = nodes.unionByName(level.select(*columns))
    nodes = cut(nodes)
    leaves = at.join(F.broadcast(nodes.select("node", F.col("cls").alias("predicted"))), "node")
    return Tree(nodes, leaves.select("img", "cls", "node", "predicted"))
