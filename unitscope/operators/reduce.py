"""Aggregations. All of them combine map-side before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitscope.operators.layout import bounded
from unitscope.schema import ABSENT, IDS


def max_all(mat: DataFrame) -> DataFrame:
    return mat.agg(F.max("value").alias("value"))


def max_axis(mat: DataFrame, axis: int) -> DataFrame:
    """Maximum along axis 0..3; the reduced axis is kept as absent."""
    if axis not in range(4):
        raise ValueError(f"axis must be 0..3, not {axis}")
    keep = [c for c in IDS if c != IDS[axis]]
    absent = F.lit(ABSENT).cast("long").alias(IDS[axis])
    out = mat.groupBy(*keep).agg(F.max("value").alias("value"))
    return out.select(*[absent if c == IDS[axis] else F.col(c) for c in IDS], "value")


def spatial_max(cells: DataFrame, rank: int = 4) -> DataFrame:
    """Maximum of every map: over y and x (rank 4), over y (rank 3); rank 2 is copied."""
    if rank == 2:
        return cells.select("img", "unit", F.col("v").alias("max_v"))
    if rank not in (3, 4):
        raise ValueError(f"rank must be 2, 3 or 4, not {rank}")
    return cells.groupBy("img", "unit").agg(F.max("v").alias("max_v"))


def block_max(blocks: DataFrame) -> DataFrame:
    """As :func:`spatial_max` for whole maps; needs no shuffle."""
    return blocks.select("img", "unit", F.array_max("values").alias("max_v"))


def over_threshold(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cells strictly above the threshold of their unit."""
    return cells.join(bounded(thresholds), "unit").where(F.col("v") > F.col("thresh"))


def mask_area(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cells over the threshold per map; maps without any keep a 0."""
    hit = F.count_if(F.col("v") > F.col("thresh"))
    return cells.join(bounded(thresholds), "unit").groupBy("img", "unit").agg(hit.alias("area"))


def bincount(df: DataFrame, label: str) -> DataFrame:
    """Occurrences per positive label; label 0 means unlabelled and is dropped."""
    return df.where(F.col(label) > 0).groupBy(label).agg(F.count("*").alias("n"))


def argmax_class(scores: DataFrame, item: str = "img", cls: str = "cls", score: str = "score") -> DataFrame:
    """The class with the largest score per item; the first class wins a tie."""
    best = F.max_by(cls, F.struct(F.col(score), -F.col(cls)))
    return scores.groupBy(item).agg(best.alias("predicted"))


def accuracy(predictions: DataFrame, predicted: str = "predicted", truth: str = "label") -> DataFrame:
    hit = F.col(predicted) == F.col(truth)
    return predictions.agg(
        F.count_if(hit).alias("correct"),
        F.count("*").alias("total"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def class_histogram(df: DataFrame, cls: str) -> DataFrame:
    """Items per class, rarest first."""
    return df.groupBy(cls).agg(F.count("*").alias("n")).orderBy("n", cls)


def mode_earliest(df: DataFrame, by: list[str], item: str, position: str | Column) -> DataFrame:
    """Most frequent item per group; the one met first wins a tie."""
    pos = F.col(position) if isinstance(position, str) else position
    counts = df.groupBy(*by, item).agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    best = F.max_by(item, F.struct(F.col("_n"), -F.col("_first")))
    return counts.groupBy(*by).agg(best.alias("mode"))


def distinct_over(df: DataFrame, item: str, score: str, threshold: float) -> DataFrame:
    """Distinct items among rows at or over a score."""
    kept = df.where(F.col(score) >= threshold)
    return kept.agg(F.count_distinct(item).alias("n_distinct"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum, one row per column."""
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev(c).alias("stddev"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))


def product_sum(df: DataFrame, by: list[str], left: str, right: str, name: str = "value") -> DataFrame:
    """Sum of the products of two columns per group, as inside a matrix product."""
    return df.groupBy(*by).agg(F.sum(F.col(left) * F.col(right)).alias(name))
