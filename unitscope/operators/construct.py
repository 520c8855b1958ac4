"""Constant and random tensors, generated on the executors."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.schema import ABSENT, IDS


def _grid(spark: SparkSession, dims: list[int | None]) -> DataFrame:
    """All cells of a grid with their flat row-major ``cell`` number; None = absent axis."""
    sizes = [1 if d is None else int(d) for d in dims]
    df = spark.range(prod(sizes)).withColumnRenamed("id", "cell")
    ids, stride = [], prod(sizes)
    for name, dim, size in zip(IDS, dims, sizes):
        stride = stride // size if size else 0
        if dim is None:
            ids.append(F.lit(ABSENT).cast("long").alias(name))
        else:
            ids.append(F.expr(f"(cell div {max(stride, 1)}) % {max(size, 1)}").alias(name))
    return df.select("cell", *ids)


def zeroes(spark: SparkSession, d1: int, d2: int, d3: int, d4: int) -> DataFrame:
    return _grid(spark, [d1, d2, d3, d4]).select(*IDS, F.lit(0.0).alias("value"))


def ones_2d(spark: SparkSession, d3: int, d4: int) -> DataFrame:
    return _grid(spark, [None, None, d3, d4]).select(*IDS, F.lit(1.0).alias("value"))


def hashed_integer(cell: Column, lo: int, hi: int, seed: int) -> Column:
    """Integer-valued double in ``lo..hi``, both included, drawn from a digest of the cell.

    A digest, unlike ``rand``, gives a retried task the same numbers.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), cell.cast("string")))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    return (number % (hi - lo + 1) + lo).cast("double")


def random_2d(spark, d3: int, d4: int, lo: int = 1, hi: int = 5, seed: int = 0) -> DataFrame:
    grid = _grid(spark, [None, None, d3, d4])
    return grid.select(*IDS, hashed_integer(F.col("cell"), lo, hi, seed).alias("value"))


def random_4d(
    spark, d1: int, d2: int, d3: int, d4: int, lo: int = 1, hi: int = 5, seed: int = 0
) -> DataFrame:
    grid = _grid(spark, [d1, d2, d3, d4])
    return grid.select(*IDS, hashed_integer(F.col("cell"), lo, hi, seed).alias("value"))
