"""Shape, index and slicing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitscope.schema import ABSENT, IDS


def shape(mat: DataFrame) -> DataFrame:
    """One row ``n_1..n_4`` with the size of every axis; 0 for an absent axis."""
    return mat.agg(
        *[F.coalesce(F.max(c) + 1, F.lit(0)).alias(f"n_{i}") for i, c in enumerate(IDS, 1)]
    )


def shape_values(mat: DataFrame) -> list[int]:
    return list(shape(mat).first())


def reverse(mat: DataFrame, axis: int, size: int | None = None) -> DataFrame:
    """Flip axis 0..3. The size is found by a scalar subquery unless it is given."""
    if axis not in range(4):
        raise ValueError(f"axis must be 0..3, not {axis}")
    name = IDS[axis]
    length = F.lit(size) if size is not None else mat.agg(F.max(name) + 1).scalar()
    flipped = F.when(F.col(name) == ABSENT, F.col(name)).otherwise(length - 1 - F.col(name))
    return mat.select(*[flipped.alias(c) if c == name else F.col(c) for c in IDS], "value")


def transpose(mat: DataFrame, axes: list[int] | None = None) -> DataFrame:
    """New axis ``i`` is old axis ``axes[i]``; None reverses the axes."""
    axes = list(reversed(range(4))) if axes is None else list(axes)
    if sorted(axes) != [0, 1, 2, 3]:
        raise ValueError(f"axes must be a permutation of 0..3, not {axes}")
    return mat.select(*[F.col(IDS[a]).alias(IDS[i]) for i, a in enumerate(axes)], "value")


def channel_rows(cells: DataFrame, height: int, width: int) -> DataFrame:
    """One value column per channel, kept long: row number of ``(img, y, x)`` and the unit."""
    row = (F.col("img") * height + F.col("y")) * width + F.col("x")
    return cells.select(row.alias("row_id"), "unit", "v")


def slice_images(df: DataFrame, start: int, end: int, img: str = "img") -> DataFrame:
    """Images ``start`` (included) to ``end`` (excluded)."""
    return df.where((F.col(img) >= start) & (F.col(img) < end))


def first_images(mat: DataFrame, size: int) -> DataFrame:
    return mat.where(F.col("id_1") < size)


def one_hot(df: DataFrame, column: str, minlength: int | None = None) -> DataFrame:
    """Expand an integer column to rows ``(…, pos, hot)`` of length ``max + 1`` or more."""
    length = df.agg(F.max(column) + 1).scalar()
    if minlength is not None:
        length = F.greatest(length, F.lit(minlength))
    positions = F.sequence(F.lit(0), (length - 1).cast("int"))
    return df.withColumn("pos", F.explode(positions)).withColumn(
        "hot", F.when(F.col("pos") == F.col(column), 1.0).otherwise(0.0)
    )
