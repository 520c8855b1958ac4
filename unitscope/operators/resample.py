"""Spatial resampling.

Every method is linear and separable, so it is two joins with a weight table
``(o, i, w)`` per axis. Upscaling by bilinear interpolation also has a block form
that works on whole maps without any join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitscope.operators import maps
from unitscope.operators.layout import BROADCAST_ROWS, spread

_WEIGHTS = T.StructType(
    [
        T.StructField("o", T.IntegerType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("w", T.DoubleType()),
    ]
)


class FieldMap:
    """Offset, size and step of a receptive field along y and x."""

    def __init__(self, offset: tuple[int, int], size: tuple[int, int], step: tuple[int, int]):
        self.offset, self.size, self.step = offset, size, step

    def centers(self, axis: int, count: int, reduction: int = 1) -> list[int]:
        first = self.size[axis] // 2 + self.offset[axis]
        stride = self.step[axis] // reduction
        return [first // reduction + a * stride for a in range(count)]

    def output_size(self, axis: int, count: int, reduction: int = 1) -> int:
        full = (count - 1) * self.step[axis] + self.size[axis] + 2 * self.offset[axis]
        return full // reduction


def _table(spark: SparkSession, rows: list[tuple[int, int, float]]) -> DataFrame:
    df = spark.createDataFrame(rows, _WEIGHTS)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def _from_dense(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    out, src = np.nonzero(matrix)
    return _table(spark, [(int(o), int(i), float(matrix[o, i])) for o, i in zip(out, src)])


def bilinear_weights(spark: SparkSession, n_in: int, n_out: int) -> DataFrame:
    """Half-pixel triangle filter; widened when shrinking; normalised at the edges."""
    scale = n_in / n_out
    reach = max(scale, 1.0)
    rows = []
    for o in range(n_out):
        center = (o + 0.5) * scale
        taps = np.arange(max(0, int(center - reach - 0.5)), min(n_in, int(center + reach + 1.5)))
        weights = np.maximum(0.0, 1.0 - np.abs(taps + 0.5 - center) / reach)
        weights /= weights.sum()
        rows += [(o, int(i), float(w)) for i, w in zip(taps, weights) if w > 0]
    return _table(spark, rows)


def linear_weights(
    spark: SparkSession, centers: list[int], n_out: int, span: int | None = None
) -> DataFrame:
    """Linear interpolation between unit centres, constant outside them.

    ``span`` stretches ``n_out`` sample points over that many pixels.
    """
    points = np.arange(n_out) * ((span or n_out) / n_out)
    weights = [np.interp(points, centers, unit) for unit in np.eye(len(centers))]
    return _from_dense(spark, np.stack(weights, axis=1))


def cubic_weights(spark: SparkSession, centers: list[int], n_out: int) -> DataFrame:
    """Cubic interpolating spline through unit centres (third derivative continuous at the
    second and last but one knot), constant outside the centres."""
    x = np.asarray(centers, dtype=float)
    n = len(x)
    if n < 4:
        raise ValueError("a cubic spline needs at least four centres")
    h = np.diff(x)
    system, slopes = np.zeros((n, n)), np.zeros((n, n))
    for k in range(1, n - 1):
        system[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        slopes[k, k - 1] = 6 / h[k - 1]
        slopes[k, k] = -6 / h[k - 1] - 6 / h[k]
        slopes[k, k + 1] = 6 / h[k]
    system[0, :3] = h[1], -(h[0] + h[1]), h[0]
    system[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    curvature = np.linalg.solve(system, slopes)
    points = np.clip(np.arange(n_out, dtype=float), x[0], x[-1])
    k = np.clip(np.searchsorted(x, points, side="right") - 1, 0, n - 2)
    left, right, width = points - x[k], x[k + 1] - points, h[k]
    unit = np.eye(n)
    weights = (
        (right / width)[:, None] * unit[k]
        + (left / width)[:, None] * unit[k + 1]
        + ((right**3 / width - right * width) / 6)[:, None] * curvature[k]
        + ((left**3 / width - left * width) / 6)[:, None] * curvature[k + 1]
    )
    return _from_dense(spark, weights)


def gaussian_weights(
    spark: SparkSession, centers: list[int], n_out: int, sigma: float, gain: float = 1.0
) -> DataFrame:
    """Blur of points placed at the centres; the kernel is cut at four sigma and nothing
    comes in from outside the grid."""
    radius = int(4.0 * sigma + 0.5)
    norm = sum(math.exp(-0.5 * (d / sigma) ** 2) if sigma else 1.0 for d in range(-radius, radius + 1))
    rows = []
    for i, c in enumerate(centers):
        if not 0 <= c < n_out:
            raise ValueError(f"centre {c} lies outside the grid of {n_out}")
        for o in range(max(0, c - radius), min(n_out, c + radius + 1)):
            kernel = math.exp(-0.5 * ((o - c) / sigma) ** 2) if sigma else 1.0
            rows.append((o, i, gain * kernel / norm))
    return _table(spark, rows)


#: Output pixels made in one go by a task that resamples cells (8 MB of doubles).
_PIXELS = 1 << 20


def _entries(weights: DataFrame) -> list[tuple[int, int, float]]:
    """The rows of a weight table, which is as large as a grid side, in a fixed order."""
    rows = weights.where("o is not null and i is not null and w is not null").select("o", "i", "w")
    return sorted((int(r["o"]), int(r["i"]), float(r["w"])) for r in rows.collect())


def gather_maps(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Maps ``(img, unit, values array<double>, held array<boolean>)``, row-major, of cells ``(img, unit, y, x, v)``.

    ``held`` tells which places have a cell; values of equal places are added, a place without a number is
    null. Cells beyond the grid are left out, and maps that have no others. The cells are shuffled and sorted
    by map once; a task then holds the maps of one Arrow batch, however many maps there are.
    """
    kind = T.StructType([
        cells.schema["img"], cells.schema["unit"],
        T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("held", T.ArrayType(T.BooleanType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return maps.gather(batches, height, width)

    place = [F.col(c).cast("long").alias(c) for c in ("y", "x")]
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    wanted = cells.select("img", "unit", *place, F.col("v").cast("double").alias("v")).where(inside)
    return spread(wanted, "img", "unit").sortWithinPartitions("img", "unit").mapInArrow(run, kind)


def _gathered(cells: DataFrame, wy: list, wx: list) -> DataFrame:
    return gather_maps(cells, *[max((i for _, i, _ in w), default=-1) + 1 for w in (wy, wx)])


def resample(cells: DataFrame, weights_y: DataFrame, weights_x: DataFrame) -> DataFrame:
    """``(img, unit, py, px, v)`` from ``(img, unit, y, x, v)``.

    The small input cells are shuffled by map once; both sums then run over the whole maps of
    an Arrow batch, so the much larger output is never moved, grouped or held.
    """
    wy, wx = _entries(weights_y), _entries(weights_x)
    gathered = _gathered(cells, wy, wx)
    new = [T.StructField("py", T.IntegerType()), T.StructField("px", T.IntegerType()), T.StructField("v", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from maps.weighted_rows(batch, wy, wx, _PIXELS)

    return gathered.mapInArrow(run, T.StructType([*gathered.schema.fields[:2], *new]))


def _weighted_maps(gathered: DataFrame, wy: list, wx: list, shape) -> DataFrame:
    """Resampled maps ``(img, unit, w, values)``; pixels without a number are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from maps.weighted_maps(batch, wy, wx, _PIXELS, tuple(shape))

    kind = [*gathered.schema.fields[:2], T.StructField("w", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))]
    return gathered.mapInArrow(run, T.StructType(kind))


def upsample_linear(cells, shape_in, fieldmap: FieldMap, reduction=1, shape=None, scaleshape=None):
    """Bilinear interpolation between the unit centres of a field map."""
    spark = cells.sparkSession
    shape = shape or [fieldmap.output_size(a, shape_in[a], reduction) for a in (0, 1)]
    out = scaleshape or shape
    tables = [
        linear_weights(spark, fieldmap.centers(a, shape_in[a], reduction), out[a], shape[a])
        for a in (0, 1)
    ]
    return resample(cells, *tables)


def upsample_cubic(cells, shape_in, fieldmap: FieldMap, shape=None) -> DataFrame:
    spark = cells.sparkSession
    shape = shape or [fieldmap.output_size(a, shape_in[a]) for a in (0, 1)]
    tables = [cubic_weights(spark, fieldmap.centers(a, shape_in[a]), shape[a]) for a in (0, 1)]
    return resample(cells, *tables)


def upsample_gaussian(cells, shape_in, fieldmap: FieldMap, shape=None) -> DataFrame:
    """Activations spread from the unit centres, scaled by the area of a step."""
    spark = cells.sparkSession
    shape = shape or [fieldmap.output_size(a, shape_in[a]) for a in (0, 1)]
    tables = [
        gaussian_weights(
            spark,
            fieldmap.centers(a, shape_in[a]),
            shape[a],
            sigma=fieldmap.step[a] // 1.414,
            gain=fieldmap.step[a],
        )
        for a in (0, 1)
    ]
    return resample(cells, *tables)


def blur_masks(
    cells: DataFrame,
    shape_in,
    fieldmap: FieldMap,
    image_shape,
    sigma: float = 0.1,
    threshold: float = 0.5,
    percentile: float | None = None,
) -> DataFrame:
    """Pixels of blurred activations over a share of the overall maximum, or over a
    percentile (0..100) of all blurred values."""
    from unitscope.operators.quantile import percentiles
    from unitscope.session import cut

    spark = cells.sparkSession
    tables = [
        gaussian_weights(
            spark, fieldmap.centers(a, shape_in[a]), image_shape[a], fieldmap.size[a] * sigma
        )
        for a in (0, 1)
    ]
    wy, wx = map(_entries, tables)
    # the maps as they come are kept, their many pixels are made where they are counted
    kept = cut(_gathered(cells, wy, wx))
    blurred = _weighted_maps(kept, wy, wx, image_shape)
    if percentile is None:
        limit = blurred.select(F.explode("values").alias("v")).agg(F.max("v") * threshold).scalar()
    else:
        # pixels beyond the reach of every kernel hold 0, and so do maps without a number of their own
        named = F.col("img").isNotNull() & F.col("unit").isNotNull()
        zero = F.transform("values", lambda v: F.coalesce(F.when(named, v), F.lit(0.0)))
        blurred = blurred.withColumn("values", zero)
        found = percentiles(blurred.select(F.lit(1).alias("_all"), F.explode("values").alias("v")), ["_all"], "v", [percentile / 100])
        limit = found.select("quantile").scalar()
    rows = blocks_to_cells(blurred).select("img", "unit", F.col("y").alias("py"), F.col("x").alias("px"), "v")
    return rows.where(F.col("v") > limit)


def pixel_rows(
    blocks: DataFrame, height: int | str, width: int | str, keep: list[str], over: str | None = None
) -> DataFrame:
    """Columns ``keep`` and the pixels ``(py, px, v)`` of every map ``(h, w, values)`` resized bilinearly.

    Sizes are numbers, or names of columns holding the size wanted for the row. With ``over``,
    only pixels over the number in that column are returned. Nothing is shuffled.
    """
    sizes = [F.lit(s) if isinstance(s, int) else F.col(s) for s in (height, width)]
    limit = [F.col(over).cast("double").alias("_limit")] if over else []
    asked = blocks.select(
        *keep, F.col("h").cast("int"), F.col("w").cast("int"), F.col("values").cast("array<double>"),
        *[s.cast("int").alias(n) for s, n in zip(sizes, ("_height", "_width"))], *limit,
    )
    kind = T.StructType([*asked.select(*keep).schema.fields, T.StructField("py", T.IntegerType()), T.StructField("px", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = [batch.column(c).to_numpy().astype(np.int64) for c in ("_height", "_width")]
                most = batch.column("_limit").to_numpy(zero_copy_only=False) if over else None
                yield from maps.pixel_rows(batch, *at, most, keep)

    return asked.mapInArrow(run, kind)


def enlarge_blocks(blocks: DataFrame, height: int | str, width: int | str) -> DataFrame:
    """Bilinear enlargement of whole maps to pixel rows ``(…, py, px, v)``."""
    return pixel_rows(blocks, height, width, [c for c in blocks.columns if c not in ("h", "w", "values")])


def cells_to_blocks(cells: DataFrame) -> DataFrame:
    """Whole maps ``(img, unit, h, w, values)``, row-major, from cells."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return cells.groupBy("img", "unit").agg(
        (F.max("y") + 1).cast("int").alias("h"),
        (F.max("x") + 1).cast("int").alias("w"),
        F.transform(ordered, lambda c: c["v"]).alias("values"),
    )


def blocks_to_cells(blocks: DataFrame) -> DataFrame:
    return blocks.select("img", "unit", "w", F.posexplode("values").alias("_p", "v")).select(
        "img",
        "unit",
        F.floor(F.col("_p") / F.col("w")).cast("int").alias("y"),
        (F.col("_p") % F.col("w")).cast("int").alias("x"),
        "v",
    )


def field_rectangle(cells: DataFrame, fieldmap: FieldMap) -> DataFrame:
    """Image rectangle and centre of every unit position."""
    (oy, ox), (sy, sx), (ty, tx) = fieldmap.offset, fieldmap.size, fieldmap.step
    return (
        cells.withColumn("y0", F.col("y") * ty + oy)
        .withColumn("x0", F.col("x") * tx + ox)
        .withColumn("rh", F.lit(sy))
        .withColumn("rw", F.lit(sx))
        .withColumn("cy", F.col("y0") + sy // 2)
        .withColumn("cx", F.col("x0") + sx // 2)
    )


def crop_rectangles(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """Pixels ``(img, ch, y, x, v)`` inside each rectangle ``(img, rect, y0, x0, rh, rw)``.

    Rows are ``(img, rect, ch, cy, cx, v)``; what lies beyond the border is 0. The
    rectangles are expanded to their pixels, so the join is an equi join on the pixel.
    """
    channels = pixels.groupBy("img").agg(F.max("ch").alias("_chs"))
    grid = (
        rects.join(channels, "img")
        .withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("_chs").cast("int"))))
        .withColumn("cy", F.explode(F.sequence(F.lit(0), (F.col("rh") - 1).cast("int"))))
        .withColumn("cx", F.explode(F.sequence(F.lit(0), (F.col("rw") - 1).cast("int"))))
        .withColumn("y", (F.col("y0") + F.col("cy")).cast("int"))
        .withColumn("x", (F.col("x0") + F.col("cx")).cast("int"))
    )
    source = pixels.select(
        "img", F.col("ch").cast("int"), F.col("y").cast("int"), F.col("x").cast("int"), "v"
    )
    return grid.join(source, ["img", "ch", "y", "x"], "left").select(
        "img", "rect", "ch", "cy", "cx", F.coalesce("v", F.lit(0.0)).alias("v")
    )


def center_grid(shapes: DataFrame, fieldmap: FieldMap, reduction: int = 1) -> DataFrame:
    """Centres ``(…, y, x, cy, cx)`` of all positions of layers ``(…, h, w)``."""
    firsts = [(fieldmap.size[a] // 2 + fieldmap.offset[a]) // reduction for a in (0, 1)]
    strides = [fieldmap.step[a] // reduction for a in (0, 1)]
    return (
        shapes.withColumn("y", F.explode(F.sequence(F.lit(0), (F.col("h") - 1).cast("int"))))
        .withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("w") - 1).cast("int"))))
        .withColumn("cy", F.lit(firsts[0]) + F.col("y") * strides[0])
        .withColumn("cx", F.lit(firsts[1]) + F.col("x") * strides[1])
        .drop("h", "w")
    )
