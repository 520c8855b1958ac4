"""Image jobs on pixel rows ``(img, ch, y, x, v)``, ch 0..2 = R, G, B."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitscope.operators.resample import bilinear_weights, resample

#: Mean of blue, green and red, and the scale of the network input.
BGR_MEAN = [109.5388, 118.6897, 124.6901]
INPUT_SCALE = 255.0 * 0.224


def grey_to_rgb(pixels: DataFrame) -> DataFrame:
    """Repeat the single channel of grey images three times."""
    return pixels.drop("ch").withColumn("ch", F.explode(F.array(*[F.lit(c) for c in range(3)])))


def normalise(pixels: DataFrame, bgr_mean: list[float] = BGR_MEAN) -> DataFrame:
    """Network input per RGB pixel: minus the channel mean, over the input scale."""
    means = F.array(*[F.lit(m) for m in reversed(bgr_mean)])
    value = (F.col("v") - F.get(means, F.col("ch").cast("int"))) / F.lit(INPUT_SCALE)
    return pixels.withColumn("v", value)


def resize(pixels: DataFrame, shape_in: tuple[int, int], shape_out: tuple[int, int]) -> DataFrame:
    """Bilinear resize of every channel, rounded to bytes.

    Sums are rounded to nine places first, so the order of addition cannot tip a half.
    """
    spark = pixels.sparkSession
    wy = bilinear_weights(spark, shape_in[0], shape_out[0])
    wx = bilinear_weights(spark, shape_in[1], shape_out[1])
    out = resample(pixels.withColumnRenamed("ch", "unit"), wy, wx)
    byte = F.least(F.greatest(F.floor(F.round("v", 9) + F.lit(0.5)), F.lit(0)), F.lit(255))
    return out.select(
        "img",
        F.col("unit").alias("ch"),
        F.col("py").alias("y"),
        F.col("px").alias("x"),
        byte.cast("int").alias("v"),
    )


def highlight(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """``(mask · 0.8 + 0.2) · image`` for every unit mask ``(img, unit, py, px, mask)``."""
    mask = mask.select(
        "img", "unit", F.col("py").cast("int").alias("y"), F.col("px").cast("int").alias("x"), "mask"
    )
    source = pixels.select(
        "img", "ch", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v"
    )
    shown = (F.col("mask") * F.lit(0.8) + F.lit(0.2)) * F.col("v")
    return mask.join(source, ["img", "y", "x"]).select(
        "img", "unit", "ch", "y", "x", shown.alias("v")
    )


Model = Callable[[np.ndarray], dict[str, np.ndarray]]

_FEATURES = "img long, layer string, unit int, h int, w int, values array<double>, max_v double"


def extract_features(images: DataFrame, model: Model, shape: tuple[int, int, int]) -> DataFrame:
    """Run ``model`` on batches of images ``(img, values array<double>)`` of one shape.

    The model maps a batch ``(n, ch, y, x)`` to named layer outputs ``(n, units, h, w)``,
    ``(n, units, h)`` or ``(n, units)``. The result has one row per image, layer and unit:
    the map and its maximum. Batches are Arrow batches, so memory does not grow with the
    table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("img").to_numpy(zero_copy_only=False)
            stacked = batch.column("values").flatten().to_numpy(zero_copy_only=False)
            for layer, out in model(stacked.reshape(-1, *shape).copy()).items():
                out = np.asarray(out, dtype=float)
                n, units = out.shape[:2]
                h, w = (list(out.shape[2:]) + [1, 1])[:2]
                flat = out.reshape(n * units, h * w)
                ends = np.arange(0, (n * units + 1) * h * w, h * w, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids, units)),
                        pa.array([layer] * (n * units)),
                        pa.array(np.tile(np.arange(units, dtype=np.int32), n)),
                        pa.array(np.full(n * units, h, np.int32)),
                        pa.array(np.full(n * units, w, np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel())),
                        pa.array(flat.max(axis=1)),
                    ],
                    names=["img", "layer", "unit", "h", "w", "values", "max_v"],
                )

    return images.select("img", "values").mapInArrow(run, _FEATURES)


def split_invalid(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maps without, and images with, a NaN in any map."""
    bad = features.where(F.exists("values", F.isnan)).select("img").distinct()
    return features.join(bad, "img", "left_anti"), bad


def extract_guarded(
    images: DataFrame, model: Model, shape: tuple[int, int, int], retry: Model | None = None
) -> tuple[DataFrame, DataFrame]:
    """Extract, run images with NaN outputs once more, and report those still invalid.

    Returns ``(features, still invalid images)``.
    """
    from unitscope.session import cut

    first = cut(extract_features(images, model, shape))
    good, bad = split_invalid(first)
    again = cut(extract_features(images.join(bad, "img", "left_semi"), retry or model, shape))
    recovered, failed = split_invalid(again)
    return good.unionByName(recovered), failed
