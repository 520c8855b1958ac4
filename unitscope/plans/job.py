"""The whole job over folders: a data set on disk to reported units, every stage kept and resumed.

Below the output folder lie ``features`` (by ranges of images), ``thresholds``, ``tally`` and
``records``. A stage that is complete is read; feature extraction goes on with the
ranges of images that are missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.operators import rank, tally
from unitscope.operators.images import Model, extract_features
from unitscope.operators.quantile import THRESHOLD_QUANTILE
from unitscope.plans.dissection import block_thresholds
from unitscope.sources import images as files
from unitscope.sources import store
from unitscope.sources.dataset import ConceptData


@dataclass
class Report:
    features: DataFrame
    thresholds: DataFrame
    scores: DataFrame
    records: DataFrame
    rendered: DataFrame
    unreadable: DataFrame


def file_features(
    spark: SparkSession, images: DataFrame, folder: str, path: str, model: Model, side: tuple[int, int], names: str | None = "*.jpg", size: int = 4096, jobs: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Features of the image files that ``images`` (``img, image``) names below ``folder``, and the files not to be read.

    Files are decoded once, whatever the number of jobs, then resized, normalised and given to the model
    in one pass for the ranges of images that ``path`` does not hold yet.
    """
    stored = files.read_images(spark, folder, names)

    def fetch(part: DataFrame) -> DataFrame:
        return part.select("img", F.col("image").alias("file")).join(stored, "file")

    def compute(found: DataFrame) -> DataFrame:
        return extract_features(files.input_arrays(found, *side, key="img"), model, (3, *side))

    listed = images.select(F.col("img").cast("long").alias("img"), "image")
    lost = listed.join(stored.where(F.col("height") >= 0), F.col("image") == F.col("file"), "left_anti")
    return store.compute_in_ranges(listed, compute, path, size, jobs, fetch), lost


def analyse(
    spark: SparkSession,
    data: ConceptData,
    folder: str,
    path: str,
    model: Model,
    layer: str,
    side: tuple[int, int],
    q: float = THRESHOLD_QUANTILE,
    names: str | None = "*.jpg",
    size: int = 4096,
) -> Report:
    """Features, thresholds, tally, scores and report order of one layer, kept below ``path``."""
    features, lost = file_features(spark, data.images, folder, f"{path}/features", model, side, names, size)
    blocks = features.where(F.col("layer") == layer).select("img", "unit", "h", "w", "values")
    thresholds = store.load_or_compute(spark, f"{path}/thresholds", lambda: block_thresholds(blocks, q))
    sums = store.load_or_compute(
        spark, f"{path}/tally", lambda: tally.tally_sums(blocks, thresholds, data.images, data.channels, data.scalars, data.labelcat)
    )
    scores = tally.iou(sums, data.labelcat)
    categories = data.category_names()

    def records() -> DataFrame:
        best = tally.best_labels(scores, thresholds, sums, len(categories))
        kept = tally.tally_records(best, categories, data.names)
        order = tally.unit_order(tally.best_category(best).select("unit", "score"))
        return kept.join(order.select((F.col("unit") + 1).alias("unit"), "position"), "unit")

    found = store.load_or_compute(spark, f"{path}/records", records)
    return Report(features, thresholds, scores, found, rank.rendered_order(found), lost)
