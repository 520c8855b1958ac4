"""From feature maps and labels to unit records, and from records to responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitscope.operators import activation, tally
from unitscope.operators.quantile import THRESHOLD_QUANTILE, exact_quantiles
from unitscope.session import cut


@dataclass
class Dissection:
    """Results of one layer; every member is a lazy DataFrame over stored sums."""

    thresholds: DataFrame
    sums: DataFrame
    scores: DataFrame
    best: DataFrame
    records: DataFrame


def block_thresholds(blocks: DataFrame, q: float = THRESHOLD_QUANTILE) -> DataFrame:
    """Unit thresholds straight from whole maps."""
    values = blocks.select("unit", F.explode("values").alias("v"))
    return exact_quantiles(values, ["unit"], "v", [q]).select(
        "unit", F.col("quantile").alias("thresh")
    )


def dissect(
    blocks: DataFrame,
    images: DataFrame,
    channels: DataFrame,
    scalars: DataFrame,
    labelcat: DataFrame,
    categories: list[str],
    names: DataFrame,
    q: float = THRESHOLD_QUANTILE,
) -> Dissection:
    """Thresholds, tally, scores, best labels and records of one layer.

    Thresholds and the tally are checkpointed: both are tiny next to the feature maps and
    everything later reads them.
    """
    thresholds = cut(block_thresholds(blocks, q))
    sums = cut(tally.tally_sums(blocks, thresholds, images, channels, scalars, labelcat))
    scores = tally.iou(sums, labelcat)
    best = tally.best_labels(scores, thresholds, sums, len(categories))
    records = tally.tally_records(best, categories, names)
    return Dissection(thresholds, sums, scores, best, records)


def respond(
    blocks: DataFrame,
    thresholds: DataFrame,
    records: DataFrame,
    predictions: DataFrame,
    height: int = activation.IMAGE_SIDE,
    width: int = activation.IMAGE_SIDE,
) -> DataFrame:
    """Rates and weighted features of correctly classified images.

    ``records`` count units from 1, maps from 0.
    """
    right = predictions.where(F.col("predicted") == F.col("label")).select("img")
    rates = activation.activation_rates(
        blocks.join(right, "img", "left_semi"), thresholds, height, width
    )
    zero_based = records.withColumn("unit", F.col("unit") - 1)
    return activation.weighted_features(rates, zero_based)
