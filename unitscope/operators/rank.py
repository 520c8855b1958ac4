"""Rankings and report aggregates over tally records ``(unit, category, label, score)``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitscope.functions import display_name
from unitscope.operators.layout import bounded, global_index, top_per_group
from unitscope.operators.maps import count_over
from unitscope.operators.reduce import mode_earliest
from unitscope.session import cut

#: Lowest score shown, images shown per unit, order of the categories.
SCORE_THRESHOLD = 0.04
TOP_IMAGES = 10
CATEGORY_ORDER = ["object", "scene", "part", "material", "texture", "color"]


def top_images(maxima: DataFrame, n: int = TOP_IMAGES) -> DataFrame:
    """The ``n`` images with the largest maximum per unit; ties by image."""
    return top_per_group(maxima, ["unit"], [F.desc("max_v"), F.asc("img")], n, "rank")


def label_histogram(records: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Units per label, best score and most common category among records over a score.

    Categories tie by the earliest record; ``position`` is the order of the records.
    """
    kept = records.where(F.col("score") >= threshold)
    counts = kept.groupBy("label").agg(
        F.count("*").alias("n_units"), F.max("score").alias("best_score")
    )
    modes = mode_earliest(kept, ["label"], "category", "position")
    return counts.join(modes.withColumnRenamed("mode", "category"), "label")


def _category_rank(histogram: DataFrame, order: list[str]) -> DataFrame:
    """Position of every category: the given order, then others as their labels come up."""
    known = F.array(*[F.lit(c) for c in order])
    at = F.array_position(known, F.col("category"))
    keyed = histogram.groupBy("category").agg(F.max(F.struct("n_units", "best_score")).alias("_top")).select(
        "category",
        F.when(at > 0, at).otherwise(F.lit(len(order) + 1)).alias("_at"),
        F.when(at > 0, F.lit(0)).otherwise(-F.col("_top.n_units")).alias("_n"),
        F.when(at > 0, F.lit(0.0)).otherwise(-F.col("_top.best_score")).alias("_s"),
    )
    ranked = global_index(keyed, ["_at", "_n", "_s", "category"], "cat_pos")
    return ranked.select("category", F.col("cat_pos").cast("int").alias("cat_pos"))


def label_order(histogram: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Labels by category order, then number of units and best score, both descending."""
    histogram = cut(histogram)
    ranks = _category_rank(histogram, order or CATEGORY_ORDER)
    keyed = histogram.join(bounded(ranks), "category")
    by = [F.asc("cat_pos"), F.desc("n_units"), F.desc("best_score"), F.asc("label")]
    return global_index(keyed, by, "label_pos")


def category_totals(histogram: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Labels of every category; known ones without a label count 0."""
    known = histogram.sparkSession.createDataFrame([(c,) for c in order or CATEGORY_ORDER], "category string")
    rows = histogram.select("category", F.lit(1).alias("_n")).unionByName(known.withColumn("_n", F.lit(0)))
    return rows.groupBy("category").agg(F.sum("_n").alias("n_labels"))


def rendered_order(
    records: DataFrame, threshold: float = SCORE_THRESHOLD, order: list[str] | None = None
) -> DataFrame:
    """Records in report order as ``rendered_pos``; those under the score come last.

    Equal keys keep the order of ``position``.
    """
    histogram = cut(label_histogram(records, threshold))
    ranks = _category_rank(histogram, order or CATEGORY_ORDER)
    lookup = histogram.join(bounded(ranks), "category").select(
        "label", "cat_pos", "n_units", "best_score"
    )
    high = F.col("score") >= threshold
    keyed = records.join(bounded(lookup), "label", "left").select(
        *records.columns,
        F.when(high, 0).otherwise(1).alias("_low"),
        F.when(high, F.col("cat_pos")).otherwise(0).alias("_cat"),
        F.when(high, -F.col("n_units")).otherwise(0).alias("_n"),
        F.when(high, -F.col("best_score")).otherwise(0.0).alias("_best"),
    )
    by = ["_low", "_cat", "_n", "_best", F.desc("score"), F.asc("position")]
    return global_index(keyed, by, "rendered_pos").drop("_low", "_cat", "_n", "_best")


def coverage_summary(records: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    high = F.col("score") >= threshold
    return records.agg(
        F.count_if(high).alias("units_over"),
        F.count("*").alias("units"),
        F.count_distinct(F.when(high, F.col("label"))).alias("concepts"),
    )


def score_rank(records: DataFrame) -> DataFrame:
    """0-based rank by score; ties keep the rendered order."""
    return global_index(records, [F.desc("score"), F.asc("rendered_pos")], "score_order")


def limit_records(rendered: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` records of the report."""
    return rendered.where(F.col("rendered_pos") < limit)


def show_names(records: DataFrame) -> DataFrame:
    return records.withColumn("display", display_name(F.col("label")))


def top_image_areas(
    top: DataFrame, blocks: DataFrame, thresholds: DataFrame, height: int, width: int
) -> DataFrame:
    """Mask pixels at image size for every listed ``(unit, img)``; 0 without any."""
    picked = blocks.join(top.select("unit", "img", "rank"), ["unit", "img"])
    return map_areas(picked, thresholds, height, width, keep=["rank"])


def map_areas(
    blocks: DataFrame, thresholds: DataFrame, height: int, width: int, keep: list[str] = ()
) -> DataFrame:
    """Mask pixels ``(img, unit, …, area)`` of every map enlarged to a fixed size.

    Maps that cannot reach the threshold are not enlarged; they yield a single row that
    counts 0.
    """
    # a map with NaN has no mask
    limit = F.when(F.isnan(F.array_max("values")), F.lit(float("inf"))).otherwise(F.col("thresh").cast("double"))
    joined = blocks.join(bounded(thresholds.select("unit", "thresh")), "unit").select(
        "img", "unit", *keep, F.col("h").cast("int"), F.col("w").cast("int"), F.col("values").cast("array<double>"), limit.alias("thresh")
    )
    kind = T.StructType([*joined.select("img", "unit", *keep).schema.fields, T.StructField("area", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = batch.column("thresh").to_numpy(zero_copy_only=False)
            area = pa.array(count_over(limit, batch, height, width))
            names = ["img", "unit", *keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), area], names=[*names, "area"])

    return joined.mapInArrow(run, kind)


def flag_low(records: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    return records.withColumn("low_score", F.col("score") < threshold)
