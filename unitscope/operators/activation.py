"""How strongly, and with what meaning, the units respond on a second set of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitscope.functions import location_name
from unitscope.operators.layout import bounded, top_per_group
from unitscope.operators.rank import map_areas

IMAGE_SIDE = 224
TOP_UNITS = 20


def activation_rates(
    blocks: DataFrame, thresholds: DataFrame, height: int = IMAGE_SIDE, width: int = IMAGE_SIDE
) -> DataFrame:
    """Share of pixels over the threshold per map, 0 included."""
    areas = map_areas(blocks, thresholds, height, width)
    return areas.select("img", "unit", (F.col("area") / (height * width)).alias("rate"))


def correct_only(rates: DataFrame, predictions: DataFrame) -> DataFrame:
    """Keep images whose predicted class is the true one."""
    right = predictions.where(F.col("predicted") == F.col("label"))
    return rates.join(right.select("img"), "img", "left_semi")


def ranked_units(rates: DataFrame, records: DataFrame) -> DataFrame:
    """Units of every image by rate, then score, with their concept. ``unit`` is 0-based."""
    info = records.select("unit", "label", "category", "score")
    joined = rates.join(bounded(info), "unit")
    # a group holds one row per unit of the network, whatever the number of images
    order = [F.desc("rate"), F.desc("score"), F.asc("unit")]
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy("img").orderBy(*order)))


def weighted_features(rates: DataFrame, records: DataFrame) -> DataFrame:
    """Score times rate per image and unit."""
    info = records.select("unit", "label", "score")
    return rates.join(bounded(info), "unit").select(
        "img", "unit", "label", "rate", (F.col("score") * F.col("rate")).alias("feature")
    )


def unit_label_vector(records: DataFrame) -> DataFrame:
    """All unit labels in unit order, in one row."""
    listed = F.array_sort(F.collect_list(F.struct("unit", "label")))
    return records.agg(F.transform(listed, lambda r: r["label"]).alias("labels"))


def select_classes(items: DataFrame, classes: list[str], cls: str = "class") -> DataFrame:
    return items.where(F.col(cls).isin(classes))


def feature_details(features: DataFrame, image_classes: DataFrame) -> DataFrame:
    """Positive features of an image by unit label, plus its class at 100, as
    ``details array<struct<value, name>>``, largest first.

    Units sharing a label overwrite each other, the last unit wins; a label called like
    the class is overwritten by the class.
    """
    positive = features.where(F.col("feature") > 0)
    by_name = positive.groupBy("img", F.col("label").alias("name")).agg(
        F.max_by("feature", "unit").alias("value")
    )
    own = image_classes.select("img", F.col("class").alias("name"), F.lit(100.0).alias("value"))
    named = by_name.join(image_classes.select("img"), "img", "left_semi")
    merged = named.unionByName(own).groupBy("img", "name").agg(F.max("value").alias("value"))
    entry = F.struct((-F.col("value")).alias("neg"), F.col("name"))
    return merged.groupBy("img").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct((-e["neg"]).alias("value"), e["name"].alias("name")),
        ).alias("details")
    )


def class_samples(rates: DataFrame, images: DataFrame, predictions: DataFrame, classes: list[str]) -> DataFrame:
    """Rates ``(img, image, class, unit, rate)`` of correctly classified images of the
    chosen classes."""
    chosen = select_classes(images, classes).select("img", "image", "class")
    return correct_only(rates, predictions).join(chosen, "img")


def strongest_units(
    blocks: DataFrame,
    thresholds: DataFrame,
    height: int = IMAGE_SIDE,
    width: int = IMAGE_SIDE,
    n: int = TOP_UNITS,
    rate_area: int = IMAGE_SIDE * IMAGE_SIDE,
) -> DataFrame:
    """The ``n`` units with the largest masks per image; the rate is taken over
    ``rate_area`` pixels whatever the size of the image."""
    areas = map_areas(blocks, thresholds, height, width)
    top = top_per_group(areas, ["img"], [F.desc("area"), F.asc("unit")], n, "rank")
    return top.withColumn("rate", F.col("area") / rate_area)


def location_names(strongest: DataFrame, images: DataFrame, records: DataFrame) -> DataFrame:
    """File name for every strongest unit of an image."""
    named = strongest.join(images.select("img", "image"), "img").join(
        bounded(records.select("unit", "label")), "unit"
    )
    name: Column = location_name(F.col("image"), F.col("rate"), F.col("label"), F.col("unit"))
    return named.select("img", "unit", "rank", name.alias("name"))


def rate_tree(features: DataFrame, units: list[int], max_depth: int = 4, min_leaf: int = 10):
    """Decision tree (Gini) on wide unit features ``(img, cls, unit_<n>…)``.

    A leaf of ten rows already implies a split of at least twenty. Returns the assembler of
    the unit columns, in the order given, and the fitted tree.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=[f"unit_{u}" for u in units], outputCol="features")
    tree = DecisionTreeClassifier(
        labelCol="cls",
        featuresCol="features",
        impurity="gini",
        maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
        seed=1,
    )
    return assembler, tree.fit(assembler.transform(features))


def location_highlight(strongest, blocks, pixels, height: int, width: int) -> DataFrame:
    """Image pixels scaled by the enlarged activation of each strongest unit."""
    from unitscope.operators.images import highlight
    from unitscope.operators.resample import enlarge_blocks

    picked = blocks.join(strongest.select("img", "unit"), ["img", "unit"])
    grown = enlarge_blocks(picked, height, width)
    return highlight(pixels, grown.withColumnRenamed("v", "mask"))
