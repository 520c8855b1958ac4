"""Which concepts a unit responds to: tallies and intersection over union.

Inputs::

    blocks      img, unit, h, w, values array<double>
    thresholds  unit, thresh
    images      img, sh, sw
    channels    img, channel, labels array<int>    label map of sh × sw, row-major
    scalars     img, label                         image-level labels
    labelcat    label, cat_idx                     primary category of a label

The whole tally is one long table of sums ``(unit, kind, key, amount)``, so tallies of
disjoint sets of images merge by addition:

    unit   key 0        pixels under the masks of the unit
    both   key label    pixels of the label under the masks
    cat    key cat_idx  mask pixels on images where the category shows under the mask
    label  key label    pixels of the label anywhere (unit -1)
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from unitscope.operators.layout import bounded, global_index, spread
from unitscope.operators.maps import labels_under
from unitscope.operators.resample import pixel_rows

#: Stands for "any pixel under the mask" next to the real labels.
_ANY = -1
EPSILON = 1e-10


def image_label_area(scalars: DataFrame, images: DataFrame) -> DataFrame:
    """Every image-level label covers its whole image, once per occurrence."""
    return (
        scalars.join(images.select("img", "sh", "sw"), "img")
        .groupBy("label")
        .agg(F.sum((F.col("sh") * F.col("sw")).cast("long")).alias("area"))
    )


def pixel_label_area(channels: DataFrame) -> DataFrame:
    """Pixels per label over all channels, label 0 left out."""
    return (
        channels.select(F.explode("labels").alias("label"))
        .where(F.col("label") > 0)
        .groupBy("label")
        .agg(F.count("*").alias("area"))
    )


def gate(blocks: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Maps whose maximum is over the threshold of the unit.

    Interpolation never exceeds its inputs, so the others cannot have a mask; they are
    dropped before anything is enlarged or shuffled.
    """
    peak = F.array_max("values")
    return blocks.join(bounded(thresholds.select("unit", "thresh")), "unit").where(
        (peak > F.col("thresh")) & ~F.isnan(peak)
    )


def activation_mask(blocks: DataFrame, thresholds: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels ``(img, unit, py, px, v)`` of the enlarged maps over the threshold."""
    sized = spread(gate(blocks, thresholds), "img").join(images.select("img", "sh", "sw"), "img")
    return pixel_rows(sized, "sh", "sw", ["img", "unit"], over="thresh")


#: Images whose maps and label maps a task holds at a time.
IMAGES = 32


def mask_labels(
    blocks: DataFrame,
    thresholds: DataFrame,
    images: DataFrame,
    channels: DataFrame,
    scalars: DataFrame,
) -> DataFrame:
    """Per activated map ``(img, unit, area, hits array<struct<label, amount>>)``.

    Maps on one side and sizes, label maps and image labels on the other are shuffled once,
    to groups of ``IMAGES`` images; a task enlarges the maps of a group, holds them against
    the thresholds and counts the labels under the masks. Only counts leave it. Image-level
    labels without a number do not count; a map of an image without a size is left out.
    """
    groups = max(1, -(-images.count() // IMAGES))
    group = F.pmod(F.xxhash64(F.col("img")), F.lit(groups)).alias("_group")
    none = F.lit(None)
    opened = gate(blocks, thresholds).select(
        group, "img", "unit", F.col("h").cast("int"), F.col("w").cast("int"), "values", F.col("thresh").cast("double")
    )

    def facts(df: DataFrame, channel, labels, height=none, width=none) -> DataFrame:
        return df.select(
            group,
            "img",
            channel.cast("int").alias("channel"),
            height.cast("int").alias("sh"),
            width.cast("int").alias("sw"),
            labels.cast("array<int>").alias("labels"),
        )

    sizes = facts(images, F.lit(-1), none, F.col("sh"), F.col("sw"))
    maps = facts(channels, F.col("channel"), F.col("labels"))
    whole = facts(scalars, F.lit(-2), F.array("label"))
    told = sizes.unionByName(maps).unionByName(whole)
    kind = T.StructType(
        [
            images.schema["img"],
            blocks.schema["unit"],
            T.StructField("area", T.LongType()),
            T.StructField("hits", T.ArrayType(T.StructType([T.StructField("label", T.IntegerType()), T.StructField("amount", T.LongType())]))),
        ]
    )
    arrow = to_arrow_schema(kind)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return labels_under(left, right, arrow) if left.num_rows and right.num_rows else arrow.empty_table()

    # fresh columns: both sides may come from one table
    sides = [spread(df.toDF(*df.columns), "_group").groupBy("_group") for df in (opened, told)]
    return sides[0].cogroup(sides[1]).applyInArrow(work, kind)


def unit_area(hits: DataFrame) -> DataFrame:
    return hits.groupBy("unit").agg(F.sum("area").alias("area"))


def unit_label_pixels(hits: DataFrame) -> DataFrame:
    """Pixels of every label under the masks of a unit; image-level labels add the mask."""
    flat = hits.select("unit", F.inline("hits"))
    return flat.groupBy("unit", "label").agg(F.sum("amount").alias("both"))


def unit_category_area(hits: DataFrame, labelcat: DataFrame) -> DataFrame:
    """Mask pixels of a unit, counted once for every category showing under the mask."""
    shown = hits.select("img", "unit", "area", F.inline("hits")).where(F.col("amount") > 0)
    return (
        shown.join(bounded(labelcat), "label")
        .groupBy("img", "unit", "cat_idx")
        .agg(F.max("area").alias("area"))
        .groupBy("unit", "cat_idx")
        .agg(F.sum("area").alias("area"))
    )


def tally_sums(
    blocks: DataFrame,
    thresholds: DataFrame,
    images: DataFrame,
    channels: DataFrame,
    scalars: DataFrame,
    labelcat: DataFrame,
) -> DataFrame:
    """The mergeable tally ``(unit, kind, key, amount)`` of a set of images, in one pass."""
    hits = mask_labels(blocks, thresholds, images, channels, scalars)
    entry = F.struct(F.lit(_ANY).alias("label"), F.col("area").alias("amount"))
    flat = hits.select("img", "unit", "area", F.inline(F.concat(F.array(entry), "hits")))
    shown = flat.join(bounded(labelcat.select("label", "cat_idx")), "label", "left").withColumn(
        "cat_idx", F.when(F.col("label") == _ANY, _ANY).otherwise(F.col("cat_idx"))
    )
    # one row per category under a mask: its area counts once, its labels one by one
    by_cat = shown.groupBy("img", "unit", "cat_idx").agg(
        F.max("area").alias("area"), F.collect_list(F.struct("label", "amount")).alias("_found")
    )

    def row(kind, key, amount):
        return F.struct(
            F.lit(kind).alias("kind"), key.cast("int").alias("key"), amount.alias("amount")
        )

    cat, area = F.col("cat_idx"), F.col("area")
    labels = F.transform("_found", lambda f: row("both", f["label"], f["amount"]))
    # image-level labels of a map without any pixel over the threshold bring no area
    categories = F.when(cat.isNotNull(), F.array(row("cat", cat, area)))
    rows = F.when(cat == _ANY, F.array(row("unit", F.lit(0), area))).otherwise(
        F.coalesce(F.concat(categories, labels), labels)
    )
    per_unit = by_cat.select("unit", F.inline(rows))
    areas = image_label_area(scalars, images).unionAll(pixel_label_area(channels))
    per_label = areas.select(
        F.lit(_ANY).alias("unit"),
        F.lit("label").alias("kind"),
        F.col("label").cast("int").alias("key"),
        F.col("area").alias("amount"),
    )
    return merge_tallies(per_unit, per_label)


def merge_tallies(*parts: DataFrame) -> DataFrame:
    """Sum tallies of disjoint sets of images."""
    together = reduce(lambda a, b: a.unionByName(b), parts)
    return together.groupBy("unit", "kind", "key").agg(F.sum("amount").alias("amount"))


def _kind(sums: DataFrame, kind: str, key: str, amount: str) -> DataFrame:
    cols = [F.col("key").alias(key), F.col("amount").alias(amount)]
    rows = sums.where(F.col("kind") == kind)
    return rows.select(*cols) if kind == "label" else rows.select("unit", *cols)


def iou(sums: DataFrame, labelcat: DataFrame) -> DataFrame:
    """``(unit, label, cat_idx, both, activation, truth, iou)`` where unit and label meet.

    ``activation`` is the unit's area in the label's primary category.
    """
    both = _kind(sums, "both", "label", "both")
    activation = _kind(sums, "cat", "cat_idx", "activation")
    truth = _kind(sums, "label", "label", "truth")
    union = F.col("activation") + F.col("truth") - F.col("both")
    return (
        both.join(bounded(labelcat.select("label", "cat_idx")), "label")
        .join(activation, ["unit", "cat_idx"])
        .join(truth, "label")
        .select(
            "unit",
            "label",
            "cat_idx",
            "both",
            "activation",
            "truth",
            (F.col("both") / (union + F.lit(EPSILON))).alias("iou"),
        )
    )


def best_labels(
    scores: DataFrame, units: DataFrame, sums: DataFrame, n_categories: int
) -> DataFrame:
    """Best label per unit and category, for every unit and category.

    Ties go to the lowest label. Without any positive score the label is 0 with score 0;
    label 0 belongs to the last category, whose area is then reported.
    """
    picked = (
        scores.where(F.col("iou") > 0)
        .groupBy("unit", "cat_idx")
        .agg(
            F.max_by(
                F.struct("label", "iou", "truth", "activation", "both"),
                F.struct(F.col("iou"), -F.col("label")),
            ).alias("_b")
        )
    )
    last = (
        _kind(sums, "cat", "cat_idx", "_last")
        .where(F.col("cat_idx") == n_categories - 1)
        .select("unit", "_last")
    )
    grid = units.select("unit").withColumn(
        "cat_idx", F.explode(F.sequence(F.lit(0), F.lit(n_categories - 1)))
    )
    zero = F.lit(0).cast("long")
    return (
        grid.join(picked, ["unit", "cat_idx"], "left")
        .join(last, "unit", "left")
        .select(
            "unit",
            "cat_idx",
            F.coalesce("_b.label", F.lit(0)).alias("label"),
            F.coalesce("_b.truth", zero).alias("truth"),
            F.when(F.col("_b").isNotNull(), F.col("_b.activation"))
            .otherwise(F.coalesce("_last", zero))
            .alias("activation"),
            F.coalesce("_b.both", zero).alias("intersect"),
            F.coalesce("_b.iou", F.lit(0.0)).alias("iou"),
        )
    )


def best_category(best: DataFrame) -> DataFrame:
    """Category with the highest score per unit; ties go to the higher index."""
    choice = F.max_by(F.struct("cat_idx", "label", "iou"), F.struct("iou", "cat_idx"))
    return best.groupBy("unit").agg(choice.alias("_c")).select(
        "unit",
        F.col("_c.cat_idx").alias("cat_idx"),
        F.col("_c.label").alias("label"),
        F.col("_c.iou").alias("score"),
    )


def unit_order(top: DataFrame) -> DataFrame:
    """Units by score, best first, as ``position`` from 0; ties by unit."""
    return global_index(top, [F.desc("score"), F.asc("unit")], "position")


def tally_records(best: DataFrame, categories: list[str], names: DataFrame) -> DataFrame:
    """One wide record per unit, numbered from 1: the best category, label and score, then
    label, truth, activation, intersect and iou of every category.

    ``names`` is ``(label, name)``; unknown labels are called ''.
    """
    named = best.join(bounded(names.select("label", "name")), "label", "left").withColumn(
        "name", F.coalesce("name", F.lit(""))
    )

    def of(cat: int, column: str):
        return F.max(F.when(F.col("cat_idx") == cat, F.col(column)))

    wide = []
    for i, cat in enumerate(categories):
        wide += [
            of(i, "name").alias(f"{cat}-label"),
            of(i, "truth").cast("double").alias(f"{cat}-truth"),
            of(i, "activation").cast("double").alias(f"{cat}-activation"),
            of(i, "intersect").cast("double").alias(f"{cat}-intersect"),
            of(i, "iou").alias(f"{cat}-iou"),
        ]
    lead = F.max_by(F.struct("cat_idx", "name", "iou"), F.struct("iou", "cat_idx")).alias("_c")
    table = F.array(*[F.lit(c) for c in categories])
    rows = named.groupBy("unit").agg(lead, *wide)
    rest = [c for c in rows.columns if c not in ("unit", "_c")]
    return rows.select(
        (F.col("unit") + 1).alias("unit"),
        F.get(table, F.col("_c.cat_idx")).alias("category"),
        F.col("_c.name").alias("label"),
        F.col("_c.iou").alias("score"),
        *[F.col(f"`{c}`") for c in rest],
    )
