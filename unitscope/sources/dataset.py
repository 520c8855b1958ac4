"""A concept data set on disk as the tables the tally takes.

Layout of the folder::

    index.csv       image, split, ih, iw, sh, sw, and a column of items per category
    category.csv    name, …           its order numbers the categories
    label.csv       number, name, category, frequency, coverage, syns
    c_<name>.csv    code, number, name, frequency, coverage    one per category
    images/         label maps named in the index

Any of the tables may be a folder of part files. Nothing is read by name from the driver: index, label maps and
categories are joined as DataFrames, a label map is decoded once and stays one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitscope.operators import concepts
from unitscope.operators.layout import bounded, global_index
from unitscope.session import cut
from unitscope.sources import images as files
from unitscope.sources import labels


@dataclass
class ConceptData:
    """Tables of a data set; ``img`` counts the kept images in index order."""

    categories: DataFrame  # cat_idx, name, …
    images: DataFrame  # img, image, split, ih, iw, sh, sw
    scalars: DataFrame  # img, category, channel, label
    channels: DataFrame  # img, category, channel, labels array<int>
    labels: DataFrame  # number, name, category, frequency, coverage, syns; one row for every number
    codes: DataFrame  # category, cat_idx, code, number, name, frequency, coverage
    labelcat: DataFrame  # label, cat_idx
    names: DataFrame  # label, name
    problems: DataFrame  # image, field, value, reason

    def category_names(self) -> list[str]:
        """Names by number; there are a handful of categories."""
        return [r["name"] for r in self.categories.orderBy("cat_idx").select("name").collect()]


#: Columns that order the rows of CSV files as they stand there.
_ORDER = ["_file", "_block", "_line"]


def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every field as text, and the columns ``_ORDER``."""
    raw = labels.read_text_csv(spark, path)
    return raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")
    )


def open_dataset(
    spark: SparkSession,
    path: str,
    categories: list[str],
    require_all: bool = False,
    index: str = "index.csv",
    pattern: str = "*.png",
) -> ConceptData:
    """Read the data set at ``path`` for the wanted categories.

    Images without any data in them (or, with ``require_all``, without data in each) are left
    out; label 0 is no data. A category of an image whose items are all numbers gives
    image-level labels; with a label map among them, every number fills a map of its own.
    Label maps that are missing, unreadable or of another size than the index says, and sizes
    that are no numbers, are listed in ``problems``; the channel concerned is left out.
    """
    listed = in_file_order(spark, f"{path}/category.csv").withColumn("_place", F.struct(*_ORDER)).drop(*_ORDER)
    # a row for each wanted name
    wanted = cut(labels.select_categories(listed, categories, "_place"))
    found = [r["name"] for r in wanted.orderBy("cat_idx").collect()]
    raw = in_file_order(spark, f"{path}/{index}")
    shown, sizes = [c for c in found if c in raw.columns], [c for c in labels.INDEX_META[2:] if c in raw.columns]
    if not shown:
        raise ValueError(f"none of the categories {categories} is in both category.csv and {index}")
    raw = raw.select(*_ORDER, "image", "split", *sizes, *shown)
    enough = concepts.has_all_data(shown) if require_all else concepts.has_any_data(shown)
    numbered = global_index(labels.decode_index(raw, _ORDER).where(enough), [F.col(c) for c in _ORDER], "img")
    kept = cut(numbered.select("img", "image", "split", *sizes, *shown))
    images = kept.select("img", "image", "split", *sizes)
    scalars, channels, missed = _segmentations(spark, kept, shown, f"{path}/images", pattern)
    sizes_lost = labels.bad_numbers(raw, "image", sizes).withColumn("reason", F.lit("not a whole number"))
    codes = cut(_codes(spark, path, wanted, found))
    known = concepts.dense_labels(labels.decode_labels(labels.read_text_csv(spark, f"{path}/label.csv")))
    coverage = codes.where(F.col("code") > 0).select("category", "cat_idx", "number", "coverage")
    labelcat = concepts.primary_category(known, coverage, len(found))
    return ConceptData(
        wanted,
        images,
        scalars,
        channels,
        known,
        codes,
        cut(labelcat.select(F.col("number").cast("int").alias("label"), "cat_idx")),
        known.select(F.col("number").cast("int").alias("label"), "name"),
        missed.unionByName(sizes_lost),
    )


def _codes(spark: SparkSession, path: str, wanted: DataFrame, names: list[str]) -> DataFrame:
    """The code tables of all categories in one."""
    columns = ["code", "number", "name", "frequency", "coverage"]

    def one(name: str) -> DataFrame:
        raw = labels.read_text_csv(spark, f"{path}/c_{name}.csv")
        held = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns]
        return labels.decode_labels(raw.select(*held)).withColumn("category", F.lit(name))

    whole = reduce(lambda a, b: a.unionByName(b), map(one, names))
    numbers = wanted.select(F.col("name").alias("category"), "cat_idx")
    return whole.join(bounded(numbers), "category").select("category", "cat_idx", *columns)


def _segmentations(spark: SparkSession, kept: DataFrame, shown: list[str], folder: str, pattern: str):
    """Image-level labels, label maps, and the label maps that could not be had."""
    items = labels.index_items(kept.select("image", *shown)).join(kept.select("img", "image", "sh", "sw"), "image")
    mapped = F.max(F.col("path").isNotNull()).over(Window.partitionBy("img", "category"))
    items = cut(items.withColumn("_mapped", mapped))
    scalars = items.where(~F.col("_mapped")).select("img", "category", "channel", "label")
    filled = items.where(F.col("_mapped") & F.col("label").isNotNull()).select(
        "img", "category", "channel", F.array_repeat(F.col("label"), F.col("sh") * F.col("sw")).alias("labels")
    )
    asked = items.where(F.col("path").isNotNull())
    stored = files.read_images(spark, folder, pattern)
    # every file is opened once
    decoded = files.label_maps(stored, every=True).withColumn("_there", F.lit(True))
    met = cut(asked.join(decoded, asked["path"] == decoded["file"], "left"))
    fits = (F.col("height") == F.col("sh")) & (F.col("width") == F.col("sw"))
    good = F.coalesce(fits, F.lit(False))
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("height").isNull(), "unreadable").otherwise("size differs from the index")
    missed = met.where(~good).select("image", F.col("category").alias("field"), F.col("path").alias("value"), reason.alias("reason"))
    return scalars, met.where(good).select("img", "category", "channel", "labels").unionByName(filled), missed
