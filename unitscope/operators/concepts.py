"""Images, categories, labels and segmentations of a concept data set.

Tables used below::

    images        img, split, sh, sw
    image labels  img, category, label          one row per image-level label
    channels      img, category, channel, labels array<int>   row-major label map
    coverage      category, cat_idx, number, coverage
    codes         category, code, number
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitscope.operators.layout import bounded, global_index


def has_any_data(lists: list[str]) -> Column:
    """Any of the label-list columns holds something but label 0."""
    checks = [F.exists(F.col(c), lambda x: x != "0") for c in lists]
    out = checks[0]
    for check in checks[1:]:
        out = out | check
    return out


def has_all_data(lists: list[str]) -> Column:
    """Every one of the label-list columns holds something but label 0."""
    checks = [F.exists(F.col(c), lambda x: x != "0") for c in lists]
    out = checks[0]
    for check in checks[1:]:
        out = out & check
    return out


def images_with_any(images: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """Long form of :func:`has_any_data`."""
    wanted = labels.where(F.col("category").isin(categories) & (F.col("label") != 0))
    return images.join(wanted, "img", "left_semi")


def images_with_all(images: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """Long form of :func:`has_all_data`."""
    wanted = labels.where(F.col("category").isin(categories) & (F.col("label") != 0))
    full = (
        wanted.groupBy("img")
        .agg(F.count_distinct("category").alias("_n"))
        .where(F.col("_n") == len(set(categories)))
    )
    return images.join(full, "img", "left_semi")


def category_table(df: DataFrame, name: str = "category") -> DataFrame:
    """Categories in name order as ``(category, cat_idx)``; there are a handful of them."""
    names = F.array_sort(F.collect_set(name))
    return df.agg(names.alias("_c")).select(F.posexplode("_c").alias("cat_idx", "category"))


def dense_labels(
    labels: DataFrame, key: str = "number", allow_none: bool = False, empty: dict | None = None
) -> DataFrame:
    """One row for every number from 0 to the largest.

    Holes get their own number and empty values ('' for text, 0 for numbers), or nulls
    with ``allow_none``. ``empty`` overrides the empty value of a column.
    """
    top = labels.agg(F.max(key)).first()[0]
    numbers = labels.sparkSession.range(0 if top is None else int(top) + 1).withColumnRenamed("id", key)
    kinds = dict(labels.dtypes)
    out = numbers.withColumn(key, F.col(key).cast(kinds[key])).join(labels, key, "left")
    if allow_none:
        return out
    blank = {"string": F.lit("")}
    filled = []
    for c in labels.columns:
        if c == key:
            filled.append(F.col(c))
        elif empty and c in empty:
            filled.append(F.coalesce(c, F.lit(empty[c])).alias(c))
        elif kinds[c].startswith(("array", "map")):
            base = F.array() if kinds[c].startswith("array") else F.create_map()
            filled.append(F.coalesce(c, base.cast(kinds[c])).alias(c))
        else:
            filled.append(F.coalesce(c, blank.get(kinds[c], F.lit(0).cast(kinds[c]))).alias(c))
    return out.select(*filled)


def to_codes(df: DataFrame, codes: DataFrame, number: str = "number") -> DataFrame:
    """Per-category dense code of a label number; 0 where the category lacks it."""
    table = codes.select("category", F.col("number").alias(number), "code")
    return df.join(bounded(table), ["category", number], "left").withColumn(
        "code", F.coalesce("code", F.lit(0))
    )


def to_numbers(df: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Label number of a per-category code; 0 where the code is unused."""
    table = codes.select("category", F.col("code").alias(code), "number")
    return df.join(bounded(table), ["category", code], "left").withColumn(
        "number", F.coalesce("number", F.lit(0))
    )


def primary_category(numbers: DataFrame, coverage: DataFrame, n_categories: int) -> DataFrame:
    """Category with the largest coverage per label, as ``(number, cat_idx)``.

    Categories without the label count as coverage 0, so the last category wins when no
    coverage is positive; ties go to the higher index.
    """
    best = coverage.where(F.col("coverage") > 0).groupBy("number").agg(
        F.max(F.struct("coverage", "cat_idx")).getField("cat_idx").alias("_best")
    )
    return numbers.select("number").join(best, "number", "left").select(
        "number", F.coalesce("_best", F.lit(n_categories - 1)).cast("int").alias("cat_idx")
    )


def label_statistics(labels: DataFrame) -> DataFrame:
    """Name, all names, frequency and coverage of every label."""
    return labels.select(
        "number",
        "name",
        F.concat(F.array("name"), F.col("syns")).alias("all_names"),
        "frequency",
        F.col("coverage").cast("double").alias("coverage"),
    )


def label_sizes(codes: DataFrame) -> DataFrame:
    """Labels per category, counting code 0: the largest code plus one."""
    return codes.groupBy("category").agg((F.max("code") + 1).alias("label_size"))


def category_frequency(codes: DataFrame) -> DataFrame:
    """Frequency of every category, summed over its labels ``(category, cat_idx, frequency)``."""
    return codes.groupBy("cat_idx", "category").agg(F.sum("frequency").cast("double").alias("frequency"))


def split_sizes(images: DataFrame) -> DataFrame:
    return images.groupBy("split").agg(F.count("*").alias("n"))


def select_images(images: DataFrame, split: str | None = None, start=None, end=None) -> DataFrame:
    """Images of a split with ``start <= img < end``."""
    if split is not None:
        images = images.where(F.col("split") == split)
    if start is not None:
        images = images.where(F.col("img") >= start)
    if end is not None:
        images = images.where(F.col("img") < end)
    return images


def shuffled(images: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """A repeatable random order, another one in every epoch; ``pos`` counts from 0."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col("img").cast("string")))
    keyed = images.withColumn("_key", digest)
    return global_index(keyed, ["_key", "img"], "pos").drop("_key")


def batches(images: DataFrame, size: int, order: str = "img") -> DataFrame:
    """Consecutive batches of ``size`` images; the last may be short."""
    numbered = global_index(images, [order], "pos")
    return numbered.withColumn("batch", F.floor(F.col("pos") / size)).drop("pos")


def _pixels(df: DataFrame) -> DataFrame:
    """Expand rows with ``sh`` and ``sw`` to one row per pixel."""
    area = (F.col("sh") * F.col("sw") - 1).cast("int")
    return (
        df.withColumn("_p", F.explode(F.sequence(F.lit(0), area)))
        .withColumn("py", F.floor(F.col("_p") / F.col("sw")).cast("int"))
        .withColumn("px", (F.col("_p") % F.col("sw")).cast("int"))
    )


def segmentation(
    images: DataFrame,
    scalars: DataFrame,
    channels: DataFrame,
    category: str,
    channel: int = 0,
    codes: DataFrame | None = None,
) -> DataFrame:
    """One channel of one category as pixels ``(img, py, px, label)``.

    An image-level label fills the grid, no data gives 0. With ``codes`` the labels are
    the category's own dense codes.
    """
    flat = scalars.where((F.col("category") == category) & (F.col("channel") == channel))
    maps = channels.where((F.col("category") == category) & (F.col("channel") == channel))
    source = images.select("img", "sh", "sw").join(
        flat.select("img", F.col("label").alias("_flat")), "img", "left"
    )
    source = source.join(maps.select("img", "labels"), "img", "left")
    label = F.coalesce(F.get("labels", F.col("_p")), F.col("_flat"), F.lit(0)).cast("int")
    out = _pixels(source).select("img", "py", "px", label.alias("label"))
    if codes is None:
        return out
    mapped = to_codes(out.withColumn("category", F.lit(category)), codes, "label")
    return mapped.select("img", "py", "px", F.col("code").cast("int").alias("label"))


def segmentation_stack(
    images: DataFrame,
    scalars: DataFrame,
    channels: DataFrame,
    categories: DataFrame,
    max_depth: int | None = None,
) -> DataFrame:
    """All channels of all wanted categories stacked: pixels ``(img, depth, py, px, label)``.

    Depth follows category order, then channel; categories without data take no depth.
    """
    empty = F.array().cast("array<int>")
    layers = (
        scalars.select(
            "img", "category", "channel", F.col("label").cast("int").alias("_flat"), empty.alias("labels")
        )
        .unionByName(
            channels.select(
                "img", "category", "channel", F.lit(0).alias("_flat"), F.col("labels").cast("array<int>").alias("labels")
            )
        )
        .join(bounded(categories.select("category", "cat_idx")), "category")
    )
    ordered = F.array_sort(F.collect_list(F.struct("cat_idx", "channel", "_flat", "labels")))
    # the list holds one entry per channel of a single image
    stacked = layers.groupBy("img").agg(ordered.alias("_layers"))
    picked = F.col("_layers") if max_depth is None else F.slice("_layers", 1, max_depth)
    rows = stacked.select("img", F.posexplode(picked).alias("depth", "_l")).join(
        images.select("img", "sh", "sw"), "img"
    )
    label = F.coalesce(F.get("_l.labels", F.col("_p")), F.col("_l._flat"))
    return _pixels(rows).select("img", "depth", "py", "px", label.cast("int").alias("label"))


def resolve_segmentations(
    images: DataFrame, scalars: DataFrame, channels: DataFrame, categories: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The wanted categories of every image as ``(scalar labels, pixel labels)``.

    A category of an image with only whole-image labels stays a list of labels; if it has
    any label map, its whole-image labels are grids too.
    """
    if categories is not None:
        scalars = scalars.where(F.col("category").isin(categories))
        channels = channels.where(F.col("category").isin(categories))
    keys = ["img", "category"]
    mapped = channels.select(*keys).distinct()
    plain = scalars.join(mapped, keys, "left_anti").select(*keys, "channel", "label")
    filled = scalars.join(mapped, keys, "left_semi").select(
        *keys, "channel", F.col("label").cast("int").alias("_flat"), F.array().cast("array<int>").alias("labels")
    )
    maps = channels.select(
        *keys, "channel", F.lit(0).alias("_flat"), F.col("labels").cast("array<int>").alias("labels")
    )
    grids = _pixels(maps.unionByName(filled).join(images.select("img", "sh", "sw"), "img"))
    label = F.coalesce(F.get("labels", F.col("_p")), F.col("_flat")).cast("int")
    return plain, grids.select(*keys, "channel", "py", "px", label.alias("label"))


def rescale_labels(channels: DataFrame, height: int, width: int, crop: bool = False) -> DataFrame:
    """Nearest-neighbour rescale of label maps ``(…, sh, sw, labels)`` to pixel rows.

    With ``crop`` the largest centred window of the target's proportions is scaled.
    """
    sh, sw = F.col("sh"), F.col("sw")
    if crop:
        ratio = F.greatest(F.lit(height) / sh, F.lit(width) / sw)
        ch, cw = F.bround(F.lit(height) / ratio).cast("int"), F.bround(F.lit(width) / ratio).cast("int")
        my, mx = F.floor((sh - ch) / 2), F.floor((sw - cw) / 2)
    else:
        ch, cw, my, mx = sh, sw, F.lit(0), F.lit(0)

    def nearest(o: Column, n_in: Column, n_out: int) -> Column:
        if n_out == 1:
            return F.lit(0)
        return F.floor(o * (n_in - 1) / (n_out - 1) + F.lit(0.5))

    pixel = F.explode(F.sequence(F.lit(0), F.lit(height * width - 1)))
    rows = (
        channels.withColumn("_p", pixel)
        .withColumn("py", F.floor(F.col("_p") / width).cast("int"))
        .withColumn("px", (F.col("_p") % width).cast("int"))
    )
    at = (my + nearest(F.col("py"), ch, height)) * sw + mx + nearest(F.col("px"), cw, width)
    return rows.withColumn("label", F.get("labels", at.cast("int"))).drop("_p", "labels", "sh", "sw")


def normalised_labels(
    images: DataFrame, scalars: DataFrame, channels: DataFrame, category: str, flatten: bool = False
) -> DataFrame:
    """Labels of one category as grids ``(img, channel, py, px, label)``.

    ``flatten`` keeps the first channel or label only and fills images without any with 0.
    """
    if flatten:
        out = segmentation(images, scalars, channels, category, 0)
        return out.select("img", F.lit(0).alias("channel"), "py", "px", "label")
    plain, grids = resolve_segmentations(images, scalars, channels, [category])
    filled = _pixels(plain.join(images.select("img", "sh", "sw"), "img"))
    filled = filled.select("img", "channel", "py", "px", F.col("label").cast("int").alias("label"))
    return grids.select("img", "channel", "py", "px", "label").unionByName(filled)
