"""Stored results: feature maps, thresholds, tallies and wide exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitscope.session import scratch


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def load_or_compute(
    spark: SparkSession,
    path: str,
    compute: Callable[[], DataFrame],
    partition_by: list[str] = (),
) -> DataFrame:
    """Read a finished table, or compute and store it first."""
    if not is_complete(spark, path):
        compute().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def compute_in_ranges(
    images: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    path: str,
    size: int = 4096,
    jobs: int = 8,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``compute`` over ``images`` (with a long ``img``), stored by ranges of ``size`` image numbers.

    A manifest lists the finished ranges with the number of images each was made from. A run
    leaves those alone and computes only what is missing, or has other images by number now,
    in at most ``jobs`` jobs; what an interrupted job has left behind is overwritten and never
    read. ``compute`` maps images to rows with the same ``img``. What is dear to read by ranges is
    added by ``fetch``, to all missing images at once: several jobs then take their ranges from a
    copy in the scratch folder.
    """
    spark = images.sparkSession
    made, manifest = f"{path}/ranges", f"{path}/manifest"
    listed = "_range long, _images long, _run long"
    part = F.floor(F.col("img") / size).cast("long")

    def finished() -> DataFrame:
        return spark.read.schema(listed).parquet(manifest) if exists(spark, manifest) else spark.createDataFrame([], listed)

    wanted = images.groupBy(part.alias("_range")).agg(F.count("*").alias("_images"))
    # the last entry of a range holds: it was written over when its images changed
    latest = finished().groupBy("_range").agg(F.max_by("_images", "_run").alias("_images"))
    run = (finished().agg(F.max("_run")).first()[0] or 0) + 1
    missing = wanted.join(latest, ["_range", "_images"], "left_anti").orderBy("_range").collect()
    step = max(1, -(-len(missing) // jobs))
    whole = images.where(part.isin([r["_range"] for r in missing]))
    whole = (fetch(whole) if fetch else whole).withColumn("_range", part)
    if fetch and len(missing) > step:
        held = scratch(spark, "fetched")
        whole.write.partitionBy("_range").parquet(held)
        whole = spark.read.schema(whole.schema).parquet(held)
    for at in range(0, len(missing), step):
        now = missing[at : at + step]
        rows = compute(whole.where(F.col("_range").isin([r["_range"] for r in now])).drop("_range")).withColumn("_range", part)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_range").parquet(made)
        spark.createDataFrame([(*r, run) for r in now], listed).coalesce(1).write.mode("append").parquet(manifest)
    none = images.limit(0)
    kind = compute(fetch(none) if fetch else none).schema
    if not exists(spark, made):
        return spark.createDataFrame([], kind)
    read = spark.read.schema(T.StructType([*kind.fields, T.StructField("_range", T.LongType())])).parquet(made)
    # one row for each finished range
    return read.join(F.broadcast(finished().select("_range").distinct()), "_range", "left_semi").drop("_range")


def save_features(features: DataFrame, path: str) -> None:
    """Feature maps by model and layer, sorted by image inside the files."""
    (
        features.repartition("model", "layer", F.floor(F.col("img") / 4096))
        .sortWithinPartitions("model", "layer", "img", "unit")
        .write.mode("overwrite")
        .partitionBy("model", "layer")
        .parquet(path)
    )


def threshold_table(thresholds: DataFrame, dataset: str, model: str, layer: str) -> DataFrame:
    return thresholds.select(
        F.lit(dataset).alias("dataset"),
        F.lit(model).alias("model_name"),
        F.lit(layer).alias("layer_name"),
        F.col("unit").cast("int").alias("unit_id"),
        F.col("thresh").cast("double").alias("thresh"),
    )


def tally_table(records: DataFrame, dataset: str, model: str, layer: str) -> DataFrame:
    """Label of every unit; ``unit_id`` counts from 0 while records count from 1."""
    return records.select(
        F.lit(dataset).alias("dataset"),
        F.lit(model).alias("model_name"),
        F.lit(layer).alias("layer_name"),
        (F.col("unit") - 1).cast("int").alias("unit_id"),
        F.col("label").alias("semantic_label"),
    )


def save_tally_csv(records: DataFrame, path: str) -> None:
    """One record per unit, best score first."""
    ordered = records.orderBy(F.desc("score"), F.asc("unit"))
    ordered.write.mode("overwrite").option("header", True).csv(path)


def read_tally_csv(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    columns = "unit int, category string, label string, score double"
    for cat in categories:
        columns += f", `{cat}-label` string"
        for part in ("truth", "activation", "intersect", "iou"):
            columns += f", `{cat}-{part}` double"
    # labels that are '' come back as null without emptyValue
    out = spark.read.option("header", True).schema(columns).csv(path)
    return out.fillna("", subset=["label", *[f"{cat}-label" for cat in categories]])


def wide_rates(samples: DataFrame, units: list[int]) -> DataFrame:
    """``(image, class, unit_0 …)``; absent rates are 0.

    Columns are called by unit number, because several units may share a label.
    """
    wide = samples.groupBy("img", "image", "class").pivot("unit", units).agg(F.max("rate"))
    rates = [F.coalesce(F.col(f"`{u}`"), F.lit(0.0)).alias(f"unit_{u}") for u in units]
    return wide.select("image", "class", *rates)


def save_matrix_csv(matrix: DataFrame, width: int, path: str) -> None:
    """Dense rows ``(src, row)`` as a headerless CSV in row order."""
    cols = [F.get("row", F.lit(j)).alias(f"c{j}") for j in range(width)]
    matrix.orderBy("src").select(*cols).write.mode("overwrite").csv(path)


def export_feature_maps(blocks: DataFrame, selection: DataFrame) -> DataFrame:
    """Maps of the selected images ``(img, pos)``, numbered anew in selection order."""
    from unitscope.operators.layout import global_index

    numbered = global_index(selection.select("img", "pos"), ["pos", "img"], "new_img")
    return blocks.join(numbered.select("img", "new_img"), "img").select(
        F.col("new_img").alias("img"), F.col("img").alias("source_img"), "unit", "h", "w", "values"
    )
