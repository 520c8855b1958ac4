"""Tensors from and to files, tables, local arrays and nested columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitscope.operators.layout import spread
from unitscope.schema import ABSENT, IDS, MATRIX


def read_tensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of four ids and a value; the schema is fixed, never inferred."""
    return spark.read.schema(MATRIX).csv(path)


def write_tensor_csv(mat: DataFrame, path: str) -> None:
    mat.select(*IDS, "value").write.mode("overwrite").csv(path)


def array_to_cells(spark: SparkSession, array) -> DataFrame:
    """A local array of rank 1 to 4 as cells; absent leading axes hold -1."""
    array = np.asarray(array, dtype=float)
    rank = array.ndim
    if not 1 <= rank <= 4:
        raise ValueError(f"rank must be 1..4, not {rank}")
    full = array.reshape((1,) * (4 - rank) + array.shape)
    lead = [
        [ABSENT] if axis < 4 - rank else list(range(full.shape[axis])) for axis in range(3)
    ]
    rows = [
        (a, b, c, full[i, j, k].tolist())
        for i, a in enumerate(lead[0])
        for j, b in enumerate(lead[1])
        for k, c in enumerate(lead[2])
    ]
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in IDS[:3]]
        + [T.StructField("_row", T.ArrayType(T.DoubleType()))]
    )
    lines = spark.createDataFrame(rows, schema)
    return lines.select(*IDS[:3], F.posexplode("_row").alias("id_4", "value")).select(
        *IDS[:3], F.col("id_4").cast("long"), "value"
    )


def nested_to_cells(df: DataFrame, column: str = "feature_map", first: str | None = None) -> DataFrame:
    """A 4-deep array column as cells, other columns kept. ``first`` names a column with
    the number of the first image of the row."""
    keep = [c for c in df.columns if c not in (column, first)]
    start = F.col(first) if first else F.lit(0)
    return (
        df.select(*keep, start.alias("_s"), F.posexplode(column).alias("_a", "_v1"))
        .select(*keep, (F.col("_s") + F.col("_a")).cast("long").alias("id_1"), F.posexplode("_v1").alias("_b", "_v2"))
        .select(*keep, "id_1", F.col("_b").cast("long").alias("id_2"), F.posexplode("_v2").alias("_c", "_v3"))
        .select(*keep, "id_1", "id_2", F.col("_c").cast("long").alias("id_3"), F.posexplode("_v3").alias("_d", "value"))
        .select(*keep, "id_1", "id_2", "id_3", F.col("_d").cast("long").alias("id_4"), "value")
    )


def cells_to_nested(mat: DataFrame, keys: list[str] = (), images_per_row: int = 64) -> DataFrame:
    """Dense cells as rows ``(*keys, first_img, feature_map)`` with a 4-deep array.

    A row holds a run of ``images_per_row`` consecutive images, so it stays bounded for
    any number of images.
    """
    keys = list(keys)

    def level(df: DataFrame, by: list[str], axis: str, item: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(axis, item)))
        return df.groupBy(*by).agg(F.transform(ordered, lambda s: s[item]).alias("_n"))

    run = (F.floor(F.col("id_1") / images_per_row) * images_per_row).alias("first_img")
    # one shuffle by run serves all four levels
    rows = spread(mat.select(*keys, run, *IDS, F.col("value").alias("_n")), *keys, "first_img")
    by = [*keys, "first_img", *IDS]
    for depth in range(4):
        axis = by.pop()
        rows = level(rows, by, axis, "_n")
    return rows.select(*keys, F.col("first_img").cast("long"), F.col("_n").alias("feature_map"))


def save_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Overwrite a Parquet table of the session catalog and return it."""
    writer = df.write.format("parquet").mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def query_table(spark: SparkSession, name: str) -> DataFrame:
    """All rows of a catalog table."""
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": name})


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the current database."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name"), "isTemporary")
