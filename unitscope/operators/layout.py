"""Size-checked broadcasts and distributed positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from unitscope.session import cut

#: Rows of fixed-width columns that may be shipped to every executor (a few MB).
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it is counted to be small, else leave the join to Spark.

    ``df`` should be cheap to read: a source table, or something passed through ``cut``.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` before a stage that multiplies its rows.

    The number of partitions is the session's, stated outright: adaptive execution would
    merge partitions by their bytes, which are small before the expansion.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def global_index(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """0-based position of each row under a total order.

    Rows are range-partitioned, numbered inside their partition and shifted by the
    number of rows in earlier partitions, so no task ever sees the whole input. The
    partition tag is checkpointed: a retried task must not draw other boundaries.
    """
    spark = df.sparkSession
    tagged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in tagged.groupBy("_part").count().collect())
    offsets, seen = [], 0
    for part, rows in sizes:
        offsets.append((part, seen))
        seen += rows
    schema = T.StructType(
        [T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())]
    )
    before = F.broadcast(spark.createDataFrame(offsets, schema))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        tagged.withColumn("_pos", F.row_number().over(inside).cast("long") - 1)
        .join(before, "_part")
        .withColumn(name, F.col("_before") + F.col("_pos"))
        .drop("_part", "_pos", "_before")
    )


def running_sums(df: DataFrame, by: list[str], order: str, amounts: list[str]) -> DataFrame:
    """``df`` with ``<amount>_upto``: sums over the rows of a group up to and with the row's ``order``.

    Rows are range-partitioned by group and order, summed inside their partition, and shifted by
    the group's sums in earlier partitions, so a group may fill any number of tasks. Rows of equal
    order lie together and have equal sums.
    """
    tagged = cut(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    # a row for each group and each partition that it reaches into
    parts = tagged.groupBy(*by, "_part").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*by, "_part", *[F.coalesce(F.sum(f"_{a}").over(earlier), F.lit(0)).alias(f"_{a}") for a in amounts])
    inside = Window.partitionBy(*by, "_part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    own = tagged.select("*", *[F.sum(a).over(inside).alias(f"{a}_upto") for a in amounts])
    met = own.join(before, [*by, "_part"])
    return met.select(*df.columns, *[(F.col(f"{a}_upto") + F.col(f"_{a}")).alias(f"{a}_upto") for a in amounts])


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of every group, with their 1-based rank.

    Spark cuts each input partition to ``n`` rows per group before the shuffle
    (WindowGroupLimit), so a hot group sends only its candidates.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= n)
