"""Incremental forms of the mergeable results.

New feature maps arrive as a stream; every micro-batch appends its partial sketch or
tally to a table, and readers merge the parts. A batch that is run again replaces its own
part, so results stay exact after a lost executor or a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from unitscope.operators.quantile import SKETCH_K, build_sketch, merge_sketches
from unitscope.operators.tally import merge_tallies
from unitscope.sources.store import is_complete


def write_parts(
    stream: DataFrame, summarise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Store ``summarise(batch)`` under ``path/part=<batch>`` for all data available now."""

    def store(batch: DataFrame, number: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{path}/part={number}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fold(
    stream: DataFrame,
    summarise: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Keep one merged result of all batches so far, for all data available now.

    Batch ``n`` merges its summary with the newest complete version before ``n`` and writes
    version ``n``; the version before stays for a batch that is run again, older ones go. So
    the result has a row for each key, however many batches there were.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = versions(spark, path)
        before = [v for v in held if v < number]
        part = summarise(batch)
        if before:
            part = part.unionByName(spark.read.schema(part.schema).parquet(f"{path}/version={before[-1]}"))
        merge(part).write.mode("overwrite").parquet(f"{path}/version={number}")
        for old in before[:-1]:
            place, system = _place(spark, f"{path}/version={old}")
            system.delete(place, True)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a folded result."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return []
    names = [f.getPath().getName() for f in system.listStatus(place)]
    found = [int(n.partition("=")[2]) for n in names if n.startswith("version=")]
    return sorted(v for v in found if is_complete(spark, f"{path}/version={v}"))


def read_fold(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a folded result."""
    return spark.read.parquet(f"{path}/version={versions(spark, path)[-1]}")


def fold_sketches(stream: DataFrame, by: list[str], value: str, path: str, checkpoint: str, k: int = SKETCH_K) -> StreamingQuery:
    """One quantile sketch per group of a stream of values."""
    return fold(stream, lambda batch: build_sketch(batch, by, value, k), lambda parts: merge_sketches(parts, by), path, checkpoint)


def fold_tallies(stream: DataFrame, tally: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """One tally of a stream of feature maps: a row for each unit, kind and key."""
    return fold(stream, tally, merge_tallies, path, checkpoint)


def stream_sketches(
    stream: DataFrame, by: list[str], value: str, path: str, checkpoint: str, k: int = SKETCH_K
) -> StreamingQuery:
    """Quantile sketches of a stream of values, one part per micro-batch."""
    return write_parts(stream, lambda batch: build_sketch(batch, by, value, k), path, checkpoint)


def read_sketches(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    return merge_sketches(spark.read.parquet(path), by)


def stream_tallies(
    stream: DataFrame, tally: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Tally sums of a stream of feature maps, one part per micro-batch.

    ``tally`` maps a batch of maps to ``(unit, kind, key, amount)``.
    """
    return write_parts(stream, tally, path, checkpoint)


def read_tallies(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(path).drop("part")
    return merge_tallies(parts)


