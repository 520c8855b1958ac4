"""Streams in several micro-batches give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from unitscope import streaming
from unitscope.operators import tally
from unitscope.session import scratch


@pytest.fixture()
def maps(spark):
    """Feature maps in three files, one micro-batch each."""
    path = scratch(spark, "stream")
    n = F.col("id")
    values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.pmod(n * 37 + p * 11, F.lit(29)) / 10.0)
    all_ = spark.range(90).select(
        F.floor(n / 3).alias("img"), (n % 3).cast("int").alias("unit"), F.lit(2).alias("h"), F.lit(2).alias("w"), values.alias("values")
    )
    for i in range(3):
        all_.where(F.floor(F.col("img") / 10) == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return all_, stream


def test_sketches(spark, maps):
    batch, stream = maps
    values = stream.select("unit", F.explode("values").alias("v"))
    path = scratch(spark, "sketch")
    query = streaming.stream_sketches(values, ["unit"], "v", path, scratch(spark, "sketch-log"))
    query.awaitTermination(120)
    assert query.exception() is None
    merged = streaming.read_sketches(spark, path, ["unit"])
    seen = {r.unit: r.n for r in merged.select("unit", F.kll_sketch_get_n_double("sketch").alias("n")).collect()}
    assert seen == {0: 120, 1: 120, 2: 120}


def test_folded_sketches_hold_a_row_for_each_group(spark, maps):
    batch, stream = maps
    values = stream.select("unit", F.explode("values").alias("v"))
    path, log = scratch(spark, "fold"), scratch(spark, "fold-log")
    for _ in range(2):  # the second run finds nothing new
        query = streaming.fold_sketches(values, ["unit"], "v", path, log)
        query.awaitTermination(120)
        assert query.exception() is None
    assert streaming.versions(spark, path) == [1, 2]
    held = streaming.read_fold(spark, path)
    seen = {r.unit: r.n for r in held.select("unit", F.kll_sketch_get_n_double("sketch").alias("n")).collect()}
    assert held.count() == 3 and seen == {0: 120, 1: 120, 2: 120}
    assert {r["unit"] for r in streaming.merge_sketches(held, ["unit"]).collect()} == {0, 1, 2}


def test_a_repeated_batch_does_not_count_twice(spark, tmp_path):
    path = str(tmp_path / "fold")
    batches = [spark.createDataFrame([(0, "unit", 0, n)], "unit int, kind string, key int, amount long") for n in (5, 7, 9)]
    stores = []

    class Stream:  # hands the batches over as a restarted query does
        def __getattr__(self, name):
            return self

        def foreachBatch(self, store):
            stores.append(store)
            return self

        def option(self, *a):
            return self

        def trigger(self, **a):
            return self

        def start(self):
            return self

    streaming.fold_tallies(Stream(), lambda b: b, path, "none")
    for number in (0, 1, 1, 2, 2):
        stores[0](batches[number], number)
    assert [tuple(r) for r in streaming.read_fold(spark, path).collect()] == [(0, "unit", 0, 21)]


def test_tallies(spark, maps):
    batch, stream = maps
    thresholds = spark.createDataFrame([(u, 1.5) for u in range(3)], "unit int, thresh double")
    images = batch.select("img").distinct().select("img", F.lit(3).alias("sh"), F.lit(3).alias("sw"))
    labels = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda p: ((F.col("img") + p) % 4).cast("int"))
    channels = images.select("img", F.lit(0).alias("channel"), labels.alias("labels"))
    scalars = images.select("img", F.lit(4).alias("label"))
    labelcat = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2)], "label int, cat_idx int")

    def sums(blocks):
        mine = blocks.select("img").distinct()
        return tally.tally_sums(
            blocks, thresholds, images.join(mine, "img"), channels.join(mine, "img"), scalars.join(mine, "img"), labelcat
        )

    path = scratch(spark, "tallies")
    query = streaming.stream_tallies(stream, sums, path, scratch(spark, "tally-log"))
    query.awaitTermination(180)
    assert query.exception() is None
    got = streaming.read_tallies(spark, path)
    want = tally.tally_sums(batch, thresholds, images, channels, scalars, labelcat)
    assert spark.read.parquet(path).select("part").distinct().count() == 3
    folded = scratch(spark, "folded")
    query = streaming.fold_tallies(stream, sums, folded, scratch(spark, "fold-log"))
    query.awaitTermination(180)
    assert query.exception() is None
    assert sorted(map(tuple, streaming.read_fold(spark, folded).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
