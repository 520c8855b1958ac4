"""Quantiles and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import query
from unitscope.operators import quantile, reshape
from unitscope.operators.layout import bounded
from unitscope.session import cut, scratch

_QS = [0.0, 0.1, 0.5, 0.9, 0.995, 1.0]
_LIST = "[" + ", ".join(f"{q}::DOUBLE" for q in _QS) + "]"


@query(
    "f1_channel_quantile",
    fx.sql("SELECT unit::BIGINT AS id_4, round(quantile_disc(v, 0.95), 9) AS approx_quantile FROM cell GROUP BY unit", "cell"),
)
def channel_quantile(spark, sf):
    """Fewer values per channel than the accuracy, so the estimate is an exact element."""
    channel_last = reshape.transpose(fx.matrix(spark, sf), [0, 2, 3, 1])
    return fx.rounded(quantile.channel_quantile(channel_last, 0.95, accuracy=1_000_000), "approx_quantile")


@query(
    "f2_unit_threshold",
    fx.sql("SELECT unit, round(quantile_cont(v, 994 / 999), 9) AS thresh FROM cell GROUP BY unit", "cell"),
)
def unit_threshold(spark, sf):
    return fx.rounded(quantile.unit_thresholds(fx.cells(spark, sf)), "thresh")


@query(
    "f2_supplier_threshold",
    "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 994 / 999), 6) AS thresh FROM lineitem GROUP BY l_suppkey",
)
def supplier_threshold(spark, sf):
    out = quantile.exact_quantiles(
        fx.table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", [quantile.THRESHOLD_QUANTILE]
    )
    return fx.rounded(out.select("l_suppkey", F.col("quantile").alias("thresh")), "thresh", digits=6)


@query("f3_sketch_build", "SELECT event_type, count(value) AS seen FROM events GROUP BY event_type")
def sketch_build(spark, sf):
    sketches = quantile.build_sketch(fx.table(spark, sf, "events"), ["event_type"], "value")
    return quantile.sketch_sizes(sketches, ["event_type"])


@query("f4_sketch_merge", "SELECT event_type, count(value) AS seen, true AS close FROM events GROUP BY event_type")
def sketch_merge(spark, sf):
    """Daily sketches merged; the median's rank is within two thousandths of one half."""
    events = fx.table(spark, sf, "events")
    daily = quantile.build_sketch(
        events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value"
    )
    merged = cut(quantile.merge_sketches(daily, ["event_type"]))
    median = quantile.sketch_quantiles(merged, ["event_type"], [0.5]).select("event_type", "estimate")
    rank = (
        events.join(bounded(cut(median)), "event_type")
        .groupBy("event_type")
        .agg(
            F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("below"),
            F.avg((F.col("value") <= F.col("estimate")).cast("double")).alias("upto"),
        )
    )
    close = (F.col("below") <= 0.502) & (F.col("upto") >= 0.498)
    return quantile.sketch_sizes(merged, ["event_type"]).join(
        rank.select("event_type", close.alias("close")), "event_type"
    )


@query(
    "f5_midrank_quantiles",
    f"""WITH r AS (SELECT event_type, list(value ORDER BY value) AS vs, count(*) AS n FROM events GROUP BY event_type),
            q AS (SELECT *, i AS q_idx, greatest(least({_LIST}[i + 1] * n - 0.5e0, n - 1), 0) AS pos
                  FROM r, range({len(_QS)}) t(i)),
            p AS (SELECT event_type, q_idx, pos - floor(pos) AS f, vs[floor(pos)::BIGINT + 1] AS a,
                         vs[least(floor(pos)::BIGINT + 1, n - 1) + 1] AS b FROM q)
       SELECT event_type, q_idx::INT AS q_idx, round(a + (b - a) * f, 6) AS quantile FROM p""",
)
def midrank_quantiles(spark, sf):
    out = quantile.quantiles(fx.table(spark, sf, "events"), ["event_type"], "value", _QS)
    return fx.rounded(out.drop("q"), "quantile", digits=6)


_PERCENTILES = """SELECT {by}, i::INT AS q_idx, round(qs[i + 1], 6) AS quantile FROM (
  SELECT {by}, quantile_cont({value}, {qs}) AS qs FROM {table} GROUP BY {by}), range({n}) t(i)"""


@query(
    "f6_percentiles",
    _PERCENTILES.format(by="event_type", value="value", qs=_LIST, table="events", n=len(_QS)),
)
def percentiles(spark, sf):
    out = quantile.percentiles(fx.table(spark, sf, "events"), ["event_type"], "value", _QS)
    return fx.rounded(out.drop("q"), "quantile", digits=6)


_EVEN = "[" + ", ".join(f"({i} / 20)::DOUBLE" for i in range(21)) + "]"


@query(
    "f7_readout",
    _PERCENTILES.format(by="l_suppkey", value="l_extendedprice", qs=_EVEN, table="lineitem", n=21),
)
def readout(spark, sf):
    out = quantile.readout(fx.table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", 21)
    return fx.rounded(out.drop("q"), "quantile", digits=6)


@query("f8_minmax", fx.sql("SELECT unit, round(min(v), 9) AS min_v, round(max(v), 9) AS max_v FROM cell GROUP BY unit", "cell"))
def minmax(spark, sf):
    return fx.rounded(quantile.minmax(fx.cells(spark, sf), ["unit"], "v"), "min_v", "max_v")


@query("f9_integrate", fx.sql("SELECT unit, round(sum(v * v), 7) AS integral FROM cell GROUP BY unit", "cell"))
def integrate(spark, sf):
    return fx.rounded(quantile.integrate(fx.cells(spark, sf), ["unit"], "v", lambda v: v * v), "integral", digits=7)


@query("f4_folded_stream", "SELECT event_type, count(value) AS seen FROM events GROUP BY event_type")
def folded_stream(spark, sf):
    """Events as a stream of four micro-batches folded into one sketch a type."""
    from unitscope import streaming

    source, path, log = (scratch(spark, name) for name in ("stream", "fold", "log"))
    events = fx.table(spark, sf, "events").select("event_type", F.col("value").cast("double").alias("value"))
    events.repartition(4, "event_type", "value").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.fold_sketches(stream, ["event_type"], "value", path, log).awaitTermination()
    return quantile.sketch_sizes(streaming.read_fold(spark, path), ["event_type"])


@query("f10_sketch_report", fx.sql("SELECT unit, count(*) AS seen, true AS close FROM cell GROUP BY unit", "cell"))
def sketch_report(spark, sf):
    """The middle quantiles deviate by at most half a percent of the range: a tenth by the sketch, the rest
    because it answers with a value seen where the exact one lies between two."""
    cells = fx.cells(spark, sf)
    sketches = quantile.build_sketch(cells, ["unit"], "v")
    report = quantile.sketch_report(cells, sketches, ["unit"], "v", [0.1, 0.25, 0.5, 0.75, 0.9])
    return report.select("unit", "seen", (F.col("max_deviation") <= 0.005).alias("close"))
