"""Aggregations and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import query
from unitscope.operators import reduce


@query("e1_max", fx.sql("SELECT round(max(v), 9) AS value FROM cell", "cell"))
def max_all(spark, sf):
    return fx.rounded(reduce.max_all(fx.matrix(spark, sf)), "value")


_COLUMNS = ["img", "unit", "y", "x"]


def _register_axis(axis: int) -> None:
    ids = ", ".join(
        f"{'-1' if i == axis else c}::BIGINT AS id_{i + 1}" for i, c in enumerate(_COLUMNS)
    )
    keep = ", ".join(c for i, c in enumerate(_COLUMNS) if i != axis)

    @query(f"e2_max_axis_{axis + 1}", fx.sql(f"SELECT {ids}, round(max(v), 9) AS value FROM cell GROUP BY {keep}", "cell"))
    def max_axis(spark, sf):
        return fx.rounded(reduce.max_axis(fx.matrix(spark, sf), axis), "value")


for _axis in range(4):
    _register_axis(_axis)


@query("e3_spatial_max", fx.sql("SELECT img, unit, round(max(v), 9) AS max_v FROM cell GROUP BY img, unit", "cell"))
def spatial_max(spark, sf):
    return fx.rounded(reduce.spatial_max(fx.cells(spark, sf)), "max_v")


@query("e3_block_max", fx.sql("SELECT img, unit, round(max(v), 9) AS max_v FROM cell GROUP BY img, unit", "cell"))
def block_max(spark, sf):
    return fx.rounded(reduce.block_max(fx.blocks(spark, sf)), "max_v")


@query(
    "e4_product_sum",
    """SELECT l_suppkey, l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS value
       FROM lineitem GROUP BY l_suppkey, l_returnflag""",
)
def product_sum(spark, sf):
    """The sum inside the matrix product, on its own."""
    items = fx.table(spark, sf, "lineitem")
    return fx.rounded(reduce.product_sum(items, ["l_suppkey", "l_returnflag"], "l_extendedprice", "l_discount"), "value", digits=2)


@query(
    "e5_mask_area",
    fx.sql("SELECT img, unit, count(*) FILTER (WHERE v > t) AS area FROM cell JOIN thr USING (unit) GROUP BY img, unit", "thr"),
)
def mask_area(spark, sf):
    return reduce.mask_area(fx.cells(spark, sf), fx.thresholds(spark, sf))


@query("e6_label_bincount", fx.sql("SELECT lab AS label, count(*) AS n FROM seg WHERE lab > 0 GROUP BY lab", "seg"))
def label_bincount(spark, sf):
    return reduce.bincount(fx.channels(spark, sf).select(F.explode("labels").alias("label")), "label")


@query("e7_argmax_class", fx.sql("SELECT img, predicted FROM pred", "pred"))
def argmax_class(spark, sf):
    return reduce.argmax_class(fx.class_scores(spark, sf))


@query(
    "e8_accuracy",
    fx.sql(
        """SELECT count(*) FILTER (WHERE predicted = label) AS correct, count(*) AS total,
                  round(avg((predicted = label)::INT), 9) AS accuracy FROM pred""",
        "pred",
    ),
)
def accuracy(spark, sf):
    return fx.rounded(reduce.accuracy(fx.predictions(spark, sf)), "accuracy")


@query("e9_class_histogram", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def class_histogram(spark, sf):
    return reduce.class_histogram(fx.table(spark, sf, "part"), "p_type")


@query(
    "e10_mode_earliest",
    """SELECT user_id, event_type AS mode FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM (
           SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)) WHERE r = 1""",
)
def mode_earliest(spark, sf):
    return reduce.mode_earliest(fx.table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("e11_distinct_over", "SELECT count(DISTINCT p_brand) AS n_distinct FROM part WHERE p_retailprice >= 950")
def distinct_over(spark, sf):
    return reduce.distinct_over(fx.table(spark, sf, "part"), "p_brand", "p_retailprice", 950.0)


@query(
    "e12_describe",
    """SELECT 'value' AS "column", count(value) AS n, round(avg(value), 6) AS mean, round(stddev(value), 6) AS stddev,
              round(min(value), 6) AS min, round(max(value), 6) AS max FROM events
       UNION ALL
       SELECT 'user_id', count(user_id), round(avg(user_id), 6), round(stddev(user_id), 6),
              min(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events""",
)
def describe(spark, sf):
    stats = reduce.describe(fx.table(spark, sf, "events"), ["value", "user_id"])
    return fx.rounded(stats, "mean", "stddev", "min", "max", digits=6)
