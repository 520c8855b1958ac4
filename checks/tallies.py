"""Tallies and intersection over union."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import query
from checks.sources import RECORDS_SQL
from unitscope.operators import tally
from unitscope.plans.dissection import block_thresholds
from unitscope.session import cut


@query("h1_image_label_area", fx.sql("SELECT lab AS label, (count(*) * 16)::BIGINT AS area FROM scal GROUP BY lab", "scal"))
def image_label_area(spark, sf):
    return tally.image_label_area(fx.scalars(spark, sf), fx.images(spark, sf))


@query("h2_pixel_label_area", fx.sql("SELECT lab AS label, count(*) AS area FROM seg WHERE lab > 0 GROUP BY lab", "seg"))
def pixel_label_area(spark, sf):
    return tally.pixel_label_area(fx.channels(spark, sf))


@query(
    "h3_activation_gate",
    fx.sql("SELECT img, unit, round(max(v), 9) AS max_v FROM cell JOIN thr USING (unit) GROUP BY img, unit, t HAVING max(v) > t", "thr"),
)
def activation_gate(spark, sf):
    open_ = tally.gate(fx.blocks(spark, sf), fx.thresholds(spark, sf))
    return fx.rounded(open_.select("img", "unit", F.array_max("values").alias("max_v")), "max_v")


@query("h4_activation_mask", fx.sql("SELECT img, unit, py, px, round(v, 9) AS v FROM mask", "mask"))
def activation_mask(spark, sf):
    mask = tally.activation_mask(fx.blocks(spark, sf), fx.thresholds(spark, sf), fx.images(spark, sf))
    return fx.rounded(mask, "v")


@query("h5_unit_area", fx.sql("SELECT unit, sum(area)::BIGINT AS area FROM area GROUP BY unit", "area"))
def unit_area(spark, sf):
    return tally.unit_area(fx.hits(spark, sf))


@query(
    "h6_unit_pixel_labels",
    fx.sql(
        """SELECT unit, lab AS label, count(*) AS both FROM mask JOIN seg USING (img, py, px)
           WHERE lab > 0 GROUP BY unit, lab""",
        "mask",
        "seg",
    ),
)
def unit_pixel_labels(spark, sf):
    none = fx.scalars(spark, sf).where(F.lit(False))
    hits = tally.mask_labels(
        fx.blocks(spark, sf), fx.thresholds(spark, sf), fx.images(spark, sf), fx.channels(spark, sf), none
    )
    return tally.unit_label_pixels(hits)


@query(
    "h7_unit_image_labels",
    fx.sql("SELECT unit, lab AS label, sum(area)::BIGINT AS both FROM area JOIN scal USING (img) GROUP BY unit, lab", "area", "scal"),
)
def unit_image_labels(spark, sf):
    none = fx.channels(spark, sf).where(F.lit(False))
    hits = tally.mask_labels(
        fx.blocks(spark, sf), fx.thresholds(spark, sf), fx.images(spark, sf), none, fx.scalars(spark, sf)
    )
    return tally.unit_label_pixels(hits)


@query("h8_unit_category_area", fx.sql("SELECT unit, cat AS cat_idx, area FROM catarea", "catarea"))
def unit_category_area(spark, sf):
    return tally.unit_category_area(fx.hits(spark, sf), fx.labelcat(spark, sf))


@query(
    "h9_iou",
    fx.sql(
        """SELECT unit, lab AS label, cat AS cat_idx, both_n AS both, act AS activation, truth,
                  round(iou, 9) AS iou FROM iou""",
        "iou",
    ),
)
def iou(spark, sf):
    return fx.rounded(fx.dissection(spark, sf).scores, "iou")


_WIDE_SQL = """
WITH cell AS (
  SELECT vec_id AS img, u::INT AS unit, (p // 7)::INT AS y, (p % 7)::INT AS x, embedding[(p + 5 * u) % 64 + 1]::DOUBLE AS v
  FROM embeddings, range(4) a(u), range(49) b(p)
), tap AS (
  SELECT o::INT AS o, greatest(floor(c), 0)::INT AS a, least(floor(c) + 1, 6)::INT AS b, c - floor(c) AS f
  FROM (SELECT o, (o + 0.5e0) * 7 / 28 - 0.5e0 AS c FROM range(28) t(o))
), rows_ AS (
  SELECT c.img, c.unit, t.o AS py, c.x, c.v + (d.v - c.v) * t.f AS v
  FROM tap t JOIN cell c ON c.y = t.a JOIN cell d ON d.y = t.b AND d.img = c.img AND d.unit = c.unit AND d.x = c.x
), up AS (
  SELECT c.img, c.unit, c.py, t.o AS px, c.v + (d.v - c.v) * t.f AS v
  FROM tap t JOIN rows_ c ON c.x = t.a JOIN rows_ d ON d.x = t.b AND d.img = c.img AND d.unit = c.unit AND d.py = c.py
), thr AS (SELECT unit, quantile_cont(v, 0.9) AS t FROM cell GROUP BY unit
), mask AS (SELECT img, unit, py, px FROM up JOIN thr USING (unit) WHERE v > t
), seg AS (
  SELECT vec_id AS img, py::INT AS py, px::INT AS px, ((label * 3 + py // 5 + px // 5) % 6)::INT AS lab FROM embeddings, range(28) a(py), range(28) b(px)
), both_ AS (SELECT unit, lab, count(*) AS n FROM mask JOIN seg USING (img, py, px) WHERE lab > 0 GROUP BY unit, lab
), area AS (SELECT img, unit, count(*) AS area FROM mask GROUP BY img, unit
), shown AS (SELECT DISTINCT img, unit, lab % 2 AS cat FROM mask JOIN seg USING (img, py, px) WHERE lab > 0
), act AS (SELECT unit, cat, sum(area)::BIGINT AS act FROM shown JOIN area USING (img, unit) GROUP BY unit, cat
), truth AS (SELECT lab, count(*) AS truth FROM seg WHERE lab > 0 GROUP BY lab)
SELECT unit, lab AS label, (lab % 2)::INT AS cat_idx, n AS both, act AS activation, truth, round(n / ((act + truth - n) + 1e-10), 9) AS iou
FROM both_ JOIN act ON act.unit = both_.unit AND act.cat = lab % 2 JOIN truth USING (lab)
"""


@query("h9_iou_wide_maps", _WIDE_SQL.replace("SELECT unit, lab AS label", "SELECT both_.unit, lab AS label"))
def iou_of_wide_maps(spark, sf):
    """Maps of 7 × 7 against label maps of 28 × 28."""
    vectors = fx.table(spark, sf, "embeddings")
    img, cls = F.col("vec_id").alias("img"), F.col("label")
    value = F.slice(F.concat("embedding", "embedding"), F.col("unit") * 5 + 1, 49).cast("array<double>")
    maps = vectors.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(img, "unit", F.lit(7).alias("h"), F.lit(7).alias("w"), value.alias("values"))
    pixel = F.sequence(F.lit(0), F.lit(28 * 28 - 1))
    label = F.transform(pixel, lambda p: ((cls * 3 + F.floor(F.floor(p / 28) / 5) + F.floor(p % 28 / 5)) % 6).cast("int"))
    channels = vectors.select(img, F.lit(0).alias("channel"), label.alias("labels"))
    images = vectors.select(img, F.lit(28).alias("sh"), F.lit(28).alias("sw"))
    labelcat = spark.createDataFrame([(n, n % 2) for n in range(1, 6)], "label int, cat_idx int")
    thresholds = cut(block_thresholds(maps, fx.DENSE_Q))
    sums = cut(tally.tally_sums(maps, thresholds, images, channels, fx.scalars(spark, sf).where(F.lit(False)), labelcat))
    return fx.rounded(tally.iou(sums, labelcat), "iou")


@query(
    "h10_best_labels",
    fx.sql(
        """SELECT unit, cat AS cat_idx, lab AS label, truth, act AS activation, both_n AS intersect,
                  round(iou, 9) AS iou FROM best""",
        "best",
    ),
)
def best_labels(spark, sf):
    return fx.rounded(fx.dissection(spark, sf).best, "iou")


@query(
    "h11_best_category",
    fx.sql("SELECT unit, cat AS cat_idx, lab AS label, round(score, 9) AS score FROM top_", "top"),
)
def best_category(spark, sf):
    return fx.rounded(tally.best_category(fx.dissection(spark, sf).best), "score")


@query(
    "h12_unit_order",
    fx.sql(
        "SELECT unit, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, unit) - 1 AS position FROM top_",
        "top",
    ),
)
def unit_order(spark, sf):
    top = tally.best_category(fx.dissection(spark, sf).best)
    return fx.rounded(tally.unit_order(top.select("unit", "score")), "score")


@query("h13_tally_records", RECORDS_SQL)
def tally_records(spark, sf):
    records = fx.dissection(spark, sf).records
    return fx.rounded(records, "score", *[f"{c}-iou" for c in fx.CATEGORIES])


@query(
    "h14_merged_tallies",
    fx.sql(
        """SELECT unit, 'unit' AS kind, 0 AS key, sum(area)::BIGINT AS amount FROM area GROUP BY unit
           UNION ALL SELECT unit, 'both', lab, n FROM both_
           UNION ALL SELECT unit, 'cat', cat, area FROM catarea
           UNION ALL SELECT -1, 'label', lab, n FROM truth""",
        "both",
        "catarea",
        "truth",
    ),
)
def merged_tallies(spark, sf):
    """Three image ranges tallied on their own and added up."""
    thresholds = fx.thresholds(spark, sf)
    size = fx.images(spark, sf).count()
    bounds = [0, size // 3, size // 2, None]
    parts = []
    for start, end in zip(bounds, bounds[1:]):

        def part(df):
            kept = df.where(F.col("img") >= start)
            return kept.where(F.col("img") < end) if end is not None else kept

        parts.append(
            tally.tally_sums(
                part(fx.blocks(spark, sf)),
                thresholds,
                part(fx.images(spark, sf)),
                part(fx.channels(spark, sf)),
                part(fx.scalars(spark, sf)),
                fx.labelcat(spark, sf),
            )
        )
    return tally.merge_tallies(*[cut(p) for p in parts])
