"""Rankings and report aggregates, on unit records and on brand records.

A brand record stands for a unit: one per part, its label the brand, its category the part
type and its score derived from the price.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import query
from unitscope.operators import rank


def _records(spark, sf):
    part = fx.table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("unit"),
        F.lower("p_type").alias("category"),
        F.concat(F.lower(F.regexp_replace("p_name", " ", "_")), F.lit("_"), F.col("p_size").cast("string"), F.lit("-s")).alias("label"),
        (F.floor(F.col("p_retailprice") * 10) % 97 / 1000).alias("score"),
        F.col("p_partkey").alias("position"),
    )


_REC = """rec AS (
  SELECT p_partkey AS unit, lower(p_type) AS category,
         lower(replace(p_name, ' ', '_')) || '_' || p_size || '-s' AS label,
         (floor(p_retailprice * 10)::BIGINT % 97) / 1000 AS score FROM part)"""
_HIST = """
high AS (SELECT * FROM rec WHERE score >= 0.04e0),
modes AS (SELECT label, category FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, first) AS r FROM (
    SELECT label, category, count(*) AS n, min(unit) AS first FROM high GROUP BY 1, 2)) WHERE r = 1),
hist AS (SELECT label, count(*) AS n_units, max(score) AS best_score FROM high GROUP BY label),
histo AS (SELECT * FROM hist JOIN modes USING (label))"""
#: One given category, the others in the order their labels come up.
_ORDER = ["promo", "small"]
_CATPOS = """
cats AS (SELECT category, (row_number() OVER (ORDER BY
           CASE category WHEN 'promo' THEN 1 WHEN 'small' THEN 2 ELSE 3 END, n DESC, s DESC, category) - 1)::INT AS cat_pos
         FROM (SELECT category, CASE WHEN category IN ('promo', 'small') THEN 0 ELSE n_units END AS n,
                      CASE WHEN category IN ('promo', 'small') THEN 0 ELSE best_score END AS s,
                      row_number() OVER (PARTITION BY category ORDER BY n_units DESC, best_score DESC) AS r FROM histo)
         WHERE r = 1)"""


@query(
    "i1_top_images",
    fx.sql(
        """SELECT img, unit, round(max_v, 9) AS max_v, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY unit ORDER BY max_v DESC, img)::INT AS rank FROM (
               SELECT img, unit, max(v) AS max_v FROM cell GROUP BY 1, 2)) WHERE rank <= 10""",
        "cell",
    ),
)
def top_images(spark, sf):
    from unitscope.operators.reduce import block_max

    return fx.rounded(rank.top_images(block_max(fx.blocks(spark, sf))), "max_v")


@query(
    "i1_top_items",
    """SELECT l_suppkey AS unit, img, max_v, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY max_v DESC, img)::INT AS rank FROM (
           SELECT l_suppkey, l_orderkey AS img, max(l_extendedprice) AS max_v FROM lineitem GROUP BY 1, 2)) WHERE rank <= 10""",
)
def top_items(spark, sf):
    items = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.col("l_orderkey").alias("img"))
    return rank.top_images(items.agg(F.max("l_extendedprice").alias("max_v")))


@query("i2_label_histogram", f"WITH {_REC}, {_HIST} SELECT label, n_units, best_score, category FROM histo")
def label_histogram(spark, sf):
    return rank.label_histogram(_records(spark, sf))


@query(
    "i2_unit_histogram",
    fx.sql(
        """SELECT label, count(*) AS n_units, round(max(score), 9) AS best_score,
                  arg_min(category, unit) AS category FROM top_ WHERE score >= 0.04e0 GROUP BY label""",
        "top",
    ),
)
def unit_histogram(spark, sf):
    """On unit records; a label has one primary category here."""
    return fx.rounded(rank.label_histogram(fx.records(spark, sf)), "best_score")


@query(
    "i3_label_order",
    f"""WITH {_REC}, {_HIST}, {_CATPOS}
        SELECT label, category, cat_pos, n_units, best_score,
               row_number() OVER (ORDER BY cat_pos, n_units DESC, best_score DESC, label) - 1 AS label_pos
        FROM histo JOIN cats USING (category)""",
)
def label_order(spark, sf):
    return rank.label_order(rank.label_histogram(_records(spark, sf)), _ORDER)


@query(
    "i4_category_totals",
    f"""WITH {_REC}, {_HIST}, every AS (SELECT category, 1 AS n FROM histo UNION ALL
            SELECT unnest(['object', 'scene', 'part', 'material', 'texture', 'color']), 0)
        SELECT category, sum(n)::BIGINT AS n_labels FROM every GROUP BY category""",
)
def category_totals(spark, sf):
    return rank.category_totals(rank.label_histogram(_records(spark, sf)))


_RENDERED = f"""{_REC}, {_HIST}, {_CATPOS},
rendered AS (SELECT rec.*, row_number() OVER (ORDER BY
    CASE WHEN score < 0.04e0 THEN 1 ELSE 0 END,
    CASE WHEN score < 0.04e0 THEN 0 ELSE cat_pos END,
    CASE WHEN score < 0.04e0 THEN 0 ELSE n_units END DESC,
    CASE WHEN score < 0.04e0 THEN 0 ELSE best_score END DESC,
    score DESC, unit) - 1 AS rendered_pos
  FROM rec LEFT JOIN (SELECT label, n_units, best_score, cat_pos FROM histo JOIN cats USING (category)) h USING (label))"""


@query("i5_rendered_order", f"WITH {_RENDERED} SELECT unit, label, category, score, rendered_pos FROM rendered")
def rendered_order(spark, sf):
    return rank.rendered_order(_records(spark, sf), order=_ORDER).drop("position")


@query(
    "i6_coverage_summary",
    f"""WITH {_REC} SELECT count(*) FILTER (WHERE score >= 0.04e0) AS units_over, count(*) AS units,
               count(DISTINCT label) FILTER (WHERE score >= 0.04e0) AS concepts FROM rec""",
)
def coverage_summary(spark, sf):
    return rank.coverage_summary(_records(spark, sf))


@query(
    "i7_score_rank",
    f"""WITH {_RENDERED} SELECT unit, score, rendered_pos,
               row_number() OVER (ORDER BY score DESC, rendered_pos) - 1 AS score_order FROM rendered""",
)
def score_rank(spark, sf):
    ranked = rank.score_rank(rank.rendered_order(_records(spark, sf), order=_ORDER))
    return ranked.select("unit", "score", "rendered_pos", "score_order")


@query("i8_limited_records", f"WITH {_RENDERED} SELECT unit, label, rendered_pos FROM rendered WHERE rendered_pos < 25")
def limited_records(spark, sf):
    rendered = rank.rendered_order(_records(spark, sf), order=_ORDER)
    return rank.limit_records(rendered, 25).select("unit", "label", "rendered_pos")


@query(
    "i9_display_names",
    "SELECT p_partkey AS unit, lower(p_name) || ' ' || p_size AS display FROM part",
)
def display_names(spark, sf):
    return rank.show_names(_records(spark, sf)).select("unit", "display")


@query(
    "i10_top_image_areas",
    fx.sql(
        """SELECT r.img, r.unit, r.rank, coalesce(area, 0) AS area FROM (
             SELECT *, row_number() OVER (PARTITION BY unit ORDER BY max_v DESC, img)::INT AS rank FROM (
               SELECT img, unit, max(v) AS max_v FROM cell GROUP BY 1, 2)) r
           LEFT JOIN area a ON a.img = r.img AND a.unit = r.unit WHERE rank <= 10""",
        "area",
    ),
)
def top_image_areas(spark, sf):
    from unitscope.operators.reduce import block_max

    blocks = fx.blocks(spark, sf)
    top = rank.top_images(block_max(blocks))
    return rank.top_image_areas(top, blocks, fx.thresholds(spark, sf), fx.GRID, fx.GRID)


@query("i11_low_scores", f"WITH {_REC} SELECT unit, score, score < 0.04e0 AS low_score FROM rec")
def low_scores(spark, sf):
    return rank.flag_low(_records(spark, sf)).select("unit", "score", "low_score")
