"""Activation rates of a second set of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import query
from unitscope.operators import activation, resample, tree
from unitscope.session import cut

_CLASSES = [1, 4, 7]


def _small_records(spark, sf):
    """Unit label, category and score from the tally."""
    return cut(fx.records(spark, sf)).drop("position")


@query("j1_activation_rates", fx.sql("SELECT img, unit, rate::DOUBLE AS rate FROM rate", "rate"))
def activation_rates(spark, sf):
    return fx.rates(spark, sf)


@query(
    "j2_correct_only",
    fx.sql("SELECT img, unit, rate::DOUBLE AS rate FROM rate JOIN pred USING (img) WHERE predicted = label", "rate", "pred"),
)
def correct_only(spark, sf):
    return activation.correct_only(fx.rates(spark, sf), fx.predictions(spark, sf))


@query(
    "j3_ranked_units",
    fx.sql(
        """SELECT img, unit, rate::DOUBLE AS rate, label, category, round(score, 9) AS score,
                  row_number() OVER (PARTITION BY img ORDER BY rate DESC, score DESC, unit)::INT AS rank
           FROM rate JOIN top_ USING (unit)""",
        "rate",
        "top",
    ),
)
def ranked_units(spark, sf):
    return fx.rounded(activation.ranked_units(fx.rates(spark, sf), _small_records(spark, sf)), "score")


@query(
    "j4_weighted_features",
    fx.sql(
        """SELECT img, unit, label, rate::DOUBLE AS rate, round(score * rate, 9) AS feature
           FROM rate JOIN top_ USING (unit)""",
        "rate",
        "top",
    ),
)
def weighted_features(spark, sf):
    return fx.rounded(activation.weighted_features(fx.rates(spark, sf), _small_records(spark, sf)), "feature")


@query(
    "j4_responses",
    fx.sql(
        """SELECT img, unit, top_.label, rate::DOUBLE AS rate, round(score * rate, 9) AS feature
           FROM rate JOIN top_ USING (unit) JOIN pred USING (img) WHERE predicted = pred.label""",
        "rate",
        "top",
        "pred",
    ),
)
def responses(spark, sf):
    """Rates and features of correctly classified images from maps to result."""
    from unitscope.plans import respond

    done = fx.dissection(spark, sf)
    out = respond(
        fx.blocks(spark, sf), done.thresholds, cut(done.records), fx.predictions(spark, sf), fx.GRID, fx.GRID
    )
    return fx.rounded(out, "feature")


@query(
    "j5_unit_label_vector",
    fx.sql("SELECT string_agg(label, '|' ORDER BY unit) AS labels FROM top_", "top"),
)
def unit_label_vector(spark, sf):
    return activation.unit_label_vector(_small_records(spark, sf)).select(F.concat_ws("|", "labels").alias("labels"))


@query("j6_selected_classes", "SELECT vec_id AS img, label AS cls FROM embeddings WHERE label IN (1, 4, 7)")
def selected_classes(spark, sf):
    return activation.select_classes(fx.images(spark, sf).select("img", "cls"), _CLASSES, "cls")


@query(
    "j7_feature_details",
    fx.sql(
        """SELECT img, (row_number() OVER (PARTITION BY img ORDER BY value DESC, name) - 1)::INT AS pos, name,
                  round(value, 9) AS value FROM (
             SELECT img, label AS name, arg_max(score * rate, unit) AS value
             FROM rate JOIN top_ USING (unit) WHERE score * rate > 0 GROUP BY img, label
             UNION ALL SELECT vec_id, 'class_' || label, 100 FROM embeddings)""",
        "rate",
        "top",
    ),
)
def feature_details(spark, sf):
    features = activation.weighted_features(fx.rates(spark, sf), _small_records(spark, sf))
    classes = fx.images(spark, sf).select("img", F.concat(F.lit("class_"), F.col("cls").cast("string")).alias("class"))
    details = activation.feature_details(features, classes)
    flat = details.select("img", F.posexplode("details").alias("pos", "d")).select("img", "pos", "d.name", "d.value")
    return fx.rounded(flat, "value")


@query("j8_rate_tree")
def rate_tree(spark, sf):
    """Images per class and predicted class of the tree."""
    units = list(range(fx.UNITS))
    rates = fx.rates(spark, sf).join(fx.images(spark, sf).select("img", "cls"), "img")
    wide = rates.groupBy("img", "cls").pivot("unit", units).agg(F.max("rate"))
    wide = cut(wide.select("img", F.col("cls").cast("double").alias("cls"), *[F.col(str(u)).alias(f"unit_{u}") for u in units]))
    assembler, model = activation.rate_tree(wide, units)
    scored = model.transform(assembler.transform(wide))
    return scored.groupBy(F.col("cls").cast("int").alias("cls"), F.col("prediction").cast("int").alias("predicted")).agg(
        F.count("*").alias("n")
    )


def _level(k: int, deep: bool) -> str:
    """One level of the tree: every split of every node scored from its rows, and the rows of the children."""
    out = f"""side{k} AS (
      SELECT a.node, a.unit, a.v, r.cls, count(*) FILTER (r.v <= a.v) AS lc, count(*) AS tc
      FROM (SELECT DISTINCT node, unit, v FROM rows{k}) a JOIN rows{k} r USING (node, unit) GROUP BY ALL
    ), gain{k} AS (
      SELECT node, unit, v AS t, sum(lc * lc)::DOUBLE / sum(lc) + sum((tc - lc) * (tc - lc))::DOUBLE / sum(tc - lc)
             - sum(tc * tc)::DOUBLE / sum(tc) AS gain
      FROM side{k} GROUP BY ALL HAVING sum(lc) >= 10 AND sum(tc - lc) >= 10
    ), split{k} AS (
      SELECT * FROM gain{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, unit, t) = 1
    ), limit{k} AS (
      SELECT node, s.unit, t, (t + min(v)) / 2 AS threshold FROM split{k} s JOIN rows{k} r USING (node) WHERE r.unit = s.unit AND r.v > t GROUP BY node, s.unit, t
    ), node{k} AS (
      SELECT node, {k} AS depth, n, cls, c::DOUBLE / n AS share FROM (
        SELECT node, cls, count(*) AS c, sum(count(*)) OVER (PARTITION BY node)::BIGINT AS n FROM (SELECT DISTINCT node, img, cls FROM rows{k}) GROUP BY node, cls)
      QUALIFY row_number() OVER (PARTITION BY node ORDER BY c DESC, cls) = 1
    )"""
    if deep:
        out += f""", move{k} AS (
      SELECT r.img, 2 * node + CASE WHEN r.v <= t THEN 0 ELSE 1 END AS node FROM rows{k} r JOIN limit{k} l USING (node) WHERE r.unit = l.unit
    ), rows{k + 1} AS (SELECT m.node, r.img, r.unit, r.v, r.cls FROM rows{k} r JOIN move{k} m USING (img))"""
    return out


_TREE_SQL = fx.sql("", "rate").rstrip() + f""", rows0 AS (
      SELECT 1 AS node, img, unit, rate::DOUBLE AS v, label AS cls FROM rate JOIN embeddings ON vec_id = img
    ), {_level(0, True)}, {_level(1, True)}, {_level(2, False)}
    SELECT node::BIGINT AS node, depth, l.unit::INT AS unit, round(threshold, 9) AS threshold, n, cls, round(share, 9) AS share FROM node0 LEFT JOIN limit0 l USING (node)
    UNION ALL SELECT node, depth, l.unit::INT, round(threshold, 9), n, cls, round(share, 9) FROM node1 LEFT JOIN limit1 l USING (node)
    UNION ALL SELECT node, depth, NULL::INT, NULL::DOUBLE, n, cls, round(share, 9) FROM node2"""


@query("j8_exact_tree", _TREE_SQL)
def exact_tree(spark, sf):
    """Nodes of a tree of depth two with exact splits."""
    grown = tree.exact_tree(fx.rates(spark, sf).withColumnRenamed("rate", "v"), fx.images(spark, sf).select("img", "cls"), max_depth=2)
    return fx.rounded(grown.nodes, "threshold", "share")


@query(
    "j9_class_samples",
    fx.sql(
        """SELECT img, 'vec_' || img || '.jpg' AS image, 'class_' || label AS class, unit, rate::DOUBLE AS rate
           FROM rate JOIN pred USING (img) WHERE predicted = label AND label IN (1, 4, 7)""",
        "rate",
        "pred",
    ),
)
def class_samples(spark, sf):
    images = fx.images(spark, sf).withColumn("class", F.concat(F.lit("class_"), F.col("cls").cast("string")))
    chosen = [f"class_{c}" for c in _CLASSES]
    rows = activation.class_samples(fx.rates(spark, sf), images, fx.predictions(spark, sf), chosen)
    return rows.select("img", "image", "class", "unit", "rate")


_STRONG = """strong AS (SELECT * FROM (
  SELECT img, unit, area, row_number() OVER (PARTITION BY img ORDER BY area DESC, unit)::INT AS rank FROM rate)
  WHERE rank <= 5)"""


@query(
    "j10_strongest_units",
    fx.sql("SELECT img, unit, area, rank, area / 64 AS rate FROM strong", "rate").replace("\nSELECT img", f",\n{_STRONG}\nSELECT img"),
)
def strongest_units(spark, sf):
    return activation.strongest_units(
        fx.blocks(spark, sf), fx.thresholds(spark, sf), fx.GRID, fx.GRID, n=5, rate_area=64
    )


@query(
    "j11_location_names",
    fx.sql(
        "SELECT img, unit, rank, 'vec_' || img || '_' || printf('%.2f', area / 16) || '_' || label || '_' || unit AS name "
        "FROM strong JOIN top_ USING (unit)",
        "rate",
        "top",
    ).replace("\nSELECT img, unit, rank, 'vec", f",\n{_STRONG}\nSELECT img, unit, rank, 'vec"),
)
def location_names(spark, sf):

    strong = activation.strongest_units(
        fx.blocks(spark, sf), fx.thresholds(spark, sf), fx.GRID, fx.GRID, n=5, rate_area=16
    )
    return activation.location_names(strong, fx.images(spark, sf), _small_records(spark, sf))


@query(
    "j10_location_highlight",
    fx.sql(
        """SELECT s.img, s.unit, ch, y, x, round((up.v * 0.8e0 + 0.2e0) * pix.v, 6) + 0 AS v
           FROM strong s JOIN up ON up.img = s.img AND up.unit = s.unit
           JOIN pix ON pix.img = s.img AND pix.y = up.py AND pix.x = up.px""",
        "rate",
        "pix",
    ).replace("\nSELECT s.img", f",\n{_STRONG}\nSELECT s.img"),
)
def location_highlight(spark, sf):
    """The image under the enlarged activation of its strongest units."""
    blocks = fx.blocks(spark, sf)
    strong = activation.strongest_units(blocks, fx.thresholds(spark, sf), fx.GRID, fx.GRID, n=5, rate_area=16)
    shown = activation.location_highlight(strong, blocks, fx.pixels(spark, sf), fx.GRID, fx.GRID)
    return fx.rounded(shown, "v", digits=6)
