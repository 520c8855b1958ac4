"""Inputs of the queries, derived from the given tables, and the same in SQL.

The 64 numbers of an embedding are 16 unit maps of 2 × 2; label maps are 4 × 4. A vector's
class gives its pixel labels (two channels) and, for most classes, an image-level label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS, SIDE, GRID = 16, 2, 4
DENSE_Q = 0.9
CATEGORIES = ["object", "part", "scene"]
#: Classes whose images carry no image-level label.
NO_SCENE = [0, 3, 6, 9]


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its footer is read once per session."""
    key = (spark.sparkContext.applicationId, f"{sf}/{name}.parquet")
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(key[1])
    return _TABLES[key]


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Results to nine places, without negative zeros."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if c in columns else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def blocks(spark, sf) -> DataFrame:
    """Whole maps, one row per image and unit."""
    vectors = table(spark, sf, "embeddings")
    cut = F.slice("embedding", F.col("unit") * (SIDE * SIDE) + 1, SIDE * SIDE).cast("array<double>")
    return vectors.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(UNITS - 1)))).select(
        F.col("vec_id").alias("img"),
        "unit",
        F.lit(SIDE).alias("h"),
        F.lit(SIDE).alias("w"),
        cut.alias("values"),
    )


def cells(spark, sf) -> DataFrame:
    from unitscope.operators.resample import blocks_to_cells

    return blocks_to_cells(blocks(spark, sf))


def matrix(spark, sf) -> DataFrame:
    from unitscope.schema import to_matrix

    return to_matrix(cells(spark, sf))


def images(spark, sf) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("img"),
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("image"),
        F.when(F.col("vec_id") % 4 == 0, "val").otherwise("train").alias("split"),
        F.lit(GRID).alias("sh"),
        F.lit(GRID).alias("sw"),
        F.col("label").alias("cls"),
    )


def _grid_labels(label) -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(GRID * GRID - 1)), label)


def channels(spark, sf) -> DataFrame:
    """Two label maps per image; their label numbers overlap."""
    cls = F.col("label")

    def first(p):
        return ((cls * 3 + F.floor(p / GRID) + p % GRID) % 6).cast("int")

    def second(p):
        r = (cls + 2 * F.floor(p / GRID) + p % GRID) % 4
        return F.when(r == 0, 0).otherwise(r + 2).cast("int")

    both = F.array(
        F.struct(F.lit(0).alias("channel"), _grid_labels(first).alias("labels")),
        F.struct(F.lit(1).alias("channel"), _grid_labels(second).alias("labels")),
    )
    vectors = table(spark, sf, "embeddings")
    return vectors.select(F.col("vec_id").alias("img"), F.lit("object").alias("category"), cls, F.inline(both)).drop("label")


def scalars(spark, sf) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return vectors.where(~F.col("label").isin(NO_SCENE)).select(
        F.col("vec_id").alias("img"),
        F.lit("scene").alias("category"),
        F.lit(0).alias("channel"),
        (F.col("label") + 6).cast("int").alias("label"),
    )


def labelcat(spark, sf) -> DataFrame:
    """Primary category of every label in use."""
    from unitscope.session import cut

    pixel = channels(spark, sf).select(F.explode("labels").alias("label"))
    used = pixel.where("label > 0").unionByName(scalars(spark, sf).select("label")).distinct()
    label = F.col("label")
    # kept like the small stored table it stands for
    return cut(used.select("label", F.when(label <= 3, 0).when(label <= 5, 1).otherwise(2).alias("cat_idx")))


def names(spark, sf) -> DataFrame:
    return labelcat(spark, sf).select(
        "label", F.concat(F.lit("concept_"), F.col("label").cast("string"), F.lit("-c")).alias("name")
    )


def thresholds(spark, sf, q: float = DENSE_Q) -> DataFrame:
    from unitscope.plans.dissection import block_thresholds
    from unitscope.session import cut

    return cut(block_thresholds(blocks(spark, sf), q))


def hits(spark, sf) -> DataFrame:
    from unitscope.operators.tally import mask_labels

    return mask_labels(
        blocks(spark, sf),
        thresholds(spark, sf),
        images(spark, sf),
        channels(spark, sf),
        scalars(spark, sf),
    )


def dissection(spark, sf):
    from unitscope.plans import dissect

    return dissect(
        blocks(spark, sf),
        images(spark, sf),
        channels(spark, sf),
        scalars(spark, sf),
        labelcat(spark, sf),
        CATEGORIES,
        names(spark, sf),
        DENSE_Q,
    )


def records(spark, sf) -> DataFrame:
    """Unit records with a 0-based ``unit`` and ``position`` = unit."""
    return dissection(spark, sf).records.select(
        (F.col("unit") - 1).alias("unit"), "category", "label", "score", (F.col("unit") - 1).alias("position")
    )


def predictions(spark, sf) -> DataFrame:
    """Class with the largest dot product of vector and class centroid, and the true class."""
    from unitscope.operators.reduce import argmax_class

    return argmax_class(class_scores(spark, sf)).join(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), "label"), "img"
    )


def class_scores(spark, sf) -> DataFrame:
    from unitscope.operators.layout import bounded

    vectors = table(spark, sf, "embeddings")
    flat = vectors.select(F.col("vec_id").alias("img"), "label", F.posexplode("embedding").alias("p", "v"))
    flat = flat.withColumn("v", F.col("v").cast("double"))
    centroids = flat.groupBy(F.col("label").alias("cls"), "p").agg(F.avg("v").alias("c"))
    return (
        flat.drop("label")
        .join(bounded(centroids), "p")
        .groupBy("img", "cls")
        .agg(F.round(F.sum(F.col("v") * F.col("c")), 9).alias("score"))
    )


def rates(spark, sf) -> DataFrame:
    from unitscope.operators.activation import activation_rates

    return activation_rates(blocks(spark, sf), thresholds(spark, sf), GRID, GRID)


def pixels(spark, sf) -> DataFrame:
    """Each vector as an RGB image of 8 × 8 bytes."""
    vectors = table(spark, sf, "embeddings")
    flat = vectors.select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("p", "e"))
    byte = F.floor((F.col("e").cast("double") + 1.0) * 100.0)
    return flat.withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "img",
        "ch",
        F.floor(F.col("p") / 8).cast("int").alias("y"),
        (F.col("p") % 8).cast("int").alias("x"),
        ((byte + F.col("ch") * 20) % 256).cast("double").alias("v"),
    )


# --- the same in SQL --------------------------------------------------------------------

_CTE = {
    "cell": """cell AS (
      SELECT vec_id AS img, (p // 4)::INT AS unit, ((p % 4) // 2)::INT AS y, (p % 2)::INT AS x,
             embedding[p + 1]::DOUBLE AS v
      FROM embeddings, range(64) t(p))""",
    "tap": """tap AS (
      SELECT o::INT AS o, greatest(floor(c), 0)::INT AS a, least(floor(c) + 1, 1)::INT AS b, c - floor(c) AS f
      FROM (SELECT o, (o + 0.5e0) * 2 / 4 - 0.5e0 AS c FROM range(4) t(o)))""",
    "up": """up AS (
      SELECT img, unit, py, px, lft + (rgt - lft) * fx AS v FROM (
        SELECT c1.img, c1.unit, ty.o AS py, tx.o AS px, tx.f AS fx,
               c1.v + (c3.v - c1.v) * ty.f AS lft, c2.v + (c4.v - c2.v) * ty.f AS rgt
        FROM tap ty CROSS JOIN tap tx
        JOIN cell c1 ON c1.y = ty.a AND c1.x = tx.a
        JOIN cell c2 ON c2.img = c1.img AND c2.unit = c1.unit AND c2.y = ty.a AND c2.x = tx.b
        JOIN cell c3 ON c3.img = c1.img AND c3.unit = c1.unit AND c3.y = ty.b AND c3.x = tx.a
        JOIN cell c4 ON c4.img = c1.img AND c4.unit = c1.unit AND c4.y = ty.b AND c4.x = tx.b))""",
    "thr": "thr AS (SELECT unit, quantile_cont(v, 0.9) AS t FROM cell GROUP BY unit)",
    "seg": """seg AS (
      SELECT vec_id AS img, 0 AS ch, py::INT AS py, px::INT AS px, ((label * 3 + py + px) % 6)::INT AS lab
      FROM embeddings, range(4) a(py), range(4) b(px)
      UNION ALL
      SELECT vec_id, 1, py::INT, px::INT,
             CASE WHEN (label + 2 * py + px) % 4 = 0 THEN 0 ELSE (label + 2 * py + px) % 4 + 2 END::INT
      FROM embeddings, range(4) a(py), range(4) b(px))""",
    "scal": "scal AS (SELECT vec_id AS img, label + 6 AS lab FROM embeddings WHERE label NOT IN (0, 3, 6, 9))",
    "labcat": """labcat AS (
      SELECT lab, CASE WHEN lab <= 3 THEN 0 WHEN lab <= 5 THEN 1 ELSE 2 END AS cat
      FROM (SELECT lab FROM seg WHERE lab > 0 UNION SELECT lab FROM scal))""",
    "mask": "mask AS (SELECT up.* FROM up JOIN thr USING (unit) WHERE v > t)",
    "area": "area AS (SELECT img, unit, count(*) AS area FROM mask GROUP BY img, unit)",
    "hit": """hit AS (
      SELECT img, unit, lab, count(*) AS n FROM mask JOIN seg USING (img, py, px)
      WHERE lab > 0 GROUP BY img, unit, lab
      UNION ALL
      SELECT img, unit, lab, area FROM area JOIN scal USING (img))""",
    "both": "both_ AS (SELECT unit, lab, sum(n)::BIGINT AS n FROM hit GROUP BY unit, lab)",
    "catarea": """catarea AS (
      SELECT unit, cat, sum(area)::BIGINT AS area
      FROM (SELECT DISTINCT img, unit, cat FROM hit JOIN labcat USING (lab)) JOIN area USING (img, unit)
      GROUP BY unit, cat)""",
    "truth": """truth AS (
      SELECT lab, sum(n)::BIGINT AS n FROM (
        SELECT lab, count(*) AS n FROM seg WHERE lab > 0 GROUP BY lab
        UNION ALL SELECT lab, count(*) * 16 FROM scal GROUP BY lab) GROUP BY lab)""",
    "iou": """iou AS (
      SELECT b.unit, b.lab, l.cat, b.n AS both_n, c.area AS act, t.n AS truth,
             b.n / ((c.area + t.n - b.n) + 1e-10) AS iou
      FROM both_ b JOIN labcat l USING (lab) JOIN catarea c ON c.unit = b.unit AND c.cat = l.cat
      JOIN truth t ON t.lab = b.lab)""",
    "best": """best AS (
      SELECT g.unit, g.cat, coalesce(i.lab, 0) AS lab, coalesce(i.truth, 0) AS truth,
             coalesce(i.act, z.area, 0) AS act, coalesce(i.both_n, 0) AS both_n, coalesce(i.iou, 0) AS iou
      FROM (SELECT unit, cat::INT AS cat FROM thr, range(3) r(cat)) g
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY unit, cat ORDER BY iou DESC, lab) AS r
                 FROM iou WHERE iou > 0) i ON i.unit = g.unit AND i.cat = g.cat AND i.r = 1
      LEFT JOIN catarea z ON z.unit = g.unit AND z.cat = 2)""",
    "top": """top_ AS (
      SELECT unit, cat, lab, iou AS score,
             CASE cat WHEN 0 THEN 'object' WHEN 1 THEN 'part' ELSE 'scene' END AS category,
             CASE WHEN lab = 0 THEN '' ELSE 'concept_' || lab || '-c' END AS label
      FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY iou DESC, cat DESC) AS r FROM best)
      WHERE r = 1)""",
    "score": """score AS (
      SELECT e.img, c.cls, round(sum(e.v * c.c), 9) AS score
      FROM (SELECT vec_id AS img, p, embedding[p + 1]::DOUBLE AS v FROM embeddings, range(64) t(p)) e
      JOIN (SELECT label AS cls, p, avg(embedding[p + 1]::DOUBLE) AS c
            FROM embeddings, range(64) t(p) GROUP BY label, p) c USING (p)
      GROUP BY e.img, c.cls)""",
    "pred": """pred AS (
      SELECT img, cls AS predicted, label FROM (
        SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, cls) AS r FROM score) s
      JOIN embeddings ON vec_id = img WHERE r = 1)""",
    "rate": """rate AS (
      SELECT img, unit, coalesce(area, 0) AS area, coalesce(area, 0) / 16 AS rate
      FROM (SELECT DISTINCT img, unit FROM cell) LEFT JOIN area USING (img, unit))""",
    "pix": """pix AS (
      SELECT vec_id AS img, ch::INT AS ch, (p // 8)::INT AS y, (p % 8)::INT AS x,
             ((floor((embedding[p + 1]::DOUBLE + 1) * 100) + ch * 20) % 256)::DOUBLE AS v
      FROM embeddings, range(64) t(p), range(3) u(ch))""",
}

_NEEDS = {
    "up": ["cell", "tap"],
    "thr": ["cell"],
    "labcat": ["seg", "scal"],
    "mask": ["up", "thr"],
    "area": ["mask"],
    "hit": ["area", "seg", "scal"],
    "both": ["hit"],
    "catarea": ["hit", "labcat"],
    "truth": ["seg", "scal"],
    "iou": ["both", "catarea", "truth"],
    "best": ["iou"],
    "top": ["best"],
    "pred": ["score"],
    "rate": ["area"],
}


def sql(select: str, *ctes: str) -> str:
    """``select`` preceded by the named table expressions and what they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in ctes:
        visit(name)
    head = ",\n".join(_CTE[name] for name in order)
    return f"WITH {head}\n{select}" if order else select
