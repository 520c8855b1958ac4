"""Constructors, shape and index operators, element-wise and matrix algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import query
from unitscope.operators import algebra, construct, reduce, reshape
from unitscope.schema import to_4d

_IDS = "img AS id_1, unit::BIGINT AS id_2, y::BIGINT AS id_3, x::BIGINT AS id_4"
_GRID4 = """i AS id_1, u AS id_2, y AS id_3, x AS id_4
  FROM (SELECT max(vec_id) + 1 AS n FROM embeddings), range(n) a(i), range(16) b(u), range(2) c(y), range(2) d(x)"""


@query("b1_zeroes", f"SELECT 0.0::DOUBLE AS value, {_GRID4}")
def zeroes(spark, sf):
    return construct.zeroes(spark, *reshape.shape_values(fx.matrix(spark, sf)))


@query(
    "b2_ones_2d",
    """SELECT -1::BIGINT AS id_1, -1::BIGINT AS id_2, i AS id_3, u AS id_4, 1.0::DOUBLE AS value
       FROM (SELECT max(vec_id) + 1 AS n FROM embeddings), range(n) a(i), range(16) b(u)""",
)
def ones_2d(spark, sf):
    images, units, _, _ = reshape.shape_values(fx.matrix(spark, sf))
    return construct.ones_2d(spark, images, units)


def _hashed(seed: int, cell: str, lo: int, hi: int) -> str:
    return f"((('0x' || substr(md5('{seed}:' || ({cell})), 1, 12))::BIGINT % {hi - lo + 1}) + {lo})::DOUBLE"


@query(
    "b3_random_2d",
    f"""SELECT -1::BIGINT AS id_1, -1::BIGINT AS id_2, i AS id_3, u AS id_4, {_hashed(7, 'i * 16 + u', 1, 5)} AS value
        FROM (SELECT max(vec_id) + 1 AS n FROM embeddings), range(n) a(i), range(16) b(u)""",
)
def random_2d(spark, sf):
    images, units, _, _ = reshape.shape_values(fx.matrix(spark, sf))
    return construct.random_2d(spark, images, units, seed=7)


@query("b4_random_4d", f"SELECT {_hashed(3, '((i * 16 + u) * 2 + y) * 2 + x', -2, 9)} AS value, {_GRID4}")
def random_4d(spark, sf):
    return construct.random_4d(spark, *reshape.shape_values(fx.matrix(spark, sf)), lo=-2, hi=9, seed=3)


@query(
    "c1_shape",
    fx.sql(
        "SELECT max(img) + 1 AS n_1, max(unit)::BIGINT + 1 AS n_2, max(y)::BIGINT + 1 AS n_3, max(x)::BIGINT + 1 AS n_4 FROM cell",
        "cell",
    ),
)
def shape(spark, sf):
    return reshape.shape(fx.matrix(spark, sf))


_FLIPS = {
    1: "n - 1 - img AS id_1, unit::BIGINT AS id_2, y::BIGINT AS id_3, x::BIGINT AS id_4",
    2: "img AS id_1, (15 - unit)::BIGINT AS id_2, y::BIGINT AS id_3, x::BIGINT AS id_4",
    3: "img AS id_1, unit::BIGINT AS id_2, (1 - y)::BIGINT AS id_3, x::BIGINT AS id_4",
    4: "img AS id_1, unit::BIGINT AS id_2, y::BIGINT AS id_3, (1 - x)::BIGINT AS id_4",
}


def _register_reverse(axis: int) -> None:
    select = f"SELECT {_FLIPS[axis]}, v AS value FROM cell, (SELECT max(vec_id) + 1 AS n FROM embeddings)"

    @query(f"c2_reverse_axis_{axis}", fx.sql(select, "cell"))
    def reverse(spark, sf):
        return reshape.reverse(fx.matrix(spark, sf), axis - 1)


for _axis in _FLIPS:
    _register_reverse(_axis)


@query(
    "c3_transpose",
    fx.sql("SELECT img AS id_1, y::BIGINT AS id_2, x::BIGINT AS id_3, unit::BIGINT AS id_4, v AS value FROM cell", "cell"),
)
def transpose(spark, sf):
    return reshape.transpose(fx.matrix(spark, sf), [0, 2, 3, 1])


@query(
    "c3_transpose_reversed",
    fx.sql("SELECT x::BIGINT AS id_1, y::BIGINT AS id_2, unit::BIGINT AS id_3, img AS id_4, v AS value FROM cell", "cell"),
)
def transpose_reversed(spark, sf):
    return reshape.transpose(fx.matrix(spark, sf))


@query("c4_channel_rows", fx.sql("SELECT (img * 2 + y) * 2 + x AS row_id, unit, v FROM cell", "cell"))
def channel_rows(spark, sf):
    return reshape.channel_rows(fx.cells(spark, sf), fx.SIDE, fx.SIDE)


_SIZE = "(SELECT max(vec_id) + 1 FROM embeddings)"


@query(
    "c5_image_slice",
    fx.sql(f"SELECT img, unit, y, x, v FROM cell WHERE img >= {_SIZE} // 4 AND img < {_SIZE} // 4 * 3", "cell"),
)
def image_slice(spark, sf):
    """The middle half of the images."""
    quarter = reshape.shape_values(fx.matrix(spark, sf))[0] // 4
    return reshape.slice_images(fx.cells(spark, sf), quarter, quarter * 3)


@query("c6_first_images", fx.sql(f"SELECT {_IDS}, v AS value FROM cell WHERE img < {_SIZE} // 2", "cell"))
def first_images(spark, sf):
    mat = fx.matrix(spark, sf)
    return reshape.first_images(mat, reshape.shape_values(mat)[0] // 2)


@query(
    "c7_one_hot",
    """SELECT vec_id, label, pos::INT AS pos, CASE WHEN pos = label THEN 1.0 ELSE 0.0 END::DOUBLE AS hot
       FROM embeddings, (SELECT max(label) + 1 AS n FROM embeddings), range(n) r(pos)""",
)
def one_hot(spark, sf):
    return reshape.one_hot(fx.table(spark, sf, "embeddings").select("vec_id", "label"), "label")


def lineitem_matrix(spark, sf, value: str):
    """Supplier × part bucket; several line items share a cell, so they are summed."""
    items = fx.table(spark, sf, "lineitem")
    cells = items.groupBy(
        F.col("l_suppkey").alias("id_3"), (F.col("l_partkey") % 50).alias("id_4")
    ).agg(F.round(F.sum(value), 2).alias("value"))
    return to_4d(cells)


_LINE = """
  q AS (SELECT l_suppkey AS i, l_partkey % 50 AS j, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1, 2),
  p AS (SELECT l_suppkey AS i, l_partkey % 50 AS j, round(sum(l_tax), 2) AS v FROM lineitem GROUP BY 1, 2)
"""


def _line_sql(value: str) -> str:
    return f"""WITH {_LINE} SELECT -1::BIGINT AS id_1, -1::BIGINT AS id_2, q.i AS id_3, q.j AS id_4, {value} AS value
               FROM q JOIN p USING (i, j)"""


def _line_query(name: str, value: str, op) -> None:
    @query(name, _line_sql(value))
    def run(spark, sf):
        left = lineitem_matrix(spark, sf, "l_quantity")
        right = lineitem_matrix(spark, sf, "l_tax")
        return fx.rounded(op(left, right), "value", digits=6)


_line_query("d1_add", "round(q.v + p.v, 6)", algebra.add)
_line_query("d3_subtract", "round(q.v - p.v, 6)", algebra.subtract)
_line_query("d5_dot_multiply", "round(q.v * p.v, 6) + 0", algebra.dot_multiply)
_line_query("d7_dot_divide", "round(q.v / nullif(p.v, 0), 6)", algebra.dot_divide)


def _self_flip(name: str, expr: str, op) -> None:
    """A tensor against its own mirror image along the last axis."""

    @query(
        name,
        fx.sql(
            f"""SELECT a.img AS id_1, a.unit::BIGINT AS id_2, a.y::BIGINT AS id_3, a.x::BIGINT AS id_4,
                       round({expr}, 9) + 0 AS value
                FROM cell a JOIN cell b ON a.img = b.img AND a.unit = b.unit AND a.y = b.y AND a.x = 1 - b.x""",
            "cell",
        ),
    )
    def run(spark, sf):
        mat = fx.matrix(spark, sf)
        return fx.rounded(op(mat, reshape.reverse(mat, 3)), "value")


_self_flip("d1_add_4d", "a.v + b.v", algebra.add)
_self_flip("d3_subtract_4d", "a.v - b.v", algebra.subtract)
_self_flip("d5_dot_multiply_4d", "a.v * b.v", algebra.dot_multiply)
_self_flip("d7_dot_divide_4d", "a.v / nullif(b.v, 0)", algebra.dot_divide)


@query("d2_add_number", fx.sql(f"SELECT {_IDS}, round(v + 2.5e0, 9) AS value FROM cell", "cell"))
def add_number(spark, sf):
    return fx.rounded(algebra.add(fx.matrix(spark, sf), 2.5), "value")


@query("d4_subtract_number", fx.sql(f"SELECT {_IDS}, round(v - 2, 9) AS value FROM cell", "cell"))
def subtract_number(spark, sf):
    return fx.rounded(algebra.subtract(fx.matrix(spark, sf), 2), "value")


@query(
    "d6_dot_multiply_2d",
    f"WITH {_LINE} SELECT q.i AS id_3, q.j AS id_4, round(q.v * p.v, 6) + 0 AS value FROM q JOIN p USING (i, j)",
)
def dot_multiply_2d(spark, sf):
    left = lineitem_matrix(spark, sf, "l_quantity")
    right = lineitem_matrix(spark, sf, "l_tax")
    return fx.rounded(algebra.dot_multiply_2d(left, right), "value", digits=6)


def _month(column: str):
    return (F.year(column) * 12 + F.month(column)).cast("long")


@query(
    "d8_multiply_2d",
    """WITH a AS (SELECT l_suppkey AS i, l_partkey % 50 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
            b AS (SELECT l_partkey % 50 AS k, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS j,
                         sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
       SELECT -1::BIGINT AS id_1, -1::BIGINT AS id_2, i AS id_3, j AS id_4, round(sum(a.v * b.v), 4) AS value
       FROM a JOIN b USING (k) GROUP BY i, j""",
)
def multiply_2d(spark, sf):
    """Supplier × part bucket times part bucket × ship month."""
    items = fx.table(spark, sf, "lineitem")
    bucket = F.col("l_partkey") % 50
    left = items.groupBy(F.col("l_suppkey").alias("id_3"), bucket.alias("id_4")).agg(F.sum("l_quantity").alias("value"))
    right = items.groupBy(bucket.alias("id_3"), _month("l_shipdate").alias("id_4")).agg(
        F.sum("l_quantity").alias("value")
    )
    return fx.rounded(algebra.multiply_2d(left, right), "value", digits=4)


@query(
    "d8_multiply_2d_self",
    """WITH a AS (SELECT l_suppkey AS i, l_partkey % 20 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
       SELECT -1::BIGINT AS id_1, -1::BIGINT AS id_2, a.i AS id_3, b.i AS id_4, round(sum(a.v * b.v), 4) AS value
       FROM a JOIN a b USING (k) GROUP BY a.i, b.i""",
)
def multiply_2d_self(spark, sf):
    """A matrix times its own transpose, heavy inner indices split."""
    items = fx.table(spark, sf, "lineitem")
    mat = items.groupBy(F.col("l_suppkey").alias("id_3"), (F.col("l_partkey") % 20).alias("id_4")).agg(
        F.sum("l_quantity").alias("value")
    )
    flipped = mat.select(F.col("id_4").alias("id_3"), F.col("id_3").alias("id_4"), "value")
    return fx.rounded(algebra.multiply_2d(mat, flipped), "value", digits=4)


@query(
    "d8_multiply_skewed",
    """WITH r AS (SELECT l_orderkey, l_suppkey, l_quantity, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey END AS k FROM lineitem),
            a AS (SELECT l_orderkey AS i, k, sum(l_quantity) AS v FROM r GROUP BY 1, 2),
            b AS (SELECT k, l_suppkey AS j, count(*) AS v FROM r GROUP BY 1, 2)
       SELECT j AS id_4, count(DISTINCT i) AS orders, round(sum(a.v * b.v), 4) AS value FROM a JOIN b USING (k) GROUP BY j""",
)
def multiply_skewed(spark, sf):
    """Orders × parts times parts × suppliers, where every order holds one and the same part."""
    items = fx.table(spark, sf, "lineitem").withColumn("k", F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_partkey")).cast("long"))
    left = items.groupBy(F.col("l_orderkey").alias("id_3"), F.col("k").alias("id_4")).agg(F.sum("l_quantity").alias("value"))
    right = items.groupBy(F.col("k").alias("id_3"), F.col("l_suppkey").alias("id_4")).agg(F.count("*").cast("double").alias("value"))
    product = algebra.multiply_2d(left, right)
    return fx.rounded(product.groupBy("id_4").agg(F.count("*").alias("orders"), F.sum("value").alias("value")), "value", digits=4)


@query(
    "d8_multiply_tiled",
    """WITH a AS (SELECT l_suppkey AS i, l_partkey // 4 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
       SELECT -1::BIGINT AS id_1, -1::BIGINT AS id_2, a.i AS id_3, b.i AS id_4, round(sum(a.v * b.v), 4) AS value
       FROM a JOIN a b USING (k) GROUP BY a.i, b.i""",
)
def multiply_tiled(spark, sf):
    """Suppliers by the parts they share, as a product of tiles."""
    items = fx.table(spark, sf, "lineitem")
    mat = items.groupBy(F.col("l_suppkey").alias("id_3"), F.floor(F.col("l_partkey") / 4).alias("id_4")).agg(
        F.sum("l_quantity").alias("value")
    )
    flipped = mat.select(F.col("id_4").alias("id_3"), F.col("id_3").alias("id_4"), "value")
    return fx.rounded(algebra.multiply_tiled(mat, flipped), "value", digits=4)


@query(
    "d8_multiply_batched",
    fx.sql(
        """SELECT a.img AS id_1, a.unit::BIGINT AS id_2, a.y::BIGINT AS id_3, b.x::BIGINT AS id_4,
                  round(sum(a.v * b.v), 9) + 0 AS value
           FROM cell a JOIN cell b ON a.img = b.img AND a.unit = b.unit AND a.x = b.y
           GROUP BY a.img, a.unit, a.y, b.x""",
        "cell",
    ),
)
def multiply_batched(spark, sf):
    mat = fx.matrix(spark, sf)
    return fx.rounded(algebra.multiply_batched(mat, mat), "value")


@query(
    "d9_shape_check",
    fx.sql(
        """SELECT count(*) AS cells, (SELECT count(*) FROM (SELECT max(img) FROM cell) a
             JOIN (SELECT max(img) FROM cell WHERE img < 100) b ON true) > 0 AS differs FROM cell""",
        "cell",
    ),
)
def shape_check(spark, sf):
    """A tensor has its own shape, and not that of its first images."""
    mat = fx.matrix(spark, sf)
    algebra.require_same_shape(mat, reshape.reverse(mat, 1))
    try:
        algebra.require_same_shape(mat, reshape.first_images(mat, 100))
        differs = False
    except ValueError:
        differs = True
    return mat.agg(F.count("*").alias("cells"), F.lit(differs).alias("differs"))


@query(
    "d10_threshold_join",
    fx.sql("SELECT img, unit, y, x, round(v, 9) AS v FROM cell JOIN thr USING (unit) WHERE v > t", "thr"),
)
def threshold_join(spark, sf):
    kept = reduce.over_threshold(fx.cells(spark, sf), fx.thresholds(spark, sf))
    return fx.rounded(kept.select("img", "unit", "y", "x", "v"), "v")


@query(
    "d11_image_lookup",
    """SELECT 'vec_' || vec_id || '.jpg' AS image, vec_id AS img, 'data/images/vec_' || vec_id || '.jpg' AS path,
              CASE WHEN vec_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, 4 AS sh, 4 AS sw,
              CASE WHEN label NOT IN (0, 3, 6, 9) THEN label + 6 END AS scene
       FROM embeddings JOIN orders ON o_orderkey = vec_id""",
)
def image_lookup(spark, sf):
    """File names from another table, their metadata, path and scene label."""
    from unitscope.sources.labels import find_images

    files = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("vec_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("image")
    )
    found = find_images(fx.images(spark, sf), files, "data")
    scene = fx.scalars(spark, sf).select("img", F.col("label").alias("scene"))
    return found.join(scene, "img", "left").select("image", "img", "path", "split", "sh", "sw", "scene")
