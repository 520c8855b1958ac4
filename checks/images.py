"""Image jobs and spatial resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import query
from unitscope.operators import images, resample
from unitscope.operators.layout import bounded
from unitscope.session import scratch
from unitscope.sources import images as files

_MEANS = "[124.6901::DOUBLE, 118.6897::DOUBLE, 109.5388::DOUBLE]"


@query(
    "l1_normalised_images",
    fx.sql(f"SELECT img, ch, y, x, round((v - {_MEANS}[ch + 1]) / 57.12e0, 9) AS v FROM pix", "pix"),
)
def normalised_images(spark, sf):
    return fx.rounded(images.normalise(fx.pixels(spark, sf)), "v")


@query(
    "l1_grey_images",
    fx.sql(
        f"""SELECT img, c::INT AS ch, y, x, round((v - {_MEANS}[c + 1]) / 57.12e0, 9) AS v
            FROM pix, range(3) t(c) WHERE ch = 0""",
        "pix",
    ),
)
def grey_images(spark, sf):
    grey = fx.pixels(spark, sf).where("ch = 0")
    return fx.rounded(images.normalise(images.grey_to_rgb(grey)).select("img", "ch", "y", "x", "v"), "v")


def _shrink(n_in: int, n_out: int, name: str) -> str:
    """Triangle filter weights, widened for shrinking."""
    scale = n_in / n_out
    reach = max(scale, 1.0)
    raw = f"greatest(0, 1 - abs(i + 0.5e0 - (o + 0.5e0) * {scale}::DOUBLE) / {reach}::DOUBLE)"
    return f"""{name} AS (SELECT o, i, r / sum(r) OVER (PARTITION BY o) AS w FROM (
      SELECT o, i, {raw} AS r FROM range({n_out}) a(o), range({n_in}) b(i)) WHERE r > 0)"""


def _after(base: str, extra: str, select: str) -> str:
    return base.rstrip() + f",\n{extra}\n{select}"


@query(
    "l2_resized_images",
    _after(
        fx.sql("", "pix"),
        _shrink(8, 6, "w"),
        """SELECT img, ch, a.o::INT AS y, b.o::INT AS x,
                  least(greatest(floor(round(sum(v * a.w * b.w), 9) + 0.5e0), 0), 255)::INT AS v
           FROM pix JOIN w a ON a.i = y JOIN w b ON b.i = x GROUP BY img, ch, a.o, b.o""",
    ),
)
def resized_images(spark, sf):
    """Eight to six pixels a side; halves are rounded alike by rounding sums first."""
    return images.resize(fx.pixels(spark, sf), (8, 8), (6, 6))


#: Fixed kernel of the convolution used as a model: one 3 × 3 filter per unit.
_KERNELS = np.array([[[1, 0, -1], [2, 0, -2], [1, 0, -1]], [[0, 1, 0], [1, -4, 1], [0, 1, 0]]], dtype=float)


def _convolution(broken_over: float | None = None):
    """A stride-2 convolution of the first channel and its spatial mean; NaN for images
    whose first value is over a limit. A closure, so tasks need not import this module."""
    kernels = _KERNELS

    def model(batch: np.ndarray) -> dict[str, np.ndarray]:
        windows = np.lib.stride_tricks.sliding_window_view(batch[:, 0], (3, 3), axis=(1, 2))[:, ::2, ::2]
        maps = np.einsum("nhwij,uij->nuhw", windows, kernels)
        if broken_over is not None:
            maps[batch[:, 0, 0, 0] > broken_over] = np.nan
        return {"conv": maps, "mean": maps.mean(axis=(2, 3))}

    return model


def _flat_images(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    return vectors.select(F.col("vec_id").alias("img"), F.col("embedding").cast("array<double>").alias("values"))


_KERNEL_SQL = "kern(u, i, j, k) AS (VALUES " + ", ".join(
    f"({u}, {i}, {j}, {_KERNELS[u, i, j]}::DOUBLE)" for u in range(2) for i in range(3) for j in range(3)
) + ")"
_PLAIN = """plain AS (SELECT vec_id AS img, p // 8 AS y, p % 8 AS x, embedding[p + 1]::DOUBLE AS v
  FROM embeddings, range(64) t(p))"""
_CONV = f"""WITH {_PLAIN}, {_KERNEL_SQL}, conv AS (
  SELECT img, u, oy, ox, sum(v * k) AS v FROM range(3) a(oy), range(3) b(ox), kern
  JOIN plain ON y = oy * 2 + i AND x = ox * 2 + j GROUP BY img, u, oy, ox)"""


@query(
    "l3_extracted_features",
    f"""{_CONV}
        SELECT img, 'conv' AS layer, u AS unit, (oy * 3 + ox)::INT AS p, round(v, 6) + 0 AS v FROM conv
        UNION ALL SELECT img, 'mean', u, 0, round(avg(v), 6) + 0 FROM conv GROUP BY img, u""",
)
def extracted_features(spark, sf):
    features = images.extract_features(_flat_images(spark, sf), _convolution(), (1, 8, 8))
    flat = features.select("img", "layer", "unit", F.posexplode("values").alias("p", "v"))
    return fx.rounded(flat, "v", digits=6)


@query(
    "l3_feature_maxima",
    f"{_CONV} SELECT img, 'conv' AS layer, u AS unit, round(max(v), 6) + 0 AS max_v FROM conv GROUP BY img, u",
)
def feature_maxima(spark, sf):
    features = images.extract_features(_flat_images(spark, sf), _convolution(), (1, 8, 8)).where("layer = 'conv'")
    return fx.rounded(features.select("img", "layer", "unit", "max_v"), "max_v", digits=6)


_FILES = f"""WITH pix AS (
  SELECT vec_id AS img, ch::INT AS ch, (p // 8) AS y, (p % 8) AS x,
         ((floor((embedding[p + 1]::DOUBLE + 1) * 100) + ch * 20) % 256)::DOUBLE AS v
  FROM embeddings, range(64) t(p), range(3) u(ch)
), input AS (SELECT img, y, x, (v - {_MEANS}[1]) / 57.12e0 AS v FROM pix WHERE ch = 0
), {_KERNEL_SQL}, conv AS (
  SELECT img, u, oy, ox, sum(v * k) AS v FROM range(3) a(oy), range(3) b(ox), kern
  JOIN input ON y = oy * 2 + i AND x = ox * 2 + j GROUP BY img, u, oy, ox)"""


@query(
    "l3_features_of_files",
    f"{_FILES} SELECT img, 'conv' AS layer, u AS unit, round(max(v), 6) + 0 AS max_v FROM conv GROUP BY img, u",
)
def features_of_files(spark, sf):
    """Image files to feature maxima, in two runs: the second finds the first third of the ranges done."""
    from unitscope.plans.job import file_features

    folder, path = scratch(spark, "photos"), scratch(spark, "features")
    name = F.concat(F.lit("p"), F.col("img").cast("string"), F.lit(".png"))
    files.save_pixels(fx.pixels(spark, sf).withColumn("file", name), folder)
    listed = fx.images(spark, sf).select("img", name.alias("image"))
    size = max(1, listed.count() // 9)
    first = listed.where(F.col("img") < 3 * size)
    file_features(spark, first, folder, path, _convolution(), (8, 8), "*.png", size, jobs=2)
    features, _ = file_features(spark, listed, folder, path, _convolution(), (8, 8), "*.png", size, jobs=2)
    conv = features.where("layer = 'conv'")
    return fx.rounded(conv.select("img", "layer", "unit", "max_v"), "max_v", digits=6)


@query(
    "l2_saved_images",
    _after(
        fx.sql("", "pix"),
        _shrink(8, 6, "w"),
        """SELECT 'p' || img || '.png' AS file, ch, a.o::INT AS y, b.o::INT AS x,
                  least(greatest(floor(round(sum(v * a.w * b.w), 9) + 0.5e0), 0), 255)::INT AS v
           FROM pix JOIN w a ON a.i = y JOIN w b ON b.i = x GROUP BY img, ch, a.o, b.o""",
    ),
)
def saved_images(spark, sf):
    """Resized images written as files and read again."""
    folder = scratch(spark, "resized")
    name = F.concat(F.lit("p"), F.col("img").cast("string"), F.lit(".png"))
    files.save_pixels(images.resize(fx.pixels(spark, sf), (8, 8), (6, 6)).withColumn("file", name), folder)
    back = files.image_pixels(files.read_images(spark, folder))
    return back.select("file", F.posexplode(F.array("r", "g", "b")).alias("ch", "v"), "y", "x")


@query(
    "l4_nan_guard",
    "SELECT vec_id AS img, CASE WHEN embedding[1]::DOUBLE > 0.2e0 THEN 'failed' ELSE 'valid' END AS state FROM embeddings",
)
def nan_guard(spark, sf):
    """Images with NaN outputs run once more; those still invalid are listed."""
    good, failed = images.extract_guarded(_flat_images(spark, sf), _convolution(0.1), (1, 8, 8), retry=_convolution(0.2))
    valid = good.select("img").distinct().withColumn("state", F.lit("valid"))
    return valid.unionByName(failed.withColumn("state", F.lit("failed")))


@query(
    "l5_highlighted_images",
    fx.sql(
        """SELECT pix.img, unit, ch, pix.y, pix.x,
                  round((CASE WHEN up.v > t THEN 1 ELSE 0 END * 0.8e0 + 0.2e0) * pix.v, 6) AS v
           FROM up JOIN thr USING (unit) JOIN pix ON pix.img = up.img AND pix.y = up.py AND pix.x = up.px""",
        "up",
        "thr",
        "pix",
    ),
)
def highlighted_images(spark, sf):
    grown = resample.enlarge_blocks(fx.blocks(spark, sf), fx.GRID, fx.GRID)
    on = grown.join(bounded(fx.thresholds(spark, sf)), "unit")
    mask = on.withColumn("mask", (F.col("v") > F.col("thresh")).cast("double"))
    return fx.rounded(images.highlight(fx.pixels(spark, sf), mask), "v", digits=6)


@query("m1_bilinear_blocks", fx.sql("SELECT img, unit, py, px, round(v, 9) AS v FROM up", "up"))
def bilinear_blocks(spark, sf):
    return fx.rounded(resample.enlarge_blocks(fx.blocks(spark, sf), fx.GRID, fx.GRID), "v")


@query(
    "m1_bilinear_cells",
    _after(
        fx.sql("", "cell"),
        _shrink(2, 5, "w"),
        """SELECT img, unit, a.o::INT AS py, b.o::INT AS px, round(sum(v * a.w * b.w), 9) + 0 AS v
           FROM cell JOIN w a ON a.i = y JOIN w b ON b.i = x GROUP BY img, unit, a.o, b.o""",
    ),
)
def bilinear_cells(spark, sf):
    weights = resample.bilinear_weights(spark, fx.SIDE, 5)
    return fx.rounded(resample.resample(fx.cells(spark, sf), weights, weights), "v")


def _single_unit(spark, sf):
    """Each vector as one unit map of 8 × 8."""
    vectors = fx.table(spark, sf, "embeddings")
    return vectors.select(F.col("vec_id").alias("img"), F.lit(0).alias("unit"), F.posexplode("embedding").alias("p", "v")).select(
        "img",
        "unit",
        F.floor(F.col("p") / 8).cast("int").alias("y"),
        (F.col("p") % 8).cast("int").alias("x"),
        F.col("v").cast("double").alias("v"),
    )


#: Field maps of the queries: offset, size, step.
_WIDE = resample.FieldMap((0, 0), (4, 4), (4, 4))
_THIN = resample.FieldMap((0, 0), (2, 2), (2, 2))

_LINEAR = """wl AS (SELECT o, i, w FROM (
  SELECT o, i, greatest(0, 1 - abs(greatest(least(o, 6), 2) - (2 + 4 * i)) / 4) AS w FROM range(8) a(o), range(2) b(i))
  WHERE w > 0)"""


def _weighted(extra: str, name: str) -> str:
    return _after(
        fx.sql("", "cell"),
        extra,
        f"""SELECT img, unit, a.o::INT AS py, b.o::INT AS px, round(sum(v * a.w * b.w), 9) + 0 AS v
            FROM cell JOIN {name} a ON a.i = y JOIN {name} b ON b.i = x GROUP BY img, unit, a.o, b.o""",
    )


@query("m2_field_map_bilinear", _weighted(_LINEAR, "wl"))
def field_map_bilinear(spark, sf):
    return fx.rounded(resample.upsample_linear(fx.cells(spark, sf), (2, 2), _WIDE), "v")


def _spline_table(knots: np.ndarray, n_out: int) -> np.ndarray:
    """Weights of the spline, found from its definition: one cubic per interval through
    both ends, equal slopes and curvatures at inner knots, and equal third derivatives at
    the second and the last but one."""
    n, pieces = len(knots), len(knots) - 1

    def power(t: float, order: int) -> np.ndarray:
        table = [[1, t, t**2, t**3], [0, 1, 2 * t, 3 * t**2], [0, 0, 2, 6 * t], [0, 0, 0, 6]]
        return np.array(table[order], dtype=float)

    rows, right = [], []

    def equation(parts: dict[int, np.ndarray], unit: int | None) -> None:
        row = np.zeros(4 * pieces)
        for piece, values in parts.items():
            row[4 * piece : 4 * piece + 4] = values
        rows.append(row)
        right.append(np.eye(n)[unit] if unit is not None else np.zeros(n))

    width = np.diff(knots)
    for p in range(pieces):
        equation({p: power(0.0, 0)}, p)
        equation({p: power(width[p], 0)}, p + 1)
    for p in range(pieces - 1):
        orders = [1, 2] + ([3] if p in (0, pieces - 2) else [])
        for order in orders:
            equation({p: power(width[p], order), p + 1: -power(0.0, order)}, None)
    solved = np.linalg.solve(np.array(rows), np.array(right))
    out = []
    for t in np.clip(np.arange(n_out, dtype=float), knots[0], knots[-1]):
        p = min(max(int(np.searchsorted(knots, t, side="right")) - 1, 0), pieces - 1)
        out.append(power(t - knots[p], 0) @ solved[4 * p : 4 * p + 4])
    return np.array(out)


_SPLINE = _spline_table(1.0 + 2.0 * np.arange(8), 16)
_SPLINE_SQL = "ws(o, i, w) AS (VALUES " + ", ".join(
    f"({o}, {i}, {float(_SPLINE[o, i])!r}::DOUBLE)" for o in range(16) for i in range(8)
) + ")"


@query(
    "m3_bicubic",
    f"""WITH {_PLAIN}, {_SPLINE_SQL}
        SELECT img, 0 AS unit, a.o AS py, b.o AS px, round(sum(v * a.w * b.w), 9) + 0 AS v
        FROM plain JOIN ws a ON a.i = y JOIN ws b ON b.i = x GROUP BY img, a.o, b.o""",
)
def bicubic(spark, sf):
    return fx.rounded(resample.upsample_cubic(_single_unit(spark, sf), (8, 8), _THIN), "v")


def _gauss(sigma: float, gain: float, n_out: int) -> str:
    radius = int(4 * sigma + 0.5)
    kernel = f"exp(-0.5e0 * (o - (2 + 4 * i)) * (o - (2 + 4 * i)) / {sigma * sigma}::DOUBLE)"
    norm = f"(SELECT sum(exp(-0.5e0 * d * d / {sigma * sigma}::DOUBLE)) FROM range(-{radius}, {radius + 1}) t(d))"
    return f"""wg AS (SELECT o, i, {gain}::DOUBLE * {kernel} / {norm} AS w FROM range({n_out}) a(o), range(2) b(i)
               WHERE abs(o - (2 + 4 * i)) <= {radius})"""


@query("m4_gaussian", _weighted(_gauss(2.0, 4.0, 8), "wg"))
def gaussian(spark, sf):
    return fx.rounded(resample.upsample_gaussian(fx.cells(spark, sf), (2, 2), _WIDE), "v")


_BLUR = f"""{_gauss(0.4, 1.0, 8)},
blur AS (SELECT img, unit, a.o::INT AS py, b.o::INT AS px, sum(v * a.w * b.w) AS v
         FROM cell JOIN wg a ON a.i = y JOIN wg b ON b.i = x GROUP BY img, unit, a.o, b.o)"""


@query(
    "m5_blur_masks",
    _after(
        fx.sql("", "cell"),
        _BLUR,
        "SELECT img, unit, py, px, round(v, 9) AS v FROM blur WHERE v > (SELECT max(v) * 0.3e0 FROM blur)",
    ),
)
def blur_masks(spark, sf):
    return fx.rounded(resample.blur_masks(fx.cells(spark, sf), (2, 2), _WIDE, (8, 8), threshold=0.3), "v")


@query(
    "m5_blur_masks_percentile",
    _after(
        fx.sql("", "cell"),
        _BLUR
        + """, filled AS (SELECT g.img, g.unit, py::INT AS py, px::INT AS px, coalesce(v, 0) AS v
             FROM (SELECT DISTINCT img, unit FROM cell) g CROSS JOIN range(8) a(py) CROSS JOIN range(8) b(px)
             LEFT JOIN blur USING (img, unit, py, px))""",
        """SELECT img, unit, py, px, round(v, 9) AS v FROM filled
           WHERE v > (SELECT quantile_cont(v, 0.97) FROM filled)""",
    ),
)
def blur_masks_percentile(spark, sf):
    return fx.rounded(resample.blur_masks(fx.cells(spark, sf), (2, 2), _WIDE, (8, 8), percentile=97), "v")


_FIELD = resample.FieldMap((-3, -2), (7, 6), (4, 3))


@query(
    "m6_field_rectangles",
    fx.sql(
        """SELECT img, unit, y, x, y * 4 - 3 AS y0, x * 3 - 2 AS x0, 7 AS rh, 6 AS rw, y * 4 - 3 + 3 AS cy,
                  x * 3 - 2 + 3 AS cx FROM cell""",
        "cell",
    ),
)
def field_rectangles(spark, sf):
    return resample.field_rectangle(fx.cells(spark, sf).drop("v"), _FIELD)


@query(
    "m7_field_crops",
    fx.sql(
        """SELECT r.img, r.rect, ch, cy, cx, coalesce(v, 0) AS v FROM (
             SELECT vec_id AS img, (a * 2 + b)::INT AS rect, a * 4 - 3 AS y0, b * 3 - 2 AS x0, c::INT AS ch,
                    i::INT AS cy, j::INT AS cx
             FROM embeddings, range(2) p(a), range(2) q(b), range(3) s(c), range(7) t(i), range(6) u(j)) r
           LEFT JOIN pix USING (img, ch) WHERE pix.y = y0 + cy AND pix.x = x0 + cx
           UNION ALL
           SELECT vec_id, (a * 2 + b)::INT, c::INT, i::INT, j::INT, 0
           FROM embeddings, range(2) p(a), range(2) q(b), range(3) s(c), range(7) t(i), range(6) u(j)
           WHERE a * 4 - 3 + i NOT BETWEEN 0 AND 7 OR b * 3 - 2 + j NOT BETWEEN 0 AND 7""",
        "pix",
    ),
)
def field_crops(spark, sf):
    positions = fx.images(spark, sf).select("img").withColumn("y", F.explode(F.array(F.lit(0), F.lit(1))))
    positions = positions.withColumn("x", F.explode(F.array(F.lit(0), F.lit(1))))
    rects = resample.field_rectangle(positions, _FIELD).withColumn("rect", F.col("y") * 2 + F.col("x"))
    return resample.crop_rectangles(fx.pixels(spark, sf), rects.select("img", "rect", "y0", "x0", "rh", "rw"))


@query(
    "m8_center_grid",
    fx.sql("SELECT DISTINCT img, y, x, (0 + y * 2)::INT AS cy, (0 + x * 1)::INT AS cx FROM cell", "cell"),
)
def center_grid(spark, sf):
    shapes = fx.images(spark, sf).select("img", F.lit(2).alias("h"), F.lit(2).alias("w"))
    return resample.center_grid(shapes, _FIELD, reduction=2)
