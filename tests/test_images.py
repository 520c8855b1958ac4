import numpy as np
import pytest
from pyspark.sql import functions as F

from unitscope.functions import location_name
from unitscope.functions.text import two_decimals
from unitscope.operators import activation, images, resample
from unitscope.session import scratch
from unitscope.sources import images as files
from unitscope.sources import store


def _cells(spark, maps):
    rows = [(i, u, int(y), int(x), float(m[y, x])) for (i, u), m in maps.items() for y, x in np.ndindex(m.shape)]
    return spark.createDataFrame(rows, "img int, unit int, y int, x int, v double")


def _dense(df, height, width):
    out = {}
    for r in df.collect():
        out.setdefault((r.img, r.unit), np.full((height, width), np.nan))[r.py, r.px] = r.v
    return out


@pytest.fixture(scope="module")
def maps():
    rng = np.random.default_rng(4)
    return {(i, u): rng.normal(size=(4, 5)) for i in range(2) for u in range(2)}


def test_blocks_and_cells_agree(spark, maps):
    cells = _cells(spark, maps)
    back = resample.blocks_to_cells(resample.cells_to_blocks(cells))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


@pytest.mark.parametrize("size", [(4, 5), (9, 11), (28, 10)])
def test_block_form_equals_weight_tables(spark, maps, size):
    cells = _cells(spark, maps)
    wide = resample.resample(cells, resample.bilinear_weights(spark, 4, size[0]), resample.bilinear_weights(spark, 5, size[1]))
    a = _dense(wide, *size)
    b = _dense(resample.enlarge_blocks(resample.cells_to_blocks(cells), *size), *size)
    assert a.keys() == b.keys() == maps.keys()
    for key in a:
        assert np.allclose(a[key], b[key], atol=1e-12)
        assert a[key].max() <= maps[key].max() + 1e-12


def test_shrinking_weights_are_normalised(spark):
    sums = resample.bilinear_weights(spark, 256, 224).groupBy("o").agg(F.sum("w").alias("s"))
    assert sums.where("abs(s - 1) > 1e-12").count() == 0


def test_linear_field_map(spark, maps):
    field = resample.FieldMap((0, 0), (4, 4), (4, 4))
    got = _dense(resample.upsample_linear(_cells(spark, maps), (4, 5), field), 16, 20)
    cy, cx = 2 + 4 * np.arange(4), 2 + 4 * np.arange(5)
    for key, m in maps.items():
        rows = np.stack([np.interp(np.arange(16), cy, m[:, j]) for j in range(5)], axis=1)
        want = np.stack([np.interp(np.arange(20), cx, rows[i]) for i in range(16)])
        assert np.allclose(got[key], want, atol=1e-12)


def test_cubic_spline_reproduces_cubics(spark):
    field = resample.FieldMap((0, 0), (3, 3), (3, 3))
    centers = np.array(field.centers(0, 6))

    def cubic(t):
        return 0.02 * t**3 - 0.3 * t**2 + t - 2

    m = cubic(centers)[:, None] * np.ones(6)
    got = _dense(resample.upsample_cubic(_cells(spark, {(0, 0): m}), (6, 6), field), 18, 18)[0, 0]
    points = np.clip(np.arange(18.0), centers[0], centers[-1])
    assert np.allclose(got[:, 5], cubic(points), atol=1e-9)
    with pytest.raises(ValueError):
        resample.cubic_weights(spark, [0, 1, 2], 3)


def test_resampling_groups_no_pixels(spark):
    """Equal places add up, maps without a number stay null, what no cell reaches has no row; nothing is grouped."""
    rows = [(0, 0, 0, 0, 1.0), (0, 0, 0, 0, 2.0), (0, 0, 0, 1, None), (0, 0, 5, 0, 7.0), (None, 0, 0, 1, 4.0), (2, 1, 0, 0, None)]
    rows += [(i, 0, 0, x, float(i + x)) for i in range(10, 30) for x in range(2)]
    cells = spark.createDataFrame(rows, "img int, unit int, y int, x int, v double").repartition(7)
    both = resample._table(spark, [(0, 0, 1.0), (1, 0, 0.5), (2, 1, 1.0)])
    got = resample.resample(cells, both, resample._table(spark, [(0, 0, 1.0), (1, 0, 0.5), (1, 1, 0.5)]))
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.schema == spark.createDataFrame([], "img int, unit int, py int, px int, v double").schema
    out = {tuple(r)[:4]: r.v for r in got.collect()}
    want = {(0, 0, 0, 0): 3.0, (0, 0, 0, 1): 1.5, (0, 0, 1, 0): 1.5, (0, 0, 1, 1): 0.75, (None, 0, 0, 1): 2.0, (None, 0, 1, 1): 1.0}
    want |= {(2, 1, y, x): None for y in range(2) for x in range(2)}
    for i in range(10, 30):
        want |= {(i, 0, y, x): (i + x / 2) / (y + 1) for y in range(2) for x in range(2)}
    assert out == want


def test_percentile_masks_join_no_pixels(spark, maps):
    """Pixels beyond every kernel count as 0; the limit is the percentile of all pixels of all maps."""
    field = resample.FieldMap((0, 0), (6, 6), (6, 6))
    mask = resample.blur_masks(_cells(spark, maps), (4, 5), field, (24, 30), percentile=90)
    assert "Join [img" not in mask._jdf.queryExecution().executedPlan().toString()
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / 0.6) ** 2)
    kernel /= kernel.sum()
    whole = {}
    for key, m in maps.items():
        whole[key] = np.zeros((24, 30))
        for y, x in np.ndindex(m.shape):
            whole[key][1 + 6 * y : 6 + 6 * y, 1 + 6 * x : 6 + 6 * x] += m[y, x] * np.outer(kernel, kernel)
    limit = np.percentile(np.stack(list(whole.values())), 90)
    got = _dense(mask, 24, 30)
    for key, v in whole.items():
        assert np.array_equal(~np.isnan(got[key]), v > limit)
        assert np.allclose(got[key][v > limit], v[v > limit], atol=1e-12)


def test_gaussian_spreads_the_mass(spark):
    field = resample.FieldMap((0, 0), (9, 9), (9, 9))
    m = np.zeros((7, 7))
    m[3, 3] = 1.5
    got = _dense(resample.upsample_gaussian(_cells(spark, {(0, 0): m}), (7, 7), field), 63, 63)[0, 0]
    assert np.nansum(got) == pytest.approx(1.5 * 81, rel=1e-9)
    assert np.unravel_index(np.nanargmax(got), got.shape) == (31, 31)


def test_field_rectangles_and_crops(spark):
    field = resample.FieldMap((-2, -1), (4, 3), (2, 2))
    assert field.output_size(0, 3) == 2 * 2 + 4 - 4
    image = np.arange(1.0, 31.0).reshape(5, 6)
    pixels = _cells(spark, {(0, 0): image}).withColumnRenamed("unit", "ch")
    at = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 2, 2)], "img int, rect int, y int, x int")
    rects = resample.field_rectangle(at, field).select("img", "rect", "y0", "x0", "rh", "rw")
    got = {(r.rect, r.cy, r.cx): r.v for r in resample.crop_rectangles(pixels, rects).collect()}
    assert len(got) == 2 * 12
    padded = np.pad(image, 8)
    for (rect, cy, cx), v in got.items():
        y0, x0 = {0: (-2, -1), 1: (2, 3)}[rect]
        assert v == padded[8 + y0 + cy, 8 + x0 + cx]


def test_normalise_matches_the_two_step_form(spark):
    rgb = np.random.default_rng(0).integers(0, 256, size=(2, 3, 3)).astype(float)
    rows = [(0, c, y, x, float(rgb[y, x, c])) for y in range(2) for x in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "img int, ch int, y int, x int, v double")
    bgr = (rgb[..., ::-1] - images.BGR_MEAN).transpose(2, 0, 1)
    want = bgr[::-1] / (255.0 * 0.224)
    for r in images.normalise(df).collect():
        assert r.v == pytest.approx(want[r.ch, r.y, r.x], abs=1e-12)


def test_png_round_trip(spark):
    rng = np.random.default_rng(1)
    pixels = {f"s{i}.png": rng.integers(0, 256, size=(3, 4, 3)) for i in range(3)}
    df = spark.createDataFrame([(f, 3, 4, a.ravel().tolist()) for f, a in pixels.items()], "file string, height int, width int, rgb array<int>")
    path = scratch(spark, "png-test")
    assert files.write_png(df, path) == 3
    found = files.read_images(spark, path)
    assert found.count() == 3
    for r in files.label_pixels(found).collect():
        a = pixels[r.file]
        assert r.label == a[r.y, r.x, 0] + 256 * a[r.y, r.x, 1]


def test_extraction_and_nan_guard(spark):
    df = spark.createDataFrame([(i, [float(i)] * 4) for i in range(6)], "img long, values array<double>")

    def model(batch):
        assert batch.shape[1:] == (1, 2, 2)
        maps = np.repeat(batch, 3, axis=1) + np.arange(3)[None, :, None, None]
        maps[batch[:, 0, 0, 0] >= 4] = np.nan
        return {"maps": maps, "flat": maps.max(axis=(2, 3))}

    def better(batch):
        out = model(np.where(batch == 4.0, 0.0, batch))
        return out

    rows = images.extract_features(df, model, (1, 2, 2)).where("layer = 'maps' and img = 1").collect()
    assert {(r.unit, r.max_v, tuple(r["values"])) for r in rows} == {(u, 1.0 + u, (1.0 + u,) * 4) for u in range(3)}
    good, failed = images.extract_guarded(df, model, (1, 2, 2), retry=better)
    assert sorted(r.img for r in good.select("img").distinct().collect()) == [0, 1, 2, 3, 4]
    assert [r.img for r in failed.collect()] == [5]


def test_rates_of_silent_maps_are_zero(spark):
    blocks = spark.createDataFrame([(0, 0, 2, 2, [1.0, 0.0, 0.0, 0.0]), (0, 1, 2, 2, [-1.0] * 4), (1, 0, 2, 2, [2.0] * 4)], "img long, unit int, h int, w int, values array<double>")
    limits = spark.createDataFrame([(0, 0.5), (1, 0.0)], "unit int, thresh double")
    got = {(r.img, r.unit): r.rate for r in activation.activation_rates(blocks, limits, 4, 4).collect()}
    assert got == {(0, 0): 4 / 16, (0, 1): 0.0, (1, 0): 1.0}
    top = activation.strongest_units(blocks, limits, 4, 4, n=1, rate_area=64).collect()
    assert {(r.img, r.unit, r.rate) for r in top} == {(0, 0, 4 / 64), (1, 0, 16 / 64)}


def test_details_let_the_last_unit_win(spark):
    features = spark.createDataFrame([(0, 0, "sky", 0.9), (0, 3, "sky", 0.2), (0, 1, "sea", 0.5), (0, 2, "tree", 0.0)], "img int, unit int, label string, feature double")
    classes = spark.createDataFrame([(0, "beach")], "img int, class string")
    row = activation.feature_details(features, classes).first()
    assert [(d.name, d.value) for d in row.details] == [("beach", 100.0), ("sea", 0.5), ("sky", 0.2)]


def test_location_name(spark):
    df = spark.createDataFrame([("a_1.jpg", 0.125, "sky", 3), ("b.jpg", 0.378, "sea", 12)], "f string, r double, l string, u int")
    got = [r[0] for r in df.select(location_name(F.col("f"), F.col("r"), F.col("l"), F.col("u"))).collect()]
    assert got == ["a_1_0.12_sky_3", "b_0.38_sea_12"]


def test_load_or_compute_runs_once(spark):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("m", "l", 1)], "model string, layer string, img int")

    path = scratch(spark, "once")
    for _ in range(2):
        assert store.load_or_compute(spark, path, compute, ["model", "layer"]).first().img == 1
    assert len(calls) == 1


def test_features_are_stored_by_layer(spark):
    df = spark.range(40).select(
        F.lit("m").alias("model"), F.concat(F.lit("l"), (F.col("id") % 2).cast("string")).alias("layer"),
        F.col("id").alias("img"), F.lit(0).alias("unit"), F.array(F.lit(0.5)).alias("values"),
    )
    path = scratch(spark, "by-layer")
    store.save_features(df, path)
    assert store.is_complete(spark, path) and not store.is_complete(spark, path + "-other")
    one = spark.read.parquet(path).where("layer = 'l1'")
    assert one.count() == 20
    assert "PartitionFilters: [isnotnull(layer" in one._jdf.queryExecution().executedPlan().toString()


def test_unreadable_files_are_reported(spark, tmp_path):
    folders = [tmp_path / "a", tmp_path / "b"]
    for n, folder in enumerate(folders):
        rows = [("x.png", 2, 3, [10 * n + 1] * 18)]
        files.write_png(spark.createDataFrame(rows, "file string, height int, width int, rgb array<int>"), str(folder))
    (tmp_path / "a" / "broken.png").write_bytes(b"no image")
    found = files.read_images(spark, str(tmp_path / "a"))
    assert {r["file"] for r in found.collect()} == {"x.png", "broken.png"}
    assert [r["file"] for r in files.unreadable(found).collect()] == ["broken.png"]
    assert files.image_pixels(found).count() == 6
    both = files.read_images(spark, f"{tmp_path}/[ab]")
    assert both.count() == 3


def test_two_decimals_are_exact(spark):
    values = [0.025, 0.005, 0.015, 0.125, 0.375, 0.995, 1.005, 0.0, 0.3, 1.0, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(two_decimals(F.col("v"))).collect()]
    assert got == ["%.2f" % v for v in values]


def test_shrinking_maps_use_the_wide_filter(spark):
    rng = np.random.default_rng(8)
    for (h, w), (oh, ow) in (((8, 8), (3, 3)), ((8, 5), (3, 7)), ((4, 9), (6, 4)), ((7, 7), (7, 7))):
        data = rng.normal(size=(h, w))
        blocks = spark.createDataFrame([(0, 0, h, w, data.ravel().tolist())], "img int, unit int, h int, w int, values array<double>")
        got = np.zeros((oh, ow))
        for r in resample.enlarge_blocks(blocks, oh, ow).collect():
            got[r["py"], r["px"]] = r["v"]
        want = np.zeros((oh, ow))
        rows, cols = (
            {(r["o"], r["i"]): r["w"] for r in resample.bilinear_weights(spark, a, b).toDF("o", "i", "w").collect()} for a, b in ((h, oh), (w, ow))
        )
        for (y, i), p in rows.items():
            for (x, j), q in cols.items():
                want[y, x] += p * q * data[i, j]
        assert np.allclose(got, want)
