"""Data sets on disk, resumed extraction, and the whole job against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitscope.operators import maps
from unitscope.operators.images import extract_features
from unitscope.plans.job import analyse
from unitscope.session import scratch
from unitscope.sources import dataset, store
from unitscope.sources import images as files

SIDE = 4
INDEX = [
    # image, object (paths or numbers), scene
    ("c.jpg", "m/0.png;m/1.png", "7"),
    ("a.jpg", "3;m/2.png", ""),
    ("b.jpg", "", "8;0;9"),
    ("none.jpg", "0;;0", "0"),
    ("gone.jpg", "m/none.png", "7"),
    ("wide.jpg", "m/wide.png", ""),
    ("broken.jpg", "m/broken.png;2", ""),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("concepts")
    rng = np.random.default_rng(3)
    grids = {f"m/{i}.png": rng.integers(0, 600, (SIDE, SIDE)) for i in range(3)}
    grids["m/wide.png"] = rng.integers(0, 6, (SIDE, 7))
    rows = [(f, *g.shape, np.stack([g % 256, g // 256, 0 * g], axis=-1).ravel().tolist()) for f, g in grids.items()]
    photos = {f"{n}.jpg": rng.integers(0, 256, (6, 5, 3)) for n in ("a", "b", "c")}
    rows += [(f, *p.shape[:2], p.ravel().tolist()) for f, p in photos.items()]
    files.write_png(spark.createDataFrame(rows, "file string, height int, width int, rgb array<int>"), str(root / "images"))
    (root / "images" / "m" / "broken.png").write_bytes(b"no image")
    lines = ["image,split,ih,iw,sh,sw,object,part,scene"] + [f"{i},train,6,{'x5' if i == 'b.jpg' else 5},{SIDE},{SIDE},{o},,{s}" for i, o, s in INDEX]
    (root / "index.csv").write_text("\n".join(lines) + "\n")
    (root / "category.csv").write_text("name,frequency\ncolor,1\nscene,2\nobject,3\n")
    names = [1, 2, 3, 4, 7, 8, 9, 300]
    (root / "label.csv").write_text("number,name,category,frequency,coverage,syns\n" + "".join(f"{n},n{n},object(1);scene(1),5,0.5,a;b\n" for n in names))
    (root / "c_object.csv").write_text("code,number,name,frequency,coverage\n" + "".join(f"{c},{n},n{n},5,0.3\n" for c, n in enumerate(names[:5], 1)))
    (root / "c_scene.csv").write_text("code,number,name,frequency,coverage\n1,7,n7,5,0.2\n2,8,n8,5,0.4\n3,1,n1,5,0.3\n")
    return root, grids, photos


@pytest.fixture(scope="module")
def data(spark, folder):
    return dataset.open_dataset(spark, str(folder[0]), ["object", "scene", "material"])


def test_images_are_numbered_in_index_order(data):
    got = [(r["img"], r["image"]) for r in data.images.orderBy("img").collect()]
    assert got == list(enumerate(["c.jpg", "a.jpg", "b.jpg", "gone.jpg", "wide.jpg", "broken.jpg"]))
    assert data.category_names() == ["scene", "object"]


def test_numbers_and_label_maps(data, folder):
    _, grids, _ = folder
    scalars = sorted((r["img"], r["category"], r["channel"], r["label"]) for r in data.scalars.collect())
    # all items of the index, label 0 as well; repeated separators hold nothing
    assert scalars == [(0, "scene", 0, 7), (2, "scene", 0, 8), (2, "scene", 1, 0), (2, "scene", 2, 9), (3, "scene", 0, 7)]
    maps_ = {(r["img"], r["channel"]): r["labels"] for r in data.channels.collect()}
    assert maps_ == {
        (0, 0): grids["m/0.png"].ravel().tolist(), (0, 1): grids["m/1.png"].ravel().tolist(),
        (1, 0): [3] * SIDE * SIDE, (1, 1): grids["m/2.png"].ravel().tolist(), (5, 1): [2] * SIDE * SIDE,
    }


def test_what_cannot_be_read_is_listed(data):
    got = {(r["image"], r["field"], r["value"], r["reason"]) for r in data.problems.collect()}
    assert got == {
        ("gone.jpg", "object", "m/none.png", "missing"), ("broken.jpg", "object", "m/broken.png", "unreadable"),
        ("wide.jpg", "object", "m/wide.png", "size differs from the index"), ("b.jpg", "iw", "x5", "not a whole number"),
    }


def test_label_maps_are_read_once(spark, folder, data):
    """A scan for the label maps and none for what is missing; unreadable ones have rows of nulls."""
    stored = files.read_images(spark, f"{folder[0]}/images", "*.png")
    out = {r["file"]: (r["height"], r["width"], r["labels"]) for r in files.label_maps(stored, every=True).collect()}
    want = {f: (*g.shape, g.ravel().tolist()) for f, g in folder[1].items()} | {"m/broken.png": (None, None, None)}
    assert out == want
    assert {r["file"] for r in files.label_maps(stored).collect()} == set(want) - {"m/broken.png"}


def test_one_scan_meets_label_maps_and_index(spark, folder, monkeypatch):
    scans, cut = [], dataset.cut

    def counted(df):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan image"))
        return cut(df)

    monkeypatch.setattr(dataset, "cut", counted)
    dataset.open_dataset(spark, str(folder[0]), ["object", "scene"])
    assert sum(scans) == 1


def test_all_categories_and_primary_ones(spark, folder, data):
    both = dataset.open_dataset(spark, str(folder[0]), ["object", "scene"], require_all=True)
    assert [r["image"] for r in both.images.orderBy("img").collect()] == ["c.jpg", "gone.jpg"]
    cats = {r["label"]: r["cat_idx"] for r in data.labelcat.collect()}
    # scene is 0, object 1; the larger coverage, then the higher number
    assert (cats[7], cats[8], cats[1], cats[2], cats[300], cats[5]) == (1, 0, 1, 1, 1, 1)
    assert data.labels.count() == 301
    with pytest.raises(ValueError):
        dataset.open_dataset(spark, str(folder[0]), ["material"])


def halves():
    """A model of its own, so that tasks need not import this module."""

    def model(batch):
        return {"mean": batch.reshape(len(batch), 3, 2, batch.shape[2] // 2, 2, -1).mean(axis=(3, 5))}

    return model


def test_the_whole_job_and_a_second_run(spark, folder, data):
    root, _, photos = folder
    path, calls, model = scratch(spark, "job"), spark.sparkContext.accumulator(0), halves()

    def counted(batch):
        calls.add(len(batch))
        return model(batch)

    def run():
        return analyse(spark, data, f"{root}/images", path, counted, "mean", (4, 4), q=0.5, size=2)

    report = run()
    got = {(r["img"], r["unit"]): r["values"] for r in report.features.collect()}
    assert calls.value == 3 and {k[0] for k in got} == {0, 1, 2}
    mean = np.array([124.6901, 118.6897, 109.5388])[:, None, None]
    for img, name in enumerate("cab"):
        small = np.clip(np.floor(np.round(maps.resize(photos[f"{name}.jpg"].transpose(2, 0, 1).astype(float), 4, 4), 9) + 0.5), 0, 255)
        want = model(((small - mean) / 57.12)[None])["mean"][0]
        for unit in range(3):
            assert got[img, unit] == pytest.approx(want[unit].ravel())
    assert {r["image"] for r in report.unreadable.collect()} == {"gone.jpg", "wide.jpg", "broken.jpg"}
    first = [tuple(r) for r in report.rendered.orderBy("rendered_pos").collect()]
    assert len(first) == 3
    before = calls.value
    assert [tuple(r) for r in run().rendered.orderBy("rendered_pos").collect()] == first and calls.value == before


def test_extraction_goes_on_where_it_broke(spark):
    path, seen = scratch(spark, "ranges"), spark.sparkContext.accumulator(0)
    images = spark.createDataFrame([(i, [float(i)] * 4) for i in range(100)], "img long, values array<double>")

    def compute(limit):
        def net(batch):
            if (batch[:, 0, 0, 0] >= limit).any():
                raise RuntimeError("out of memory")
            seen.add(len(batch))
            return {"max": batch.max(axis=(2, 3))}

        return lambda part: extract_features(part.coalesce(1), net, (1, 2, 2))

    with pytest.raises(Exception, match="out of memory"):
        store.compute_in_ranges(images, compute(60), path, size=10, jobs=10)
    assert seen.value == 60
    whole = store.compute_in_ranges(images, compute(1000), path, size=10, jobs=3)
    assert seen.value == 100
    assert sorted((r["img"], r["max_v"]) for r in whole.collect()) == [(i, float(i)) for i in range(100)]
    # a range with other images is made anew, the others are not
    fewer = images.where("img <> 5")
    again = store.compute_in_ranges(fewer, compute(1000), path, size=10)
    assert seen.value == 109 and again.count() == 99
    assert store.compute_in_ranges(fewer, compute(1000), path, size=10).count() == 99 and seen.value == 109


def test_images_are_fetched_once(spark):
    """Several jobs take what was fetched for all missing ranges; a second run fetches what it lacks."""
    path, seen = scratch(spark, "fetched-once"), spark.sparkContext.accumulator(0)
    images = spark.createDataFrame([(i, f"p{i}") for i in range(100)], "img long, image string")

    def fetch(part):
        def add(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch.assign(values=[[float(i)] * 4 for i in batch["img"]])[["img", "values"]]

        # as files are: all are opened, then those wanted are kept
        return part.select("img").join(images.mapInPandas(add, "img long, values array<double>"), "img")

    def compute(found):
        return extract_features(found, halves_of_four(), (1, 2, 2))

    store.compute_in_ranges(images.where("img < 30"), compute, path, size=10, jobs=3, fetch=fetch)
    assert seen.value == 100
    whole = store.compute_in_ranges(images, compute, path, size=10, jobs=4, fetch=fetch)
    assert seen.value == 200
    assert sorted((r["img"], r["max_v"]) for r in whole.collect()) == [(i, float(i)) for i in range(100)]


def halves_of_four():
    return lambda batch: {"max": batch.max(axis=(2, 3))}


def test_no_images(spark):
    none = spark.createDataFrame([], "img long, values array<double>")
    assert store.compute_in_ranges(none, lambda part: extract_features(part, halves(), (1, 2, 2)), scratch(spark, "none")).count() == 0


def test_labels_under_a_mask(spark):
    """Channels of other lengths, repeated and missing labels, images without a size or without labels."""
    from unitscope.operators import tally

    blocks = spark.createDataFrame([(i, u, 1, 2, [1.0, float(u)]) for i in range(4) for u in range(2)], "img long, unit int, h int, w int, values array<double>")
    thresholds = spark.createDataFrame([(0, 0.5), (1, 0.5)], "unit int, thresh double")
    images = spark.createDataFrame([(0, 1, 4), (1, 1, 4), (3, 2, 2)], "img long, sh int, sw int")
    channels = spark.createDataFrame([(0, 0, [1, 1, 2, 2]), (0, 1, [1]), (0, 2, [0, None, 2, 3]), (3, 0, None)], "img long, channel int, labels array<int>")
    scalars = spark.createDataFrame([(1, 9), (1, 9), (1, None)], "img long, label int")
    got = {(r["img"], r["unit"]): (r["area"], sorted(map(tuple, r["hits"]))) for r in tally.mask_labels(blocks, thresholds, images, channels, scalars).collect()}
    assert got == {
        (0, 0): (2, [(1, 3)]), (0, 1): (4, [(1, 3), (2, 3), (3, 1)]),
        (1, 0): (2, [(9, 2), (9, 2)]), (1, 1): (4, [(9, 4), (9, 4)]),
        (3, 0): (2, []), (3, 1): (4, []),
    }
    assert tally.mask_labels(blocks.limit(0), thresholds, images, channels, scalars).count() == 0


def test_areas_of_odd_maps(spark):
    from unitscope.operators.rank import map_areas

    rows = [(0, 0, 1, 2, [0.0, 1.0]), (1, 0, 1, 2, [float("nan"), 1.0]), (2, 0, 1, 2, [0.0, 0.2]), (3, 0, 1, 2, [None, 1.0])]
    blocks = spark.createDataFrame(rows, "img long, unit int, h int, w int, values array<double>")
    thresholds = spark.createDataFrame([(0, 0.5)], "unit int, thresh double")
    got = {r["img"]: r["area"] for r in map_areas(blocks, thresholds, 2, 8).where(F.lit(True)).collect()}
    assert got == {0: 8, 1: 0, 2: 0, 3: 4}
