from pyspark.sql import functions as F

from unitscope.functions import typed_double
from unitscope.operators import concepts, rank
from unitscope.operators.layout import global_index
from unitscope.sources import labels


def test_label_zero_counts_as_empty(spark):
    df = spark.createDataFrame([(0, ["0"], ["a.png"]), (1, ["0"], []), (2, ["3"], ["0", "5"])], "img int, scene array<string>, object array<string>")
    lists = ["scene", "object"]
    assert [r.img for r in df.where(concepts.has_any_data(lists)).orderBy("img").collect()] == [0, 2]
    assert [r.img for r in df.where(concepts.has_all_data(lists)).collect()] == [2]


def test_dense_labels_fill_holes(spark):
    df = spark.createDataFrame([(1, "a", ["x"], 0.5), (3, "c", ["y", "z"], 0.25)], "number int, name string, syns array<string>, coverage double")
    rows = {r.number: r for r in concepts.dense_labels(df).collect()}
    assert set(rows) == {0, 1, 2, 3}
    assert (rows[2].name, rows[2].syns, rows[2].coverage) == ("", [], 0.0)
    assert rows[3].syns == ["y", "z"]
    assert concepts.dense_labels(df, allow_none=True).where("name is null").count() == 2


def test_codes_of_unknown_labels_are_zero(spark):
    codes = spark.createDataFrame([("part", 7, 1), ("part", 9, 2)], "category string, number int, code int")
    df = spark.createDataFrame([("part", 7), ("part", 8), ("scene", 7)], "category string, number int")
    assert {(r.category, r.number): r.code for r in concepts.to_codes(df, codes).collect()} == {("part", 7): 1, ("part", 8): 0, ("scene", 7): 0}
    back = spark.createDataFrame([("part", 2), ("part", 5)], "category string, code int")
    assert {r.code: r.number for r in concepts.to_numbers(back, codes).collect()} == {2: 9, 5: 0}


def test_primary_category_ties(spark):
    numbers = spark.createDataFrame([(0,), (1,), (2,)], "number int")
    coverage = spark.createDataFrame([("a", 0, 1, 0.5), ("b", 1, 1, 0.5), ("a", 0, 2, 0.7), ("c", 2, 2, 0.1)], "category string, cat_idx int, number int, coverage double")
    got = {r.number: r.cat_idx for r in concepts.primary_category(numbers, coverage, 3).collect()}
    assert got == {0: 2, 1: 1, 2: 0}


def test_shuffle_is_repeatable_and_changes_by_epoch(spark):
    df = spark.range(500).withColumnRenamed("id", "img")
    orders = [[r.img for r in concepts.shuffled(df, 1, e).orderBy("pos").collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[2]) == list(range(500))


def test_global_index_with_heavy_ties(spark):
    """A third of the rows share the first key; the position stays exact."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("k"))
    got = [(r.k, r.id) for r in global_index(df, [F.desc("k"), F.asc("id")], "pos").orderBy("pos").collect()]
    assert got == sorted(((r.k, r.id) for r in df.collect()), key=lambda t: (-t[0], t[1]))
    assert global_index(df.where("id < 0"), ["id"]).count() == 0


def test_batches(spark):
    df = spark.range(10, 23).withColumnRenamed("id", "img")
    sizes = {r.batch: r.n for r in concepts.batches(df, 5).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 5, 1: 5, 2: 3}


def test_stack_skips_empty_categories_and_caps_depth(spark):
    images = spark.createDataFrame([(0, 1, 2), (1, 1, 2)], "img int, sh int, sw int")
    scalars = spark.createDataFrame([(0, "scene", 0, 9), (1, "scene", 0, 8)], "img int, category string, channel int, label int")
    channels = spark.createDataFrame([(0, "object", 0, [1, 2])], "img int, category string, channel int, labels array<int>")
    cats = spark.createDataFrame([("object", 0), ("part", 1), ("scene", 2)], "category string, cat_idx int")
    rows = concepts.segmentation_stack(images, scalars, channels, cats).collect()
    assert {(r.img, r.depth, r.px): r.label for r in rows} == {(0, 0, 0): 1, (0, 0, 1): 2, (0, 1, 0): 9, (0, 1, 1): 9, (1, 0, 0): 8, (1, 0, 1): 8}
    assert concepts.segmentation_stack(images, scalars, channels, cats, max_depth=1).where("depth > 0").count() == 0


def test_segmentation_of_missing_data_is_zero(spark):
    images = spark.createDataFrame([(0, 1, 2)], "img int, sh int, sw int")
    none = spark.createDataFrame([], "img int, category string, channel int, label int")
    maps = spark.createDataFrame([(0, "object", 0, [1, 2])], "img int, category string, channel int, labels array<int>")
    assert [r.label for r in concepts.segmentation(images, none, maps, "object", channel=1).collect()] == [0, 0]


def test_metadata_decoding(spark):
    raw = spark.createDataFrame([("i.jpg", "train", "10", "20", "5", "6", "3;;12", "o.png;4")], "image string, split string, ih string, iw string, sh string, sw string, scene string, object string")
    items = {(r.category, r.channel): (r.label, r.path) for r in labels.index_items(labels.decode_index(raw)).collect()}
    assert items == {("scene", 0): (3, None), ("scene", 1): (12, None), ("object", 0): (None, "o.png"), ("object", 1): (4, None)}
    label = spark.createDataFrame([("12", "plant", "object(46); part(45)", "998", "30.5", "flora;plant life")], "number string, name string, category string, frequency string, coverage string, syns string")
    row = labels.decode_labels(label).first()
    assert (row.number, row.category, row.frequency, row.coverage, row.syns) == (12, {"object": 46, "part": 45}, 998, 30.5, ["flora", "plant life"])


def test_line_parsers(spark):
    lines = spark.createDataFrame([("/b/beach 48",), ("/s/swimming_pool/indoor 327",), ("/a/x/y/z 1",)], "value string")
    assert {(r.cls, r.name) for r in labels.parse_class_names(lines).collect()} == {(48, "beach"), (327, "swimming_pool/indoor"), (1, "x/y")}
    images = spark.createDataFrame([("val_01.jpg 0",), ("val_02.jpg 164 ",)], "value string")
    assert {tuple(r) for r in labels.parse_image_list(images).collect()} == {("val_01.jpg", 0), ("val_02.jpg", 164)}


def test_category_order_and_empty_choice(spark):
    raw = spark.createDataFrame([("part", 5, 0), ("object", 9, 1), ("color", 2, 2)], "name string, frequency int, pos int")
    got = labels.select_categories(raw, ["color", "part"], "pos").collect()
    assert [(r.cat_idx, r.name, r.frequency) for r in got] == [(0, "part", 5), (1, "color", 2)]
    assert labels.select_categories(raw, None, "pos").count() == 0


def test_typed_values(spark):
    raw = spark.createDataFrame([("12",), ("-3",), ("1.5",), ("2e+3",), ("-",), ("beach",), ("",)], "v string")
    got = [tuple(r) for r in labels.value_kinds(raw, "v").collect()]
    assert got == [(12, None, None), (-3, None, None), (None, 1.5, None), (None, 2000.0, None), (None, None, "-"), (None, None, "beach"), (None, None, "")]


def test_numbers_as_spark_writes_them(spark):
    df = spark.createDataFrame([("1.0E-5",), ("2.5E7",), ("3e2",), ("-4",), ("x",)], "c string")
    assert [r[0] for r in df.select(typed_double(F.col("c"))).collect()] == [1e-5, 2.5e7, 300.0, -4.0, None]


def test_categories_without_labels_count_zero(spark):
    histogram = spark.createDataFrame([("a", "object"), ("b", "object"), ("c", "odd")], "label string, category string")
    got = {r["category"]: r["n_labels"] for r in rank.category_totals(histogram, ["object", "part"]).collect()}
    assert got == {"object": 2, "part": 0, "odd": 1}
