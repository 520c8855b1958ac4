"""Scans, sources and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import query
from unitscope.operators import resample
from unitscope.operators.layout import bounded, spread
from unitscope.session import scratch
from unitscope.sources import arrays, dataset
from unitscope.sources import images as image_files
from unitscope.sources import labels, store, tensors

_CELLS = fx.sql(
    "SELECT img AS id_1, unit::BIGINT AS id_2, y::BIGINT AS id_3, x::BIGINT AS id_4, v AS value FROM cell",
    "cell",
)


@query("a1_tensor_csv", _CELLS)
def tensor_csv(spark, sf):
    path = scratch(spark, "tensor")
    tensors.write_tensor_csv(fx.matrix(spark, sf), path)
    return tensors.read_tensor_csv(spark, path)


@query("a2_dense_to_cells", fx.sql("SELECT img, unit, y, x, v FROM cell", "cell"))
def dense_to_cells(spark, sf):
    return resample.blocks_to_cells(fx.blocks(spark, sf))


@query(
    "a2_array_to_cells",
    """WITH seg AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS s FROM customer GROUP BY 1),
            held AS (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM customer GROUP BY 1, 2)
       SELECT -1::BIGINT AS id_1, -1::BIGINT AS id_2, n_nationkey::BIGINT AS id_3, s::BIGINT AS id_4,
              coalesce(c, 0)::DOUBLE AS value
       FROM nation CROSS JOIN seg LEFT JOIN held ON c_nationkey = n_nationkey AND held.c_mktsegment = seg.c_mktsegment""",
)
def array_to_cells(spark, sf):
    """Customers by nation and segment, counted by Spark, as a local array of rank 2."""
    names = sorted(r[0] for r in fx.table(spark, sf, "customer").select("c_mktsegment").distinct().collect())
    held = fx.table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").count().collect()
    array = np.zeros((fx.table(spark, sf, "nation").count(), len(names)))
    for nation, segment, count in held:
        array[nation, names.index(segment)] = count
    return tensors.array_to_cells(spark, array)


@query("a2_array_files", _CELLS)
def array_files(spark, sf):
    """The maps as a folder of dense parts, read back as cells in many byte ranges."""
    path = scratch(spark, "array")
    shape = (fx.images(spark, sf).count(), fx.UNITS, fx.SIDE, fx.SIDE)
    arrays.save_array(fx.matrix(spark, sf), path, shape, part_bytes=1 << 16)
    return arrays.read_array(spark, path, partitionBytes=1 << 15)


@query("a3_nested_round_trip", _CELLS.replace("SELECT img AS id_1", "SELECT 'layer4' AS layer_name, img AS id_1"))
def nested_round_trip(spark, sf):
    named = fx.matrix(spark, sf).withColumn("layer_name", F.lit("layer4"))
    nested = tensors.cells_to_nested(named, ["layer_name"], images_per_row=32)
    return tensors.nested_to_cells(nested, "feature_map", "first_img")


@query(
    "a4_feature_store",
    fx.sql(
        "SELECT 'net' AS model, 'layer4' AS layer, img, unit, round(max(v), 9) AS max_v FROM cell GROUP BY img, unit",
        "cell",
    ),
)
def feature_store(spark, sf):
    path = scratch(spark, "features")

    def compute():
        return fx.blocks(spark, sf).select(F.lit("net").alias("model"), F.lit("layer4").alias("layer"), "*")

    store.load_or_compute(spark, path, compute, ["model", "layer"])
    again = store.load_or_compute(spark, path, compute, ["model", "layer"])
    peaks = again.select("model", "layer", "img", "unit", F.array_max("values").alias("max_v"))
    return fx.rounded(peaks, "max_v")


@query("a5_saved_table", fx.sql("SELECT unit::BIGINT AS id_2, count(*) AS cells FROM cell GROUP BY unit", "cell"))
def saved_table(spark, sf):
    table = tensors.save_table(fx.matrix(spark, sf), "scope_features", scratch(spark, "features"))
    return table.groupBy("id_2").agg(F.count("*").alias("cells"))


@query("a6_table_query", "SELECT n_nationkey, n_name, n_regionkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def table_query(spark, sf):
    joined = fx.table(spark, sf, "customer").join(
        bounded(fx.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    )
    rows = joined.select("n_nationkey", "n_name", "n_regionkey", "c_custkey")
    tensors.save_table(rows, "scope_customers", scratch(spark, "customers"))
    return tensors.query_table(spark, "scope_customers")


@query(
    "a7_catalog_listing",
    """SELECT 'scope_lineitem' AS name, true AS "isTemporary", count(*) AS n FROM lineitem
       UNION ALL SELECT 'scope_orders', true, count(*) FROM orders
       UNION ALL SELECT 'scope_events', true, count(*) FROM events""",
)
def catalog_listing(spark, sf):
    counts = None
    for name in ("lineitem", "orders", "events"):
        fx.table(spark, sf, name).createOrReplaceTempView(f"scope_{name}")
        rows = spark.table(f"scope_{name}").agg(F.count("*").alias("n")).withColumn("name", F.lit(f"scope_{name}"))
        counts = rows if counts is None else counts.unionByName(rows)
    return tensors.list_tables(spark).join(counts, "name").select("name", "isTemporary", "n")


def _label_images(spark, sf) -> str:
    """One RGB label map per vector, written as PNG files."""
    p = F.sequence(F.lit(0), F.lit(fx.GRID * fx.GRID - 1))

    def rgb(i):
        label = F.col("label") * 300 + i * 7
        return F.array(label % 256, F.floor(label / 256).cast("int"), F.lit(0))

    maps = fx.table(spark, sf, "embeddings").select(
        F.concat(F.lit("seg_"), F.col("vec_id").cast("string"), F.lit(".png")).alias("file"),
        F.lit(fx.GRID).alias("height"),
        F.lit(fx.GRID).alias("width"),
        F.flatten(F.transform(p, rgb)).alias("rgb"),
    )
    path = scratch(spark, "png")
    image_files.write_png(maps, path)
    return path


@query(
    "a8_image_scan",
    "SELECT 'seg_' || vec_id || '.png' AS file, 4 AS height, 4 AS width, 3 AS n_channels, 48 AS n_bytes FROM embeddings",
)
def image_scan(spark, sf):
    found = image_files.read_images(spark, _label_images(spark, sf))
    return found.select("file", "height", "width", "n_channels", F.octet_length("data").alias("n_bytes"))


@query(
    "a23_label_image_decode",
    """SELECT 'seg_' || vec_id || '.png' AS file, (p // 4)::INT AS y, (p % 4)::INT AS x,
              (label * 300 + p * 7)::INT AS label FROM embeddings, range(16) t(p)""",
)
def label_image_decode(spark, sf):
    return image_files.label_pixels(image_files.read_images(spark, _label_images(spark, sf)))


def _index_text(spark, sf):
    n, d = F.col("n_chars"), F.col("doc_id")
    return fx.table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), d.cast("string"), F.lit(".jpg")).alias("image"),
        F.when(d % 3 == 0, "val").otherwise("train").alias("split"),
        F.lit("224").alias("ih"),
        (n % 90 + 10).cast("string").alias("iw"),
        F.lit("112").alias("sh"),
        F.lit("56").alias("sw"),
        F.when(d % 2 == 0, F.concat(F.lit("a/"), d.cast("string"), F.lit("_object.png"))).otherwise("").alias("object"),
        F.when(n % 4 == 0, "")
        .otherwise(F.concat((n % 7).cast("string"), F.lit(";;"), (n % 5).cast("string")))
        .alias("scene"),
    )


@query(
    "a9_index_decode",
    """WITH d AS (SELECT 'doc_' || doc_id || '.jpg' AS image, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS split,
                 (n_chars % 90 + 10)::INT AS iw, doc_id, n_chars FROM documents)
       SELECT image, split, iw, 56 AS sw, 'object' AS category, 0 AS channel, NULL::INT AS label,
              'a/' || doc_id || '_object.png' AS path FROM d WHERE doc_id % 2 = 0
       UNION ALL SELECT image, split, iw, 56, 'scene', 0, (n_chars % 7)::INT, NULL FROM d WHERE n_chars % 4 <> 0
       UNION ALL SELECT image, split, iw, 56, 'scene', 1, (n_chars % 5)::INT, NULL FROM d WHERE n_chars % 4 <> 0""",
)
def index_decode(spark, sf):
    path = scratch(spark, "index")
    raw = _index_text(spark, sf)
    raw.write.option("header", True).option("emptyValue", "").csv(path)
    index = labels.decode_index(labels.read_text_csv(spark, path, raw.columns))
    return labels.index_items(index).join(index.select("image", "split", "iw", "sw"), "image").select(
        "image", "split", "iw", "sw", "category", "channel", "label", "path"
    )


@query(
    "a10_label_decode",
    """WITH p AS (SELECT p_partkey AS number, p_name AS name, p_size, p_type, p_retailprice, p_partkey FROM part)
       SELECT number, name, 'object' AS category, p_size AS n, 2 AS n_syns, round(p_retailprice, 6) AS coverage FROM p
       UNION ALL SELECT number, name, lower(p_type), (p_partkey % 50)::INT, 2, round(p_retailprice, 6) FROM p""",
)
def label_decode(spark, sf):
    part = fx.table(spark, sf, "part")
    text = part.select(
        F.col("p_partkey").cast("string").alias("number"),
        F.col("p_name").alias("name"),
        F.concat(
            F.lit("object("), F.col("p_size").cast("string"), F.lit("); "), F.lower("p_type"), F.lit("("),
            (F.col("p_partkey") % 50).cast("string"), F.lit(")"),
        ).alias("category"),
        F.concat_ws(";", "p_brand", "p_type").alias("syns"),
        F.col("p_retailprice").cast("string").alias("coverage"),
    )
    path = scratch(spark, "label")
    text.write.option("header", True).csv(path)
    decoded = labels.decode_labels(labels.read_text_csv(spark, path, text.columns))
    return fx.rounded(
        decoded.select(
            "number", "name", F.explode("category").alias("category", "n"), F.size("syns").alias("n_syns"), "coverage"
        ),
        "coverage",
        digits=6,
    )


@query(
    "a11_category_scan",
    """SELECT (row_number() OVER (ORDER BY pos) - 1)::INT AS cat_idx, name, frequency FROM (
         SELECT p_type AS name, count(*) AS frequency, min(p_partkey) AS pos FROM part
         WHERE p_type IN ('LARGE', 'PROMO', 'SMALL') GROUP BY p_type)""",
)
def category_scan(spark, sf):
    raw = fx.table(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(
        F.count("*").alias("frequency"), F.min("p_partkey").alias("pos")
    )
    return labels.select_categories(raw, ["LARGE", "PROMO", "SMALL"], "pos")


@query(
    "a12_typed_csv",
    """SELECT p_partkey AS number,
              CASE WHEN p_partkey % 3 = 0 THEN p_size::BIGINT END AS as_long,
              CASE WHEN p_partkey % 3 = 1 THEN p_retailprice END AS as_double,
              CASE WHEN p_partkey % 3 = 2 THEN p_name END AS as_text FROM part""",
)
def typed_csv(spark, sf):
    key = F.col("p_partkey")
    mixed = (
        F.when(key % 3 == 0, F.col("p_size").cast("string"))
        .when(key % 3 == 1, F.col("p_retailprice").cast("string"))
        .otherwise(F.col("p_name"))
    )
    text = fx.table(spark, sf, "part").select(key.cast("string").alias("number"), mixed.alias("value"))
    path = scratch(spark, "mixed")
    text.write.option("header", True).csv(path)
    raw = labels.typed_csv(labels.read_text_csv(spark, path, text.columns), longs=["number"])
    return labels.value_kinds(raw, "value")


@query(
    "a13_image_list",
    "SELECT 'val_' || doc_id || '.jpg' AS image, (n_chars % 365)::INT AS label FROM documents",
)
def image_list(spark, sf):
    lines = fx.table(spark, sf, "documents").select(
        F.concat(
            F.lit("val_"), F.col("doc_id").cast("string"), F.lit(".jpg "), (F.col("n_chars") % 365).cast("string")
        ).alias("value")
    )
    path = scratch(spark, "list")
    lines.write.text(path)
    return labels.parse_image_list(spark.read.text(path))


def _class_lines(spark, sf):
    name = F.regexp_replace("p_name", " ", "_")
    sub = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/"), F.lower("p_type"))).otherwise("")
    return fx.table(spark, sf, "part").select(
        F.concat(
            F.lit("/"), F.substring("p_name", 1, 1), F.lit("/"), name, sub, F.lit(" "), F.col("p_partkey").cast("string")
        ).alias("value")
    )


@query(
    "a14_class_names",
    """SELECT p_partkey::INT AS cls,
              replace(p_name, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN '/' || lower(p_type) ELSE '' END AS name
       FROM part""",
)
def class_names(spark, sf):
    return labels.parse_class_names(_class_lines(spark, sf))


@query(
    "a15_class_list_rewrite",
    """SELECT 'Places' AS dataset, p_partkey AS id,
              '/' || p_name[1] || '/' || replace(p_name, ' ', '_')
              || CASE WHEN p_partkey % 2 = 0 THEN '/' || lower(p_type) ELSE '' END AS name FROM part""",
)
def class_list_rewrite(spark, sf):
    path = scratch(spark, "classes")
    labels.rewrite_class_list(_class_lines(spark, sf), "Places", path)
    return spark.read.schema("dataset string, id long, name string").option("sep", "\t").csv(path)


@query(
    "a16_threshold_store",
    fx.sql(
        """SELECT 'scenes' AS dataset, 'net' AS model_name, 'layer4' AS layer_name, unit AS unit_id,
                  round(t, 9) AS thresh FROM thr""",
        "thr",
    ),
)
def threshold_store(spark, sf):
    path = scratch(spark, "thresholds")
    kept = store.load_or_compute(
        spark, path, lambda: store.threshold_table(fx.thresholds(spark, sf), "scenes", "net", "layer4")
    )
    return fx.rounded(kept, "thresh")


_WIDE = ", ".join(
    f"""max(CASE WHEN cat = {i} THEN CASE WHEN b.lab = 0 THEN '' ELSE 'concept_' || b.lab || '-c' END END) AS "{c}-label",
        max(CASE WHEN cat = {i} THEN truth END)::DOUBLE AS "{c}-truth",
        max(CASE WHEN cat = {i} THEN act END)::DOUBLE AS "{c}-activation",
        max(CASE WHEN cat = {i} THEN both_n END)::DOUBLE AS "{c}-intersect",
        round(max(CASE WHEN cat = {i} THEN iou END), 9) AS "{c}-iou" """
    for i, c in enumerate(fx.CATEGORIES)
)
RECORDS_SQL = fx.sql(
    f"""SELECT (unit + 1)::INT AS unit, category, label, round(score, 9) AS score, w.* EXCLUDE (unit)
        FROM top_ JOIN (SELECT unit, {_WIDE} FROM best b GROUP BY unit) w USING (unit)""",
    "top",
)


@query("a17_tally_csv", RECORDS_SQL)
def tally_csv(spark, sf):
    path = scratch(spark, "tally")
    store.save_tally_csv(fx.dissection(spark, sf).records, path)
    back = store.read_tally_csv(spark, path, fx.CATEGORIES)
    return fx.rounded(back, "score", *[f"{c}-iou" for c in fx.CATEGORIES])


@query(
    "a18_tally_table",
    fx.sql(
        """SELECT 'scenes' AS dataset, 'net' AS model_name, 'layer4' AS layer_name, unit AS unit_id,
                  label AS semantic_label FROM top_""",
        "top",
    ),
)
def tally_table(spark, sf):
    rows = store.tally_table(fx.dissection(spark, sf).records, "scenes", "net", "layer4")
    path = scratch(spark, "tally_result")
    rows.write.parquet(path)
    return spark.read.parquet(path)


_UNITS = list(range(fx.UNITS))


@query(
    "a19_wide_rates",
    fx.sql(
        "SELECT 'vec_' || img || '.jpg' AS image, 'class_' || label AS class, "
        + ", ".join(f"max(CASE WHEN unit = {u} THEN rate END)::DOUBLE AS unit_{u}" for u in _UNITS)
        + " FROM rate JOIN embeddings ON vec_id = img GROUP BY img, label",
        "rate",
    ),
)
def wide_rates(spark, sf):
    named = fx.images(spark, sf).select(
        "img", "image", F.concat(F.lit("class_"), F.col("cls").cast("string")).alias("class")
    )
    wide = store.wide_rates(fx.rates(spark, sf).join(named, "img"), _UNITS)
    path = scratch(spark, "rates")
    wide.write.option("header", True).csv(path)
    return spark.read.schema(wide.schema).option("header", True).csv(path)


@query(
    "a20_dense_weights",
    fx.sql(
        "SELECT "
        + ", ".join(
            f"coalesce(sum(CASE WHEN b.unit = {u} THEN n END), 0)::DOUBLE AS c{u}" for u in _UNITS
        )
        + """ FROM (SELECT DISTINCT unit FROM cell) u LEFT JOIN (
             SELECT a.unit AS src, b.unit, count(*) AS n FROM area a JOIN area b ON a.img = b.img AND a.unit < b.unit
             GROUP BY a.unit, b.unit) b ON b.src = u.unit GROUP BY u.unit""",
        "area",
    ),
)
def dense_weights(spark, sf):
    from unitscope.operators import graph

    active = fx.rates(spark, sf).where(F.col("rate") > 0)
    units = fx.blocks(spark, sf).select("unit").distinct()
    path = scratch(spark, "matrix")
    store.save_matrix_csv(graph.weight_matrix(graph.coactivation_edges(active), units), fx.UNITS, path)
    return spark.read.schema(", ".join(f"c{u} double" for u in _UNITS)).csv(path)


@query(
    "a21_membership",
    fx.sql("SELECT unit, (count(*) FILTER (WHERE v > 0) % 5)::INT AS community FROM cell GROUP BY unit", "cell"),
)
def membership(spark, sf):
    groups = fx.cells(spark, sf).groupBy("unit").agg((F.count_if(F.col("v") > 0) % 5).alias("c"))
    # one number per unit of the network
    ordered = F.array_sort(F.collect_list(F.struct("unit", "c")))
    text = groups.agg(F.concat_ws("  ", F.transform(ordered, lambda s: s["c"].cast("string"))).alias("value"))
    path = scratch(spark, "membership")
    text.coalesce(1).write.text(path)
    return labels.read_membership(spark, path)


@query(
    "a22_feature_map_export",
    fx.sql(
        """SELECT n.new_img AS img, n.vec_id AS source_img, unit, round(sum(v), 9) AS total
           FROM cell JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_img
                           FROM embeddings WHERE label IN (1, 3)) n ON n.vec_id = cell.img
           GROUP BY n.new_img, n.vec_id, unit""",
        "cell",
    ),
)
def feature_map_export(spark, sf):
    chosen = fx.images(spark, sf).where(F.col("cls").isin(1, 3)).select("img", F.col("img").alias("pos"))
    maps = store.export_feature_maps(fx.blocks(spark, sf), chosen)
    path = scratch(spark, "export")
    maps.write.parquet(path)
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return fx.rounded(spark.read.parquet(path).select("img", "source_img", "unit", total.alias("total")), "total")


@query(
    "a12_unreadable_fields",
    """SELECT o_orderkey::VARCHAR AS id, 'size' AS field, CASE WHEN o_orderkey % 3 = 0 THEN '12.0' ELSE o_orderpriority END AS value
       FROM orders WHERE o_orderkey % 5 <> 1
       UNION ALL SELECT o_orderkey::VARCHAR, 'count', o_orderstatus FROM orders WHERE o_orderkey % 7 = 2""",
)
def unreadable_fields(spark, sf):
    """Fields of a text table that hold no whole number, listed beside the table that has nulls for them."""
    key = F.col("o_orderkey")
    path = scratch(spark, "fields")
    text = fx.table(spark, sf, "orders").select(
        key.cast("string").alias("id"),
        F.when(key % 5 == 1, (key % 90).cast("string")).when(key % 3 == 0, "12.0").otherwise(F.col("o_orderpriority")).alias("size"),
        F.when(key % 7 == 2, F.col("o_orderstatus")).when(key % 7 == 3, "").otherwise("-5").alias("count"),
    )
    text.write.option("header", True).csv(path)
    return labels.bad_numbers(labels.read_text_csv(spark, path, text.columns), "id", ["size", "count"], "long")


def _dataset(spark, sf) -> str:
    """The labels of the vectors as a data set on disk: index, tables and one PNG per label map."""
    path = scratch(spark, "dataset")
    img = F.col("img").cast("string")
    maps = fx.channels(spark, sf).withColumn("file", F.concat(F.lit("m"), F.col("img") % 7, F.lit("/"), img, F.lit("_"), F.col("channel"), F.lit(".png")))
    rgb = F.flatten(F.transform("labels", lambda x: F.array(x % 256, F.floor(x / 256).cast("int"), F.lit(0))))
    side = F.lit(fx.GRID)
    image_files.write_png(spread(maps, "file").select("file", side.alias("height"), side.alias("width"), rgb.alias("rgb")), f"{path}/images")
    # two label maps an image
    listed = maps.groupBy("img").agg(F.array_join(F.array_sort(F.collect_list("file")), ";").alias("object"))
    index = fx.images(spark, sf).join(listed, "img").join(fx.scalars(spark, sf).select("img", F.col("label").alias("scene")), "img", "left")
    columns = [F.col(c).cast("string") for c in ("image", "split", "sh", "sw", "object")]
    index.select(*columns, F.lit("").alias("part"), F.concat(F.col("scene").cast("string"), F.lit(";")).alias("scene")).write.option("header", True).csv(f"{path}/index.csv")
    names = fx.labelcat(spark, sf).select(F.col("label").alias("number"), F.concat(F.lit("concept_"), F.col("label"), F.lit("-c")).alias("name"), "cat_idx")
    entry = F.concat(F.element_at(F.array(*map(F.lit, fx.CATEGORIES)), F.col("cat_idx") + 1), F.lit("(5)"))
    rest = [F.lit("5").alias("frequency"), F.lit("0.5").alias("coverage")]
    names.select("number", "name", entry.alias("category"), *rest, F.lit("").alias("syns")).write.option("header", True).csv(f"{path}/label.csv")
    for i, name in enumerate(fx.CATEGORIES):
        own = names.where(F.col("cat_idx") == i).select(F.col("number").alias("code"), "number", "name", *rest)
        own.write.option("header", True).csv(f"{path}/c_{name}.csv")
    rows = spark.createDataFrame([(c,) for c in ["color", *fx.CATEGORIES]], "name string").coalesce(1)
    rows.write.option("header", True).csv(f"{path}/category.csv")
    return path


@query(
    "a23_dataset_iou",
    fx.sql(
        """SELECT unit, lab AS label, cat AS cat_idx, both_n AS both, act AS activation, truth,
                  round(iou, 9) AS iou FROM iou""",
        "iou",
    ),
)
def dataset_iou(spark, sf):
    """Scores from a data set on disk: index, label maps and code tables to the tally."""
    from unitscope.plans import dissect

    data = dataset.open_dataset(spark, _dataset(spark, sf), fx.CATEGORIES)
    number = data.images.select("img", F.regexp_extract("image", r"vec_(\d+)", 1).cast("long").alias("vec"))
    maps = fx.blocks(spark, sf).withColumnRenamed("img", "vec").join(number, "vec").drop("vec")
    done = dissect(maps, data.images, data.channels, data.scalars, data.labelcat, data.category_names(), data.names, fx.DENSE_Q)
    return fx.rounded(done.scores, "iou")
