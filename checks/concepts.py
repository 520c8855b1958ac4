"""Images, labels and segmentations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import query
from unitscope.operators import concepts
from unitscope.operators.layout import bounded


def _documents(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("img"), F.col("lang").alias("split"), "source", "n_chars")


def _document_labels(spark, sf):
    """Image-level labels: quality and toxic, 0 = none."""
    pairs = F.array(
        F.struct(F.lit("quality").alias("category"), F.col("quality").alias("label")),
        F.struct(F.lit("toxic").alias("category"), F.col("toxic").alias("label")),
    )
    return fx.table(spark, sf, "labels").select(F.col("doc_id").alias("img"), F.inline(pairs))


_DOC = "SELECT d.doc_id AS img, lang AS split FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


@query("g1_any_label", f"{_DOC} WHERE quality <> 0 OR toxic <> 0")
def any_label(spark, sf):
    kept = concepts.images_with_any(_documents(spark, sf), _document_labels(spark, sf), ["quality", "toxic"])
    return kept.select("img", "split")


@query("g2_all_labels", f"{_DOC} WHERE quality <> 0 AND toxic <> 0")
def all_labels(spark, sf):
    kept = concepts.images_with_all(_documents(spark, sf), _document_labels(spark, sf), ["quality", "toxic"])
    return kept.select("img", "split")


def _label_lists(spark, sf):
    listed = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("img"),
        F.array(F.col("quality").cast("string")).alias("quality"),
        F.array(F.col("toxic").cast("string")).alias("toxic"),
    )
    return _documents(spark, sf).join(listed, "img", "left")


@query(
    "g1_any_label_lists",
    """SELECT d.doc_id AS img, coalesce(quality <> 0 OR toxic <> 0, false) AS any_data,
              coalesce(quality <> 0 AND toxic <> 0, false) AS all_data
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def any_label_lists(spark, sf):
    columns = ["quality", "toxic"]
    false = F.lit(False)
    return _label_lists(spark, sf).select(
        "img",
        F.coalesce(concepts.has_any_data(columns), false).alias("any_data"),
        F.coalesce(concepts.has_all_data(columns), false).alias("all_data"),
    )


def _brand(column: str = "p_brand"):
    return F.regexp_extract(column, r"(\d+)$", 1).cast("long")


def _brand_labels(spark, sf):
    """Brands as a label table with holes: every third number is one."""
    part = fx.table(spark, sf, "part")
    return part.groupBy((_brand() * 3).alias("number"), F.col("p_brand").alias("name")).agg(
        F.count("*").alias("frequency"), F.round(F.sum("p_retailprice"), 2).alias("coverage")
    )


@query(
    "g3_dense_labels",
    """WITH l AS (SELECT replace(p_brand, 'Brand#', '')::BIGINT * 3 AS number, p_brand AS name, count(*) AS frequency,
                         round(sum(p_retailprice), 2) AS coverage FROM part GROUP BY p_brand)
       SELECT n AS number, coalesce(name, '') AS name, coalesce(frequency, 0) AS frequency,
              coalesce(coverage, 0) AS coverage
       FROM (SELECT max(number) + 1 AS m FROM l), range(m) t(n) LEFT JOIN l ON l.number = n""",
)
def dense_labels(spark, sf):
    return concepts.dense_labels(_brand_labels(spark, sf))


def _coverage(spark, sf):
    """Coverage and frequency per (category = part type, label = brand)."""
    part = fx.table(spark, sf, "part")
    per = part.groupBy(F.col("p_type").alias("category"), _brand().alias("number")).agg(
        F.round(F.sum("p_retailprice"), 2).alias("coverage"), F.count("*").alias("frequency")
    )
    return per.join(bounded(concepts.category_table(part, "p_type")), "category")


_COV = """cov AS (
  SELECT p_type AS category, replace(p_brand, 'Brand#', '')::BIGINT AS number,
         round(sum(p_retailprice), 2) AS coverage, count(*) AS frequency FROM part GROUP BY 1, 2),
cats AS (SELECT category, (row_number() OVER (ORDER BY category) - 1)::INT AS cat_idx
         FROM (SELECT DISTINCT p_type AS category FROM part))"""


def _codes(spark, sf):
    """Dense codes from 1 per category, by label number; half the brands lack one."""
    cov = _coverage(spark, sf)
    kept = cov.where(F.col("number") > 12)
    return kept.select("category", "number", (F.col("number") - 12).cast("int").alias("code"))


@query(
    "g4_number_to_code",
    """SELECT p_partkey, p_type AS category, replace(p_brand, 'Brand#', '')::BIGINT AS number,
              greatest(replace(p_brand, 'Brand#', '')::INT - 12, 0) AS code FROM part""",
)
def number_to_code(spark, sf):
    rows = fx.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"), _brand().alias("number"))
    return concepts.to_codes(rows, _codes(spark, sf)).select("p_partkey", "category", "number", "code")


@query(
    "g4_code_to_number",
    """SELECT p_partkey, p_type AS category, p_size AS code,
              CASE WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_type = o.p_type
                                AND replace(q.p_brand, 'Brand#', '')::INT = o.p_size + 12)
                   THEN p_size + 12 ELSE 0 END::BIGINT AS number FROM part o""",
)
def code_to_number(spark, sf):
    rows = fx.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_size").alias("code"))
    return concepts.to_numbers(rows, _codes(spark, sf)).select("p_partkey", "category", "code", "number")


@query(
    "g5_primary_category",
    f"""WITH {_COV} SELECT number, cat_idx FROM (
          SELECT number, cat_idx, row_number() OVER (PARTITION BY number ORDER BY coverage DESC, cat_idx DESC) AS r
          FROM cov JOIN cats USING (category)) WHERE r = 1
        UNION ALL SELECT 0, 5""",
)
def primary_category(spark, sf):
    """Number 0 is in no category and falls to the last one."""
    coverage = _coverage(spark, sf)
    numbers = concepts.dense_labels(coverage.select("number").distinct())
    return concepts.primary_category(numbers, coverage, 6)


@query(
    "g6_label_statistics",
    """SELECT replace(p_brand, 'Brand#', '')::BIGINT AS number, p_brand AS name,
              p_brand || '|' || string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS all_names,
              count(*) AS frequency, round(sum(p_retailprice), 2) AS coverage FROM part GROUP BY p_brand""",
)
def label_statistics(spark, sf):
    labels = fx.table(spark, sf, "part").groupBy(_brand().alias("number"), F.col("p_brand").alias("name")).agg(
        F.array_sort(F.collect_set("p_type")).alias("syns"),
        F.count("*").alias("frequency"),
        F.round(F.sum("p_retailprice"), 2).alias("coverage"),
    )
    stats = concepts.label_statistics(labels)
    return stats.withColumn("all_names", F.concat_ws("|", "all_names"))


@query(
    "g6_label_sizes",
    "SELECT p_type AS category, max(replace(p_brand, 'Brand#', '')::INT) - 12 + 1 AS label_size FROM part GROUP BY p_type",
)
def label_sizes(spark, sf):
    return concepts.label_sizes(_codes(spark, sf))


@query(
    "g6_category_frequency",
    f"WITH {_COV} SELECT cat_idx, category, sum(frequency)::DOUBLE AS frequency FROM cov JOIN cats USING (category) GROUP BY 1, 2",
)
def category_frequency(spark, sf):
    return concepts.category_frequency(_coverage(spark, sf))


@query("g7_split_sizes", "SELECT lang AS split, count(*) AS n FROM documents GROUP BY lang")
def split_sizes(spark, sf):
    return concepts.split_sizes(_documents(spark, sf))


@query(
    "g8_split_range",
    """SELECT doc_id AS img, source FROM documents, (SELECT count(*) AS n FROM documents)
       WHERE lang = 'en' AND doc_id >= n // 5 AND doc_id < n""",
)
def split_range(spark, sf):
    docs = _documents(spark, sf)
    n = docs.count()
    return concepts.select_images(docs, "en", n // 5, n).select("img", "source")


@query(
    "g9_seeded_shuffle",
    "SELECT doc_id AS img, row_number() OVER (ORDER BY md5('11:2:' || doc_id), doc_id) - 1 AS pos FROM documents",
)
def seeded_shuffle(spark, sf):
    return concepts.shuffled(_documents(spark, sf).select("img"), seed=11, epoch=2)


@query(
    "g10_batches",
    """SELECT batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (
         SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents) GROUP BY batch""",
)
def batches(spark, sf):
    rows = concepts.batches(_documents(spark, sf).select("img"), 64)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("img").alias("first"), F.max("img").alias("last"))


def _grids(spark, sf):
    return fx.images(spark, sf), fx.scalars(spark, sf), fx.channels(spark, sf)


@query(
    "g11_segmentation_pixels",
    fx.sql("SELECT img, py, px, lab AS label FROM seg WHERE ch = 1", "seg"),
)
def segmentation_pixels(spark, sf):
    return concepts.segmentation(*_grids(spark, sf), "object", channel=1)


@query(
    "g11_segmentation_scalar",
    """SELECT vec_id AS img, py::INT AS py, px::INT AS px,
              CASE WHEN label NOT IN (0, 3, 6, 9) THEN label + 6 ELSE 0 END AS label
       FROM embeddings, range(4) a(py), range(4) b(px)""",
)
def segmentation_scalar(spark, sf):
    return concepts.segmentation(*_grids(spark, sf), "scene")


@query(
    "g11_segmentation_codes",
    fx.sql("SELECT img, py, px, CASE WHEN lab >= 2 THEN lab - 1 ELSE 0 END AS label FROM seg WHERE ch = 0", "seg"),
)
def segmentation_codes(spark, sf):
    """Dense codes of the object category, in which label 1 has none."""
    labelled = fx.channels(spark, sf).select("category", F.explode("labels").alias("number"))
    codes = labelled.distinct().where("number >= 2").withColumn("code", F.col("number") - 1)
    return concepts.segmentation(*_grids(spark, sf), "object", codes=codes)


_STACK = """SELECT img, ch AS depth, py, px, lab AS label FROM seg
  UNION ALL SELECT img, 2, py::INT, px::INT, lab FROM scal, range(4) a(py), range(4) b(px)"""


def _category_table(spark, sf):
    """The categories of the data, in name order."""
    used = fx.channels(spark, sf).select("category").unionByName(fx.scalars(spark, sf).select("category"))
    return concepts.category_table(used)


@query("g12_segmentation_stack", fx.sql(_STACK, "seg", "scal"))
def segmentation_stack(spark, sf):
    return concepts.segmentation_stack(*_grids(spark, sf), _category_table(spark, sf))


@query("g12_segmentation_stack_depth", fx.sql("SELECT img, ch AS depth, py, px, lab AS label FROM seg", "seg"))
def segmentation_stack_depth(spark, sf):
    return concepts.segmentation_stack(*_grids(spark, sf), _category_table(spark, sf), max_depth=2)


@query(
    "g13_resolved_segmentations",
    fx.sql(
        """SELECT img, 'object' AS category, ch AS channel, py, px, lab AS label FROM seg
           UNION ALL SELECT img, 'scene', 0, NULL, NULL, lab FROM scal""",
        "seg",
        "scal",
    ),
)
def resolved_segmentations(spark, sf):
    plain, grids = concepts.resolve_segmentations(*_grids(spark, sf))
    none = F.lit(None).cast("int")
    flat = plain.select("img", "category", "channel", none.alias("py"), none.alias("px"), "label")
    return grids.unionByName(flat)


@query(
    "g13_resolved_mixed",
    fx.sql(
        """SELECT img, 'object' AS category, ch AS channel, py, px, lab AS label FROM seg
           UNION ALL SELECT img, 'object', 2, py::INT, px::INT, lab FROM scal, range(4) a(py), range(4) b(px)""",
        "seg",
        "scal",
    ),
)
def resolved_mixed(spark, sf):
    """An image-level label next to label maps of its category becomes a grid too."""
    images, scalars, channels = _grids(spark, sf)
    mixed = scalars.select("img", F.lit("object").alias("category"), F.lit(2).alias("channel"), "label")
    return concepts.resolve_segmentations(images, mixed, channels, ["object"])[1]


def _nearest(o: str, n_in: int, n_out: int) -> str:
    return f"floor({o} * {n_in - 1} / {n_out - 1} + 0.5e0)::INT"


@query(
    "g14_rescaled_labels",
    fx.sql(
        f"""SELECT img, ch AS channel, oy::INT AS py, ox::INT AS px, lab AS label
            FROM range(7) a(oy), range(6) b(ox), seg
            WHERE py = {_nearest('oy', 4, 7)} AND px = {_nearest('ox', 4, 6)}""",
        "seg",
    ),
)
def rescaled_labels(spark, sf):
    sized = fx.channels(spark, sf).join(fx.images(spark, sf).select("img", "sh", "sw"), "img")
    return concepts.rescale_labels(sized, 7, 6).drop("category")


@query(
    "g14_cropped_labels",
    fx.sql(
        f"""SELECT img, ch AS channel, oy::INT AS py, ox::INT AS px, lab AS label
            FROM range(8) a(oy), range(4) b(ox), seg
            WHERE py = {_nearest('oy', 4, 8)} AND px = 1 + {_nearest('ox', 2, 4)}""",
        "seg",
    ),
)
def cropped_labels(spark, sf):
    sized = fx.channels(spark, sf).join(fx.images(spark, sf).select("img", "sh", "sw"), "img")
    return concepts.rescale_labels(sized, 8, 4, crop=True).drop("category")


@query(
    "g15_normalised_flat",
    fx.sql("SELECT img, 0 AS channel, py, px, lab AS label FROM seg WHERE ch = 0", "seg"),
)
def normalised_flat(spark, sf):
    return concepts.normalised_labels(*_grids(spark, sf), "object", flatten=True)


@query(
    "g15_normalised_full",
    fx.sql(
        "SELECT img, 0 AS channel, py::INT AS py, px::INT AS px, lab AS label FROM scal, range(4) a(py), range(4) b(px)",
        "scal",
    ),
)
def normalised_full(spark, sf):
    return concepts.normalised_labels(*_grids(spark, sf), "scene")
