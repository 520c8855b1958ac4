"""Near-duplicate documents by an inverted join over MinHash coordinates.

Every document posts its id under each pair of signature coordinate and value. Two
documents of the wanted similarity share, but for odds of about one in a hundred thousand at
the threshold itself, at least ``MATCHES`` of the ``COORDINATES`` pairs. The join finds those:

* documents with equal shingle sets are one class, and only its smallest id posts;
* pairs that nobody shares are dropped; the rest of a document's pairs are ordered by how
  many share them, and only the prefix posts that two documents with enough matches must
  meet in (``shared - MATCHES + 1`` rarest ones);
* the lists are read in rounds. A round compares one document of each list with the
  rest, first the one that shares most, then the smallest id; it confirms links on full
  shingle sets and joins what is linked into components. Later rounds skip pairs that are in one
  component already, so a large group of copies costs a few comparisons for each member
  and never all its pairs;
* the last round compares every pair that is still apart and may be similar: in no hash class
  of shingles can more be common than either document has that any document left also has;
* comparing counts the collisions of the two whole signatures, skipping the lists.

Defined results: a null or empty text, or one without words, has no shingles and is linked
with nothing. Texts of fewer than five words are one shingle. Rows that share an id are one document
with the shingles of all of them. A null id is never linked and is its own component. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitscope.llm.common import (
    arrow, byte_texts, cut, lists, mix, quoted, set_digests, shingle_sets, small_side, table, word_hashes,
)
from unitscope.llm.registry import query
from unitscope.operators.graph import connected_components

WIDTH = 5
SIMILAR = (75, 100)
COORDINATES = 64
MATCHES = 33
#: Hash classes of shingles; what two documents can have in common is bounded in each.
CLASSES = 64


def minhash(values: np.ndarray, sizes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Signatures of non-empty sets: one row each, the smallest 32-bit hash under every coordinate."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), coordinates), dtype=np.int32)
    rng = np.random.default_rng(2024)
    with np.errstate(over="ignore"):
        for k, odd in enumerate(rng.integers(1, 2**63, coordinates, dtype=np.uint64) | np.uint64(1)):
            h = ((values * odd) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(h, starts).view(np.int32)
    return out


def shingled(docs: DataFrame, with_sets: bool, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n, d1, d2, signature)`` of every document, or ``(doc_id, n, shingles)``."""
    schema = "doc_id long, n long, " + ("shingles array<long>" if with_sets else "d1 long, d2 long, signature binary")

    def make(batch: pa.RecordBatch) -> dict:
        texts = [t.lower() for t in byte_texts(batch.column(1))]
        values, sizes = shingle_sets(*word_hashes(texts), width)
        out = {"doc_id": batch.column(0), "n": pa.array(sizes)}
        if with_sets:
            return out | {"shingles": lists(values.view(np.int64), sizes)}
        some = np.flatnonzero(sizes)
        rows: list[bytes | None] = [None] * len(sizes)
        if len(some):
            signs = minhash(mix(values), sizes[some])
            for i, s in zip(some, signs):
                rows[i] = s.tobytes()
        d1, d2 = set_digests(values, sizes)
        return out | {"d1": pa.array(d1), "d2": pa.array(d2), "signature": pa.array(rows, pa.binary())}

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), make, schema)


def whole(docs: DataFrame) -> DataFrame:
    """One row per id: rows that repeat an id are joined, with a mark no word or shingle crosses alike."""
    twice = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("_c")).where("_c > 1")
    if twice.isEmpty():
        return docs.select("doc_id", "text")
    same = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("text")
    )
    return same.unionByName(docs.where(F.col("doc_id").isNull()).select("doc_id", "text"))


def matches(pairs: DataFrame, signs: DataFrame, least: int = MATCHES) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures agree in at least ``least`` coordinates and whose sizes allow a link."""
    one = signs.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("signature").alias("_sa"))
    two = signs.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("signature").alias("_sb"))
    num, den = SIMILAR
    met = pairs.join(one, "a").join(two, "b").where(
        (F.least("_na", "_nb") * den >= F.greatest("_na", "_nb") * num)
    )

    def make(batch: pa.RecordBatch) -> dict:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.int32).reshape(batch.num_rows, -1) for i in (2, 3))
        good = pa.array((a == b).sum(axis=1) >= least)
        return {"a": batch.column(0).filter(good), "b": batch.column(1).filter(good)}

    return arrow(met.select("a", "b", "_sa", "_sb"), make, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that full shingle sets confirm. ``pairs`` has been cut."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = cut(shingled(docs.join(small_side(ids), "doc_id", "left_semi"), True))
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_sb"))
    num, den = SIMILAR

    def make(batch: pa.RecordBatch) -> dict:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            same = len(np.intersect1d(x, y, assume_unique=True))
            good.append(den * same >= num * (len(x) + len(y) - same))
        keep = pa.array(good, pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "_sa", "_sb"), make, "a long, b long")


def posted(signs: DataFrame, least: int = MATCHES) -> DataFrame:
    """``(key, id, shared)``: the prefix of every document's shared coordinate-value pairs, rarest first."""

    def make(batch: pa.RecordBatch) -> dict:
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1)
        k = s.shape[1]
        keys = s.astype(np.int64) << 7 | np.arange(k)
        return {"key": pa.array(keys.ravel()), "id": pa.array(np.repeat(batch.column(0).to_numpy(), k))}

    posts = arrow(signs.select("id", "signature"), make, "key long, id long").repartition("key")
    often = posts.groupBy("key").agg(F.count("*").alias("_f")).where("_f > 1")
    mine = Window.partitionBy("id")
    return (
        posts.join(often.hint("shuffle_hash"), "key")
        .withColumn("_rank", F.row_number().over(mine.orderBy("_f", "key")))
        .withColumn("shared", F.count("*").over(mine))
        .where(F.col("_rank") <= F.col("shared") - (least - 1))
        .select("key", "id", "shared")
    )


def common_shingles(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, n, q, counts)``: the shingles of each of ``ids``, those that another of them has too, and
    how many of these fall into each of ``CLASSES`` hash classes. ``ids`` has been cut."""
    sets = shingled(docs.join(small_side(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi"), True)
    rows = cut(sets.select(F.col("doc_id").alias("id"), "n", F.explode("shingles").alias("g")))
    twice = rows.groupBy("g").agg(F.count("*").alias("_f")).where("_f > 1").select("g")
    split = rows.join(twice, "g").groupBy("id", "n", F.pmod("g", F.lit(CLASSES)).cast("int").alias("c")).agg(F.count("*").alias("_n"))
    held = split.groupBy("id", "n").agg(F.sum("_n").alias("q"), F.map_from_entries(F.collect_list(F.struct("c", "_n"))).alias("_m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)))
    return held.select("id", "n", "q", counts.alias("counts"))


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document with an id."""
    docs = whole(docs)
    seen = cut(shingled(docs, False))
    full = seen.where(F.col("n") > 0).where(F.col("doc_id").isNotNull())
    classes = cut(full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id")))
    signs = cut(
        full.join(classes.select("id"), full["doc_id"] == classes["id"], "left_semi").select(F.col("doc_id").alias("id"), "n", "signature")
    )
    posts = cut(posted(signs))
    links, labels = None, None
    num, den = SIMILAR
    for head in (F.struct("shared", -F.col("id")), -F.col("id"), None):
        current = posts.withColumn("comp", F.col("id"))
        if labels is not None:
            current = posts.join(labels, posts["id"] == labels["node"], "left").select(
                "key", "id", "shared", F.coalesce("component", "id").alias("comp")
            )
            apart = current.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
            current = cut(current.join(apart.select("key"), "key", "left_semi"))
        if head is not None:
            first = current.groupBy("key").agg(F.max_by(F.struct("id", "comp"), head).alias("_h"))
            pairs = current.join(first, "key").where(F.col("comp") != F.col("_h.comp")).select(
                F.least("id", "_h.id").alias("a"), F.greatest("id", "_h.id").alias("b")
            )
        else:
            bound = cut(common_shingles(docs, cut(current.select("id").distinct())))
            # 4 q >= 3 n, else nothing can be similar
            one = cut(current.join(bound, "id").where(den * F.col("q") >= num * F.col("n")))
            two = one.select("key", F.col("id").alias("b"), F.col("comp").alias("_cb"), F.col("n").alias("_nb"), F.col("q").alias("_qb"), F.col("counts").alias("_kb"))
            classwise = F.aggregate(F.zip_with("counts", "_kb", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda a, x: a + x)
            most = F.least("q", "_qb")
            pairs = one.withColumnRenamed("id", "a").join(two, "key").where(
                (F.col("a") < F.col("b")) & (F.col("comp") != F.col("_cb"))
                & (F.least("n", "_nb") * den >= F.greatest("n", "_nb") * num)
                & ((num + den) * most >= num * (F.col("n") + F.col("_nb")))
                & ((num + den) * classwise >= num * (F.col("n") + F.col("_nb")))
            ).select("a", "b")
        found = cut(matches(pairs.distinct(), signs))
        if not found.isEmpty():
            new = cut(confirm(found, docs))
            links = new if links is None else links.unionByName(new)
            labels = connected_components(links)
    groups = full.join(classes, ["d1", "d2", "n"]).select("doc_id", "id")
    if labels is not None:
        groups = groups.join(labels, groups["id"] == labels["node"], "left").select(
            "doc_id", F.coalesce("component", "id").alias("id")
        )
    out = seen.join(groups, "doc_id", "left").withColumn("component_id", F.coalesce("id", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the smallest id of their component."""
    gone = cut(components(docs).where(~F.col("kept")).select("doc_id"))
    return docs.join(small_side(gone), "doc_id", "left_anti").select([quoted(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g
    FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
    SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * same >= 75 * (x.n + y.n - same)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a),
low AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low.other, w.doc_id)) AS component_id,
       least(w.doc_id, coalesce(low.other, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


@query("op2_near_dup", SQL)
def op2_near_dup(spark, sf_dir):
    return components(table(spark, sf_dir, "documents"))
