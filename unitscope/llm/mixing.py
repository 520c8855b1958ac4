"""Mixing sources to target weights by exact cuts through hash-ordered documents.

Every document gets a hash-random key. Inside its source documents are sorted by key;
sums of sizes over ranges of the key (``RANGES`` of them a source) are added up first, then
the sums inside each range, so no task sees a whole source. A source with the target ``t`` and
``s`` words takes ``floor(t / s)`` whole epochs and the documents before the cut at the rest;
the document at the cut gives only the words before it.

Defined results: a null or empty text has size 0 and takes nothing. Null is a source of its own,
last in order. Rows that are equal in id and text are separate documents, cut in any
order. Sources without a word have target 0. An empty table gives no rows. In the mix other columns stay as
they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitscope.llm.common import WORD, aside, cut, quoted, table
from unitscope.llm.registry import query

WEIGHTS = (5, 2, 1)
#: All targets together and each source's largest target, in sizes.
SHARE, MOST = 1.5, 2.0
RANGES = 4096
USED = {"doc_id", "source", "text"}


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)``, one row a source, from ``(source, size)``.

    Sources that reach ``most`` times their size are those with the smallest room for
    their weight; what is over goes to the rest by weight.
    """
    spark = rows.sparkSession
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on; UTF-8 bytes sort as code points do
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    by_room = Window.orderBy("_room", "_n").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy("_room", "_n").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    pick = F.array(*[F.lit(float(w)) for w in weights])
    laid = (
        total.withColumn("_n", F.row_number().over(order) - 1)
        .withColumn("_w", F.get(pick, F.col("_n") % len(weights)))
        .withColumn("_room", most * F.col("source_size") / F.col("_w"))
        .withColumn("_capped", F.coalesce(F.sum("source_size").over(by_room), F.lit(0)))
        .withColumn("_weights", F.sum("_w").over(from_here))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_per", (share * F.col("_all") - most * F.col("_capped")) / F.col("_weights"))
        # the first source, by room, that stays below its limit sets the words a weight is worth
        .withColumn("_value", F.min(F.when(F.col("_per") <= F.col("_room"), F.struct("_room", "_n", "_per"))).over(everything)["_per"])
    )
    limit = most * F.col("source_size")
    return laid.select("source", "source_size", F.coalesce(F.least(limit, F.col("_w") * F.col("_value")), limit).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``epochs`` (whole ones) and ``rest``:
    the words of one more reading, and ``taken = epochs * size + rest``."""
    new = ["size", "source_size", "target", "epochs", "rest", "taken"]
    rows, back = aside(docs, USED)
    kept = [column for column, name in zip(back, docs.columns) if name.lower() not in new]
    return place(rows.withColumn("size", sizes(F.col("text"))), rows.columns).select(*kept, *new)


def place(rows: DataFrame, columns: list[str]) -> DataFrame:
    """As ``mixed``, for rows that have their ``size`` and the columns ``_key`` is made of."""
    total = cut(targets(rows.select("source", "size")))
    key = F.xxhash64(F.lit(11), F.col("doc_id"), text_or_id(rows))
    rows = rows.withColumn("_key", key).withColumn("_range", F.shiftrightunsigned("_key", 52).cast("int"))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    ranges = ranges.join(F.broadcast(total) if total.count() <= 100_000 else total, ranges["source"].eqNullSafe(total["source"])).select(
        ranges["source"].alias("_s"), F.col("_range").alias("_r"), "_before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    return (
        rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("_before") - F.col("_in"))))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("rest"))
        .select(*[quoted(c) for c in columns], "size", "source_size", "target", "epochs", "rest", "taken")
    )


def text_or_id(rows: DataFrame) -> Column:
    return F.coalesce(F.col("_digest") if "_digest" in rows.columns else F.xxhash64("text"), F.lit(0))


def mix_corpus(docs: DataFrame) -> DataFrame:
    """The documents of the mix: a row for each reading, the last one cut to its words."""
    rows, back = aside(docs, USED | {"n_chars"})
    out = place(rows.withColumn("size", sizes(F.col("text"))), rows.columns)
    whole = F.col("rest") == F.col("size")
    # the text up to the end of word number ``rest``; possessive, so long texts need no stack
    head = F.concat(F.lit(r"^((?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("rest").cast("string"), F.lit("}+)"))
    part = F.when(whole, F.col("text")).otherwise(F.expr("regexp_extract(text, _head, 1)"))
    reading = F.transform(F.sequence(F.lit(1), F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)), lambda i: F.when(i <= F.col("epochs"), F.col("text")).otherwise(part))
    some = out.where(F.col("taken") > 0).withColumn("_head", head).withColumn("_read", F.explode(reading))
    made = {"text": F.col("_read"), "n_chars": F.length("_read").cast("long")}
    return some.select([made[c.lower()].alias(c) if c.lower() in made else column for column, c in zip(back, docs.columns)])


@query("op5_mixing", None)
def op5_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", sizes(F.col("text")).alias("size"), F.xxhash64("text").alias("_digest"))
    return place(rows, ["doc_id"])
