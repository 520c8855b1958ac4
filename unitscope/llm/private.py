"""Personal data: pattern spans, and terms that reveal what the patterns protect.

Built-in functions only. Patterns give the base spans (email, ip, card, phone). The values they
find are the protected entities. Every word that shares a text with an entity is weighed by co-occurrence: with
``N`` different texts, ``n(t)`` texts with the term, ``n(v)`` with the entity and ``n(t, v)`` with both,

    disclosure = log2(n(t, v) N / (n(t) n(v))) / log2(N / n(v)),

the share of the entity's information that the term gives away (1: it occurs nowhere else). A term reveals an entity
if its disclosure is at least ``DISCLOSURE`` and so many common texts are no chance: by the Chernoff bound
``exp(-n(v) KL(n(t, v) / n(v), n(t) / N))``, times the number of terms, at most ``CHANCE``. Every mention of a revealing
term, in each text that holds the entity, gets a span of the kind ``term``. ``sanitise`` generalises entities to their
kind and removes revealing terms.

Defined results: a null or empty text has no spans. Rows are judged each for itself; copies of a text count as one. An empty table gives no rows.
Positions count code points, the end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitscope.llm.common import aside, cut, small_side, table
from unitscope.llm.registry import query

# What a span of each kind looks like. A match starts where a run of its first
# characters starts or the last match ended, and never gives characters back, so that long
# runs take linear time and no stack.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]+"
#: Odds that any term of the corpus meets an entity so often by chance.
CHANCE = 0.01
DISCLOSURE = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the last digit checks the others: every second one from the right counts double."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.floor(F.substring(digits, i, F.lit(1)).cast("int") * 2 / 10).cast("int") + F.substring(digits, i, F.lit(1)).cast("int") * 2 % 10
        ),
    )
    return (n > 0) & (total % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."),
            lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """``(_row, doc_id, _k, text, _spans)`` of every row of ``(doc_id, text)``, cut: base spans by
    start, then kind, and the text where a pattern met it.

    A pattern gives the matches and the gaps before them; places are running sums of their
    lengths, over rows, so a text full of matches takes linear time.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.xxhash64("text").alias("_k"), "text")
    for kind, pattern in PATTERNS.items():
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        hint = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind)
        found = found.withColumn(f"_m_{kind}", values if hint is None else F.when(hint, values).otherwise(F.array().cast("array<string>")))
    for kind, pattern in PATTERNS.items():
        found = found.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.transform(F.split(text, pattern, -1), F.length)))
    numbered = [
        F.transform(
            F.zip_with(f"_m_{kind}", F.slice(f"_g_{kind}", F.lit(1), F.size(f"_m_{kind}")), lambda v, g: F.struct(v.alias("v"), g.alias("g"))),
            lambda x, i: F.struct(F.lit(n).alias("kind"), i.alias("i"), x["v"].alias("v"), x["g"].alias("g")),
        )
        for n, kind in enumerate(PATTERNS)
    ]
    none = F.array().cast("array<struct<kind:int,i:int,v:string,g:int>>")
    matches = F.concat(*[F.coalesce(m, none) for m in numbered])
    found = found.select("doc_id", "_k", "text", matches.alias("_m"))
    # the row numbers are cut with what they number, so a lost task cannot change them
    found = cut(found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "_k", "_m", F.when(F.size("_m") > 0, F.col("text")).alias("text")))
    so_far = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = found.select("_row", F.inline("_m")).withColumn("_end", F.sum(F.col("g") + F.length("v")).over(so_far).cast("int"))
    valid = F.lit(False)
    for n, kind in enumerate(PATTERNS):
        valid = F.when(F.col("kind") == n, _valid(kind, F.col("v"))).otherwise(valid)
    span = F.struct((F.col("_end") - F.length("v")).alias("start"), "kind", F.col("_end").alias("end"))
    spans = spans.where(valid).groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    return found.drop("_m").join(spans, "_row", "left").withColumn("_spans", F.coalesce("_spans", F.array().cast(_SPAN)))


def _words(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def entities(found: DataFrame) -> DataFrame:
    """``(_row, _k, v)``: which entity values a row holds, each once."""
    value = lambda x: F.xxhash64(x["kind"], F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]))
    return found.where(F.size("_spans") > 0).select("_row", "_k", F.explode(F.array_distinct(F.transform("_spans", value))).alias("v"))


def term_counts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(term, _nt)``: in how many different texts a term stands. Copies are taken off again, so that no text is shuffled for them."""
    words = docs.where(F.col("text").isNotNull()).select(F.explode(_words(F.col("text"))).alias("term"), F.lit(1).cast("long").alias("n"))
    copied = cut(found.groupBy("_k").agg((F.count("*") - 1).alias("_more")).where("_more > 0"))
    again = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("_k"), "text").join(small_side(copied), "_k")
    again = again.groupBy("_k").agg(F.first("text").alias("text"), F.first("_more").alias("_more"))
    less = again.select(F.explode(_words(F.col("text"))).alias("term"), (-F.col("_more")).alias("n"))
    # counted before they meet, so a word that every text has is one row of each task
    return words.groupBy("term").agg(F.sum("n").alias("n")).unionByName(less).groupBy("term").agg(F.sum("n").alias("_nt"))


def revealing(docs: DataFrame, found: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(v, c)``, the class of every entity that can be given away, and ``(c, term, disclosure)`` of the terms
    that do so. Entities in the same texts are one class. ``found`` and ``held`` have been cut."""
    spread = cut(term_counts(docs, found))
    total = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text")).distinct().count()
    limit = math.log(max(spread.count(), 1) / CHANCE)
    # one common text has a chance of 1 / total at least
    least = 1 if math.log(max(total, 1)) >= limit else 2
    sets = held.select("v", "_k").distinct().groupBy("v").agg(
        F.count("*").alias("_nv"), F.bit_xor(F.xxhash64("_k", F.lit(1))).alias("_x"), F.bit_xor(F.xxhash64("_k", F.lit(2))).alias("_y")
    )
    classes = cut(sets.where((F.col("_nv") >= least) & (F.col("_nv") < total)).select("v", "_nv", F.xxhash64("_nv", "_x", "_y").alias("c")))
    # copies of a text have one row that speaks for all
    texts = held.join(small_side(classes.select("v", "c")), "v").groupBy("_k").agg(F.min("_row").alias("_row"), F.collect_set("c").alias("_cs"))
    pairs = found.select("_row", "text").join(small_side(cut(texts.select("_row", "_cs"))), "_row")
    pairs = pairs.select("_cs", F.explode(_words(F.col("text"))).alias("term")).select("term", F.explode("_cs").alias("c"))
    pairs = cut(pairs.groupBy("c", "term").agg(F.count("*").alias("_ntv")).where(F.col("_ntv") >= least))
    some = spread.join(small_side(cut(pairs.select("term").distinct())), "term", "left_semi")
    a, q = F.col("_ntv") / F.col("_nv"), F.col("_nt") / F.lit(total)
    apart = a * F.log(a / q) + F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - q))).otherwise(0.0)
    gives = F.log2(a / q) / F.log2(F.lit(total) / F.col("_nv"))
    risky = (
        pairs.join(some, "term").join(classes.select("c", "_nv").distinct(), "c")
        .where((a > q) & (F.col("_nv") * apart >= limit))
        .select("c", "term", gives.alias("disclosure"))
        .where(F.col("disclosure") >= DISCLOSURE)
    )
    return classes.select("v", "c"), cut(risky)


def mentions(found: DataFrame, marks: DataFrame) -> DataFrame:
    """``(_row, at, n)`` of every mention of the terms ``(_row, term)`` in their rows. ``marks`` has been cut."""
    text = F.col("text")
    rows = found.select("_row", "text").join(small_side(cut(marks.select("_row").distinct())), "_row", "left_semi")
    words = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    gaps = F.transform(F.split(text, TERM, -1), F.length)
    pieces = F.zip_with(words, F.slice(gaps, F.lit(1), F.size(words)), lambda w, g: F.struct(F.lower(w).alias("term"), F.length(w).alias("n"), g.alias("g")))
    pieces = rows.select("_row", F.posexplode(pieces).alias("i", "_p")).select("_row", "i", "_p.term", "_p.n", "_p.g")
    so_far = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("at", (F.sum(F.col("g") + F.col("n")).over(so_far) - F.col("n")).cast("int"))
    return placed.join(marks, ["_row", "term"], "left_semi").select("_row", "at", "n")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: base spans and those of revealing terms, by start, then kind."""
    docs = docs.select("doc_id", "text")
    found = cut(base_spans(docs))
    held = cut(entities(found))
    classes, risky = revealing(docs, found, held)
    marks = held.join(small_side(classes), "v").select("_row", "c").distinct().join(small_side(risky), "c").select("_row", "term")
    more = mentions(found, cut(marks.distinct())).groupBy("_row").agg(
        F.collect_list(F.struct(F.col("at").alias("start"), F.lit(4).alias("kind"), (F.col("at") + F.col("n")).alias("end"))).alias("_more")
    )
    # words inside an entity are no terms
    outside = F.filter("_more", lambda t: ~F.exists("_spans", lambda x: (x["start"] < t["end"]) & (x["end"] > t["start"])))
    return (
        found.join(more, "_row", "left")
        .withColumn("spans", F.array_sort(F.concat("_spans", F.coalesce(outside, F.array().cast(_SPAN)))))
        .select("doc_id", "_k", "_spans", "spans")
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``clean``: entities generalised to their kind, revealing terms removed. Other columns stay as they are."""
    docs, back = aside(docs, {"doc_id", "text"})
    told = find(docs.select("doc_id", "text")).groupBy("doc_id", "_k").agg(F.first("spans").alias("spans")).withColumnRenamed("doc_id", "_d").withColumnRenamed("_k", "_h")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit(""))
    rows = docs.join(told, docs["doc_id"].eqNullSafe(told["_d"]) & (F.xxhash64(docs["text"]) == told["_h"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        "spans", start,
        lambda a, x: F.when(x["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.get(names, x["kind"])).alias("out"), x["end"].alias("at"))
        ),
    )
    rows = rows.withColumn("_x", done)
    clean = F.when(F.col("text").isNotNull(), F.concat("_x.out", F.expr("substring(text, _x.at + 1)")))
    return rows.withColumn("clean", clean).select(*back, "clean")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


@query("op7_private_data")
def op7_private_data(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda n: F.size(F.filter("_spans", lambda x: x["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:4])],
        F.sha2(joined(F.col("_spans")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
