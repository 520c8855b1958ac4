"""Element-wise and matrix algebra on cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitscope.operators.layout import bounded
from unitscope.operators.products import Stripes, by_key, products, unpacked
from unitscope.operators.reshape import shape
from unitscope.schema import ABSENT, IDS
from unitscope.session import cut, release, scratch


def require_same_shape(left: DataFrame, right: DataFrame) -> None:
    """Raise ValueError when the shapes differ; one job for both operands."""
    shapes = shape(left).unionAll(shape(right)).collect()
    if shapes[0] != shapes[1]:
        raise ValueError(f"shapes differ: {tuple(shapes[0])} and {tuple(shapes[1])}")


def _cellwise(
    left: DataFrame,
    right: DataFrame,
    combine: Callable[[Column, Column], Column],
    ids: list[str],
    check: bool,
    fill: float | None,
    ordered: bool,
) -> DataFrame:
    if check:
        require_same_shape(left, right)
    a = left.select(*ids, F.col("value").alias("_a"))
    b = right.select(*ids, F.col("value").alias("_b"))
    joined = a.join(b, ids, "inner" if fill is None else "full")
    va, vb = F.col("_a"), F.col("_b")
    if fill is not None:
        va, vb = F.coalesce(va, F.lit(fill)), F.coalesce(vb, F.lit(fill))
    out = joined.select(*ids, combine(va, vb).alias("value"))
    return out.orderBy(*ids) if ordered else out


def add(left, right, *, check=True, fill=None, ordered=False) -> DataFrame:
    """Cell-wise sum with a tensor of the same shape, or with a number.

    Cells missing on either side drop out unless ``fill`` gives them a value.
    """
    if isinstance(right, (int, float)):
        return left.select(*IDS, (F.col("value") + F.lit(float(right))).alias("value"))
    return _cellwise(left, right, lambda a, b: a + b, IDS, check, fill, ordered)


def subtract(left, right, *, check=True, fill=None, ordered=False) -> DataFrame:
    if isinstance(right, (int, float)):
        return left.select(*IDS, (F.col("value") - F.lit(float(right))).alias("value"))
    return _cellwise(left, right, lambda a, b: a - b, IDS, check, fill, ordered)


def dot_multiply(left, right, *, check=True, fill=None, ordered=False) -> DataFrame:
    return _cellwise(left, right, lambda a, b: a * b, IDS, check, fill, ordered)


def dot_multiply_2d(left, right, left_shape=None, right_shape=None, *, ordered=False) -> DataFrame:
    """Cell-wise product of 2-D cells; shapes the caller knows are compared without a job."""
    if left_shape is not None and right_shape is not None and list(left_shape) != list(right_shape):
        raise ValueError(f"shapes differ: {tuple(left_shape)} and {tuple(right_shape)}")
    return _cellwise(left, right, lambda a, b: a * b, IDS[2:], False, None, ordered)


def dot_divide(left, right, *, check=True, fill=None, ordered=False) -> DataFrame:
    """Cell-wise quotient; null where the divisor is 0."""
    return _cellwise(left, right, F.try_divide, IDS, check, fill, ordered)


#: Pairs of cells that a task of a matrix product is meant to multiply, and tasks at most.
PAIRS, MOST_TASKS = 1_000_000, 20_000


def _dealt(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both operands partitioned by inner index ``_k`` (and salt ``_s``) and the columns to join on.

    An index with more than ``PAIRS`` of them is split: its left cells are dealt to as many
    salts as it takes, its right cells go to each. The number of partitions follows from the
    pairs, not from the bytes before the join.
    """
    sizes = a.groupBy("_k").agg(F.count("*").alias("_m")).join(b.groupBy("_k").agg(F.count("*").alias("_n")), "_k")
    sizes = cut(sizes.select("_k", (F.col("_m") * F.col("_n")).alias("_p")))
    total = sizes.agg(F.sum("_p")).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, -(-total // PAIRS)))
    hot = cut(sizes.where(F.col("_p") > PAIRS).select("_k", F.ceil(F.col("_p") / PAIRS).cast("int").alias("_salts")))
    if hot.isEmpty():
        return a.repartition(tasks, "_k"), b.repartition(tasks, "_k"), ["_k"]
    hot = bounded(hot)
    salts = F.coalesce("_salts", F.lit(1))
    left = a.join(hot, "_k", "left").withColumn("_s", F.pmod(F.xxhash64("id_3"), salts).cast("int")).drop("_salts")
    right = b.join(hot, "_k", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.repartition(tasks, "_k", "_s"), right.repartition(tasks, "_k", "_s"), ["_k", "_s"]


#: Cells of one operand that a task of a striped product holds, pairs that it is meant to multiply,
#: and cells of the result that it adds up at a time.
STRIPE_CELLS, STRIPE_PAIRS, OPEN_CELLS = 2_000_000, 25_000_000, 2_000_000
#: Copies of cells that the number of tasks may lead to (eight times the operands at least), and cells of
#: an inner index that is not gathered in a task.
SENT_CELLS, HEAVY_CELLS = 400_000_000, 500_000
#: Products of fewer pairs are joined cell by cell.
JOINED_PAIRS = 20_000_000

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder, or at ``path``, and read from there.

    Shuffle files that nothing refers to any more are removed then.
    """
    path = path or scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stripe_bounds(df: DataFrame, column: str, stripes: int) -> list[int]:
    """Numbers that part ``column`` into at most ``stripes`` ranges of about as many rows each."""
    if stripes <= 1:
        return []
    found = df.agg(F.percentile_approx(column, [s / stripes for s in range(1, stripes)])).first()[0]
    return sorted({int(b) for b in found or []})


def stripe(column: Column, bounds: list[int]) -> Column:
    """Number of the range that ``column`` lies in, the first for null."""
    if not bounds:
        return F.lit(0)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.when(column.isNull(), 0).otherwise(F.size(F.filter(limits, lambda b: b < column)))


def _ceil(number, by) -> int:
    return max(1, math.ceil(number / by))


_PACKED = "_t int, _side boolean, _cells binary"


def _striped(a: DataFrame, b: DataFrame, pairs: float, rows: int) -> DataFrame:
    """``(id_3, id_4, value)`` from ``a (id_3, _k, _v)`` and ``b (_k, id_4, _v)``, by stripes of the result.

    A task holds the cells of some rows of the left operand and of some columns of the right one,
    and adds up its part of the result, ``rows`` rows at a time: what is shuffled are
    the operands, packed, by inner index and then to every stripe of the other one that holds their inner
    index, never products. Inner indices of many cells go to their stripes straight away. Only
    where one row or column is more than a task holds, or there are too few of them to occupy
    the tasks, the inner indices are dealt to several tasks too and their sums added.
    """
    of_a = a.groupBy("id_3").agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n"), F.max("n")).first()
    of_b = b.groupBy("id_4").agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n"), F.max("n")).first()
    (m_a, n_a, most_a), (m_b, n_b, most_b) = of_a, of_b
    # with t tasks in all, the square root of t * n_a * n_b cells of either side are sent
    tasks = min(MOST_TASKS, _ceil(pairs, STRIPE_PAIRS), _ceil(max(SENT_CELLS, 8 * (n_a + n_b)) ** 2, 4 * n_a * n_b))
    down = min(m_a, max(_ceil(n_a, STRIPE_CELLS), _ceil(math.sqrt(tasks * n_a / n_b), 1)))
    across = min(m_b, max(_ceil(n_b, STRIPE_CELLS), _ceil(tasks, down)))
    inner = max(_ceil(max(most_a, most_b), STRIPE_CELLS), _ceil(tasks, down * across) if down == m_a or across == m_b else 1)
    at_a, at_b = stripe_bounds(a, "id_3", down), stripe_bounds(b, "id_4", across)
    stripes = Stripes(at_a, at_b, inner)
    # at most one inner index for every HEAVY_CELLS cells
    sizes = a.select("_k").unionAll(b.select("_k")).groupBy("_k").agg(F.count("*").alias("_n"))
    heavy = sorted(r["_k"] for r in sizes.where(F.col("_n") > HEAVY_CELLS).select("_k").collect())
    release(a.sparkSession)
    cells = a.select(F.lit(False).alias("_side"), F.col("id_3").alias("_id"), "_k", "_v").unionAll(
        b.select(F.lit(True).alias("_side"), F.col("id_4").alias("_id"), "_k", "_v")
    )
    is_heavy = F.col("_k").isin(heavy)
    buckets, most = _ceil(n_a + n_b, STRIPE_CELLS), OPEN_CELLS

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_key(batches, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from products(unpacked(batches), rows, most)

    light = cells.where(~is_heavy) if heavy else cells
    packed = light.mapInArrow(bucketed, _PACKED).repartitionById(buckets, "_t").mapInArrow(stripes.from_buckets, _PACKED)
    if heavy:
        known = []
        for side, id_, bounds in ((a, "id_3", at_a), (b, "id_4", at_b)):
            found = side.where(is_heavy).select("_k", stripe(F.col(id_), bounds).alias("_s")).distinct().collect()
            found = np.array(sorted((r["_k"], r["_s"]) for r in found), dtype=np.int64).reshape(-1, 2)
            known.append((found[:, 0].copy(), found[:, 1].copy()))

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from stripes.direct(batches, known)

        packed = packed.unionAll(cells.where(is_heavy).mapInArrow(direct, _PACKED))
    dealt = packed.repartitionById((len(at_a) + 1) * (len(at_b) + 1) * inner, "_t").drop("_t")
    out = dealt.mapInArrow(run, _TILE)
    return out if inner == 1 else out.groupBy("id_3", "id_4").agg(F.sum("value").alias("value"))


def multiply_2d(left: DataFrame, right: DataFrame, *, salts: int | None = None, ordered=False) -> DataFrame:
    """Matrix product of 2-D operands.

    Pairs that meet are counted. Few of them are joined, inner indices with many cells split over
    tasks; many are added up in stripes of the result, so that neither products nor partial sums
    are shuffled. ``salts`` joins and splits every inner index alike instead, without counting.
    """
    a = left.select(F.col("id_3"), F.col("id_4").alias("_k"), F.col("value").alias("_a"))
    b = right.select(F.col("id_3").alias("_k"), F.col("id_4"), F.col("value").alias("_b"))
    on = ["_k", "_s"]
    out = None
    if salts is None:
        kinds = {f.name: f.dataType for f in [*a.schema, *b.schema]}
        plain = all(isinstance(kinds[c], _INTEGRAL) for c in ("id_3", "_k", "id_4")) and isinstance(b.schema["_k"].dataType, _INTEGRAL)
        a, b = kept(a.where(F.col("_k").isNotNull())), kept(b.where(F.col("_k").isNotNull()))
        pairs = _pairs(a, b)
        if plain and kinds["_a"] == kinds["_b"] == T.DoubleType() and pairs > max(JOINED_PAIRS, 4 * (a.count() + b.count())):
            out = _striped(_cells(a, "id_3", "_a"), _cells(b, "id_4", "_b"), pairs, OPEN_CELLS)
            out = out.select(F.col("id_3").cast(kinds["id_3"]).alias("id_3"), F.col("id_4").cast(kinds["id_4"]).alias("id_4"), "value")
        else:
            a, b, on = _dealt(a, b)
    else:
        a = a.withColumn("_s", F.pmod(F.xxhash64("id_3"), F.lit(salts)).cast("int"))
        b = b.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if out is None:
        out = a.join(b, on).groupBy("id_3", "id_4").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))
    absent = F.lit(ABSENT).cast("long")
    out = out.select(absent.alias("id_1"), absent.alias("id_2"), "id_3", "id_4", "value")
    return out.orderBy("id_3", "id_4") if ordered else out


def _pairs(a: DataFrame, b: DataFrame) -> float:
    """Number of pairs that meet on ``_k``."""
    sizes = a.groupBy("_k").agg(F.count("*").alias("_m")).join(b.groupBy("_k").agg(F.count("*").alias("_n")), "_k")
    return sizes.agg(F.sum(F.col("_m").cast("double") * F.col("_n"))).first()[0] or 0.0


def _cells(df: DataFrame, outer: str, value: str) -> DataFrame:
    return df.select(F.col(outer).cast("long").alias(outer), F.col("_k").cast("long").alias("_k"), F.col(value).cast("double").alias("_v"))


_TILE = "id_3 long, id_4 long, value double"


def multiply_tiled(left: DataFrame, right: DataFrame, block: int = 256, *, ordered=False) -> DataFrame:
    """Matrix product of dense 2-D operands, by tiles of ``block`` rows.

    Tiles of the result are added up as arrays inside the tasks, which hold the cells of some rows
    of the left and of some columns of the right operand; a tile leaves its task as finished cells,
    so no partial sums are shuffled. Cells of the result exist where the operands share an
    inner index, as in :func:`multiply_2d`.
    """
    a = kept(_cells(left.where(F.col("id_4").isNotNull()).withColumnRenamed("id_4", "_k"), "id_3", "value"))
    b = kept(_cells(right.where(F.col("id_3").isNotNull()).withColumnRenamed("id_3", "_k"), "id_4", "value"))
    absent = F.lit(ABSENT).cast("long")
    pairs = _pairs(a, b)
    if pairs:
        out = _striped(a, b, pairs, block)
    else:
        out = a.join(b.drop("_v"), "_k").select("id_3", "id_4", F.col("_v").alias("value"))
    out = out.select(absent.alias("id_1"), absent.alias("id_2"), "id_3", "id_4", "value")
    return out.orderBy("id_3", "id_4") if ordered else out


def multiply_batched(left: DataFrame, right: DataFrame, *, ordered=False) -> DataFrame:
    """Matrix product per ``(id_1, id_2)``, like a stack of 2-D products."""
    lead = IDS[:2]
    a = left.select(*lead, "id_3", F.col("id_4").alias("_k"), F.col("value").alias("_a"))
    b = right.select(*lead, F.col("id_3").alias("_k"), "id_4", F.col("value").alias("_b"))
    out = (
        a.join(b, [*lead, "_k"])
        .groupBy(*IDS)
        .agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))
    )
    return out.orderBy(*IDS) if ordered else out
