"""Per-channel quantiles: exact order statistics, approximations and mergeable sketches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitscope.operators.layout import BROADCAST_ROWS
from unitscope.session import cut

#: Readout position of the activation threshold: index 994 of 1000 even points on [0, 1].
THRESHOLD_QUANTILE = 994 / 999

#: Even cut points, and how often a bucket may be cut again (64 ways each time).
_EVEN = [i / 64 for i in range(1, 64)]
_MAX_DEPTH = 5


def _probes(qs: list[float], accuracy: int) -> list[float]:
    """Where to cut a group so that few values share a bucket with a wanted quantile."""
    if len(qs) > 8:
        return _EVEN
    margin = 2.0 / accuracy
    cuts = {min(1.0, max(0.0, q + d)) for q in qs for d in (-margin, margin)}
    return sorted(cuts)


def _with_bucket(df: DataFrame, n_edges: int) -> DataFrame:
    """Number ``_b`` of sorted ``_edges`` below ``_v``, by bisection in plain columns.

    Each step is a column of its own, so it is computed once per row.
    """
    step = 1 << (n_edges.bit_length() - 1)
    df = df.withColumn("_b", F.lit(0))
    while step:
        at = F.col("_b") + F.lit(step - 1)
        below = (at < n_edges) & (F.get("_edges", at) < F.col("_v"))
        df = df.withColumn("_b", F.col("_b") + F.when(below, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return df


def _position(q: Column, n: Column, method: str) -> Column:
    if method == "linear":
        return q * (n - 1)
    return F.least(F.greatest(q * n - F.lit(0.5), F.lit(0.0)), (n - 1).cast("double"))


def _broadcaster(size: int) -> Callable[[DataFrame], DataFrame]:
    """Broadcast tables of up to ``size`` numbers if that is little, else leave the join to Spark."""
    return F.broadcast if size <= 10 * BROADCAST_ROWS else (lambda df: df)


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    qs: list[float],
    method: str = "linear",
    accuracy: int = 10_000,
    bucket_rows: int = 4_000_000,
) -> DataFrame:
    """Exact quantiles as rows ``(*by, q_idx, q, quantile)``; null and NaN are skipped.

    ``linear`` interpolates at ``q * (n - 1)``, ``midrank`` at ``q * n - 1/2``.

    No group is ever gathered in one task. A small sketch per group proposes cut points
    close to the wanted quantiles; exact counts between the cuts tell which buckets hold
    them; only those buckets are shuffled, with equal values collapsed first, and
    numbered. Buckets of more than ``bucket_rows`` different values are cut again. The
    sketch steers the balance only, the result does not depend on it.
    """
    if method not in ("linear", "midrank"):
        raise ValueError(f"unknown method {method}")
    qs = [float(q) for q in qs]
    number = F.col(value).cast("double")
    # adding 0.0 turns -0.0 into 0.0, so both count as one value
    vals = df.where(number.isNotNull() & ~F.isnan(number)).select(
        *by, (number + F.lit(0.0)).alias("_v")
    )
    keys, probes, wanted = list(by), _probes(qs, accuracy), None
    for depth in range(_MAX_DEPTH):
        edges = cut(
            vals.groupBy(*keys).agg(F.percentile_approx("_v", probes, accuracy).alias("_edges"))
        )
        # edges hold a list per group; targets and buckets a few rows per group and quantile
        ship = _broadcaster(edges.count() * max(len(probes), 2 * len(qs)))
        tagged = _with_bucket(vals.join(ship(edges), keys), len(probes)).drop("_edges")
        upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = (
            tagged.groupBy(*keys, "_b")
            .agg(F.count("*").alias("_n_b"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
            .withColumn("_before", F.coalesce(F.sum("_n_b").over(upto), F.lit(0)))
        )
        if wanted is None:
            placed = _positions(counts, keys, qs, method)
        else:
            placed = counts.join(ship(wanted), keys).withColumn("_off", F.col("_off") + F.col("_before"))
        inside_bucket = (F.col("_k") >= F.col("_off")) & (F.col("_k") < F.col("_off") + F.col("_n_b"))
        targets = cut(placed.where(inside_bucket).drop("_before"))
        largest = targets.where("_min < _max").agg(F.max("_n_b")).first()[0] or 0
        if largest <= bucket_rows or depth == _MAX_DEPTH - 1:
            break
        name = f"_b{depth}"
        buckets = targets.select(*keys, "_b").distinct()
        vals = cut(tagged.join(ship(buckets), [*keys, "_b"]).withColumnRenamed("_b", name))
        wanted = targets.withColumnRenamed("_b", name).drop("_n_b", "_min", "_max")
        keys, probes = [*keys, name], _EVEN
    buckets = targets.select(*keys, "_b", "_off").distinct()
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    spans = (
        tagged.join(ship(buckets), [*keys, "_b"])
        .groupBy(*keys, "_b", "_off", "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn("_end", F.col("_off") + F.sum("_c").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .drop("_off")
    )
    found = spans.join(ship(targets), [*keys, "_b"]).where(
        (F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_end"))
    )
    low = F.max(F.when(F.col("_k") == F.col("_low"), F.col("_v")))
    high = F.max(F.when(F.col("_k") == F.col("_high"), F.col("_v")))
    return (
        found.groupBy(*by, "q_idx", "q", "_frac")
        .agg(low.alias("_lo"), high.alias("_hi"))
        .select(
            *by,
            "q_idx",
            "q",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile"),
        )
    )


def _positions(counts: DataFrame, by: list[str], qs: list[float], method: str) -> DataFrame:
    """Buckets of a group times the order statistics ``_k`` every quantile needs."""
    wanted = F.array(
        *[F.struct(F.lit(i).alias("q_idx"), F.lit(q).alias("q")) for i, q in enumerate(qs)]
    )
    return (
        counts.withColumn("_n", F.sum("_n_b").over(Window.partitionBy(*by)))
        .withColumn("_off", F.col("_before"))
        .withColumn("_w", F.explode(wanted))
        .select(*[c for c in counts.columns], "_n", "_off", "_w.q_idx", "_w.q")
        .withColumn("_pos", _position(F.col("q"), F.col("_n"), method))
        .withColumn("_frac", F.col("_pos") - F.floor("_pos"))
        .withColumn("_low", F.floor("_pos"))
        .withColumn("_high", F.least(F.col("_low") + 1, F.col("_n") - 1))
        .withColumn("_k", F.explode(F.array_distinct(F.array("_low", "_high"))))
        .drop("_n", "_pos")
    )


def unit_thresholds(cells: DataFrame, q: float = THRESHOLD_QUANTILE) -> DataFrame:
    """One activation threshold per unit over all images and positions."""
    return exact_quantiles(cells, ["unit"], "v", [q]).select(
        "unit", F.col("quantile").alias("thresh")
    )


def channel_quantile(mat: DataFrame, p: float = 0.95, accuracy: int = 10_000) -> DataFrame:
    """Approximate quantile per channel of a tensor whose channel is on ``id_4``."""
    return mat.groupBy("id_4").agg(
        F.percentile_approx("value", p, accuracy).alias("approx_quantile")
    )


def quantiles(df, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Interpolated quantiles at mid-rank positions."""
    return exact_quantiles(df, by, value, qs, method="midrank")


def percentiles(df, by: list[str], value: str, ps: list[float]) -> DataFrame:
    """Quantiles at ``p * (n - 1)``, as numpy places them; ``ps`` are fractions 0..1."""
    return exact_quantiles(df, by, value, ps, method="linear")


def readout(df, by: list[str], value: str, count: int) -> DataFrame:
    """``count`` evenly spaced quantiles from 0 to 1."""
    return percentiles(df, by, value, [i / (count - 1) for i in range(count)])


def minmax(df, by: list[str], value: str) -> DataFrame:
    """Extremes per group, NaN ignored; NaN for a group that holds nothing else."""
    number = F.col(value).cast("double")
    kept = F.when(~F.isnan(number), number)
    nan = F.lit(float("nan"))
    return df.groupBy(*by).agg(
        F.coalesce(F.min(kept), nan).alias("min_v"), F.coalesce(F.max(kept), nan).alias("max_v")
    )


def integrate(df, by: list[str], value: str, fun: Callable[[Column], Column]) -> DataFrame:
    """Sum of a column function over all values of a group."""
    return df.groupBy(*by).agg(F.sum(fun(F.col(value).cast("double"))).alias("integral"))


#: Size of a sketch: ranks are off by about a tenth of a percent at most.
SKETCH_K = 4096


def build_sketch(df, by: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """One mergeable quantile sketch per group."""
    return df.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch")
    )


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Combine sketches of disjoint batches into one per group."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """Quantile estimates as rows ``(*by, q_idx, estimate)``."""
    ranks = F.array(*[F.lit(float(q)) for q in qs])
    estimates = F.kll_sketch_get_quantile_double("sketch", ranks)
    return sketches.select(*by, F.posexplode(estimates).alias("q_idx", "estimate"))


def sketch_sizes(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Number of values every sketch has seen."""
    return sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("seen"))


def sketch_report(
    df: DataFrame, sketches: DataFrame, by: list[str], value: str, qs: list[float]
) -> DataFrame:
    """Values seen and largest deviation from the exact quantiles, relative to the range."""
    exact = percentiles(df, by, value, qs)
    spread = minmax(df, by, value)
    sizes = sketch_sizes(sketches, by)
    deviation = F.max(F.abs(F.col("estimate") - F.col("quantile"))).alias("_dev")
    worst = (
        sketch_quantiles(sketches, by, qs).join(exact, [*by, "q_idx"]).groupBy(*by).agg(deviation)
    )
    relative = F.try_divide(F.col("_dev"), F.col("max_v") - F.col("min_v"))
    return (
        worst.join(spread, by)
        .join(sizes, by)
        .select(*by, "seen", F.coalesce(relative, F.lit(0.0)).alias("max_deviation"))
    )
