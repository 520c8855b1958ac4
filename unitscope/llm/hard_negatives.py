"""Hard-negative mining with Four-Russians scoring.

Components are integers. A candidate is stored as bit planes: for every plane of its two's complement and every group of
eight dimensions one byte. For an anchor, all 256 subset sums of its eight components of a group are tabulated once;
the byte of a candidate is then the place of that group's part of the inner product. The parts of a plane are added,
the planes shifted and added (the sign plane is taken away), which gives the whole score exactly. Tables
of ``LANES`` anchors lie side by side, so that one look-up serves them all.

Anchors and candidates meet in tiles of stated size that Spark shuffles: each anchor tile with each candidate tile. A first
pass finds the best rows of an anchor's own label; a second one scores the rows of other labels against the windows which those set.
A tile sends on only the few rows that can still be among the first ones of an anchor.

Defined results: rows with a null label or vector, a null or non-finite component, or a component so large that scores leave
64 bits (``floor(sqrt(2**56 / dimensions))`` after scaling) take no part. Vectors of unequal length are compared
as if zeros followed the shorter one; an empty vector scores 0. Rows without an id are candidates after all others
of their score, never anchors. Repeated rows are rows of their own; "other" rows have another id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitscope.llm.common import arrow, cut, table
from unitscope.llm.registry import query

#: Rows of a tile; a task holds one tile of each kind at a time.
CANDIDATES, ANCHORS = 4_096, 8_192
#: Anchors whose tables lie side by side.
LANES = 64
#: Components become floor(SCALE * x).
SCALE = 256
#: Other rows of an anchor's label, and negatives of each.
POSITIVES, NEGATIVES = 5, 3
#: Tasks of a pass at most.
MOST_TASKS = 4_096
_LAST = np.iinfo(np.int64).max


def planes_of(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Bit planes of integer vectors, the sign plane first: ``(planes, bytes[row, plane, group])``."""
    least, most = (int(values.min()), int(values.max())) if values.size else (0, 0)
    n = max(most.bit_length(), (-least - 1).bit_length() if least < 0 else 0) + 1
    bits = (values[:, None, :] >> np.arange(n - 1, -1, -1)[None, :, None]) & 1
    return n, np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def values_of(packed: np.ndarray) -> np.ndarray:
    """The vectors of ``bytes[row, plane, group]``, with zeros up to a whole group."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weight = 1 << np.arange(packed.shape[1] - 1, -1, -1, dtype=np.int64)
    weight[0] = -weight[0]
    return np.tensordot(weight, bits, axes=(0, 1))


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """``table[group, byte, anchor]``: the sum of the components whose bits the byte has."""
    n, dims = anchors.shape
    parts = anchors.T.reshape(dims // 8, 8, n).astype(kind)
    out = np.zeros((dims // 8, 256, n), dtype=kind)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + parts[:, bit, None]
    return out


def scores(tables: np.ndarray, packed: np.ndarray, kind: type) -> np.ndarray:
    """Exact inner products ``[candidate, anchor]`` from look-ups, shifts and additions."""
    n, planes, groups = packed.shape
    total = np.zeros((n, tables.shape[2]), dtype=kind)
    part = np.empty((n, tables.shape[2]), dtype=tables.dtype)
    found = np.empty_like(part)
    for plane in range(planes):
        part[:] = 0
        for g in range(min(groups, len(tables))):  # beyond either's groups there are only zeros
            np.take(tables[g], packed[:, plane, g], axis=0, out=found, mode="clip")
            part += found
        if plane == 0:
            total -= part
        else:
            total <<= 1
            total += part
    return total


def integer_vectors(df: DataFrame, id_col: str, vector: str, label: Column, anchors: Column, scale: int = SCALE) -> DataFrame:
    """Rows that take part: ``id, label, anchor, n, planes, packed``, their vectors as bit planes."""
    kept = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("v"))

    def make(batch: pa.RecordBatch) -> dict:
        columns = batch.to_pydict()
        at, planes, packed, dims = [], [], [], []
        for i, v in enumerate(columns["v"]):
            if columns["label"][i] is None or v is None or any(x is None for x in v):
                continue
            scaled = np.floor(scale * np.array(v, dtype=np.float64))
            most = math.isqrt((1 << 56) // max(len(v), 1))
            if not np.isfinite(scaled).all() or (np.abs(scaled) > most).any():
                continue
            n, made = planes_of(scaled.astype(np.int64)[None])
            at.append(i)
            dims.append(len(v))
            planes.append(n)
            packed.append(made.tobytes())
        return {k: pa.array([columns[k][i] for i in at], t) for k, t in (("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()))} | {"n": pa.array(dims, pa.int32()), "planes": pa.array(planes, pa.int32()), "packed": pa.array(packed, pa.binary())}

    return arrow(kept, make, "id long, label long, anchor boolean, n int, planes int, packed binary")


class Tile:
    """Rows of one side in memory; vectors of like shape lie together."""

    def __init__(self, rows: pa.Table):
        self.label = rows["label"].to_numpy().astype(np.int64)
        self.id = np.array([_LAST if i is None else i for i in rows["id"].to_pylist()], dtype=np.int64)
        self.known = np.array([i is not None for i in rows["id"].to_pylist()], dtype=bool)
        planes, packed = rows["planes"].to_numpy(), rows["packed"].to_pylist()
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, (p, b) in enumerate(zip(planes.tolist(), packed)):
            shapes.setdefault((p, len(b) // p), []).append(i)
        self.parts = [(np.array(at), np.frombuffer(b"".join(packed[i] for i in at), dtype=np.uint8).reshape(len(at), *shape)) for shape, at in shapes.items()]

    def vectors(self) -> np.ndarray:
        out = np.zeros((len(self.id), 8 * max((p.shape[2] for _, p in self.parts), default=0)), dtype=np.int64)
        for at, packed in self.parts:
            out[at, : 8 * packed.shape[2]] = values_of(packed)
        return out


def blocks(anchors: Tile, candidates: Tile, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(anchors, candidates, scores)`` of up to LANES anchors and all candidates that share a label with one of
    them (or, without ``same``, differ from one), by position; a pair of the wrong kind may be among them."""
    vectors = anchors.vectors()
    order = np.argsort(anchors.label, kind="stable")
    top = np.abs(vectors).max(axis=0, initial=0)
    for lo in range(0, len(order), LANES):
        own = order[lo : lo + LANES]
        labels = np.unique(anchors.label[own])
        bound = int(top.max(initial=0)) * max(len(top), 1)
        kind = np.int16 if bound < 1 << 15 else np.int32 if bound < 1 << 31 else np.int64
        tables = subset_sums(vectors[own], kind)
        for at, packed in candidates.parts:
            if same:
                keep = np.isin(candidates.label[at], labels)
            else:
                keep = candidates.label[at] != labels[0] if len(labels) == 1 else np.ones(len(at), bool)
            if keep.any():
                wide = np.int64 if bound << packed.shape[1] >= 1 << 31 else np.int32
                yield own, at[keep], scores(tables, packed[keep], wide)


def _columns(kind: pa.Schema, rows: list[tuple]) -> pa.Table:
    """Arrow columns from pieces of numpy columns; an id of _LAST is null."""
    if not rows:
        return kind.empty_table()
    whole = [np.concatenate(c) for c in zip(*rows)]
    return pa.table([pa.array(c, mask=c == _LAST) if f.name.endswith("_id") else pa.array(c) for f, c in zip(kind, whole)], schema=kind)


def _first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` rows of each group by descending score, then id."""
    order = np.lexsort((ids, -score, group))
    starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < n]


_NEAR = pa.schema([("row", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])
_FOUND = pa.schema([("row", pa.int64()), ("positive", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def near_rows(anchors: pa.Table, candidates: pa.Table, count: int) -> pa.Table:
    """The best ``count`` rows of the anchor's label in a tile."""
    a, c, rows = Tile(anchors), Tile(candidates), anchors["row"].to_numpy()
    out = []
    for own, at, s in blocks(a, c, same=True):
        ok = c.label[at][:, None] == a.label[own][None]
        ok &= (c.id[at][:, None] != a.id[own][None]) | ~c.known[at][:, None]
        if len(at) > count:  # all that reach the count-th best score, ties included
            shown = np.where(ok, s, np.iinfo(s.dtype).min)
            ok &= s >= np.partition(shown, len(at) - count, axis=0)[len(at) - count][None]
        i, j = np.nonzero(ok)
        score = s[i, j].astype(np.int64)
        keep = _first_of(j, score, c.id[at[i]], count)
        out.append((rows[own[j[keep]]], c.id[at[i[keep]]], score[keep]))
    return _columns(_NEAR, out)


def window_rows(anchors: pa.Table, candidates: pa.Table, count: int) -> pa.Table:
    """The best ``count`` rows of other labels in a tile, for each window of each anchor."""
    a, c, rows = Tile(anchors), Tile(candidates), anchors["row"].to_numpy()
    windows = [[(w["low"], w["high"]) for w in ws] for ws in anchors["windows"].to_pylist()]
    least = np.array([min(w[0] for w in ws) for ws in windows], dtype=np.int64)
    most = np.array([max(w[1] for w in ws) for ws in windows], dtype=np.int64)
    out = []
    for own, at, s in blocks(a, c, same=False):
        ok = (s >= least[own][None]) & (s <= most[own][None])
        j, i = np.nonzero(ok.T)
        if not len(j):
            continue
        differ = c.label[at[i]] != a.label[own[j]]
        i, j = i[differ], j[differ]
        score, ids = s[i, j].astype(np.int64), c.id[at[i]]
        order = np.lexsort((ids, -score, j))
        j, score, ids = j[order], score[order], ids[order]
        edges = np.searchsorted(j, np.arange(len(own) + 1))
        for k, anchor in enumerate(own):
            lo, hi = edges[k], edges[k + 1]
            falling = -score[lo:hi]
            for number, (low, high) in enumerate(windows[anchor]):
                start = int(np.searchsorted(falling, -high))
                stop = min(int(np.searchsorted(falling, -low, side="right")), start + count)
                if start < stop:
                    n = stop - start
                    out.append((np.full(n, rows[anchor]), np.full(n, number, np.int32), ids[lo + start : lo + stop], score[lo + start : lo + stop]))
    return _columns(_FOUND, out)


def _tiles(anchors: DataFrame, candidates: DataFrame, work, kind: pa.Schema, schema: str, n_anchors: int, n_rows: int) -> DataFrame:
    """``work`` on every anchor tile with every candidate tile. Tiles are even: rows are dealt by number, not by id."""
    across, down = max(1, -(-n_rows // CANDIDATES)), max(1, -(-n_anchors // ANCHORS))
    tasks = min(across * down, MOST_TASKS)
    deal = F.xxhash64("row")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))

    left = anchors.withColumn("down", F.pmod(deal, F.lit(down))).withColumn("across", every(across))
    right = candidates.withColumn("across", F.pmod(deal, F.lit(across))).withColumn("down", every(down))

    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        return work(a, c) if a.num_rows and c.num_rows else kind.empty_table()

    # the number of partitions is stated: these rows are few bytes and much work
    pair = [side.repartition(tasks, "down", "across").groupBy("down", "across") for side in (left, right)]
    return pair[0].cogroup(pair[1]).applyInArrow(run, schema)


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20)) -> DataFrame:
    """Hard negatives of every anchor and positive of ``integer_vectors``.

    ``low`` and ``high`` are the fractions of the positive's score between which a negative scores.
    """
    rows = cut(vectors.withColumn("row", F.monotonically_increasing_id()))
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    anchors = rows.where("anchor")
    near = _tiles(anchors, rows, lambda a, c: near_rows(a, c, positives), _NEAR, "row long, other_id long, score long", n_anchors, n_rows)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    # window bounds: ceil and floor of fractions, in whole numbers
    low_score = -F.expr(f"(-score * {low[0]} - pmod(-score * {low[0]}, {low[1]})) div {low[1]}")
    high_score = F.expr(f"(score * {high[0]} - pmod(score * {high[0]}, {high[1]})) div {high[1]}")
    chosen = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "other_id", "score", low_score.alias("low"), high_score.alias("high")))).alias("windows"))
    asked = cut(anchors.join(chosen, "row"))
    found = _tiles(asked, rows, lambda a, c: window_rows(a, c, negatives), _FOUND, "row long, positive int, negative_id long, negative_score long", n_anchors, n_rows)
    order = Window.partitionBy("row", "positive").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    window = F.col("windows")[F.col("positive")]
    return found.join(asked.select("row", F.col("id").alias("anchor_id"), "windows"), "row").select(
        "anchor_id", window["other_id"].alias("positive_id"), "rank", "negative_id", window["score"].alias("positive_score"), "negative_score"
    )


SQL = """
WITH raw AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cell AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM raw
), score AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM cell a JOIN cell b ON a.d = b.d WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM score WHERE anchor_label = other_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN score s ON s.anchor_id = p.anchor_id AND s.anchor_label <> s.other_label
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark, sf_dir):
    given = table(spark, sf_dir, "embeddings")
    moved = (F.col("label").cast("long") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label").cast("long"))
    return mine(integer_vectors(given, "vec_id", "embedding", label, F.col("vec_id") % 50 == 0))
