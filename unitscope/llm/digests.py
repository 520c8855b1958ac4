"""Document fingerprints from statistically improbable byte windows.

Every window of ``WINDOW`` bytes has an entropy, in ``LEVELS`` steps. A count of the levels of all
windows of the corpus ranks them: the fewer windows a level has, the rarer it is;
windows of next to no information never count as rare. In each run of ``RUN`` windows the rarest (the first of equals)
gets a point, and windows with ``POINTS`` points are features; where a text has none, all with a point are. Features go, in text order, into
a chain of Bloom filters of 2,048 bits and at most ``FILL`` features, five bits each. Two chains
are alike as far as the bits of their filters overlap beyond chance: the mean, over the
filters of the shorter chain, of the best overlap with a filter of the other.

Defined results: a null or empty text has an empty fingerprint, which is like another empty one (1)
and unlike the rest (0). A text shorter than a window is one feature; with fewer windows than a run, the run is
all of them. Documents are in descending order of their ids, null ids last, equal ids by a digest of the text. An
only document is its own next. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitscope.llm.common import arrow, byte_texts, span_hashes, table, text_key
from unitscope.llm.registry import query

WINDOW, RUN, POINTS = 64, 64, 16
LEVELS = 1000
#: Levels below this one are runs of few letters, tables of digits and the like.
PLAIN = 100
BITS, FILL, HASHES = 2048, 160, 5
#: Bytes looked at together.
CHUNK = 1 << 20
#: Ranges of ids, at most; a range is sorted on disk and read as a stream, so it may be large.
MOST_PARTS = 4096

_F = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * 65536).astype(np.int64)


def levels(x: np.ndarray) -> np.ndarray:
    """The entropy level of every window of the bytes ``x``, exact in integers."""
    n = len(x)
    before, after = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for k in range(1, WINDOW):
        same = x[k:] == x[:-k]
        before[k:] += same
        after[:-k] += same
    first = _F[np.bincount(x[:WINDOW], minlength=256)].sum()
    gone, come = after[: n - WINDOW].astype(np.int64) + 1, before[WINDOW:].astype(np.int64)
    steps = _F[gone - 1] - _F[gone] + _F[come + 1] - _F[come]
    total = np.concatenate([[first], first + np.cumsum(steps)])
    full = int(_F[WINDOW])
    return (LEVELS * (full - total) // full).astype(np.int64)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``CHUNK`` bytes together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of every text start in the joined bytes, and how many there are."""
    return np.cumsum(sizes) - sizes, np.maximum(sizes - WINDOW + 1, 0)


def level_counts(texts: list[bytes]) -> np.ndarray:
    counts = np.zeros(LEVELS + 1, dtype=np.int64)
    for lo, hi in chunks(texts):
        x = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
        if len(x) < WINDOW:
            continue
        starts, number = _windows(np.array([len(t) for t in texts[lo:hi]]))
        inside = np.zeros(len(x) + 1, dtype=np.int32)
        np.add.at(inside, starts, number > 0)
        np.add.at(inside, starts + number, -(number > 0).astype(np.int32))
        counts += np.bincount(levels(x)[np.cumsum(inside)[: len(x) - WINDOW + 1] > 0], minlength=LEVELS + 1)
    return counts


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of every level, rarest first; plain levels come after all others."""
    rank = np.empty(LEVELS + 1, dtype=np.int64)
    rank[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    rank[:PLAIN] += LEVELS + 1
    return rank


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the selected windows of every text, in text order, each once."""
    out: list[np.ndarray] = []
    none = np.zeros(0, dtype=np.uint64)
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        x = np.frombuffer(b"".join(part), dtype=np.uint8)
        starts, number = _windows(np.array([len(t) for t in part]))
        chosen, hashes = none.astype(np.int64), none
        if len(x) >= WINDOW:
            m = len(x) - WINDOW + 1
            key = rank[levels(x)] << 32 | np.arange(m)
            points = np.zeros(m, dtype=np.int64)
            if m >= RUN:
                least = key
                for step in (1, 2, 4, 8, 16, 32):
                    least = np.minimum(least[:-step], least[step:])
                runs = np.maximum(number - RUN + 1, 0)
                at = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
                points += np.bincount(least[at] & 0xFFFFFFFF, minlength=m)
            for i in np.flatnonzero((number > 0) & (number < RUN)):
                points[int(key[starts[i] : starts[i] + number[i]].min()) & 0xFFFFFFFF] = POINTS
            chosen = np.flatnonzero(points >= POINTS)
            bare = (number > 0) & (np.searchsorted(chosen, starts) == np.searchsorted(chosen, starts + number))
            for i in np.flatnonzero(bare):
                own = points[starts[i] : starts[i] + number[i]]
                own[own > 0] = POINTS
            if bare.any():
                chosen = np.flatnonzero(points >= POINTS)
            hashes = span_hashes(x, chosen, chosen + WINDOW)
        ends = np.searchsorted(chosen, starts + number)
        begins = np.searchsorted(chosen, starts)
        for i, t in enumerate(part):
            if number[i]:
                own = hashes[begins[i] : ends[i]]
                _, once = np.unique(own, return_index=True)
                out.append(own[np.sort(once)] if len(once) < len(own) else own)
            elif t:
                out.append(np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little")], dtype=np.uint64))
            else:
                out.append(none)
    return out


def chain(hashes: np.ndarray) -> np.ndarray:
    """The filters of a text as rows of bytes."""
    n = -(-len(hashes) // FILL)
    bits = np.zeros((n, BITS), dtype=bool)
    row = np.arange(len(hashes)) // FILL
    for k in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap of two chains, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    of_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for one in a:
        mine = int(np.bitwise_count(one).sum(dtype=np.int64))
        both = np.bitwise_count(b & one).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(of_b, mine), of_b * mine / BITS
        total += float(np.max(np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), both >= most)))
    return min(max(total / len(a), 0.0), 1.0)


def written(filters: np.ndarray) -> str:
    return ":".join(row.tobytes().hex() for row in filters)


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy levels over all windows of all texts."""

    def make(batch: pa.RecordBatch) -> dict:
        counts = level_counts(byte_texts(batch.column(0)))
        some = np.flatnonzero(counts)
        return {"level": pa.array(some), "n": pa.array(counts[some])}

    rows = arrow(docs.select("text"), make, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS + 1, dtype=np.int64)
    for r in rows:  # LEVELS rows at most
        counts[r["level"]] = r["n"]
    return ranks(counts)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text, part, last)`` so that each row's next one, by descending id, follows it
    in its part; the row after a part's end is there once more as its ``last`` one."""
    spark = docs.sparkSession
    # descending ids: ~id ascends
    order = F.coalesce(F.expr("~cast(doc_id as long)"), F.lit(2**63 - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_o", order).withColumn("_k", text_key(F.col("text")))
    parts = min(4 * max(1, docs.rdd.getNumPartitions()), MOST_PARTS)
    bounds = rows.agg(F.percentile_approx("_o", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts)).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    rows = rows.withColumn("part", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), lambda b: b <= F.col("_o"))))
    firsts = sorted(rows.groupBy("part").agg(F.min(F.struct("_o", "_k")).alias("f")).collect(), key=lambda r: r["part"])  # a row for each part
    if not firsts:
        return rows.select("doc_id", "text", "part", F.lit(False).alias("last"))
    after = [(r["f"]["_o"], r["f"]["_k"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    after = F.broadcast(spark.createDataFrame(after, "_fo long, _fk long, _before int"))
    extra = rows.join(after, (F.col("_o") == F.col("_fo")) & (F.col("_k") == F.col("_fk")), "left")
    copies = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("last")), F.struct(F.col("_before").alias("part"), F.lit(True).alias("last")))
    copies = F.when(F.col("_before").isNull(), F.slice(copies, 1, 1)).otherwise(copies)
    laid = extra.withColumn("_c", F.explode(copies)).select("doc_id", "text", "_o", "_k", "_c.part", "_c.last")
    return laid.repartition(max(1, parts // 4), "part").sortWithinPartitions("part", "last", "_o", "_k").select("doc_id", "text", "part", "last")


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs))
    names = [p.split()[0] for p in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        held: tuple | None = None  # id, text, part and chain of the row before
        for batch in batches:
            ids, texts, parts, last = (c.to_pylist() for c in batch.columns)
            chains = [chain(f) for f in features([t.encode() for t in texts], rank)]
            rows = []
            for i in range(len(ids)):
                if held is not None and held[2] == parts[i]:
                    rows.append((held, (ids[i], texts[i], parts[i], chains[i])))
                held = None if last[i] else (ids[i], texts[i], parts[i], chains[i])
            changed = [edited(a[1], b[1]).encode() for a, b in rows]
            own = [chain(f) for f in features(changed, rank)]
            made = [
                (a[0], len(a[1]), hashlib.sha256(t).hexdigest(), written(a[3]), written(e), likeness(a[3], e), likeness(a[3], b[3]))
                for (a, b), t, e in zip(rows, changed, own)
            ]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    return with_next(docs).mapInArrow(run, SCHEMA)


@query("op6_fingerprints")
def op6_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
