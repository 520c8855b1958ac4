"""What several operators share: row keys, words and shingles of whole batches, tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.session import checkpoint_dir, cut, release  # noqa: F401

#: Words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch handed to Python; texts can be long.
BATCH_ROWS = 250
_ODD = 0x9E3779B97F4A7C15
#: Bytes hashed together.
SEGMENT = 1 << 18
#: Rows of ids that may be broadcast (a few MB); beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with Arrow batches of a size that long texts allow."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_key(text: Column) -> Column:
    """Which of the rows with one id this is: a digest of its text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which is cheap to count, as a broadcast side if its size allows it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_LETTERS = np.random.default_rng(256).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            row = np.full(n, base, dtype=np.uint64)
            row[:1] = 1
            with np.errstate(over="ignore"):
                made.append(np.multiply.accumulate(row))
        if n > 4 * SEGMENT:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of the bytes ``x``."""
    power, back = powers(len(x))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[x] * power, dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every part one after another, and the number of each."""
    joined = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    out, where, at = [], [], 0
    while at < len(joined):
        to = min(at + SEGMENT, len(joined))
        while to < len(joined) and not _SPACE[joined[to - 1]]:  # a word is not cut
            more = np.flatnonzero(_SPACE[joined[to : to + SEGMENT]])
            to += int(more[0]) + 1 if len(more) else min(SEGMENT, len(joined) - to)
        x = joined[at:to]
        edge = np.diff(np.concatenate([[True], _SPACE[x], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out.append(span_hashes(x, starts, ends))
        where.append(starts + at)
        at = to
    where_all = np.concatenate(where)
    borders = np.searchsorted(where_all, np.cumsum(sizes))
    return np.concatenate(out), np.diff(borders, prepend=0).astype(np.int64)


def roll(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive words."""
    rolled = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if len(rolled) else 0):
            rolled = mix(rolled * np.uint64(_ODD) + hashes[k : len(hashes) - width + 1 + k])
    return rolled


#: Parts sorted together, and the bits that leaves for the hash of a shingle.
PARTS, HASH_BITS = 1 << 10, 54


def shingle_sets(
    hashes: np.ndarray, counts: np.ndarray, width: int, level: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every part: ``(shingles, sizes)``, ascending inside a part.

    Shingles are ``HASH_BITS`` bits of a hash. A part with fewer words than ``width`` has one shingle, its
    whole sequence of words; without words it has none. With ``level`` (a power of two of 6-bit
    numbers) a shingle is the low ``HASH_BITS - 6`` bits of its hash; the level that the highest of these
    pick becomes its top 6 bits, so that shingles of a low level come first.
    """
    if len(counts) > PARTS:
        made, at = [], 0
        for lo in range(0, len(counts), PARTS):
            part = counts[lo : lo + PARTS]
            n = int(part.sum())
            made.append(shingle_sets(hashes[at : at + n], part, width, level))
            at += n
        return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    starts = np.cumsum(counts) - counts
    rolled = roll(hashes, width)
    full = counts >= width
    per_part = np.where(full, counts - width + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), per_part)
    if full.all():
        # the windows that lie inside one part
        values = rolled[np.arange(len(owner)) + (width - 1) * owner.astype(np.int64)]
    else:
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(per_part) - per_part, per_part)
        values = np.zeros(len(owner), dtype=np.uint64)
        whole = np.repeat(full, per_part)
        values[whole] = rolled[(np.repeat(starts, per_part) + inside)[whole]]
        short = np.flatnonzero((counts > 0) & ~full)
        with np.errstate(over="ignore"):
            for i, at in zip(short, (np.cumsum(per_part) - per_part)[short]):
                value = np.full(1, counts[i], dtype=np.uint64)
                for h in hashes[starts[i] : starts[i] + counts[i]]:
                    value = mix(value * np.uint64(_ODD) + h)
                values[at] = value[0]
    if level is None:
        values >>= np.uint64(64 - HASH_BITS)
    else:
        values &= np.uint64((1 << (HASH_BITS - 6)) - 1)
        top = level[(values >> np.uint64(HASH_BITS - 5 - len(level).bit_length())).astype(np.int64)]
        values = top << np.uint64(HASH_BITS - 6) | values
    keys = np.sort(owner << np.uint64(HASH_BITS) | values)
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    sizes = np.bincount((keys >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(counts))
    return keys & np.uint64((1 << HASH_BITS) - 1), sizes.astype(np.int64)


def set_digests(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set (0, 0 for an empty one)."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        out = []
        for salt in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
            out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def arrow(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, Any] | None], schema: str) -> DataFrame:
    """``mapInArrow`` where ``make`` turns a batch into named columns (None: no rows)."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch) if batch.num_rows else None
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(kind, (made[f.name] for f in kind))],
                    schema=kind,
                )

    return df.mapInArrow(run, schema)


def append(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, Any]], added: str) -> DataFrame:
    """All columns of ``df`` and those that ``make`` computes from a batch.

    A computed name takes the place of a column of that name in ``df``.
    """
    from pyspark.sql.types import StructField, StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    extra = StructType.fromDDL(added)
    taken = {f.name.lower() for f in extra}
    kept = df.select([quoted(c) for c in df.columns if c.lower() not in taken])
    schema = StructType(list(kept.schema.fields) + list(extra.fields))
    kind = to_arrow_schema(extra)
    names = kept.columns
    plain = [f"_c{i}" for i in range(len(names))]  # dots in names are no matter inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = make(batch.rename_columns(names))
            new = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(kind, (made[f.name] for f in kind))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + new, names=plain + [f.name for f in kind])

    inner = StructType([StructField(p, f.dataType) for p, f in zip(plain, kept.schema)] + list(extra.fields))
    return kept.toDF(*plain).mapInArrow(run, inner).toDF(*schema.names)


def quoted(name: str) -> Column:
    """A column by its literal name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def aside(df: DataFrame, used: set[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with every column but the ``used`` ones under a name that means nothing, and the
    columns that give back the names and the order of ``df``."""
    names = [c.lower() if c.lower() in used else f"_u{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, df.columns)]
