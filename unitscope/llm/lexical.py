"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of like size. For each document, every term that occurs at least once, twice,
3, 4, 6, 8, 12, … times (``LEVELS``) is posted with that level to a Bloom filter of some bits; a block stores them by bit: one bitmap of
its documents for each bit position. The bitmap of a query term at a level is the conjunction of its bits' bitmaps; it can only
overestimate, so the next level less one bounds the term's occurrences. Bitmaps weighted by the terms' weights are summed
for each item and level, and the sums, times what a level adds in a document of that length, are an upper bound of its score.

A search counts the documents of each of its terms, then scores the documents with the highest bounds exactly, takes the k-th best score of an item as its threshold, and then
scores all documents whose bound reaches it: whatever is left out is proven not to be among the first k. Nothing is approximate.

Defined results: null texts have no terms and are in no result, nor are items without one. Items are looked at by id, and rows of
equal id are items of their own with the same id (ranked each for itself). Repeated documents are documents of their own and take
ranks of their own; a null ``doc_id`` comes after all others of its score. Empty tables give no rows. Items are taken in groups of
``ITEM_BYTES`` of text, which a task can hold; a longer text is a group of its own.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitscope.llm.common import HASH_BITS, PARTS, arrow, byte_texts, cut, mix, table, text_key, word_hashes
from unitscope.llm.registry import query
from unitscope.session import scratch

TOP = 10
#: Bits for each posted pair of term and level, and bit positions of each.
BITS, PROBES = 12, 4
#: Occurrences from which on a term is posted at a level.
LEVELS = [1, 2, 3] + [k << s for s in range(1, 40) for k in (2, 3)]
#: Bytes of a block's bitmaps, documents of a block, and documents gathered before blocks are made.
BLOCK_BYTES, BLOCK_DOCS, GATHERED = 1 << 18, 1024, 1 << 20
#: Bytes of item texts looked for at once.
ITEM_BYTES = 4 << 20
#: Numbers in the ids and items of candidates that may be broadcast (4 MB).
BROADCAST_NUMBERS = 500_000
#: Numbers in a matrix of weights of items by terms.
WEIGHTS = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _letters() -> np.ndarray:
    """What each byte becomes: A-Z lower-cased, separators a blank."""
    out = np.full(256, 32, dtype=np.uint8)
    for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[lo : hi + 1] = np.arange(lo, hi + 1)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


LETTERS = _letters()
_TABLE = LETTERS.tobytes()


def plain(text: bytes) -> bytes:
    """A text with A-Z lower-cased and a blank for whatever separates terms."""
    return text.translate(_TABLE)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, in order: runs of ASCII letters, digits and all beyond ASCII."""
    return plain(text).split()


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms one after another, and the number of each text; ``HASH_BITS`` are used."""
    hashes, counts = word_hashes([plain(t) for t in texts])
    return hashes & np.uint64((1 << HASH_BITS) - 1), counts


def posted(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """What each text posts: a hash for each of its terms and each level that it reaches."""
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = np.sort(owner << np.uint64(HASH_BITS) | hashes)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(starts, len(keys)))
    own, text = keys[starts] & np.uint64((1 << HASH_BITS) - 1), (keys[starts] >> np.uint64(HASH_BITS)).astype(np.int64)
    made, whose = [], []
    for level, least in enumerate(LEVELS):
        reach = times >= least
        own, text, times = own[reach], text[reach], times[reach]
        if not len(own):
            break
        made.append(at_level(own, level))
        whose.append(text)
    if not made:
        return [np.zeros(0, np.uint64)] * len(counts)
    order = np.argsort(np.concatenate(whose), kind="stable")
    sizes = np.bincount(np.concatenate(whose), minlength=len(counts))
    return np.split(np.concatenate(made)[order], np.cumsum(sizes)[:-1])


def at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes + np.uint64((level * _ODD + 1) & (2**64 - 1)))


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions ``[key, probe]`` of posted hashes."""
    with np.errstate(over="ignore"):
        step = mix(keys ^ np.uint64(_ODD)) | np.uint64(1)
        return ((keys[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)[None]) % np.uint64(bits)).astype(np.int64)


def _block(docs: list[tuple]) -> dict:
    """The index row of some documents ``(doc_id, text key, n, keys)``."""
    bits = max(64, BITS * max(len(d[3]) for d in docs))
    marks = np.zeros(bits * len(docs), dtype=bool)
    for i, d in enumerate(docs):
        marks[positions(d[3], bits).ravel() * len(docs) + i] = True
    slices = np.packbits(marks.reshape(bits, len(docs)), axis=1, bitorder="little")
    return {"ids": [d[0] for d in docs], "keys": [d[1] for d in docs], "n": [d[2] for d in docs], "bits": bits, "slices": slices.tobytes()}


def _blocks(docs: list[tuple]) -> list[dict]:
    """Documents of like size together: in a block none posts less than a part of what the largest does."""
    docs.sort(key=lambda d: len(d[3]), reverse=True)
    out, at = [], 0
    while at < len(docs):
        most = len(docs[at][3])
        room = max(8, min(BLOCK_DOCS, 8 * BLOCK_BYTES // max(BITS * most, 64) // 8 * 8))
        to = at + 1
        while to < len(docs) and to - at < room and 4 * len(docs[to][3]) >= 3 * most:
            to += 1
        out.append(_block(docs[at:to]))
        at = to
    return out


_INDEX = "ids array<long>, keys array<long>, n array<long>, bits long, slices binary"


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of bit-sliced signatures of all documents with a term (``doc_id``, ``text``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(_INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, batch.num_rows, PARTS):
                hashes, counts = term_hashes(byte_texts(batch.column(2).slice(lo, PARTS)))
                for i, (n, made) in enumerate(zip(counts.tolist(), posted(hashes, counts)), lo):
                    if n:
                        held.append((ids[i], keys[i], n, made))
                        size += len(made)
            if size >= GATHERED:
                for row in _blocks(held):
                    yield pa.RecordBatch.from_pylist([row], schema=kind)
                held, size = [], 0
        for row in _blocks(held):
            yield pa.RecordBatch.from_pylist([row], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text").mapInArrow(run, _INDEX)


def frequencies(docs: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the wanted terms."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                counts.update(shared.value.intersection(terms(text)))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["term", "df"])

    told = docs.select("text").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in told.collect()}  # a row for each wanted term at most


class Index:
    """A written index: blocks, and the number of documents and terms."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        path = scratch(spark, "signatures")
        build_index(docs).write.parquet(path)
        self.blocks = spark.read.parquet(path)
        sums = self.blocks.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b))).first()
        self.documents, self.occurrences = sums[0] or 0, sums[1] or 0


class Items:
    """Items in a task: their terms, the weights, and the thresholds."""

    def __init__(self, texts: list[bytes]):
        self.own = [sorted(set(terms(t))) for t in texts]
        self.all = sorted(set().union(*self.own))
        number = {t: i for i, t in enumerate(self.all)}
        self.index = [np.array([number[t] for t in own], dtype=np.int64) for own in self.own]

    def weigh(self, df: dict[bytes, int], documents: int, occurrences: int) -> Items:
        self.documents, self.occurrences = documents, occurrences
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) if t in df else 0 for t in self.all], dtype=np.int64)
        hashes = term_hashes([b" ".join(self.all)])[0]
        self.keys = [at_level(hashes, level) for level in range(len(LEVELS))]
        self.groups = []
        lo = 0
        while lo < len(self.own):  # as many items as a small dense matrix of weights has room for
            hi, known = lo + 1, set(self.own[lo])
            while hi < len(self.own) and (hi + 1 - lo) * len(known | set(self.own[hi])) <= WEIGHTS:
                known.update(self.own[hi])
                hi += 1
            names = np.unique(np.concatenate(self.index[lo:hi]))
            names = names[self.weight[names] > 0]
            matrix = np.zeros((hi - lo, len(names)))
            for i in range(lo, hi):
                own = self.index[i][self.weight[self.index[i]] > 0]
                matrix[i - lo, np.searchsorted(names, own)] = self.weight[own]
            exact = matrix.sum(axis=1).max(initial=0) < 1 << 24
            self.groups.append((lo, hi, names, matrix.astype(np.float32 if exact else np.float64)))
            lo = hi
        return self

    def damping(self, n: np.ndarray | int) -> np.ndarray | int:
        """The ``m`` of documents of ``n`` terms."""
        return 10 + (90 * n * self.documents) // self.occurrences

    def bounds(self, bits: int, slices: bytes, n: np.ndarray) -> np.ndarray:
        """Upper bounds ``[item, document]`` of the scores in a block."""
        rows = np.frombuffer(slices, dtype=np.uint8).reshape(bits, -1)
        m, steps, before = self.damping(n), [], np.zeros(len(n), dtype=np.int64)
        for level, least in enumerate(LEVELS):
            most = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else np.iinfo(np.int32).max
            most = np.minimum(most, n)  # a term occurs no more often than the text has terms
            reached = np.maximum(before, 1_000_000_000 * most // (1000 * most + 8 * m))
            steps.append(reached - before)
            before = reached
        out = np.zeros((len(self.own), len(n)))
        for lo, hi, names, weights in self.groups:
            held = None
            for level, gain in enumerate(steps):
                at = positions(self.keys[level][names], bits)
                found = rows[at[:, 0]]
                for probe in range(1, PROBES):
                    found &= rows[at[:, probe]]
                if held is not None:
                    found &= held
                some = found.any(axis=1)
                if not some.any():
                    break
                names, weights, held = names[some], weights[:, some], found[some]
                seen = np.unpackbits(held, axis=1, count=len(n), bitorder="little")
                out[lo:hi] += (weights @ seen.astype(weights.dtype)).astype(np.float64) * gain
        return out * (1 + 1e-9) + 1  # more than rounding can take away

    def score(self, item: int, counts: Counter, m: int) -> int:
        """The exact score of a document."""
        total = 0
        for t, number in zip(self.own[item], self.index[item].tolist()):
            if tf := counts.get(t, 0):
                total += int(self.weight[number]) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        return total


def _highest(index: Index, items, k: int) -> DataFrame:
    """The documents with the ``k`` highest bounds of each item, in each task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL("item int, bound double, doc_id long, key long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        heaps: list[list] = [[] for _ in own.own]
        for batch in batches:
            for row in batch.to_pylist():
                bounds = own.bounds(row["bits"], row["slices"], np.array(row["n"], dtype=np.int64))
                take = min(k, bounds.shape[1])
                for i, at in enumerate(np.argpartition(-bounds, take - 1, axis=1)[:, :take].tolist()):
                    for j in at:
                        if bounds[i, j] > 1:
                            entry = (bounds[i, j], row["keys"][j], row["ids"][j])
                            (heapq.heappush if len(heaps[i]) < k else heapq.heappushpop)(heaps[i], _Entry(entry))
        flat = [(i, e.values[0], e.values[2], e.values[1]) for i, heap in enumerate(heaps) for e in heap]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat), kind)], schema=kind)

    return index.blocks.mapInArrow(run, "item int, bound double, doc_id long, key long")


class _Entry:
    """Compared by bound and key only; ids may be null."""

    __slots__ = ("values",)

    def __init__(self, values: tuple):
        self.values = values

    def __lt__(self, other: _Entry) -> bool:
        return self.values[:2] < other.values[:2]


def _possible(index: Index, items, least: np.ndarray) -> DataFrame:
    """All documents whose bound reaches the threshold of an item: ``doc_id, key, items``."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(least)

    def make(batch: pa.RecordBatch) -> dict:
        own, need = items.value, shared.value
        out: dict[str, list] = {"doc_id": [], "key": [], "items": []}
        for row in batch.to_pylist():
            ok = own.bounds(row["bits"], row["slices"], np.array(row["n"], dtype=np.int64)) >= need[:, None]
            for j in np.flatnonzero(ok.any(axis=0)).tolist():
                out["doc_id"].append(row["ids"][j])
                out["key"].append(row["keys"][j])
                out["items"].append(np.flatnonzero(ok[:, j]).tolist())
        return out

    return arrow(index.blocks, make, "doc_id long, key long, items array<int>")


def _scored(docs: DataFrame, pairs: DataFrame, items) -> DataFrame:
    """Exact scores of the documents and items named in ``doc_id, key, items``."""
    wanted = pairs.select(F.col("doc_id").alias("wanted_id"), F.col("key").alias("wanted_key"), "items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    size = pairs.agg(F.sum(F.size("items") + 4)).first()[0] or 0
    met = rows.join(F.broadcast(wanted) if size <= BROADCAST_NUMBERS else wanted, (F.col("key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("wanted_id")))

    def make(batch: pa.RecordBatch) -> dict:
        own = items.value
        out: dict[str, list] = {"doc_id": [], "item": [], "score": []}
        ids, wants = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, want, text in zip(ids, wants, byte_texts(batch.column(2))):
            found = terms(text)
            counts, m = Counter(found), own.damping(len(found))
            for i in want:
                if (s := own.score(i, counts, m)) > 0:
                    out["doc_id"].append(doc)
                    out["item"].append(i)
                    out["score"].append(s)
        return out

    return arrow(met.select("doc_id", "items", "text"), make, "doc_id long, item int, score long")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(index: Index, docs: DataFrame, rows: list, k: int) -> DataFrame:
    """The best documents of some items ``(item_id, text)``: ``item, rank, doc_id, score``."""
    spark = docs.sparkSession
    asked = Items([(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows])
    df = frequencies(docs, asked.all)
    items = spark.sparkContext.broadcast(asked.weigh(df, index.documents, max(index.occurrences, 1)))
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "key", "doc_id")
    first = _highest(index, items, k).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    first = cut(first.groupBy("doc_id", "key").agg(F.collect_set("item").alias("items")))
    known = _ranked(_scored(docs, first, items), k).groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    least = np.full(len(rows), 2.0)  # bounds carry 1 for rounding: above it something was found
    for r in known.where(F.col("n") == k).collect():  # one row an item
        least[r["item"]] = r["least"]
    pairs = cut(_possible(index, items, least).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("items")).alias("items")).withColumn("items", F.array_distinct("items")))
    return _ranked(_scored(docs, pairs, items), k)


def search(index: Index, docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item (``item_id``, ``text``)."""
    spark = docs.sparkSession
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // ITEM_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in range(groups):
        part = items.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group)) if groups > 1 else items
        rows = part.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").collect()
        if rows and index.documents:
            names = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long"))
            out = out.unionByName(_search(index, docs, rows, k).join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


SQL = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), held AS (SELECT doc_id, t, len(t) AS n FROM found WHERE len(t) > 0
), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS occurrences FROM held
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), posting AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM held) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, total GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // occurrences)))) AS BIGINT) AS score
  FROM wanted JOIN posting USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 10
"""


@query("op12_lexical_search", SQL)
def op12_lexical_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(Index(docs), docs, table(spark, sf_dir, "benchmark"))
