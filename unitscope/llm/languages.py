"""Language identification by error-correcting output codes.

Every language has a codeword of bits. A bit's classifier weighs hashed byte n-grams by the logarithm of the ratio of their
frequencies in the languages whose bit is 1 and in those whose bit is 0; frequencies are means over all documents that may be
learned from, each counting alike. A second pass over the same documents finds where the weighted sums of both kinds lie (means, spread
and errors), which turns a sum into a logit and gives the bit a weight: its reliability. A text is decoded to the codeword of
the smallest weighted logistic loss. It is flagged as ambiguous where the second codeword is almost as near, or where more bits disagree
than the code can correct.

All passes run over whole texts; what reaches the driver is one row of sums for each language and bucket of n-grams. Sums are
whole numbers, so neither the order of rows nor that of tasks changes a model.

Defined results: a null text, and one without a letter, is ``und`` with score 0; so is every text where no document may be
learned from. One language alone is predicted with score 1. Rows are judged each for itself; a null id is never held out and
never learned from. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitscope.llm.common import append, byte_texts, table
from unitscope.llm.registry import query

#: Buckets of n-grams, their lengths in bytes, and bytes looked at in one go.
BUCKETS, LENGTHS, SEGMENT = 1 << 15, (1, 2, 3, 4), 1 << 20
#: Whole-number scale of frequencies and sums.
UNIT = 1 << 24
#: Weight of the even distribution in a language's frequencies.
SMOOTH = 0.02
#: Languages with which all dichotomies are bits; beyond it, bits of the code and codes tried.
EXHAUSTIVE, LEAST_BITS, TRIED = 5, 15, 64
#: A decoding is ambiguous if the second codeword's share of the two is at least this.
CLOSE = 0.2
#: Largest logit of a mean text of either kind.
STEEP = 6.0
#: Languages counted in a task before their counts are sent on.
HELD = 32


def _letters() -> np.ndarray:
    """A-Z lower-cased, a blank for any other ASCII sign."""
    out = np.full(256, 32, dtype=np.uint64)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x61:0x7B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


_LETTERS = _letters()


def gram_counts(text: bytes) -> np.ndarray:
    """How often each bucket occurs among the n-grams of a whole text; those of blanks only do not count."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    longest = max(LENGTHS)
    for at in range(0, len(text), SEGMENT):
        x = _LETTERS[np.frombuffer(text, dtype=np.uint8)[at : at + SEGMENT + longest - 1]]
        for n in LENGTHS:
            count = min(len(x) - n + 1, SEGMENT)
            if count <= 0:
                continue
            codes = np.zeros(count, dtype=np.uint64)
            blank = np.uint64(0)
            for k in range(n):
                codes = codes << np.uint64(8) | x[k : k + count]
                blank = blank << np.uint64(8) | np.uint64(32)
            codes = codes[codes != blank]
            with np.errstate(over="ignore"):
                mixed = (codes + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return out


def code_words(languages: int, seed: int = 5) -> np.ndarray:
    """A code of 0 and 1 ``[language, bit]``; rows lie far apart and no column is constant."""
    if languages < 2:
        return np.zeros((languages, 0), dtype=np.int8)
    if languages <= EXHAUSTIVE:
        # one column for each way to part the languages in two
        return np.array([[m >> r & 1 for m in range(1, 1 << (languages - 1))] for r in range(languages)], dtype=np.int8)
    bits = max(LEAST_BITS, 5 * int(np.ceil(np.log2(languages))))
    best, far, rng = None, -1, np.random.default_rng(seed)
    for _ in range(TRIED):
        code = np.stack([rng.permutation(np.arange(languages) % 2) for _ in range(bits)], axis=1).astype(np.int8)
        least = distance(code)
        if least > far:
            best, far = code, least
    return best


def distance(code: np.ndarray) -> int:
    """The smallest number of bits in which two codewords differ."""
    signs = 2 * code.astype(np.int64) - 1
    differ = (code.shape[1] - signs @ signs.T) // 2
    return int(differ[~np.eye(len(code), dtype=bool)].min()) if len(code) > 1 else 0


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int8))
    weights: np.ndarray | None = None  # [bit, bucket]
    middle: np.ndarray | None = None
    slope: np.ndarray | None = None
    trust: np.ndarray | None = None

    def sums(self, text: bytes) -> np.ndarray:
        """The mean weight of a text's n-grams for each bit."""
        counts = gram_counts(text)
        used = np.flatnonzero(counts)
        return self.weights[:, used] @ counts[used] / max(int(counts.sum()), 1)

    def decode(self, sums: np.ndarray) -> tuple[int, int, float, bool]:
        """``(language, second, score, ambiguous)`` of the sums of one text."""
        logits = np.clip(self.slope * (sums - self.middle), -30, 30)
        signs = 2 * self.code.astype(np.float64) - 1
        loss = (self.trust * np.logaddexp(0, -signs * logits)).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        wrong = int(((logits > 0) != (self.code[order[0]] > 0)).sum())
        second = share[order[1]] / (1 + share[order[1]])
        return int(order[0]), int(order[1]), float(1 / share.sum()), bool(second >= CLOSE or wrong > (distance(self.code) - 1) // 2)


def learned_from() -> Column:
    """Documents whose text and language may be looked at."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


def frequencies(known: DataFrame) -> DataFrame:
    """``lang, bucket, amount``: sums over documents of the share of each bucket in units of ``UNIT``; bucket -1 counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told(lang: str) -> pa.RecordBatch:
            amounts = held.pop(lang)
            used = np.flatnonzero(amounts)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used - 1, pa.int32()), pa.array(amounts[used])], names=["lang", "bucket", "amount"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                counts = gram_counts(text)
                total = int(counts.sum())
                if not total:
                    continue
                if lang not in held and len(held) >= HELD:
                    yield told(next(iter(held)))
                own = held.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                own[0] += 1
                own[1:] += np.rint(counts * (UNIT / total)).astype(np.int64)
        for lang in list(held):
            yield told(lang)

    return known.select("lang", "text").mapInArrow(run, "lang string, bucket int, amount long").groupBy("lang", "bucket").agg(F.sum("amount").alias("amount"))


def spreads(known: DataFrame, model: Model) -> DataFrame:
    """``lang, bit, n, total, squares``: sums over documents of a bit's sums and their squares, in units of ``UNIT``."""
    shared, bits = known.sparkSession.sparkContext.broadcast(model), model.code.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                z = shared.value.sums(text)
                row = own.setdefault(lang, np.zeros((3, bits), dtype=np.int64))
                row += np.rint(np.stack([np.ones(bits), z * UNIT, z * z * UNIT])).astype(np.int64)
        if own:
            flat = np.concatenate(list(own.values()), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k in own for _ in range(bits)], pa.string()), pa.array(list(range(bits)) * len(own), pa.int32()), *map(pa.array, flat)],
                names=["lang", "bit", "n", "total", "squares"],
            )

    made = known.select("lang", "text").mapInArrow(run, "lang string, bit int, n long, total long, squares long")
    return made.groupBy("lang", "bit").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def fit(docs: DataFrame) -> Model:
    """A model of all documents with a text and a language that may be learned from."""
    known = docs.where(learned_from() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    told = frequencies(known).toArrow()
    languages = sorted(set(told["lang"].to_pylist()))
    model = Model(languages, code_words(len(languages)))
    if len(languages) < 2:
        return model
    place = {lang: i for i, lang in enumerate(languages)}
    amounts = np.zeros((len(languages), BUCKETS + 1))
    amounts[[place[x] for x in told["lang"].to_pylist()], told["bucket"].to_numpy() + 1] = told["amount"].to_numpy()
    share = amounts[:, 1:] / amounts[:, 1:].sum(axis=1, keepdims=True)
    share = (1 - SMOOTH) * share + SMOOTH / BUCKETS
    one = model.code.astype(np.float64)
    model.weights = np.stack([np.log(share[one[:, b] == 1].mean(axis=0) / share[one[:, b] == 0].mean(axis=0)) for b in range(one.shape[1])])
    bits = one.shape[1]
    n, total, squares = np.zeros((3, len(languages), bits))
    for r in spreads(known, model).collect():  # a row for each language and bit
        at = place[r["lang"]], r["bit"]
        n[at], total[at], squares[at] = r["n"], r["total"] / UNIT, r["squares"] / UNIT
    mean = total / n
    spread = np.maximum(squares / n - mean**2, 1e-9)
    high = np.array([mean[one[:, b] == 1, b].mean() for b in range(bits)])
    low = np.array([mean[one[:, b] == 0, b].mean() for b in range(bits)])
    within = spread.mean(axis=0)
    # the logit of two bells of that spread, but no steeper than STEEP at the means: a text of two languages lies between them
    width = np.maximum(high - low, 1e-9)
    model.middle, model.slope = (high + low) / 2, np.minimum(width / within, 2 * STEEP / width)
    apart = np.maximum(high - low, 1e-9) / np.sqrt(within)  # a bit's reliability: how many spreads lie between its kinds
    model.trust = apart / apart.mean()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``second`` and ``ambiguous``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        own = shared.value
        column = batch.column(batch.schema.get_field_index("text"))
        out = []
        for text, raw in zip(column.to_pylist(), byte_texts(column)):
            if not own.languages or text is None or not any(map(str.isalpha, text)):
                out.append(("und", 0.0, None, False))
            elif len(own.languages) == 1:
                out.append((own.languages[0], 1.0, None, False))
            else:
                best, second, score, unsure = own.decode(own.sums(raw))
                out.append((own.languages[best], score, own.languages[second], unsure))
        return dict(zip(("lang_pred", "score", "second", "ambiguous"), (list(c) for c in zip(*out))))

    return append(docs, make, "lang_pred string, score double, second string, ambiguous boolean")


@query("op13_language_id")
def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "second", "ambiguous")
