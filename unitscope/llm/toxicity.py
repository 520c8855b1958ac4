"""Toxicity by non-negative positive-unlabelled learning.

The classifier is a logistic model over hashed words, trained with numpy. Confirmed toxic rows
are the positives; a sample of all rows, whose labels are not looked at, is the unlabelled text. With the class prior
``p`` the risk of the negatives is the unlabelled risk less ``p`` times that of the positives taken as negatives; where a
batch's estimate is below 0, its gradient is reversed, so the model cannot win by overfitting
the positives. The prior is the share of toxic rows among the labelled ones that may be learned from.

A score is the logistic of the sum of the weights of the distinct words of the whole text, so
neither repeats nor plain words drown what tells.

Defined results: null and empty texts score the bias alone. Rows are scored each for itself. Ids
labelled twice take the larger label. Without a positive or an unlabelled row every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitscope.llm.common import append, arrow, byte_texts, cut, lists, table
from unitscope.llm.quality import sample_labels
from unitscope.llm.registry import query

BITS = 20
#: Rows learned from, at most, by the digest of the id.
MAX_POSITIVE, MAX_UNLABELLED = 5_000, 16_000
CUT = 0.3
#: Words remembered in a task before its cache starts anew.
CACHE_WORDS = 50_000
#: Step length and L1 penalty of the training.
RATE, SPARSE = 0.3, 1e-5
#: Standard deviations by which a feature must be more frequent in positives.
CLEAR = 4.0
#: Words that are not letters in front or behind are trimmed; A-Z is lower-cased.
#: Lengths, in code points, of the beginnings of words that are features of their own.
STARTS = (3, 4, 5, 6, 7)
TRIM = b".,;:!?\"'()[]{}<>*#$%&|-_"


def held_out() -> Column:
    """Rows never learned from; a null id is not among them (and is not learned from either)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Buckets(dict):
    """Hash buckets of a word: itself, its beginnings, and its inner pieces."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        mask = (1 << BITS) - 1
        bare = word.strip(TRIM) or word
        letters = bare.decode("utf-8", "replace")
        pieces = [bare] + [b"^" + letters[:n].encode("utf-8", "replace") for n in STARTS if len(letters) >= n]
        value = self[word] = [xxhash.xxh64_intdigest(p) & mask for p in pieces]
        return value


def buckets(text: bytes, cache: Buckets) -> np.ndarray:
    """Distinct buckets of the words of a text."""
    found: set[int] = set()
    for w in set(text.lower().split()):
        found.update(cache[w])
    return np.fromiter(found, dtype=np.int32, count=len(found))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def train(features: list[np.ndarray], positive: np.ndarray, prior: float, epochs: int = 60, seed: int = 7) -> Model:
    """Minimise the non-negative risk by mini-batches (logistic loss, AdaGrad steps)."""
    if not positive.any() or positive.all():
        return Model(np.zeros(1 << BITS), -np.inf)
    # only what positives have clearly more often than the unlabelled rows is looked at
    n_pos, n_rest = int(positive.sum()), int((~positive).sum())
    seen = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(f for f, p in zip(features, positive) if p == kind)]), minlength=1 << BITS) for kind in (True, False)]
    usual = (seen[0] + seen[1] + 1) / (n_pos + n_rest + 2)
    useful = (seen[0] - n_pos * usual) / np.sqrt(n_pos * usual * (1 - usual)) >= CLEAR
    useful &= seen[0] >= 3
    chosen_buckets = np.flatnonzero(useful)
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[chosen_buckets] = np.arange(len(chosen_buckets))
    features = [n[n >= 0] for n in (number[f] for f in features)]
    width = len(chosen_buckets)
    weights, bias, squares = np.zeros(width), 0.0, np.full(width + 1, 1e-8)
    rng = np.random.default_rng(seed)
    pos, rest = np.flatnonzero(positive), np.flatnonzero(~positive)
    share = 512
    for _ in range(epochs):
        order = rng.permutation(rest)
        for at in range(0, len(order), share):
            u = order[at : at + share]
            p = rng.choice(pos, min(len(pos), share // 2), replace=False)
            chosen = np.concatenate([p, u])
            index = np.concatenate([features[i] for i in chosen])
            rows = np.repeat(np.arange(len(chosen)), [len(features[i]) for i in chosen])
            z = bias + np.bincount(rows, weights=weights[index], minlength=len(chosen))
            # logistic losses of the rows as negatives, and the slopes of both kinds of loss
            as_negative = np.logaddexp(0, z)
            up = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            down = up - 1
            n_p, n_u = len(p), len(u)
            slope = np.zeros(len(chosen))
            if as_negative[n_p:].mean() - prior * as_negative[:n_p].mean() >= 0:
                slope[:n_p] = prior * (down[:n_p] - up[:n_p]) / n_p
                slope[n_p:] = up[n_p:] / n_u
            else:
                slope[:n_p] = prior * up[:n_p] / n_p
                slope[n_p:] = -up[n_p:] / n_u
            gradient = np.append(np.bincount(index, weights=slope[rows], minlength=width), slope.sum())
            squares += gradient**2
            step = RATE / np.sqrt(squares)
            moved = np.append(weights, bias) - step * gradient
            # the L1 part of the step
            weights = (np.sign(moved) * np.maximum(np.abs(moved) - step * SPARSE, 0))[:-1]
            bias = float(moved[-1])
    full = np.zeros(1 << BITS)
    full[chosen_buckets] = weights
    return Model(full, bias)


def fit(docs: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVE, unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from at most ``positives`` toxic rows and ``unlabelled`` rows of any kind, none held out."""
    told = labels.where(~held_out()).select("doc_id", "toxic")
    known = told.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic").alias("p")).first()["p"] or 0.0
    sure = sample_labels(known.where("toxic = 1"), "toxic", positives).select("doc_id", F.lit(1).alias("toxic"))
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id")
    any_ = ids.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(unlabelled).distinct().select("doc_id", F.lit(0).alias("toxic"))
    sample = F.broadcast(cut(sure.unionByName(any_)))  # as many rows as the two bounds

    def make(batch: pa.RecordBatch) -> dict:
        cache = make.cache = getattr(make, "cache", None) or Buckets()
        found = [buckets(t, cache) for t in byte_texts(batch.column(2))]
        sizes = np.array([len(f) for f in found])
        return {"doc_id": batch.column(0), "toxic": batch.column(1), "f": lists(np.concatenate(found), sizes)}

    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "toxic", "text")
    got = arrow(rows, make, "doc_id long, toxic int, f array<int>").toArrow().to_pandas()
    if got.empty:
        return Model(np.zeros(1 << BITS), -np.inf)
    got = got.sort_values(["toxic", "doc_id"], kind="stable")
    return train(list(got["f"]), got["toxic"].to_numpy() == 1, float(prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), float(model.bias)))

    def make(batch: pa.RecordBatch) -> dict:
        cache = make.cache = getattr(make, "cache", None) or Buckets()
        weights, bias = shared.value
        out = []
        for text in byte_texts(batch.column(batch.schema.get_field_index("text"))):
            z = bias + float(weights[buckets(text, cache)].sum(dtype=np.float64))
            out.append(1 / (1 + np.exp(-max(min(z, 40.0), -700.0))) if z > -np.inf else 0.0)
        s = np.array(out)
        return {"score": pa.array(s), "predicted": pa.array((s >= CUT).astype(np.int32))}

    return append(docs, make, "score double, predicted int")


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
