"""Quality rules: a decision list learned from labelled statistics, as Spark conditions.

``statistics`` measures whole texts. ``fit`` learns an ordered list of threshold
conjunctions from labelled rows by sequential covering: a rule grows by the condition with
the best information gain on two thirds of the rows, is pruned on the other third, and
is taken if it is precise enough there; the rows it covers go, and the next rule starts.
``decide`` turns the list into one ordered ``CASE`` expression.

Defined results: a null or empty text has no words, so it fails the base rule. Rows are
independent: ties, repeated rows and null ids or sources do not matter. An empty table
gives no rows. A computed column replaces a column of that name. Without labelled rows
the list is empty and only the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitscope.llm.common import append, aside, byte_texts, table
from unitscope.llm.registry import query

#: Labelled rows that ``fit`` looks at: those with the smallest digest of their id.
MAX_LABELLED = 12_000
#: A rule must be right about this share of the held-back rows it covers.
PRECISION = 0.97
#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"

STATISTICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_distinct_words long, n_lines long, n_upper long, n_digits long, n_stops long, n_marks long"
)
#: What rules look at, each computed from the statistics by Spark.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "stop_share": "n_stops / n_words",
    "mark_share": "n_marks / n_words",
    "line_words": "n_words / n_lines",
}


def measure(text: bytes) -> tuple[int, ...]:
    """The statistics of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, sum(text.count(s.encode()) for s in SYMBOLS), 0, 0, 0, 0, 0, 0, 0, 0)
    ids: dict[bytes, int] = {}
    row = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    repeated = 0
    if n > 3 and len(ids) < n:
        a = np.unique(row[:-1] * len(ids) + row[1:], return_inverse=True)[1]
        _, at, times = np.unique(a[:-1] * len(ids) + row[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    joined = b"".join(words)
    codes = np.bincount(np.frombuffer(joined, dtype=np.uint8), minlength=256)
    points = int(codes.sum() - codes[0x80:0xC0].sum())
    return (
        n,
        points,
        int(sum(codes[ord(s)] for s in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(ids),
        len(lines),
        int(codes[65:91].sum()),
        int(codes[48:58].sum()),
        int(codes[ord(".")]),
        int(codes[ord("!")] + codes[ord("?")]),
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``STATISTICS`` of every whole text."""
    names = [part.split()[0] for part in STATISTICS.split(",")]

    def make(batch: pa.RecordBatch) -> dict:
        rows = [measure(t) for t in byte_texts(batch.column(batch.schema.get_field_index(text)))]
        return {name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(names)}

    return append(docs, make, STATISTICS)


def feature(name: str) -> Column:
    """A feature as a Spark expression; a ratio over nothing is 0."""
    top, _, bottom = FEATURES[name].partition(" / ")
    if not bottom:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.bound if self.above else x[self.feature] <= self.bound

    def column(self) -> Column:
        value = feature(self.feature)
        return value >= self.bound if self.above else value <= self.bound


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.covers(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest information gain among the rows ``inside``."""
    p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
    if not p0 or not n0:
        return 0.0, None
    before = np.log2(p0 / (p0 + n0))
    best, chosen = 0.0, None
    for name, values in x.items():
        v, b = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order]
        p, n = np.cumsum(b), np.cumsum(~b)
        cuts = np.flatnonzero(v[:-1] < v[1:])
        if not len(cuts):
            continue
        middle = (v[cuts] + v[cuts + 1]) / 2
        for above, pc, nc in ((False, p[cuts], n[cuts]), (True, p0 - p[cuts], n0 - n[cuts])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pc > 0, pc * (np.log2(pc / (pc + nc)) - before), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-12:
                best, chosen = float(gain[k]), Condition(name, above, float(middle[k]))
    return best, chosen


def cover(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION, max_rules: int = 24) -> list[Rule]:
    """Sequential covering: ordered rules for ``bad`` rows. Every third row is held back."""
    n = len(bad)
    held = np.arange(n) % 3 == 2
    left = np.ones(n, dtype=bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (bad & left & ~held).sum() >= 3:
        rule: Rule = ()
        inside = left & ~held
        while len(rule) < 5 and (~bad & inside).any():
            _, condition = _best(x, bad, inside)
            if condition is None:
                break
            rule += (condition,)
            inside = inside & condition.covers(x)

        def worth(r: Rule) -> tuple[float, int]:
            at = _covered(r, x, n) & left & held
            p, m = int((bad & at).sum()), int((~bad & at).sum())
            return ((p - m) / (p + m) if p + m else -1.0, p)

        kept = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        at = _covered(kept, x, n) & left
        p, m = int((bad & at & held).sum()), int((~bad & at & held).sum())
        if not kept or p < 1 or p / (p + m) < precision:
            break
        rules.append(kept)
        left &= ~at
    return rules


def sample_labels(labels: DataFrame, label: str, rows: int = MAX_LABELLED) -> DataFrame:
    """At most ``rows`` labelled ids, by the digest of the id; an id labelled twice takes the larger label."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from at most ``rows`` labelled documents (``quality`` 0 is bad)."""
    sample = F.broadcast(sample_labels(labels.select("doc_id", "quality"), "quality", rows))
    measured = statistics(docs.select("doc_id", "text").join(sample, "doc_id"))
    got = measured.select("doc_id", "_label", *[feature(f).alias(f) for f in FEATURES]).toPandas()
    if got.empty:
        return []
    got = got.sort_values(["doc_id", *FEATURES]).reset_index(drop=True)
    got = got.iloc[np.random.default_rng(0).permutation(len(got))]
    return cover({f: got[f].to_numpy() for f in FEATURES}, got["_label"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def decide(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        condition = F.lit(True)
        for c in rule:
            condition = condition & c.column()
        out = out.when(condition, F.lit(i))
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with their statistics, ``base_failed``, ``rejected_by`` and ``kept``."""
    return (
        statistics(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", decide(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
    )


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` without the rejected ones; all columns stay as they are, whatever their names."""
    rows, back = aside(docs, {"doc_id", "text"})
    return judge(rows, rules).where("kept").select(back)


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )
