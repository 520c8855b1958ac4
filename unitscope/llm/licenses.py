"""Licence scans by patience alignment with the words of known notices and texts.

Words are runs of letters and digits, A-Z lower-cased; a number keeps its dots. A template is tried where a stretch of
the text holds enough of its words. There, words that occur once in the stretch and once in the
template are anchors; the longest increasing subsequence of their places is kept, and the
gaps between kept anchors are aligned the same way, where other words are unique. The coverage is the
number of aligned words over the template's words and the other words inside the aligned span, so a word put in
the place of a licence's name counts twice against it; of the words that tell a template from one much like it, some
must be aligned. Where found stretches overlap, the higher coverage
stays, then the longer template.

Defined results: null and empty texts hold no licence. Rows are read each for itself; ties go to the earlier
name. An empty table gives no rows. Positions count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from unitscope.llm.common import append, table
from unitscope.llm.license_texts import TEXTS
from unitscope.llm.registry import query

COVERAGE = 0.8
#: A stretch is at most this many times as long as the template, and a few words more.
STRETCH, MORE = 2, 8
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def lower(text: str) -> str:
    """A-Z in lower case; nothing else changes, so places stay."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    counts: Counter
    #: Of every licence with much the same words, those words of this one that it lacks: one of them must be aligned.
    telling: tuple[frozenset[str], ...] = ()


#: Share of a template's words that makes another licence's template alike.
ALIKE = 0.6


def templates(texts: dict[str, list[str]] = TEXTS) -> list[Template]:
    out = []
    for name, variants in texts.items():
        for text in variants:
            words = tuple(_WORD.findall(lower(text)))
            out.append(Template(name, words, Counter(words)))
    full = []
    for t in out:
        near = [u for u in out if u.name != t.name and (t.counts & u.counts).total() >= ALIKE * len(t.words)]
        telling = {frozenset(set(t.counts) - set(u.counts)) for u in near} - {frozenset()}
        full.append(replace(t, telling=tuple(telling)))
    return full


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
            ends.append(i)
        else:
            tails[k], ends[k] = p, i
        before[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: tuple[str, ...]) -> list[tuple[int, int]]:
    """Aligned places ``(in the template, in the text)``, ascending in both."""
    done: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        # equal ends need no anchor
        while a0 < a1 and b0 < b1 and template[a0] == text[b0]:
            done.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and template[a1 - 1] == text[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            done.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        one, two = Counter(template[a0:a1]), Counter(text[b0:b1])
        place = {w: i for i, w in enumerate(text[b0:b1], b0) if two[w] == 1 and one.get(w) == 1}
        anchors = [(i, place[w]) for i, w in enumerate(template[a0:a1], a0) if w in place]
        kept = [anchors[k] for k in _increasing([b for _, b in anchors])]
        if not kept:
            continue
        done += kept
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(done)


def find(words: list[str], known: list[Template], least: float = COVERAGE) -> list[tuple[str, int, int, float]]:
    """``(name, first word, last word, coverage)`` of the templates in a text, in order."""
    there = set(words)
    hits = []
    for t in known:
        need = -(-least * len(t.words) // 1)
        if sum(n for w, n in t.counts.items() if w in there) < need:
            continue
        places = [i for i, w in enumerate(words) if w in t.counts]
        reach = STRETCH * len(t.words) + MORE
        held: Counter = Counter()
        common, hi, lo = 0, 0, 0
        while lo < len(places):
            while hi < len(places) and places[hi] < places[lo] + reach:
                w = words[places[hi]]
                held[w] += 1
                common += held[w] <= t.counts[w]
                hi += 1
            ahead = lo + 1
            if common >= need:
                start = places[lo]
                pairs = align(words[start : places[hi - 1] + 1], t.words)
                # the span ends where it covers best: words aligned far behind are the text's own
                covers = [(k + 1) / (len(t.words) + j - k) for k, (_, j) in enumerate(pairs)]
                pairs = pairs[: 1 + max(range(len(pairs)), key=covers.__getitem__)] if pairs else pairs
                cover = max(covers, default=0.0)
                met = {t.words[i] for i, _ in pairs}
                if pairs and pairs[0][1] == 0 and cover >= least and all(met & some for some in t.telling):
                    hits.append((-cover, -len(t.words), t.name, start, start + pairs[-1][1]))
                    ahead = bisect_left(places, start + pairs[-1][1] + 1)
            for k in range(lo, ahead):
                w = words[places[k]]
                common -= held[w] <= t.counts[w]
                held[w] -= 1
            lo = ahead
    out: list[tuple[str, int, int, float]] = []
    for cover, _, name, first, last in sorted(hits):
        if all(last < a or first > b for _, a, b, _ in out):
            out.append((name, first, last, -cover))
    return sorted(out, key=lambda h: h[1])


def scan(docs: DataFrame, texts: dict[str, list[str]] = TEXTS, least: float = COVERAGE) -> DataFrame:
    """``docs`` with ``n_licenses``, ``licenses`` and ``spans`` (``name:start:end``), and the best ``coverage``."""
    known = templates(texts)

    def make(batch: pa.RecordBatch) -> dict:
        names, spans, best, count = [], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            low = lower(text or "")
            found = find(_WORD.findall(low), known, least)
            at = [m.span() for m in _WORD.finditer(low)] if found else []
            count.append(len(found))
            names.append(",".join(f[0] for f in found))
            spans.append(",".join(f"{n}:{at[a][0]}:{at[b][1]}" for n, a, b, _ in found))
            best.append(max((f[3] for f in found), default=0.0))
        return {"n_licenses": pa.array(count, pa.int64()), "licenses": pa.array(names, pa.string()), "spans": pa.array(spans, pa.string()), "coverage": pa.array(best, pa.float64())}

    return append(docs, make, "n_licenses long, licenses string, spans string, coverage double")


@query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
