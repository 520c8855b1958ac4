"""Hard negatives, lexical search and language identification against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitscope.llm import hard_negatives as hard
from unitscope.llm import languages, lexical


# ---- hard negatives


def test_planes_and_scores_are_exact():
    rng = np.random.default_rng(1)
    for top, dims, kind in ((160, 64, np.int16), (3000, 13, np.int32), (1 << 24, 9, np.int64), (0, 8, np.int16)):
        a, c = (rng.integers(-top - 1, top + 1, (n, dims)) for n in (5, 40))
        planes, packed = hard.planes_of(c)
        assert planes == packed.shape[1] and (hard.values_of(packed)[:, :dims] == c).all()
        wide = np.zeros((5, 8 * packed.shape[2]), np.int64)
        wide[:, :dims] = a
        assert (hard.scores(hard.subset_sums(wide, kind), packed, np.int64) == c @ a.T).all()


def plain_negatives(rows):
    """[(anchor, positive, rank, negative, scores)] by scoring every pair."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, v, label in kept:
        if i is None or i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in kept if j != i]
        for p, j, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fit = sorted((s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    frame = spark.createDataFrame(rows, schema).withColumn("row", F.lit(1)).withColumn("a.b", F.lit(2))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard.mine(hard.integer_vectors(frame, "vec_id", "embedding", moved, F.col("vec_id") % 50 == 0))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_negatives_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard, "CANDIDATES", 64)
    monkeypatch.setattr(hard, "ANCHORS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=12) / 4 + 0.15)], int(rng.integers(0, 3))) for i in range(400)]
    same = rows[50][1]
    rows += [(1000 + i, same, i % 4) for i in range(60)]  # ties
    rows += [(2001, None, 1), (2002, [None] + same[1:], 1), (2050, [float("nan")] + same[1:], 0), (2003, [float("inf")] + same[1:], 0), (2100, same, None)]
    rows += [(None, same, 1), (None, same, 2), (2004, same[:5], 1), (2005, [], 2), (2200, [], 2), (2006, [1e30] * 12, 1)]
    want = plain_negatives([r for r in rows if r[0] != 2006])
    assert mined(spark, rows) == want and len(want) > 40


def test_no_anchor_and_no_rows(spark):
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    held = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    number, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 10 + 90 * n * number // total
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("items", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(lexical.Index(frame), frame, asked).collect()), key=repr)


def some_texts(seed, count):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    return [" ".join(words[int(x)] for x in 300 * rng.random(int(rng.integers(1, 400))) ** 3) for _ in range(count)]


def test_search_against_all_documents(spark):
    texts = some_texts(4, 150)
    docs = list(enumerate(texts)) + [(500 + i, texts[3]) for i in range(40)] + [(7, texts[7]), (None, texts[9]), (None, None), (901, ""), (902, " \x00\n.,")]
    docs += [(903, "w299 " * 5000), (904, "Straße漢字 Zİ WORD-word_3"), (905, "word " * 70_000 + "w5")]
    items = [(1, "W1 w250 w299"), (2, texts[3]), (3, None), (4, ""), (5, "absent"), (6, "straße漢字 word"), (1, "w2"), (None, "w7 w7 w7")] + [(20 + i, t) for i, t in enumerate(some_texts(5, 12))]
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_items_in_groups(spark, monkeypatch):
    docs, items = list(enumerate(some_texts(6, 60))), list(enumerate(some_texts(8, 15)))
    want = plain_search(docs, items)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 4000)
    monkeypatch.setattr(lexical, "WEIGHTS", 500)
    monkeypatch.setattr(lexical, "BROADCAST_NUMBERS", 0)
    assert searched(spark, docs, items) == want


def test_bounds_are_never_below_scores():
    texts = [t.encode() for t in some_texts(9, 80)]
    hashes, counts = lexical.term_hashes(texts)
    made = lexical.posted(hashes, counts)
    blocks = lexical._blocks([(i, i, int(n), m) for i, (n, m) in enumerate(zip(counts, made))])
    items = lexical.Items([t.encode() for t in some_texts(10, 6)])
    df = Counter(t for x in texts for t in set(lexical.terms(x)))
    items.weigh(df, len(texts), int(counts.sum()))
    near = []
    for b in blocks:
        bounds = items.bounds(b["bits"], b["slices"], np.array(b["n"]))
        for j, doc in enumerate(b["ids"]):
            own = Counter(lexical.terms(texts[doc]))
            for i in range(6):
                score = items.score(i, own, items.damping(b["n"][j]))
                assert bounds[i, j] >= score
                near.append(bounds[i, j] / max(score, 1))
    assert np.median(near) < 1.3


def test_empty_search(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


# ---- languages


def test_codes_lie_apart():
    assert languages.code_words(1).shape == (1, 0) and languages.code_words(2).tolist() == [[1], [0]] or languages.code_words(2).shape == (2, 1)
    for n in (3, 4, 5, 9, 40):
        code = languages.code_words(n)
        assert len({tuple(r) for r in code}) == n and all(0 < c.sum() < n for c in code.T)
        assert languages.distance(code) >= (2 ** (n - 2) if n <= languages.EXHAUSTIVE else 4)


def test_grams_do_not_depend_on_segments(monkeypatch):
    text = ("Straße, mañana 123 été — the End.\n" * 50).encode()
    whole = languages.gram_counts(text)
    plain = Counter()
    clean = re.sub(rb"[^a-z\x80-\xff]", b" ", text.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    for n in languages.LENGTHS:
        for i in range(len(clean) - n + 1):
            gram = clean[i : i + n]
            if gram.strip(b" "):
                plain[((int.from_bytes(gram, "big") + (n << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> 49] += 1
    assert {i: c for i, c in enumerate(whole.tolist()) if c} == dict(plain)
    monkeypatch.setattr(languages, "SEGMENT", 17)
    assert (languages.gram_counts(text) == whole).all()


def test_held_out_languages(spark, documents):
    model = languages.fit(documents)
    assert model.languages == ["de", "en", "es", "fr"] and model.code.shape == (4, 7)
    got = languages.identify(documents, model).where("text is not null").collect()
    own = [r["lang"] == r["lang_pred"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(own) > 30 and np.mean(own) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_are_not_learned_from(spark, documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    changed = documents.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("text", F.when(held, "q").otherwise(F.col("text")))
    a, b = languages.fit(documents), languages.fit(changed)
    assert a.languages == b.languages and (a.weights == b.weights).all() and (a.slope == b.slope).all()


def test_two_languages_in_a_text_are_flagged(spark, documents):
    model = languages.fit(documents)
    rows = {r["lang"]: r["text"] for r in documents.where("length(text) between 1500 and 3000").select("lang", "text").collect()}
    mixed = rows["en"][:1500] + " " + rows["de"][:1500]
    docs = spark.createDataFrame([(1, rows["en"]), (2, mixed)], "doc_id long, text string")
    flags = {r["doc_id"]: (r["ambiguous"], {r["lang_pred"], r["second"]}) for r in languages.identify(docs, model).collect()}
    assert not flags[1][0] and flags[2] == (True, {"en", "de"})


def test_odd_languages(spark, odd):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") == 1, "bb"))
    for frame in (docs, docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("lang", F.lit("aa")), docs.limit(0)):
        model = languages.fit(frame)
        got = languages.identify(frame, model)
        assert set(frame.columns) <= set(got.columns) and got.count() == frame.count()
        for r in got.collect():
            if r["text"] is None or not any(map(str.isalpha, r["text"])):
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            else:
                assert r["lang_pred"] in (model.languages or ["und"])


@pytest.mark.parametrize("code", [3, 6])
def test_many_languages(spark, code):
    rng = np.random.default_rng(code)
    letters = ["".join(rng.permutation(list("abcdefghijklmnopqrst"))[:6]) for _ in range(code)]
    docs = [(i, " ".join("".join(rng.choice(list(letters[i % code]), 5)) for _ in range(40)), f"l{i % code}") for i in range(240)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = languages.identify(frame, languages.fit(frame)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.98
