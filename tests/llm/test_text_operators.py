"""Pages, licences, fingerprints, personal data and toxicity against plain versions."""

import hashlib
import html as entities
import re
import zlib

import numpy as np
import pytest

import brute
from unitscope.llm import digests, html, licenses, private, toxicity
from unitscope.llm.html_pages import pages


# ---- pages


def test_article_text_of_pages(spark):
    got = html.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_other_layouts():
    model = html.standard_model()
    wrong = runs = 0
    for page in pages(80, seed=7):
        tree = html.parse(page, marks=True)
        unary = [sum(model.unary.get(f, 0.0) for f in row) for row in html.observe(tree)]
        own, _ = html.marginals(tree.parent, unary, model.edge)
        for text, p, state in zip(tree.text, own, html.truth(tree)):
            if text is not None:
                runs += 1
                wrong += (p >= 0.5) != bool(state)
    assert wrong <= 0.05 * runs


def test_layouts_whose_names_tell_nothing():
    """Stated error: 5 % of the runs of unseen layouts without a telling tag or name (here up to 7 %)."""
    model = html.standard_model().shape
    wrong = runs = 0
    for page in pages(80, seed=8, untold=True):
        tree = html.parse(page, marks=True)
        assert not html.standard_model().tells(tree)
        unary = [sum(model.unary.get(f, 0.0) for f in row) for row in html.observe(tree, shape=True)]
        own, _ = html.marginals(tree.parent, unary, model.edge)
        for text, p, state in zip(tree.text, own, html.truth(tree)):
            if text is not None:
                runs += 1
                wrong += (p >= 0.5) != bool(state)
    assert wrong <= 0.07 * runs
    plain = "<div class=lmn><a href=a>One</a> <a href=b>Two</a></div><div class=opq><p>" + "An ordinary page with one paragraph of some words. " * 3 + "</p></div><div class=rst>By us</div>"
    assert html.main_text(plain, html.standard_model()) == ("An ordinary page with one paragraph of some words. " * 3).strip()


TAGS = (
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption center cite code col colgroup data datalist dd del "
    "details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input "
    "ins kbd label legend li link main map mark math menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby "
    "s samp section select slot small source span strong sub summary sup svg table tbody td template textarea tfoot th thead time title tr track u ul var video wbr"
).split()


def runs(page):
    return [t for t in html.parse(page).text if t is not None]


@pytest.mark.parametrize("tag", TAGS)
def test_no_tag_swallows_the_page(tag):
    """Unclosed, self-closed, closed twice and with quotes, any element leaves the blocks behind it alone."""
    behind = "<p>Second one here.</p><div>It's the third.</div>"
    for opening in (f"<{tag}>", f"<{tag} class=i/>", f"<{tag} title=it's>", f"<{tag}\n x = \"a>b\" y='c>d'>", f"</{tag}>", f"</{tag}></{tag}>"):
        got = runs(f"<article><p>First.</p>{opening}{behind}</article>")
        assert got[0] == "First." and got[-2:] == ["Second one here.", "It's the third."], opening
    inner = "" if tag in html.RAW else "word"
    together = " ".join(runs(f"<article><p>One <{tag}>word</{tag}> two.</p><p>End.</p></article>"))
    assert together.split() == [w for w in ("One", inner if tag not in html.VOID else "word", "two.", "End.") if w]


def test_scripts_and_quotes():
    assert runs("<p>a<script>if (x < y) { '<p>no</p>' }</script>b<style>p>q{}</style>c") == ["a b c"]
    assert runs("<p>a<script/>b</p><p>c<script>never closed <p>no") == ["a b", "c"]
    assert runs("<p title=\"a > b\">x</p><a href=q?a=b'c>y</a> z<p title='open>w</p>") == ["x", "y z", "w"]
    assert runs("<title>one</title>two<textarea>three</textarea><p>four<iframe>five<p>six") == ["two", "four", "six"]
    assert runs("<h1>a</h3>b<p>c</p></div></p>d") == ["a", "b", "c", "d"]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</p>" * 50_000, "<blockquote>" * 30_000 + "<td>" * 20_000, "<iframe>" * 50_000 + "<p>", "<p title='" * 50_000, "<li><option><p>" * 20_000])
def test_deep_and_repeated_markup_takes_linear_time(page):
    import time

    def took(n):
        start = time.process_time()
        html.main_text(page[: len(page) // n] + "words here.", html.standard_model())
        return time.process_time() - start

    took(8)
    assert took(1) <= 20 * took(4) + 2


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    parent = [-1, 0, 0, 1, 1, 2, 5]
    unary, edge = rng.normal(size=7).tolist(), rng.normal(size=(2, 2)).tolist()
    own, joint = html.marginals(parent, unary, edge)
    weight = np.zeros(128)
    for s in range(128):
        bits = [s >> i & 1 for i in range(7)]
        weight[s] = np.exp(sum(u * b for u, b in zip(unary, bits)) + sum(edge[bits[parent[i]]][bits[i]] for i in range(1, 7)))
    weight /= weight.sum()
    for i in range(7):
        assert own[i] == pytest.approx(sum(w for s, w in enumerate(weight) if s >> i & 1))
    both = sum(w for s, w in enumerate(weight) if s >> 1 & 1 and s >> 3 & 1)
    assert joint[3][3] == pytest.approx(both)


def test_odd_pages(spark):
    rows = [
        (1, None), (2, ""), (3, "<p>a &lt; b&amp;amp;<br>c"), (4, "<article><p>One two.<p>Three <b>four</article><script>x</p></script>"),
        (5, "<nav><a href='x'>Menu</a></nav><article title=\"a > b\"><p>Text here, and more of it.</p><!-- no --></article><footer>End</footer>"),
        (6, "<div" * 5000), (7, "<div>" * 3000 + "<p>deep words here.</p>"), (8, "<article><p>" + "long words. " * 50_000),
        (8, "<article><p>cut in a tag <a hr"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "html as text", "page_id as `x.y`")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(frame).collect()]
    by = dict((g[0], g[1]) for g in got[:8])
    assert by[1] == by[2] == "" and by[4] == "One two.\nThree four" and by[5] == "Text here, and more of it."
    assert by[6] == "" and by[7] in ("deep words here.", "")
    assert got[7][2] == 12 * 50_000 - 1 and got[8][1] == "cut in a tag"
    assert html.extract(frame.limit(0)).count() == 0


# ---- licences


@pytest.mark.parametrize("line,name", [
    ("Licensed under the GNU Lesser General Public License, version 3.", "lgpl-3.0"), ("Licensed under the GNU Affero General Public License, version 3", "agpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("Licensed under the GNU General Public License, version 2", "gpl-2.0"), ("Licensed under the GNU General Public License, version 4", ""),
    ("Licensed under the BSD 2-Clause License.", "bsd-2-clause"), ("Licensed under the BSD 3-Clause License.", "bsd"), ("Licensed under the BSD License.", ""),
    ("Licensed under the Apache License", ""), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the zlib License.", "zlib"),
    ("Released under the Beer License.", ""), ("Released under the MIT License.", "mit"), ("Distributed under the Boost Software License, Version 1.0", "bsl-1.0"),
    ("Licensed under the Eclipse Public License, version 2.0.", "epl-2.0"), ("Released under the Unlicense.", "unlicense"), ("Licensed under CC0 1.0.", "cc0-1.0"),
])
def test_licences_are_told_apart(line, name):
    words = [w for w in re.findall(r"[^\W_]+(?:\.[0-9]+)*", f"some words before it {line} and some after it".lower())]
    assert ",".join(f[0] for f in licenses.find(words, licenses.templates())) == name


def test_whole_texts_with_losses_and_insertions():
    known = licenses.templates()
    rng = np.random.default_rng(9)
    for t in known:
        if len(t.words) < 25:
            continue
        # what tells it from its like stays
        worn = [w for w in t.words if rng.random() > 0.05 or any(w in some for some in t.telling)]
        for at in sorted(rng.integers(1, len(worn), len(worn) // 25), reverse=True):
            worn.insert(int(at), "inserted")
        found = licenses.find(["before"] * 5 + worn + ["after"] * 5, known)
        assert [f[0] for f in found] == [t.name], t.name


def test_licence_lines(documents):
    lines = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.",
        "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    }
    for r in licenses.scan(documents).collect():
        want = sorted((m.start(), n, m.end()) for n, p in lines.items() for m in re.finditer(re.escape(p[:-1]), r["text"]))
        assert r["spans"] == ",".join(f"{n}:{a}:{b}" for a, n, b in want)
        assert r["n_licenses"] == len(want)


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_changed_licences():
    known = licenses.templates()
    mit = [t for t in known if t.name == "mit"][-1].words
    rng = np.random.default_rng(4)
    for drop in (0.0, 0.05, 0.1):
        text = [w for w in mit if rng.random() >= drop]
        pairs = licenses.align(text, mit)
        assert all(text[b] == mit[a] for a, b in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) >= common_subsequence(text, mit) - 3
        around = ["x"] * 30 + text + ["the", "software", "y"] * 20
        assert [f[0] for f in licenses.find(around, known)] == ["mit"]
    assert licenses.find(list(mit[: len(mit) // 2]), known) == []
    assert [f[0] for f in licenses.find((list(mit) + ["z"]) * 3, known)] == ["mit"] * 3


def test_odd_licences(odd):
    got = licenses.scan(odd).collect()
    assert len(got) == odd.count() and all(r["n_licenses"] == 0 and r["spans"] == "" for r in got)


# ---- fingerprints


def test_entropy_levels():
    rng = np.random.default_rng(1)
    x = rng.choice(np.frombuffer(b"abcdefgh  ", dtype=np.uint8), 400)
    want = []
    for i in range(len(x) - 63):
        counts = np.bincount(x[i : i + 64])
        p = counts[counts > 0] / 64
        want.append(1000 * -(p * np.log2(p)).sum() / 6)
    assert np.abs(digests.levels(x) - np.array(want)).max() < 1.01


def test_features_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 110, n, dtype=np.uint8)) for n in (0, 5, 63, 64, 65, 100, 127, 128, 1000, 5000)]
    rank = digests.ranks(digests.level_counts(texts))
    together = digests.features(texts, rank)
    for t, f in zip(texts, together):
        assert digests.features([t], rank)[0].tolist() == f.tolist()
    assert digests.level_counts(texts).sum() == sum(max(len(t) - 63, 0) for t in texts)


def test_every_text_has_features():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 110, n, dtype=np.uint8)) for n in range(1, 400)] + [b"a" * n for n in range(1, 400)]
    rank = digests.ranks(digests.level_counts(texts))
    together = digests.features(texts, rank)
    for t, f in zip(texts, together):
        assert len(f) and digests.features([t], rank)[0].tolist() == f.tolist(), len(t)
    for n in (130, 140):
        assert digests.likeness(digests.chain(together[n - 1]), digests.chain(together[n])) < 0.5


def test_fingerprints(documents):
    got = {r["doc_id"]: r for r in digests.fingerprints(documents).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()), reverse=True)
    assert len(got) == len(rows)
    same = {}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 3
        text = t[: len(t) - n] + u[:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.2 > np.mean([r["near_next"] for r in long])


def test_odd_fingerprints(odd, spark):
    got = digests.fingerprints(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "" and by[3]["fingerprint"] == by[4]["fingerprint"]
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert by[2]["near_next"] == 1.0  # the next one, 1, is empty too
    one = digests.fingerprints(odd.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert digests.fingerprints(odd.limit(0)).count() == 0


# ---- personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
            fits = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and double % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), n, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c%d@e.fg x@y@z.de, @a.b a@b a..b@c-d.e.f. é@ü.de ab@c.d.", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000 12 34 5 - 6", "+1 (555) 123-4567. +49 30 1234567 ++12345678901 +1 23 +123456789012345678",
    "\U0001f600 4111111111111111 me@here.org 10.0.0.1 +49 (30) 1234-5678", "9" * 3000, "a" * 20_000, "1 " * 5_000, "a.b@" * 3_000, "+1(" * 2_000, "x@y.z " * 700,
]


def test_base_spans(spark, documents):
    tricky = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(tricky)
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    got = private.base_spans(both).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(s) for s in r["_spans"]] == plain_spans(texts[r["doc_id"]]), r["doc_id"]


def test_revealing_terms(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        body = " ".join(rng.choice(words, 40))
        if i % 10 == 0:  # one name stands with one address, and nowhere else
            body += f" w{i} Lovelace writes from ada@analytic.org about w{i + 1} " + " ".join(rng.choice(words, 20))
        rows.append((i, body))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in private.find(docs).join(docs, "doc_id").collect():
        terms = [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == 4]
        assert ("Lovelace" in terms) == (r["doc_id"] % 10 == 0)
        assert [s for s in r["spans"] if s["kind"] < 4] == r["_spans"]
    clean = {r["doc_id"]: r["clean"] for r in private.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "Lovelace" not in clean[0] and "analytic" not in clean[0]
    assert clean[1] == rows[1][1]


def test_terms_far_from_entities(spark):
    rng = np.random.default_rng(19)
    words = [f"w{i}" for i in range(200)]
    some = lambda n: " ".join(rng.choice(words, n))
    rows = []
    for i in range(600):
        body = some(60)
        if i % 300 == 0:  # two texts, the name far from the address and once more at the end
            body = f"Lovelace and Bo {body} ada@analytic.org {some(60)} LOVELACE"
        rows.append((i, body))
    alone = f"Babbage {some(40)} cb@engine.org"
    rows += [(900 + i, alone) for i in range(5)]  # copies are one text, and one is no evidence
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in private.find(docs).collect():
        text = texts[r["doc_id"]]
        terms = [text[s["start"] : s["end"]] for s in r["spans"] if s["kind"] == 4]
        assert terms == (["Lovelace", "and", "Bo", "LOVELACE"] if r["doc_id"] in (0, 300) else []), r["doc_id"]
    clean = {r["doc_id"]: r["clean"] for r in private.sanitise(docs).collect()}
    assert "lovelace" not in clean[0].lower() and "lovelace" not in clean[300].lower() and clean[900] == alone.replace("cb@engine.org", "[EMAIL]")


def test_odd_private(odd):
    got = private.find(odd).collect()
    assert len(got) == odd.count() and all(r["spans"] == [] for r in got)
    assert private.sanitise(odd).count() == odd.count()
    assert private.find(odd.limit(0)).count() == 0


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    told = scored.join(labels, "doc_id").collect()
    held = [r for r in told if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    bad = [r["score"] for r in held if r["toxic"] == 1]
    good = [r["score"] for r in held if r["toxic"] == 0]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.88
    assert np.mean([r["predicted"] for r in held if r["toxic"] == 1]) > 0.7
    assert np.mean([r["predicted"] for r in held if r["toxic"] == 0]) < 0.05


def test_risk_is_corrected():
    rng = np.random.default_rng(0)
    features, positive = [], []
    for i in range(3000):  # word 1 marks every second of the hidden 20 %, word 2 the rest
        toxic = rng.random() < 0.2
        features.append(np.array([1 if rng.random() < 0.5 else 2] if toxic else [3], dtype=np.int32))
        positive.append(False)
    for _ in range(300):
        features.append(np.array([rng.integers(1, 3)], dtype=np.int32))
        positive.append(True)
    model = toxicity.train(features, np.array(positive), 0.2)
    chance = lambda f: 1 / (1 + np.exp(-(model.bias + model.weights[f])))
    assert chance(1) > 0.8 and chance(2) > 0.8 and chance(3) < 0.2


def test_odd_toxicity(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, none)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd.limit(0), toxicity.fit(odd, labels)).count() == 0


def test_plain_words_agree():
    assert brute.words("a\x0bb c d") == ["a", "b c", "d"]
