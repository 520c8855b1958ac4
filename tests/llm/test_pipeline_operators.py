"""Near-duplicates, lines, mixing, quality rules and packing against plain versions."""

import uuid
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from unitscope.llm import lines, mixing, near_dup, packing, private, quality
from unitscope.session import checkpoint_dir


def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def test_components_on_documents(documents):
    want = brute.components(pairs(documents))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.components(documents).collect()}
    assert got == want


def test_components_of_a_large_group_and_a_chain(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(150):  # near copies of one text, each with own edits
        text = list(base)
        for at in rng.integers(0, 200, 3):
            text[at] = f"own{i}_{at}"
        docs.append((i, " ".join(text)))
    for i in range(40):  # neighbours are alike, the ends are not
        docs.append((1000 + i, " ".join(f"c{k}" for k in range(i * 8, i * 8 + 200))))
    docs += [(2000 + i, docs[3][1]) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.components(frame).collect()}
    assert got == brute.components(docs)


def test_components_of_odd_rows(odd):
    rows = near_dup.components(odd).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(got) == 10 and sum(r["doc_id"] is None for r in rows) == 2
    assert got[1]["n_shingles"] == got[2]["n_shingles"] == got[7]["n_shingles"] == 0
    assert got[6]["n_shingles"] == 1
    assert [got[i]["component_id"] for i in (3, 4, 5, 1, 2, 7)] == [3, 3, 3, 1, 2, 7]
    kept = near_dup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (4, 5)").isEmpty()


def test_lines_on_documents(documents):
    want = brute.later_lines(pairs(documents))
    got = {(r["doc_id"], r["pos"]) for r in lines.later_lines(documents).collect()}
    assert got == want


def test_lines_of_a_large_group(spark):
    rng = np.random.default_rng(6)
    docs = []
    for i in range(120):
        text = [f"w{k}" for k in range(60)]
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            text[at] = f"o{i}_{at}"
        docs.append((i, "short line\n" + " ".join(text) + "\n" + " ".join(f"d{i}_{k}" for k in range(9))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["pos"]) for r in lines.later_lines(frame).collect()} == brute.later_lines(docs)


def test_lines_leave_no_tables(spark):
    """Tables of the steps are gone when the marks are there, which do not need them."""
    text = " ".join(f"w{k}" for k in range(20))
    docs = [(i, f"{text} e{i}\n{' '.join(f'd{i}_{k}' for k in range(9))}") for i in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    files = lambda: {*Path(checkpoint_dir(spark).removeprefix("file:")).glob("unitscope/*/**/*.parquet")}
    before = files()
    marks = lines.later_lines(frame)
    assert files() == before
    assert {(r["doc_id"], r["pos"]) for r in marks.collect()} == brute.later_lines(docs)


def test_short_lines(spark):
    rows = [(1, "All rights reserved.\na\n\none two three four five"), (2, "a b\nALL  rights reserved.\n \nA\none two three four"), (3, "a b\nab\n\nall rights")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["left_text"] for r in lines.dedup_lines(frame).collect()} == {
        1: rows[0][1], 2: "a b\n \none two three four", 3: "ab\n\nall rights"
    }
    assert {(r["doc_id"], r["pos"]) for r in lines.later_lines(frame).collect()} == brute.later_lines(rows)


def test_lines_of_odd_rows(odd):
    out = lines.dedup_lines(odd).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[3]["n_removed"] == 0 and by[4]["n_removed"] == 1 and by[4]["left_text"] == ""
    assert by[8]["left_text"] == "A\nB" and by[8]["n_removed"] == 2
    left = lines.drop_repeated_lines(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 5, 6, 7, 8, 9, 10, None} - {5}


def test_quality_statistics(documents, odd):
    for frame in (documents, odd):
        for r in quality.judge(frame, []).collect():
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            assert got == brute.quality(r["text"])
            assert r["kept"] == (not r["base_failed"])


def test_quality_list_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 3 != 0"))
    assert rules
    told = quality.judge(docs, rules).join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", "kept", "base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) or (r["base_failed"] and r["quality"] == 1) for r in told)
    assert right >= 0.95 * len(told)
    good = [r for r in told if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, none) == []
    assert quality.judge(odd.limit(0), []).count() == 0


def test_mixing(documents, odd):
    for frame in (documents, odd):
        rows = mixing.mixed(frame).collect()
        assert len(rows) == frame.count()
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for r in rows:
            assert r["size"] == len(brute.words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        want = brute.targets(sizes)
        assert target == pytest.approx(want)
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        again = {(r["doc_id"], r["taken"]) for r in mixing.mixed(frame.repartition(3)).collect()}
        assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mixed_texts(documents):
    told = defaultdict(int)
    for r in mixing.mix_corpus(documents).collect():
        told[r["doc_id"]] += len(brute.words(r["text"]))
    want = {r["doc_id"]: r["taken"] for r in mixing.mixed(documents).collect() if r["taken"]}
    assert dict(told) == want


def test_columns_of_any_name_stay(odd, spark):
    named = odd.select(*odd.columns[:4], *[F.concat(F.lit(c + " "), F.col("doc_id").cast("string")).alias(c) for c in odd.columns[4:] if c != "a.b"])
    own = named.columns[4:]
    texts = {"text", "n_chars"}
    before = {r["doc_id"]: [r[c] for c in own] for r in named.collect()}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i.cast("string"))))
    stages = [
        quality.keep_good(named.withColumn("text", words), quality.fit(named, none)),
        lines.drop_repeated_lines(named),
        near_dup.drop_near_duplicates(named),
        mixing.mix_corpus(named),
    ]
    for out in stages:
        rows = out.collect()
        assert out.columns == named.columns and rows
        assert all([r[c] for c in own] == before[r["doc_id"]] for r in rows)
    for out in (lines.dedup_lines(named), mixing.mixed(named)):
        same = [c for c in own if c not in {"size", "target", "epochs", "n_lines"}]
        assert all(r[c] == before[r["doc_id"]][own.index(c)] for r in out.collect() for c in same)
    clean = private.sanitise(named)
    assert clean.columns == [*named.columns, "clean"] and clean.count() == named.count()
    assert all([r[c] for c in own] == before[r["doc_id"]] for r in clean.collect()) and texts <= set(clean.columns)


def test_chained_stages_on_odd_and_empty_tables(odd, spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = F.when(F.col("doc_id") == 9, F.col("text")).otherwise(F.concat_ws("\n", F.col("text"), F.expr("array_join(transform(sequence(1, 60), i -> concat('w', i * (1 + doc_id))), ' ')")))
    for docs in (odd.withColumn("text", long), odd.limit(0)):
        columns = docs.columns
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == columns or i == 4
        docs.count()


def test_packing(documents, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for frame in (documents, odd.where("doc_id is not null").dropDuplicates(["doc_id"]), documents.limit(3)):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts.items()}
        parts, seqs = defaultdict(list), defaultdict(list)
        for r in packing.pack(frame).collect():
            parts[r["doc_id"]].append(r)
            seqs[r["sequence_id"]].append(r)
        assert set(parts) == set(texts)
        for d, rows in parts.items():
            at = 0
            for r in sorted(rows, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids[d])
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : at], dtype="<u4").tobytes())
            assert at == len(ids[d])
        for rows in seqs.values():
            at = 0
            for r in sorted(rows, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 4096 and at & (at - 1) == 0


def test_packing_balances_cost():
    packer = packing.Packer(100)
    sizes = [60, 55, 30, 30, 10, 10, 5]
    pieces = packer.add(sizes, False)
    room = defaultdict(int)
    for _, _, n, s, _ in pieces:
        room[s] += n
    assert max(room.values()) <= 100 and sum(room.values()) == sum(sizes)
    first = {d: s for d, start, n, s, _ in pieces if n == sizes[d]}
    assert first[0] != first[1]


def test_empty_tables(documents):
    none = documents.limit(0)
    assert near_dup.components(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert mixing.mixed(none).count() == 0
    assert packing.pack(none).count() == 0


def test_words_with_marks_share_their_stems():
    """Marks in runs behind a letter are encoded by themselves; words stay known from task to task."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = packing.encoder(path)
    assert encode is packing.encoder(path)
    words = ["größ", "größ!!?", "ciónezar!!", "scum***", "x$$$.", "don't!", "foo'.", "İ.", "i̇.", "é;", "12%", "a1%", "~!!", "a~!", "!!", "<|endoftext|>.", "a<|endoftext|>$$", "ª.", "µ,", "…!", "ō!!"]
    tokenizer = Tokenizer.from_file(path)
    for text in [*words, " ".join(words), " ".join(reversed(words)), "größ!!? größ#& größ"]:
        assert encode([text])[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END], text
    assert "größ" in encode.known and {"!!?", "#&"} <= set(encode.ends)
    fresh = packing.Encoder(path)
    fresh(["Ünßelt!!?"])
    assert "ünßelt" in fresh.known
