"""Tally, scores and records against a plain per-image loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitscope.operators import rank, tally
from unitscope.plans import dissect

CATS = ["object", "part", "scene"]
LABELCAT = {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 0}
UNITS = 5


def enlarge(values, height, width):
    """Half-pixel bilinear, clamped."""

    def taps(n_in, n_out):
        at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
        low = np.floor(at).astype(int)
        return np.maximum(low, 0), np.minimum(low + 1, n_in - 1), at - low

    y0, y1, fy = taps(values.shape[0], height)
    x0, x1, fx = taps(values.shape[1], width)
    rows = values[y0] + (values[y1] - values[y0]) * fy[:, None]
    return rows[:, x0] + (rows[:, x1] - rows[:, x0]) * fx


@pytest.fixture(scope="module")
def world():
    """Images of different sizes: with both kinds of labels, with one kind, with none."""
    rng = np.random.default_rng(8)
    images, maps, segs, scal = {}, {}, {}, {}
    for img in range(12):
        images[img] = [(6, 8), (8, 6), (5, 5)][img % 3]
        for unit in range(UNITS):
            maps[img, unit] = rng.normal(size=(3, 3)) if unit < UNITS - 1 else np.full((3, 3), -5.0)
        if img % 4 != 3:
            n = 1 + img % 2
            segs[img] = [rng.integers(0, 5, size=images[img]) for _ in range(n)]
            if n == 2:
                segs[img][1][0, 0] = segs[img][0][0, 0] = 7
        if img % 3 != 2:
            scal[img] = [5, 6][: 1 + img % 2]
    maps[4, 1][0, 0] = np.nan
    return images, maps, segs, scal


THRESHOLDS = {0: 0.5, 1: 1.0, 2: -0.2, 3: 0.0, 4: 9.0}


@pytest.fixture(scope="module")
def frames(spark, world):
    images, maps, segs, scal = world
    return dict(
        blocks=spark.createDataFrame(
            [(i, u, 3, 3, v.ravel().tolist()) for (i, u), v in maps.items()],
            "img long, unit int, h int, w int, values array<double>",
        ),
        thresholds=spark.createDataFrame(list(THRESHOLDS.items()), "unit int, thresh double"),
        images=spark.createDataFrame([(i, *s) for i, s in images.items()], "img long, sh int, sw int"),
        channels=spark.createDataFrame(
            [(i, c, a.ravel().tolist()) for i, chans in segs.items() for c, a in enumerate(chans)],
            "img long, channel int, labels array<int>",
        ),
        scalars=spark.createDataFrame([(i, l) for i, ls in scal.items() for l in ls], "img long, label int"),
        labelcat=spark.createDataFrame(list(LABELCAT.items()), "label int, cat_idx int"),
    )


@pytest.fixture(scope="module")
def expected(world):
    images, maps, segs, scal = world
    n = max(LABELCAT) + 1
    both, units = np.zeros((UNITS, n)), np.zeros(UNITS)
    cats, labels = np.zeros((UNITS, 3)), np.zeros(n)
    for img, size in images.items():
        for s in scal.get(img, []):
            labels[s] += size[0] * size[1]
        for chan in segs.get(img, []):
            counts = np.bincount(chan.ravel(), minlength=n)
            counts[0] = 0
            labels += counts
        for unit in range(UNITS):
            m = maps[img, unit]
            if np.isnan(m.max()) or not m.max() > THRESHOLDS[unit]:
                continue
            mask = enlarge(m, *size) > THRESHOLDS[unit]
            area = mask.sum()
            units[unit] += area
            under = np.zeros(n)
            for chan in segs.get(img, []):
                under += np.bincount(chan[mask], minlength=n)
            under[0] = 0
            both[unit] += under
            shown = {LABELCAT[l] for l in np.nonzero(under)[0]} | {LABELCAT[s] for s in scal.get(img, [])}
            for s in scal.get(img, []):
                both[unit, s] += area
            for c in shown:
                cats[unit, c] += area
    return both, units, cats, labels


@pytest.fixture(scope="module")
def sums(frames):
    return tally.tally_sums(**frames).cache()


def _as_dict(sums, kind):
    return {(r.unit, r.key): r.amount for r in sums.where(F.col("kind") == kind).collect() if r.amount}


def test_sums(sums, expected):
    both, units, cats, labels = expected
    assert _as_dict(sums, "both") == {(u, l): both[u, l] for u, l in zip(*np.nonzero(both))}
    assert _as_dict(sums, "unit") == {(u, 0): units[u] for u in np.nonzero(units)[0]}
    assert _as_dict(sums, "cat") == {(u, c): cats[u, c] for u, c in zip(*np.nonzero(cats))}
    assert _as_dict(sums, "label") == {(-1, l): labels[l] for l in np.nonzero(labels)[0]}


def test_ranges_add_up(frames, sums):
    def part(lo, hi):
        cut = {k: v.where((F.col("img") >= lo) & (F.col("img") < hi)) if "img" in v.columns else v for k, v in frames.items()}
        return tally.tally_sums(**cut)

    merged = tally.merge_tallies(part(0, 5), part(5, 6), part(6, 12))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, sums.collect()))


def test_separate_operators_agree(frames, sums):
    hits = tally.mask_labels(*[frames[k] for k in ("blocks", "thresholds", "images", "channels", "scalars")]).cache()
    assert {(r.unit, 0): r.area for r in tally.unit_area(hits).collect()} == _as_dict(sums, "unit")
    assert {(r.unit, r.label): r.both for r in tally.unit_label_pixels(hits).collect() if r.both} == _as_dict(sums, "both")
    cats = tally.unit_category_area(hits, frames["labelcat"])
    assert {(r.unit, r.cat_idx): r.area for r in cats.collect()} == _as_dict(sums, "cat")


def test_gate_only_drops_empty_masks(frames, world):
    images, maps, _, _ = world
    mask = tally.activation_mask(frames["blocks"], frames["thresholds"], frames["images"])
    got = {(r.img, r.unit): r.n for r in mask.groupBy("img", "unit").agg(F.count("*").alias("n")).collect()}
    want = {}
    for (i, u), m in maps.items():
        n = 0 if np.isnan(m).any() else int((enlarge(m, *images[i]) > THRESHOLDS[u]).sum())
        if n:
            want[i, u] = n
    assert got == want


def test_scores_and_records(spark, frames, sums, expected):
    both, _, cats, labels = expected
    scores = tally.iou(sums, frames["labelcat"])
    want = {}
    for u, l in zip(*np.nonzero(both)):
        want[u, l] = both[u, l] / (cats[u, LABELCAT[l]] + labels[l] - both[u, l] + 1e-10)
    got = {(r.unit, r.label): r.iou for r in scores.collect() if r.both}
    assert got.keys() == want.keys()
    for key in got:
        assert got[key] == pytest.approx(want[key], rel=1e-12) and 0 <= got[key] <= 1

    best = tally.best_labels(scores, frames["thresholds"], sums, 3).cache()
    assert best.count() == UNITS * 3
    for r in best.collect():
        mine = {l: s for (u, l), s in want.items() if u == r.unit and LABELCAT[l] == r.cat_idx and s > 0}
        if not mine:
            assert (r.label, r.iou, r.truth, r.intersect) == (0, 0.0, 0, 0)
            assert r.activation == cats[r.unit, 2]
        else:
            top = max(mine.values())
            assert r.iou == pytest.approx(top) and r.label == min(l for l, s in mine.items() if s == pytest.approx(top, rel=1e-12))
    names = spark.createDataFrame([(l, f"n{l}") for l in LABELCAT], "label int, name string")
    records = {r.unit: r for r in tally.tally_records(best, CATS, names).collect()}
    assert set(records) == set(range(1, UNITS + 1))
    silent = records[UNITS]
    # no score anywhere: the highest category index wins the tie, with label 0
    assert (silent.category, silent.label, silent.score) == ("scene", "", 0.0)
    order = tally.unit_order(tally.best_category(best).select("unit", "score"))
    ordered = [r.unit for r in order.orderBy("position").collect()]
    assert ordered == sorted(range(UNITS), key=lambda u: (-records[u + 1].score, u))


def test_equal_scores_break_to_lowest_label_and_highest_category(spark):
    scores = spark.createDataFrame(
        [(0, 2, 0, 4, 10, 10, 0.25), (0, 1, 0, 4, 10, 10, 0.25), (0, 5, 1, 4, 10, 10, 0.25)],
        "unit int, label int, cat_idx int, both long, activation long, truth long, iou double",
    )
    sums = spark.createDataFrame([(0, "cat", 0, 10), (0, "cat", 1, 10)], "unit int, kind string, key int, amount long")
    best = tally.best_labels(scores, spark.createDataFrame([(0,)], "unit int"), sums, 2)
    assert {(r.cat_idx, r.label) for r in best.collect()} == {(0, 1), (1, 5)}
    assert tally.best_category(best).first().cat_idx == 1


def test_dissect_end_to_end(spark, frames):
    names = spark.createDataFrame([(l, f"n{l}") for l in LABELCAT], "label int, name string")
    inputs = {k: v for k, v in frames.items() if k != "thresholds"}
    done = dissect(inputs.pop("blocks"), inputs["images"], inputs["channels"], inputs["scalars"], inputs["labelcat"], CATS, names, q=0.8)
    assert done.records.count() == UNITS
    assert done.thresholds.count() == UNITS


def test_report_order(spark):
    records = spark.createDataFrame(
        [
            (1, "scene", "a", 0.10, 0),
            (2, "object", "b", 0.20, 1),
            (3, "object", "c", 0.30, 2),
            (4, "object", "b", 0.05, 3),
            (5, "weird", "d", 0.90, 4),
            (6, "object", "c", 0.01, 5),
            (7, "scene", "b", 0.07, 6),
        ],
        "unit int, category string, label string, score double, position int",
    )
    histogram = {r.label: (r.n_units, r.best_score, r.category) for r in rank.label_histogram(records).collect()}
    assert histogram == {"a": (1, 0.10, "scene"), "b": (3, 0.20, "object"), "c": (1, 0.30, "object"), "d": (1, 0.90, "weird")}
    rendered = rank.rendered_order(records)
    assert [r.unit for r in rendered.orderBy("rendered_pos").collect()] == [2, 7, 4, 3, 1, 5, 6]
    ranked = rank.score_rank(rendered)
    assert [r.unit for r in ranked.orderBy("score_order").collect()] == [5, 3, 2, 1, 7, 4, 6]
    summary = rank.coverage_summary(records).first()
    assert (summary.units_over, summary.units, summary.concepts) == (6, 7, 4)
    assert rank.limit_records(rendered, 2).count() == 2
