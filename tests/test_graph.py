"""Graphs against plain Python on small inputs."""

from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitscope.operators import graph
from unitscope.operators.links import turns
from unitscope.session import checkpoint_dir


def _edge_dict(edges):
    return {(r.src, r.dst): r.weight for r in edges.collect()}


def _coactive(rows):
    items = {}
    for i, u in rows:
        items.setdefault(i, set()).add(u)
    out = {}
    for units in items.values():
        for a, b in combinations(sorted(units), 2):
            out[a, b] = out.get((a, b), 0) + 1
    return out


@pytest.mark.parametrize("spread_by", [1, 1000])
def test_coactivation_both_ways(spark, spread_by):
    """Dense matrix for a narrow range of units, join for a wide one; one item is hot."""
    rng = np.random.default_rng(1)
    rows = [(int(i), int(u) * spread_by) for i, u in zip(rng.integers(0, 40, 300), rng.integers(3, 30, 300))]
    rows += [(7, u * spread_by) for u in range(3, 30)] + [(99, 4 * spread_by)]
    df = spark.createDataFrame(rows, "img int, unit int")
    assert _edge_dict(graph.coactivation_edges(df)) == _coactive(rows)


def test_items_with_many_units_go_through_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(u) * 1000) for i, u in zip(rng.integers(0, 40, 300), rng.integers(3, 30, 300))]
    rows += [(i, u * 1000) for i in (7, 8) for u in range(3, 30)]
    df = spark.createDataFrame(sorted(set(rows)), "_i long, _u long")
    assert _edge_dict(graph._wide_edges(df, few=12)) == _coactive(rows)


def test_no_active_units(spark):
    assert graph.coactivation_edges(spark.createDataFrame([], "img int, unit int")).count() == 0


def test_weight_matrix(spark):
    edges = spark.createDataFrame([(0, 2, 5), (1, 2, 3)], "src long, dst long, weight long")
    units = spark.range(4).withColumnRenamed("id", "unit")
    rows = {r.src: r.row for r in graph.weight_matrix(edges, units).collect()}
    assert rows == {0: [0, 0, 5, 0], 1: [0, 0, 3, 0], 2: [0, 0, 0, 0], 3: [0, 0, 0, 0]}


def _communities(edges, k):
    nodes = sorted({n for e in edges for n in e})
    linked = set(edges)
    cliques = [set(c) for c in combinations(nodes, k) if all(p in linked for p in combinations(c, 2))]
    groups = []
    for clique in cliques:
        touching = [g for g in groups if any(len(clique & c) >= k - 1 for c in g)]
        groups = [g for g in groups if g not in touching] + [sum(touching, []) + [clique]]
    return sorted(sorted(set().union(*g)) for g in groups)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_clique_communities(spark, k):
    rng = np.random.default_rng(5)
    pairs = [(a, b) for a, b in combinations(range(14), 2) if rng.random() < 0.35]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    found = {}
    for r in graph.k_clique_communities(edges, k).collect():
        found.setdefault(r.community, []).append(r.unit)
    assert sorted(sorted(v) for v in found.values()) == _communities(pairs, k)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100


def _modularity(edges, of):
    m = sum(edges.values())
    out = 0.0
    for c in set(of.values()):
        inside = sum(w for (a, b), w in edges.items() if of[a] == of[b] == c)
        deg = sum(w * ((of[a] == c) + (of[b] == c)) for (a, b), w in edges.items())
        out += inside / m - (deg / (2 * m)) ** 2
    return out


def test_multilevel_communities_find_planted_groups(spark):
    rng = np.random.default_rng(2)
    edges = {}
    for a, b in combinations(range(24), 2):
        same = a // 8 == b // 8
        if rng.random() < (0.9 if same else 0.08):
            edges[a, b] = int(rng.integers(1, 4))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight long")
    out = graph.multilevel_communities(df)
    of = {r.unit: r.community for r in out.collect()}
    assert len({of[i] for i in range(8)}) == len({of[i] for i in range(8, 16)}) == 1
    assert len(set(of.values())) == 3
    score = graph.modularity(df, out).first().modularity
    assert score == pytest.approx(_modularity(edges, of))
    assert score > 0.4


def test_modularity_counts_loops_twice(spark):
    df = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (1, 1, 2)], "src long, dst long, weight long")
    apart = spark.createDataFrame([(0, 0), (1, 1)], "unit long, community long")
    assert graph.modularity(df, apart).first().modularity == pytest.approx(4 / 5 - 2 * (5 / 10) ** 2)


def test_long_ids_stay_apart(spark):
    """Two triangles whose ids share their first twelve digits."""
    first = 10**13
    rows = [(first + a + g, first + b + g, 1.0) for g in (0, 3) for a, b in ((0, 1), (0, 2), (1, 2))]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    found = graph.k_clique_communities(edges, 3).collect()
    assert len({r["community"] for r in found}) == 2 and len(found) == 6


def test_communities_of_separate_cliques(spark):
    """Without a limit on passes, cliques joined by one edge each are the communities."""
    rows = [(8 * g + a, 8 * g + b, 1.0) for g in range(12) for a in range(8) for b in range(a + 1, 8)]
    rows += [(8 * g, 8 * g + 8, 0.1) for g in range(11)]
    found = graph.multilevel_communities(spark.createDataFrame(rows, "src long, dst long, weight double"))
    assert {(r["unit"], r["community"]) for r in found.collect()} == {(u, u // 8 * 8) for u in range(96)}


def test_hubs_are_not_expanded(spark):
    """A star has no two edges that leave one node upward, and cliques equal a plain search."""
    star = spark.createDataFrame([(0, i, 1) for i in range(1, 400)], "src long, dst long, weight long")
    up = graph.upward(star)
    assert up.groupBy("low").count().agg(F.max("count")).first()[0] == 1 and up.count() == 399
    rng = np.random.default_rng(4)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 30, (160, 2)) if a != b} | {(0, i) for i in range(1, 30)}
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    linked = {frozenset(p) for p in pairs}
    for k in (3, 4):
        want = {c for c in combinations(range(30), k) if all(frozenset(p) in linked for p in combinations(c, 2))}
        got = [tuple(r) for r in graph.cliques(edges, k).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert graph.cliques(star.limit(0), 3).count() == 0


@pytest.mark.parametrize("held,listed", [(10**6, 10**6), (9, 12)])
def test_triangles_in_stripes_shuffle_no_pairs(spark, monkeypatch, held, listed):
    """Stripes of edges and groups of lists find every triangle once; no join forms pairs."""
    rng = np.random.default_rng(8)
    pairs = sorted({(a, b) for a, b in combinations(range(0, 180, 10), 2) if rng.random() < 0.4} | {(0, b) for b in range(10, 180, 10)})
    monkeypatch.setattr(graph, "HELD_EDGES", held)
    monkeypatch.setattr(graph, "LISTED_NODES", listed)
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    found = graph.cliques(edges, 3)
    nodes = sorted({n for e in pairs for n in e})
    assert sorted(map(tuple, found.collect())) == [t for t in combinations(nodes, 3) if all(p in set(pairs) for p in combinations(t, 2))]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_wide_edges_group_a_bounded_number_of_rows(spark, monkeypatch):
    """Partitions follow from units and pairs; null items and units have no edges."""
    monkeypatch.setattr(graph, "TASK_ROWS", 20)
    rng = np.random.default_rng(2)
    rows = sorted({(int(i), int(u) * 1000) for i, u in zip(rng.integers(0, 30, 200), rng.integers(0, 25, 200))})
    df = spark.createDataFrame([*rows, (None, 5), (None, 6), (3, None), (4, None)], "_i long, _u long")
    edges = graph._wide_edges(df)
    want = _coactive(rows)
    assert _edge_dict(edges) == want
    assert edges.rdd.getNumPartitions() >= sum(want.values()) // 20


def test_nations_are_whole_communities(spark, tmp_path):
    """Twelve linked suppliers are one community, not runs of eight."""
    from checks import QUERIES, SQL, load_all

    load_all()
    rows = [(i, 1 if i < 12 else 2) for i in range(15)] + [(99, 3)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    found = {(r.unit, r.community) for r in QUERIES["k6_communities_of_nations"](spark, str(tmp_path)).collect()}
    assert found == {(i, 0) for i in range(12)} | {(i, 12) for i in range(12, 15)}
    assert "// 8" not in SQL["k6_communities_of_nations"]


def test_cliques_leave_their_edges_and_lists(spark):
    """Of the tables that edges pass through on their way to triangles, the last two stay."""
    edges = spark.createDataFrame([(i, j, 1) for i in range(8) for j in range(i + 1, 8) if (i + j) % 3], "src long, dst long, weight long")
    tables = lambda: {f.parent for f in Path(checkpoint_dir(spark).removeprefix("file:")).glob("unitscope/*/**/*.parquet")}
    before = tables()
    found = graph.cliques(edges, 3)
    assert len(tables() - before) == 2
    ends = {(i, j) for i, j, _ in edges.collect()}
    assert {tuple(r) for r in found.collect()} == {
        (i, j, k) for i, j in ends for k in range(j + 1, 8) if {(i, k), (j, k)} <= ends
    }


def test_held_and_joined_communities_agree(spark, monkeypatch):
    """Packed links of whole nodes give what joins of links give: loops, repeated and turned edges, long and negative ids."""
    rng = np.random.default_rng(7)
    ids = np.concatenate([rng.integers(-(10**15), 10**15, 30), [0, 1]])
    rows = [(int(ids[a]), int(ids[b]), float(w)) for a, b, w in rng.integers(0, [32, 32, 5], (160, 3))]
    rows += [(int(ids[a]), int(ids[b]), 4.0) for g in range(0, 30, 6) for a, b in combinations(range(g, g + 6), 2)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    joined = lambda: {(r["unit"], r["community"]) for r in graph.multilevel_communities(edges).collect()}
    held = graph._held_communities(edges)
    assert "Join" not in held._jdf.queryExecution().toString()
    got = {(r["unit"], r["community"]) for r in held.collect()}
    monkeypatch.setattr(graph, "HELD_NODES", 0)
    assert got == joined()
    monkeypatch.setattr(graph, "HELD_NODES", 100)
    monkeypatch.setattr(graph, "HELD_LINKS", 50)
    assert got == joined()


def test_turns_are_those_of_spark(spark):
    nodes = [0, 1, -5, 10**17, 360_000]
    frame = spark.createDataFrame([(n,) for n in nodes], "node long")
    for step in (0, 3, 40):
        want = [r[0] for r in frame.select(F.xxhash64("node", F.lit(step))).collect()]
        assert turns(np.array(nodes), step).tolist() == want
