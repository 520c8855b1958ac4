"""Co-activation graph of the units and its communities.

Edges are ``(src, dst, weight)`` with ``src < dst``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitscope.operators.algebra import kept, multiply_tiled, stripe, stripe_bounds
from unitscope.operators.layout import bounded, global_index
from unitscope.operators.links import both_ways, contracted, moves, packed, turns, whole_nodes
from unitscope.operators.links import degrees as packed_degrees
from unitscope.operators.products import closed_pairs
from unitscope.session import cut, discard, release, scratch

#: Widest unit range counted as a dense matrix per task (a few dozen MB).
DENSE_UNITS = 2048
#: Units up to which the pairs of one item are listed.
FEW_UNITS = 512
#: Rows that a task is meant to group.
TASK_ROWS = 1_000_000

_EDGE = "src long, dst long, weight long"


def coactivation_edges(active: DataFrame, item: str = "img", unit: str = "unit") -> DataFrame:
    """Number of items on which both units are active, from rows ``(item, unit)``.

    Up to ``DENSE_UNITS`` units, every task multiplies its 0/1 item × unit matrix with
    itself and emits each pair once, so no pair of an item is ever shuffled. In a wider
    range, the pairs of items with few units are listed, and items with many are
    counted as a product of tiles; an item that is active almost everywhere is never
    expanded pair by pair.
    """
    rows = active.select(F.col(item).alias("_i"), F.col(unit).cast("long").alias("_u")).distinct()
    low, high = rows.agg(F.min("_u"), F.max("_u")).first()
    if low is None or high - low + 1 <= DENSE_UNITS:
        return _dense_edges(rows, low or 0, 0 if low is None else high - low + 1)
    return _wide_edges(rows)


def _wide_edges(rows: DataFrame, few: int = FEW_UNITS) -> DataFrame:
    rows = kept(rows)
    sizes = rows.groupBy("_i").agg(F.count("*").alias("_n"))
    many = cut(sizes.where(F.col("_n") > few).select("_i"))
    none = many.isEmpty()
    small = rows if none else rows.join(bounded(many), "_i", "left_anti")
    known = small.where(F.col("_i").isNotNull() & F.col("_u").isNotNull())
    listed, pairs = known.groupBy("_i").agg(F.count("*").alias("_n")).agg(
        F.sum("_n"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2)
    ).first()
    # an item's list holds few units; the numbers of partitions follow from units and pairs, not from the session
    lists = known.repartition(_parts(listed), "_i").groupBy("_i").agg(F.sort_array(F.collect_list("_u")).alias("_l"))
    met = lists.select(
        F.posexplode("_l").alias("_at", "src"), "_l"
    ).select("src", F.explode(F.slice("_l", F.col("_at") + 2, F.size("_l"))).alias("dst"))
    counts = met.repartition(_parts(pairs), "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    if none:
        return counts
    # dense numbers for the items and units at hand keep the tiles well filled
    big = rows.join(global_index(many, ["_i"], "_row").select("_i", "_row"), "_i").select("_row", "_u")
    units = cut(global_index(big.select("_u").distinct(), ["_u"], "_col"))
    big = cut(big.join(bounded(units), "_u").select("_row", "_col"))
    one = F.lit(1.0).alias("value")
    product = multiply_tiled(
        big.select(F.col("_col").alias("id_3"), F.col("_row").alias("id_4"), one),
        big.select(F.col("_row").alias("id_3"), F.col("_col").alias("id_4"), one),
    ).where(F.col("id_3") < F.col("id_4"))
    # units are numbered in order, so src stays below dst
    src = units.select(F.col("_col").alias("id_3"), F.col("_u").alias("src"))
    dst = units.select(F.col("_col").alias("id_4"), F.col("_u").alias("dst"))
    heavy = product.join(bounded(src), "id_3").join(bounded(dst), "id_4").select(
        "src", "dst", F.round("value").cast("long").alias("weight")
    )
    return counts.unionByName(heavy).repartition(_parts(pairs), "src", "dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _parts(rows: float | None) -> int:
    """Partitions of about ``TASK_ROWS`` rows."""
    return max(1, -(-int(rows or 0) // TASK_ROWS))


def _dense_edges(rows: DataFrame, low: int, width: int) -> DataFrame:
    # a list never exceeds the width checked by the caller
    sets = rows.groupBy("_i").agg(F.collect_list((F.col("_u") - low).cast("int")).alias("_units"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            lists = batch["_units"].to_list()
            for start in range(0, len(lists), 4096):
                part = lists[start : start + 4096]
                hot = np.zeros((len(part), width), dtype=np.float32)
                hot[np.repeat(np.arange(len(part)), [len(u) for u in part]), np.concatenate(part)] = 1
                total += hot.T @ hot
        src, dst = np.nonzero(np.triu(total, 1))
        yield pd.DataFrame(
            {"src": src + low, "dst": dst + low, "weight": total[src, dst].astype("int64")}
        )

    partial = sets.select("_units").mapInPandas(count, _EDGE)
    return partial.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def weight_matrix(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Rows ``(src, row array<double>)`` of the upper-triangular matrix, zeros filled in.

    ``units`` lists all units; a row is as long as the largest unit number plus one.
    """
    width = units.agg((F.max("unit") + 1).cast("int")).scalar()
    rows = edges.groupBy("src").agg(
        F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("_m")
    )
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1).cast("long")),
        lambda j: F.coalesce(F.try_element_at("_m", j), F.lit(0)).cast("double"),
    )
    return (
        units.select(F.col("unit").cast("long").alias("src"))
        .withColumn("_n", width)
        .join(rows, "src", "left")
        .select("src", F.coalesce(cells, F.array_repeat(F.lit(0.0), F.col("_n"))).alias("row"))
    )


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return edges.select(F.inline(ends), "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """Number and total weight of the edges of every unit."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("unit"), "weight")
    return ends.groupBy("unit").agg(
        F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree")
    )


#: Halvings of the nodes that may move in a pass, before a pass moves the best one alone.
MOST_IDLE = 6


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node, ``(node, component)``, from links ``(a, b)``.

    Every round takes the smallest label among the neighbours and then jumps to that
    label's own label, so long chains shrink quickly. Labels are checkpointed per round.
    """
    pairs = cut(
        links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        .distinct()
    )
    labels = cut(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select(
        "node", F.least("node", "_m").alias("component")
    ))
    while True:  # every round lowers a label, so this ends
        near = (
            pairs.join(labels, pairs["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("component").alias("_near"))
        )
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", "component", F.least("component", "_near").alias("_low")
        )
        jump = labels.select(F.col("node").alias("_low"), F.col("component").alias("_far"))
        moved = cut(
            lower.join(jump, "_low").select(
                "node", F.least("_low", "_far").alias("component"), F.col("component").alias("_old")
            )
        )
        labels = moved.select("node", "component")
        if moved.where(F.col("component") != F.col("_old")).isEmpty():
            return labels


def upward(edges: DataFrame) -> DataFrame:
    """Every edge once as ``(low, high)``, from the node of fewer edges to that of more (then by number).

    No node has more than the square root of twice the number of edges above it, however many
    it has in all: the centre of a star has none. The result is a table; edges come to their ends' numbers
    of edges one end at a time, so that only one shuffle of them is on disk.
    """
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "upward")
    edges = kept(edges.select("src", "dst"), f"{path}/edges")
    pairs = edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = kept(pairs, f"{path}/pairs")
    discard(spark, f"{path}/edges")
    sizes = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    sizes = bounded(cut(sizes))
    release(spark)
    half = kept(pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("_na")), "a"), f"{path}/half")
    discard(spark, f"{path}/pairs")
    placed = half.join(sizes.select(F.col("node").alias("b"), F.col("n").alias("_nb")), "b")
    # a is the smaller number, so it is the lower one where both have as many edges
    up = F.col("_na") <= F.col("_nb")
    out = kept(placed.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high")))
    discard(spark, path)
    return out


#: Edges that a task of the search for triangles looks up, and nodes in the lists that it is given.
HELD_EDGES, LISTED_NODES = 4_000_000, 8_000_000


def _triangles(pair: DataFrame) -> DataFrame:
    """``(n_1, n_2, n_3)`` with edges ``n_1 → n_2``, ``n_1 → n_3`` and ``n_2 → n_3``, from the edges ``(n_1, n_2)``.

    Nodes are dealt by stripes with the lists of nodes above them. A list also goes to the stripes
    in which one of its nodes lies; there its pairs are formed and looked up, so pairs are never
    shuffled.
    """
    edges = pair.count()
    bounds = stripe_bounds(pair, "n_1", max(1, -(-edges // HELD_EDGES)))
    lists = kept(pair.repartition(_parts(edges), "n_1").groupBy(F.col("n_1").alias("node")).agg(F.collect_list("n_2").alias("above")))
    own = lists.withColumn("_own", F.lit(True)).withColumn("_b", stripe(F.col("node"), bounds))
    to = F.array_distinct(F.transform("above", lambda n: stripe(n, bounds))) if bounds else F.array(F.lit(0))
    sent = lists.withColumn("_to", to)
    nodes = sent.agg(F.sum(F.size("above").cast("long") * F.size("_to"))).first()[0] or 0
    groups = max(1, -(-nodes // (LISTED_NODES * (len(bounds) + 1))))
    sent = sent.withColumn("_own", F.lit(False)).withColumn("_b", F.explode("_to")).withColumn("_g", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int"))
    own = own.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = [(F.col("_b") * groups + F.col("_g")).cast("int").alias("_t"), "_own", "node", "above"]
    dealt = own.select(*columns).unionAll(sent.select(*columns)).repartitionById((len(bounds) + 1) * groups, "_t")
    return dealt.drop("_t").mapInArrow(closed_pairs, "n_1 long, n_2 long, n_3 long")


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """All cliques of ``k`` nodes, as columns ``n_1 < … < n_k``.

    A clique is found from its lowest node in the order of ``upward``, so hubs are joined to, never
    expanded.
    """
    pair = upward(edges).select(F.col("low").cast("long").alias("n_1"), F.col("high").cast("long").alias("n_2"))
    out = pair if k < 3 else _triangles(pair)
    for size in range(4, k + 1):
        new = f"n_{size}"
        step = pair.select(F.col("n_1").alias("n_1"), F.col("n_2").alias(new))
        out = out.join(step, "n_1")
        for j in range(2, size):
            link = pair.select(F.col("n_1").alias(f"n_{j}"), F.col("n_2").alias(new))
            out = out.join(link, [f"n_{j}", new], "left_semi")
    ordered = out.select(F.array_sort(F.array(*[f"n_{i}" for i in range(1, k + 1)])).alias("_n"))
    return ordered.select(*[F.get("_n", F.lit(i - 1)).alias(f"n_{i}") for i in range(1, k + 1)])


def _padded(node):
    """A node's number in at least 12 digits; a longer one keeps all of them."""
    text = node.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(12)), F.lit("0"))


def k_clique_communities(edges: DataFrame, k: int = 5) -> DataFrame:
    """Communities ``(community, unit)`` of cliques of size ``k`` linked by ``k - 1``
    shared nodes. A unit may be in several. A community is named by its smallest clique
    face, written ``n-n-…``; faces of one clique form a chain of links.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    found = cut(cliques(edges, k).select(F.array(*[f"n_{i}" for i in range(1, k + 1)]).alias("_c")))
    faces = F.array(
        *[
            F.array(*[F.get("_c", F.lit(i)) for i in face])
            for face in combinations(range(k), k - 1)
        ]
    )
    text = F.transform(faces, lambda f: F.concat_ws("-", F.transform(f, lambda n: _padded(n))))
    chained = found.select("_c", text.alias("_f"))
    links = chained.select(
        F.explode(
            F.transform(
                F.slice("_f", 2, k - 1), lambda f: F.struct(F.get("_f", F.lit(0)).alias("a"), f.alias("b"))
            )
        ).alias("_l")
    ).select("_l.a", "_l.b")
    component = connected_components(links)
    named = chained.select("_c", F.get("_f", F.lit(0)).alias("node")).join(component, "node")
    return named.select(F.col("component").alias("community"), F.explode("_c").alias("unit")).distinct()


def community_groups(membership: DataFrame, names: DataFrame) -> DataFrame:
    """Size and units of every community, in unit order, with their labels."""
    listed = F.array_sort(F.collect_list(F.struct("unit", "label")))
    return (
        membership.join(bounded(names.select("unit", "label")), "unit")
        .groupBy("community")
        .agg(listed.alias("_m"), F.count("*").alias("size"))
        .select(
            "community",
            "size",
            F.transform("_m", lambda r: r["unit"]).alias("units"),
            F.transform("_m", lambda r: r["label"]).alias("labels"),
        )
    )


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Weighted modularity of a partition ``(unit, community)``, one row."""
    of = membership.select(F.col("unit").alias("src"), F.col("community").alias("_cs"))
    to = membership.select(F.col("unit").alias("dst"), F.col("community").alias("_cd"))
    placed = edges.join(of, "src").join(to, "dst")
    # every edge adds its weight inside its community, and to the degree of both ends
    parts = placed.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("_cs").alias("c"),
                    F.when(F.col("_cs") == F.col("_cd"), F.col("weight")).otherwise(0).alias("inside"),
                    F.col("weight").alias("deg"),
                ),
                F.struct(F.col("_cd").alias("c"), F.lit(0).cast("long").alias("inside"), F.col("weight").alias("deg")),
            )
        )
    )
    per = parts.groupBy("c").agg(F.sum("inside").alias("inside"), F.sum("deg").alias("deg"))
    total = F.col("_m")
    # deg sums to twice the total weight
    return per.agg(
        (F.sum("deg") / 2).alias("_m"),
        F.sum("inside").alias("_in"),
        F.sum(F.col("deg").cast("double") * F.col("deg")).alias("_sq"),
    ).select((F.col("_in") / total - F.col("_sq") / (4 * total * total)).alias("modularity"))


def multilevel_communities(edges: DataFrame) -> DataFrame:
    """Modularity communities ``(unit, community)`` by local moving and contraction.

    In every pass each node of one half (drawn anew by a digest of node and pass) moves
    to the neighbouring community with the largest gain, smallest community on ties; the
    other half stays, so neighbours do not swap for ever. A pass that does not raise the
    modularity is undone, and the next one moves half as many nodes, down to the best one alone. Passes
    end when no node gains by a move, or the best move changes the modularity by less than 1e-9. Settled communities become the nodes of the next level.

    Up to ``HELD_NODES`` nodes, every task of a pass holds the placement and reads the packed links of
    whole nodes, so that no pass shuffles links. Beyond, and with nulls, links are joined to the placement.
    """
    kinds = {f.name: f.dataType for f in edges.schema}
    if kinds["src"] == kinds["dst"] == T.LongType():
        found = _held_communities(edges)
        if found is not None:
            return found
    ends = symmetric(edges).select("src").distinct().withColumnRenamed("src", "unit")
    membership = cut(ends.select("unit", F.col("unit").alias("community")))
    level = kept(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    total = level.agg(F.sum("weight")).first()[0]
    if not total:
        return membership
    best = _score(level, membership.toDF("node", "comm"), total)
    while True:
        placed = _local_moves(level, total)
        if placed is None:
            break
        placed, score = placed
        if score <= best + 1e-9:
            break
        best = score
        membership = cut(
            membership.join(placed, membership["community"] == placed["node"]).select(
                "unit", F.col("comm").alias("community")
            )
        )
        a = placed.toDF("src", "_a")
        b = placed.toDF("dst", "_b")
        level = cut(
            level.join(a, "src")
            .join(b, "dst")
            .select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "weight")
            .groupBy("src", "dst")
            .agg(F.sum("weight").alias("weight"))
        )
    smallest = membership.groupBy("community").agg(F.min("unit").alias("_name"))
    return membership.join(smallest, "community").select("unit", F.col("_name").alias("community"))


#: Nodes whose communities every task of a pass may hold (a few dozen MB), and links that a task gathers.
HELD_NODES, HELD_LINKS = 1_000_000, 2_000_000


def _held_communities(edges: DataFrame) -> DataFrame | None:
    """As ``multilevel_communities``, for few nodes; None if there are too many, no weight, or nulls."""
    spark = edges.sparkSession
    best = community = units = None
    while True:
        path = scratch(spark, "communities")
        level = _held_level(edges, path)
        if level is None:
            return None  # contracted levels have fewer nodes, no nulls and the same weight
        nodes, links, deg, loop, total = level
        if units is None:
            units, community = nodes, np.arange(len(nodes))
        comm, start, score = _held_moves(links, nodes, deg, loop, total)
        best = start if best is None else best
        if score <= max(start, best) + 1e-9:
            break
        best = score
        # a community keeps the id of a node as its own; its number is its place among them
        named, number = np.unique(comm, return_inverse=True)
        ids, community = nodes[named], number[community]
        held = spark.sparkContext.broadcast((number, ids))

        def contract(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            yield from contracted(batches, *held.value)

        own = spark.createDataFrame(pd.DataFrame({"src": ids, "dst": ids, "weight": np.bincount(number, loop, len(named))}), _WEIGHTED)
        edges = cut(links.mapInArrow(contract, _WEIGHTED).unionAll(own).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
        discard(spark, path)
    discard(spark, path)
    low = np.full(len(units), np.iinfo(np.int64).max)
    np.minimum.at(low, community, units)
    return spark.createDataFrame(pd.DataFrame({"unit": units, "community": low[community]}), "unit long, community long")


_WEIGHTED = "src long, dst long, weight double"


def _held_level(edges: DataFrame, path: str):
    """Nodes in order, packed links of their numbers, degrees, loops and the total weight; or None."""
    spark = edges.sparkSession
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    stored = kept(rows.mapInArrow(packed, "n long, cells binary"), f"{path}/edges")
    size, odd = stored.agg(F.sum("n"), F.count_if(F.col("cells").isNull())).first()
    if odd or not size:
        discard(spark, path)
        return None
    degree = cut(stored.select("cells").mapInArrow(packed_degrees, "node long, deg double, loop double").groupBy("node").agg(F.sum("deg").alias("deg"), F.sum("loop").alias("loop")))
    found = degree.toPandas().sort_values("node") if degree.count() <= HELD_NODES else None
    total = None if found is None else float(found["deg"].sum()) / 2
    if not total:
        discard(spark, path)
        return None
    nodes = found["node"].to_numpy()
    tasks, known = max(1, -(-2 * size // HELD_LINKS)), spark.sparkContext.broadcast(nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from both_ways(batches, known.value, tasks)

    dealt = stored.select("cells").mapInArrow(deal, "_t int, cells binary").repartitionById(tasks, "_t").select("cells")
    links = kept(dealt.mapInArrow(whole_nodes, "cells binary"), f"{path}/links")
    del dealt
    discard(spark, f"{path}/edges")
    return nodes, links, found["deg"].to_numpy(), found["loop"].to_numpy(), total


def _held_moves(links: DataFrame, nodes: np.ndarray, deg: np.ndarray, loop: np.ndarray, total: float):
    """The community of every node by their numbers, the modularity of single nodes and that of the communities."""
    spark = links.sparkSession

    def survey(comm: np.ndarray):
        """Modularity of a placement, and the nodes that gain by a move."""
        tot = np.bincount(comm, deg, len(nodes))
        held = spark.sparkContext.broadcast((comm, tot, deg))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from moves(batches, *held.value, total)

        out = links.mapInArrow(run, "node long, best long, gain double, inside double").toPandas()
        held.destroy()
        inside = out["inside"].sum() / 2 + loop.sum()
        return float(inside / total - (tot * tot).sum() / (4 * total * total)), out[out["node"] >= 0].sort_values("node")

    comm = np.arange(len(nodes))
    score, gainers = survey(comm)
    start, idle = score, 0
    for step in count():
        if gainers.empty:
            break
        node, to = gainers["node"].to_numpy(), gainers["best"].to_numpy()
        if idle < MOST_IDLE:
            turn = turns(nodes[node], step) % (2 << idle) == 0
        else:  # only the node that gains most
            turn = np.arange(len(node)) == gainers["gain"].to_numpy().argmax()
        moved = comm.copy()
        moved[node[turn]] = to[turn]
        new, then = survey(moved)
        if new > score + 1e-9:
            comm, score, gainers, idle = moved, new, then, 0
        else:
            if idle == MOST_IDLE:  # the best single move changes it by less than can be told
                break
            idle += 1
    return comm, start, score


def _degree(level: DataFrame) -> DataFrame:
    """Weighted degree of every node; a loop counts twice."""
    ends = level.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.sum("weight").alias("deg"))


def _score(level: DataFrame, placed: DataFrame, total: float) -> float:
    out = modularity(level, placed.toDF("unit", "community")).first()[0]
    return float(out)


def _local_moves(level: DataFrame, total: float):
    """Placement ``(node, comm)`` and its modularity, or None if no move helps."""
    degree = cut(_degree(level))
    placed = cut(degree.select("node", F.col("node").alias("comm")))
    score = _score(level, placed, total)
    start, idle = score, 0
    links = kept(symmetric(level.where(F.col("src") != F.col("dst"))).toDF("node", "other", "weight"))
    for step in count():
        sizes = degree.join(placed, "node").groupBy("comm").agg(F.sum("deg").alias("tot"))
        near = (
            links.join(placed.toDF("other", "comm"), "other")
            .groupBy("node", "comm")
            .agg(F.sum("weight").alias("link"))
        )
        own = placed.withColumnRenamed("comm", "_own").join(degree, "node")
        # gain of community c for node i: link(i, c) - deg(i) · tot(c without i) / 2m
        options = (
            near.unionByName(placed.withColumn("link", F.lit(0.0)))
            .groupBy("node", "comm")
            .agg(F.sum("link").alias("link"))
            .join(sizes, "comm")
            .join(own, "node")
            .withColumn("_t", F.col("tot") - F.when(F.col("comm") == F.col("_own"), F.col("deg")).otherwise(0.0))
            .withColumn("gain", F.col("link") - F.col("deg") * F.col("_t") / (2 * total))
        )
        pick = options.groupBy("node", "_own").agg(
            F.max_by("comm", F.struct(F.round("gain", 9), -F.col("comm"))).alias("_best"),
            F.max(F.when(F.col("comm") == F.col("_own"), F.col("gain"))).alias("_stay"),
            F.max("gain").alias("_gain"),
        )
        gains = F.col("_gain") > F.col("_stay") + 1e-9
        pick = cut(pick)
        if pick.where(gains).isEmpty():
            break
        if idle < MOST_IDLE:
            turn = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2 << idle)) == 0
        else:  # only the node that gains most
            turn = F.col("node") == pick.select(F.max_by("node", F.struct(F.col("_gain") - F.col("_stay"), -F.col("node")))).first()[0]
        better = turn & gains
        moved = cut(
            pick.select(
                "node",
                F.when(better, F.col("_best")).otherwise(F.col("_own")).alias("comm"),
            )
        )
        new = _score(level, moved, total)
        if new > score + 1e-9:
            placed, score, idle = moved, new, 0
        else:
            if idle == MOST_IDLE:  # the best single move changes it by less than can be told
                break
            idle += 1
    return (placed, score) if score > start + 1e-9 else None
