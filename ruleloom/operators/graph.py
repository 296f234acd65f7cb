"""Neighbour graphs, their components and communities, on edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators import community
from ruleloom.operators.components import connected_components
from ruleloom.plans.durable import materialize

#: Lists that one part of a hub is in at most, and nodes of a component that one task takes.
HUB, LARGE = 2_000, 50_000
#: Nodes and edges of a community that the refinement takes as one group; larger ones are divided on edge tables.
PIECE, PIECE_EDGES = 50_000, 1_000_000


def snn_edges(neighbors: DataFrame, k: int, min_shared: int = 15, mutual: bool = False) -> DataFrame:
    """(source, target, shared, jaccard) of pairs with common out-neighbours.

    ``neighbors``: q, n, k rows for each q, none with q = n. An equi-join on
    the neighbour; neither end counts as its own neighbour. ``mutual`` keeps
    pairs in which each is a neighbour of the other. A hub, in more lists than
    HUB, is dealt into parts on both sides, so that its pairs are made by many
    tasks. What is shuffled by the source is one array of the larger ends of each
    of its neighbours' parts, not a row a pair.
    """
    hubs = neighbors.groupBy("n").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1")
    rows = neighbors.select("q", "n").join(hubs, "n", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine, every = F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = rows.select(F.col("q").alias("source"), "n", mine.alias("i"), every.alias("j"))
    b = rows.select(F.col("q").alias("target"), "n", mine.alias("j"), every.alias("i")).groupBy("n", "i", "j").agg(F.sort_array(F.collect_list("target")).alias("targets"))  # a part of a hub at most
    ends = a.join(b, ["n", "i", "j"]).select("source", F.filter("targets", lambda x: x > F.col("source")).alias("targets")).where(F.size("targets") > 0)
    pairs = ends.repartition("source").select("source", F.explode("targets").alias("target"))
    edges = pairs.groupBy("source", "target").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    if mutual:
        edges = edges.join(neighbors.select(F.col("q").alias("source"), F.col("n").alias("target")), ["source", "target"], "left_semi")
        edges = edges.join(neighbors.select(F.col("q").alias("target"), F.col("n").alias("source")), ["source", "target"], "left_semi")
    return edges.withColumn("jaccard", F.round(F.col("shared") / (2 * k - F.col("shared")), 8))


def undirected_edges(ranked: DataFrame, top: int = 3, min_score: float = 0.70, mutual: bool = True) -> DataFrame:
    """(source, target, n_directions, mean_score, min_score, max_score) from directed (q, n, score, rank).

    A direction qualifies by rank and score; the figures come from qualifying
    directions only.
    """
    good = ranked.where((F.col("rank") <= top) & (F.col("score") >= min_score) & (F.col("q") != F.col("n")))
    pairs = good.select(F.least("q", "n").alias("source"), F.greatest("q", "n").alias("target"), "score")
    out = pairs.groupBy("source", "target").agg(
        F.count("*").alias("n_directions"), F.round(F.avg("score"), 8).alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )
    return out.where("n_directions = 2") if mutual else out


def graph_nodes(nodes: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """(id, degree, weighted_degree) for every node, isolated ones with zeros."""
    ends = edges.select(F.col("source").alias("id"), weight).unionAll(edges.select(F.col("target").alias("id"), weight))
    sums = ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum(weight).alias("w"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.round(F.coalesce("w", F.lit(0.0)), 8).alias("weighted_degree"))


def component_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): isolated nodes are components of their own."""
    found = connected_components(edges.select("source", "target"))
    return nodes.select("id").join(found.withColumnRenamed("vertex", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def representatives(nodes: DataFrame, edges: DataFrame, labels: DataFrame, weight: str, order: list, most: int = 10) -> DataFrame:
    """(community, rank, id, degree, weighted_degree): the ``most`` members of each community with the highest weighted degree in the whole graph; ``order`` breaks ties."""
    rows = labels.select("id", "community").join(graph_nodes(nodes, edges, weight), "id")
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weighted_degree"), *order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("community", "rank", "id", "degree", "weighted_degree")  # ranked inside the tasks first


def graph_summary(nodes: DataFrame, edges: DataFrame, components: DataFrame, labels: DataFrame, weight: str, resolution: float = 1.0) -> DataFrame:
    """One row: nodes, edges, components, their largest and the single ones; communities, their largest and single ones; modularity; least and greatest weight."""
    sizes = lambda rows, c, name: rows.groupBy(c).agg(F.count("*").alias("n")).agg(F.count("*").alias(name), F.max("n").alias(f"largest_{name}"), F.count_if(F.col("n") == 1).alias(f"single_{name}"))
    row = nodes.agg(F.count("*").alias("nodes"))
    for one in (edges.agg(F.count("*").alias("edges"), F.min(weight).alias("min_weight"), F.max(weight).alias("max_weight")), sizes(components, "component", "components"), sizes(labels, "community", "communities"), modularity(edges, labels, weight, resolution)):
        row = row.join(F.broadcast(one))  # a row each
    return row


def component_export(labels: DataFrame, edges: DataFrame, weight: str, largest: int = 25) -> DataFrame:
    """(component, size, n_edges, density, total_weight, oversize, rank) of components with two nodes or more.

    Ranked by size, then the smallest member; an oversize component is reported, never cut.
    """
    size = labels.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    inner = edges.join(labels.withColumnRenamed("id", "source"), "source").groupBy("component").agg(F.count("*").alias("n_edges"), F.round(F.sum(weight), 8).alias("total_weight"))
    out = size.join(inner, "component", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    out = out.withColumn("density", F.round(2 * F.col("n_edges") / (F.col("size") * (F.col("size") - 1)), 6)).withColumn("oversize", F.col("size") > largest)
    return numbered(out, [F.desc("size"), F.col("component")], "rank", 1)


def numbered(rows: DataFrame, order: list, name: str, start: int = 0, parts: int | None = None) -> DataFrame:
    """A dense number over the whole table by range partitions: ranks inside each, offset by the rows before.

    Rows are dealt by range into ``parts``, the session's shuffle partitions if
    not given, so no task sorts the table.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt, "numbered")
    before = dealt.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_r", inside).join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_r") - 1 + start).cast("long")).drop("_p", "_n", "_before", "_r")


def modularity(edges: DataFrame, labels: DataFrame, weight: str, resolution: float = 1.0) -> DataFrame:
    """One row (modularity): sum over communities of inside / 2m - resolution (total / 2m)^2."""
    e = edges.join(labels.select(F.col("id").alias("source"), F.col("community").alias("a")), "source").join(labels.select(F.col("id").alias("target"), F.col("community").alias("b")), "target")
    ends = e.select(F.col("a").alias("c"), F.when(F.col("a") == F.col("b"), 2 * F.col(weight)).otherwise(0.0).alias("inside"), weight).unionAll(e.select(F.col("b").alias("c"), F.lit(0.0).alias("inside"), weight))
    per = ends.groupBy("c").agg(F.sum("inside").alias("inside"), F.sum(weight).alias("total"))
    m2 = F.sum("total")
    return per.agg(F.round(F.sum("inside") / m2 - resolution * F.sum(F.col("total") * F.col("total")) / (m2 * m2), 6).alias("modularity"))


def louvain(nodes: DataFrame, edges: DataFrame, weight: str = "jaccard", resolution: float = 0.8) -> DataFrame:
    """(id, community): Louvain, communities named by their smallest member.

    Modularity has no gain across components, so each is optimised by itself
    with the whole graph's edge weight: components of at most LARGE nodes in
    one task each, with fixed node order; larger ones together by
    :func:`louvain_moves`, where no task holds a component.
    """
    labels = materialize(component_table(nodes, edges), "components")
    big = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("component")
    big = materialize(labels.join(big, "component", "left_semi").select("id"), "large-components")
    if big.isEmpty():
        return _by_component(labels, edges, weight, lambda ids, links, m: community.louvain(ids, links, m, resolution))
    total = edges.agg(F.sum(weight)).first()[0] or 0.0
    inside = edges.join(big.withColumnRenamed("id", "source"), "source", "left_semi")
    moved = louvain_moves(big, inside, weight, resolution, total)
    rest = _by_component(labels.join(big, "id", "left_anti"), edges.join(big.withColumnRenamed("id", "source"), "source", "left_anti"), weight, lambda ids, links, m: community.louvain(ids, links, m, resolution), total)
    return rest.unionByName(moved)


def louvain_moves(nodes: DataFrame, edges: DataFrame, weight: str, resolution: float, total: float, rounds: int = 12) -> DataFrame:
    """(id, community) by synchronous moves on edge tables.

    In each round a half of the nodes, by a hash, moves to the neighbouring
    community with the highest gain; a level ends when neither half moves or
    after ``rounds``, and the graph of its communities is the next level's,
    until a level moves nothing.
    """
    both = lambda e: e.select(F.col("source").alias("a"), F.col("target").alias("b"), "w").unionAll(e.where("source <> target").select(F.col("target").alias("a"), F.col("source").alias("b"), "w"))
    links = materialize(edges.select("source", "target", F.col(weight).cast("double").alias("w")), "moves-links")
    out = materialize(nodes.select("id", F.col("id").alias("community")), "moves-labels")
    while True:
        ways = materialize(both(links), "moves-ways")
        degree = ways.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("degree"))
        home = materialize(degree.select(F.col("a").alias("id"), F.col("a").alias("c"), "degree"), "moves-home")
        still, changed = 0, False
        for n in range(rounds):
            mass = home.groupBy("c").agg(F.sum("degree").alias("mass"))
            to = ways.where("a <> b").join(home.select(F.col("id").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
            own = home.select(F.col("id").alias("a"), F.col("c").alias("own"), "degree")
            stay = own.select("a", F.col("own").alias("c"), F.lit(0.0).alias("w"))
            seen = to.unionByName(stay).groupBy("a", "c").agg(F.sum("w").alias("w")).join(own, "a").join(mass, "c")
            alone = F.when(F.col("c") == F.col("own"), F.col("mass") - F.col("degree")).otherwise(F.col("mass"))
            gain = F.round(F.col("w") - F.lit(resolution) * F.col("degree") * alone / F.lit(2 * total), 12)
            best = seen.withColumn("gain", gain).groupBy("a").agg(F.first("own").alias("own"), F.first("degree").alias("degree"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("now"), F.max("gain").alias("top"), F.min_by("c", F.struct((-F.col("gain")).alias("g"), F.col("c"))).alias("to"))
            turn = F.pmod(F.xxhash64("a"), F.lit(2)) == n % 2
            step = best.withColumn("goes", turn & (F.col("top") > F.col("now") + 1e-9))
            step = materialize(step.select(F.col("a").alias("id"), F.when(F.col("goes"), F.col("to")).otherwise(F.col("own")).alias("c"), "degree", "goes"), "moves-home")
            any_ = not step.where("goes").isEmpty()
            home, changed, still = step.drop("goes"), changed or any_, 0 if any_ else still + 1
            if still == 2:
                break
        names = home.groupBy("c").agg(F.min("id").alias("name"))
        home = materialize(home.join(names, "c").select(F.col("id").alias("community"), F.col("name").alias("new")), "moves-names")
        out = materialize(out.join(home, "community", "left").select("id", F.coalesce("new", "community").alias("community")), "moves-labels")
        if not changed:
            names = out.groupBy("community").agg(F.min("id").alias("name"))
            return out.join(names, "community").select("id", F.col("name").alias("community"))
        ends = links.join(home.withColumnsRenamed({"community": "source", "new": "s"}), "source").join(home.withColumnsRenamed({"community": "target", "new": "t"}), "target")
        links = materialize(ends.groupBy(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target")).agg(F.sum("w").alias("w")), "moves-links")


def leiden(labels: DataFrame, edges: DataFrame, weight: str = "jaccard", largest: int = 25, resolution: float = 1.0, factor: float = 1.5, depth: int = 30) -> DataFrame:
    """(id, parent, community, was_refined): communities above ``largest`` divided until none is; every part is connected.

    Each level divides the communities that are too large, each as a graph of
    its own, at a resolution that grows by ``factor`` a level: moves, refinement
    into well-connected parts, and the same on the graph of the parts. Those of
    at most PIECE nodes and PIECE_EDGES edges are one group each; larger ones
    are divided together on edge tables by :func:`leiden_level`, where no task
    holds a community. A community without edges falls into single nodes, and
    what ``depth`` levels leave too large raises. The others pass through unread.
    """
    kind = labels.schema["id"].dataType.simpleString()
    todo = materialize(labels.select("id", F.col("community").alias("parent"), F.col("community").cast(kind).alias("community")), "leiden-todo")
    e = edges.select("source", "target", F.col(weight).cast("double").alias("w"))
    done, level = None, 0
    while True:
        sizes = todo.groupBy("community").agg(F.count("*").alias("n"))
        small = todo.join(sizes.where(F.col("n") <= largest).select("community"), "community", "left_semi").select("id", "parent", "community", F.lit(level > 0).alias("was_refined"))
        done = small if done is None else done.unionByName(small)
        big = todo.join(sizes.where(F.col("n") > largest), "community")
        inner = e.join(big.select(F.col("id").alias("source"), "community", "n"), "source").join(big.select(F.col("id").alias("target"), F.col("community").alias("other")), "target").where("community = other").drop("other")
        inner = materialize(inner, "leiden-inner")
        linked = inner.groupBy("community").agg(F.count("*").alias("m"))
        big = materialize(big.join(linked, "community", "left"), "leiden-big")
        if big.isEmpty():
            return done
        lone = big.where("m is null").select("id", "parent", F.col("id").alias("community"), F.lit(True).alias("was_refined"))
        whole = (F.col("n") <= PIECE) & (F.col("m") <= PIECE_EDGES)
        groups = big.where(whole).select("community", F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(0.0).alias("w"))
        groups = groups.unionAll(inner.join(linked, "community").where(whole).select("community", F.col("source").alias("a"), F.col("target").alias("b"), "w"))

        found = groups.groupBy("community").applyInArrow(_divided(largest, resolution * factor**level, factor, depth - level), f"id {kind}, community {kind}")
        refined = big.where(whole).select("id", "parent").join(found, "id").select("id", "parent", "community", F.lit(True).alias("was_refined"))
        done = materialize(done.unionByName(lone).unionByName(refined), "leiden-done")
        rest = big.where(F.col("m").isNotNull() & ~whole)
        if rest.isEmpty():
            return done
        if level > depth:
            raise RuntimeError(f"communities are still above {largest} nodes at resolution {resolution * factor**level}")
        split = leiden_level(rest.select("id", F.col("community").alias("graph")), inner.join(rest.select("community").distinct(), "community", "left_semi"), resolution * factor**level)
        todo = materialize(rest.select("id", "parent").join(split, "id"), "leiden-todo")
        level += 1


def _divided(largest: int, resolution: float, factor: float, depth: int):
    """What divides one community that is small enough for a group."""

    def divide(table: pa.Table) -> pa.Table:
        names, links = _read(table)
        return _named(names, community.refine(list(range(len(names))), links, largest, resolution, factor, depth))

    return divide


def leiden_level(nodes: DataFrame, edges: DataFrame, resolution: float, start: DataFrame | None = None, rounds: int = 8, times: int = 10) -> DataFrame:
    """(id, community): connected communities of every ``graph`` at one resolution, on edge tables.

    ``nodes``: id, graph; ``edges``: source, target, w inside the graphs;
    ``start``: id, community to begin with, else single nodes. Moves as in
    :func:`louvain_moves`; then the nodes of each community start again as
    single ones, and those that are well connected to it join parts that are;
    the parts, in their communities, are the next graph's nodes. A step that
    lowers the modularity is taken back and ends the moves.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    ways = materialize(edges.where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"), "w").unionAll(edges.where("source <> target").select(F.col("target").alias("a"), F.col("source").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "leiden-ways")
    inner = ways
    loops = edges.where("source = target").groupBy(F.col("source").alias("id")).agg((2 * F.sum("w")).alias("loop"))
    degrees = ways.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("out"))
    home = nodes.join(degrees, "id", "left").join(loops, "id", "left").select("id", "graph", (F.coalesce("out", F.lit(0.0)) + F.coalesce("loop", F.lit(0.0))).alias("degree"), F.coalesce("loop", F.lit(0.0)).alias("loop"))
    home = home.join(home.groupBy("graph").agg(F.sum("degree").alias("m2")), "graph")
    home = home.join(start.withColumnRenamed("community", "c"), "id") if start is not None else home.withColumn("c", F.col("id"))
    home = materialize(home.select("id", "c", "degree", "loop", "m2"), "leiden-home")
    out = nodes.select("id", F.col("id").alias("node"))
    for _ in range(times):
        home = _moves(ways, home, resolution, rounds)
        parts = _refined(ways, home, resolution, rounds // 2)
        merged = parts.where("part <> id")
        out = materialize(out.join(parts.select(F.col("id").alias("node"), "part"), "node").select("id", F.col("part").alias("node")), "leiden-parts")
        ends = ways.join(parts.select(F.col("id").alias("a"), F.col("part").alias("x")), "a").join(parts.select(F.col("id").alias("b"), F.col("part").alias("y")), "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w"))
        ends = materialize(ends, "leiden-ends")
        within = ends.where("a = b").select(F.col("a").alias("id"), F.col("w").alias("inside"))
        home = home.join(parts.select("id", "part"), "id").groupBy(F.col("part").alias("id")).agg(F.min("c").alias("c"), F.sum("degree").alias("degree"), F.sum("loop").alias("loop"), F.max("m2").alias("m2"))
        home = materialize(home.join(within, "id", "left").select("id", "c", "degree", (F.col("loop") + F.coalesce("inside", F.lit(0.0))).alias("loop"), "m2"), "leiden-home")
        ways = ends.where("a <> b")
        if merged.isEmpty():
            break
    found = out.join(home.select(F.col("id").alias("node"), "c"), "node").select("id", "c")
    same = inner.join(found.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(found.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb and a < b").select(F.col("a").alias("source"), F.col("b").alias("target"))
    return component_table(nodes, same).select("id", F.col("component").cast(kind).alias("community"))


def _quality(ways: DataFrame, home: DataFrame, resolution: float) -> float:
    """The sum of the graphs' modularities; ``ways`` holds both directions."""
    at = home.select("id", "c", "m2")
    inside = ways.join(at.select(F.col("id").alias("a"), "c", "m2"), "a").join(at.select(F.col("id").alias("b"), F.col("c").alias("d")), "b").where("c = d").agg(F.sum(F.col("w") / F.col("m2"))).first()[0] or 0.0
    rest = home.groupBy("c").agg(F.sum("degree").alias("k"), F.sum("loop").alias("loop"), F.max("m2").alias("m2")).where("m2 > 0").agg(F.sum(F.col("loop") / F.col("m2") - F.lit(resolution) * (F.col("k") / F.col("m2")) ** 2)).first()[0] or 0.0
    return inside + rest


def _moves(ways: DataFrame, home: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """``home`` (id, c, degree, loop, m2) after rounds in which half of the nodes, by a hash, go to the neighbouring community of the highest gain."""
    value, still = _quality(ways, home, resolution), 0
    for n in range(rounds):
        mass = home.groupBy("c").agg(F.sum("degree").alias("mass"))
        to = ways.join(home.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
        own = home.withColumnRenamed("c", "own")
        seen = to.unionByName(home.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w")).join(own, "id").join(mass, "c")
        gain = F.round(F.col("w") - F.lit(resolution) * F.col("degree") * (F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("degree")).otherwise(0.0)) / F.col("m2"), 12)
        seen = seen.where("m2 > 0").withColumn("gain", gain)
        best = seen.groupBy("id").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("now"), F.min(F.struct((-F.col("gain")).alias("g"), F.col("c").alias("c"))).alias("to"))
        goes = (F.pmod(F.xxhash64("id", F.lit(n // 2)), F.lit(2)) == n % 2) & (-F.col("to.g") > F.col("now") + 1e-9)
        step = materialize(home.join(best.where(goes).select("id", F.col("to.c").alias("new")), "id", "left"), "leiden-moves")
        if step.where("new is not null").isEmpty():
            still += 1
            if still == 2:
                return home
            continue
        moved = step.select("id", F.coalesce("new", "c").alias("c"), "degree", "loop", "m2")
        now = _quality(ways, moved, resolution)
        if now <= value + 1e-12:
            return home
        home, value, still = moved, now, 0
    return home


def _refined(ways: DataFrame, home: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(id, part): single nodes that are well connected to their community join, in turns, parts of it that are; ties go to the smaller part."""
    whole = home.groupBy("c").agg(F.sum("degree").alias("whole"))
    at = home.select("id", "c")
    links = ways.join(at.select(F.col("id").alias("a"), "c"), "a").join(at.select(F.col("id").alias("b"), F.col("c").alias("d")), "b").where("c = d").select("a", "b", "w")
    links = materialize(links, "leiden-links")
    state = materialize(home.join(whole, "c").where("m2 > 0").select("id", "c", "degree", "m2", "whole", F.col("id").alias("part")), "leiden-state")
    for n in range(rounds):
        place = state.select(F.col("id").alias("b"), F.col("part").alias("to"))
        near = links.join(place, "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("w"))
        near = materialize(near.join(state.select("id", "part"), "id"), "leiden-near")
        outer = near.where("to <> part").groupBy("part").agg(F.sum("w").alias("outer"))
        parts = state.groupBy("part").agg(F.count("*").alias("size"), F.sum("degree").alias("mass"), F.max("whole").alias("whole"), F.max("m2").alias("m2")).join(outer, "part", "left")
        well = F.coalesce("outer", F.lit(0.0)) >= F.lit(resolution) * F.col("mass") * (F.col("whole") - F.col("mass")) / F.col("m2") - 1e-12
        turn = (F.col("size") == 1) & (F.pmod(F.xxhash64("part", F.lit(n // 2)), F.lit(2)) == n % 2)  # the others stay where they are
        parts = materialize(parts.select("part", "mass", "m2", well.alias("well"), turn.alias("turn")).where("well"), "leiden-well")
        goes = near.where("to <> part").join(parts.where("turn").select("part", F.col("mass").alias("degree")), "part").join(parts.where("not turn").select(F.col("part").alias("to"), "mass", "m2"), "to")
        gain = F.round(F.col("w") - F.lit(resolution) * F.col("degree") * F.col("mass") / F.col("m2"), 12)
        new = goes.withColumn("gain", gain).where("gain > 1e-12").groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("to").alias("to"))).alias("x")).select("id", F.col("x.to").alias("new"))
        state = materialize(state.join(new, "id", "left").select("id", "c", "degree", "m2", "whole", F.coalesce("new", "part").alias("part")), "leiden-state")
    return home.select("id").join(state.select("id", "part"), "id", "left").select("id", F.coalesce("part", "id").alias("part"))


def _read(table: pa.Table) -> tuple[pa.Array, list[tuple]]:
    """The nodes in order, and the links in order, with their ends as places among the nodes."""
    lone = pc.is_null(table["b"])
    names = table.filter(lone)["a"].unique()
    names, links = names.take(pc.array_sort_indices(names)), table.filter(pc.invert(lone))
    a, b = (pc.index_in(links[c], value_set=names).to_numpy() for c in "ab")
    w = links["w"].to_numpy()
    order = np.lexsort((w, b, a))
    return names, list(zip(a[order].tolist(), b[order].tolist(), w[order].tolist(), strict=True))


def _named(names: pa.Array, parts: list[set]) -> pa.Table:
    """(id, community) of the parts, places among ``names``, called by their smallest members."""
    members = [(i, min(part)) for part in parts for i in sorted(part)]
    return pa.table([names.take(pa.array([m[c] for m in members], pa.int64())) for c in (0, 1)], names=["id", "community"])


def _by_component(labels: DataFrame, edges: DataFrame, weight: str, split, total: float | None = None) -> DataFrame:
    total = (edges.agg(F.sum(weight)).first()[0] or 0.0) if total is None else total
    kind = labels.schema["id"].dataType
    e = edges.join(labels.withColumnRenamed("id", "source"), "source").select("component", F.col("source").alias("a"), F.col("target").alias("b"), F.col(weight).cast("double").alias("w"))
    linked = labels.join(e.select("component").distinct(), "component", "left_semi")
    rows = linked.select("component", F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(0.0).alias("w")).unionAll(e)

    def run(table: pa.Table) -> pa.Table:
        names, links = _read(table)
        return _named(names, split(list(range(len(names))), links, float(total)))

    found = rows.groupBy("component").applyInArrow(run, f"id {kind.simpleString()}, community {kind.simpleString()}")
    return labels.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
