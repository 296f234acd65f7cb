import random
import re
from itertools import product

import pytest
from oracle import SF

from pyspark.sql import functions as F

from ruleloom.operators import community, graph, ranking
from ruleloom.operators.components import connected_components
from ruleloom.plans import fixtures as fx
from ruleloom.plans.queries import QUERIES


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_of_random_graphs_paths_and_stars(spark):
    rng = random.Random(5)
    cases = [[(rng.randrange(40), rng.randrange(40)) for _ in range(30)], [(i, i + 1) for i in range(33)], [(50, i) for i in range(20)], [(i, 40 - i) for i in range(20)] + [(i, i + 5) for i in range(0, 40, 7)]]
    for edges in cases:
        df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
        assert {r["vertex"]: r["component"] for r in connected_components(df).collect()} == roots(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(groups=4, size=12):
    rng = random.Random(1)
    ids = list(range(groups * size))
    links = [(a, b, 1.0) for a in ids for b in ids if a < b and (a // size == b // size and rng.random() < 0.7 or rng.random() < 0.01)]
    return ids, links


def test_louvain_finds_planted_groups_and_reruns_agree():
    ids, links = planted()
    parts = community.louvain(ids, links, sum(w for *_, w in links), 1.0)
    assert parts == community.louvain(ids, links[::-1], sum(w for *_, w in links), 1.0)
    assert sorted(map(min, parts)) == [0, 12, 24, 36]


def test_refine_is_a_partition_within_the_bound():
    ids, links = planted(2, 40)
    parts = community.refine(ids, links, 25, 1.0, 1.5, 10)
    assert sorted(i for p in parts for i in p) == ids
    assert max(map(len, parts)) <= 25
    clique = [(a, b, 1.0) for a in range(60) for b in range(a)]
    assert max(map(len, community.refine(list(range(60)), clique, 25, 1.0, 1.5, 30))) <= 25
    with pytest.raises(RuntimeError, match="still above"):
        community.refine(list(range(60)), clique, 25, 0.1, 1.0, 3)
    assert community.refine([1, 2, 3], [], 2, 1.0, 1.5, 10) == [{1}, {2}, {3}]


def test_louvain_is_at_least_as_modular_as_components(spark):
    ids, links = planted()
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    edges = spark.createDataFrame(links, "source long, target long, jaccard double")
    labels = graph.louvain(nodes, edges, resolution=1.0)
    whole = graph.component_table(nodes, edges).withColumnRenamed("component", "community")
    score = lambda x: graph.modularity(edges, x, "jaccard").first()[0]
    assert score(labels) >= score(whole)


def test_large_components_by_moves_on_tables(spark, monkeypatch):
    ids, links = planted(3, 10)
    nodes = spark.createDataFrame([(i,) for i in [*ids, 99]], "id long")
    edges = spark.createDataFrame(links, "source long, target long, jaccard double")
    monkeypatch.setattr(graph, "LARGE", 5)
    found = {r["id"]: r["community"] for r in graph.louvain(nodes, edges, resolution=1.0).collect()}
    assert found == {i: i // 10 * 10 for i in ids} | {99: 99}


def test_hubs_in_parts_count_all_shared_neighbours(spark, monkeypatch):
    rng = random.Random(2)
    lists = {q: rng.sample([n for n in range(30) if n != q], 6) + [40] for q in range(30)}
    rows = spark.createDataFrame([(q, n) for q, ns in lists.items() for n in ns], "q long, n long")
    monkeypatch.setattr(graph, "HUB", 7)
    want = {(a, b): len(set(lists[a]) & set(lists[b])) for a in lists for b in lists if a < b and len(set(lists[a]) & set(lists[b])) >= 2}
    assert {(r["source"], r["target"]): r["shared"] for r in graph.snn_edges(rows, 7, 2).collect()} == want


def linked(members, links):
    near = {i: set() for i in members}
    for a, b, _ in links:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    return len(community.connected(set(members), near)) == 1


def quality(parts, links, resolution=1.0):
    m2 = 2 * sum(w for *_, w in links)
    home = {i: n for n, p in enumerate(parts) for i in p}
    mass = [0.0] * len(parts)
    inside = 0.0
    for a, b, w in links:
        mass[home[a]] += w
        mass[home[b]] += w
        inside += 2 * w * (home[a] == home[b])
    return inside / m2 - resolution * sum((k / m2) ** 2 for k in mass)


def test_leiden_is_connected_and_no_worse_than_its_start():
    for seed in range(6):
        rng = random.Random(seed)
        ids = list(range(40))
        links = [(a, b, rng.choice([1.0, 2.0])) for a in ids for b in ids if a < b and rng.random() < (0.5 if a % 4 == b % 4 else 0.06)]
        total = sum(w for *_, w in links)
        parts = community.leiden(ids, links, total, 1.0)
        assert sorted(i for p in parts for i in p) == ids and all(linked(p, links) for p in parts)
        assert quality(parts, links) >= quality(community.louvain(ids, links, total, 1.0), links) - 0.02
        assert parts == community.leiden(ids, links[::-1], total, 1.0)


def test_leiden_of_small_graphs_against_all_partitions():
    def every(n):
        for labels in product(range(n), repeat=n):
            if all(x <= max(labels[:i], default=-1) + 1 for i, x in enumerate(labels)):
                yield [{i for i in range(n) if labels[i] == c} for c in set(labels)]

    links = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 0.5), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0)]
    best = max(quality(p, links) for p in every(6))
    assert quality(community.leiden(list(range(6)), links, 6.5, 1.0), links) == pytest.approx(best)


def test_a_part_that_hangs_by_a_bridge_node_is_cut_off():
    # a and b meet in one node only; once it is gone its old community is no longer connected
    ids, links = planted(2, 10)
    links += [(0, 10, 3.0), (0, 11, 3.0), (0, 12, 3.0)]
    assert all(linked(p, links) for p in community.leiden(ids, links, sum(w for *_, w in links), 1.0))


@pytest.mark.parametrize("piece", [2_000, 5])
def test_leiden_of_tables_and_of_groups(spark, monkeypatch, piece):
    monkeypatch.setattr(graph, "PIECE", piece)
    ids, links = planted(5, 14)
    ids = [*ids, 100, 101]
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    edges = spark.createDataFrame([*links, (3, 3, 0.5)], "source long, target long, jaccard double")
    start = spark.createDataFrame([(i, 0 if i < 42 else 42 if i < 100 else i) for i in ids], "id long, community long")
    out = graph.leiden(start, edges, largest=14).collect()
    assert sorted(r["id"] for r in out) == ids
    parts = {}
    for r in out:
        parts.setdefault(r["community"], set()).add(r["id"])
        assert r["parent"] == (0 if r["id"] < 42 else 42 if r["id"] < 100 else r["id"]) and r["was_refined"] == (r["id"] < 100)
    assert all(len(p) <= 14 and min(p) == c and linked(p, links) for c, p in parts.items())
    assert sum(p == set(range(g, g + 14)) for g in range(0, 70, 14) for p in parts.values()) >= 4  # the planted ones
    level = graph.leiden_level(nodes.where("id < 100").withColumn("graph", F.lit(0)), edges.where("source <> target").withColumnRenamed("jaccard", "w"), 1.0)
    found = {}
    for r in level.collect():
        found.setdefault(r["community"], set()).add(r["id"])
    assert quality(list(found.values()), links) >= quality(community.louvain(ids[:70], links, sum(w for *_, w in links), 1.0), links) - 0.02


def test_leiden_level_is_no_worse_than_a_given_start(spark):
    ids, links = planted(4, 9)
    nodes = spark.createDataFrame([(i, 0) for i in ids], "id long, graph int")
    edges = spark.createDataFrame(links, "source long, target long, w double")
    start = [set(p) for p in community.louvain(ids, links, sum(w for *_, w in links), 1.0)]
    given = spark.createDataFrame([(i, min(p)) for p in start for i in p], "id long, community long")
    found = {}
    for r in graph.leiden_level(nodes, edges, 1.0, given).collect():
        found.setdefault(r["community"], set()).add(r["id"])
    assert quality(list(found.values()), links) >= quality(start, links) - 1e-9


def test_a_community_of_some_thousand_nodes_is_one_group(spark, monkeypatch):
    """Dense ones too: on edge tables each level of theirs takes hundreds of Spark jobs."""
    monkeypatch.setattr(graph, "leiden_level", lambda *a, **k: pytest.fail("divided on edge tables"))
    ids = [f"D{i:04d}" for i in range(2_400)]
    links = [(ids[a], ids[b], 1.0 if a // 24 == b // 24 else 0.01) for a in range(2_400) for b in {*range(a + 1, a // 24 * 24 + 24), *((a + 24 * n) % 2_400 for n in range(1, 12))} if a < b]
    start = spark.createDataFrame([(i, ids[0]) for i in ids], "id string, community string")
    out = graph.leiden(start, spark.createDataFrame(links, "source string, target string, jaccard double")).collect()
    parts = {}
    for r in out:
        parts.setdefault(r["community"], set()).add(r["id"])
    assert parts == {ids[g]: set(ids[g : g + 24]) for g in range(0, 2_400, 24)}


def test_snn_edges_shuffle_arrays_and_no_row_a_pair(spark, monkeypatch):
    """Pairs are made after the rows are with their source: no exchange is by source and target; hubs in parts give the same counts."""
    rng = random.Random(11)
    lists = {q: [0, *rng.sample(range(1, 40), 5)] for q in range(40, 100)}
    n = spark.createDataFrame([(q, x) for q, some in lists.items() for x in some], "q long, n long")
    want = {(a, b): len(set(lists[a]) & set(lists[b])) for a in lists for b in lists if a < b and len(set(lists[a]) & set(lists[b])) > 1}
    for hub in (2_000, 7):
        monkeypatch.setattr(graph, "HUB", hub)
        edges = graph.snn_edges(n, 6, 2)
        assert {(r["source"], r["target"]): r["shared"] for r in edges.collect()} == want and len(want) > 100
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(source" in plan and not re.search(r"hashpartitioning\(source#\d+L?, target", plan)


def test_mutual_edges_read_no_more_neighbours_than_can_make_one(spark, monkeypatch):
    """The edges of the whole lists, from lists of their first TOP rows."""
    asked, whole = [], fx.neighbors
    want = graph.undirected_edges(whole(spark, SF), fx.TOP, fx.MIN_SCORE)
    monkeypatch.setattr(fx, "neighbors", lambda s, d, k=fx.K: asked.append(whole(s, d, k)) or asked[-1])
    found = QUERIES["mutual_topk_edges"](spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 0
    assert asked[0].groupBy("q").count().agg({"count": "max"}).first()[0] == fx.TOP


def test_soft_floor_reads_twenty_neighbours(spark, monkeypatch):
    """The candidates of the whole lists' first 20 rows, from lists of 20."""
    asked, whole = [], fx.neighbors
    want = ranking.soft_floor(whole(spark, SF).where("rank <= 20"), ["q"], "score", "rank", 0.36, 3)
    monkeypatch.setattr(fx, "neighbors", lambda s, d, k=fx.K: asked.append(whole(s, d, k)) or asked[-1])
    found = QUERIES["soft_floor_candidates"](spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 0
    assert asked[0].groupBy("q").count().agg({"count": "max"}).first()[0] == 20
