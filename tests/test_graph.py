import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartograph.operators import graph
from cartograph.operators.components import connected_components

NODE = "id string, kind string, title string, description string, path string, lang string, tags array<string>, attrs map<string,string>, files array<string>, exports array<string>, ord long"
EDGE = "src string, dst string, kind string, confidence string, weight int, source string, ord long"


def test_node_merge_keeps_first_text_and_unites_lists(spark):
    rows = [
        ("/m/kiln", "Module", "", "fires clay", "", "", ["clay"], {"heat": "900"}, ["kiln.rs"], [], 3),
        ("/m/kiln", "Module", "Kiln", "bakes", "", "", ["bricks", "clay", " "], {"heat": "1200", "fuel": "gas"}, ["bake.rs", "kiln.rs"], [], 4),
    ]
    r = graph.merge_nodes(spark.createDataFrame(rows, NODE)).first()
    assert (r.title, r.description, r.tags, r.files, r.attrs) == ("Kiln", "fires clay", ["bricks", "clay"], ["bake.rs", "kiln.rs"], {"heat": "900", "fuel": "gas"})


@pytest.mark.parametrize("rows", [[("", "Module", 0)], [("/a", "Module", 0), ("/a", "Service", 1)]])
def test_bad_nodes_raise(spark, rows):
    full = [(i, k, "", "", "", "", [], {}, [], [], o) for i, k, o in rows]
    with pytest.raises(Exception):
        graph.merge_nodes(spark.createDataFrame(full, NODE)).collect()


def test_edge_merge(spark):
    rows = [("oven", "dough", "imports", "ambiguous", 7, "", 5), ("oven", "dough", "imports", "inferred", 4, "oven.rs", 6), ("oven", "oven", "imports", "extracted", 9, "", 7), ("oven", "dough", "reads", "inferred", 6, "p", 8), ("oven", "dough", "reads", "inferred", 5, "q", 9)]
    for order in (rows, rows[::-1]):
        got = {r.kind: (r.weight, r.confidence, r.source) for r in graph.merge_edges(spark.createDataFrame(order, EDGE)).collect()}
        assert got == {"imports": (11, "inferred", "oven.rs"), "reads": (11, "inferred", "p")}


def edges(spark, pairs, kind="imports"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, kind string")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_components_islands_and_orphans(spark):
    e = edges(spark, [("a", "b"), ("c", "d"), ("d", "e")])
    n = nodes(spark, "abcdez")
    got = {r.id: (r.component, r.size) for r in graph.components(n, e).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 3), "d": ("c", 3), "e": ("c", 3), "z": ("z", 1)}
    assert [tuple(r) for r in graph.islands(n, e).collect()] == [("a", 2)]
    assert [r.id for r in graph.orphans(n, e).collect()] == ["z"]


def test_components_on_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(150)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def test_cycles_on_driver_and_cluster(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("x", "y"), ("y", "x"), ("c", "x")])
    want = {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("x", "x", 2), ("y", "x", 2)}
    assert {tuple(r) for r in graph.cycles(e).collect()} == want
    assert {tuple(r) for r in graph.cycles(e, driver_edges=-1).collect()} == want


def test_ring_of_20000_is_one_cycle(spark):
    e = spark.range(20000).select(F.col("id").cast("string").alias("src"), ((F.col("id") + 1) % 20000).cast("string").alias("dst"), F.lit("imports").alias("kind"))
    assert graph.cycles(e).agg(F.min("size"), F.count("*")).first() == (20000, 20000)


def test_shortest_path_takes_the_smallest_sequence(spark):
    e = edges(spark, [("a", "y"), ("a", "x"), ("x", "z"), ("y", "z")])
    assert graph.shortest_path(e, "a", "z").first() == (2, "a > x > z")
    assert graph.shortest_path(e, "z", "a").isEmpty()
    chain = edges(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(36)])
    assert graph.shortest_path(chain, "n00", "n36").first().hops == 36


def test_two_triangles_are_two_clusters_with_one_bridge(spark):
    e = edges(spark, [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a1", "b1")])
    c = graph.clusters(nodes(spark, ["a1", "a2", "a3", "b1", "b2", "b3"]), e)
    groups = defaultdict(set)
    for r in c.collect():
        groups[r.cluster].add(r.id)
    assert dict(groups) == {0: {"a1", "a2", "a3"}, 1: {"b1", "b2", "b3"}}
    assert [(r.src, r.dst) for r in graph.bridges(e, c).collect()] == [("a1", "b1")]
    spread = graph.spread_clusters(nodes(spark, ["a1", "a2", "a3", "b1", "b2", "b3", "z"]), e)
    assert {r.id: r.cluster for r in spread.collect()} == {"a1": 0, "a2": 0, "a3": 0, "b1": 1, "b2": 1, "b3": 1, "z": 2}
    assert graph.modularity(e, c).first()[0] == pytest.approx(6 / 7 - 2 * (7 / 14) ** 2)


def test_spread_clusters_come_near_the_sequential_ones(spark):
    rng = random.Random(12)
    pairs = [(f"n{i:03}", f"n{j:03}") for i in range(60) for j in range(i) if rng.random() < (0.5 if i // 15 == j // 15 else 0.02)]
    e, n = edges(spark, pairs), nodes(spark, [f"n{i:03}" for i in range(60)])
    one, two = (graph.modularity(e, c).first()[0] for c in (graph.clusters(n, e), graph.spread_clusters(n, e)))
    assert two > 0.9 * one


def test_degrees_hubs_dangling(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("a", "q")]).union(edges(spark, [("a", "b")], "reads"))
    n = nodes(spark, "abc")
    assert {tuple(r) for r in graph.degrees(n, e).collect()} == {("a", 0, 3, 3), ("b", 2, 0, 2), ("c", 1, 0, 1)}
    assert [r.id for r in graph.hubs(n, e, 2).collect()] == ["a", "b"]
    assert [r.id for r in graph.hubs(n.union(nodes(spark, "z")), e, 0).collect()] == ["a", "b", "c", "z"]
    assert [(r.src, r.dst) for r in graph.edges_at(n, e, "a").collect()] == [("a", "b"), ("a", "b"), ("a", "c")] and graph.edges_at(n, e, "b", out=False).count() == 2
    assert [r.dst for r in graph.dangling(e, n).collect()] == ["q"]
    assert graph.with_both_ends(e, n).count() == 3
