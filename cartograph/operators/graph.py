"""Typed, confidence-tagged multigraph on DataFrames.

nodes(id, kind, title, description, path, lang, tags, attrs, files, exports, ord)
edges(src, dst, kind, confidence, weight, source, ord); ``ord`` says who wrote first.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartograph.operators.components import connected_components
from cartograph.session import cut

# Kinds and confidences, strongest first.
NODE_KINDS = ("Module", "Symbol", "Service", "Interface", "Data", "Pipeline", "Document", "External")
EDGE_KINDS = ("imports", "calls", "defines", "owns", "depends_on", "reads", "writes", "configures", "precedes", "implements", "documents", "tested_by", "co_changes")
CONFIDENCES = ("extracted", "inferred", "ambiguous")

#: Edges collected for the driver's cycle search; larger graphs are coloured on the cluster.
DRIVER_EDGES = 500_000
#: Rows of a search frontier that are broadcast; more are joined by shuffle.
BROADCAST_FRONTIER = 100_000


def confidence_rank(c: Column) -> Column:
    return F.when(c == "extracted", 3).when(c == "inferred", 2).when(c == "ambiguous", 1).otherwise(0)


def set_normalise(values: Column) -> Column:
    """Trimmed, without blanks, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind): weights add up; the strongest confidence and, among equals, the
    first writer give confidence and source. Self edges and empty ends go."""
    rank = F.struct(confidence_rank(F.col("confidence")), -F.col("ord"))
    kept = edges.where("src <> dst AND src <> '' AND dst <> ''")
    out = kept.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"), F.max_by(F.struct("confidence", "source"), rank).alias("b"))
    return out.select("src", "dst", "kind", F.col("b.confidence").alias("confidence"), "weight", F.col("b.source").alias("source"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id: the first non-empty text wins, lists are united, attributes are the first writer's.

    An empty id or two kinds under one id raise."""

    def first(name: str) -> Column:
        return F.coalesce(F.min_by(F.when(F.col(name) != "", F.col(name)), F.when(F.col(name) != "", F.col("ord"))), F.lit("")).alias(name)

    def united(name: str) -> Column:
        return set_normalise(F.flatten(F.collect_list(name))).alias(name)

    checked = nodes.withColumn("id", F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.raise_error(F.lit("node id is empty")).cast("string")).otherwise(F.col("id")))
    base = checked.groupBy("id").agg(
        F.min("kind").alias("kind"), F.max("kind").alias("_k"), *[first(c) for c in ("title", "description", "path", "lang")], *[united(c) for c in ("tags", "files", "exports")]
    )
    base = base.withColumn("kind", F.when(F.col("kind") != F.col("_k"), F.raise_error(F.concat(F.lit("kind conflict at "), "id")).cast("string")).otherwise(F.col("kind"))).drop("_k")
    pairs = checked.select("id", "ord", F.explode("attrs").alias("k", "v")).groupBy("id", "k").agg(F.min_by("v", "ord").alias("v"))
    attrs = pairs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    return base.join(attrs, "id", "left").withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that lack an end."""
    ids = nodes.select("id")
    a = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    b = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return a.unionByName(b).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in, out, total over edges with both ends; parallel kinds count each. One shuffle of ends."""
    ends = with_both_ends(edges, nodes).select(
        F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")
    ).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("long")
    out = nodes.select("id").join(sums, "id", "left").withColumns({c: F.coalesce(c, zero) for c in ("in_degree", "out_degree")})
    return out.withColumn("total", F.col("in_degree") + F.col("out_degree"))


def hubs(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes of most edges (all for n <= 0), ties by id."""
    out = degrees(nodes, edges).orderBy(F.desc("total"), "id")
    return out.limit(n) if n > 0 else out


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge to or from another node."""
    ends = with_both_ends(edges, nodes).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_anti")


def adjacency(edges: DataFrame, kinds: tuple[str, ...] = (), directed: bool = True) -> DataFrame:
    """id and its sorted, distinct neighbours."""
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    pairs = e.select("src", "dst")
    if not directed:
        pairs = pairs.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def confidence_counts(edges: DataFrame) -> DataFrame:
    """Edges by confidence, all three always there."""
    spark = edges.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CONFIDENCES])).alias("confidence"))
    n = edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "confidence", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its smallest id), size over all kinds."""
    cc = connected_components(with_both_ends(edges, nodes))
    out = nodes.select("id").join(cc, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.join(out.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("id", "component", "size")


def islands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of two nodes or more but for the largest (ties: the one of the smallest id)."""
    c = components(nodes, edges).groupBy("component").agg(F.max("size").alias("size")).where("size > 1")
    top = c.agg(F.max_by("component", F.struct("size", F.lit(0))).alias("_x"), F.max("size").alias("most"))
    first = c.join(F.broadcast(top.select("most")), c["size"] == F.col("most")).agg(F.min("component").alias("main"))
    return c.join(F.broadcast(first), F.col("component") != F.col("main")).select("component", "size")


def _tarjan(adj: dict) -> list[list]:
    """Strongly connected components of two nodes or more, without recursion."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(adj):
        if root in index:
            continue
        work = [(root, iter(adj.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(adj.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while not comp or comp[-1] != v:
                        comp.append(stack.pop())
                        on.discard(comp[-1])
                    if len(comp) > 1:
                        out.append(sorted(comp))
    return out


def _trim(e: DataFrame) -> DataFrame:
    """Edges both of whose ends have edges in and out."""
    mid = e.select("src").distinct().join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return e.join(mid, "src", "left_semi").join(mid.withColumnRenamed("src", "dst"), "dst", "left_semi")


def _coloured(e: DataFrame) -> DataFrame:
    """(id, cycle) by colouring: least labels spread forwards, roots reach back within their colour."""
    spark = e.sparkSession
    found = spark.createDataFrame([], e.select(F.col("src").alias("id"), F.col("src").alias("cycle")).schema)
    e = cut(e)
    while True:
        before = -1
        while before != (now := e.count()):
            before, e = now, cut(_trim(e))
        if not now:
            return found
        colour = cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            sent = e.join(colour, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "c")
            new = cut(colour.union(sent).groupBy("id").agg(F.min("c").alias("c")))
            changed = not new.join(colour, ["id", "c"], "left_anti").isEmpty()
            colour = new
            if not changed:
                break
        own = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        own = cut(own)
        reached = cut(colour.where("id = c"))
        while True:
            back = own.join(reached.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c")
            new = cut(reached.union(back).distinct())
            if new.count() == reached.count():
                break
            reached = new
        found = cut(found.union(reached.select("id", F.col("c").alias("cycle"))))
        done = reached.select("id")
        e = cut(e.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"))


def cycles(edges: DataFrame, kinds: tuple[str, ...] = ("imports",), driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(id, cycle, size): strongly connected components of two nodes or more, named by the smallest id.

    Edges that can't be on a cycle are trimmed first. What is left is searched on the driver if it
    has at most ``driver_edges`` edges, else coloured on the cluster."""
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    e = cut(_trim(e.where("src <> dst").select("src", "dst").distinct()))
    if e.count() <= driver_edges:
        adj = defaultdict(list)
        for s, d in e.orderBy("src", "dst").collect():
            adj[s].append(d)
        rows = [(x, c[0]) for c in _tarjan(adj) for x in c]
        out = e.sparkSession.createDataFrame(rows, f"id {e.schema['src'].dataType.simpleString()}, cycle {e.schema['src'].dataType.simpleString()}")
    else:
        out = _coloured(e)
        out = out.join(out.groupBy("cycle").count().where("count > 1"), "cycle").select("id", "cycle")
    return out.join(out.groupBy("cycle").agg(F.count(F.lit(1)).alias("size")), "cycle").select("id", "cycle", "size")


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(hops, path): the shortest directed path, the smallest id sequence among equals; no row if none.

    The edges are written once; the frontier keeps one path per node and is broadcast while it is small. The search ends
    when no new node is reached, however long the path."""
    spark = edges.sparkSession
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    frontier = cut(spark.range(1).select(F.lit(start).alias("id"), F.array(F.lit(start)).alias("path")))
    seen = frontier.select("id")
    hops = 0
    while True:
        hit = frontier.where(F.col("id") == end)
        if not hit.isEmpty():
            return hit.select(F.lit(hops).cast("long").alias("hops"), F.array_join("path", " > ").alias("path"))
        n = frontier.count()
        if not n:
            return spark.createDataFrame([], "hops bigint, path string")
        near = F.broadcast(frontier) if n <= BROADCAST_FRONTIER else frontier
        step = e.join(near, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        seen = seen.union(frontier.select("id"))
        hops += 1
        if hops % 8 == 0:
            seen = cut(seen)


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node with an id, if there is one."""
    return nodes.where(F.col("id") == node_id)


def ordered_nodes(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes (of one kind) by id."""
    return (nodes if kind is None else nodes.where(F.col("kind") == kind)).orderBy("id")


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst", "kind")


def edges_at(nodes: DataFrame, edges: DataFrame, node_id: str, out: bool = True) -> DataFrame:
    """Edges that leave (or, with ``out`` False, reach) a node and whose other end is a node."""
    own, other = ("src", "dst") if out else ("dst", "src")
    return ordered_edges(edges.where(F.col(own) == node_id).join(nodes.select(F.col("id").alias(other)), other, "left_semi").select(*edges.columns))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))), F.lit(True))


def gate_share(nodes: DataFrame) -> DataFrame:
    """One row: pipelines, and those of them that guard what is merged (tag gate)."""
    p = nodes.where("kind = 'Pipeline'")
    return p.agg(F.count(F.lit(1)).alias("pipelines"), F.count_if(F.array_contains("tags", "gate")).alias("gates"))


def louvain(adj: dict[int, dict[int, float]], twice_m: float, levels: int = 20, passes: int = 100) -> list[int]:
    """Labels of nodes 0..n-1 by modularity: nodes in ascending order move to the best strictly better community."""
    n = len(adj)
    labels = list(range(n))
    loops = [0.0] * n
    graph = {u: dict(vs) for u, vs in adj.items()}
    for _ in range(levels):
        size = len(graph)
        degree = [sum(graph[u].values()) + 2 * loops[u] for u in range(size)]
        community = list(range(size))
        total = degree[:]
        moved_any = False
        for _ in range(passes):
            moved = False
            for u in range(size):
                links: dict[int, float] = defaultdict(float)
                for v, w in graph[u].items():
                    links[community[v]] += w
                own = community[u]
                total[own] -= degree[u]
                best, gain = own, links.get(own, 0.0) - total[own] * degree[u] / twice_m
                for c in sorted(links):
                    g = links[c] - total[c] * degree[u] / twice_m
                    if g > gain:
                        best, gain = c, g
                total[best] += degree[u]
                if best != own:
                    community[u], moved, moved_any = best, True, True
            if not moved:
                break
        names = {c: i for i, c in enumerate(dict.fromkeys(community))}
        if not moved_any or len(names) == size:
            break
        labels = [names[community[x]] for x in labels]
        merged: dict[int, dict[int, float]] = {i: defaultdict(float) for i in range(len(names))}
        inner = [0.0] * len(names)
        for u in range(size):
            a = names[community[u]]
            inner[a] += loops[u]
            for v, w in graph[u].items():
                b = names[community[v]]
                if a == b:
                    inner[a] += w / 2
                else:
                    merged[a][b] += w
        graph, loops = {k: dict(v) for k, v in merged.items()}, inner
    return labels


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): Louvain on the simple undirected graph of all kinds, clusters numbered by lowest member.

    Communities never cross weakly connected components, so each component is one group, given the
    whole graph's degree sum. A component is one task: its edges must fit a worker."""
    both = with_both_ends(edges, nodes).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = cut(both)
    twice_m = float(2 * pairs.count())
    cc = connected_components(pairs, "a", "b")
    parts = pairs.join(cc.withColumnRenamed("id", "a"), "a").select("component", "a", "b")

    def run(key, table):
        a, b = table["a"].to_pylist(), table["b"].to_pylist()
        ids = sorted({*a, *b})
        at = {x: i for i, x in enumerate(ids)}
        adj: dict[int, dict[int, float]] = {i: {} for i in range(len(ids))}
        for x, y in zip(a, b, strict=True):
            adj[at[x]][at[y]] = adj[at[y]][at[x]] = 1.0
        labels = louvain(adj, twice_m)
        least: dict[int, str] = {}
        for x, c in zip(ids, labels, strict=True):
            least.setdefault(c, x)
        return pa.table({"id": ids, "lead": [least[c] for c in labels]})

    grouped = parts.groupBy("component").applyInArrow(run, "id string, lead string")
    return _numbered(nodes, grouped)


def _numbered(nodes: DataFrame, leads: DataFrame) -> DataFrame:
    """(id, cluster) of (id, lead: the lowest member of its cluster): dense numbers in the leads' order; a node without a lead is its own.

    Only the leads are put in one order: sorted by ranges, numbered in each, and the ranges' sizes added up."""
    out = cut(nodes.select("id").join(leads, "id", "left").withColumn("lead", F.coalesce("lead", "id")))
    ranged = cut(out.select("lead").distinct().repartitionByRange("lead").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    numbers = ranged.join(F.broadcast(before), "_p").withColumn("cluster", (F.row_number().over(Window.partitionBy("_p").orderBy("lead")) - 1 + F.col("_b")).cast("long"))
    return out.join(numbers.select("lead", "cluster"), "lead").select("id", "cluster")


def spread_clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, cluster) by local moves on the cluster, for components too large for one task.

    In a round every node sees the communities of its neighbours and half of the nodes (by a hash that changes with the round) move
    to the best strictly better one, ties to the lowest. Moves of a round don't see each other and communities aren't contracted, so clusters may
    differ from ``clusters``; ``modularity`` says by how much. Ends after four rounds without a move, or ``rounds``."""
    e = with_both_ends(edges, nodes).where("src <> dst")
    both = cut(e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct())
    twice_m = float(both.count())
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("deg"))
    labels = cut(degree.select(F.col("u").alias("id"), "deg", F.col("u").alias("c")))
    still = 0
    for r in range(rounds):
        total = labels.groupBy("c").agg(F.sum("deg").alias("tot"))
        links = both.join(labels.select(F.col("id").alias("v"), F.col("c").alias("to")), "v").groupBy("u", "to").agg(F.count(F.lit(1)).alias("k"))
        # A node's own community is always among the choices, with no link if need be.
        choices = links.unionByName(labels.select(F.col("id").alias("u"), F.col("c").alias("to"), F.lit(0).cast("long").alias("k"))).groupBy("u", "to").agg(F.max("k").alias("k"))
        choices = choices.join(labels.withColumnRenamed("id", "u"), "u").join(total.withColumnRenamed("c", "to"), "to")
        own = F.col("to") == F.col("c")
        gain = F.col("k") - (F.col("tot") - F.when(own, F.col("deg")).otherwise(0)) * F.col("deg") / F.lit(twice_m)
        best = choices.withColumn("gain", gain).groupBy("u").agg(F.max(F.when(own, F.col("gain"))).alias("stay"), F.max("gain").alias("top"), F.min_by("to", F.struct(-F.col("gain"), F.col("to"))).alias("to"))
        moves = best.where((F.col("top") > F.col("stay") + 1e-9) & (F.pmod(F.xxhash64(F.lit(r), "u"), F.lit(2)) == 0)).select(F.col("u").alias("id"), "to")
        moves = cut(moves)
        still = still + 1 if moves.isEmpty() else 0
        if still == 4:
            break
        labels = cut(labels.join(moves, "id", "left").select("id", "deg", F.coalesce("to", "c").alias("c")))
    leads = labels.groupBy("c").agg(F.min("id").alias("lead"))
    return _numbered(nodes, labels.join(leads, "c").select("id", "lead"))


def modularity(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """One row: the modularity of clusters (id, cluster) on the simple undirected graph."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    c = cluster.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), cluster.select(F.col("id").alias("b"), F.col("cluster").alias("cb"))
    j = pairs.join(c[0], "a").join(c[1], "b")
    ends = j.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    inner = j.agg(F.count_if(F.col("ca") == F.col("cb")).alias("inside"), F.count(F.lit(1)).alias("m"))
    return ends.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("sq")).join(F.broadcast(inner), F.lit(True)).select((F.col("inside") / F.col("m") - F.col("sq") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def bridges(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """Edges whose ends lie in different clusters."""
    a = cluster.select(F.col("id").alias("src"), F.col("cluster").alias("src_cluster"))
    b = cluster.select(F.col("id").alias("dst"), F.col("cluster").alias("dst_cluster"))
    return edges.join(a, "src").join(b, "dst").where("src_cluster >= 0 AND dst_cluster >= 0 AND src_cluster <> dst_cluster")
