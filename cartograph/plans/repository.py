"""Whole runs over a repository: analyse a tree, write its bundle, show its graph, compare two revisions, verify what is committed."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.operators import diff, graph, history, practice, report, verify
from cartograph.plans.build import build
from cartograph.session import cut
from cartograph.sinks import bundle
from cartograph.sources import config, files, gitlog, manifests

BUNDLE = "cartograph-map"


@dataclass
class Analysis:
    files: DataFrame
    skips: DataFrame
    facts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    gaps: DataFrame
    clusters: DataFrame
    findings: DataFrame
    commit: str


def analyse(spark: SparkSession, root: str, settings: config.Config | None = None, spans: report.Spans | None = None) -> Analysis:
    """Read a tree and its history (where it is a git repository) and build its graph."""
    c, spans = settings or config.load(root), spans or report.Spans()
    with spans.stage("files"):
        tree, skips = files.read_corpus(spark, root, [f"/{BUNDLE}/", *c.ignore], c.include_vendored)
        tree = cut(tree)
    changes = conventions = releases = None
    commit = ""
    if not c.no_history:
        with spans.stage("history"):
            log, why = gitlog.read_repository(spark, root, c.max_commits or gitlog.CAP)
            if not why:
                log = cut(log)
                moves = log.where("old_path <> ''").select("ord", "pos", F.col("old_path").alias("old"), F.col("path").alias("new"))
                changes = cut(history.fold_renames(log.where("path IS NOT NULL"), moves))
                conventions = history.conventions(log.select("ord", "subject").distinct())
                releases = gitlog.releases(spark, root)
                commit = gitlog.revision(root, "HEAD")
    with spans.stage("graph"):
        nodes, edges, gaps = (cut(x) for x in build(tree, changes, c.include_vendored))
        clusters = cut(graph.clusters(nodes, edges))
    facts = cut(manifests.read_manifests(tree.where("content IS NOT NULL").select("path", "content")))
    findings = cut(practice.analyse(facts, tree, conventions, releases, BUNDLE))
    return Analysis(tree, skips, facts, nodes, edges, gaps, clusters, findings, commit)


def rendered(a: Analysis) -> tuple[DataFrame, dict[str, str]]:
    """(pages of nodes, other files of the bundle by name)."""
    extra = {
        "index.md": bundle.index_page(a.nodes), "hubs.md": bundle.hubs_page(graph.hubs(a.nodes, a.edges, 10)), "findings.md": bundle.findings_page(graph.islands(a.nodes, a.edges), graph.gate_share(a.nodes), a.gaps),
        "practices.md": bundle.practices_page(practice.render(a.findings)), "manifest.json": bundle.manifest_json(a.nodes, a.edges, a.commit),
    }
    return bundle.pages(a.nodes, a.edges), {k: v for k, v in extra.items() if v}


def write_bundle(a: Analysis, root: str, entry: str = "") -> dict[str, int]:
    """Write the bundle below ``root``; people's text stays. Counts of what was done."""
    at = Path(root) / BUNDLE
    pages, extra = rendered(a)
    log = at / "log.md"
    if entry or log.exists():
        old = log.read_text(encoding="utf-8") if log.exists() else None
        extra["log.md"] = bundle.log_page(old, entry) if entry else old
    return bundle.write(str(at), ((r.page, r.text) for r in pages.orderBy("page").toLocalIterator()), extra)


def show(a: Analysis, top: int = 10) -> str:
    """A text report: kinds, hubs, cycles, bridges, components, orphans, gaps; the first few of each (all for top <= 0)."""
    out = []

    def part(title: str, rows: DataFrame, line) -> None:
        n = rows.count()
        shown = rows.limit(top) if top > 0 else rows
        out.append(f"{title} ({n})")
        out.extend(f"  {line(r)}" for r in shown.toLocalIterator())
        if 0 < top < n:
            out.append(f"  and {n - top} more")

    part("kinds", graph.kind_counts(a.nodes).orderBy("kind"), lambda r: f"{r.kind}: {r.n}")
    part("hubs", graph.hubs(a.nodes, a.edges, 0), lambda r: f"{r.id}: {r.total} ({r.in_degree} in, {r.out_degree} out)")
    cycles = graph.cycles(a.edges.where("kind = 'imports'")).groupBy("cycle").agg(F.max("size").alias("size"), F.array_sort(F.collect_list("id")).alias("ids"))
    part("cycles", cycles.orderBy(F.desc("size"), "cycle"), lambda r: " -> ".join(r.ids[:6]) + (" ..." if len(r.ids) > 6 else ""))
    part("bridges", graph.bridges(a.edges, a.clusters).orderBy("src", "dst", "kind"), lambda r: f"{r.src} -> {r.dst} ({r.kind})")
    comps = graph.components(a.nodes, a.edges).groupBy("component").agg(F.max("size").alias("size"))
    part("components", comps.orderBy(F.desc("size"), "component"), lambda r: f"{r.component}: {r['size']}")
    part("orphans", graph.orphans(a.nodes, a.edges).orderBy("id"), lambda r: r.id)
    return "\n".join([*out, "gaps", *[f"  {x}" for x in report.lines(report.coverage(a.gaps))]]) + "\n"


def compare(spark: SparkSession, root: str, old: str, new: str, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes of nodes, changes of edges, one row of counts) between two revisions; both are looked up before any tree is checked out.

    Trees are checked out below ``folder``, which the workers read. Without a table of renames a move shows as a removal and an addition."""
    shas = [gitlog.revision(root, r) for r in (old, new)]
    found = []
    for sha in shas:
        with gitlog.snapshot(root, sha, folder) as tree:
            found.append(analyse(spark, tree, config.Config(no_history=True)))
    try:
        moved = gitlog.renames(spark, root, *shas)
        moved = moved.unionByName(diff.dir_renames(moved).toDF("old_path", "new_path"))
    except ValueError:
        moved = spark.createDataFrame([], "old_path string, new_path string")
    a, b = found
    pairs = cut(diff.pair_renames(a.nodes, b.nodes, moved.distinct()))
    nodes, edges = cut(diff.diff_nodes(a.nodes, b.nodes, pairs)), cut(diff.diff_edges(a.edges, b.edges, pairs))
    return nodes, edges, diff.summary(nodes, edges)


def verify_bundle(a: Analysis, root: str, as_of: bool = False) -> DataFrame:
    """Findings of the committed bundle against a fresh rendering; one finding where there is no bundle."""
    spark, at = a.nodes.sparkSession, Path(root) / BUNDLE
    disk = bundle.read_pages(str(at))
    if not disk:
        return spark.createDataFrame([("missing-bundle", "", f"no bundle at {BUNDLE}", "fail")], "kind string, page string, detail string, severity string")
    pages, extra = rendered(a)
    fresh = pages.unionByName(spark.createDataFrame([(k, v) for k, v in extra.items() if k.endswith(".md")], "page string, text string"))
    recorded, listed = None, spark.createDataFrame([], "page string")
    if (at / "manifest.json").exists():
        m = json.loads((at / "manifest.json").read_text(encoding="utf-8"))
        recorded, listed = m.get("commit", ""), spark.createDataFrame([(p,) for p in m.get("pages", [])], "page string")
    return verify.verify(cut(fresh), spark.createDataFrame(list(disk.items()), "page string, text string"), None, recorded, a.commit or None, as_of).unionByName(verify.page_list(pages, listed))
