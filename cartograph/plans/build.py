"""From a corpus to the graph: files, manifests and a history become nodes, edges and counted gaps.

Everything is a join on equal keys or an aggregation; what neither a file nor a manifest explains is a gap, never a guess.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.functions import classify
from cartograph.functions.text import capitalised, counted
from cartograph.operators import graph, history, resolve
from cartograph.plans import imports as I
from cartograph.plans.imports import ancestors, folder_of, join_path, normal_path
from cartograph.session import cut
from cartograph.sources import extract, manifests

# Prefixes of ids by kind.
MODULE, SERVICE, INTERFACE, DATA, REFERENCE, PIPELINE = "/modules/", "/services/", "/interfaces/", "/data/", "/references/", "/pipelines/"
#: Steps named in a pipeline's summary.
STEPS = 8

_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def joined(values: Column, sep: str = ", ") -> Column:
    """Distinct sorted values as text, '' for none."""
    return F.array_join(graph.set_normalise(values), sep)


def attributes(**values: Column) -> Column:
    """A map of the values that aren't empty."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(v.cast("string"), F.lit("")).alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"] != ""))


def tags(*values: Column | str) -> Column:
    cols = [F.lit(v) if isinstance(v, str) else v for v in values]
    return F.array_compact(F.array(*cols))


def wanted(df: DataFrame, kind: str, prefix: str, key: Column, name: Column, **more: Column) -> DataFrame:
    """Rows for ``assign_ids`` with a node's other columns."""
    text = {c: more.get(c, F.lit("")).alias(c) for c in ("title", "description", "path", "lang")}
    lists = {c: more.get(c, _empty()).alias(c) for c in ("tags", "files", "exports")}
    attrs = more.get("attrs", F.create_map().cast("map<string,string>")).alias("attrs")
    return df.select(F.lit(kind).alias("kind"), F.lit(prefix).alias("prefix"), key.alias("key"), name.alias("name"), *text.values(), *lists.values(), attrs)


def named_module(folders: DataFrame, **more: Column) -> DataFrame:
    """Rows for ``assign_ids`` of directories with source."""
    folder = F.col("folder")
    return wanted(folders, "Module", MODULE, folder, F.when(folder == "", "root").otherwise(F.regexp_extract(folder, "([^/]*)$", 1)), path=folder, **more)


def module_nodes(code: DataFrame) -> DataFrame:
    """Directories with source. code: extraction's facts (null where no reader is) with folder and is_test."""
    f = code.select("path", "lang", "folder", "is_test", "package", "symbols", "entrypoints", "incomplete")
    shown = F.transform(F.filter(F.coalesce("symbols", F.array().cast(code.schema["symbols"].dataType)), lambda s: s["exported"]), lambda s: F.when(s["recv"] != "", F.concat(s["recv"], F.lit("."), s["name"])).otherwise(s["name"]))
    f = f.withColumn("shown", F.when(~F.col("is_test"), shown).otherwise(_empty()))
    votes = f.withColumn("_header", (F.col("lang") == "c") & F.endswith("path", F.lit(".h")))
    # The language of most files; headers count only where there is nothing else.
    lang = votes.groupBy("folder", "lang").agg(F.count_if(~F.col("_header")).alias("n"), F.count(F.lit(1)).alias("k")).groupBy("folder").agg(F.min_by("lang", F.struct(-F.col("n"), F.when(F.col("n") == 0, F.lit(1)).otherwise(F.lit(0)), F.col("lang"))).alias("lang"))
    g = f.groupBy("folder").agg(
        graph.set_normalise(F.collect_list("path")).alias("files"), graph.set_normalise(F.flatten(F.collect_list("shown"))).alias("exports"),
        joined(F.flatten(F.collect_list(F.coalesce("entrypoints", _empty())))).alias("eps"), F.coalesce(F.min_by(F.when(F.col("package") != "", F.col("package")), F.when(F.col("package") != "", F.col("path"))), F.lit("")).alias("package"), F.count_if("incomplete").alias("partial"),
    ).join(lang, "folder")
    base = F.regexp_extract("folder", "([^/]*)$", 1)
    n, x = F.size("files"), F.size("exports")
    what = F.concat_ws(
        "; ", counted(n, F.concat("lang", F.lit(" file"))), F.when(x > 0, counted(x, F.lit("exported symbol"))), F.when(F.col("eps") != "", F.concat(F.lit("entrypoint "), "eps")), F.when((F.col("package") != "") & (F.col("package") != base), F.concat(F.lit("package "), "package"))
    )
    return named_module(
        g, title=F.when(F.col("folder") == "", "(repository root)").otherwise(F.col("folder")), lang=F.col("lang"), files=F.col("files"), exports=F.col("exports"),
        description=F.concat(capitalised(what), F.lit(".")), tags=tags(F.when(F.col("eps") != "", F.lit("entrypoint")), F.when(F.col("partial") > 0, F.lit("partial-extraction"))),
        attrs=attributes(package=F.col("package"), entrypoints=F.col("eps"), files=n, exported=x, incomplete_files=F.when(F.col("partial") > 0, F.col("partial"))),
    )


def external_nodes(facts: DataFrame) -> DataFrame:
    """Declared dependencies but for the corpus's own packages and targets."""
    d = facts.where("fact = 'dep'")
    siblings = facts.where("fact = 'module' AND ecosystem = 'npm'").select(F.lit("npm").alias("ecosystem"), "name").union(facts.where("kind = 'cmake' AND fact = 'target'").select(F.lit("cmake"), "name")).distinct()
    local = d.where(F.try_element_at("attrs", F.lit("local")) == "true").select("ecosystem", "name").distinct()
    source = F.coalesce(F.try_element_at("attrs", F.lit("source")), F.lit(""))
    g = d.join(siblings.union(local), ["ecosystem", "name"], "left_anti").groupBy("ecosystem", "name").agg(
        joined(F.collect_list("value")).alias("version"), graph.set_normalise(F.collect_list("scope")).alias("scopes"), joined(F.collect_list(source)).alias("source"), graph.set_normalise(F.collect_list("path")).alias("files")
    )
    direct = (F.size("scopes") > 1) | ~F.array_contains("scopes", "indirect")
    return wanted(
        g, "External", REFERENCE, F.concat_ws("/", "ecosystem", "name"), F.concat("ecosystem", F.lit("-"), "name"), title=F.col("name"), files=F.col("files"),
        description=F.concat("ecosystem", F.lit(" dependency "), "name", F.when(F.col("version") != "", F.concat(F.lit(" ("), "version", F.lit(")"))).otherwise("")),
        tags=tags("external", F.col("ecosystem"), F.when(direct, F.lit("direct")), F.when(F.col("source") != "", F.lit("unregistered-source"))), attrs=attributes(ecosystem=F.col("ecosystem"), name=F.col("name"), version=F.col("version"), scope=F.array_join("scopes", ", "), source=F.col("source")),
    )


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def services(facts: DataFrame) -> DataFrame:
    """Service facts that become nodes: values of a chart alone are none."""
    return facts.where((F.col("fact") == "service") & (F.col("name") != "") & (_attr("kind") != "helm-values"))


def service_nodes(facts: DataFrame) -> DataFrame:
    """Services by name over all manifests, with the names of secrets that the same files give them."""
    s = services(facts)
    secrets = facts.where("fact = 'secret'").select("path", F.col("scope").alias("service"), F.col("name").alias("secret"))
    per = s.select("path", F.col("name").alias("service")).distinct().join(secrets, ["path", "service"]).groupBy(F.col("service").alias("name")).agg(joined(F.collect_list("secret")).alias("secrets"))

    def many(name: str) -> Column:
        return joined(F.flatten(F.collect_list(F.split(_attr(name), ", ")))).alias(name)

    g = s.groupBy("name").agg(
        joined(F.flatten(F.collect_list(F.split("value", ", ")))).alias("image"), joined(F.flatten(F.collect_list("items"))).alias("ports"), many("env"), many("volumes"), many("kind"), many("namespace"), F.max(_attr("build")).alias("build"), F.max(_attr("replicas")).alias("replicas"), graph.set_normalise(F.collect_list("path")).alias("files")
    )
    g = g.join(per, "name", "left").withColumn("secrets", F.coalesce("secrets", F.lit("")))
    text = F.concat_ws(
        "; ", F.concat(F.when(F.col("kind") == "", "Service").otherwise(F.replace("kind", F.lit(", "), F.lit("/"))), F.lit(" "), "name"), F.when(F.col("image") != "", F.concat(F.lit("image "), "image")).when(F.col("build") != "", F.concat(F.lit("built from "), "build")),
        F.when(F.col("ports") != "", F.concat(F.lit("ports "), "ports")), F.when(F.col("secrets") != "", F.concat(F.lit("reads secrets "), "secrets")),
    )
    return wanted(
        g, "Service", SERVICE, F.col("name"), F.col("name"), title=F.col("name"), files=F.col("files"), description=F.concat(text, F.lit(".")),
        tags=tags(F.when(F.col("secrets") != "", F.lit("reads-secrets")), F.when(F.array_contains(F.split("kind", ", "), "Secret"), F.lit("secret"))),
        attrs=attributes(image=F.col("image"), ports=F.col("ports"), env=F.col("env"), volumes=F.col("volumes"), workload=F.col("kind"), namespace=F.col("namespace"), build=F.col("build"), replicas=F.col("replicas"), secret_refs=F.col("secrets")),
    )


def interface_nodes(facts: DataFrame) -> DataFrame:
    """One node per contract file, the names by kind as attributes."""
    c = facts.where("kind IN ('proto', 'openapi', 'graphql')")
    by_kind = c.where("fact = 'contract'").groupBy("path", "kind", "scope").agg(joined(F.collect_list("name")).alias("names"), F.count_distinct("name").alias("k"))
    g = by_kind.groupBy("path", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scope", "names")))).alias("by"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scope", "k"))), lambda x: counted(x["k"], x["scope"])), ", ").alias("said"))
    g = g.join(c.where("fact = 'module'").groupBy("path").agg(F.first("name").alias("package")), "path", "left").join(c.groupBy("path").agg(F.every("complete").alias("whole")), "path")
    base = F.regexp_extract("path", "([^/]*)$", 1)
    name = F.when(F.coalesce("package", F.lit("")) != "", F.concat("package", F.lit(" ("), base, F.lit(")"))).otherwise(base)
    return wanted(
        g, "Interface", INTERFACE, F.col("path"), name, title=name, path=F.col("path"), files=F.array("path"), tags=tags(F.col("kind"), F.when(~F.col("whole"), F.lit("partial-extraction"))), attrs=F.map_concat(attributes(format=F.col("kind"), package=F.col("package")), "by"),
        description=F.concat(capitalised(F.col("kind")), F.lit(" definition: "), "said", F.lit(".")),
    )


def data_nodes(facts: DataFrame) -> DataFrame:
    """Tables that migrations name, with how many migrations and whether one of them takes away."""
    m = facts.where("fact = 'migration'").select("path", F.trim(F.concat_ws(" ", "value", "name")).alias("label"), (_attr("destructive") == "true").alias("drops"), F.explode("items").alias("table"))
    g = m.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.some("drops").alias("drops"), graph.set_normalise(F.collect_list("path")).alias("files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "label"))), lambda x: x["label"]), "; ").alias("past"))
    return wanted(
        g, "Data", DATA, F.col("table"), F.col("table"), title=F.col("table"), files=F.col("files"), tags=tags("table", F.when(F.col("drops"), F.lit("destructive-history"))), attrs=attributes(table=F.col("table"), migrations=F.col("n"), history=F.col("past")),
        description=F.concat(F.lit("Table "), "table", F.lit(", changed by "), counted(F.col("n"), F.lit("migration")), F.when(F.col("drops"), "; at least one of them takes away").otherwise("")),
    )


def jobs(facts: DataFrame) -> DataFrame:
    """Jobs with their node key and name: qualified by the workflow, or by its path where that has no plain name."""
    name = F.when(F.contains("name", F.lit("${{")), F.col("value")).otherwise(F.col("name"))
    flow = F.when((_attr("workflow") == "") | F.contains(_attr("workflow"), F.lit("${{")), F.col("path")).otherwise(_attr("workflow"))
    j = facts.where("fact = 'job'").withColumn("title", F.concat(flow, F.lit(" "), name))
    return j.withColumn("key", F.concat("path", F.lit("#"), "value"))


def pipeline_nodes(facts: DataFrame) -> DataFrame:
    """One node per job, its first steps' names in order."""
    label = F.when(F.col("name") == _attr("uses"), F.regexp_replace("name", "@[^@]*$", "")).otherwise(F.col("name"))
    steps = facts.where("fact = 'step' AND name <> ''").groupBy("path", F.col("scope").alias("value")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", label.alias("name")))), lambda x: x["name"]).alias("names"))
    j = jobs(facts).join(steps, ["path", "value"], "left").withColumn("names", F.coalesce("names", _empty()))
    more = F.size("names") - STEPS
    runs = F.concat(F.array_join(F.slice("names", 1, STEPS), " → "), F.when(more > 0, F.concat(F.lit(" → +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    n = F.coalesce(_attr("steps").try_cast("int"), F.lit(0))
    said = F.concat(
        F.lit("CI job "), "name", F.when(_attr("workflow") != "", F.concat(F.lit(" in the "), _attr("workflow"), F.lit(" workflow"))).otherwise(""), F.when(_attr("uses") != "", F.concat(F.lit(", calling "), _attr("uses"))).when(n > 0, F.concat(F.lit(", "), counted(n, F.lit("step")))).otherwise(""),
        F.when(_attr("gate") == "true", "; guards what is merged").otherwise(""),
    )
    return wanted(
        j, "Pipeline", PIPELINE, F.col("key"), F.col("title"), title=F.col("title"), path=F.col("path"), files=F.array("path"), description=said, tags=tags(F.when(_attr("gate") == "true", F.lit("gate"))),
        attrs=attributes(workflow=_attr("workflow"), job=F.col("name"), steps=n, runner=_attr("runner"), uses=_attr("uses"), permissions=_attr("permissions"), needs=F.array_join("items", ", "), runs=runs),
    )


def document_nodes(facts: DataFrame) -> DataFrame:
    """Decision records and rules for agents that state a rule."""
    d = facts.where("kind IN ('adr', 'agent-rules')")
    g = d.where("fact = 'rule'").groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), joined(F.collect_list("name")).alias("sections"))
    g = g.join(d.where("fact = 'module'").groupBy("path").agg(F.first("name").alias("named"), F.first("value").alias("number"), F.first(_attr("status")).alias("status")), "path", "left")
    base = F.regexp_extract("path", "([^/]*)$", 1)
    name = F.when((F.col("kind") == "adr") & (F.col("named") != ""), F.concat(F.lit("ADR"), F.when(F.col("number") != "", F.concat(F.lit(" "), "number")).otherwise(""), F.lit(": "), "named")).otherwise(base)
    state = F.when(F.col("kind") == "adr", F.col("status"))
    return wanted(
        g, "Document", REFERENCE, F.col("path"), name, title=name, path=F.col("path"), files=F.array("path"), tags=tags(F.col("kind"), "constraint", F.lower(F.when(state != "", state))), attrs=attributes(rules=F.col("n"), status=state, number=F.when(F.col("kind") == "adr", F.col("number")), sections=F.col("sections")),
        description=F.concat(F.when(F.col("kind") == "adr", F.concat(F.lit("Decision"), F.when(state != "", F.concat(F.lit(" ("), state, F.lit(")"))).otherwise(""))).otherwise("Constraints"), F.lit(", "), counted(F.col("n"), F.lit("rule")), F.lit(" in "), base, F.lit(".")),
    )


def edge(src: Column | str, dst: Column | str, kind: Column, path: Column, weight: int = 0) -> list[Column]:
    src, dst = (F.col(c) if isinstance(c, str) else c for c in (src, dst))
    return [src.alias("src"), dst.alias("dst"), kind.alias("kind"), F.lit("extracted").alias("confidence"), F.lit(weight).cast("long").alias("weight"), path.alias("source"), F.xxhash64(path).alias("ord")]


def nearest(rows: DataFrame, folder: Column, modules: DataFrame, name: str) -> DataFrame:
    """``rows`` with the module of the nearest directory at or above ``folder`` (null where none)."""
    dirs = rows.select(folder.alias("_at")).distinct()
    hit = dirs.select("_at", F.posexplode(ancestors(F.col("_at"))).alias("_k", "folder")).join(modules, "folder").groupBy("_at").agg(F.min_by("id", "_k").alias(name))
    return rows.withColumn("_at", folder).join(hit, "_at", "left").drop("_at")


def dependency_edges(facts: DataFrame, externals: DataFrame, modules: DataFrame) -> DataFrame:
    """From the module nearest to a manifest to each dependency: an external, else a package or target of the corpus, else the local directory."""
    d = nearest(facts.where("fact = 'dep'"), folder_of(F.col("path")), modules, "src").where("src IS NOT NULL")
    d = d.join(externals.select("ecosystem", "name", F.col("id").alias("ext")), ["ecosystem", "name"], "left")
    own = facts.where("fact = 'module' AND ecosystem = 'npm'").select(F.lit("npm").alias("ecosystem"), "name", folder_of(F.col("path")).alias("home"))
    own = own.union(facts.where("kind = 'cmake' AND fact = 'target'").select(F.lit("cmake"), "name", folder_of(F.col("path")))).groupBy("ecosystem", "name").agg(F.min("home").alias("home"))
    d = d.join(own, ["ecosystem", "name"], "left")
    at = F.coalesce("home", F.when(_attr("local") == "true", normal_path(F.when(F.col("ecosystem").isin("crates.io", "rubygems", "helm"), join_path(folder_of(F.col("path")), _attr("at"))).otherwise(_attr("at")))))
    d = nearest(d.withColumn("_to", at), F.coalesce("_to", F.lit("\u0000")), modules, "_near")
    dst = F.coalesce("ext", F.when(F.col("_to").isNotNull(), F.col("_near")))
    return d.withColumn("_dst", dst).where("_dst IS NOT NULL").select(*edge("src", "_dst", F.lit("configures"), F.col("path")))


def service_edges(facts: DataFrame, nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """What a service depends on, the module it is built from, and the one service's interfaces."""
    s = nodes.where("kind = 'Service'").select(F.col("key").alias("name"), "id")
    deps = facts.where("fact = 'service_dep'").join(s, "name").join(s.select(F.col("name").alias("value"), F.col("id").alias("to")), "value")
    out = deps.select(*edge("id", "to", F.lit("deploys"), F.col("path")))
    built = services(facts).where(_attr("build") != "").join(s, "name").withColumn("folder", normal_path(join_path(folder_of(F.col("path")), _attr("build"))))
    # A context may name its container file.
    spelled = built.select("path", F.col("id").alias("from"), F.explode(F.array_distinct(F.array("folder", folder_of(F.col("folder"))))).alias("folder"), F.col("folder").alias("given"))
    met = spelled.join(modules, "folder").groupBy("path", "from", "given").agg(F.max_by("id", F.length("folder")).alias("id"))
    out = out.unionByName(met.select(*edge("from", "id", F.lit("deploys"), F.col("path"))))
    one = s.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("svc")).where("n = 1")
    faces = nodes.where("kind = 'Interface'").select("id", "path").join(F.broadcast(one), F.lit(True))
    return out.unionByName(faces.select(*edge("svc", "id", F.lit("implements"), F.col("path"))))


def pipeline_edges(facts: DataFrame, nodes: DataFrame, externals: DataFrame) -> DataFrame:
    """A needed job precedes; a job uses the actions of its steps."""
    p = nodes.where("kind = 'Pipeline'").select("key", "id")
    j = jobs(facts).join(p, "key")
    need = j.select("path", F.col("id").alias("to"), F.explode("items").alias("need")).withColumn("key", F.concat("path", F.lit("#"), "need")).join(p, "key")
    out = need.select(*edge("id", "to", F.lit("precedes"), F.col("path")))
    uses = facts.where("fact = 'step'").select("path", F.col("scope").alias("value"), _attr("uses").alias("uses")).union(facts.where("fact = 'job'").select("path", "value", _attr("uses").alias("uses")))
    uses = uses.where("uses <> '' AND NOT startswith(uses, './')").withColumn("name", F.regexp_replace("uses", "@[^@]*$", "")).withColumn("key", F.concat("path", F.lit("#"), "value"))
    act = externals.where("ecosystem = 'github-actions'").select("name", F.col("id").alias("ext"))
    return out.unionByName(uses.join(p, "key").join(act, "name").select(*edge("id", "ext", F.lit("configures"), F.col("path"))))


def document_edges(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """Rules for agents document the modules at and below their directory."""
    d = nodes.where(F.array_contains("tags", "agent-rules")).select(F.col("id").alias("doc"), "path", folder_of(F.col("path")).alias("scope"))
    below = modules.select("id", F.explode(ancestors(F.col("folder"))).alias("scope"))
    return d.join(below, "scope").select(*edge("doc", "id", F.lit("documents"), F.col("path")))


def owners(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """id, owners of modules at and below the literal directories of ownership rules; patterns are not approximated."""
    p = F.trim("name")
    o = facts.where("fact = 'owner'").where(~p.rlike(r"[*?\[\]!]")).select(F.regexp_replace(p, "^/|/$", "").alias("scope"), "items").where("scope <> ''")
    below = modules.select("id", F.explode(ancestors(F.col("folder"))).alias("scope"))
    return below.join(o, "scope").groupBy("id").agg(joined(F.flatten(F.collect_list("items"))).alias("owners"))


def test_edges(code: DataFrame, resolved: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that a directory of tests only imports (JVM tests: the module of their package) are tested by it."""
    source = code.select("path", "lang", "folder", "is_test")
    prod = source.where("NOT is_test").select("folder").distinct()
    tests = source.where("is_test").join(prod, "folder", "left_anti").join(modules.withColumnRenamed("id", "test"), "folder")
    named = code.where("package <> ''").select("path", "package").join(tests.where(F.col("lang").isin(*I.JVM)), "path")
    home = code.where("package <> ''").where(F.col("lang").isin(*I.JVM) & ~F.col("is_test")).select("package", "folder").join(modules, "folder").groupBy("package").agg(F.min("id").alias("id"))
    by_package = named.join(home, "package").where("id <> test").select("path", "test", "id")
    rest = tests.select("path", "test").join(by_package.select("path"), "path", "left_anti")
    imports = code.where("is_test").select("path", "lang", "folder", F.explode("imports.raw").alias("raw")).join(rest, "path")
    by_import = imports.join(resolved.where("internal AND target IS NOT NULL"), [*I.KEY]).select("path", "test", F.col("target").alias("id"))
    return by_package.unionByName(by_import).select(*edge("id", "test", F.lit("tested_by"), F.col("path"), 1))


def gap(df: DataFrame, what: str, name: Column, n: Column | None = None) -> DataFrame:
    """Rows, or what ``n`` counts of them, by name."""
    return df.groupBy(F.lit(what).alias("what"), name.alias("name")).agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"))


class Build:
    """The graph of files (path, class, lang, content, is_test) and, if given, of a history (``history`` changes).

    Each part is worked out when it is asked for, and what parts share once: ids and nodes need no imports, gaps no edges. Parts for kinds of manifests,
    languages or tests that the corpus doesn't have are left out of the plans."""

    def __init__(self, files: DataFrame, changes: DataFrame | None = None, include_vendored: bool = False):
        # Written once: classes are worked out once, and every reader below reads what it needs.
        kept = files.where(classify.analysed(F.col("path"), include_vendored))
        self.own = cut(kept.select("path", "class", "lang", "content", "is_test", *[c for c in ("truncated",) if c in files.columns]))
        self.changes = changes

    @cached_property
    def code(self) -> DataFrame:
        """Every source file with folder, is_test and extraction's facts, null where its language has no reader."""
        source = self.own.where("class = 'source' AND content <> ''").withColumn("folder", folder_of(F.col("path")))
        return cut(extract.extract(source.drop("class"), carry=("folder string", "is_test boolean")))

    @cached_property
    def facts(self) -> DataFrame:
        return cut(manifests.read_manifests(self.own.where("content IS NOT NULL").select("path", "content")).where("fact IS NOT NULL"))

    @cached_property
    def said(self) -> set[tuple[str, str]]:
        """Kinds and facts of the manifests."""
        return {(r.kind, r.fact) for r in self.facts.select("kind", "fact").distinct().collect()}

    def has(self, fact: str = "", *kinds: str) -> bool:
        return any((not fact or f == fact) and (not kinds or k in kinds) for k, f in self.said)

    @cached_property
    def seen(self):
        """Whether the source has tests, files not read in full, and queries of unknown tables."""
        return self.code.agg(F.coalesce(F.bool_or("is_test"), F.lit(False)).alias("tests"), F.coalesce(F.bool_or("incomplete"), F.lit(False)).alias("partial"), F.coalesce(F.bool_or(F.col("unnamed_queries") > 0), F.lit(False)).alias("unnamed")).first()

    def others(self) -> list[DataFrame]:
        """Nodes of manifests."""
        f = self.facts
        made = (
            ((("dep",),), external_nodes), ((("service",),), service_nodes), ((("", "proto", "openapi", "graphql"),), interface_nodes), ((("migration",),), data_nodes), ((("job",),), pipeline_nodes), ((("", "adr", "agent-rules"),), document_nodes),
        )
        return [nodes(f) for needs, nodes in made if all(self.has(*n) for n in needs)]

    @cached_property
    def full(self) -> DataFrame:
        every = module_nodes(self.code)
        for p in self.others():
            every = every.unionByName(p)
        return cut(resolve.assign_ids(every))

    @cached_property
    def ids(self) -> DataFrame:
        """The nodes' ids without what modules hold, unless the whole nodes are there."""
        if "full" in self.__dict__:
            return self.full
        every = named_module(self.code.select("folder").distinct())
        for p in self.others():
            every = every.unionByName(p)
        return cut(resolve.assign_ids(every.select("kind", "prefix", "key", "name", "path", "tags", "attrs")))

    @property
    def modules(self) -> DataFrame:
        return self.ids.where("kind = 'Module'").select(F.col("path").alias("folder"), "id")

    @property
    def externals(self) -> DataFrame:
        return self.ids.where("kind = 'External'").select(F.col("attrs")["ecosystem"].alias("ecosystem"), F.col("attrs")["name"].alias("name"), "id")

    @cached_property
    def refs(self) -> DataFrame:
        """what (imports, reads, writes), lang, folder, raw: what the files of a directory name, how often (n), and the least ``ord`` of a file that does."""
        named = F.concat(
            F.transform(F.coalesce("imports.raw", _empty()), lambda x: F.struct(F.lit("imports").alias("what"), F.col("lang").alias("lang"), x.alias("raw"))),
            F.transform(F.coalesce("queries", F.array().cast(self.code.schema["queries"].dataType)), lambda q: F.struct(q["access"].alias("what"), F.lit("").alias("lang"), q["table"].alias("raw"))),
        )
        r = self.code.select("path", "folder", F.explode(named).alias("r")).select(F.xxhash64("path").alias("ord"), "folder", "r.*")
        # Without texts among the sums Spark needs no sorting for them.
        return cut(r.groupBy("what", *I.KEY).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")))

    @cached_property
    def resolved(self) -> DataFrame:
        names = self.refs.where("what = 'imports'").select(*I.KEY)
        return cut(I.resolve_names(names, self.code.select("path", "lang", "folder", "is_test"), self.modules, self.externals, self.code.select("path", "package"), self.facts, self.said))

    @property
    def linked(self) -> DataFrame:
        return self.refs.where("what = 'imports'").join(self.resolved, [*I.KEY])

    @property
    def known(self) -> DataFrame:
        """Uses of tables with the table's id, null for unknown ones."""
        return self.refs.where("what <> 'imports'").withColumnRenamed("raw", "key").join(self.ids.where("kind = 'Data'").select("key", "id"), "key", "left")

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, kind, confidence, weight, source."""
        facts, modules, externals = self.facts, self.modules, self.externals
        ends = self.linked.where("target IS NOT NULL").select("folder", "target", F.lit("imports").alias("kind"), F.col("n").alias("weight"), "ord")
        ends = ends.unionByName(self.known.where("id IS NOT NULL").select("folder", F.col("id").alias("target"), F.col("what").alias("kind"), F.lit(0).cast("long").alias("weight"), "ord"))
        # The first file by ord of each end.
        firsts = self.code.select("path", F.xxhash64("path").alias("ord")).join(self.refs.select("ord").distinct(), "ord").groupBy("ord").agg(F.min("path").alias("source"))
        edges = ends.join(firsts, "ord").join(modules, "folder").select(F.col("id").alias("src"), F.col("target").alias("dst"), "kind", F.lit("extracted").alias("confidence"), "weight", "source", "ord")
        parts = [dependency_edges(facts, externals, modules)] if self.has("dep") else []
        parts += [service_edges(facts, self.ids, modules)] if self.has("service") else []
        parts += [pipeline_edges(facts, self.ids, externals)] if self.has("job") else []
        parts += [document_edges(self.ids, modules)] if self.has("", "agent-rules") else []
        parts += [test_edges(self.code, self.resolved, modules)] if self.seen.tests else []
        for p in parts:
            edges = edges.unionByName(p)
        merged = graph.merge_edges(edges)
        return merged if self.changes is None else merged.unionByName(self.history[1])

    @cached_property
    def gaps(self) -> DataFrame:
        """what, name, n."""
        name = F.concat_ws(" ", "lang", "raw")
        gaps = gap(self.linked.where("target IS NULL AND internal"), "unlinked import", name, F.col("n")).unionByName(gap(self.linked.where("target IS NULL AND NOT internal AND NOT shipped"), "unresolved import", name, F.col("n")))
        gaps = gaps.unionByName(gap(self.known.where("id IS NULL"), "unknown table", F.col("key"), F.col("n")))
        if self.seen.unnamed:
            gaps = gaps.unionByName(self.code.where("unnamed_queries > 0").select(F.lit("interpolated table").alias("what"), F.col("path").alias("name"), F.col("unnamed_queries").cast("long").alias("n")))
        if self.seen.partial:
            gaps = gaps.unionByName(gap(self.code.where("incomplete"), "incomplete source", F.col("path")))
        gaps = gaps.unionByName(gap(self.facts.where("NOT complete").select("path").distinct(), "incomplete manifest", F.col("path")))
        return gaps.unionByName(manifests.unread(self.own).select(F.lit("unread manifest").alias("what"), F.col("key").alias("name"), "n"))

    @cached_property
    def history(self) -> tuple[DataFrame, DataFrame]:
        return history_attributes(self.changes, self.modules)

    @cached_property
    def nodes(self) -> DataFrame:
        """id, kind, title, description, path, lang, tags, attrs, files, exports."""
        full, extra = self.full, None
        if self.has("owner"):
            extra = owners(self.facts, self.modules).select("id", attributes(owners=F.col("owners")).alias("more"))
        if self.changes is not None:
            extra = self.history[0] if extra is None else extra.unionByName(self.history[0])
        if extra is not None:
            extra = extra.groupBy("id").agg(F.map_from_entries(F.array_sort(F.flatten(F.collect_list(F.map_entries("more"))))).alias("more"))
            full = full.join(extra, "id", "left").withColumn("attrs", F.when(F.col("more").isNotNull(), F.map_concat("attrs", "more")).otherwise(F.col("attrs")))
        return full.select("id", "kind", "title", "description", "path", "lang", "tags", "attrs", "files", "exports")


def build(files: DataFrame, changes: DataFrame | None = None, include_vendored: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, gaps) of ``Build``."""
    b = Build(files, changes, include_vendored)
    return b.nodes, b.edges, b.gaps


def history_attributes(changes: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, more: what the history says of each module; co-change edges between nearest modules)."""
    folder = folder_of(F.col("path"))
    dirs = history.dir_history(changes, folder)
    top = history.top_author(changes.select("ord", folder.alias("dir"), "author").distinct(), "dir")
    h = dirs.join(top.select("dir", "author", "share_percent"), "dir").join(modules.withColumnRenamed("folder", "dir"), "dir")
    share = F.concat(F.col("share_percent").cast("string"), F.lit("%"))
    attrs = h.select("id", attributes(commits=F.col("commits"), lines_added=F.col("insertions"), lines_removed=F.col("deletions"), first_commit=F.col("first"), last_commit=F.col("last"), top_author=F.col("author"), top_author_share=share).alias("more"))
    pairs, _ = history.co_change(changes, folder)
    touched = changes.select(folder.alias("dir")).distinct()
    module_of = nearest(touched, F.col("dir"), modules, "module").where("module IS NOT NULL")
    co = history.co_change_edges(pairs, module_of)
    return attrs, co.select("src", "dst", "kind", F.lit("extracted").alias("confidence"), F.col("weight").cast("long").alias("weight"), F.lit("").alias("source"))
