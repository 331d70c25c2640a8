"""Manifests as rows: the first route that fits a path says which reader takes the file; a failed reader gives incomplete facts."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.sources import contracts, infra, packages
from cartograph.sources.facts import Fact, Out

Reader = Callable[[str, str, Out], None]

# Routes in order, each a kind, a pattern of paths, and its reader.
ROUTES: list[tuple[str, str, Reader]] = [
    ("lock", "(^|/)(" + "|".join(map(re.escape, contracts.LOCKS)) + ")$", contracts.lock),
    ("go.mod", r"(^|/)go\.(mod|work)$", packages.go_mod),
    ("package.json", r"(^|/)package\.json$", packages.package_json),
    ("pyproject", r"(^|/)pyproject\.toml$", packages.pyproject),
    ("requirements", r"(^|/)([\w.-]*requirements[\w.-]*\.(txt|in)|requirements/[\w.-]+\.(txt|in))$", packages.requirements),
    ("cargo", r"(^|/)Cargo\.toml$", packages.cargo),
    ("gem", r"(^|/)Gemfile$|\.gemspec$", packages.gemfile),
    ("composer", r"(^|/)composer\.json$", packages.composer),
    ("msbuild", r"\.(cs|fs|vb)proj$|(^|/)Directory\.(Build|Packages)\.(props|targets)$", packages.msbuild),
    ("solution", r"\.sln$", packages.solution),
    ("cmake", r"(^|/)CMakeLists\.txt$|\.cmake$", packages.cmake),
    ("bazel", r"(^|/)(BUILD|WORKSPACE|MODULE)(\.bazel)?$", packages.bazel),
    ("tsconfig", r"(^|/)(tsconfig|jsconfig)(\.[\w-]+)*\.json$", packages.tsconfig),
    ("makefile", r"(^|/)(GNU)?[Mm]akefile$|\.mk$", packages.makefile),
    ("containerfile", r"(?i)(^|/)(docker|container)file(\.[^/]*)?$|\.(docker|container)file$", infra.containerfile),
    ("compose", r"(^|/)(docker-)?compose([.-][\w.-]+)?\.ya?ml$", infra.compose),
    ("workflow", r"(^|/)\.github/workflows/[^/]+\.ya?ml$|(^|/)action\.ya?ml$", infra.workflow),
    ("helm-chart", r"(^|/)Chart\.ya?ml$", infra.helm_chart),
    ("helm-values", r"(^|/)values[\w.-]*\.ya?ml$", infra.helm_values),
    ("openapi", r"(?i)(^|/)(openapi|swagger)[\w.-]*\.(ya?ml|json)$|(^|/)openapi/.*\.(ya?ml|json)$", contracts.openapi),
    ("kubernetes", r"(^|/)(k8s|kubernetes|manifests|deploy|templates)/.*\.ya?ml$", infra.kubernetes),
    ("terraform", r"\.(tf|tfvars)$", infra.terraform),
    ("proto", r"\.proto$", contracts.proto),
    ("graphql", r"\.(graphqls?|gql)$", contracts.graphql),
    ("migration", r"(^|/)(migrations?|migrate|db/migration)/.*\.(sql|py|rb|js|ts|php|go)$", contracts.migration),
    ("codeowners", r"(^|/)(CODEOWNERS|OWNERS)$", contracts.code_owners),
    ("adr", r"(?i)(^|/)(adrs?|decisions)/.*\.md$", contracts.decision),
    ("agent-rules", r"(^|/)(AGENTS|CLAUDE)\.md$", contracts.agent_rules),
]
# Extensions of files that are manifests only as migrations or container files (for a test that costs little).
CODE = ("py", "pyi", "go", "ts", "tsx", "js", "jsx", "mjs", "rs", "java", "kt", "c", "h", "cc", "cpp", "hpp", "m", "rb", "php", "cs", "sh", "sql", "vue")
#: A pattern of Java's that fits every path that a route fits, and few others.
_ANY_ROUTE = "(?isu)" + "|".join(f"(?:{re.sub(r'\[\\w[.-]*\]', '[^/]', pattern.removeprefix('(?i)'))})" for _, pattern, _ in ROUTES)
_ROUTES = [(kind, re.compile(pattern), reader) for kind, pattern, reader in ROUTES]


def route(path: str) -> tuple[str, Reader] | None:
    return next(((kind, reader) for kind, pattern, reader in _ROUTES if pattern.search(path)), None)


def read(path: str, source: str) -> tuple[str, Out] | None:
    """(kind, facts) of a file; None where no route fits. A reader that fails leaves what it had and says so."""
    found = route(path)
    if found is None:
        return None
    kind, reader = found
    out = Out()
    try:
        reader(source, path, out)
    except (ValueError, ET.ParseError, AttributeError, TypeError, KeyError, IndexError, RecursionError):
        out.complete = False
    return kind, merged(out)


def merged(out: Out) -> Out:
    """Sorted facts; equal ones once, at their first line; a dependency named twice in a scope keeps the spelled-out version."""
    best: dict[tuple, Fact] = {}
    for f in out:
        key = (f.fact, f.name, f.scope, f.ecosystem, f.attrs.get("local", "")) if f.fact == "dep" else (f.fact, f.name, f.value, f.scope, f.ecosystem, tuple(f.items), tuple(sorted(f.attrs.items())), f.line if f.fact in ("step", "rule") else 0)
        old = best.get(key)
        if old is None:
            best[key] = f
        else:
            old.value = old.value or f.value
            old.line = min(old.line, f.line)
            old.attrs = f.attrs | old.attrs
    new = Out(sorted(best.values(), key=lambda f: (f.fact, f.scope if f.fact == "step" else "", f.line if f.fact in ("step", "rule") else 0, f.name, f.ecosystem, f.scope, f.value)))
    new.complete = out.complete
    return new


SCHEMA = "path string, kind string, fact string, name string, value string, scope string, ecosystem string, line int, items array<string>, attrs map<string,string>, complete boolean"
_ARROW = pa.schema([
    *((c, pa.string()) for c in ("path", "kind", "fact", "name", "value", "scope", "ecosystem")), ("line", pa.int32()), ("items", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("complete", pa.bool_()),
])


def read_manifests(files: DataFrame) -> DataFrame:
    """SCHEMA rows of the manifests among files (path, content): one per fact; a manifest without any gives one row with a null fact.

    A null content counts as empty. Files that no route fits give no row (``unread`` counts them)."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in _ARROW.names]

            def flush(cols=cols):
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = read(path or "", content or "")
                if got is None:
                    continue
                kind, facts = got
                for f in facts or [Fact(None, None, None, None, None, None)]:
                    row = (path, kind, f.fact, f.name, f.value, f.scope, f.ecosystem, f.line, f.items, sorted(f.attrs.items()), facts.complete)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield flush()

    # What can be no manifest isn't sent to Python; routes decide about the rest.
    p = F.col("path")
    low = F.lower(p)
    plain = (F.length(p) == F.octet_length(p)) & F.substring_index(p, ".", -1).isin(*CODE) & ~low.contains("migrat") & ~low.contains("dockerfile") & ~low.contains("containerfile")
    return files.select("path", "content").where(~plain).where(F.col("path").rlike(_ANY_ROUTE)).mapInArrow(run, SCHEMA)


def manifest_kind(path):
    """The kind of manifest of a path as a Column; null where no route fits."""
    out = None
    for kind, pattern, _ in ROUTES:
        out = F.when(path.rlike(pattern), kind) if out is None else out.when(path.rlike(pattern), kind)
    return out


def unread(files: DataFrame, wanted: tuple[str, ...] = ("manifest", "infra", "contract")) -> DataFrame:
    """key, n: files (path, class) of classes that ought to be read and that no route fits, by extension."""
    from cartograph.functions import classify

    ext = classify.extension(F.col("path"))
    key = F.when(ext == "", classify.basename(F.col("path"))).otherwise(ext)
    return files.where(F.col("class").isin(*wanted) & manifest_kind(F.col("path")).isNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def read_dependencies(files: DataFrame) -> DataFrame:
    """path, name, version, scope, ecosystem, complete of dependencies and base images among files; a manifest without any gives a null name."""
    rows = read_manifests(files)
    dep = F.col("fact").isin("dep", "image")
    own = rows.where(dep).select("path", "name", F.col("value").alias("version"), F.when(F.col("fact") == "image", "runtime").otherwise(F.col("scope")).alias("scope"), F.when(F.col("fact") == "image", "image").otherwise(F.col("ecosystem")).alias("ecosystem"), "complete")
    none = rows.groupBy("path", "complete").agg(F.count_if(dep).alias("n")).where("n = 0")
    null = F.lit(None).cast("string")
    return own.unionByName(none.select("path", null.alias("name"), null.alias("version"), null.alias("scope"), null.alias("ecosystem"), "complete"))

