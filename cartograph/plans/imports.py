"""Resolution of imports: every language turns an import into ranked candidates, and candidates meet what the corpus has by equality.

A candidate is a key with a rank (lower is better). Keys: ``m:`` a directory of source, ``s:`` a source file without its extension, ``f:`` a file,
``y:`` a Python module below a root, ``p:`` a declared package or namespace, ``r:`` a path below a named root (Go module, workspace package,
PSR-4 prefix), ``a:`` a path alias of a directory, ``d:`` a dependency of an ecosystem, ``x:`` a dependency of any. What has no target is
``internal`` if its form says that it is the corpus's own (then it is unlinked), else it is unresolved unless the runtime ships it.

Prefix rules (Go modules, aliases, PSR-4, packages) explode the import's prefixes and join them by equality, so the work is the number of
segments and not of rules.

What an import means depends on its language, the directory it stands in and its spelling alone, so each such name (``KEY``) is resolved once, however many
files hold it; rules of languages and files of kinds that no name asks for are left out of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.functions import runtime
from cartograph.operators import resolve
from cartograph.session import cut

SCRIPT = ("typescript", "javascript", "vue", "svelte", "astro")
C_FAMILY = ("c", "cpp", "objc")
JVM = ("java", "kotlin")
# Ecosystems by language; directories that C and Ruby look into from each ancestor.
ECOSYSTEM = {"python": "pypi", **dict.fromkeys(SCRIPT, "npm"), "go": "go", "rust": "crates.io", "csharp": "nuget", "php": "composer", "ruby": "rubygems"}
C_ROOTS = ("include", "src", "", "lib", "source")
RUBY_ROOTS = ("", "lib")
#: What a resolution depends on.
KEY = ("lang", "folder", "raw")
#: Asked-for candidates that are broadcast to the corpus's files; more are joined by shuffle.
BROADCAST_CANDIDATES = 200_000
# Import names of Python packages that differ from the package's name.
PYTHON_NAMES = {
    "attrs": ("attr", "attrs"), "beautifulsoup4": ("bs4",), "opencv-python": ("cv2",), "python-dateutil": ("dateutil",), "python-dotenv": ("dotenv",), "protobuf": ("google",),
    "google-cloud-storage": ("google",), "grpcio": ("grpc",), "grpcio-tools": ("grpc_tools",), "pillow": ("PIL",), "pyyaml": ("yaml",), "pyjwt": ("jwt",), "pycryptodome": ("Crypto",),
    "pytest-cov": ("pytest_cov",), "scikit-learn": ("sklearn",), "scikit-image": ("skimage",), "msgpack-python": ("msgpack",), "typing-extensions": ("typing_extensions",),
    "setuptools": ("setuptools", "pkg_resources"), "mysqlclient": ("MySQLdb",), "psycopg2-binary": ("psycopg2",), "python-multipart": ("multipart",), "pymupdf": ("fitz",), "faiss-cpu": ("faiss",),
    "faiss-gpu": ("faiss",),
}


def folder_of(path: Column) -> Column:
    """The directory of a path, '' at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def normal_path(path: Column) -> Column:
    """A slash path without . and .. segments."""
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        F.split(path, "/"), empty,
        lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(walked, "/")


def ancestors(folder: Column) -> Column:
    """The directory and those above it, nearest first, '' last."""
    up = F.reverse(resolve.prefixes(folder))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(up, F.array(F.lit(""))))


def join_path(*parts: Column | str) -> Column:
    """Parts joined by slashes, empty ones left out."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.filter(F.array(*cols), lambda x: x != ""), "/")


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def keyed(kind: str, paths: Column) -> Column:
    return F.transform(paths, lambda p: F.concat(F.lit(f"{kind}:"), p))


def own_candidates(group: str, folder: Column, raw: Column) -> Column:
    """Keys that need nothing but the import and where it stands, best first, for a group of languages (a key of ``GROUPS``)."""
    none = F.array().cast("array<string>")
    up = ancestors(folder)
    beside = normal_path(join_path(folder, raw))
    if group == "python":
        dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
        dotted = F.regexp_replace(raw, r"^\.+", "")
        above = normal_path(join_path(folder, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))))
        relative = normal_path(join_path(above, F.translate(dotted, ".", "/")))
        parent = F.regexp_replace(dotted, r"\.?[^.]*$", "")
        named = F.flatten(F.transform(up, lambda r: F.array(F.concat(F.lit("y:"), r, F.lit("|"), dotted), F.concat(F.lit("y:"), r, F.lit("|"), F.when(parent == "", "\u0000").otherwise(parent)))))
        return F.when(dots > 0, F.concat(keyed("m", F.array(relative)), keyed("s", F.array(relative)), keyed("m", F.array(above)))).otherwise(named)
    if group == "script":
        return F.when(raw.rlike(r"^\.{1,2}(/|$)"), F.array(F.concat(F.lit("s:"), stem(beside)), F.concat(F.lit("s:"), beside), F.concat(F.lit("s:"), join_path(beside, "index")), F.concat(F.lit("m:"), beside))).otherwise(none)
    if group == "c":
        inc = F.regexp_replace(raw, '[<>"]', "")
        own = F.when(raw.startswith('"'), keyed("f", F.array(normal_path(join_path(folder, inc))))).otherwise(none)
        return F.concat(own, keyed("f", F.flatten(F.transform(up, lambda r: F.array(*[normal_path(join_path(r, d, inc)) for d in C_ROOTS])))))
    if group == "ruby":
        rb = F.when(raw.endswith(".rb"), raw).otherwise(F.concat(raw, F.lit(".rb")))
        return F.when(raw.startswith("."), keyed("f", F.array(normal_path(join_path(folder, rb))))).otherwise(keyed("f", F.flatten(F.transform(up, lambda r: F.array(*[join_path(r, d, rb) for d in RUBY_ROOTS])))))
    if group == "shell":
        return keyed("f", F.concat(F.array(beside), F.transform(up, lambda r: normal_path(join_path(r, raw)))))
    if group == "powershell":
        windows = normal_path(join_path(folder, F.translate(F.regexp_replace(raw, r"^\$PSScriptRoot[/\\]?", ""), "\\", "/")))
        return F.when(raw.rlike(r"[/\\]|\.psm?1$"), keyed("f", F.array(windows))).otherwise(none)
    if group == "php":
        return F.when(raw.endswith(".php") | raw.startswith("."), keyed("f", F.concat(F.array(beside), F.transform(up, lambda r: normal_path(join_path(r, raw)))))).otherwise(none)
    # Rust: crate:: starts below src of an ancestor, self:: here, super:: one above; the longest path that is a file or directory wins.
    steps = F.split(raw, "::")
    tail = F.slice(steps, F.lit(2), F.size(steps))
    paths = F.transform(F.reverse(F.sequence(F.lit(0), F.size(tail))), lambda n: F.array_join(F.slice(tail, F.lit(1), n), "/"))

    def below(base: Column) -> Column:
        return F.flatten(F.transform(paths, lambda p: F.array(F.concat(F.lit("s:"), join_path(base, p)), F.concat(F.lit("s:"), join_path(base, p, "mod")), F.concat(F.lit("m:"), join_path(base, p)))))

    crate = F.flatten(F.transform(up, lambda r: F.concat(below(join_path(r, "src")), F.array(F.concat(F.lit("s:"), join_path(r, "src", "lib"))))))
    return F.coalesce(F.when(steps[0] == "crate", crate).when(steps[0] == "self", below(folder)).when(steps[0] == "super", below(folder_of(F.concat(folder, F.lit("/x"))))), none)


#: Languages that find their own files in the same way.
GROUPS = {"python": ("python",), "script": SCRIPT, "c": C_FAMILY, "ruby": ("ruby",), "shell": ("shell",), "powershell": ("powershell",), "php": ("php",), "rust": ("rust",)}


def own_form(lang: Column, raw: Column) -> Column:
    """Whether the form alone says that an import is the corpus's own."""
    return (
        F.when(lang == "python", raw.startswith(".")).when(lang.isin(*SCRIPT), raw.rlike(r"^\.{1,2}(/|$)")).when(lang == "rust", raw.rlike("^(crate|self|super)(::|$)"))
        .when(lang == "ruby", raw.startswith(".")).when(lang == "shell", F.lit(True))
        .when(lang == "powershell", raw.rlike(r"[/\\]|\.psm?1$")).when(lang == "php", raw.endswith(".php") | raw.startswith(".")).otherwise(F.lit(False))
    )


def slashed(lang: Column, raw: Column) -> Column:
    """An import's name with its separators as slashes."""
    return (
        F.when(lang.isin("python", *JVM, "csharp"), F.translate(raw, ".", "/")).when(lang == "rust", F.replace(raw, F.lit("::"), F.lit("/")))
        .when(lang == "php", F.regexp_replace(F.translate(raw, "\\", "/"), "^/", "")).otherwise(raw)
    )


def dependency_candidates(lang: Column, raw: Column, eco: Column) -> Column:
    """Keys of dependencies: every spelling of every prefix, longest first, in the language's own ecosystem and then in any."""
    names = F.flatten(F.transform(F.reverse(resolve.prefixes(slashed(lang, raw))), lambda p: F.concat(resolve.dependency_keys(p), F.when(lang.isin("csharp", *JVM), resolve.dependency_keys(F.translate(p, "/", "."))).otherwise(F.array().cast("array<string>")))))
    return F.concat(F.when(eco.isNotNull(), F.transform(names, lambda k: F.concat(F.lit("d:"), eco, F.lit(":"), k))).otherwise(F.array().cast("array<string>")), keyed("x", names))


def dependency_targets(externals: DataFrame) -> DataFrame:
    """candidate, target of externals (ecosystem, name, id) under all their spellings; the least id where several share one."""
    known = F.create_map(*[x for k, v in PYTHON_NAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    extra = F.when(F.col("ecosystem") == "pypi", F.try_element_at(known, F.lower("name")))
    e = externals.select("ecosystem", "id", F.explode(F.concat(resolve.dependency_keys(F.col("name")), F.coalesce(extra, F.array().cast("array<string>")))).alias("k"))
    own = e.groupBy(F.concat(F.lit("d:"), "ecosystem", F.lit(":"), "k").alias("candidate")).agg(F.min("id").alias("target"))
    every = e.groupBy(F.concat(F.lit("x:"), "k").alias("candidate")).agg(F.min_by("id", F.struct("ecosystem", "id")).alias("target"))
    return own.unionByName(every)


def effective_aliases(facts: DataFrame) -> DataFrame:
    """scope (directory), pattern, targets: path aliases of each configuration, its own or the nearest it extends."""
    own = cut(facts.where("fact = 'alias' AND ecosystem = 'npm'").select("path", F.col("name").alias("pattern"), F.col("items").alias("targets")))
    parents = cut(facts.where("fact = 'extends' AND scope = ''").select("path", F.col("name").alias("parent")).distinct())
    configs = facts.where("kind = 'tsconfig'").select("path").distinct()
    holders = own.select(F.col("path").alias("at")).distinct()
    open_ = cut(configs.select("path", F.col("path").alias("at"), F.array("path").alias("seen")))
    found = None
    while True:
        hit = open_.join(holders, "at", "left_semi").select("path", "at")
        found = hit if found is None else found.unionByName(hit)
        rest = open_.join(holders, "at", "left_anti").join(parents.withColumnRenamed("path", "at"), "at")
        rest = rest.where(~F.array_contains("seen", F.col("parent"))).select("path", F.col("parent").alias("at"), F.concat("seen", F.array("parent")).alias("seen"))
        open_ = cut(rest)
        if open_.isEmpty():
            break
    nearest = found.groupBy("path").agg(F.first("at").alias("at"))
    return nearest.join(own.withColumnRenamed("path", "at"), "at").select(folder_of(F.col("path")).alias("scope"), "pattern", "targets")


def alias_candidates(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """KEY, rank, candidate, internal of imports that an alias of an enclosing directory matches, nearest directory and longest prefix first."""
    fixed = F.regexp_extract("pattern", r"^([^*]*)", 1)
    a = aliases.select("scope", "pattern", "targets", fixed.alias("pre"), F.regexp_extract("pattern", r"^[^*]*\*?(.*)$", 1).alias("post"), F.contains("pattern", F.lit("*")).alias("open"))
    a = a.withColumn("key", F.when(F.col("open"), F.regexp_extract("pre", "^(.*)/[^/]*$", 1)).otherwise(F.col("pre")))
    i = imports.where(F.col("lang").isin(*SCRIPT) & ~F.col("raw").rlike(r"^\.{1,2}(/|$)"))
    i = i.select(*KEY, F.explode(ancestors(F.col("folder"))).alias("scope"), F.concat(F.array(F.lit("")), resolve.prefixes(F.col("raw"))).alias("keys")).select(*KEY, "scope", F.explode("keys").alias("key"))
    m = i.join(a, ["scope", "key"]).where((~F.col("open") & (F.col("raw") == F.col("pattern"))) | (F.col("open") & F.startswith("raw", F.col("pre")) & F.endswith("raw", F.col("post")) & (F.length("raw") >= F.length("pre") + F.length("post"))))
    part = F.substr("raw", F.length("pre") + 1, F.length("raw") - F.length("pre") - F.length("post"))
    m = m.select(*KEY, F.length("scope").alias("depth"), F.length("pre").alias("len"), F.col("pattern"), F.posexplode("targets").alias("k", "t"), part.alias("part"))
    to = normal_path(F.when(F.contains("t", F.lit("*")), F.replace("t", F.lit("*"), F.col("part"))).otherwise(F.col("t")))
    keys = F.array(F.concat(F.lit("s:"), stem(to)), F.concat(F.lit("s:"), to), F.concat(F.lit("s:"), join_path(to, "index")), F.concat(F.lit("m:"), to))
    ranked = m.select(*KEY, (100_000 - F.col("depth") * 200 - F.col("len")).alias("base"), "k", "pattern", F.posexplode_outer(keys).alias("j", "candidate")).where("candidate IS NOT NULL")
    return ranked.select(*KEY, (F.col("base") * 100 + F.col("k") * 4 + F.col("j")).cast("long").alias("rank"), "candidate", (F.col("pattern") != "*").alias("internal"))


def root_candidates(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """KEY, rank, candidate, internal of imports below a named root: roots(grp, prefix, dir, internal); longest prefix first."""
    grp = F.when(F.col("lang") == "go", "go").when(F.col("lang") == "php", "php").when(F.col("lang") == "rust", "rust").when(F.col("lang").isin(*SCRIPT), "npm")
    i = imports.withColumn("grp", grp).where("grp IS NOT NULL").withColumn("s", slashed(F.col("lang"), F.col("raw")))
    i = i.select(*KEY, "grp", "s", F.explode(resolve.prefixes(F.col("s"))).alias("prefix"))
    m = i.join(roots, ["grp", "prefix"]).withColumn("rest", F.substr("s", F.length("prefix") + 2))
    to = normal_path(join_path(F.col("dir"), F.col("rest")))
    keys = (
        F.when(F.col("grp") == "go", keyed("m", F.array(to)))
        .when(F.col("grp") == "php", keyed("f", F.array(F.concat(to, F.lit(".php")))))
        .when(F.col("grp") == "rust", F.concat(keyed("s", F.array(join_path(F.col("dir"), "src", F.col("rest")), join_path(F.col("dir"), "src", "lib"))), keyed("m", F.array(join_path(F.col("dir"), "src")))))
        .otherwise(F.concat(keyed("s", F.array(stem(to), to, join_path(F.col("dir"), "src", F.col("rest")), join_path(to, "index"), join_path(to, "src", "index"))), keyed("m", F.array(to, join_path(to, "src"), F.col("dir"), join_path(F.col("dir"), "src")))))
    )
    m = m.select(*KEY, F.length("prefix").alias("len"), "internal", F.posexplode_outer(keys).alias("j", "candidate")).where("candidate IS NOT NULL")
    return m.select(*KEY, ((10_000 - F.col("len")) * 100 + F.col("j")).cast("long").alias("rank"), "candidate", "internal")


def package_candidates(imports: DataFrame) -> DataFrame:
    """KEY, rank, candidate of JVM and C# imports: declared packages by dotted prefix, longest first."""
    i = imports.where(F.col("lang").isin(*JVM, "csharp"))
    names = F.reverse(resolve.prefixes(F.regexp_replace("raw", r"\.\*$", ""), "."))
    grp = F.when(F.col("lang") == "csharp", "csharp").otherwise("jvm")
    i = i.select(*KEY, grp.alias("grp"), F.posexplode(names).alias("rank", "p"))
    return i.select(*KEY, F.col("rank").cast("long").alias("rank"), F.concat(F.lit("p:"), "grp", F.lit(":"), "p").alias("candidate"))


def corpus_targets(source: DataFrame, modules: DataFrame, packages: DataFrame, roots: DataFrame, asked: DataFrame, kinds: set[str]) -> DataFrame:
    """candidate, target of what the corpus has, of the asked-for candidates. source(path, lang, folder, is_test), modules(folder, id), packages(path, package),
    Python roots(dir), asked(candidate), kinds: of the candidates asked for (see above)."""
    own = source.join(modules, "folder")
    parts = []
    if "m" in kinds:
        parts.append(modules.select(F.concat(F.lit("m:"), "folder").alias("candidate"), F.col("id").alias("target")))
    if "f" in kinds:
        parts.append(own.select(F.concat(F.lit("f:"), "path").alias("candidate"), F.col("id").alias("target")))
    if "s" in kinds:
        parts.append(own.select(F.concat(F.lit("s:"), stem(F.col("path"))).alias("candidate"), F.col("id").alias("target")))
    if "y" in kinds:
        # A Python file below a root, under its dotted name from there (src/ and lib/ left off), and its directory. What depends on the directory alone is worked out by directory.
        at = modules.select("folder", "id", F.explode(ancestors(F.col("folder"))).alias("dir")).join(roots.select("dir").union(roots.sparkSession.range(1).select(F.lit("").alias("dir"))).distinct(), "dir")
        rest = F.when(F.col("folder") == F.col("dir"), "").otherwise(F.concat(F.when(F.col("dir") == "", F.col("folder")).otherwise(F.substr("folder", F.length("dir") + 2)), F.lit("/")))
        at = at.select("folder", "dir", "id", F.regexp_replace(rest, r"^(src|lib|python)/", "").alias("below"))
        py = source.where("lang = 'python'")
        name = F.regexp_replace(F.concat("below", stem(F.regexp_extract("path", "([^/]*)$", 1))), "/?__init__$", "")
        y = py.join(at, "folder").select("dir", "id", name.alias("p")).unionByName(at.join(py.select("folder").distinct(), "folder", "left_semi").select("dir", "id", F.regexp_replace("below", "/$", "").alias("p")))
        parts.append(y.where("p <> ''").select(F.concat(F.lit("y:"), "dir", F.lit("|"), F.translate("p", "/", ".")).alias("candidate"), F.col("id").alias("target")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if out is not None:
        out = out.join(asked, "candidate", "left_semi").groupBy("candidate").agg(F.min("target").alias("target"))
    if "p" in kinds:
        pk = packages.where("package <> ''").join(own.where(F.col("lang").isin(*JVM, "csharp")).select("path", "lang", "id", "is_test"), "path")
        pk = pk.groupBy(F.concat(F.lit("p:"), F.when(F.col("lang") == "csharp", "csharp").otherwise("jvm"), F.lit(":"), "package").alias("candidate")).agg(F.min_by("id", F.struct("is_test", "id")).alias("target"))
        out = pk if out is None else out.unionByName(pk)
    return out if out is not None else asked.select("candidate", F.lit(None).cast("string").alias("target")).limit(0)


def named_roots(facts: DataFrame) -> DataFrame:
    """grp, prefix, dir, internal of Go modules, workspace packages, crates and PSR-4 prefixes among manifest facts."""
    at = folder_of(F.col("path"))
    m = facts.where("fact = 'module'")
    go = m.where("ecosystem = 'go'").select(F.lit("go").alias("grp"), F.col("name").alias("prefix"), at.alias("dir"), F.lit(True).alias("internal"))
    npm = m.where("ecosystem = 'npm'").select(F.lit("npm").alias("grp"), F.col("name").alias("prefix"), at.alias("dir"), F.lit(True).alias("internal"))
    rust = m.where("ecosystem = 'crates.io'").select(F.lit("rust").alias("grp"), F.explode(F.array_distinct(F.array(F.col("name"), F.translate("name", "-", "_")))).alias("prefix"), at.alias("dir"), F.lit(True).alias("internal"))
    psr = facts.where("fact = 'alias' AND ecosystem = 'composer'").select("path", "name", F.explode("items").alias("t"))
    php = psr.select(F.lit("php").alias("grp"), F.regexp_replace(F.translate("name", "\\", "/"), "/$", "").alias("prefix"), normal_path(join_path(folder_of(F.col("path")), F.col("t"))).alias("dir"), F.lit(True).alias("internal"))
    return go.unionByName(npm).unionByName(rust).unionByName(php)


def resolve_names(names: DataFrame, source: DataFrame, modules: DataFrame, externals: DataFrame, packages: DataFrame, facts: DataFrame, said: set[tuple[str, str]]) -> DataFrame:
    """Distinct ``names`` (KEY) with target (null where none), internal (a module or of the corpus's own form) and shipped (by the runtime).

    source(path, lang, folder, is_test), modules(folder, id), externals(ecosystem, name, id), packages(path, package), facts: manifest facts, said: their (kind, fact)."""
    langs = {r.lang for r in names.select("lang").distinct().collect()}
    told = {fact for _, fact in said}
    eco = F.lit(None).cast("string")
    for lang, e in ECOSYSTEM.items():
        if lang in langs:
            eco = F.when(F.col("lang") == lang, e).otherwise(eco)
    lang, folder, raw = F.col("lang"), F.col("folder"), F.col("raw")
    # The outer form keeps Spark from testing each list's size first, which would work the list out twice.
    parts = [names.where(lang.isin(*spoken)).select(*KEY, F.posexplode_outer(own_candidates(group, folder, raw)).alias("rank", "candidate")).where("candidate IS NOT NULL").withColumn("tier", F.lit(0)).withColumn("internal", F.lit(False)) for group, spoken in GROUPS.items() if not langs.isdisjoint(spoken)]
    if "alias" in told and not langs.isdisjoint(SCRIPT):
        parts.append(alias_candidates(names, effective_aliases(facts)).withColumn("tier", F.lit(1)))
    if not told.isdisjoint(("module", "alias")) and not langs.isdisjoint(("go", "php", "rust", *SCRIPT)):
        parts.append(root_candidates(names, named_roots(facts)).withColumn("tier", F.lit(2)))
    if not langs.isdisjoint((*JVM, "csharp")):
        parts.append(package_candidates(names).withColumn("tier", F.lit(3)).withColumn("internal", F.lit(False)))
    if "dep" in told:
        parts.append(names.where(~own_form(lang, raw)).select(*KEY, F.posexplode_outer(dependency_candidates(lang, raw, eco)).alias("rank", "candidate")).where("candidate IS NOT NULL").withColumn("tier", F.lit(4)).withColumn("internal", F.lit(False)))
    cand = names.select(*KEY, F.lit(0).alias("rank"), F.lit("").alias("candidate"), F.lit(0).alias("tier"), F.lit(False).alias("internal")).limit(0) if not parts else None
    for p in parts:
        p = p.select(*KEY, "rank", "candidate", "tier", "internal")
        cand = p if cand is None else cand.unionByName(p)
    cand = cut(cand.select(*KEY, F.struct(F.col("tier"), F.col("rank").cast("long").alias("rank")).alias("rank"), "candidate", "internal"))
    counts = {r.kind: r.n for r in cand.groupBy(F.substring("candidate", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = cand.select("candidate").distinct()
    asked = F.broadcast(asked) if sum(counts.values()) <= BROADCAST_CANDIDATES else asked
    python_roots = facts.where("ecosystem = 'pypi'").select(folder_of(F.col("path")).alias("dir")).distinct()
    targets = corpus_targets(source, modules, packages, python_roots, asked, set(counts)).withColumn("own", F.lit(True))
    if not {"d", "x"}.isdisjoint(counts):
        targets = targets.unionByName(dependency_targets(externals).withColumn("own", F.lit(False)))
    hit = cand.join(targets, "candidate", "left")
    best = hit.groupBy(*KEY).agg(
        F.min_by(F.when(F.col("target").isNotNull(), F.struct("target", "own")), F.when(F.col("target").isNotNull(), F.struct("rank", "target"))).alias("b"), F.max("internal").alias("_claimed")
    )
    out = names.join(best, [*KEY], "left")
    # A name that a rule of the corpus claims is never a dependency, even where the rule finds nothing.
    claimed = F.coalesce("_claimed", F.lit(False))
    own = F.coalesce(F.col("b.own"), F.lit(False))
    target = F.when(own | ~claimed, F.col("b.target"))
    return out.select(*names.columns, target.alias("target"), (own | claimed | own_form(lang, raw)).alias("internal"), runtime.ships(lang, raw).alias("shipped"))
