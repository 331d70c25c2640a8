import json
import re
import shutil
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartograph.sinks import export
from cartograph.sources import config, extract, files, gitlog, manifests
from cartograph.sources.readers import yaml
from cartograph.streaming.events import windowed_counts


def test_ignore_rules_last_match_wins(spark):
    lines = ["# note", "*.log", "!keep.log", "/build/", "docs/**/x?.md", "[!a]b", "\\#x", "sp\\ "]
    want = {"a/b.log": True, "keep.log": False, "build/x": True, "src/build/x": False, "docs/p/q/x1.md": True, "docs/x12.md": False, "cb": True, "ab": False, "#x": True, "build": False}
    df = spark.createDataFrame([(p,) for p in want], "path string").select("path", files.ignored(F.col("path"), lines).alias("i"))
    assert {r.path: r.i for r in df.collect()} == want


def test_corpus(spark, tmp_path):
    for name, body in {".gitignore": b"*.tmp\n", "src/.gitignore": b"!keep.tmp\n", "src/x.tmp": b"x", "src/empty.py": b"", ".github/workflows/a.yml": b"on: push\n", "huge.txt": b"ab\n" * 1_000_000, "src/keep.tmp": b"x", "src/a.py": b"import os\r\nx = 1\n", "vendor/v.go": b"package v\n", "b.bin": b"\x00\x01", "testdata/f.py": b"y", "big.txt": b"line\n" * 60_000, "skip.log": b"x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got, skips = files.read_corpus(spark, str(tmp_path), ["*.log"])
    rows = {r.path: r for r in got.collect()}
    assert {r.path: r.reason for r in skips.collect()} == {"vendor/v.go": "vendored", "testdata/f.py": "fixture", "skip.log": "ignored", "src/x.tmp": "ignored"}
    assert rows["src/a.py"].content == "import os\nx = 1\n" and rows["src/a.py"].lines == 2 and rows["src/a.py"].lang == "python"
    assert {"src/keep.tmp", ".gitignore", ".github/workflows/a.yml"} <= set(rows) and rows["src/empty.py"].content == "" and rows["src/empty.py"].lines == 0
    assert rows["huge.txt"].truncated and rows["huge.txt"].lines is None and 65_000 < len(rows["huge.txt"].content) < 66_000
    assert {r.path for r in files.read_corpus(spark, str(tmp_path), budget=5)[1].where("reason = 'byte budget'").collect()} >= {"src/a.py"}
    assert rows["b.bin"].binary and rows["big.txt"].truncated and "elided" in rows["big.txt"].content


def test_log_without_files_and_bad_paths():
    log = "h1\x1fd\x1fA\x1fa\x1fb\x1f\0h0\x1fd\x1fB\x1fs\x1f\n1\t1\t../x\0" + "2\t0\tok\0"
    rows = list(gitlog.parse(log))
    assert [(r[0], r[4], r[6]) for r in rows] == [(0, "a\x1fb", None), (1, "s", "ok")]


@pytest.mark.parametrize(
    "lang, text, names",
    [
        ("rust", "pub fn a() {}\nfn b() {}\npub(crate) struct C;\nimpl D {\n    pub fn m(&self) {}\n}\n", {("a", True), ("b", False), ("C", False), ("m", True)}),
        ("java", "package p.q;\npublic class A {\n  public int f(int x) { return 1; }\n  // public void no() {}\n}\n", {("A", True), ("f", True)}),
        ("kotlin", "package p\nclass A\nprivate fun b() {}\nfun String.c() = 1\n", {("A", True), ("b", False), ("c", True)}),
        ("csharp", "namespace N;\npublic class A {\n  public int P { get; }\n  void h() {}\n}\n", {("A", True), ("P", True), ("h", False)}),
        ("ruby", "module M\n  class K\n    def go!\n    end\n  end\nend\n", {("M", True), ("K", True), ("go!", True)}),
        ("php", "<?php\nnamespace A;\nuse B\\C;\nclass K { \n private function z() {}\n}\n", {("K", True), ("z", False)}),
        ("shell", "#!/bin/sh\n. ./lib.sh\ngo() { :; }\n_h() { :; }\n", {("go", True), ("_h", False)}),
        ("c", '#include "a.h"\nstruct S {\n};\nstatic int f(int a) {\n}\nint main(void) {\n}\n', {("S", True), ("f", False), ("main", True)}),
        ("powershell", "Import-Module Foo\nfunction Get-It { }\n", {("Get-It", True)}),
    ],
)
def test_symbols(lang, text, names):
    assert {(s[0], s[3]) for s in extract.facts_of(text, lang).symbols} == names


def symbols(lang, source):
    return {(s[2], s[0]) if s[2] else s[0]: s[3] for s in extract.facts_of(source, lang).symbols}


def test_scopes_decide_what_is_shown():
    assert symbols("java", "package p;\npublic interface F { void m(); }\nclass G { public void n() { class L { public void x() {} } } public G() {} }\n") == {"F": True, ("F", "m"): True, "G": False, ("G", "n"): False}
    assert symbols("cpp", "namespace {\nint hid() { return 1; }\n}\nclass K {\n  void low();\npublic:\n  void go();\n};\nvoid K::go() {}\ntypedef struct { int q; } T;\n#define M(x) { x\n") == {"hid": False, "K": True, ("K", "low"): False, ("K", "go"): True, "T": True}
    assert symbols("kotlin", "class A(val x: Int, private var y: Int) {\n  companion object {\n    fun make() {}\n  }\n}\ninternal fun b() {}\n") == {"A": True, ("A", "x"): True, ("A", "y"): False, ("A", "make"): True, "b": False}
    assert symbols("ruby", "class K\n  def sq(x) = x * x\n  def go\n    if a\n      b\n    end\n  end\n  private\n  def low\n  end\nend\n") == {"K": True, ("K", "sq"): True, ("K", "go"): True, ("K", "low"): False}
    assert symbols("powershell", "function Get-It { }\nfunction Low { }\nExport-ModuleMember -Function Get-It\n") == {"Get-It": True, "Low": False}
    assert symbols("typescript", "const q = 1\nfunction g() {\n  const inner = 1\n}\nexport { q, g as h }\nexport default class extends B {}\n") == {"q": True, "g": True, "default": True}
    assert symbols("go", "package p\n\ntype (\n\tA struct {\n\t\tInner int\n\t}\n)\nconst (\n\tX = iota\n\t_\n)\nfunc (t *tiny) Big() {}\n") == {"A": True, "X": True, ("tiny", "Big"): False}
    assert symbols("rust", "pub trait T { fn q(&self); }\nimpl T for S { fn q(&self) {} }\npub(super) fn n() {}\nfn o() { let c = '{'; let l: &'static str = r#\"}\"#; }\n") == {"T": True, ("T", "q"): True, ("S", "q"): True, "n": False, "o": False}


def test_docs_entry_points_and_several_names():
    f = extract.facts_of("#!/usr/bin/env node\nimport {\n  a,\n  type b,\n} from './m'\nimport './n'\nconst { x } = require('q')\n/** Runs it. Twice. */\nexport function run() {}\n", "typescript")
    assert f.entrypoints == ["node"] and [(i[0], i[2]) for i in f.imports] == [("./m", ["a", "b"]), ("./n", []), ("q", [])] and [s[5] for s in f.symbols if s[0] == "run"] == ["Runs it."]
    f = extract.facts_of("import a.b.C\n", "kotlin")
    assert f.imports == [("a.b", "", ["C"], 1)]
    f = extract.facts_of('"""Doc."""\nfrom .x import y, z\n__all__ = ["y", "go"]\ndef go():\n    """Goes. Far."""\n    run("""\n    SELECT a FROM bins\n    """)\n', "python", "src/p/__init__.py")
    assert f.package == "p" and [(s[0], s[1], s[3], s[5]) for s in f.symbols] == [("y", "", True, ""), ("go", "func", True, "Goes.")] and f.queries == [("bins", "reads", 7)]
    assert extract.facts_of("#!/bin/sh\ncat <<-'X'\n\t. ./no.sh\n\tX\n. \"$DIR/yes.sh\"\n", "shell").imports == [("./yes.sh", "", [], 5)]


def test_broken_python_is_incomplete():
    assert extract.facts_of("def (", "python").incomplete and extract.facts_of("x", "cobol") is None


def facts(path, source):
    kind, out = manifests.read(path, source)
    return {(f.fact, f.name, f.value, f.scope) for f in out}, out.complete


def test_manifests():
    got, whole = facts("Cargo.toml", '[dependencies]\nserde = {version="1", package="serde2"}\n[dev-dependencies]\nq = "2"\n')
    assert got == {("dep", "q", "2", "dev"), ("dep", "serde2", "1", "runtime")} and whole
    assert facts("package.json", "{oops") == (set(), False) and manifests.read("x.bin", "") is None
    assert facts("CODEOWNERS", "# c\n/a/ @x @y\n*.go\n")[0] == {("owner", "/a/", "", "")}
    assert {("target", "build", "go build", "")} <= facts("Makefile", "build: dep\n\tgo build\nX := 1\n")[0]
    assert facts("a/Dockerfile", "FRUM x\nFROM y\n")[1] is False
    bad, whole = facts("k8s/t.yaml", "apiVersion: v1\nkind: Service\n{{ if .x }}\nmetadata:\n  name: s\n{{ end }}\n")
    assert ("service", "s", "", "") in bad and not whole
    assert all("hidden" not in str(f) for f in manifests.read("compose.yml", "services:\n  a:\n    environment:\n      API_TOKEN: hidden\n")[1])


def test_read_manifests_keeps_silent_files_and_takes_nulls(spark):
    df = spark.createDataFrame([("go.mod", None, "x"), ("package.json", "{}", "x"), ("a.bin", "q", "x"), (None, "q", "x")], "path string, content string, kind string")
    rows = manifests.read_manifests(df).collect()
    assert {(r.path, r.kind, r.fact) for r in rows} == {("go.mod", "go.mod", None), ("package.json", "package.json", None)}
    assert manifests.read_manifests(df.limit(0)).isEmpty()


def test_yaml():
    text = """a: &x {k: [1, 'two: 2', "t\\n"]}   # note
b:
  <<: *x
  l:
  - one
  - n: 2
    m: |-
      kept
        deep
  -
    z: y
c: >
  folded
  text

  more
"url": http://h:8/p#f
---
- - p
  - q
"""
    docs, whole = yaml.read(text)
    assert whole and docs == [{"a": {"k": ["1", "two: 2", "t\n"]}, "b": {"l": ["one", {"n": "2", "m": "kept\n  deep"}, {"z": "y"}], "k": ["1", "two: 2", "t\n"]}, "c": "folded text\nmore\n", "url": "http://h:8/p#f"}, [["p", "q"]]]
    assert docs[0].lines["b"] == 2 and yaml.read("a: *none\n")[1] is False and yaml.read("") == ([], True)


def test_settings(tmp_path):
    assert config.parse("include_vendored: true\nmax_commits: 50\nignore:\n  - '*.log'\n") == config.Config(include_vendored=True, max_commits=50, ignore=["*.log"])
    for bad in ("api_key: x", "repo: ${HOME}", "includ_vendored: true", "max_commits: many", "- a", "no_history: maybe"):
        with pytest.raises(ValueError):
            config.parse(bad)
    assert config.load(str(tmp_path)) == config.Config()


def git(at, *args):
    subprocess.run(["git", "-C", str(at), "-c", "user.name=T", "-c", "user.email=t@e", *args], check=True, capture_output=True)


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_a_git_repository(spark, tmp_path):
    git(tmp_path, "init", "-q")
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    git(tmp_path, "add", "."), git(tmp_path, "commit", "-qm", "feat: a")
    git(tmp_path, "tag", "v1.9.0"), git(tmp_path, "tag", "v1.10.0")
    git(tmp_path, "mv", "a.txt", "b.txt"), git(tmp_path, "commit", "-qm", "move")
    changes, why = gitlog.read_repository(spark, str(tmp_path))
    assert why == "" and [(r.ord, r.path, r.old_path) for r in changes.orderBy("ord").collect()] == [(0, "b.txt", "a.txt"), (1, "a.txt", None)]
    r = gitlog.releases(spark, str(tmp_path)).first()
    assert (r.available, r["count"], r.latest, r.commits_since) == (True, 2, "v1.10.0", 1)
    assert gitlog.state(spark, str(tmp_path)).first()[:4] == (True, "", False, False)
    assert [tuple(x) for x in gitlog.renames(spark, str(tmp_path), "HEAD~1", "HEAD").collect()] == [("a.txt", "b.txt")]
    with gitlog.snapshot(str(tmp_path), "v1.9.0") as tree:
        assert (Path(tree) / "a.txt").exists()
    assert not Path(tree).exists()
    with pytest.raises(ValueError):
        gitlog.revision(str(tmp_path), "nowhere")
    assert gitlog.read_repository(spark, str(tmp_path / ".."))[1] != ""


def test_exports_and_pages(spark, tmp_path):
    n = spark.createDataFrame([("b", "Module", 'B "x" & y'), ("a", "Data", "")], "id string, kind string, title string")
    e = spark.createDataFrame([("a", "b", "imports", "inferred", 2), ("a", "zz", "imports", "extracted", 1)], "src string, dst string, kind string, confidence string, weight int")
    data = json.loads("".join(export.to_json(n, e)))
    assert [x["id"] for x in data["nodes"]] == ["a", "b"] and len(data["edges"]) == 1 and "title" not in data["nodes"][0]
    assert "style=dashed" in "".join(export.to_dot(n, e)) and "-.->" in "".join(export.to_mermaid(n, e)) and "&amp;" in "".join(export.to_graphml(n, e))
    assert "subgraph cluster_0 {" in "".join(export.to_dot(n.withColumn("cluster", F.lit(0)), e)) and "subgraph c0" in "".join(export.to_mermaid(n.withColumn("cluster", F.lit(0)), e))
    export.export(n, e, "dot", f"{tmp_path}/g.dot")
    with pytest.raises(ValueError):
        export.export(n, e, "png", "x")
    page = lambda **k: export.render(list(k.items()))
    merged = export.merge_page("hi\n" + page(a="old\n", gone="g\n") + "human <!-- region:q -->\n", page(a="new\n", b="B\n"))
    assert re.sub("<!--.*?-->\n", "", merged) == "hi\nnew\ng\nhuman B\n"


def test_stream_of_events(spark, tmp_path):
    src = spark.range(100).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("click").alias("event_type"), F.lit(0.5).alias("value"))
    src.write.parquet(f"{tmp_path}/in")
    q = windowed_counts(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n), sum(total_cents) FROM win").first() == (100, 5000)


def test_only_paths_that_may_be_manifests_reach_the_readers(spark):
    """What the plan keeps back is what no route fits, in other letters and after odd line ends too."""
    paths = [
        "a/x.py", "db/migrations/1_x.py", "db/Migrations/1_x.py", "migrate/a\rb.sql", "a/dockerfile.py", "a/Docker\u0131le.go", "a/doc\u212aerfile.js", "go.mod", "go.mod\n", "go.mod\r", "a/\u00e9\u00b2requirements-\u00b2.txt", "x.tf",
        "tsconfig.\u00e9.json", "K8S/a.yml", "k8s/a\nb.yml", "ADR/x.MD", "x.sql", "", "Makefile", "a/b.vue", "values\u00e9.yaml",
    ]
    df = spark.createDataFrame([(p, "") for p in paths] + [(None, "x")], "path string, content string")
    got = {r.path for r in manifests.read_manifests(df).collect()}
    assert got == {p for p in paths if manifests.route(p)}
    plan = manifests.read_manifests(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "migrat" in plan


def test_leading_imports_are_read_by_line_with_the_rest_as_before():
    f = extract.facts_of("import os\n\nfrom .a import b, c\nimport q as r\n\n\ndef f():\n    import os\n    run('SELECT a FROM t')\n", "python", "p/x.py")
    assert f.imports == [(".a", "", ["b", "c"], 3), ("os", "", [], 1), ("q", "r", [], 4)] and f.symbols[0][4] == 7 and f.queries == [("t", "reads", 9)]
    assert extract.leading_imports("import os\n\nx = 1\nimport b\n") == ([("os", "", [], 1)], "\n\nx = 1\nimport b\n")
    assert extract.facts_of("import class\nimport a\n", "python").incomplete and extract.facts_of("import a\n  x\n", "python").incomplete
