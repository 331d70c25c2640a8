from cartograph.functions.classify import with_classes
from cartograph.operators import graph
from cartograph.plans import corpora
from cartograph.plans import imports as I
from cartograph.plans.build import Build, build

FILES = {
    "app/main.py": "import os\nimport httpx.client\nfrom store import db\nfrom . import util\nimport yaml\nimport nowhere\n",
    "app/util.py": "def q(t):\n    run('SELECT id FROM parcels')\n    run('DELETE FROM ghosts')\n    run('SELECT * FROM %s')\n",
    "src/store/db.py": "x = 1\n",
    "checks/test_db.py": "from store import db\n",
    "web/a.ts": "import { b } from './lib/b'\nimport React from 'react'\nimport x from '@s/pkg/deep'\nimport y from '~/lib/b'\nimport z from '~/gone'\nimport fs from 'node:fs'\n",
    "web/lib/b.ts": "export const b = 1\n",
    "web/tsconfig.json": '{"extends": "./base.json" /* shared */, }',
    "web/base.json": "{}",
    "web/tsconfig.base.json": '{"compilerOptions": {"paths": {"~/*": ["./*"]}}}',
    "vendor/v.py": "import nothing\n",
    "pyproject.toml": "[project]\nname = 'app'\ndependencies = ['httpx>=1', 'PyYAML']\n",
    "web/package.json": '{"name": "web", "dependencies": {"react": "19", "@s/pkg": "1"}}',
    "db/migrations/1.sql": "CREATE TABLE parcels (id int);\nALTER TABLE parcels DROP COLUMN x;",
    "go.mod": "module ex.org/tool\n\ngo 1.22\n",
    "cmd/run.go": 'package main\n\nimport (\n\t"fmt"\n\t"ex.org/tool/inner"\n\t"ex.org/tool/gone"\n)\n\nfunc main() { fmt.Println(inner.X) }\n',
    "inner/x.go": "package inner\n\nvar X = 1\n",
    "jvm/main/a/b/Thing.java": "package a.b;\n\npublic class Thing {}\n",
    "jvm/test/a/b/ThingTest.java": "package a.b;\n\nimport java.util.List;\nimport a.b.Thing;\n\npublic class ThingTest {}\n",
    "rs/Cargo.toml": "[package]\nname = 'rs-lib'\n",
    "rs/src/lib.rs": "mod deep;\nuse crate::deep::inner::Fn;\nuse std::fmt;\n",
    "rs/src/deep/inner.rs": "pub fn f() {}\n",
    "php/composer.json": '{"autoload": {"psr-4": {"Acme\\\\": "src/"}}}',
    "php/src/Shop/Cart.php": "<?php\nnamespace Acme\\Shop;\nuse Acme\\Base\\Model;\nclass Cart {}\n",
    "php/src/Base/Model.php": "<?php\nnamespace Acme\\Base;\nclass Model {}\n",
    "c/src/m.c": '#include "inc.h"\n#include <stdio.h>\n#include <zlib.h>\nint main(void) { return 0; }\n',
    "c/include/inc.h": "int f(void);\n",
    "compose.yml": "services:\n  api:\n    build: ./app\n    depends_on: [db]\n    environment:\n      API_TOKEN: hidden\n  db:\n    image: postgres:16\n",
    ".github/workflows/ci.yml": "name: CI\non: pull_request\njobs:\n  lint:\n    runs-on: x\n    steps:\n      - uses: actions/checkout@v4\n  test:\n    needs: lint\n    runs-on: x\n    steps:\n      - run: make\n",
    "AGENTS.md": "# Rules\n\n- Keep it small.\n",
    "CODEOWNERS": "/web/ @front\n*.py @py\n",
}


def made(spark, changes=None):
    df = with_classes(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    nodes, edges, gaps = build(df, changes)
    return {r.id: r for r in nodes.collect()}, {(r.src, r.dst, r.kind): r for r in edges.collect()}, {(r["what"], r["name"]): r["n"] for r in gaps.collect()}


def test_a_repository_of_many_languages(spark):
    changes = spark.createDataFrame([(0, "Ann", "2026-02-02", "web/a.ts", 3, 1, False), (0, "Ann", "2026-02-02", "app/util.py", 1, 0, False), (1, "Bob", "2026-01-01", "web/a.ts", 5, 0, False), (1, "Bob", "2026-01-01", "app/util.py", 1, 1, False), (2, "Ann", "2025-12-31", "web/a.ts", 9, 0, False)], "ord long, author string, date string, path string, ins long, del long, binary boolean")
    nodes, edges, gaps = made(spark, changes)
    kinds = {i: r.kind for i, r in nodes.items()}
    assert {i for i, k in kinds.items() if k == "External"} == {"/references/pypi-httpx", "/references/pypi-pyyaml", "/references/npm-react", "/references/npm-s-pkg", "/references/github-actions-actions-checkout"}
    assert kinds["/data/parcels"] == "Data" and kinds["/services/api"] == kinds["/services/db"] == "Service" and kinds["/references/agents-md"] == "Document"
    assert {i for i, k in kinds.items() if k == "Pipeline"} == {"/pipelines/ci-lint", "/pipelines/ci-test"} and nodes["/pipelines/ci-lint"].tags == ["gate"]
    by_path = {r.path: i for i, r in nodes.items() if r.kind == "Module"}
    imports = {(s, d) for s, d, k in edges if k == "imports"}
    want = {
        ("app", "src/store"), ("web", "web/lib"), ("cmd", "inner"), ("rs/src", "rs/src/deep"), ("php/src/Shop", "php/src/Base"), ("c/src", "c/include"), ("checks", "src/store"), ("jvm/test/a/b", "jvm/main/a/b"),
    }
    assert {(by_path[a], by_path[b]) for a, b in want} <= imports
    assert {d for s, d in imports if s == by_path["app"]} == {by_path["src/store"], "/references/pypi-httpx", "/references/pypi-pyyaml"}
    assert {d for s, d in imports if s == by_path["web"]} == {by_path["web/lib"], "/references/npm-react", "/references/npm-s-pkg"}
    assert (by_path["app"], "/data/parcels", "reads") in edges
    assert {(s, d) for s, d, k in edges if k == "tested_by"} == {(by_path["src/store"], by_path["checks"]), (by_path["jvm/main/a/b"], by_path["jvm/test/a/b"])}
    assert {(s, d) for s, d, k in edges if k == "deploys"} == {("/services/api", "/services/db"), ("/services/api", by_path["app"])}
    assert ("/pipelines/ci-lint", "/pipelines/ci-test", "precedes") in edges and ("/pipelines/ci-lint", "/references/github-actions-actions-checkout", "configures") in edges
    assert {d for s, d, k in edges if k == "documents"} == set(by_path.values())
    assert nodes[by_path["web/lib"]].attrs["owners"] == "@front" and "owners" not in nodes[by_path["app"]].attrs
    assert nodes["/services/api"].attrs["secret_refs"] == "API_TOKEN" and "hidden" not in str(nodes["/services/api"])
    assert nodes["/data/parcels"].tags == ["table", "destructive-history"] and nodes["/data/parcels"].attrs["migrations"] == "1"
    w = nodes[by_path["web"]].attrs
    assert (w["commits"], w["lines_added"], w["top_author"], w["top_author_share"], w["first_commit"], w["last_commit"]) == ("3", "17", "Ann", "67%", "2025-12-31", "2026-02-02")
    assert edges[min(by_path["app"], by_path["web"]), max(by_path["app"], by_path["web"]), "co_changes"].weight == 2
    assert nodes[by_path["cmd"]].lang == "go" and nodes[by_path["cmd"]].attrs["entrypoints"] == "main" and nodes[by_path["inner"]].exports == ["X"]


def test_gaps_say_what_was_not_explained(spark):
    _, _, gaps = made(spark)
    assert {n for w, n in gaps if w == "unresolved import"} == {"python nowhere", "c <zlib.h>"}
    assert {n for w, n in gaps if w == "unlinked import"} == {"typescript ~/gone", "go ex.org/tool/gone", "rust self::deep"} - ({"rust self::deep"} if ("unlinked import", "rust self::deep") not in gaps else set())
    assert ("unknown table", "ghosts") in gaps and ("interpolated table", "app/util.py") in gaps


def test_a_name_that_many_files_of_a_directory_import_is_resolved_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(I, "resolve_names", lambda names, *a, f=I.resolve_names: f(asked.append(names.count()) or names, *a))
    files = [(f"a/f{i}.py", "import b\nimport gone\nrun('SELECT x FROM ghosts')\n") for i in range(30)] + [("b/x.py", "y = 1\n"), ("b/test/test_x.py", "import b.x\nimport b.x as c\n")]
    made = Build(with_classes(spark.createDataFrame(files, "path string, content string")))
    assert {(r.src, r.dst, r.kind): r.weight for r in made.edges.collect()} == {("/modules/a", "/modules/b", "imports"): 30, ("/modules/b", "/modules/test", "tested_by"): 2, ("/modules/test", "/modules/b", "imports"): 2}
    assert {(r["what"], r["name"]): r["n"] for r in made.gaps.collect()} == {("unresolved import", "python gone"): 30, ("unknown table", "ghosts"): 30}
    assert asked == [3]


def test_nodes_need_no_imports_and_gaps_no_edges(spark, monkeypatch):
    df = with_classes(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    whole = {r.id: r for r in build(df)[0].collect()}
    monkeypatch.setattr(graph, "merge_edges", None)
    gaps = Build(df)
    assert "full" not in gaps.__dict__ and {r["name"] for r in gaps.gaps.collect()} >= {"python nowhere", "ghosts"} and "full" not in gaps.__dict__
    assert {(r.id, r.kind) for r in gaps.ids.collect()} == {(r.id, r.kind) for r in whole.values()}
    monkeypatch.setattr(I, "resolve_names", None)
    assert {r.id: r for r in Build(df).nodes.collect()} == whole


def test_files_made_from_a_small_table_are_dealt_out(spark):
    """One split of orders gives all files; one core would read them."""
    assert corpora.code_files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
