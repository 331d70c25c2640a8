"""Queries over corpora made from the driver's tables: a file per row, its text from the row's columns, and SQL that says from the same columns
what its facts are. The only place that writes such files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.functions import classify, lineage, runtime, text
from cartograph.operators import checks, diff, enrich, graph, history, practice, report, verify
from cartograph.plans import build as B
from cartograph.plans import lenses as L
from cartograph.session import dealt
from cartograph.sources import extract, files, gitlog, manifests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SUPPLIERS = "(SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def suppliers(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    """Columns (SQL over k, n) of a row per supplier."""
    s = L.table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS n")
    return s.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def facts_query(name: str, path: str, content: str, rows: list[tuple[str, str, str, str, str, str]]) -> None:
    """A query of the facts of one manifest per supplier. rows: fact, then SQL for name, value, scope, items and the condition."""
    facts = sorted({r[0] for r in rows})

    def run(spark: SparkSession, d: str) -> DataFrame:
        f = manifests.read_manifests(suppliers(spark, d, path=path, content=content)).where(F.col("fact").isin(*facts))
        return f.select("path", "fact", "name", "value", "scope", F.array_join("items", ",").alias("items"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = " UNION ALL ".join(f"SELECT {path} AS path, '{fact}' AS fact, {n} AS name, {v} AS value, {s} AS scope, {i} AS items FROM {SUPPLIERS} WHERE {c}" for fact, n, v, s, i, c in rows)


#: SQL of an empty text.
NONE = "''"
facts_query(
    "facts_go_mod", "concat('r', k, '/go.mod')",
    r"concat('module ex.org/m', k, '\n\ngo 1.', k % 5 + 18, '\n\nrequire (\n\tex.org/a', k % 7, ' v1.', k % 3, '.0\n\tex.org/b v0.1.0 // indirect\n)\n', if(k % 2 = 0, 'replace ex.org/b => ../b\n', ''))",
    [("module", "'ex.org/m' || k", "'1.' || (k % 5 + 18)", NONE, NONE, "true"), ("dep", "'ex.org/a' || (k % 7)", "'v1.' || (k % 3) || '.0'", "'runtime'", NONE, "true"), ("dep", "'ex.org/b'", "'v0.1.0'", "'indirect'", NONE, "true"), ("workspace", "'../b'", "'ex.org/b'", NONE, NONE, "k % 2 = 0")],
)
facts_query(
    "facts_package_json", "concat('p', k, '/package.json')",
    """concat('{"name": "@s/p', k, '", "version": "1.', n, '.0", "dependencies": {"lib', k % 5, '": "^', k % 3, '", "near": "file:../near"}, "devDependencies": {"vitest": "2"}, "scripts": {"test": "vitest", "build": "tsc -p ', k, '"}, "workspaces": ["packages/*"]}')""",
    [
        ("module", "'@s/p' || k", "'1.' || n || '.0'", NONE, NONE, "true"), ("dep", "'lib' || (k % 5)", "'^' || (k % 3)", "'runtime'", NONE, "true"), ("dep", "'near'", NONE, "'runtime'", NONE, "true"), ("dep", "'vitest'", "'2'", "'dev'", NONE, "true"),
        ("script", "'test'", "'vitest'", NONE, NONE, "true"), ("script", "'build'", "'tsc -p ' || k", NONE, NONE, "true"), ("workspace", "'packages/*'", NONE, NONE, NONE, "true"),
    ],
)
facts_query(
    "facts_pyproject", "concat('p', k, '/pyproject.toml')",
    r"concat('[project]\nname = \"app', k, '\"\nversion = \"0.', n, '\"\ndependencies = [\"Req_A', k % 4, '>=1.', k % 9, '\", \"bare; python_version > \'3\'\"]\n[project.optional-dependencies]\nextra = [\"opt[x]==2\"]\n[dependency-groups]\ndev = [\"pytest\"]\n[project.scripts]\nrun', k, ' = \"app:main\"\n')",
    [
        ("module", "'app' || k", "'0.' || n", NONE, NONE, "true"), ("dep", "'req-a' || (k % 4)", "'>=1.' || (k % 9)", "'runtime'", NONE, "true"), ("dep", "'bare'", NONE, "'runtime'", NONE, "true"), ("dep", "'opt'", "'==2'", "'runtime'", NONE, "true"),
        ("dep", "'pytest'", NONE, "'dev'", NONE, "true"), ("entrypoint", "'run' || k", "'app:main'", NONE, NONE, "true"),
    ],
)
facts_query(
    "facts_requirements", "concat('p', k, if(k % 2 = 0, '/requirements.txt', '/requirements-dev.txt'))", r"concat('# note\nTool.Box', k % 6, '~=', n, '.1  # why\n-r other.txt\ngit+https://ex.org/x.git#egg=Pinned_', k % 3, '\n')",
    [("dep", "'tool-box' || (k % 6)", "'~=' || n || '.1'", "CASE WHEN k % 2 = 0 THEN 'runtime' ELSE 'dev' END", NONE, "true"), ("dep", "'pinned-' || (k % 3)", NONE, "CASE WHEN k % 2 = 0 THEN 'runtime' ELSE 'dev' END", NONE, "true")],
)
facts_query(
    "facts_cargo", "concat('c', k, '/Cargo.toml')", r"concat('[package]\nname = \"crate', k, '\"\nversion = \"0.', n, '.0\"\n[dependencies]\nserde = { version = \"1.', k % 4, '\", package = \"serde-x\" }\nshared = { workspace = true }\n[build-dependencies]\ncc = \"1\"\n[target.\"cfg(unix)\".dependencies]\nnix = \"0.', k % 30, '\"\n')",
    [
        ("module", "'crate' || k", "'0.' || n || '.0'", NONE, NONE, "true"), ("dep", "'serde-x'", "'1.' || (k % 4)", "'runtime'", NONE, "true"), ("dep", "'shared'", "'workspace'", "'runtime'", NONE, "true"), ("dep", "'cc'", "'1'", "'build'", NONE, "true"), ("dep", "'nix'", "'0.' || (k % 30)", "'runtime'", NONE, "true"),
    ],
)
facts_query(
    "facts_gem", "concat('g', k, '/Gemfile')", r"concat('source \"x\"\ngem \"rails\", \"~> ', k % 8, '\", \">= 1\"\ngroup :test do\n  gem \"rspec', k % 3, '\"\nend\ngem \"near\", path: \"../near\"\n')",
    [("dep", "'rails'", "'~> ' || (k % 8) || ', >= 1'", "'runtime'", NONE, "true"), ("dep", "'rspec' || (k % 3)", NONE, "'dev'", NONE, "true"), ("dep", "'near'", NONE, "'runtime'", NONE, "true")],
)
facts_query(
    "facts_composer", "concat('h', k, '/composer.json')", r"""concat('{"name": "v/p', k, '", "require": {"php": ">=8", "ext-json": "*", "v/q', k % 5, '": "^', n, '"}, "autoload": {"psr-4": {"App', k, '\\\\": "src/"}}}')""",
    [("module", "'v/p' || k", NONE, NONE, NONE, "true"), ("dep", "'v/q' || (k % 5)", "'^' || n", "'runtime'", NONE, "true"), ("alias", "'App' || k || '\\'", NONE, "'psr-4'", "'src'", "true")],
)
facts_query(
    "facts_msbuild", "concat('n', k, '/App.csproj')", """concat('<Project><PropertyGroup><OutputType>Exe</OutputType></PropertyGroup><ItemGroup><PackageReference Include="Pkg', k % 6, '" Version="', n, '.0" /><PackageReference Include="Gen" PrivateAssets="all"><Version>1</Version></PackageReference><ProjectReference Include="..\\\\Lib', k, '\\\\Lib.csproj" /></ItemGroup></Project>')""",
    [("dep", "'Pkg' || (k % 6)", "n || '.0'", "'runtime'", NONE, "true"), ("dep", "'Gen'", "'1'", "'build'", NONE, "true"), ("dep", "'Lib'", NONE, "'runtime'", NONE, "true"), ("entrypoint", "'App'", NONE, NONE, NONE, "true")],
)
facts_query(
    "facts_solution", "concat('n', k, '/All.sln')", r"""concat('Project("{FAE0}") = "App', k, '", "app\\App', k, '.csproj", "{1}"\nEndProject\nProject("{2150}") = "docs", "docs", "{2}"\nEndProject\n')""",
    [("workspace", "'app/App' || k || '.csproj'", "'App' || k", NONE, NONE, "true")],
)
facts_query(
    "facts_cmake", "concat('m', k, '/CMakeLists.txt')", r"concat('project(P', k, ' VERSION 1.', n, ')\nadd_executable(tool', k, ' main.c)\nadd_library(core STATIC a.c) # c\nfind_package(ZLIB ', k % 3 + 1, '.2 REQUIRED)\ntarget_link_libraries(tool', k, ' PRIVATE core ZLIB::ZLIB fmt', k % 4, ')\nadd_test(NAME unit', k, ' COMMAND tool', k, ' --all)\n')",
    [
        ("module", "'P' || k", "'1.' || n", NONE, NONE, "true"), ("entrypoint", "'tool' || k", NONE, NONE, NONE, "true"), ("dep", "'ZLIB'", "(k % 3 + 1) || '.2'", "'build'", NONE, "true"), ("dep", "'fmt' || (k % 4)", NONE, "'build'", NONE, "true"),
        ("script", "'unit' || k", "'tool' || k || ' --all'", "'test'", NONE, "true"),
    ],
)
facts_query(
    "facts_bazel", "concat('b', k, '/BUILD')", r"concat('load(\"@r//:d.bzl\", \"x\")\ngo_binary(\n    name = \"bin', k, '\",\n    deps = [\":own\", \"//lib/n', n, ':t\", \"@dep', k % 5, '//:all\"],\n)\ngo_test(name = \"t', k, '\")\n')",
    [("entrypoint", "'bin' || k", NONE, NONE, NONE, "true"), ("script", "'t' || k", NONE, "'test'", NONE, "true"), ("dep", "'//lib/n' || n || ':t'", NONE, "'build'", NONE, "true"), ("dep", "'dep' || (k % 5)", NONE, "'build'", NONE, "true")],
)
facts_query(
    "facts_tsconfig", "concat('t', k, '/tsconfig.json')", """concat('{ // note ', k, '\n "extends": "./base.json", "compilerOptions": {"baseUrl": ".", "paths": {"@a', k % 4, '/*": ["./src/n', n, '/*", "../shared/*",],},},}')""",
    [("alias", "'*'", NONE, "'base'", "'t' || k || '/*'", "true"), ("alias", "'@a' || (k % 4) || '/*'", NONE, "'paths'", "'t' || k || '/src/n' || n || '/*,shared/*'", "true"), ("extends", "'t' || k || '/base.json'", NONE, NONE, NONE, "true")],
)
facts_query(
    "facts_makefile", "concat('k', k, '/Makefile')", r"concat('.PHONY: build', if(k % 2 = 0, ' test', ''), '\nX := 1\nbuild: dep\n\t@go build ./n', n, '\ntest:\n\tgo test\n')",
    [("target", "'build'", "'go build ./n' || n", NONE, NONE, "true"), ("target", "'test'", "'go test'", NONE, NONE, "true"), ("entrypoint", "'make build'", NONE, NONE, NONE, "true"), ("entrypoint", "'make test'", NONE, NONE, NONE, "k % 2 = 0")],
)
facts_query(
    "facts_containerfile", "concat('d', k, '/Dockerfile')", r"concat('ARG V=1.', n, '\nFROM golang:', char(36), '{V} AS build\nENV API_TOKEN=x MODE=y\nFROM build AS mid\nFROM reg.ex/base', k % 5, ':', k, '\nCOPY --from=build /a /a\nEXPOSE ', 8000 + k, ' 9/udp\n')",
    [
        ("image", "'golang'", "'1.' || n", "'build'", NONE, "true"), ("image", "'reg.ex/base' || (k % 5)", "CAST(k AS VARCHAR)", NONE, NONE, "true"), ("port", "CAST(8000 + k AS VARCHAR)", NONE, NONE, NONE, "true"), ("port", "'9/udp'", NONE, NONE, NONE, "true"), ("env", "'API_TOKEN'", NONE, NONE, NONE, "true"),
        ("env", "'MODE'", NONE, NONE, NONE, "true"), ("secret", "'API_TOKEN'", NONE, "'env'", NONE, "true"),
    ],
)
facts_query(
    "facts_compose", "concat('d', k, '/compose.yml')",
    r"concat('x-base: &base\n  image: base:', n, '\nservices:\n  web', k, ':\n    <<: *base\n    build: ./web\n    ports:\n      - \"', 8000 + k, ':80\"\n    environment:\n      DB_PASSWORD: hidden\n      MODE: a\n    depends_on:\n      db:\n        condition: x\n  db: {image: \"pg:', k % 9, '\", volumes: [data:/v]}\n')",
    [
        ("service", "'web' || k", "'base:' || n", NONE, "(8000 + k) || ':80'", "true"), ("service", "'db'", "'pg:' || (k % 9)", NONE, NONE, "true"), ("service_dep", "'web' || k", "'db'", NONE, NONE, "true"), ("secret", "'DB_PASSWORD'", "'env'", "'web' || k", NONE, "true"),
    ],
)
facts_query(
    "facts_workflow", "concat('.github/workflows/w', k, '.yml')",
    r"concat('name: Flow ', k, '\non:\n  ', if(k % 3 = 0, 'push:\n    tags: [v1]', if(k % 3 = 1, 'pull_request:', 'push:\n    branches: [main]')), '\njobs:\n  lint:\n    runs-on: linux\n    steps:\n      - uses: actions/checkout@v', n, '\n      - name: Lint\n        run: |\n          make lint\n          echo ${{ secrets.KEY', k % 2, ' }}\n  test:\n    needs: [lint]\n    runs-on: linux\n    steps: []\n')",
    [
        ("job", "'lint'", "'lint'", NONE, NONE, "true"), ("job", "'test'", "'test'", NONE, "'lint'", "true"), ("step", "'actions/checkout@v' || n", "'actions/checkout@v' || n", "'lint'", NONE, "true"), ("step", "'Lint'", "'make lint'", "'lint'", NONE, "true"),
        ("dep", "'actions/checkout'", "'v' || n", "'build'", NONE, "true"), ("secret", "'KEY' || (k % 2)", NONE, "'lint'", NONE, "true"),
    ],
)
facts_query(
    "facts_kubernetes", "concat('k8s/a', k, '.yaml')",
    r"concat('apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: web', k, '\nspec:\n  replicas: ', n, '\n  template:\n    spec:\n      containers:\n        - name: c\n          image: img:', k % 7, '\n          ports: [{containerPort: ', 80 + k, '}]\n          env:\n            - name: PW\n              valueFrom: {secretKeyRef: {name: sec', k % 3, ', key: pw}}\n---\napiVersion: v1\nkind: Service\nmetadata: {name: svc', k, '}\nspec:\n  selector: {app: web', k, '}\n  ports: [{port: 80}]\n---\napiVersion: v1\nkind: Secret\nmetadata: {name: sec', k % 3, '}\ndata: {pw: aGlkZGVu}\n')",
    [
        ("service", "'web' || k", "'img:' || (k % 7)", NONE, "CAST(80 + k AS VARCHAR)", "true"), ("service", "'svc' || k", NONE, NONE, "'80'", "true"), ("service", "'sec' || (k % 3)", NONE, NONE, NONE, "true"), ("service_dep", "'svc' || k", "'app=web' || k", NONE, NONE, "true"),
        ("secret", "'sec' || (k % 3)", "'pw'", "'web' || k", NONE, "true"), ("secret", "'sec' || (k % 3)", "'pw'", "'sec' || (k % 3)", NONE, "true"),
    ],
)
facts_query(
    "facts_helm_chart", "concat('h', k, '/Chart.yaml')", r"concat('apiVersion: v2\nname: chart', k, '\nversion: 0.', n, '.0\ndependencies:\n  - name: redis\n    version: ~', k % 9, '\n    repository: https://charts.ex\n')",
    [("module", "'chart' || k", "'0.' || n || '.0'", NONE, NONE, "true"), ("dep", "'redis'", "'~' || (k % 9)", "'runtime'", NONE, "true")],
)
facts_query(
    "facts_helm_values", "concat('h', k, '/values.yaml')", r"concat('image:\n  repository: reg.ex/app', k % 4, '\n  tag: \"', n, '\"\ndb:\n  password: hidden\n')",
    [("image", "'reg.ex/app' || (k % 4)", "CAST(n AS VARCHAR)", "'image'", NONE, "true"), ("secret", "'db.password'", NONE, "'values'", NONE, "true"), ("service", "'h' || k", NONE, NONE, NONE, "true")],
)
facts_query(
    "facts_terraform", "concat('f', k, '/main.tf')",
    r"concat('terraform {\n  required_providers {\n    aws = {\n      source = \"hashicorp/aws\"\n      version = \"~> ', n, '\"\n    }\n  }\n}\nprovider \"aws\" {}\nprovider \"random\" {}\nresource \"aws_instance\" \"web', k, '\" {\n  ami = data.x.id\n}\nresource \"aws_db_instance\" \"d\" {}\nmodule \"net\" {\n  source = \"../net', k % 3, '\"\n}\nvariable \"db_password\" {\n  type = string\n}\n')",
    [
        ("dep", "'hashicorp/aws'", "'~> ' || n", "'build'", NONE, "true"), ("dep", "'random'", NONE, "'build'", NONE, "true"), ("dep", "'net'", NONE, "'build'", NONE, "true"), ("service", "'web' || k", NONE, NONE, NONE, "true"), ("variable", "'db_password'", "'string'", NONE, NONE, "true"), ("secret", "'db_password'", NONE, "'variable'", NONE, "true"),
    ],
)
facts_query(
    "facts_proto", "concat('a/p', k, '.proto')", r"concat('syntax = \"proto3\"; // s\npackage pkg.n', n, ';\nimport \"x/y', k % 5, '.proto\";\nmessage Outer', k, ' {\n  message Inner { int32 a = 1; }\n}\nservice Api', k, ' {\n  rpc Get (Outer', k, ') returns (Outer', k, ') {}\n}\n')",
    [
        ("module", "'pkg.n' || n", NONE, NONE, NONE, "true"), ("dep", "'x/y' || (k % 5) || '.proto'", NONE, "'build'", NONE, "true"), ("contract", "'Outer' || k", NONE, "'message'", NONE, "true"), ("contract", "'Outer' || k || '.Inner'", NONE, "'message'", NONE, "true"), ("contract", "'Api' || k", NONE, "'service'", NONE, "true"),
        ("contract", "'Api' || k || '.Get'", NONE, "'rpc'", NONE, "true"),
    ],
)
facts_query(
    "facts_openapi", "concat('api', k, '/openapi.yaml')", r"concat('openapi: 3.1.0\ninfo: {title: Api ', k, ', version: \"', n, '\"}\npaths:\n  /things/{id}:\n    get: {operationId: get', k, '}\n    parameters: []\n    delete: {}\ncomponents:\n  schemas:\n    Thing', k % 4, ': {type: object}\n  securitySchemes:\n    key: {type: apiKey}\n')",
    [
        ("module", "'Api ' || k", "CAST(n AS VARCHAR)", NONE, NONE, "true"), ("contract", "'GET /things/{id}'", "'get' || k", "'endpoint'", NONE, "true"), ("contract", "'DELETE /things/{id}'", NONE, "'endpoint'", NONE, "true"), ("contract", "'Thing' || (k % 4)", NONE, "'schema'", NONE, "true"), ("secret", "'key'", NONE, "'security'", NONE, "true"),
    ],
)
facts_query(
    "facts_graphql", "concat('q', k, '/s.graphql')", r"concat('# s\ntype Query {\n  thing', k, '(id: ID!): Thing\n  all: [Thing]\n}\n\"\"\"type Hidden {}\"\"\"\ntype Thing implements Node {\n  n', n, ': Int\n}\nenum E', k % 3, ' { A B }\n')",
    [("contract", "'Query.thing' || k", NONE, "'query'", NONE, "true"), ("contract", "'Query.all'", NONE, "'query'", NONE, "true"), ("contract", "'Thing'", NONE, "'type'", NONE, "true"), ("contract", "'E' || (k % 3)", NONE, "'enum'", NONE, "true")],
)
facts_query(
    "facts_migration", "concat('s', n, '/migrations/V', k, '__add_things', if(k % 2 = 0, '.up', ''), '.sql')", r"concat('-- DROP TABLE no;\nCREATE TABLE IF NOT EXISTS things', k, ' (id int);\nINSERT INTO log VALUES (\'; x\');\n', if(k % 3 = 0, 'DROP TABLE old;\n', ''))",
    [("migration", "'add things'", "CAST(k AS VARCHAR)", "CASE WHEN k % 2 = 0 THEN 'up' ELSE '' END", "'things' || k || ',log' || CASE WHEN k % 3 = 0 THEN ',old' ELSE '' END", "true")],
)
facts_query(
    "facts_codeowners", "concat('r', k, '/CODEOWNERS')", r"concat('# own\n/src/n', n, '/ @a', k % 5, ' @b # why\n*.go @g', k, '\nnobody\n')", [("owner", "'/src/n' || n || '/'", NONE, NONE, "'@a' || (k % 5) || ',@b'", "true"), ("owner", "'*.go'", NONE, NONE, "'@g' || k", "true")],
)
facts_query(
    "facts_decision", "concat('docs/adr/', lpad(k, 4, '0'), '-x.md')", r"concat('# ', k, '. Choose n', n, '\n\n## Status\n\nAccepted\n\n## Decision\n\n- First part\n  goes on.\n- Second ', k, '.\n\n```\n- not a rule\n```\n')",
    [
        ("module", "'Choose n' || n", "CAST(k AS VARCHAR)", "'adr'", NONE, "true"), ("rule", "k || '. Choose n' || n || ' > Status'", "'Accepted'", NONE, NONE, "true"), ("rule", "k || '. Choose n' || n || ' > Decision'", "'First part goes on.'", NONE, NONE, "true"), ("rule", "k || '. Choose n' || n || ' > Decision'", "'Second ' || k || '.'", NONE, NONE, "true"),
    ],
)
ORACLE["facts_decision"] = ORACLE["facts_decision"].replace("lpad(k, 4, '0')", "lpad(CAST(k AS VARCHAR), 4, '0')")
facts_query("facts_lock", "concat('l', k, if(k % 2 = 0, '/go.sum', '/poetry.lock'))", "'anything: ['", [("lock", "CASE WHEN k % 2 = 0 THEN 'go.sum' ELSE 'poetry.lock' END", NONE, NONE, NONE, "true")])


ROUTED = "CASE k % 6 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'web/package.json' WHEN 2 THEN 'k8s/a.yml' WHEN 3 THEN 'x.tfvars' WHEN 4 THEN 'conf/odd.xyz' ELSE 'deploy.cfg' END"


@query("SELECT p, CASE k % 6 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'package.json' WHEN 2 THEN 'kubernetes' WHEN 3 THEN 'terraform' END AS kind, count(*) AS n FROM (SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'web/package.json' WHEN 2 THEN 'k8s/a.yml' WHEN 3 THEN 'x.tfvars' WHEN 4 THEN 'conf/odd.xyz' ELSE 'deploy.cfg' END AS p FROM supplier) GROUP BY ALL")
def manifest_routes(spark, d):
    p = suppliers(spark, d, p=ROUTED)
    return p.groupBy("p", manifests.manifest_kind(F.col("p")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'cfg' ELSE 'lst' END AS key, count(*) AS n FROM supplier WHERE s_suppkey % 4 < 2 GROUP BY 1")
def unread_manifests(spark, d):
    f = suppliers(spark, d, path="concat('m', k, CASE k % 4 WHEN 0 THEN '/a.cfg' WHEN 1 THEN '/a.lst' ELSE '/go.mod' END)").withColumn("class", F.lit("manifest"))
    return manifests.unread(f)


STATEMENTS = r"""CASE k % 8
 WHEN 0 THEN concat('WITH w', n, ' AS (SELECT a FROM raw', k, ') SELECT * FROM w', n, ' JOIN dim USING (a)')
 WHEN 1 THEN concat('INSERT INTO out', k, ' SELECT b.x FROM bin', n, ' b, "Big"."T', k, '" t')
 WHEN 2 THEN concat('MERGE INTO goal', k, ' g USING feed', n, ' f ON g.i = f.i WHEN MATCHED THEN UPDATE SET v = 1')
 WHEN 3 THEN concat('DELETE FROM trash', k, ' USING keep', n, ' WHERE a = b; -- SELECT 1 FROM no')
 WHEN 4 THEN concat('UPDATE tally', k, ' SET m = (SELECT max(x) FROM bin', n, ') WHERE extract(day FROM ts) = 1')
 WHEN 5 THEN concat('CREATE TABLE made', k, ' AS SELECT * FROM bin', n)
 WHEN 6 THEN 'SELECT * FROM %s WHERE id = ?'
 ELSE concat('ALTER TABLE al', k, ' DROP COLUMN c') END"""


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 8 AS c FROM supplier), r AS (
SELECT k, 'WITH' AS verb, '' AS object, false AS destructive, 'raw' || k AS "table", 'reads' AS access, false AS gap FROM s WHERE c = 0 UNION ALL SELECT k, 'WITH', '', false, 'dim', 'reads', false FROM s WHERE c = 0
UNION ALL SELECT k, 'INSERT', 'out' || k, false, 'out' || k, 'writes', false FROM s WHERE c = 1 UNION ALL SELECT k, 'INSERT', 'out' || k, false, 'bin' || n, 'reads', false FROM s WHERE c = 1 UNION ALL SELECT k, 'INSERT', 'out' || k, false, 'Big.T' || k, 'reads', false FROM s WHERE c = 1
UNION ALL SELECT k, 'MERGE', '', false, 'goal' || k, 'writes', false FROM s WHERE c = 2 UNION ALL SELECT k, 'MERGE', '', false, 'feed' || n, 'reads', false FROM s WHERE c = 2
UNION ALL SELECT k, 'DELETE', 'trash' || k, true, 'trash' || k, 'writes', false FROM s WHERE c = 3 UNION ALL SELECT k, 'DELETE', 'trash' || k, true, 'keep' || n, 'reads', false FROM s WHERE c = 3
UNION ALL SELECT k, 'UPDATE', 'tally' || k, false, 'tally' || k, 'writes', false FROM s WHERE c = 4 UNION ALL SELECT k, 'UPDATE', 'tally' || k, false, 'bin' || n, 'reads', false FROM s WHERE c = 4
UNION ALL SELECT k, 'CREATE', 'made' || k, false, 'made' || k, 'writes', false FROM s WHERE c = 5 UNION ALL SELECT k, 'CREATE', 'made' || k, false, 'bin' || n, 'reads', false FROM s WHERE c = 5
UNION ALL SELECT k, 'SELECT', '', false, NULL, NULL, true FROM s WHERE c = 6 UNION ALL SELECT k, 'ALTER', 'al' || k, true, 'al' || k, 'writes', false FROM s WHERE c = 7) SELECT * FROM r""")
def sql_lineage(spark, d):
    return lineage.sql_lineage(suppliers(spark, d, k="k", t=STATEMENTS), "k", "t").drop("line")


@query("""SELECT k, lang, raw, CASE i WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN false WHEN 7 THEN true WHEN 8 THEN false WHEN 9 THEN true WHEN 10 THEN true ELSE false END AS shipped
FROM (SELECT p_partkey AS k, p_partkey % 12 AS i, CASE p_partkey % 12 WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'go' WHEN 4 THEN 'java' WHEN 5 THEN 'java' WHEN 6 THEN 'java' WHEN 7 THEN 'c' WHEN 8 THEN 'c' WHEN 9 THEN 'typescript' WHEN 10 THEN 'csharp' ELSE 'ruby' END AS lang,
CASE p_partkey % 12 WHEN 0 THEN 'os.path' WHEN 1 THEN 'pkg' || p_size WHEN 2 THEN 'net/http' WHEN 3 THEN 'ex.org/x' || p_size WHEN 4 THEN 'java.util.List' WHEN 5 THEN 'javax.crypto.C' || p_size WHEN 6 THEN 'javax.servlet.S' || p_size WHEN 7 THEN '<vector>' WHEN 8 THEN '"stdio.h"' WHEN 9 THEN 'node:fs/promises' WHEN 10 THEN 'System.Text.N' || p_size ELSE 'net/ldap' || p_size END AS raw FROM part)""")
def runtime_imports(spark, d):
    p = L.table(spark, d, "part").selectExpr(
        "p_partkey AS k", "element_at(array('python', 'python', 'go', 'go', 'java', 'java', 'java', 'c', 'c', 'typescript', 'csharp', 'ruby'), cast(p_partkey % 12 AS int) + 1) AS lang",
        "element_at(array('os.path', concat('pkg', p_size), 'net/http', concat('ex.org/x', p_size), 'java.util.List', concat('javax.crypto.C', p_size), concat('javax.servlet.S', p_size), '<vector>', '\"stdio.h\"', 'node:fs/promises', concat('System.Text.N', p_size), concat('net/ldap', p_size)), cast(p_partkey % 12 AS int) + 1) AS raw",
    )
    return p.withColumn("shipped", runtime.ships(F.col("lang"), F.col("raw")))


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """A Python file per order in a directory per customer group: imports of another group, of the runtime, of a dependency and of nothing."""
    o = dealt(L.table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey % 150 AS c"), "k")
    text_ = r"concat('import d', (c * 7 + 3) % 150, '\nimport os\nimport dep', k % 4, '.part\nimport gone', k % 3, '\n\n\ndef f', k, '():\n    run(\'SELECT a FROM parcels WHERE k = 1\')\n')"
    code = o.selectExpr("concat('d', c, '/f', k, '.py') AS path", f"{text_} AS content")
    more = spark.range(1).selectExpr("explode(array(struct('requirements.txt' AS path, 'dep0\\ndep1\\ndep2\\ndep3\\n' AS content), struct('db/migrations/1_init.sql' AS path, 'CREATE TABLE parcels (a int);' AS content))) AS f").select("f.*")
    return classify.with_classes(code.unionByName(more))


CODE = "o AS (SELECT o_orderkey AS k, o_custkey % 150 AS c FROM orders), g AS (SELECT DISTINCT c FROM o)"


@query(f"""WITH {CODE} SELECT '/modules/d' || c AS src, '/modules/d' || ((c * 7 + 3) % 150) AS dst, 'imports' AS kind, count(*) AS weight FROM o WHERE (c * 7 + 3) % 150 <> c AND (c * 7 + 3) % 150 IN (SELECT c FROM g) GROUP BY ALL
UNION ALL SELECT '/modules/d' || c, '/references/pypi-dep' || (k % 4), 'imports', count(*) FROM o GROUP BY ALL UNION ALL SELECT DISTINCT '/modules/d' || c, '/data/parcels', 'reads', 0 FROM o""")
def build_edges(spark, d):
    return B.Build(code_files(spark, d)).edges.select("src", "dst", "kind", "weight")


@query(f"""WITH {CODE} SELECT '/modules/d' || c AS id, 'Module' AS kind, 'd' || c AS title, CAST(count(*) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS exports FROM o GROUP BY c
UNION ALL SELECT '/references/pypi-dep' || x, 'External', 'dep' || x, 1, 0 FROM range(4) t(x) UNION ALL SELECT '/data/parcels', 'Data', 'parcels', 1, 0""")
def build_nodes(spark, d):
    return B.Build(code_files(spark, d)).nodes.select("id", "kind", "title", F.size("files").cast("long").alias("files"), F.size("exports").cast("long").alias("exports"))


@query("SELECT 'unresolved import' AS \"what\", 'python gone' || (o_orderkey % 3) AS name, count(*) AS n FROM orders GROUP BY ALL")
def build_gaps(spark, d):
    return B.Build(code_files(spark, d)).gaps


@query("""WITH g AS (SELECT 'python gone' || (o_orderkey % 3) AS name, count(*) AS n FROM orders GROUP BY 1) SELECT 'unresolved import' AS "what", count(*) AS names, CAST(sum(n) AS BIGINT) AS total, string_agg(name || ' ×' || n, '; ' ORDER BY n DESC, name) AS top FROM g""")
def coverage_report(spark, d):
    gaps = L.table(spark, d, "orders").groupBy(F.lit("unresolved import").alias("what"), F.concat(F.lit("python gone"), (F.col("o_orderkey") % 3).cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return report.coverage(gaps).select("what", "names", "total", F.array_join("top", "; ").alias("top"))


def infra_files(spark: SparkSession, d: str) -> DataFrame:
    """Compose, workflow, contract, rules and ownership files of suppliers, and a Go file in each one's directory."""
    s = L.table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS n")
    parts = (
        ("concat('s', k, '/main.go')", r"'package main\n\nfunc main() {}\n'"),
        ("concat('s', k, '/compose.yml')", r"concat('services:\n  web', k, ':\n    image: img:', n, '\n    depends_on: [db', n, ']\n    build: .\n  db', n, ':\n    image: pg:1\n')"),
        ("concat('.github/workflows/w', k, '.yml')", r"concat('name: W', k, '\non: ', if(k % 2 = 0, 'pull_request', 'workflow_dispatch'), '\njobs:\n  a:\n    runs-on: x\n    steps: [{uses: act/x', n, '@v1}]\n  b:\n    needs: a\n    runs-on: x\n')"),
        ("concat('s', k, '/api.proto')", r"concat('package p', k, ';\nmessage M {}\n')"),
        ("concat('s', k, '/AGENTS.md')", r"'# Rules\n\n- One.\n- Two.\n'"),
    )
    out = None
    for path, content in parts:
        one = s.selectExpr(f"{path} AS path", f"{content} AS content")
        out = one if out is None else out.unionByName(one)
    owners = s.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("/s"), F.col("k").cast("string"), F.lit("/ @t"), F.col("n").cast("string")))), "\n").alias("content")).select(F.lit("CODEOWNERS").alias("path"), "content")
    return classify.with_classes(out.unionByName(owners))


INFRA = "s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), one AS (SELECT count(*) AS n FROM (SELECT 'web' || k FROM s UNION SELECT 'db' || n FROM s))"


@query(f"""WITH {INFRA} SELECT 'Service' AS kind, count(DISTINCT 'web' || k) + count(DISTINCT n) AS n, 0 AS gates, CAST(0 AS BIGINT) AS owned FROM s UNION ALL SELECT 'Pipeline', 2 * count(*), 2 * count(*) FILTER (k % 2 = 0), 0 FROM s
UNION ALL SELECT 'Interface', count(*), 0, 0 FROM s UNION ALL SELECT 'Document', count(*), 0, 0 FROM s UNION ALL SELECT 'External', count(DISTINCT n), 0, 0 FROM s UNION ALL SELECT 'Module', count(*), 0, count(*) FROM s""")
def build_infra_nodes(spark, d):
    n = B.Build(infra_files(spark, d)).nodes
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("tags", "gate")).alias("gates"), F.count_if(F.try_element_at("attrs", F.lit("owners")).isNotNull()).alias("owned"))


@query(f"""WITH {INFRA} SELECT '/services/web' || k AS src, '/services/db' || n AS dst, 'deploys' AS kind FROM s UNION ALL SELECT '/services/web' || k, '/modules/s' || k, 'deploys' FROM s
UNION ALL SELECT '/pipelines/w' || k || '-a', '/pipelines/w' || k || '-b', 'precedes' FROM s UNION ALL SELECT '/pipelines/w' || k || '-a', '/references/github-actions-act-x' || n, 'configures' FROM s""")
def build_infra_edges(spark, d):
    e = B.Build(infra_files(spark, d)).edges
    return e.where("kind IN ('deploys', 'precedes', 'configures')").select("src", "dst", "kind")


@query(f"WITH {INFRA} SELECT '/modules/s' || k AS id, '@t' || n AS owners FROM s")
def owner_attributes(spark, d):
    n = B.Build(infra_files(spark, d)).nodes.where("kind = 'Module'")
    return n.select("id", F.col("attrs")["owners"].alias("owners"))


@query("SELECT 2 * count(*) AS pipelines, 2 * count(*) FILTER (s_suppkey % 2 = 0) AS gates FROM supplier")
def gate_share(spark, d):
    return graph.gate_share(B.Build(infra_files(spark, d)).nodes)


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS g FROM supplier) SELECT 'build' AS topic, 'command' AS rule, false AS declared, CAST(0 AS BIGINT) AS sources FROM s UNION ALL SELECT 'test', 'command', false, 0 FROM s UNION ALL SELECT 'test', 'files', false, 0 FROM s
UNION ALL SELECT 'gates', 'jobs', true, g FROM s UNION ALL SELECT 'gates', 'further', true, n - g FROM s UNION ALL SELECT 'dependencies', 'manifests', false, 0 FROM s UNION ALL SELECT 'dependencies', 'updates', false, 0 FROM s UNION ALL SELECT 'ownership', 'owners', true, 1 FROM s
UNION ALL SELECT 'ownership', 'licence', false, 0 FROM s UNION ALL SELECT 'ownership', 'security', false, 0 FROM s UNION ALL SELECT 'documentation', 'readme', false, 0 FROM s UNION ALL SELECT 'observability', 'library', false, 0 FROM s UNION ALL SELECT 'agent rules', 'rules', true, n FROM s""")
def practice_findings(spark, d):
    f = infra_files(spark, d)
    found = practice.analyse(manifests.read_manifests(f), f)
    return found.select("topic", "rule", "declared", F.size("sources").cast("long").alias("sources"))


@query("""SELECT e AS ecosystem, CASE WHEN m = 0 THEN 'lock ' ELSE 'pinned ' END || e AS rule, m = 0 OR l > 0 OR deps = 0 AS declared FROM (SELECT 'Go' AS e, count(*) FILTER (s_suppkey % 3 = 0) AS m, count(*) FILTER (s_suppkey % 3 = 0) AS l, 1 AS deps FROM supplier
UNION ALL SELECT 'npm', count(*) FILTER (s_suppkey % 3 = 1), 0, 1 FROM supplier UNION ALL SELECT 'Cargo', 0, count(*) FILTER (s_suppkey % 3 = 2), 0 FROM supplier)""")
def practice_locks(spark, d):
    s = suppliers(spark, d, k="k")
    f = s.selectExpr("explode(filter(array(if(k % 3 = 0, struct(concat('g', k, '/go.mod') AS path, 'module m\\nrequire a.b/c v1\\n' AS content), null), if(k % 3 = 0, struct(concat('g', k, '/go.sum') AS path, '' AS content), null), if(k % 3 = 1, struct(concat('n', k, '/package.json') AS path, '{\"dependencies\": {\"a\": \"1\"}}' AS content), null), if(k % 3 = 2, struct(concat('c', k, '/Cargo.lock') AS path, '' AS content), null)), x -> x is not null)) AS f").select("f.*")
    files_ = classify.with_classes(f)
    found = practice.dependency_findings(manifests.read_manifests(f), files_).where("rule <> 'updates'")
    return found.select(F.regexp_extract("rule", " (.*)$", 1).alias("ecosystem"), "rule", "declared")


def bundle_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(fresh, disk): a page per supplier; some changed, lost, written on, of another type or with links that lead nowhere."""
    s = L.table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS n")
    head = r"concat('---\ntitle: S', k, '\ntype: Module\nresource: r', n, '\n---\n# S', k, '\n\n')"
    body = r"concat('<!-- region:a -->\nsee [x](./p', k + 1, '.md)\n<!-- /region:a -->\n')"
    fresh = s.where("k % 10 <> 9").selectExpr("concat('m/p', k, '.md') AS page", f"concat({head}, {body}) AS text")
    old = r"CASE k % 10 WHEN 1 THEN replace({t}, 'see', 'saw') WHEN 2 THEN concat({t}, 'My own note.\n') WHEN 3 THEN replace({t}, 'type: Module', 'type: index') WHEN 4 THEN {t} ELSE {t} END".replace("{t}", f"concat({head}, {body})")
    note = r"if(n % 2 = 0 AND k % 10 = 9, 'Kept by hand.\n', '')"
    disk = s.where("k % 10 <> 8").selectExpr("concat('m/p', k, '.md') AS page", f"concat({old}, {note}) AS text")
    return fresh, disk


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, (SELECT max(s_suppkey) FROM supplier) AS top FROM supplier)
SELECT 'out-of-date' AS kind, 'm/p' || k || '.md' AS page, 'fail' AS severity FROM s WHERE k % 10 IN (1, 3) UNION ALL SELECT 'missing-page', 'm/p' || k || '.md', 'fail' FROM s WHERE k % 10 = 8
UNION ALL SELECT 'orphan-page', 'm/p' || k || '.md', CASE WHEN n % 2 = 0 THEN 'warn' ELSE 'fail' END FROM s WHERE k % 10 = 9 UNION ALL SELECT 'conformance', 'm/p' || k || '.md', 'fail' FROM s WHERE k % 10 = 3
UNION ALL SELECT 'broken-link', 'm/p' || k || '.md', 'fail' FROM s WHERE k % 10 <> 8 AND ((k + 1) % 10 = 8 OR k + 1 > top)""")
def verify_bundle(spark, d):
    fresh, disk = bundle_pages(spark, d)
    return verify.verify(fresh, disk).select("kind", "page", "severity")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT 'manifest.json' AS page, min('m/p' || k || '.md') FILTER (k % 10 = 8) || ' is rendered and not listed; ' || min('m/p' || k || '.md') FILTER (k % 10 = 9) || ' is listed and not rendered' AS detail FROM s""")
def verify_page_list(spark, d):
    fresh, disk = bundle_pages(spark, d)
    return verify.page_list(fresh, disk).select("page", "detail")


@query("""SELECT kind, count(*) AS n, count(*) FILTER (kind IN ('stale-resource', 'out-of-date', 'missing-page', 'page-list')) AS pending FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'out-of-date' WHEN 1 THEN 'broken-link' WHEN 2 THEN 'page-list' ELSE 'orphan-page' END AS kind FROM supplier) GROUP BY kind""")
def pending_severity(spark, d):
    f = suppliers(spark, d, kind="CASE k % 4 WHEN 0 THEN 'out-of-date' WHEN 1 THEN 'broken-link' WHEN 2 THEN 'page-list' ELSE 'orphan-page' END", severity="'fail'")
    return checks.as_of_commit(f).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "pending").alias("pending"))


@query("""WITH ch AS (SELECT -o_orderkey AS ord, 'p' || l_partkey AS path, l_partkey AS k, CAST(l_quantity AS BIGINT) AS ins FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT path, min(ord) AS lo, CAST(floor((min(ord) + max(ord)) / 2.0) AS BIGINT) AS mid FROM ch GROUP BY path),
f AS (SELECT CASE WHEN k % 3 = 0 AND ord > mid THEN 'final/' || ch.path WHEN k % 3 = 2 AND ord > mid THEN 'q/' || ch.path ELSE ch.path END AS path, ins FROM ch JOIN b ON ch.path = b.path)
SELECT path, count(*) AS commits, CAST(sum(ins) AS BIGINT) AS insertions FROM f GROUP BY path""")
def rename_fold(spark, d):
    """Parts that moved twice (k % 3 = 0), moved and came back (1), or moved and whose name was used again (2)."""
    o = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    c = L.table(spark, d, "lineitem").join(o, "l_orderkey").select((-F.col("l_orderkey")).alias("ord"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_partkey").alias("k"), F.col("l_quantity").cast("long").alias("ins"))
    b = c.groupBy("path", "k").agg(F.min("ord").alias("lo"), F.floor((F.min("ord") + F.max("ord")) / 2).cast("long").alias("mid"))
    moves = (
        "filter(array(if(k % 3 = 0, struct(lo - 1 AS ord, concat('moved/', path) AS old, concat('final/', path) AS new), null), if(k % 3 = 0, struct(mid AS ord, path AS old, concat('moved/', path) AS new), null), "
        "if(k % 3 = 1, struct(lo - 1 AS ord, concat('away/', path) AS old, path AS new), null), if(k % 3 = 1, struct(mid AS ord, path AS old, concat('away/', path) AS new), null), "
        "if(k % 3 = 2, struct(mid AS ord, path AS old, concat('q/', path) AS new), null)), x -> x IS NOT NULL)"
    )
    r = b.selectExpr(f"explode({moves}) AS m").selectExpr("m.ord AS ord", "0 AS pos", "m.old AS old", "m.new AS new")
    return history.fold_renames(c, r).groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.sum("ins").alias("insertions"))


SENTENCE_WORDS = "(SELECT doc_id, trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS t FROM documents)"


@query(f"""WITH w AS (SELECT doc_id, t, string_split(t, ' ') AS x FROM {SENTENCE_WORDS}),
s AS (SELECT *, list_position(list_transform(x, lambda y: ends_with(y, '.') AND NOT regexp_matches(y[:-2], '^[A-Za-z]$') AND NOT list_contains(['e.g', 'i.e', 'etc', 'cf', 'vs', 'approx', 'resp', 'viz', 'al', 'Mr', 'Ms', 'Mrs', 'Dr', 'Inc', 'Ltd', 'No', 'vol', 'fig', 'ref'], y[:-2])), true) AS p FROM w)
SELECT doc_id, CASE WHEN p > 0 THEN array_to_string(x[1:p], ' ') END AS sentence FROM s""")
def first_sentence(spark, d):
    """The sentence of texts that end one; texts without a stop are clipped and show null here."""
    got = L.table(spark, d, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("s"), text.fold_space(F.col("text")).alias("t"))
    return got.select("doc_id", F.when(F.endswith("s", F.lit(".")) & F.startswith("t", F.col("s")), F.col("s")).alias("sentence"))


DEFANG_IN = r"CASE turn % 4 WHEN 0 THEN concat('## ', upper(role), ' :  \n', conv_id, '<|im_start|>x') WHEN 1 THEN concat(role, ': hello ', conv_id, ' [INST] # note') WHEN 2 THEN concat('ok\n### ', role, '\nuser: ', conv_id) ELSE concat('# ', role, ' speaks ', conv_id) END"


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '#' || chr(8203) || '# ' || upper(role) || ' :  ' || chr(10) || conv_id || '<' || chr(8203) || '|im_start|>x' WHEN 1 THEN role || ': hello ' || conv_id || ' [' || chr(8203) || 'INST] # note'
WHEN 2 THEN 'ok' || chr(10) || '#' || chr(8203) || '## ' || role || chr(10) || 'user: ' || conv_id ELSE '# ' || role || ' speaks ' || conv_id END AS text FROM conversations""")
def defang(spark, d):
    return L.table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{DEFANG_IN} AS text").withColumn("text", text.defang(F.col("text")))


@query("""WITH c AS (SELECT conv_id, turn, role || conv_id || '.md' AS name, 'say ' || text AS t FROM conversations WHERE NOT contains(text, '#') AND NOT contains(text, '[') AND NOT contains(text, '<'))
SELECT conv_id, turn, '<untrusted_source tag="' || left(sha256(t), 16) || '" name="' || name || '">' || chr(10) || t || chr(10) || '</untrusted_source tag="' || left(sha256(t), 16) || '">' AS text FROM c""")
def wrap_untrusted(spark, d):
    c = L.table(spark, d, "conversations").where("NOT contains(text, '#') AND NOT contains(text, '[') AND NOT contains(text, '<')")
    return c.select("conv_id", "turn", text.wrapped(F.concat("role", F.col("conv_id").cast("string"), F.lit(".md")), F.concat(F.lit("say "), "text")).alias("text"))


@query("""SELECT conv_id, turn, turn % 3 <> 0 AND turn % 4 <> 3 AS holds FROM conversations""")
def grounded_summaries(spark, d):
    c = L.table(spark, d, "conversations").selectExpr("conv_id", "turn", "if(turn % 3 = 0, 'It was cut of', 'It holds.') AS t", "if(turn % 4 = 3, array('a', 'z'), array('a')) AS cites", "array('a', 'b') AS paths")
    return c.select("conv_id", "turn", enrich.grounded(F.col("t"), F.col("cites"), F.col("paths")).alias("holds"))


@query("""WITH p AS (SELECT p_partkey AS k, 'a' || p_size || '/' || CASE p_partkey % 5 WHEN 0 THEN 'x.log' WHEN 1 THEN 'keep.log' WHEN 2 THEN 'out/y.txt' WHEN 3 THEN 'src/z.py' ELSE 'src/out' END AS path, p_size FROM part)
SELECT DISTINCT path FROM p WHERE (path LIKE '%.log' AND NOT (path LIKE '%/keep.log' AND p_size % 2 = 0)) OR path LIKE '%/out/y.txt'""")
def nested_ignore(spark, d):
    """A rule file at the root for logs and one in every second directory that takes a log back; a directory rule covers what lies below."""
    p = L.table(spark, d, "part").selectExpr("concat('a', p_size, '/', element_at(array('x.log', 'keep.log', 'out/y.txt', 'src/z.py', 'src/out'), cast(p_partkey % 5 AS int) + 1)) AS path").distinct()
    root = spark.range(1).selectExpr("'.gitignore' AS path", "'# logs\\n*.log\\nout/\\n' AS content")
    own = L.table(spark, d, "part").where("p_size % 2 = 0").selectExpr("concat('a', p_size, '/.gitignore') AS path", "'!keep.log\\n' AS content").distinct()
    return files.nested_ignored(p, root.unionByName(own))


@query("""WITH l AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) SELECT 'r' || k AS repo, CAST(0 AS BIGINT) AS ord, 'h' || k AS hash, 'Ann' AS author, 'src/a' || n || '.go' AS path, CAST(NULL AS VARCHAR) AS old_path, CAST(k AS BIGINT) AS ins, CAST(1 AS BIGINT) AS del, false AS "binary" FROM l
UNION ALL SELECT 'r' || k, 0, 'h' || k, 'Ann', 'b.png', NULL, 0, 0, true FROM l UNION ALL SELECT 'r' || k, 1, 'g' || k, 'Bob', 'new' || n || '.go', 'old.go', 1, 0, false FROM l""")
def git_log(spark, d):
    log = r"concat('h', k, U, '2026-01-02', U, 'Ann', U, 'fix: a', U, '\n', k, '\t1\tsrc/a', n, '.go', Z, '-\t-\tb.png', Z, 'g', k, U, '2026-01-01', U, 'Bob', U, 'mv', U, '\n1\t0\t', Z, 'old.go', Z, 'new', n, '.go', Z)".replace("U", "char(31)").replace("Z", "char(0)")
    return gitlog.parse_logs(suppliers(spark, d, repo="concat('r', k)", log=log)).select("repo", "ord", "hash", "author", "path", "old_path", "ins", "del", "binary")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT 'd' || (k % 6) AS old_dir, 'e' || (k % 6) AS new_dir FROM s WHERE k % 6 <> 3 GROUP BY k % 6""")
def dir_renames(spark, d):
    """All files of a directory went to one other, but for directory 3, which was split."""
    r = suppliers(spark, d, old_path="concat('d', k % 6, '/f', k)", new_path="concat(if(k % 6 = 3 AND k % 4 < 2, 'z', concat('e', k % 6)), '/f', k)")
    return diff.dir_renames(r)


@query("""WITH s AS (SELECT s_suppkey % 5 AS c FROM supplier) SELECT count(*) FILTER (c = 0) AS added, count(*) FILTER (c = 1) AS removed, count(*) FILTER (c = 2) AS renamed, count(*) FILTER (c = 3) AS gained, count(*) FILTER (c = 4) AS lost, count(*) = 0 AS identical FROM s""")
def diff_summary(spark, d):
    s = suppliers(spark, d, change="element_at(array('added', 'removed', 'renamed', 'gained', 'lost'), cast(k % 5 AS int) + 1)")
    return diff.summary(s.where("change IN ('added', 'removed', 'renamed')"), s.where("change IN ('gained', 'lost')"))


@query("""SELECT p_brand, CASE WHEN count(DISTINCT p_type) > 6 THEN array_to_string((list(DISTINCT p_type ORDER BY p_type))[1:6], ', ') || ' and ' || (count(DISTINCT p_type) - 6) || CASE WHEN count(DISTINCT p_type) = 7 THEN ' other' ELSE ' others' END ELSE string_agg(DISTINCT p_type, ', ' ORDER BY p_type) END AS names FROM part GROUP BY p_brand""")
def name_lists(spark, d):
    return L.table(spark, d, "part").groupBy("p_brand").agg(checks.name_list(F.collect_set("p_type")).alias("names"))


NEAR = "SELECT n_name AS id, n_regionkey AS r, n_nationkey AS k FROM nation"


@query(f"""WITH x AS ({NEAR}) SELECT id, CAST(dense_rank() OVER (ORDER BY low) - 1 AS BIGINT) AS cluster FROM (SELECT id, min(id) OVER (PARTITION BY r) AS low FROM x)""")
def clusters(spark, d):
    """Regions as cliques of their nations, a bridge from region to region: each clique is a cluster."""
    nodes, edges = nation_cliques(spark, d)
    return graph.clusters(nodes, edges).select("id", F.col("cluster").cast("long").alias("cluster"))


@query(f"""WITH x AS ({NEAR}), lead_ AS (SELECT min(id) AS id, r FROM x GROUP BY r) SELECT a.id AS src, b.id AS dst FROM lead_ a JOIN lead_ b ON b.r = a.r + 1""")
def bridges(spark, d):
    nodes, edges = nation_cliques(spark, d)
    return graph.bridges(edges, graph.clusters(nodes, edges)).select("src", "dst")


def nation_cliques(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = L.table(spark, d, "nation").selectExpr("n_name AS id", "n_regionkey AS r")
    pairs = n.selectExpr("id AS src", "r").join(n.selectExpr("id AS dst", "r"), "r").where("src < dst").select("src", "dst")
    first = n.groupBy("r").agg(F.min("id").alias("id"))
    line = first.selectExpr("id AS src", "r + 1 AS r").join(first.selectExpr("id AS dst", "r"), "r").select("src", "dst")
    return n.select("id"), pairs.union(line).withColumn("kind", F.lit("imports"))


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_linenumber = 1), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT a AS id, string_agg(b, ',' ORDER BY b) AS neighbours FROM u GROUP BY a""")
def undirected_adjacency(spark, d):
    e = L.supply_edges(spark, d).where("ord % 10 = 1")
    return graph.adjacency(e, directed=False).select("id", F.array_join("neighbours", ",").alias("neighbours"))


@query("""SELECT 's1' AS src, 'p' || l_partkey AS dst, true AS leaves FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1 AND l_partkey IN (SELECT p_partkey FROM part)) UNION ALL SELECT 's' || l_suppkey, 'p1', false FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 1)""")
def edges_at(spark, d):
    n, e = L.supply_nodes(spark, d), L.supply_edges(spark, d).select("src", "dst", "kind").withColumn("kind", F.lit("x")).distinct()
    return graph.edges_at(n, e, "s1").select("src", "dst", F.lit(True).alias("leaves")).unionByName(graph.edges_at(n, e, "p1", out=False).select("src", "dst", F.lit(False).alias("leaves")))


@query("""SELECT 's' || s_suppkey AS id, 'Module' AS kind FROM supplier WHERE s_suppkey = 7""")
def node_lookup(spark, d):
    return graph.node(L.supply_nodes(spark, d), "s7")


@query("""SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS nodes, count(*) AS edges FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def graph_counts(spark, d):
    return graph.counts(L.supply_nodes(spark, d), L.supply_edges(spark, d).select("src", "dst").distinct())


@query("""SELECT lang, count(*) FILTER (e AND g) AS tp, count(*) FILTER (NOT e) AS fp, count(*) FILTER (NOT g) AS fn FROM (SELECT lang, doc_id % 3 <> 0 AS e, doc_id % 5 <> 0 AS g FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 <> 0) GROUP BY lang""")
def score_groups(spark, d):
    t = L.table(spark, d, "documents").select("lang", "doc_id")
    return checks.score_by(t.where("doc_id % 3 <> 0"), t.where("doc_id % 5 <> 0"), "lang", ["doc_id"]).select("lang", "tp", "fp", "fn")


SOURCES = r"""CASE k % 6
 WHEN 0 THEN struct(concat('g', k, '.go') AS path, 'go' AS lang, concat('package p', n, '\n\nimport (\n\t"fmt"\n\tx "ex.org/y', n, '"\n)\n\n// func Hidden() {}\ntype T', k, ' struct{}\n\nfunc (t *T', k, ') Run() { fmt.Println("func No() {}") }\n\nfunc low() {}\n') AS content)
 WHEN 1 THEN struct(concat('p', k, '.py') AS path, 'python' AS lang, concat('import os\nfrom . import m', n, '\n\n\nclass C', k, ':\n    def go(self):\n        def inner(): pass\n\n    def _own(self): pass\n\n\ndef _low(): pass\n') AS content)
 WHEN 2 THEN struct(concat('t', k, '.ts') AS path, 'typescript' AS lang, concat('import {\n  a,\n  b,\n} from "./m', n, '"\n/* export class No {} */\nexport class K', k, ' {}\nconst q = `export function no() {}`\nexport default function run', k, '() {}\n') AS content)
 WHEN 3 THEN struct(concat('j', k, '.java') AS path, 'java' AS lang, concat('package a.n', n, ';\n\nimport java.util.List;\n\npublic class J', k, ' {\n  public int f(int x) { return 1; }\n  void low() {}\n  // public void no() {}\n}\n') AS content)
 WHEN 4 THEN struct(concat('r', k, '.rs') AS path, 'rust' AS lang, concat('use crate::n', n, '::{A, b::C as D};\npub struct S', k, ';\nimpl S', k, ' {\n    pub fn go(&self) {}\n    fn low(&self) {}\n}\n/* outer /* pub fn no() {} */ still */\npub(crate) fn near() {}\n') AS content)
 ELSE struct(concat('s', k, '.sh') AS path, 'shell' AS lang, concat('#!/bin/sh\n. ./lib', n, '.sh\ncat <<EOF\nno() { :; }\nEOF\ngo', k, '() { :; }\n_low() { :; }\n') AS content) END"""


def source_files(spark: SparkSession, d: str) -> DataFrame:
    return suppliers(spark, d, f=SOURCES).select("f.*")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS c FROM supplier)
SELECT 'g' || k || '.go' AS path, 'T' || k AS name, 'type' AS kind, '' AS recv, true AS exported FROM s WHERE c = 0 UNION ALL SELECT 'g' || k || '.go', 'Run', 'method', 'T' || k, true FROM s WHERE c = 0 UNION ALL SELECT 'g' || k || '.go', 'low', 'func', '', false FROM s WHERE c = 0
UNION ALL SELECT 'p' || k || '.py', 'C' || k, 'type', '', true FROM s WHERE c = 1 UNION ALL SELECT 'p' || k || '.py', 'go', 'method', 'C' || k, true FROM s WHERE c = 1 UNION ALL SELECT 'p' || k || '.py', '_own', 'method', 'C' || k, false FROM s WHERE c = 1 UNION ALL SELECT 'p' || k || '.py', '_low', 'func', '', false FROM s WHERE c = 1
UNION ALL SELECT 't' || k || '.ts', 'K' || k, 'type', '', true FROM s WHERE c = 2 UNION ALL SELECT 't' || k || '.ts', 'q', 'const', '', false FROM s WHERE c = 2 UNION ALL SELECT 't' || k || '.ts', 'run' || k, 'func', '', true FROM s WHERE c = 2
UNION ALL SELECT 'j' || k || '.java', 'J' || k, 'type', '', true FROM s WHERE c = 3 UNION ALL SELECT 'j' || k || '.java', 'f', 'method', 'J' || k, true FROM s WHERE c = 3 UNION ALL SELECT 'j' || k || '.java', 'low', 'method', 'J' || k, false FROM s WHERE c = 3
UNION ALL SELECT 'r' || k || '.rs', 'S' || k, 'type', '', true FROM s WHERE c = 4 UNION ALL SELECT 'r' || k || '.rs', 'go', 'method', 'S' || k, true FROM s WHERE c = 4 UNION ALL SELECT 'r' || k || '.rs', 'low', 'method', 'S' || k, false FROM s WHERE c = 4 UNION ALL SELECT 'r' || k || '.rs', 'near', 'func', '', false FROM s WHERE c = 4
UNION ALL SELECT 's' || k || '.sh', 'go' || k, 'func', '', true FROM s WHERE c = 5 UNION ALL SELECT 's' || k || '.sh', '_low', 'func', '', false FROM s WHERE c = 5""")
def source_symbols(spark, d):
    return extract.extract(source_files(spark, d)).select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.kind", "s.recv", "s.exported")


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 6 AS c FROM supplier)
SELECT 'g' || k || '.go' AS path, 'fmt' AS raw, '' AS alias FROM s WHERE c = 0 UNION ALL SELECT 'g' || k || '.go', 'ex.org/y' || n, 'x' FROM s WHERE c = 0 UNION ALL SELECT 'p' || k || '.py', 'os', '' FROM s WHERE c = 1 UNION ALL SELECT 'p' || k || '.py', '.', '' FROM s WHERE c = 1
UNION ALL SELECT 't' || k || '.ts', './m' || n, '' FROM s WHERE c = 2 UNION ALL SELECT 'j' || k || '.java', 'java.util', '' FROM s WHERE c = 3 UNION ALL SELECT 'r' || k || '.rs', 'crate::n' || n || '::A', '' FROM s WHERE c = 4 UNION ALL SELECT 'r' || k || '.rs', 'crate::n' || n || '::b::C', 'D' FROM s WHERE c = 4
UNION ALL SELECT 's' || k || '.sh', './lib' || n || '.sh', '' FROM s WHERE c = 5""")
def source_imports(spark, d):
    return extract.extract(source_files(spark, d)).select("path", F.explode("imports").alias("i")).select("path", "i.raw", "i.alias")


@query("""SELECT 'q' || s_suppkey || '.py' AS path, 'bin' || s_nationkey AS "table", CASE WHEN s_suppkey % 2 = 0 THEN 'reads' ELSE 'writes' END AS access, 2 AS line FROM supplier""")
def source_queries(spark, d):
    f = suppliers(spark, d, path="concat('q', k, '.py')", lang="'python'", content=r"concat('def f():\n    run(\'', if(k % 2 = 0, concat('SELECT a FROM bin', n, ' WHERE b = 1'), concat('INSERT INTO bin', n, ' (a) VALUES (1)')), '\')\n    log(\'select one of the rows from here\')\n    run(\'SELECT * FROM %s\')\n')")
    return extract.extract(f).select("path", F.explode("queries").alias("q")).select("path", "q.table", "q.access", "q.line")


@query("""WITH t AS (SELECT doc_id, text, (SELECT max(n) FROM range(0, 101) r(n) WHERE strlen(left(text, n)) <= 100) AS h, (SELECT max(n) FROM range(0, 101) r(n) WHERE strlen(right(text, n)) <= 100) AS t FROM documents)
SELECT doc_id, left(text, h) AS head, right(text, t) AS tail FROM t""")
def text_caps(spark, d):
    raw = F.col("text").cast("binary")
    return L.table(spark, d, "documents").select("doc_id", files.head_bytes(raw, 100).alias("head"), files.tail_bytes(raw, 100).alias("tail"))


@query("SELECT doc_id, replace(replace(replace(replace(text, chr(10), chr(13) || chr(10)), '. ', '.' || chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def newline_normal(spark, d):
    mixed = F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit(".\r"))
    return L.table(spark, d, "documents").select("doc_id", text.newlines(mixed).alias("text"))


@query("""WITH r AS (SELECT n_regionkey AS r, count(*) AS k FROM nation GROUP BY 1), m AS (SELECT sum(k * (k - 1) / 2) + count(*) - 1 AS m FROM r), d AS (SELECT r, k * (k - 1) + CASE WHEN r IN ((SELECT min(r) FROM r), (SELECT max(r) FROM r)) THEN 1 ELSE 2 END AS deg, k FROM r)
SELECT CAST(round(1000000 * (sum(k * (k - 1) / 2) / m - sum(deg * deg) / (4.0 * m * m))) AS BIGINT) AS millionths FROM d, m GROUP BY m""")
def cluster_modularity(spark, d):
    nodes, edges = nation_cliques(spark, d)
    return graph.modularity(edges, graph.clusters(nodes, edges)).select(F.round(F.col("modularity") * 1000000).cast("long").alias("millionths"))


@query(f"""WITH x AS ({NEAR}) SELECT id, CAST(dense_rank() OVER (ORDER BY low) - 1 AS BIGINT) AS cluster FROM (SELECT id, min(id) OVER (PARTITION BY r) AS low FROM x)""")
def spread_clusters(spark, d):
    nodes, edges = nation_cliques(spark, d)
    return graph.spread_clusters(nodes, edges)
