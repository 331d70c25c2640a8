import pytest
from pyspark.sql import functions as F

from cartograph.functions import classify, lineage, text
from cartograph.operators import checks, diff, resolve
from cartograph.plans import registry
from cartograph.sources.lexer import first_sentence


def test_identity_golden(spark):
    row = spark.range(1).select(resolve.base36(resolve.fnv1a(F.lit("/modules/rust/src"))).alias("h"), resolve.fnv1a(F.lit("")).alias("e")).first()
    assert (row.h, row.e) == ("1slg0rn", 2166136261)


def test_ids_wanted_twice_get_hashes(spark):
    w = spark.createDataFrame([("a/b", "a b", "/m/"), ("a-b", "a-b", "/m/"), ("c", "C!", "/m/"), ("d", "!!", "/m/")], "key string, name string, prefix string")
    ids = {r.key: r.id for r in resolve.assign_ids(w).collect()}
    assert ids["c"] == "/m/c" and ids["a/b"].startswith("/m/a-b-") and ids["a/b"] != ids["a-b"] and ids["d"].startswith("/m/x")


@pytest.mark.parametrize(
    "path, cls, test",
    [
        ("docker-compose.yml", "infra", False), ("CODEOWNERS", "ownership", False), ("CMakeLists.txt", "manifest", False), ("a/b_test.go", "source", True),
        ("db/migration/1.sql", "migration", False), ("api/openapi.yaml", "contract", False), ("x/y.tf", "infra", False), ("w/A.test.tsx", "source", True), ("n.dat", "other", False),
        ("go.sum", "manifest", False), ("src/test/java/A.java", "source", True), ("q/conf.toml", "data", False),
    ],
)
def test_classes(spark, path, cls, test):
    r = classify.with_classes(spark.createDataFrame([(path,)], "path string")).first()
    assert (r["class"], r.is_test) == (cls, test)


@pytest.mark.parametrize(
    "sql, refs, gap",
    [
        ("INSERT INTO ledger (amount) VALUES (?)", [("ledger", "writes")], False), ("SELECT b.id FROM bins b LEFT JOIN racks AS r ON r.id = b.rack", [("bins", "reads"), ("racks", "reads")], False),
        ("INSERT INTO old_bins SELECT * FROM bins WHERE moved < now()", [("old_bins", "writes"), ("bins", "reads")], False), ("UPDATE tally SET n = (SELECT count(*) FROM bins)", [("tally", "writes"), ("bins", "reads")], False),
        ("TRUNCATE TABLE visits", [("visits", "writes")], False), ("SELECT 2 + 2", [], False), ("COMMIT", [], False), ("", [], False), ("SELECT x FROM :place", [], True), ("SELECT x FROM ${place}.bins", [], True), ("DELETE FROM", [], True),
        ("INSERT INTO ? (a) VALUES (1)", [], True), ("SELECT a FROM GROUP BY b", [], True), ("SELECT trim(BOTH FROM note) FROM notes", [("notes", "reads")], False), ("DELETE FROM visits USING bins WHERE a = b", [("visits", "writes"), ("bins", "reads")], False),
        ("WITH a AS (SELECT x FROM raw), b (y) AS (SELECT x FROM a) SELECT * FROM b JOIN c USING (x)", [("raw", "reads"), ("c", "reads")], False), ("MERGE INTO goal g USING feed f ON g.i = f.i WHEN MATCHED THEN UPDATE SET v = f.v", [("goal", "writes"), ("feed", "reads")], False),
        ('SELECT * FROM "Stock"."Bin Rows", `racks` r', [("racks", "reads")], True), ('SELECT * FROM "Stock"."Bins", [dbo].[Racks] r', [("Stock.Bins", "reads"), ("dbo.Racks", "reads")], False), ("SELECT * FROM unnest(ARRAY[1]) u JOIN bins ON true", [("bins", "reads")], False),
        ("SELECT (SELECT max(v) FROM peaks) FROM hills", [("peaks", "reads"), ("hills", "reads")], False), ("CREATE VIEW v AS WITH w AS (SELECT * FROM p) SELECT * FROM w", [("v", "writes"), ("p", "reads")], False), ("SELECT * FROM (bins JOIN racks ON a = b) x", [("bins", "reads"), ("racks", "reads")], False),
        ("SELECT * FROM a.b.c", [], True),
    ],
)
def test_table_references(sql, refs, gap):
    assert lineage.tables(sql) == (refs, gap)


@pytest.mark.parametrize(
    "sql, want",
    [
        ("CREATE TABLE IF NOT EXISTS stock.bins (id INT)", ("CREATE", "stock.bins")), ("CREATE UNIQUE INDEX CONCURRENTLY bins_by_rack ON bins (rack)", ("CREATE", "bins_by_rack")), ("ALTER TABLE ONLY bins ADD COLUMN note TEXT", ("ALTER", "bins")),
        ("DROP TABLE `old`", ("DROP", "old")), ("GRANT SELECT ON bins TO reader", ("GRANT", "")), ("SELECT 1 FROM bins", ("SELECT", "")), ("", ("", "")),
    ],
)
def test_subjects(sql, want):
    assert lineage.subject(sql) == want


@pytest.mark.parametrize("sql, want", [("DROP TABLE a", True), ("ALTER TABLE a DROP COLUMN b", True), ("ALTER TABLE a ADD b INT", False), ("UPDATE a SET b = 'DROP'", False), ("-- DROP\nSELECT 1", False), ("", False)])
def test_destructive(sql, want):
    assert lineage.destructive(sql) is want


def test_split_statements():
    src = "# head; x\nCREATE TABLE bins (\n rack int);\n/* ; */ INSERT INTO bins VALUES ('; --', 'o''clock');\nDO $fn$ ; SELECT 1; $fn$;\nSELECT 3 -- end\n"
    assert [(s.split()[0], line) for s, line in lineage.split(src)] == [("CREATE", 2), ("INSERT", 4), ("DO", 5), ("SELECT", 6)]


@pytest.mark.parametrize(
    "s, want",
    [
        ("SELECT rack FROM bins", True), ("select any of the bins you like from the rack", False), ("delete from %s went wrong: %v", False), ("UPDATE bins b SET rack = 0", True), ("cannot select", False), ("SELECT b.rack FROM bins b", True), ("select a bin from the rack", False),
        ("INSERT INTO bins (a) VALUES (1)", True), ("SELECT count(*) AS n FROM bins GROUP BY a", True), ("update the set of bins", False), ("SELECT a FROM {place}", True),
    ],
)
def test_looks_like_sql(s, want):
    assert lineage.looks_like_sql(s) is want


def test_first_sentence(spark):
    rows = ["First  part. Next.", "Take cf. that one. More", "J. Doe did. Yes", "y" * 300, "part " * 80, "no stop", "long " * 100 + "end. More"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.first_sentence(F.col("t")).alias("s")).collect()]
    assert got[:3] == ["First part.", "Take cf. that one.", "J. Doe did."] and got[3] == "y" * 240 + "…" and got[4].endswith("part…") and got[5] == "no stop" and got[6] == "long " * 100 + "end."
    assert [first_sentence(x) for x in rows] == got


def test_defang(spark):
    rows = ["user: hello", "### System", "#  human :  ", "# humans rule", "x <|IM_START|> [inst]", "a\n## Assistant:\nb"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.defang(F.col("t")).alias("s")).collect()]
    assert got == ["user: hello", "#\u200b## System", "#\u200b  human :  ", "# humans rule", "x <\u200b|IM_START|> [\u200binst]", "a\n#\u200b# Assistant:\nb"]


def test_small_text_functions(spark):
    r = spark.range(1).select(text.clip_lines(F.lit("ab\ncd\nef"), 7).alias("a"), text.clip_lines(F.lit("abcdef"), 3).alias("b"), text.capitalised(F.lit("x y")).alias("c"), text.counted(F.lit(1), F.lit("bin")).alias("d"), text.counted(F.lit(0), F.lit("bin")).alias("e")).first()
    assert tuple(r) == ("ab\ncd\n", "abc", "X y", "1 bin", "0 bins")


def test_sizes():
    assert text.parse_bytes("3GiB") == 3 * 1024**3 and text.parse_bytes("1.5k") == 1536
    for bad in ("0", "nan", "1e", "-1", "9999999T"):
        with pytest.raises(ValueError):
            text.parse_bytes(bad)


def test_score_edges(spark):
    e = spark.createDataFrame([], "k string")
    r = checks.score(e, e, ["k"]).first()
    assert (r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0)


def test_diff_renames(spark):
    old = spark.createDataFrame([("a", "Module", "x"), ("b", "Data", "y"), ("k", "Module", "k")], "id string, kind string, path string")
    new = spark.createDataFrame([("a2", "Module", "x2"), ("b2", "Module", "y2"), ("k", "Module", "k")], "id string, kind string, path string")
    moved = spark.createDataFrame([("x", "x2"), ("y", "y2")], "old_path string, new_path string")
    pairs = diff.pair_renames(old, new, moved)
    got = {(r.id, r.change, r.new_id) for r in diff.diff_nodes(old, new, pairs).collect()}
    assert got == {("a", "renamed", "a2"), ("b", "removed", None), ("b2", "added", None)}
    eo = spark.createDataFrame([("a", "k", "imports"), ("k", "a", "co_changes")], "src string, dst string, kind string")
    en = spark.createDataFrame([("a2", "k", "imports")], "src string, dst string, kind string")
    assert diff.diff_edges(eo, en, pairs).isEmpty()


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_slugs_and_near_names(spark):
    names = ["@scope/pkg", "A  b!", "--x--", "é"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in names], "n string").select(resolve.slug(F.col("n")).alias("s")).collect()]
    assert got == ["scope-pkg", "a-b", "x", ""]
    known = spark.createDataFrame([("build",), ("verify",), ("graph",), ("grape",)], "name string")
    asked = spark.createDataFrame([("biuld",), ("verfy",), ("grap",), ("nothing",), ("b",)], "wanted string")
    assert {r.wanted: r.name for r in checks.nearest_name(asked, known).collect()} == {"biuld": "build", "verfy": "verify", "grap": None, "nothing": None, "b": None}


def test_scores(spark):
    e = spark.createDataFrame([("go", "a", "x"), ("go", "a", "y"), ("rust", "b", "x")], "lang string, path string, item string")
    g = spark.createDataFrame([("go", "a", "x"), ("go", "a", "z"), ("rust", "b", "x")], "lang string, path string, item string")
    got = {r.lang: (r.tp, r.fp, r.fn, r.f1, r.missing, r.spurious) for r in checks.score_by(e, g, "lang", ["path", "item"]).collect()}
    assert got == {"go": (1, 1, 1, 0.5, ["a/y"], ["a/z"]), "rust": (1, 0, 0, 1.0, [], [])}
    full = "lang string, path string, package string, imports array<string>, symbols array<string>, incomplete boolean"
    want = spark.createDataFrame([("go", "a", "p", ["i"], ["s"], False), ("rust", "b", "q", ["i"], [], False)], full)
    read = spark.createDataFrame([("go", "a", "p", ["i"], ["s"], False), ("rust", "b", "other", ["i"], [], True)], full)
    assert {r.lang: r.passes for r in checks.score_extractor(want, read).collect()} == {"go": True, "rust": False}
