from cartograph.operators import enrich, graph, report, verify
from cartograph.sinks import bundle

NODE = "id string, kind string, title string, description string, path string, tags array<string>, attrs map<string,string>, files array<string>, exports array<string>"
EDGE = "src string, dst string, kind string, weight long, confidence string"


def sample(spark):
    nodes = spark.createDataFrame([("/modules/oven", "Module", "oven", "Bakes.", "oven", ["hot"], {"files": "2"}, ["oven/a.rs"], ["Bake"]), ("/data/loaf", "Data", "loaf", "", "", [], {}, [], [])], NODE)
    return nodes, spark.createDataFrame([("/modules/oven", "/data/loaf", "writes", 3, "inferred")], EDGE)


def test_pages_are_written_merged_and_swept(spark, tmp_path):
    nodes, edges = sample(spark)
    rows = [tuple(r) for r in bundle.pages(nodes, edges).collect()]
    extra = {"index.md": bundle.index_page(nodes), "log.md": bundle.log_page(None, "made"), "manifest.json": bundle.manifest_json(nodes, edges, "c1")}
    assert bundle.write(str(tmp_path), rows, extra) == {"written": 5, "unchanged": 0, "deleted": 0, "marked": 0}
    assert bundle.write(str(tmp_path), rows, extra)["unchanged"] == 5
    page = tmp_path / "modules/oven.md"
    text = page.read_text()
    assert "writes ×3 [loaf](../data/loaf.md) (inferred)" in text and "[oven](../modules/oven.md)" in (tmp_path / "data/loaf.md").read_text()
    page.write_text(text.replace("tags:", "mine: yes I wrote this\ntags:") + "A note by hand.\n")
    changed = [(n, t.replace("Bakes.", "Bakes bread.")) for n, t in rows]
    bundle.write(str(tmp_path), changed, extra)
    text = page.read_text()
    assert "Bakes bread." in text and "A note by hand." in text and "mine: yes I wrote this" in text
    assert bundle.write(str(tmp_path), [], {"index.md": extra["index.md"]})["deleted"] == 2  # loaf and the log; the oven's page has a note
    assert "status: concept-removed" in page.read_text() and not (tmp_path / "data/loaf.md").exists()
    assert bundle.static_site(str(tmp_path), str(tmp_path / "site")) == 2 and "Bakes bread." in (tmp_path / "site/modules/oven.html").read_text()


def test_front_matter_and_scalars():
    assert [bundle.yaml_scalar(x) for x in ("plain text", "yes", "a: b", "", "1.2", " x")] == ["plain text", '"yes"', '"a: b"', '""', '"1.2"', '" x"']
    old = "---\ntitle: A\nresource: r1\nverification: human:ann\n---\nbody\n"
    assert "verification: human:ann" in bundle.downgraded(old, "---\ntitle: A\nresource: r1\n---\nnew\n") and "stale" not in bundle.downgraded(old, "---\nresource: r1\n---\n")
    assert "status: stale" in bundle.downgraded(old, "---\nresource: r2\n---\nnew\n")
    assert bundle.relative_link("a/b/c.md", "a/d.md") == "../d.md" and bundle.front_matter("no front") == ([], "no front")


def test_verification_finds_each_kind(spark):
    page = lambda t, body: f"---\ntitle: T\ntype: {t}\nresource: r\n---\n{body}"
    link = "<!-- region:a -->\n[x](./b.md) `[no](./q.md)` [web](https://e.x)\n```\n[no](./z.md)\n```\n<!-- /region:a -->\n"
    fresh = spark.createDataFrame([("m/a.md", page("Module", link)), ("m/b.md", page("Module", "")), ("m/c.md", page("Module", ""))], "page string, text string")
    disk = spark.createDataFrame([("m/a.md", page("Module", link.replace("./b.md", "./gone.md"))), ("m/b.md", page("index", "")), ("m/d.md", page("Module", "hand written\n")), ("m/e.md", page("Module", "")), ("index.md", "no front")], "page string, text string")
    got = {(r.kind, r.page, r.severity) for r in verify.verify(fresh, disk, recorded="c1", wanted="c2").collect()}
    assert got == {
        ("broken-link", "m/a.md", "fail"), ("out-of-date", "m/a.md", "fail"), ("out-of-date", "m/b.md", "fail"), ("conformance", "m/b.md", "fail"), ("missing-page", "m/c.md", "fail"), ("orphan-page", "m/d.md", "warn"),
        ("orphan-page", "m/e.md", "fail"), ("conformance", "index.md", "fail"), ("stale-resource", "manifest.json", "fail"),
    }
    later = {(r.kind, r.severity) for r in verify.verify(fresh, disk, recorded="c1", wanted="c2", as_of=True).collect()}
    assert ("out-of-date", "pending") in later and ("broken-link", "fail") in later
    assert verify.skipped_links(verify.page_facts(disk)).first().skipped == 1


def test_summaries_keep_to_the_budget_and_hold(spark):
    files = spark.createDataFrame([("/m/a", "a/x.rs", "line\n" * 10, False), ("/m/a", "a/y_test.rs", "t", True), ("/m/b", "b/z.rs", "zz", False), ("/m/c", "c/w.rs", "w", False)], "node string, path string, content string, is_test boolean")
    rows = enrich.prompts(enrich.sources(files, per_file=12), "model").orderBy("id").collect()
    assert [r.paths for r in rows] == [["a/x.rs"], ["b/z.rs"], ["c/w.rs"]] and "line\nline\n\n" in rows[0].prompt and "<untrusted_source" in rows[0].prompt
    cache = {}
    said = {"/m/a": ("It bakes.", ["a/x.rs"], 10), "/m/b": ("cut off in", ["b/z.rs"], 10), "/m/c": ("Fine.", ["elsewhere"], 10)}
    r = enrich.run(rows, lambda i, p: said[i], cache)
    assert r.summaries == [("/m/a", "It bakes.", ["a/x.rs"])] and (r.asked, r.refused) == (3, 2)
    again = enrich.run(rows, lambda i, p: 1 / 0, cache)
    assert again.cached == 1 and again.fault.startswith("ZeroDivisionError")
    assert enrich.run(rows, lambda i, p: said[i], {}, enrich.Budget(calls=1)).over_budget == 2


def test_report_and_spans(spark):
    gaps = spark.createDataFrame([("x", "a", 3), ("x", "b", 5), ("x", "c", 1), ("y", "d", 1)], "what string, name string, n long")
    assert report.lines(report.coverage(gaps, 2)) == ["x: 9 of 3 names: b ×5, a ×3 and 1 more", "y: 1 of 1 names: d ×1"]
    off, on = report.Spans(), report.Spans(True)
    for s in (off, on):
        with s.stage("read", files=2):
            pass
    assert not off.rows and on.rows[0][0] == "read" and on.rows[0][2] == {"files": 2}


def test_gate_share(spark):
    n = spark.createDataFrame([("Pipeline", ["gate"]), ("Pipeline", []), ("Module", ["gate"])], "kind string, tags array<string>")
    assert tuple(graph.gate_share(n).first()) == (2, 1)
