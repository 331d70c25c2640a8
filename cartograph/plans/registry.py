"""Queries that bind the operators to the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.functions import classify, text
from cartograph.operators import checks, diff, graph, history, resolve
from cartograph.plans import corpora
from cartograph.plans import lenses as L
from cartograph.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


RAW = """raw AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst,
  CASE l_returnflag WHEN 'A' THEN 'imports' WHEN 'N' THEN 'reads' ELSE 'co_changes' END AS kind,
  CASE WHEN l_linenumber = 1 THEN 'extracted' WHEN l_linenumber < 4 THEN 'inferred' ELSE 'ambiguous' END AS confidence,
  CAST(l_quantity AS BIGINT) AS weight, CAST(l_orderkey AS VARCHAR) AS source, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
edges AS (SELECT src, dst, kind, CAST(sum(weight) AS BIGINT) AS weight,
  arg_max(confidence, CASE confidence WHEN 'extracted' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END * 1000000000000 - ord) AS confidence,
  arg_max(source, CASE confidence WHEN 'extracted' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END * 1000000000000 - ord) AS source FROM raw GROUP BY ALL),
nodes AS (SELECT 's' || s_suppkey AS id, 'Module' AS kind FROM supplier UNION ALL SELECT 'p' || p_partkey, 'External' FROM part)"""
DEGREES = f"""WITH {RAW}, ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges)
SELECT n.id, CAST(coalesce(sum(i), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(o), 0) AS BIGINT) AS out_degree, CAST(coalesce(sum(i + o), 0) AS BIGINT) AS total
FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY n.id"""


def merged(spark, d) -> DataFrame:
    return graph.merge_edges(L.supply_edges(spark, d))


@query(f"WITH {RAW} SELECT src, dst, kind, confidence, weight, source FROM edges")
def edge_merge(spark, d):
    return merged(spark, d)


@query(DEGREES)
def degrees(spark, d):
    return graph.degrees(L.supply_nodes(spark, d), merged(spark, d))


@query(f"SELECT * FROM ({DEGREES}) ORDER BY total DESC, id LIMIT 20")
def hubs_top20(spark, d):
    return graph.hubs(L.supply_nodes(spark, d), merged(spark, d), 20)


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
def orphans(spark, d):
    nodes = L.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")).union(
        L.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    )
    edges = L.table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    return graph.orphans(nodes, edges)


PARTIAL = "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), n AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size > 10)"


def _partial(spark, d):
    s = L.table(spark, d, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    p = L.table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return s.union(p), L.supply_edges(spark, d).select("src", "dst").distinct()


@query(f"{PARTIAL} SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n)")
def dangling(spark, d):
    nodes, edges = _partial(spark, d)
    return graph.dangling(edges, nodes)


@query(f"{PARTIAL} SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def drop_dangling(spark, d):
    nodes, edges = _partial(spark, d)
    return graph.with_both_ends(edges, nodes)


@query("""WITH w AS (SELECT 'n' || c_nationkey AS id, c_name AS title, c_mktsegment AS tag, c_custkey AS ord FROM customer)
SELECT id, 'Module' AS kind, arg_min(title, ord) AS title, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, arg_min(tag, ord) AS segment FROM w GROUP BY id""")
def node_merge(spark, d):
    c = L.table(spark, d, "customer")
    empty = F.array().cast("array<string>")
    nodes = c.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id"), F.lit("Module").alias("kind"), F.col("c_name").alias("title"), F.lit("").alias("description"),
        F.lit("").alias("path"), F.lit("").alias("lang"), F.array("c_mktsegment").alias("tags"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attrs"),
        empty.alias("files"), empty.alias("exports"), F.col("c_custkey").alias("ord"),
    )
    return graph.merge_nodes(nodes).select("id", "kind", "title", F.array_join("tags", ",").alias("tags"), F.col("attrs")["segment"].alias("segment"))


@query("SELECT 'Module' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'External', count(*) FROM part")
def kind_counts(spark, d):
    return graph.kind_counts(L.supply_nodes(spark, d))


@query(f"WITH {RAW} SELECT c.confidence, count(e.src) AS n FROM (VALUES ('extracted'), ('inferred'), ('ambiguous')) c(confidence) LEFT JOIN edges e ON e.confidence = c.confidence GROUP BY c.confidence")
def confidence_counts(spark, d):
    return graph.confidence_counts(merged(spark, d))


@query("SELECT 's' || l_suppkey AS id, string_agg(DISTINCT 'p' || l_partkey, ',' ORDER BY 'p' || l_partkey) AS neighbours FROM lineitem GROUP BY l_suppkey")
def adjacency(spark, d):
    return graph.adjacency(L.supply_edges(spark, d)).select("id", F.array_join("neighbours", ",").alias("neighbours"))


PLACES = """WITH m AS (SELECT 'c' || c_custkey AS id, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation
 UNION ALL SELECT 'r' || r_regionkey, r_regionkey FROM region), k AS (SELECT r, min(id) AS component, count(*) AS size FROM m GROUP BY r)"""


@query(f"{PLACES} SELECT id, component, size FROM m JOIN k USING (r)")
def components(spark, d):
    return graph.components(L.place_nodes(spark, d), L.place_edges(spark, d))


@query(f"{PLACES} SELECT component, size FROM k WHERE size > 1 AND component <> (SELECT component FROM k ORDER BY size DESC, component LIMIT 1)")
def islands(spark, d):
    return graph.islands(L.place_nodes(spark, d), L.place_edges(spark, d))


EVENTS = "e AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst)"


@query(f"""WITH RECURSIVE {EVENTS}, reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src),
both_ways AS (SELECT a.src AS id, min(a.dst) AS cycle, count(*) AS size FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT id, cycle, size FROM both_ways WHERE size > 1""")
def cycles(spark, d):
    return graph.cycles(L.event_edges(spark, d))


@query("""WITH p AS (SELECT 3 AS hops, 'c1 > o' || o_orderkey || ' > p' || a.l_partkey || ' > s1' AS path, ['c1', 'o' || o_orderkey, 'p' || a.l_partkey, 's1'] AS ids
FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_partkey = a.l_partkey WHERE o_custkey = 1 AND b.l_suppkey = 1)
SELECT CAST(hops AS BIGINT) AS hops, path FROM p ORDER BY ids LIMIT 1""")
def shortest_path(spark, d):
    return graph.shortest_path(L.trade_edges(spark, d), "c1", "s1")


CHANGES = """ch AS (SELECT -o_orderkey AS ord, CAST(o_custkey AS VARCHAR) AS author, strftime(o_orderdate, '%Y-%m-%d') AS date,
 replace(p_brand, '#', '/') AS dir, replace(p_brand, '#', '/') || '/' || l_partkey AS path, CAST(l_quantity AS BIGINT) AS ins, CAST(l_linenumber AS BIGINT) AS del, l_tax > 0.07 AS bin
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


@query(f"""WITH {CHANGES} SELECT path, count(*) AS commits, CAST(CASE WHEN bool_or(bin) THEN 0 ELSE sum(ins) END AS BIGINT) AS insertions,
 CAST(CASE WHEN bool_or(bin) THEN 0 ELSE sum(del) END AS BIGINT) AS deletions, bool_or(bin) AS "binary", arg_max(date, ord) AS first, arg_min(date, ord) AS last FROM ch GROUP BY path""")
def path_history(spark, d):
    return history.path_history(L.changes(spark, d))


@query(f"""WITH {CHANGES}, t AS (SELECT dir, ord, any_value(date) AS date, coalesce(sum(ins) FILTER (NOT bin), 0) AS i, coalesce(sum(del) FILTER (NOT bin), 0) AS x FROM ch GROUP BY dir, ord)
SELECT dir, count(*) AS commits, CAST(sum(i) AS BIGINT) AS insertions, CAST(sum(x) AS BIGINT) AS deletions, arg_max(date, ord) AS first, arg_min(date, ord) AS last FROM t GROUP BY dir""")
def dir_history(spark, d):
    return history.dir_history(L.changes(spark, d))


@query(f"""WITH {CHANGES}, n AS (SELECT dir, author, count(*) AS n FROM ch GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, author) AS k, sum(n) OVER (PARTITION BY dir) AS commits FROM n)
SELECT dir, author, n, CAST(commits AS BIGINT) AS commits, CAST(floor(n * 100 / commits + 0.5) AS BIGINT) AS share_percent FROM r WHERE k = 1""")
def top_author(spark, d):
    c = L.changes(spark, d)
    return history.top_author(c.withColumn("dir", history.directory(F.col("path"))), "dir")


PAIRS = f"""{CHANGES}, u AS (SELECT DISTINCT ord, dir FROM ch), s AS (SELECT ord FROM u GROUP BY ord HAVING count(*) <= 40),
pairs AS (SELECT a.dir AS a, b.dir AS b, count(*) AS commits FROM u a JOIN u b ON a.ord = b.ord AND a.dir < b.dir WHERE a.ord IN (SELECT ord FROM s) GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {PAIRS} SELECT a, b, commits FROM pairs")
def co_change(spark, d):
    return history.co_change(L.changes(spark, d))[0]


@query(f"""WITH {PAIRS}, f AS (SELECT least(split_part(a, '/', 2)[1:1], split_part(b, '/', 2)[1:1]) AS x, greatest(split_part(a, '/', 2)[1:1], split_part(b, '/', 2)[1:1]) AS y, commits FROM pairs),
g AS (SELECT x, y, max(commits) AS weight FROM f WHERE x <> y GROUP BY ALL) SELECT x AS src, y AS dst, 'co_changes' AS kind, weight FROM g UNION ALL SELECT y, x, 'co_changes', weight FROM g""")
def co_change_edges(spark, d):
    c = L.changes(spark, d)
    dirs = c.select(history.directory(F.col("path")).alias("dir")).distinct().withColumn("module", F.substring(F.element_at(F.split("dir", "/"), 2), 1, 1))
    return history.co_change_edges(history.co_change(c)[0], dirs)


@query("""WITH s AS (SELECT trim(text) AS t FROM conversations)
SELECT count(*) FILTER (t <> '') AS subjects, count(*) FILTER (k <> '') AS conventional, count(*) FILTER (k = 'fix') AS fix, count(*) FILTER (k = 'feat') AS feat,
 count(*) FILTER (k = 'revert' OR (k = '' AND starts_with(t, 'Revert "'))) AS revert, count(*) FILTER (regexp_matches(t, '#[0-9]')) AS issue_refs
FROM (SELECT t, lower(regexp_extract(t, '^([A-Za-z]{1,20})(\\([^)]*\\))?!?: ', 1)) AS k FROM s)""")
def conventions(spark, d):
    return history.conventions(L.table(spark, d, "conversations").select(F.col("text").alias("subject")))


@query("""SELECT p_partkey AS key, p_type AS path, max_by(t, length(t)) AS module FROM part LEFT JOIN
(SELECT DISTINCT p_type AS t FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) FROM part WHERE p_size < 25) m ON p_type = t OR starts_with(p_type, t || ' ') GROUP BY p_partkey, p_type""")
def nearest_module(spark, d):
    p = L.table(spark, d, "part")
    names = p.select(F.col("p_type").alias("module")).union(p.where("p_size < 25").select(F.split("p_type", " ")[0])).distinct()
    left = p.select(F.col("p_partkey").alias("key"), F.col("p_type").alias("path"))
    return resolve.longest_prefix(left, "path", names.withColumn("prefix", F.col("module")), "prefix", "module", ["key"], sep=" ")


@query("""WITH c AS (SELECT o_orderkey AS k, 'n' || (o_custkey % 40) AS candidate, 1 AS rank FROM orders UNION ALL SELECT o_orderkey, 'n' || (o_orderkey % 25), 2 FROM orders),
t AS (SELECT 'n' || n_nationkey AS candidate, n_name AS target FROM nation)
SELECT k.k, arg_min(target, rank) AS target FROM (SELECT DISTINCT k FROM c) k LEFT JOIN (SELECT * FROM c JOIN t USING (candidate)) j ON j.k = k.k GROUP BY k.k""")
def resolve_ranked(spark, d):
    o = L.table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("n"), (F.col("o_custkey") % 40).cast("string")).alias("candidate"), F.lit(1).alias("rank"))
    b = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("n"), (F.col("o_orderkey") % 25).cast("string")).alias("candidate"), F.lit(2).alias("rank"))
    n = L.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("candidate"), F.col("n_name").alias("target"))
    return resolve.ranked(a.union(b), ["k"], n)


@query("""SELECT c_custkey AS key, '/m/' || trim(regexp_replace('@' || lower(c_name) || '!', '[^a-z0-9]+', '-', 'g'), '-') AS id FROM customer""")
def slug_ids(spark, d):
    c = L.table(spark, d, "customer")
    w = c.select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("@"), "c_name", F.lit("!")).alias("name"), F.lit("/m/").alias("prefix"))
    return resolve.assign_ids(w).select(F.col("key").cast("long").alias("key"), "id")


@query("""SELECT p_partkey, list_reduce(list_prepend(2166136261::HUGEINT, [ascii(x)::HUGEINT for x in string_split(p_name, '')]), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT AS hash FROM part""")
def fnv_hash(spark, d):
    return L.table(spark, d, "part").select("p_partkey", resolve.fnv1a(F.col("p_name")).alias("hash"))


@query("""WITH w AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents), r AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS size, CAST(b AS BIGINT) AS before, b < 1000000 AS within FROM r""")
def byte_budget(spark, d):
    f = L.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return checks.byte_budget(f, "size", ["doc_id"], 1_000_000).select("doc_id", "size", "before", "within")


CLASSIFY = """CASE WHEN regexp_matches(f, '\\.(md|txt)$') THEN 'doc' WHEN regexp_matches(f, '\\.(yaml|yml)$') AND contains(f, '/k8s/') THEN 'infra' WHEN regexp_matches(f, '\\.proto$') THEN 'contract'
 WHEN contains(f, '/migrations/') THEN 'migration' WHEN regexp_matches(f, '\\.(go|py)$') THEN 'source' WHEN regexp_matches(f, '\\.(json|yaml)$') THEN 'data' ELSE 'other' END"""
PATHS = """f AS (SELECT p_partkey, 'src/' || CASE p_size % 4 WHEN 0 THEN 'k8s/' WHEN 1 THEN 'migrations/' WHEN 2 THEN 'vendor/' ELSE 'app/' END || p_partkey ||
 CASE p_partkey % 8 WHEN 0 THEN '_test.go' WHEN 1 THEN '.py' WHEN 2 THEN '.yaml' WHEN 3 THEN '.md' WHEN 4 THEN '.proto' WHEN 5 THEN '.sql2' WHEN 6 THEN '.json' ELSE '.bin' END AS f FROM part)"""


def _paths(spark, d):
    p = L.table(spark, d, "part")
    folder = F.element_at(F.array(*map(F.lit, ("k8s/", "migrations/", "vendor/", "app/"))), (F.col("p_size") % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("_test.go", ".py", ".yaml", ".md", ".proto", ".sql2", ".json", ".bin"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", F.concat(F.lit("src/"), folder, F.col("p_partkey").cast("string"), ext).alias("path"))


@query(f"WITH {PATHS} SELECT p_partkey, f AS path, {CLASSIFY} AS class, {CLASSIFY} = 'source' AND regexp_matches(f, '_test.go$') AS test, contains(f, '/vendor/') AS vendored FROM f")
def classify_files(spark, d):
    return classify.with_classes(_paths(spark, d)).select("p_partkey", "path", "class", F.col("is_test").alias("test"), "vendored")


@query(f"WITH {PATHS}, g AS (SELECT f FROM f UNION ALL SELECT 'odd' || p_partkey % 4 || '/Oddfile' FROM f) SELECT CASE WHEN contains(f, '/Oddfile') THEN 'Oddfile' ELSE regexp_extract(f, '\\.([^.]*)$', 1) END AS key, count(*) AS n FROM g WHERE {CLASSIFY} = 'other' GROUP BY 1")
def census(spark, d):
    p = _paths(spark, d)
    return classify.census(p.select("path").unionByName(p.select(F.concat(F.lit("odd"), (F.col("p_partkey") % 4).cast("string"), F.lit("/Oddfile")).alias("path"))))


@query("""SELECT lang, CAST(sum(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END) AS BIGINT) AS lines,
 count(*) FILTER (regexp_matches(lower(text), 'password|passwd|secret|token|apikey|api_key|credential|private_key|privatekey|access_key|accesskey|auth|cert|signing|session_key')) AS sensitive FROM documents GROUP BY lang""")
def line_and_sensitive_counts(spark, d):
    t = F.col("text")
    return L.table(spark, d, "documents").groupBy("lang").agg(F.sum(text.line_count(t)).alias("lines"), F.count_if(text.sensitive(t)).alias("sensitive"))


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id, CASE WHEN len(x) <= 6 THEN text ELSE array_to_string(list_concat(list_concat(x[1:3], ['... elided ...']), x[len(x) - 2:]), chr(10)) END AS text FROM l""")
def elide(spark, d):
    return L.table(spark, d, "documents").select("doc_id", text.elide(F.col("text"), 6).alias("text"))


SNAPS = """o AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'co_changes' ELSE 'imports' END AS kind FROM lineitem WHERE l_shipdate < DATE '1996-01-01'),
n AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'co_changes' ELSE 'imports' END AS kind FROM lineitem WHERE l_shipdate >= DATE '1995-06-01')"""


def _snapshots(spark, d):
    l = L.table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        F.when(F.col("l_returnflag") == "R", "co_changes").otherwise("imports").alias("kind"), "l_shipdate",
    )
    return l.where("l_shipdate < DATE '1996-01-01'").drop("l_shipdate"), l.where("l_shipdate >= DATE '1995-06-01'").drop("l_shipdate")


@query(f"""WITH {SNAPS}, a AS (SELECT src AS id FROM o UNION SELECT dst FROM o), b AS (SELECT src AS id FROM n UNION SELECT dst FROM n)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL""")
def graph_diff_nodes(spark, d):
    o, n = (x.select(F.explode(F.array("src", "dst")).alias("id")) for x in _snapshots(spark, d))
    return diff.diff_nodes(o, n).select("id", "change")


@query(f"""WITH {SNAPS}, a AS (SELECT * FROM o WHERE kind <> 'co_changes'), b AS (SELECT * FROM n WHERE kind <> 'co_changes')
SELECT src, dst, kind, 'lost' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT src, dst, kind, 'gained' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def graph_diff_edges(spark, d):
    return diff.diff_edges(*_snapshots(spark, d))


@query("""WITH f AS (SELECT page_id AS page, md5(html) AS text FROM pages WHERE page_id % 7 <> 0), k AS (SELECT page_id AS page, CASE WHEN length(html) % 5 = 0 THEN 'old' ELSE md5(html) END AS text, page_id % 2 = 0 AS prunable FROM pages WHERE page_id % 11 <> 0)
SELECT * FROM (SELECT coalesce(f.page, k.page) AS page, CASE WHEN k.page IS NULL THEN 'missing-page' WHEN f.page IS NULL THEN 'orphan-page' WHEN f.text <> k.text THEN 'out-of-date' END AS kind,
 CASE WHEN f.page IS NULL AND NOT prunable THEN 'warn' ELSE 'fail' END AS severity FROM f FULL JOIN k ON f.page = k.page) WHERE kind IS NOT NULL""")
def verify_pages(spark, d):
    p = L.table(spark, d, "pages")
    h = F.md5(F.col("html").cast("binary"))
    fresh = p.where("page_id % 7 <> 0").select(F.col("page_id").alias("page"), h.alias("text"))
    disk = p.where("page_id % 11 <> 0").select(F.col("page_id").alias("page"), F.when(F.length("html") % 5 == 0, "old").otherwise(h).alias("text"), (F.col("page_id") % 2 == 0).alias("prunable"))
    return checks.verify_pages(fresh, disk)


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) SELECT page_id, target FROM l WHERE target NOT IN (SELECT url FROM pages)""")
def broken_links(spark, d):
    return checks.broken_links(L.links(spark, d), L.table(spark, d, "pages").select(F.col("url").alias("page"))).select("page_id", "target")


@query("""WITH e AS (SELECT doc_id FROM labels WHERE quality = 0), g AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE contains(text, '!!')), c AS (SELECT count(*) FILTER (e.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp,
 count(*) FILTER (e.doc_id IS NULL) AS fp, count(*) FILTER (g.doc_id IS NULL) AS fn FROM e FULL JOIN g ON e.doc_id = g.doc_id)
SELECT tp, fp, fn, CAST(round(1000000 * 2 * tp / (2 * tp + fp + fn)) AS BIGINT) AS f1_millionths FROM c""")
def score_f1(spark, d):
    labels = L.table(spark, d, "labels")
    got = L.table(spark, d, "documents").where(F.contains("text", F.lit("!!"))).join(labels, "doc_id").select("doc_id")
    s = checks.score(labels.where("quality = 0"), got, ["doc_id"])
    return s.select("tp", "fp", "fn", F.round(F.col("f1") * 1000000).cast("long").alias("f1_millionths"))


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n, greatest((SELECT count(*) FROM c) - 10, 0) AS more FROM c ORDER BY n DESC, p_brand LIMIT 10""")
def topk_more(spark, d):
    return checks.top_counts(L.table(spark, d, "part"), "p_brand", 10)


@query("""WITH w AS (SELECT DISTINCT lower(n_name) AS wanted FROM nation), k AS (SELECT lower(r_name) AS name FROM region UNION SELECT lower(n_name) || 'x' FROM nation), j AS (SELECT wanted, name, levenshtein(wanted, name) AS d FROM w JOIN k ON levenshtein(wanted, name) <= 2),
g AS (SELECT wanted, d, min(name) AS name, count(*) AS n FROM j GROUP BY wanted, d), b AS (SELECT wanted, arg_min(name, d) AS name, arg_min(n, d) AS n FROM g GROUP BY wanted)
SELECT w.wanted, CASE WHEN n = 1 THEN name END AS name FROM w LEFT JOIN b USING (wanted)""")
def nearest_command(spark, d):
    n = L.table(spark, d, "nation").select(F.lower("n_name").alias("wanted"))
    names = L.table(spark, d, "region").select(F.lower("r_name").alias("name")).union(n.select(F.concat("wanted", F.lit("x")))).distinct()
    return checks.nearest_name(n, names)


@query("""WITH r AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM documents), t AS (SELECT source, doc_id, least(n, 6000) AS c FROM r WHERE k <= 8),
b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT source AS node, doc_id AS path, CAST(least(c, 24000 - before) AS BIGINT) AS chars FROM b WHERE before < 24000""")
def enrich_sources(spark, d):
    f = L.table(spark, d, "documents").select(F.col("source").alias("node"), F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return checks.enrichment_sources(f)


@query("SELECT conv_id, turn, sha256(length(role) || ':' || role || length(text) || ':' || text) AS key FROM conversations")
def cache_keys(spark, d):
    return L.table(spark, d, "conversations").select("conv_id", "turn", checks.cache_key([F.col("role"), F.col("text")]).alias("key"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM events GROUP BY ALL""")
def event_windows(spark, d):
    w = events.windowed_counts(L.table(spark, d, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total_cents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | corpora.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE | corpora.ORACLE
