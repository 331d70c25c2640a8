"""A bundle of pages kept beside a repository: front matter, managed regions around human text, index pages, a machine-readable manifest.

A page is text. ``merge`` keeps what people wrote; ``write`` renders, merges with what is on disk, writes what changed and sweeps pages
that nothing renders any more, unless people wrote in them. Columns of pages are worked out in Arrow batches; writing is the driver's,
page by page.
"""

from __future__ import annotations

import json
import posixpath
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.sinks.export import merge_page, regions

# Keys of front matter that the renderer owns; pages that aren't concepts; fields of a page's kind.
GENERATED = ("title", "type", "description", "resource", "tags", "status", "verification", "updated")
RESERVED = {"index.md": "index", "log.md": "log", "hubs.md": "hubs", "findings.md": "findings", "practices.md": "practices"}
PLAIN = re.compile(r"[A-Za-z_/][A-Za-z0-9_./ +@():-]*")
# Words that YAML would read as something else than text.
WORDS = ("true", "false", "yes", "no", "on", "off", "null", "y", "n", "~")


def yaml_scalar(v: str) -> str:
    """Plain where YAML reads it back as the same text, else quoted."""
    plain = PLAIN.fullmatch(v) and v.lower() not in WORDS and v == v.strip() and ": " not in v and not v.endswith(":")
    return v if plain else json.dumps(v, ensure_ascii=False)


def yaml_emit(values: dict) -> str:
    out = []
    for k, v in values.items():
        if isinstance(v, (list, tuple)):
            out += [f"{k}:"] + [f"  - {yaml_scalar(str(x))}" for x in v] if v else [f"{k}: []"]
        else:
            out.append(f"{k}: {yaml_scalar(str(v))}")
    return "\n".join(out) + "\n"


def front_matter(page: str) -> tuple[list[tuple[str, str]], str]:
    """((key, its lines as they stand) in order, the rest of the page)."""
    m = re.match(r"---\n(.*?)^---\n", page, re.S | re.M)
    if not m:
        return [], page
    entries: list[tuple[str, str]] = []
    for line in m[1].splitlines(keepends=True):
        k = re.match(r"([A-Za-z_][\w-]*):", line)
        if k:
            entries.append((k[1], line))
        elif entries:
            entries[-1] = (entries[-1][0], entries[-1][1] + line)
    return entries, page[m.end() :]


def field(page: str, key: str) -> str:
    """The scalar of a front-matter key, '' without."""
    raw = next((t for k, t in front_matter(page)[0] if k == key), "")
    v = raw.partition(":")[2].strip()
    return json.loads(v) if v.startswith('"') else v


def merge_front(old: str, new: str) -> str:
    """Front matter of ``new`` with the keys that people added to ``old`` after it."""
    fresh = front_matter(new)[0]
    names = {k for k, _ in fresh}
    kept = [(k, t) for k, t in front_matter(old)[0] if k not in names and k not in GENERATED]
    body = "".join(t for _, t in [*fresh, *kept])
    return f"---\n{body}---\n" if body else ""


def downgraded(old: str, new: str) -> str:
    """``new`` with the old page's human verification: kept for the same resource, stale for another."""
    mark = field(old, "verification")
    if not mark.startswith("human:"):
        return new
    fresh = [(k, t) for k, t in front_matter(new)[0] if k not in ("verification",)]
    same = field(old, "resource") == field(new, "resource")
    lines = "".join(t if k != "status" or same else "status: stale\n" for k, t in fresh)
    if not same and "status" not in {k for k, _ in fresh}:
        lines += "status: stale\n"
    return f"---\n{lines}verification: {yaml_scalar(mark)}\n---\n{front_matter(new)[1]}"


def merge(old: str | None, new: str) -> str:
    """What the page becomes: generated keys and regions are new, what people wrote stays."""
    if old is None:
        return new
    new = downgraded(old, new)
    return merge_front(old, new) + merge_page(front_matter(old)[1], front_matter(new)[1])


def human(page: str) -> bool:
    """Whether people wrote in a page: text outside regions (beyond its title) or keys of their own."""
    entries, body = front_matter(page)
    text = "".join(t for n, t in regions(body) if not n)
    return bool(re.sub(r"(?m)^# .*$", "", text).strip()) or any(k not in GENERATED for k, _ in entries) or field(page, "verification").startswith("human:")


def removed(page: str) -> str:
    """A page whose concept is gone and that people wrote in."""
    entries, body = front_matter(page)
    lines = "".join(t for k, t in entries if k != "status") + "status: concept-removed\n"
    return f"---\n{lines}---\n{body}"


def relative_link(source: str, target: str) -> str:
    """The path of page ``target`` from page ``source`` (both from the bundle's root)."""
    return posixpath.relpath("/" + target.lstrip("/"), posixpath.dirname("/" + source.lstrip("/")))


def page_name(node_id: str) -> str:
    return node_id.strip("/") + ".md"


def region(name: str, text: str) -> str:
    return f"<!-- region:{name} -->\n{text}<!-- /region:{name} -->\n"


def _list(title: str, rows: list[str]) -> str:
    return f"## {title}\n\n" + "".join(f"- {r}\n" for r in rows) + "\n" if rows else ""


def render_node(row: dict) -> str:
    """A node's page: front matter, what it is, and its edges by direction."""
    front = {"title": row["title"] or row["id"], "type": row["kind"], "description": row.get("description") or "", "resource": row.get("path") or "", "tags": row.get("tags") or []}
    me = page_name(row["id"])
    facts = [f"{k}: {v}" for k, v in sorted((row.get("attrs") or {}).items())]

    def links(edges) -> list[str]:
        said = []
        for e in sorted(edges or [], key=lambda e: (e["kind"], e["id"])):
            weight = f" ×{e['weight']}" if (e["weight"] or 0) > 1 else ""
            said.append(f"{e['kind']}{weight} [{e['title'] or e['id']}]({relative_link(me, page_name(e['id']))})" + ("" if e["confidence"] == "extracted" else f" ({e['confidence']})"))
        return said

    body = f"# {front['title']}\n\n" + region("summary", (front["description"] + "\n") if front["description"] else "")
    body += region("facts", _list("Facts", facts)) + region("files", _list("Files", [f"`{f}`" for f in row.get("files") or []])) + region("exports", _list("Exports", [f"`{x}`" for x in row.get("exports") or []]))
    body += region("edges", _list("Leads to", links(row.get("out_edges"))) + _list("Reached from", links(row.get("in_edges"))))
    return f"---\n{yaml_emit(front)}---\n{body}"


EDGE_LIST = "array<struct<kind:string,id:string,title:string,weight:bigint,confidence:string>>"


def pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """page, text of every node with its edges; one aggregation per direction, rendering in Arrow batches."""
    titles = nodes.select(F.col("id").alias("_id"), F.col("title").alias("_title"))

    def side(own: str, other: str, name: str) -> DataFrame:
        e = edges.join(titles, F.col(other) == F.col("_id"))
        item = F.struct("kind", F.col(other).alias("id"), F.col("_title").alias("title"), F.col("weight").cast("bigint").alias("weight"), "confidence")
        return e.groupBy(F.col(own).alias("id")).agg(F.collect_list(item).alias(name))

    full = nodes.join(side("src", "dst", "out_edges"), "id", "left").join(side("dst", "src", "in_edges"), "id", "left")
    cols = ["id", "kind", "title", "description", "path", "tags", "attrs", "files", "exports", "out_edges", "in_edges"]

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["attrs"] = dict(r["attrs"] or [])
            yield pa.RecordBatch.from_arrays([pa.array([page_name(r["id"]) for r in rows], pa.string()), pa.array([render_node(r) for r in rows], pa.string())], ["page", "text"])

    return full.select(*cols).mapInArrow(run, "page string, text string")


def index_page(nodes: DataFrame) -> str:
    """Pages by kind; streamed in order."""
    out, kind = ["---\ntitle: Index\ntype: index\n---\n# Index\n\n"], None
    body: list[str] = []
    for r in nodes.orderBy("kind", "id").select("kind", "id", "title", "description").toLocalIterator():
        if r.kind != kind:
            body.append(("\n" if body else "") + f"## {r.kind}\n\n")
            kind = r.kind
        body.append(f"- [{r.title or r.id}]({page_name(r.id)}){' — ' + r.description if r.description else ''}\n")
    return "".join(out) + region("index", "".join(body))


def hubs_page(hubs: DataFrame) -> str:
    rows = [f"| [{r.id}]({page_name(r.id)}) | {r.in_degree} | {r.out_degree} | {r.total} |\n" for r in hubs.collect()]  # a top-k report
    return "---\ntitle: Hubs\ntype: hubs\n---\n# Hubs\n\n" + region("hubs", "| Node | In | Out | All |\n|---|---|---|---|\n" + "".join(rows))


def findings_page(islands: DataFrame, gates: DataFrame, gaps: DataFrame, shown: int = 20) -> str:
    """Islands, gate share and the most frequent gaps with how many more there are."""
    g = gates.first()
    lines = [f"{g.gates} of {g.pipelines} pipelines guard what is merged."] if g and g.pipelines else []
    n = islands.count()
    lines += [f"Island of {r['size']} around `{r.component}`." for r in islands.orderBy(F.desc("size"), "component").limit(shown).collect()] + ([f"and {n - shown} more islands."] if n > shown else [])
    w = Window.partitionBy("what").orderBy(F.desc("n"), "name")
    for r in gaps.withColumn("_k", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("what"))).where(F.col("_k") <= shown).orderBy("what", "_k").toLocalIterator():
        lines.append(f"{r.what}: `{r.name}` ×{r.n}" + (f" (and {r._all - shown} more)" if r._k == shown and r._all > shown else ""))
    return "---\ntitle: Findings\ntype: findings\n---\n# Findings\n\n" + region("findings", "".join(f"- {x}\n" for x in lines))


def practices_page(rendered: str) -> str:
    return "---\ntitle: Practices\ntype: practices\n---\n# Practices\n\n" + region("practices", rendered) if rendered else ""


def log_page(old: str | None, entry: str) -> str:
    """The log with ``entry`` first; an entry that is there already isn't added again."""
    past = next((t for n, t in regions(old or "") if n == "log"), "")
    line = f"- {entry}\n"
    return "---\ntitle: Log\ntype: log\n---\n# Log\n\n" + region("log", past if line in past else line + past)


def manifest_json(nodes: DataFrame, edges: DataFrame, commit: str = "") -> str:
    """Counts by kind and confidence and the list of pages, keys sorted. Counts are aggregated, the list is streamed."""
    from cartograph.operators.graph import confidence_counts

    kinds = {r.kind: r.n for r in nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    edge_kinds = {r.kind: r.n for r in edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    sure = {r.confidence: r.n for r in confidence_counts(edges).collect()}
    listed = [page_name(r.id) for r in nodes.select("id").orderBy("id").toLocalIterator()]
    return json.dumps({"commit": commit, "nodes": kinds, "edges": edge_kinds, "confidence": sure, "pages": listed}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def read_pages(root: str) -> dict[str, str]:
    base = Path(root)
    return {str(p.relative_to(base)): p.read_text(encoding="utf-8") for p in sorted(base.rglob("*.md"))} if base.is_dir() else {}


def sweep(old: dict[str, str], fresh: set[str]) -> tuple[list[str], dict[str, str]]:
    """(pages to delete, pages to mark as removed) of those on disk that nothing renders."""
    gone = [p for p in old if p not in fresh]
    return [p for p in gone if not human(old[p])], {p: removed(old[p]) for p in gone if human(old[p])}


def write(root: str, rendered, extra: dict[str, str] | None = None) -> dict[str, int]:
    """Write pages (an iterable of page, text, such as ``pages(...).toLocalIterator()``) and ``extra`` pages: counts of written, unchanged, deleted, marked."""
    base = Path(root)
    done = {"written": 0, "unchanged": 0, "deleted": 0, "marked": 0}
    fresh: set[str] = set()

    def put(name: str, text: str) -> None:
        at = base / name
        old = at.read_text(encoding="utf-8") if at.is_file() else None
        new = merge(old, text) if name.endswith(".md") else text
        fresh.add(name)
        if new == old:
            done["unchanged"] += 1
            return
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(new, encoding="utf-8")
        done["written"] += 1

    for name, text in rendered:
        put(name, text)
    for name, text in (extra or {}).items():
        if text:
            put(name, text)
    delete, mark = sweep(read_pages(root), fresh)
    for name in delete:
        (base / name).unlink()
        done["deleted"] += 1
    for name, text in mark.items():
        if (base / name).read_text(encoding="utf-8") != text:
            (base / name).write_text(text, encoding="utf-8")
            done["marked"] += 1
    return done


def static_site(root: str, out: str) -> int:
    """Every page as a plain HTML file with its links turned; the number of files."""
    from html import escape

    n = 0
    for name, text in read_pages(root).items():
        body = escape(front_matter(text)[1], quote=False)
        body = re.sub(r"&lt;!-- /?region:[\w-]+ --&gt;\n?", "", body)
        body = re.sub(r"\[([^\]]*)\]\(([^)\s]+?)(\.md)?\)", lambda m: f'<a href="{m[2]}{".html" if m[3] else ""}">{m[1]}</a>', body)
        at = Path(out) / (name.removesuffix(".md") + ".html")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f'<!doctype html>\n<meta charset="utf-8">\n<title>{escape(field(text, "title"))}</title>\n<pre>{body}</pre>\n', encoding="utf-8")
        n += 1
    return n
