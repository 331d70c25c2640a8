"""Verification of a committed bundle against a fresh rendering: conformance, links, staleness, drift, orphans, page list.

fresh(page, text) and disk(page, text) are tables of pages; findings are (kind, page, detail, severity). Pages are compared by joins on
their names; links leave a page as rows and meet the pages by an anti join.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.operators.checks import as_of_commit
from cartograph.sinks import bundle
from cartograph.sinks.export import regions
from cartograph.sources.readers import yaml

MANIFEST = "manifest.json"
_FACTS = "page string, type string, resource string, human boolean, bad string, links array<struct<target:string,place:string,counted:boolean>>"
_LINK = re.compile(r"!?\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)")


def links_of(text: str, managed: bool) -> tuple[list[str], int]:
    """(targets within the bundle, links that lead elsewhere) of a page's text; fences and code spans hold none.

    Relative targets count in managed text only: in human text they may lead anywhere in the repository."""
    found, other, fence = [], 0, ""
    for line in text.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if m and (not fence or m[1].startswith(fence)):
            fence = "" if fence else m[1]
            continue
        if fence:
            continue
        for t in _LINK.findall(re.sub(r"(`+).*?\1", "", line)):
            inside = t.startswith("/") or (managed and (t.startswith(("./", "../")) or not re.match(r"[a-z][\w+.-]*:|#", t)))
            found += [t] if inside else []
            other += not inside
    return found, other


def page_facts(pages: DataFrame) -> DataFrame:
    """_FACTS of pages (page, text): what front matter says, whether people wrote there, what is wrong with its form, its links."""

    def run(batches):
        for b in batches:
            rows = []
            for page, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = (text or "").replace("\r\n", "\n")
                entries, body = bundle.front_matter(text)
                docs, whole = yaml.read("".join(t for _, t in entries))
                front = docs[0] if docs and isinstance(docs[0], dict) else {}
                bad = "front matter is missing" if not entries else "front matter can't be read" if not whole else ""
                links = []
                for e in front.get("edges") or []:
                    to = e.get("to") if isinstance(e, dict) else ""
                    bad = bad or ("" if to else "an edge has no end")
                    links += [{"target": to, "place": "edges", "counted": True}] if to else []
                for name, part in regions(body):
                    inside, other = links_of(part, bool(name))
                    links += [{"target": t, "place": name or "prose", "counted": True} for t in inside] + [{"target": None, "place": name or "prose", "counted": False}] * other
                rows.append((page, front.get("type") or "", front.get("resource") or "", bundle.human(text), bad, links))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.struct([("target", pa.string()), ("place", pa.string()), ("counted", pa.bool_())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["page", "type", "resource", "human", "bad", "links"])

    return pages.select("page", "text").mapInArrow(run, _FACTS)


def finding(df: DataFrame, kind: str, detail: Column, severity: Column | str = "fail") -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "page", detail.alias("detail"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))


def resolved(page: Column, target: Column) -> Column:
    """The page a link names, from the bundle's root; null where it leads out of it."""
    bare = F.regexp_replace(target, "#.*$", "")
    folder = F.regexp_extract(page, "^(.*)/[^/]*$", 1)
    joined = F.when(bare.startswith("/"), F.regexp_replace(bare, "^/+", "")).otherwise(F.concat(folder, F.lit("/"), bare))
    out = F.aggregate(
        F.filter(F.split(joined, "/"), lambda s: ~s.isin("", ".")), F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when((bare != "") & (F.size(out) > 0) & (out[0] != ".."), F.array_join(out, "/"))


def conformance(facts: DataFrame) -> DataFrame:
    """Front matter that can't be read, a missing type, a reserved type on another page or another type on a reserved one."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in bundle.RESERVED.items() for x in kv]), F.col("page"))
    bad = (
        F.when(F.col("bad") != "", F.col("bad")).when(F.col("type") == "", "type is missing").when(want.isNotNull() & (F.col("type") != want), F.concat(F.lit("a reserved page must be of type "), want))
        .when(want.isNull() & F.col("type").isin(*bundle.RESERVED.values()), F.concat(F.lit("reserved type "), "type"))
    )
    return finding(facts.withColumn("_b", bad).where("_b IS NOT NULL"), "conformance", F.col("_b"))


def broken_links(facts: DataFrame) -> DataFrame:
    """Links within the bundle whose page isn't there."""
    links = facts.select("page", F.explode("links").alias("l")).where("l.counted").select("page", "l.target", "l.place").withColumn("_to", resolved(F.col("page"), F.col("target")))
    # Ids may be linked without the ending of a page.
    have = facts.select(F.explode(F.array("page", F.regexp_replace("page", r"\.md$", ""))).alias("_to")).distinct()
    return finding(links.join(have, "_to", "left_anti"), "broken-link", F.concat("target", F.lit(" in "), "place"))


def skipped_links(facts: DataFrame) -> DataFrame:
    """One row: links that lead out of the bundle and aren't checked."""
    return facts.select(F.explode("links").alias("l")).agg(F.count_if(~F.col("l.counted")).alias("skipped"))


def drift(fresh: DataFrame, disk: DataFrame) -> DataFrame:
    """Pages that a rendering would change, and pages that aren't there. What people wrote is merged first."""
    j = fresh.select("page", F.col("text").alias("new")).join(disk.select("page", F.col("text").alias("old")), "page", "left")

    def run(batches):
        for b in batches:
            rows = []
            for page, new, old in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if old is None:
                    rows.append((page, "missing-page"))
                elif bundle.merge(old.replace("\r\n", "\n"), new) != old.replace("\r\n", "\n"):
                    rows.append((page, "out-of-date"))
            cols = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], ["page", "kind"])

    found = j.select("page", "new", "old").mapInArrow(run, "page string, kind string")
    return found.select("kind", "page", F.when(F.col("kind") == "missing-page", "no page for a concept").otherwise("a rendering would change it").alias("detail"), F.lit("fail").alias("severity"))


def orphans(fresh: DataFrame, facts: DataFrame) -> DataFrame:
    """Pages that nothing renders: to be deleted, or only warned of where people wrote."""
    gone = facts.join(fresh.select("page"), "page", "left_anti").where(~F.col("page").isin(*bundle.RESERVED))
    return finding(gone, "orphan-page", F.when(F.col("human"), "its concept is gone and people wrote here").otherwise("its concept is gone"), F.when(F.col("human"), "warn").otherwise("fail"))


def stale(fresh_facts: DataFrame, facts: DataFrame, recorded: str | None, wanted: str | None) -> DataFrame:
    """The bundle describes another commit (one finding), else pages of another resource. Nothing where the commit isn't known."""
    none = facts.where(F.lit(False))
    if wanted is None:
        return finding(none, "stale-resource", F.lit(""))
    one = facts.sparkSession.range(1).select(F.lit(MANIFEST).alias("page"))
    if recorded is None:
        return finding(one, "conformance", F.lit("no commit is recorded"))
    if recorded != wanted:
        return finding(one, "stale-resource", F.lit(f"describes {recorded or '(none)'}, the tree is {wanted}"))
    j = facts.select("page", F.col("resource").alias("old")).join(fresh_facts.select("page", F.col("resource").alias("new")), "page").where("old <> new")
    return finding(j, "stale-resource", F.concat(F.lit("is "), "old", F.lit(", expected "), "new"))


def page_list(fresh: DataFrame, listed: DataFrame) -> DataFrame:
    """One finding where the recorded list (page) isn't the rendered pages."""
    own = fresh.select("page").where(F.endswith("page", F.lit(".md"))).distinct()
    a = own.join(listed.select("page"), "page", "left_anti").agg(F.min("page").alias("unlisted"), F.count(F.lit(1)).alias("n"))
    b = listed.select("page").distinct().join(own, "page", "left_anti").agg(F.min("page").alias("phantom"), F.count(F.lit(1)).alias("m"))
    both = a.join(F.broadcast(b), F.lit(True)).where("n + m > 0").withColumn("page", F.lit(MANIFEST))
    return finding(both, "page-list", F.concat_ws("; ", F.concat("unlisted", F.lit(" is rendered and not listed")), F.concat("phantom", F.lit(" is listed and not rendered"))))


def verify(fresh: DataFrame, disk: DataFrame, listed: DataFrame | None = None, recorded: str | None = None, wanted: str | None = None, as_of: bool = False) -> DataFrame:
    """All findings. ``as_of`` verifies as of the recorded commit: what a rebuild would settle is only pending."""
    facts, new = page_facts(disk), page_facts(fresh)
    out = conformance(facts).unionByName(broken_links(facts)).unionByName(stale(new, facts, recorded, wanted)).unionByName(drift(fresh, disk)).unionByName(orphans(fresh, facts))
    if listed is not None:
        out = out.unionByName(page_list(fresh, listed))
    return as_of_commit(out) if as_of else out
