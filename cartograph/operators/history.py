"""Commit-log analytics. changes(ord, author, date, path, ins, del, binary); ord 0 is the newest commit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.operators.components import connected_components
from cartograph.session import cut

BULK_DIRS = 40
#: After every commit of a walk.
END = 1 << 62


def directory(path: Column) -> Column:
    """The path's directory, ``.`` at the root."""
    d = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)


def _dates() -> list[Column]:
    dated = F.col("date") != ""
    when = F.when(dated, F.col("date"))
    return [F.max_by(when, F.when(dated, F.col("ord"))).alias("first"), F.min_by(when, F.when(dated, F.col("ord"))).alias("last")]


def path_history(changes: DataFrame) -> DataFrame:
    """Per path: touches, lines added and removed (0 if ever binary), first and last date in walk order."""
    binary = F.max("binary")
    return changes.groupBy("path").agg(
        F.count(F.lit(1)).alias("commits"),
        F.when(binary, 0).otherwise(F.sum("ins")).cast("long").alias("insertions"),
        F.when(binary, 0).otherwise(F.sum("del")).cast("long").alias("deletions"),
        binary.alias("binary"),
        *_dates(),
    )


def dir_history(changes: DataFrame, dir_col: Column | None = None) -> DataFrame:
    """Per directory: commits that touch it (each once), lines of members that aren't binary, dates."""
    d = directory(F.col("path")) if dir_col is None else dir_col
    text = F.when(~F.col("binary"), F.col("ins")), F.when(~F.col("binary"), F.col("del"))
    by_commit = changes.withColumn("dir", d).groupBy("dir", "ord").agg(
        F.first("date").alias("date"), F.coalesce(F.sum(text[0]), F.lit(0)).alias("ins"), F.coalesce(F.sum(text[1]), F.lit(0)).alias("del")
    )
    return by_commit.groupBy("dir").agg(F.count(F.lit(1)).alias("commits"), F.sum("ins").cast("long").alias("insertions"), F.sum("del").cast("long").alias("deletions"), *_dates())


def top_author(changes: DataFrame, key: str = "path") -> DataFrame:
    """Per key: the author of most touches (ties by name) and the share, rounded half up in percent."""
    n = changes.groupBy(key, "author").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(key).agg(F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("author"), F.max("n").alias("n"), F.sum("n").alias("commits"))
    return top.select(key, "author", "n", "commits", F.floor(F.col("n") * 100 / F.col("commits") + 0.5).cast("long").alias("share_percent"))


def co_change(changes: DataFrame, dir_col: Column | None = None, bulk: int = BULK_DIRS, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of directories and the commits that touch both, at least ``least``; bulk commits left out).

    A commit of over ``bulk`` directories gives no pairs, so a commit's pairs are bounded."""
    d = directory(F.col("path")) if dir_col is None else dir_col
    touched = changes.select("ord", d.alias("dir")).distinct()
    by_commit = touched.groupBy("ord").agg(F.count(F.lit(1)).alias("dirs"), F.array_sort(F.collect_list("dir")).alias("list"))
    small = by_commit.where(F.col("dirs") <= bulk)
    pairs = small.select(F.explode(F.flatten(F.transform("list", lambda x, i: F.transform(F.slice("list", i + 2, F.lit(bulk)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    n = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("commits")).where(F.col("commits") >= least)
    return n, by_commit.where(F.col("dirs") > bulk).select("ord", "dirs")


def co_change_edges(pairs: DataFrame, module_of: DataFrame) -> DataFrame:
    """Directory pairs folded onto modules (dir, module): the largest count, in both directions."""
    a = module_of.select(F.col("dir").alias("a"), F.col("module").alias("ma"))
    b = module_of.select(F.col("dir").alias("b"), F.col("module").alias("mb"))
    m = pairs.join(a, "a").join(b, "b").where("ma <> mb")
    m = m.groupBy(F.least("ma", "mb").alias("x"), F.greatest("ma", "mb").alias("y")).agg(F.max("commits").alias("weight"))
    both = F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst"))))
    return m.select(both.alias("e"), "weight").select("e.src", "e.dst", F.lit("co_changes").alias("kind"), "weight")


NAMES = "name string, since_ord long, since_pos int, until_ord long, until_pos int, newest string"


def newest_names(renames: DataFrame) -> DataFrame:
    """NAMES rows of renames(ord, pos, old, new), ord 0 the newest: from (since) to (until, included) in walk order a name means ``newest``.

    The walk goes from new to old. A rename gives its old name the meaning its new name has at that place; a name used again
    takes the meaning of the later-met rename. Only names joined by renames touch each other, so each such group is walked
    for itself; a step costs the names whose meaning changes."""
    own = renames.where("old <> new AND old <> ''").select(F.col("ord").cast("long").alias("ord"), F.col("pos").cast("int").alias("pos"), "old", "new")
    groups = connected_components(own, "old", "new")
    grouped = own.join(groups.select(F.col("id").alias("old"), "component"), "old")

    def walk(batch):
        rows = batch.sort_values(["ord", "pos", "old", "new"], kind="stable")
        to: dict[str, str] = {}
        back: dict[str, set[str]] = {}
        means: dict[str, tuple[str, int, int]] = {}
        out = []

        def end(name: str) -> str:
            while name in to:
                name = to[name]
            return name

        for o, p, old, new in zip(rows["ord"], rows["pos"], rows["old"], rows["new"], strict=True):
            target = end(new)
            if target == old:
                continue
            if old in to:
                back[to[old]].discard(old)
            to[old] = target
            back.setdefault(target, set()).add(old)
            last, todo = end(target), [old]
            while todo:
                name = todo.pop()
                todo += back.get(name, ())
                if name in means:
                    was, so, sp = means[name]
                    out.append((name, so, sp, int(o), int(p), was))
                means[name] = (last, int(o), int(p))
        out += [(name, so, sp, END, 0, last) for name, (last, so, sp) in means.items()]
        return pd.DataFrame(out, columns=["name", "since_ord", "since_pos", "until_ord", "until_pos", "newest"])

    return grouped.groupBy("component").applyInPandas(walk, NAMES)


def fold_renames(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """``changes`` under their newest names. renames(ord, pos, old, new); a rename holds for what is older.

    Only the rename table is walked; the changes meet its intervals in one join, keep their rows (equal ones too), and those of
    a much-changed path can be split. Without a column pos the changes of a commit stand before its renames."""
    pos = F.col("pos") if "pos" in changes.columns else F.lit(-1)
    at = F.struct(F.col("ord").cast("long"), pos.cast("int"))
    hit = (F.col("path") == F.col("name")) & (at > F.struct("since_ord", "since_pos")) & (at <= F.struct("until_ord", "until_pos"))
    return changes.join(cut(newest_names(renames)), hit, "left").select(*[F.coalesce("newest", "path").alias("path") if c == "path" else F.col(c) for c in changes.columns])


# The subject of a conventional commit, and an issue reference.
CONVENTIONAL = r"^([A-Za-z]{1,20})(\([^)]*\))?!?: "
ISSUE = "#[0-9]"


def conventional_type(subject: Column) -> Column:
    """The lower-cased type of a conventional subject, '' otherwise."""
    return F.lower(F.regexp_extract(subject, CONVENTIONAL, 1))


def conventions(commits: DataFrame) -> DataFrame:
    """One row: subjects (not blank), conventional, fix, feat, revert, issue_refs."""
    s = F.trim(F.coalesce(F.col("subject"), F.lit("")))
    t = conventional_type(s)

    def n(c: Column, name: str) -> Column:
        return F.count_if(c).alias(name)

    return commits.agg(
        n(s != "", "subjects"),
        n(t != "", "conventional"),
        n(t == "fix", "fix"),
        n(t == "feat", "feat"),
        n((t == "revert") | ((t == "") & s.startswith('Revert "')), "revert"),
        n(s.rlike(ISSUE), "issue_refs"),
    )


def commits_since(commits: DataFrame, tagged: str) -> DataFrame:
    """One row: commits (ord, hash) newer than the tagged one; null where that isn't among them."""
    at = commits.where(F.col("hash") == tagged).agg(F.min("ord").alias("_at"))
    n = commits.join(F.broadcast(at), F.lit(True)).agg(F.count_if(F.col("ord") < F.col("_at")).alias("n"), F.max("_at").alias("_at"))
    return n.select(F.when(F.col("_at").isNotNull(), F.col("n")).alias("commits_since"))
