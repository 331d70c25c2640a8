"""Structural diff of two snapshots with rename folding; co-change edges don't count as structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartograph.operators.history import directory


def structural(edges: DataFrame) -> DataFrame:
    return edges.where("kind <> 'co_changes'")


def dir_renames(renames: DataFrame) -> DataFrame:
    """old_dir, new_dir where all files that moved out of a directory went to one other. renames(old_path, new_path)."""
    d = renames.select(directory(F.col("old_path")).alias("old_dir"), directory(F.col("new_path")).alias("new_dir"))
    g = d.groupBy("old_dir").agg(F.min("new_dir").alias("new_dir"), F.max("new_dir").alias("_m"))
    return g.where("new_dir = _m AND old_dir <> new_dir").select("old_dir", "new_dir")


def pair_renames(old: DataFrame, new: DataFrame, moved: DataFrame) -> DataFrame:
    """old_id, new_id of nodes (id, kind, path) that moved by ``moved`` (old_path, new_path): same kind, ids
    not on both sides, a destination taken once (by the least old id)."""
    gone = old.join(new.select("id"), "id", "left_anti").select(F.col("id").alias("old_id"), "kind", F.col("path").alias("old_path"))
    came = new.join(old.select("id"), "id", "left_anti").select(F.col("id").alias("new_id"), "kind", F.col("path").alias("new_path"))
    both = gone.join(moved, "old_path").join(came, ["kind", "new_path"])
    first = both.groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    w = Window.partitionBy("new_id").orderBy("old_id")
    return first.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("old_id", "new_id")


def diff_nodes(old: DataFrame, new: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """id, change: added, removed or renamed (id is the old one, new_id the new)."""
    o, n = old.select(F.col("id").alias("o")).distinct(), new.select(F.col("id").alias("n")).distinct()
    d = o.join(n, F.col("o") == F.col("n"), "full_outer").where("o IS NULL OR n IS NULL")
    if pairs is None:
        return d.select(F.coalesce("o", "n").alias("id"), F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change"), F.lit(None).cast("string").alias("new_id"))
    d = d.join(pairs.select(F.col("old_id").alias("o"), "new_id"), "o", "left").join(pairs.select(F.col("new_id").alias("n"), F.lit(True).alias("_taken")), "n", "left").where("_taken IS NULL")
    change = F.when(F.col("o").isNull(), "added").when(F.col("new_id").isNotNull(), "renamed").otherwise("removed")
    return d.select(F.coalesce("o", "n").alias("id"), change.alias("change"), "new_id")


def diff_edges(old: DataFrame, new: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """src, dst, kind, change (gained, lost) after old ids are read under their new names."""
    o, n = structural(old).select("src", "dst", "kind").distinct(), structural(new).select("src", "dst", "kind").distinct()
    if pairs is not None:
        for c in ("src", "dst"):
            o = o.join(pairs.select(F.col("old_id").alias(c), F.col("new_id").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
        o = o.distinct()
    d = o.withColumn("_o", F.lit(1)).join(n.withColumn("_n", F.lit(1)), ["src", "dst", "kind"], "full_outer").where("_o IS NULL OR _n IS NULL")
    return d.select("src", "dst", "kind", F.when(F.col("_o").isNull(), "gained").otherwise("lost").alias("change"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and whether the snapshots are identical in structure."""

    def n(change: str) -> Column:
        return F.count_if(F.col("change") == change).alias(change)

    a, b = nodes.agg(*map(n, ("added", "removed", "renamed"))), edges.agg(*map(n, ("gained", "lost")))
    return a.join(F.broadcast(b), F.lit(True)).withColumn("identical", F.expr("added + removed + renamed + gained + lost = 0"))
