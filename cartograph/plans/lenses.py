"""Lenses: the driver's tables in the shapes the operators take. The only place that knows the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, c: str):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """Line items as raw edges supplier -> part: kind by return flag, confidence by line, weight by quantity."""
    l = table(spark, d, "lineitem")
    return l.select(
        _id("s", "l_suppkey").alias("src"),
        _id("p", "l_partkey").alias("dst"),
        F.when(F.col("l_returnflag") == "A", "imports").when(F.col("l_returnflag") == "N", "reads").otherwise("co_changes").alias("kind"),
        F.when(F.col("l_linenumber") == 1, "extracted").when(F.col("l_linenumber") < 4, "inferred").otherwise("ambiguous").alias("confidence"),
        F.col("l_quantity").cast("long").alias("weight"),
        F.col("l_orderkey").cast("string").alias("source"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def supply_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(_id("s", "s_suppkey").alias("id"), F.lit("Module").alias("kind"))
    p = table(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.lit("External").alias("kind"))
    return s.union(p)


def place_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers to their nation, nations to their region: a component per region."""
    c = table(spark, d, "customer").select(_id("c", "c_custkey").alias("src"), _id("n", "c_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"))
    n = table(spark, d, "nation").select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst"))
    return c.union(s).union(n).withColumn("kind", F.lit("imports"))


def place_nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = [("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"), ("nation", "n", "n_nationkey"), ("region", "r", "r_regionkey")]
    out = None
    for t, letter, key in parts:
        one = table(spark, d, t).select(_id(letter, key).alias("id"), F.lit(t).alias("kind"))
        out = one if out is None else out.union(one)
    return out


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer -> order -> part -> supplier."""
    o = table(spark, d, "orders").select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst"))
    l = table(spark, d, "lineitem")
    a = l.select(_id("o", "l_orderkey").alias("src"), _id("p", "l_partkey").alias("dst"))
    b = l.select(_id("p", "l_partkey").alias("src"), _id("s", "l_suppkey").alias("dst"))
    return o.union(a).union(b)


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive event types of each user: five nodes with cycles."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return e.where("dst IS NOT NULL").withColumn("kind", F.lit("imports"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits (newest order key first), their lines' suppliers as paths below the part's brand."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace("p_brand", "#", "/").alias("brand"))
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(p, "l_partkey")
    return j.select(
        (-F.col("o_orderkey")).alias("ord"),
        F.col("o_custkey").cast("string").alias("author"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.concat("brand", F.lit("/"), F.col("l_partkey").cast("string")).alias("path"),
        F.col("l_quantity").cast("long").alias("ins"),
        F.col("l_linenumber").cast("long").alias("del"),
        (F.col("l_tax") > 0.07).alias("binary"),
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    """Pages and the targets of their links."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
