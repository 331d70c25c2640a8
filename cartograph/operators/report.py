"""What a run read and what it couldn't explain: gap counters, top counts, and counts per stage."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(gaps: DataFrame, shown: int = 10) -> DataFrame:
    """what, names, total, top (the most frequent names with their counts, ties by name), more (names beyond them) of gaps (what, name, n)."""
    w = Window.partitionBy("what").orderBy(F.desc("n"), "name")
    top = gaps.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= shown).groupBy("what").agg(F.array_sort(F.collect_list(F.struct("_k", "name", "n"))).alias("t"))
    all_ = gaps.groupBy("what").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("total"))
    return all_.join(top, "what").select("what", "names", "total", F.transform("t", lambda x: F.concat(x["name"], F.lit(" ×"), x["n"].cast("string"))).alias("top"), F.greatest(F.col("names") - shown, F.lit(0)).alias("more"))


def lines(report: DataFrame) -> list[str]:
    """One line per kind of gap; a handful of rows."""
    return [f"{r.what}: {r.total} of {r.names} names: {', '.join(r.top)}" + (f" and {r.more} more" if r.more else "") for r in report.orderBy("what").collect()]


class Spans:
    """Seconds and counts by stage; off unless asked for, and never any content."""

    def __init__(self, on: bool = False):
        self.on, self.rows = on, []

    @contextmanager
    def stage(self, name: str, **counts: int):
        began = time.monotonic()
        try:
            yield
        finally:
            if self.on:
                self.rows.append((name, round(time.monotonic() - began, 3), counts))
