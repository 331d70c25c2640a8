"""Identity and entity resolution: slugs, hashed suffixes, longest-prefix and ranked-candidate joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# FNV-1a, 32 bits.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def slug(name: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as a long."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(hexed), F.lit(1)), F.lit(2)), lambda i: i < F.length(hexed) + 1 - F.lit(1)),
        lambda i: F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("long"),
    )
    return F.aggregate(octets, F.lit(FNV_BASIS).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * FNV_PRIME, F.lit(1 << 32)))


def base36(value: Column) -> Column:
    return F.lower(F.conv(value.cast("string"), 10, 36))


def assign_ids(wanted: DataFrame, key: str = "key", name: str = "name", prefix: str = "prefix", reserved: DataFrame | None = None) -> DataFrame:
    """``wanted`` with id: prefix + slug, and a hashed suffix for any id wanted twice or reserved; x<hash> for an empty slug."""
    h = base36(fnv1a(F.concat(F.col(prefix), F.col(key))))
    s = slug(F.col(name))
    plain = F.when(s == "", F.concat(F.col(prefix), F.lit("x"), h)).otherwise(F.concat(F.col(prefix), s))
    out = wanted.withColumns({"_s": s, "_h": h, "_p": plain})
    out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_p")))
    if reserved is not None:
        out = out.join(reserved.select(F.col("id").alias("_p"), F.lit(True).alias("_r")).distinct(), "_p", "left")
    else:
        out = out.withColumn("_r", F.lit(None).cast("boolean"))
    clash = ((F.col("_n") > 1) | F.coalesce("_r", F.lit(False))) & (F.col("_s") != "")
    return out.withColumn("id", F.when(clash, F.concat("_p", F.lit("-"), "_h")).otherwise(F.col("_p"))).drop("_s", "_h", "_p", "_n", "_r")


def prefixes(path: Column, sep: str = "/") -> Column:
    """All prefixes of a path that end at a separator or the end, shortest first."""
    parts = F.split(path, F.lit("\\" + sep if sep in ".|" else sep))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def longest_prefix(left: DataFrame, path: str, targets: DataFrame, target_path: str, target_id: str, keys: list[str], sep: str = "/") -> DataFrame:
    """keys, path and the target with the longest path that is a prefix (whole segments); null where none is.

    Prefixes are joined by equality, so the work is the number of segments and not of targets."""
    e = left.select(*keys, path, F.explode(prefixes(F.col(path), sep)).alias("_p"))
    hit = e.join(targets.select(F.col(target_path).alias("_p"), F.col(target_id).alias("_t")), "_p")
    best = hit.groupBy(*keys, path).agg(F.max_by("_t", F.length("_p")).alias(target_id))
    return left.select(*keys, path).join(best, [*keys, path], "left")


def path_prefix(path: Column, of: Column) -> Column:
    """Whether ``path`` equals ``of`` or lies below it."""
    return (path == of) | path.startswith(F.concat(of, F.lit("/")))


def ranked(candidates: DataFrame, keys: list[str], targets: DataFrame, candidate: str = "candidate", rank: str = "rank", target: str = "target") -> DataFrame:
    """keys and the target of the candidate of lowest rank that exists; null where none does. targets(candidate, target)."""
    hit = candidates.join(targets.select(candidate, target), candidate)
    best = hit.groupBy(*keys).agg(F.min_by(target, F.struct(F.col(rank), F.col(target))).alias(target))
    return candidates.select(*keys).distinct().join(best, keys, "left")


def dependency_keys(name: Column) -> Column:
    """Spellings under which a dependency is imported: as is, lower, with dashes, with underscores."""
    low = F.lower(name)
    return F.array_distinct(F.array(name, low, F.translate(low, "_.", "--"), F.translate(low, "-", "_")))
