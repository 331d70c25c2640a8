"""File corpora: a tree's listing, ignore rules as regular expressions, contents read by the workers, caps and line facts."""

from __future__ import annotations

import os
import re

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.functions import classify, text
from cartograph.operators.checks import byte_budget
from cartograph.session import cut

FULL_BYTES, FULL_LINES, PART_BYTES, SNIFF = 2 << 20, 50_000, 32 << 10, 8000
MARKER = "\n... elided ...\n"


def segment_regex(segment: str) -> str:
    """A regular expression of one path segment with * ? and classes."""
    out, i = "", 0
    while i < len(segment):
        c = segment[i]
        if c == "\\" and i + 1 < len(segment):
            out, i = out + re.escape(segment[i + 1]), i + 2
            continue
        end = segment.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = segment[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("[", r"\[") + "]"
            i = end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return out


def ignore_rule(line: str, base: str = "") -> tuple[bool, str] | None:
    """(negated, regular expression over paths) of an ignore line in directory ``base``; None for a comment or blank.

    A directory rule also covers what lies below it, as do all rules for a matched directory."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line)
    if not line or line.startswith("#"):
        return None
    negate = line.startswith("!")
    line = line[1:] if negate or line.startswith(("\\#", "\\!")) else line
    only_dir = line.endswith("/")
    line = line[:-1] if only_dir else line
    anchored, line = "/" in line, line.removeprefix("/")
    if not line:
        return None
    segments = ([] if anchored else ["**"]) + line.split("/")
    body = ""
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        body += (".*" if last else "(?:[^/]+/)*") if s == "**" else segment_regex(s) + ("" if last else "/")
    prefix = re.escape(base.strip("/") + "/") if base.strip("/") else ""
    return negate, f"^{prefix}{body}" + ("/.+$" if only_dir else "(?:/.+)?$")


def ignored(path: Column, lines: list[str], base: str = "") -> Column:
    """Whether the last rule that matches says so. Rules are a closed list in the plan."""
    out = F.lit(False)
    for line in lines:
        rule = ignore_rule(line, base)
        if rule:
            out = F.when(path.rlike(rule[1]), F.lit(not rule[0])).otherwise(out)
    return out


def rules_of(ignore_files: DataFrame) -> DataFrame:
    """base, ord, negate, pattern of ignore files (path, content): a row per rule, in the order of its file."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                base = path.rpartition("/")[0]
                rules = (ignore_rule(line, base) for line in (content or "").replace("\r\n", "\n").split("\n"))
                rows += [(base, k, *r) for k, r in enumerate(rules) if r]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.bool_(), pa.string()), strict=True)], ["base", "ord", "negate", "pattern"])

    return ignore_files.select("path", "content").mapInArrow(run, "base string, ord int, negate boolean, pattern string")


def nested_ignored(paths: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """path of ``paths`` that the ignore files of their own and upper directories leave out: the deepest file's last matching rule decides.

    A path meets the rules of its directories by equality, so only those are matched."""
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    met = paths.select("path", F.explode(above).alias("base")).join(rules_of(ignore_files), "base").where(F.regexp("path", F.col("pattern")))
    return met.groupBy("path").agg(F.max_by("negate", F.struct(F.length("base"), "ord")).alias("negate")).where("NOT negate").select("path")


def tail_bytes(content: Column, n: int) -> Column:
    """The last ``n`` bytes as text, cut to the start of a code point."""
    last = F.substring(content, -n, n)
    # Continuation bytes at the front (three at most) belong to a code point that was cut.
    for _ in range(3):
        last = F.when(F.hex(F.substring(last, 1, 1)).rlike("^[89AB]"), F.substring(last, F.lit(2), F.octet_length(last))).otherwise(last)
    return F.make_valid_utf8(last.cast("string"))


def head_bytes(content: Column, n: int) -> Column:
    """The first ``n`` bytes as text, without a code point that was cut."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, n).cast("string")), "\ufffd+$", "")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size of all files of a tree, hidden and empty ones too; links aren't followed. Metadata only, listed on the driver.

    ``root`` is a local folder or any address that pyarrow's file systems take."""
    if "://" not in root:
        base = os.path.abspath(root)
        rows = []
        for at, _, names in os.walk(base, followlinks=False):
            for name in names:
                full = os.path.join(at, name)
                if not os.path.islink(full):
                    rows.append((os.path.relpath(full, base).replace(os.sep, "/"), os.path.getsize(full)))
    else:
        store, base = fs.FileSystem.from_uri(root)
        rows = [(i.path[len(base) :].lstrip("/"), i.size) for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File]
    return spark.createDataFrame(rows, "path string, size long")


def contents(paths: DataFrame, root: str) -> DataFrame:
    """path, size, head, tail (binary) of paths (path, size), read by the workers: the whole file as head up to FULL_BYTES, else its first and
    last PART_BYTES. Both are null where a file can't be read."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
        for b in batches:
            for at in range(0, b.num_rows, 64):  # a bound on what is held at once
                rows = []
                for path, size in zip(b.column(0).slice(at, 64).to_pylist(), b.column(1).slice(at, 64).to_pylist(), strict=True):
                    try:
                        with store.open_input_file(f"{base}/{path}") as f:
                            if size <= FULL_BYTES:
                                rows.append((path, size, f.read(), b""))
                            else:
                                rows.append((path, size, f.read_at(PART_BYTES, 0), f.read_at(PART_BYTES, size - PART_BYTES)))
                    except OSError:
                        rows.append((path, size, None, None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["path", "size", "head", "tail"])

    return paths.select("path", "size").mapInArrow(run, "path string, size long, head binary, tail binary")


def read_corpus(spark: SparkSession, root: str, ignore: list[str] = (), include_vendored: bool = False, budget: int = 3 << 30) -> tuple[DataFrame, DataFrame]:
    """(files, skips) of a directory tree.

    Ignore files anywhere in the tree hold for what lies below them, the caller's rules for all. Files beyond the byte budget in walk
    order are skipped (empty ones never), and files that can't be read. Over the caps, a file of too many bytes keeps its first and last
    bytes and one of too many lines its first and last lines.

    files: path, size, content, lines, truncated, binary, class, lang, is_test, vendored, fixture; skips: path, reason."""
    p = F.col("path")
    named = cut(listing(spark, root))
    rules = contents(named.where(p.rlike(r"(^|/)\.gitignore$")), root).select("path", F.make_valid_utf8(F.col("head").cast("string")).alias("content"))
    left_out = nested_ignored(named, rules).withColumn("_i", F.lit(True))
    inside_git = p.rlike(r"(^|/)\.git/")
    named = named.where(~inside_git).join(left_out, "path", "left")
    named = named.withColumn("reason", F.when(F.col("_i") | ignored(p, list(ignore)), "ignored").when(~F.lit(include_vendored) & classify.vendored(p), "vendored").when(classify.fixture(p), "fixture"))
    counted = byte_budget(named.where("reason IS NULL").select("path", "size", F.split("path", "/").alias("segments")), "size", ["segments"], budget)
    fits = F.col("within") | (F.col("size") == 0)
    # As many files to a task as make some 64 MB.
    kept = counted.where(fits).select("path", "size")
    total = kept.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    read = cut(contents(kept.repartition(max(1, min(total[1], total[0] >> 26 or 1, 100_000))), root))
    skips = named.where("reason IS NOT NULL").select("path", "reason").unionByName(counted.where(~fits).select("path", F.lit("byte budget").alias("reason"))).unionByName(read.where("head IS NULL").select("path", F.lit("unreadable").alias("reason")))
    head = F.substring("head", 1, SNIFF)
    # A rune cut at the sniffed end is tolerated: up to three bytes are left off.
    valid = F.lit(False)
    for k in range(4):
        valid = valid | F.is_valid_utf8(F.substring(head, F.lit(1), F.octet_length(head) - k).cast("string"))
    own = read.where("head IS NOT NULL").withColumn("binary", F.contains(head, F.lit(b"\x00")) | ~valid)
    large = F.col("size") > FULL_BYTES
    parts = F.concat(head_bytes(F.col("head"), PART_BYTES), F.lit(MARKER), tail_bytes(F.col("tail"), PART_BYTES))
    own = own.withColumn("_t", F.when(~F.col("binary"), text.newlines(F.when(large, parts).otherwise(F.make_valid_utf8(F.col("head").cast("string"))))))
    own = own.withColumn("_n", text.line_count(F.col("_t")))
    many = F.col("_n") > FULL_LINES
    out = own.select("path", "size", F.when(many, text.elide(F.col("_t"), FULL_LINES)).otherwise(F.col("_t")).alias("content"), F.when(~large, F.col("_n")).alias("lines"), (large | F.coalesce(many, F.lit(False))).alias("truncated"), "binary")
    return classify.with_classes(out), skips
