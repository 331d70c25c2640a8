"""Summaries of nodes by a model: sources, prompts, budget, cache and grounding. The model is a callable of the caller's; none is built in."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartograph.functions.text import clip_lines, wrapped
from cartograph.operators.checks import cache_key

PROMPT_VERSION = "1"
MAX_CHARS = 600
#: (id, prompt) to (text, cites, tokens used).
Backend = Callable[[str, str], tuple[str, list[str], int]]


@dataclass
class Budget:
    calls: int = 400
    tokens: int = 2_000_000


@dataclass
class Result:
    summaries: list[tuple[str, str, list[str]]] = field(default_factory=list)  # id, text, cites
    cached: int = 0
    asked: int = 0
    refused: int = 0
    over_budget: int = 0
    fault: str = ""


def sources(files: DataFrame, most: int = 8, per_file: int = 6000, per_node: int = 24_000) -> DataFrame:
    """node, path, text of files (node, path, content, is_test): the ``most`` largest that aren't tests, cut at whole lines, within the node's budget in path order."""
    w = Window.partitionBy("node").orderBy(F.desc(F.length("content")), "path")
    top = files.where(~F.coalesce("is_test", F.lit(False))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    top = top.withColumn("text", clip_lines(F.col("content"), per_file))
    run = Window.partitionBy("node").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    left = per_node - F.coalesce(F.sum(F.length("text")).over(run), F.lit(0))
    return top.withColumn("_left", left).where("_left > 0").select("node", "path", F.when(F.length("text") <= F.col("_left"), F.col("text")).otherwise(F.substr("text", F.lit(1), F.col("_left").cast("int"))).alias("text"))


def prompts(sources_: DataFrame, actor: str) -> DataFrame:
    """id, prompt, key, paths: untrusted texts wrapped, and a key over all that a summary depends on."""
    item = F.struct("path", wrapped(F.col("path"), F.col("text")).alias("text"))
    g = sources_.groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["text"]), "\n\n")
    prompt = F.concat(F.lit("Say in at most two sentences what these files do. Cite their names.\n\n"), body)
    return g.select("id", prompt.alias("prompt"), cache_key([F.lit(PROMPT_VERSION), F.lit(actor), F.col("id"), body]).alias("key"), F.transform("s", lambda x: x["path"]).alias("paths"))


def grounded(text: Column, cites: Column, paths: Column, most: int = MAX_CHARS) -> Column:
    """Whether a summary holds: text that ends a sentence and isn't too long, at least one cite, and every cite among the sources."""
    t = F.trim(text)
    return (t != "") & (F.length(t) <= most) & t.rlike(r"[.!?][\"')\]]*$") & (F.size(cites) > 0) & F.forall(cites, lambda c: F.array_contains(paths, c))


def _holds(text: str, cites: list[str], paths: list[str], most: int = MAX_CHARS) -> bool:
    t = text.strip()
    return bool(t) and len(t) <= most and bool(re.search(r"[.!?][\"')\]]*$", t)) and bool(cites) and all(c in paths for c in cites)


def run(rows: Iterable, backend: Backend, cache: dict[str, tuple[str, list[str]]], budget: Budget | None = None) -> Result:
    """Ask for rows (id, prompt, key, paths) in id order: the cache first, then while the budget lasts; a fault of the backend ends the run.

    Sequential by nature (a budget is spent in order), so it takes an iterator and not a DataFrame."""
    out, left = Result(), budget or Budget()
    calls, tokens = left.calls, left.tokens
    for r in rows:
        if r["key"] in cache:
            text, cites = cache[r["key"]]
            out.cached += 1
        elif calls <= 0 or tokens <= 0:
            out.over_budget += 1
            continue
        else:
            try:
                text, cites, used = backend(r["id"], r["prompt"])
            except Exception as e:  # whatever a backend raises ends the run and is reported
                out.fault = f"{type(e).__name__}: {e}"
                break
            out.asked += 1
            calls, tokens = calls - 1, tokens - used
            if not _holds(text, cites, list(r["paths"])):
                out.refused += 1
                continue
            cache[r["key"]] = (text, cites)
        out.summaries.append((r["id"], text.strip(), list(cites)))
    return out


def chat_backend(url: str, model: str, timeout: float = 60.0, headers: dict[str, str] | None = None) -> Backend:
    """A backend that posts to a chat-completions address and expects {"text", "cites"} as the answer."""

    def ask(node_id: str, prompt: str) -> tuple[str, list[str], int]:
        shape = {"type": "object", "properties": {"text": {"type": "string"}, "cites": {"type": "array", "items": {"type": "string"}}}, "required": ["text", "cites"]}
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "response_format": {"type": "json_schema", "json_schema": {"name": "summary", "schema": shape}}}
        req = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(req, timeout=timeout) as r:
            got = json.load(r)
        said = json.loads(got["choices"][0]["message"]["content"])
        return said["text"], said["cites"], int(got.get("usage", {}).get("total_tokens", len(prompt) // 4))

    return ask
