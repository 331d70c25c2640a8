"""Host-level quality rules, DataFrame functions only.

Per document: words, code points in words, symbols, repeated lines and words in
repeated 8-word windows. Rule failures are counted by host, each host's failure
rate is shrunk towards an empirical beta prior fitted over all hosts, and the host's
verdict is joined back: a rejected host loses all documents, a suspect host loses the
documents that fail a soft rule, and documents failing a base rule go everywhere.

Defined results: a null text counts as an empty one (0 words, base_failed). A null host
is a host of its own. Ties, repeated rows and extra columns are kept as they are; an empty
table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.session import cut

WORD_GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
#: Bits of a packed entry that hold a window's position (any place of an array); the others hold its hash.
POSITION_BITS = 31
#: Verdicts (one row per host) broadcast to the documents; more are joined by shuffle.
BROADCAST_HOSTS = 500_000


@dataclass(frozen=True)
class HostRules:
    """min_words, repeat_percent: base rules. symbol_percent, dup_line_percent: soft
    rules. reject_rate, suspect_rate: bounds on a host's shrunk failure rate."""

    min_words: int = 20
    repeat_percent: int = 30
    symbol_percent: int = 10
    dup_line_percent: int = 30
    reject_rate: float = 0.6
    suspect_rate: float = 0.3


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and give ``body(value)``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def repeat_words(words: Column) -> Column:
    """Words covered by windows found twice or more in ``words``.

    Window hashes packed with positions are sorted as plain longs; neighbours with the
    same hash are candidates, and candidates are then compared by their words, so a
    hash collision changes nothing.
    """
    low = (1 << POSITION_BITS) - 1
    n = F.size(words) - F.lit(WINDOW - 1)

    def packed(w):
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(1), F.size(w) - F.lit(WINDOW - 1)),
                lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
            )
        )

    def same(a, b):
        return F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)

    def candidates(s):
        return F.filter(
            s,
            lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)),
        )

    def spelled(w, c):
        """Candidates as (words, position), ordered."""
        return F.sort_array(
            F.transform(
                c,
                lambda x: F.struct(
                    F.array_join(F.slice(w, x.bitwiseAND(F.lit(low)).cast("int"), F.lit(WINDOW)), " ").alias("t"),
                    x.bitwiseAND(F.lit(low)).alias("p"),
                ),
            )
        )

    def repeated(s):
        return F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, k: F.coalesce(x["t"] == F.get(s, k - 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get(s, k + 1)["t"], F.lit(False)),
                ),
                lambda x: x["p"],
            )
        )

    def covered(p):
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW).cast("long"))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def exact(w):
        return _let(
            packed(w),
            lambda s: _let(
                candidates(s),
                lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(_let(spelled(w, c), lambda t: _let(repeated(t), covered))),
            ),
        )

    return F.when(n < 2, F.lit(0).cast("long")).otherwise(_let(words, exact))


def measures(text: Column, words: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_GAP))
    pair = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, WORD_GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        pair.alias("lines"),
        repeat_words(words).alias("n_repeat_words"),
    )


def host_verdicts(failures: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """One row per host of ``failures`` (host, failed): n_docs, n_failed, rate, shrunk, verdict.

    The beta prior is fitted by moments over all hosts; only per-host counts are
    shuffled (partial sums first), so a hot host costs no more than another."""
    by_host = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = by_host.agg(
        F.avg(rate).alias("m"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"),
        F.avg(rate * (1 - rate) / F.col("n_docs")).alias("noise"),
    ).select(
        F.least(F.greatest("m", F.lit(0.001)), F.lit(0.999)).alias("m"),
        F.greatest(F.col("v") - F.col("noise"), F.lit(1e-4)).alias("v"),
    )
    prior = prior.select("m", F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(2.0)), F.lit(1000.0)).alias("k"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    # One row of two numbers joins every host row.
    return by_host.join(F.broadcast(prior), F.lit(True)).select(
        "host",
        "n_docs",
        "n_failed",
        rate.alias("rate"),
        shrunk.alias("shrunk"),
        F.when(shrunk >= rules.reject_rate, "reject").when(shrunk >= rules.suspect_rate, "suspect").otherwise("accept").alias("verdict"),
    )


def _measured(docs: DataFrame, text: str, rules: HostRules) -> tuple[DataFrame, str]:
    """``docs`` with one struct column (its name is returned) of measures and failures."""
    name = "_rules"
    while name in docs.columns or f"{name}w" in docs.columns:
        name += "_"
    w, c = f"{name}w", F.col(name)
    m = docs.withColumn(w, words_of(F.col(text))).withColumn(name, measures(F.col(text), F.col(w))).drop(w)
    base = (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.repeat_percent * c["n_words"])
    soft = (100 * c["n_symbols"] > rules.symbol_percent * c["word_chars"]) | (
        100 * (c["lines"]["n"] - c["lines"]["d"]) > rules.dup_line_percent * c["lines"]["n"]
    )
    return m.withColumn(name, c.withField("base_failed", base).withField("soft_failed", soft)), name


def _judged(measured: DataFrame, name: str, host: str, rules: HostRules) -> DataFrame:
    """``measured`` (read twice, so a written table) with host_verdict and kept in the struct ``name``."""
    c, v = F.col(name), f"{name}v"
    failures = measured.select(F.col(host).alias("host"), (c["base_failed"] | c["soft_failed"]).alias("failed"))
    # A row per host: broadcast after a count, so that texts aren't shuffled; many hosts meet them in a skew-split sort-merge join.
    verdicts = cut(host_verdicts(failures, rules).select(F.col("host").alias(f"{v}h"), F.col("verdict").alias(v)))
    few = verdicts.count() <= BROADCAST_HOSTS
    m = measured.join(F.broadcast(verdicts) if few else verdicts, F.col(host).eqNullSafe(F.col(f"{v}h")), "left")
    kept = ~c["base_failed"] & (F.col(v) != "reject") & ~((F.col(v) == "suspect") & c["soft_failed"])
    return m.withColumn(name, c.withField("host_verdict", F.col(v)).withField("kept", kept)).drop(v, f"{v}h")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """One row per row of ``docs``: id, measures, base_failed, soft_failed, host_verdict, kept."""
    m, name = _measured(docs.select(id_col, *dict.fromkeys([text, host])), text, rules)
    m = _judged(cut(m.select(id_col, *[x for x in [host] if x != id_col], name)), name, host, rules)
    c = F.col(name)
    return m.select(
        id_col,
        *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols")],
        (c["lines"]["n"] - c["lines"]["d"]).alias("n_dup_lines"),
        *[c[x].alias(x) for x in ("n_repeat_words", "base_failed", "kept", "soft_failed", "host_verdict")],
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Texts are written beside their measures, so that these are worked out once; a text that fails a base rule goes anyway and isn't written."""
    m, name = _measured(docs, text, rules)
    if text != host:
        m = m.withColumn(text, F.when(~F.col(name)["base_failed"], F.col(text)))
    return _judged(cut(m), name, host, rules).where(F.col(name)["kept"]).select(*docs.columns)
