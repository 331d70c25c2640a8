"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document a posterior over domains. Document
rates r >= 0 minimise

    1/2 sum_k ((sum_i r_i t_i p_ik - T_k) / S)^2 + ridge/2 sum_i t_i/S (r_i - 1)^2

with t_i the document's tokens (words), p_i its posterior, S all tokens and T_k the target share of
domain k times S. The minimum has r_i = max(0, 1 - p_i . m) for K multipliers m with ridge m = errors
(the inner terms above), which projected gradient steps find, scaled by the inverse of
sum_i t_i/S p_i p_i' + ridge (a bound of the curvature, so that steps are short enough and rare domains
converge as fast as frequent ones), until the totals stand still. ``RIDGE`` is so small that totals meet
every target that can be met. A step needs the K expected domain totals of the current rates and no more:
workers keep posteriors in a table, take rates from the K multipliers, and send back K whole numbers
each. Contributions are summed as integers, so neither partitioning nor retries change the rates.

Domains of the labelled table here: ``good``, ``low`` (quality 0) and ``toxic``. Features: shares of
shouted, symbol-bearing, repeated and short words, text length and evidence words learnt from the
labels; a softmax regression on them gives posteriors. It is fitted on a bounded sample of labelled
rows (``max_rows``, by hash of the id, domains evened out and weighted back).

Copies are whole numbers: floor(rate) and one more when the id's hash is below the rest, the same on
every run. Documents with 0 copies leave the mix.

Defined results: null and empty texts have 0 tokens, keep rate 1 and one copy, and have no weight in
the fit. Without labels all posteriors are equal. Targets are scaled to sum to 1; domains
without a target get 0. Repeated rows are rated alike; texts of any length are read whole; an empty table gives an
empty result. Extra columns pass through ``mix``, but for columns named mix_rate and mix_copies, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm import textvec
from cartograph.session import cut

DOMAINS = ("good", "low", "toxic")
#: Target shares of tokens.
TARGET = {"good": 0.88, "low": 0.1, "toxic": 0.02}
#: Weight of staying at rate 1, far below the least target.
RIDGE = 1e-7
BUCKET_BITS = 18
DENSE = 8
UNIT = 1 << 20  # fractions of a token in integer sums

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class DomainModel:
    evidence: np.ndarray  # by bucket: evidence of a toxic text
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (DENSE + 1) x domains


def _count_before(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def dense_features(data: np.ndarray, bounds: np.ndarray, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, features n x DENSE) of a slice."""
    raw = textvec.split_words(data, bounds, lower=False)
    n_rows = len(bounds) - 1
    n = np.diff(raw.row_words)
    some = np.maximum(n, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(raw.row, flag, n_rows) / some

    length = raw.end - raw.start
    upper, symbol, bang = (_count_before(f[raw.data]) for f in (_UPPER, _SYMBOL, np.arange(256) == 33))
    shouted = (upper[raw.end] - upper[raw.start] > 1) | (bang[raw.end] - bang[raw.start] > 1)
    marked = symbol[raw.end] - symbol[raw.start] > 0
    plain = textvec.split_words(data, bounds, textvec.SPACES_PUNCT)
    hashes = plain.hashes()
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    hit = evidence[bucket]
    key = np.unique((plain.row.astype(np.int64) << 32) | (hashes >> np.uint64(32)).astype(np.int64))
    distinct = np.bincount(key >> 32, minlength=n_rows)
    many = np.bincount(plain.row, minlength=n_rows)
    x = np.stack(
        [
            share(shouted), share(marked), share(length <= 2), np.bincount(raw.row, np.minimum(length, 30), n_rows) / some / 10,
            np.log1p(n) / 5, distinct / np.maximum(many, 1), np.log1p(np.bincount(plain.row, hit, n_rows)), np.bincount(plain.row, hit, n_rows) / np.maximum(many, 1) * 50,
        ],
        1,
    )
    return n, x


def posteriors_of(model: DomainModel, x: np.ndarray) -> np.ndarray:
    z = np.concatenate([(x - model.mean) / model.scale, np.ones((len(x), 1))], 1) @ model.weights
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def evidence_of(docs_with: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Evidence by bucket from the numbers of documents (domains x buckets) and of all documents by domain."""
    toxic, other = docs_with[2], docs_with[0] + docs_with[1]
    odds = np.log((toxic + 0.5) / (n[2] + 1)) - np.log((other + 0.5) / (n[0] + n[1] + 1))
    return np.where((toxic >= max(3, 0.01 * n[2])) & (odds > 2), 1.0, 0.0).astype(np.float32)


def fit(evidence: np.ndarray, x: np.ndarray, domain: np.ndarray, prior: np.ndarray, rounds: int = 300) -> DomainModel:
    """Softmax regression on dense features ``x`` with classes weighted back to ``prior``."""
    k = len(DOMAINS)
    n = np.bincount(domain, minlength=k)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(DENSE), np.ones(DENSE))
    weights = np.zeros((DENSE + 1, k))
    if len(x):
        a = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
        y = np.eye(k)[domain]
        each = (prior / np.maximum(n, 1))[domain][:, None]
        v = np.zeros_like(weights)
        for _ in range(rounds):
            z = a @ weights
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            v = 0.9 * v - 0.5 * (a.T @ ((p - y) * each) + 1e-4 * weights)
            weights = weights + v
    return DomainModel(evidence, mean, scale, weights)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = 6000) -> DomainModel:
    """Fit on a bounded sample of ``labels`` (key, quality, toxic): about ``max_rows`` ids, one label each (the worst), whatever their texts' length.

    The sample's ids are broadcast to find texts; texts stay on the workers, which send back counts by word and a row of features."""
    domain = F.when(F.col("toxic") > 0, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where(F.col(key).isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull())).groupBy(key).agg(F.max(domain).alias("_d"))
    counts = {r[0]: r[1] for r in known.groupBy("_d").count().collect()}
    n = np.array([counts.get(d, 0) for d in range(len(DOMAINS))], float)
    share = F.xxhash64(F.lit("mixing"), F.col(key)).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    most = F.coalesce(*[F.when(F.col("_d") == d, F.lit(max_rows / len(DOMAINS) / max(1.0, c))) for d, c in enumerate(n)])
    own = docs.select(key, F.col(text).alias("text")).where(F.col("text").isNotNull())
    # An id counts once, however many rows repeat it (the least text).
    chosen = own.join(F.broadcast(known.where(share < most)), key).groupBy(key).agg(F.min("text").alias("text"), F.max("_d").cast("int").alias("d"))
    chosen = cut(chosen.select("text", "d"))
    size = 1 << BUCKET_BITS

    def words(batches):
        """Documents by domain and bucket, summed by task."""
        total = np.zeros((len(DOMAINS), size), np.int64)
        for b in batches:
            d = b.column(1).to_numpy()
            for i, j, data, bounds in textvec.slices(b, "text"):
                w = textvec.split_words(data, bounds, textvec.SPACES_PUNCT)
                seen = np.unique((w.row.astype(np.int64) << BUCKET_BITS) | (w.hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                np.add.at(total, (d[i:j][seen >> BUCKET_BITS], seen & (size - 1)), 1)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], ["d", "bucket", "n"])

    with_ = chosen.mapInArrow(words, "d int, bucket int, n bigint").groupBy("d", "bucket").agg(F.sum("n").alias("n")).toArrow()  # domains x buckets rows at most
    docs_with = np.zeros((len(DOMAINS), size))
    docs_with[with_["d"].to_numpy(), with_["bucket"].to_numpy()] = with_["n"].to_numpy()
    drawn = {r[0]: r[1] for r in chosen.groupBy("d").count().collect()}
    evidence = evidence_of(docs_with, np.array([drawn.get(d, 0) for d in range(len(DOMAINS))]))
    used = np.flatnonzero(evidence)

    def features(batches):
        table = np.zeros(size, np.float32)
        table[used] = 1.0
        for b in batches:
            for i, j, data, bounds in textvec.slices(b, "text"):
                x = dense_features(data, bounds, table)[1]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), *[pa.array(c) for c in x.T.copy()]], ["d", *[f"x{k}" for k in range(DENSE)]])

    # About max_rows rows; in a fixed order, so that the fit is the same on every run.
    rows = chosen.mapInArrow(features, "d int, " + ", ".join(f"x{k} double" for k in range(DENSE))).toArrow().sort_by([(f"x{k}", "ascending") for k in range(DENSE)] + [("d", "ascending")])
    x = np.stack([rows[f"x{k}"].to_numpy() for k in range(DENSE)], 1) if rows.num_rows else np.zeros((0, DENSE))
    return fit(evidence, x, rows["d"].to_numpy().astype(int), n / max(1.0, n.sum()))


def _rates(p: np.ndarray, multipliers: list[float]) -> np.ndarray:
    """Rates of documents with posteriors ``p``."""
    return np.maximum(0.0, 1 - p @ np.asarray(multipliers))


def posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens and p_<domain> (long, in 1/UNIT) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in textvec.slices(batch, "text"):
                n, x = dense_features(data, bounds, shared.value.evidence)
                p = np.rint(posteriors_of(shared.value, x) * UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *[pa.array(c) for c in p.T.copy()]], ["id", "n_tokens", *[f"p_{d}" for d in DOMAINS]])

    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens bigint, " + ", ".join(f"p_{d} bigint" for d in DOMAINS))


def _p_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(f"p_{d}")).to_numpy() for d in DOMAINS], 1) / UNIT


def fit_rates(post: DataFrame, target: dict[str, float], ridge: float = RIDGE, steps: int = 200, tolerance: float = 1e-6) -> list[float]:
    """The multipliers (K numbers) from which rates follow."""
    goal = np.array([max(0.0, target.get(d, 0.0)) for d in DOMAINS])
    goal = goal / max(goal.sum(), 1e-12)
    at = [(j, k) for j in range(len(DOMAINS)) for k in range(j + 1)]
    shares = [F.shiftright(F.col(f"p_{DOMAINS[j]}") * F.col(f"p_{DOMAINS[k]}"), UNIT.bit_length() - 1) for j, k in at]
    first = post.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), *[F.sum((F.col("n_tokens") * x).cast("decimal(38,0)")) for x in shares]).first()
    total = first[0]
    found = np.zeros(len(DOMAINS))
    if not total:
        return found.tolist()
    curve = np.zeros((len(DOMAINS), len(DOMAINS)))
    for (j, k), v in zip(at, first[1:], strict=True):
        curve[j, k] = curve[k, j] = float(v or 0) / UNIT / total
    scaled = np.linalg.inv(curve + ridge * np.eye(len(DOMAINS)))

    def sums(multipliers):
        def run(batches):
            out = np.zeros(len(DOMAINS), object)
            for b in batches:
                p, t = _p_of(b), b.column(b.schema.get_field_index("n_tokens")).to_numpy()
                part = np.rint(_rates(p, multipliers)[:, None] * t[:, None] * p * 1000).astype(np.int64)
                out = out + part.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in out], [f"s_{d}" for d in DOMAINS])

        part = post.select("n_tokens", *[f"p_{d}" for d in DOMAINS]).mapInArrow(run, ", ".join(f"s_{d} bigint" for d in DOMAINS))
        r = part.agg(*[F.sum(F.col(f"s_{d}").cast("decimal(38,0)")) for d in DOMAINS]).first()
        return np.array([float(v or 0) / 1000 for v in r])

    last = None
    for _ in range(steps):
        error = sums(found.tolist()) / total - goal
        # Still against each target, not against 1: the least one is met as closely as the others.
        if last is not None and (np.abs(error - last) < tolerance * np.maximum(goal, tolerance)).all():
            break
        found, last = found + scaled @ (error - ridge * found), error
    return found.tolist()


def reached(rates: DataFrame, target: dict[str, float] = TARGET) -> DataFrame:
    """domain, target and reached share of tokens (by rates, and by whole copies) of ``mixing_rates``' rows."""
    scale = max(sum(max(0.0, target.get(d, 0.0)) for d in DOMAINS), 1e-12)
    n = F.sum("n_tokens")
    rows = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(max(0.0, target.get(d, 0.0)) / scale).alias("target"), (F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col("rate")) / n).alias("reached"), (F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col("copies")) / n).alias("reached_copies")) for d in DOMAINS])
    return rates.agg(rows.alias("x")).select(F.inline("x"))


def copies_of(ids: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Whole copies: floor, and one more by the id's hash (64-bit ids)."""
    u = (textvec.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return (np.floor(rate) + (u < rate - np.floor(rate))).astype(np.int64)


def rated(post: DataFrame, multipliers: list[float]) -> DataFrame:
    """Posterior rows with rate and copies; ids are hashed by Spark where they are not whole numbers."""
    names = [f"p_{d}" for d in DOMAINS]

    def run(batches):
        for b in batches:
            t = b.column(2).to_numpy()
            rate = np.where(t > 0, np.round(_rates(_p_of(b), multipliers), 9), 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate), pa.array(copies_of(b.column(1).to_numpy(), rate))], [*b.schema.names, "rate", "copies"])

    src = post.select("id", F.xxhash64("id").alias("h"), "n_tokens", *names)
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, h bigint, n_tokens bigint, {', '.join(f'{n} bigint' for n in names)}, rate double, copies bigint")
    return out.select("id", "n_tokens", *[(F.col(n) / UNIT).alias(n) for n in names], "rate", "copies")


def mixing_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", target: dict[str, float] = TARGET, ridge: float = RIDGE) -> DataFrame:
    """id, n_tokens, posteriors, rate and copies per row of ``docs``."""
    post = cut(posteriors(docs, train(docs, labels, id_col, text), id_col, text))
    return rated(post, fit_rates(post, target, ridge)).withColumnRenamed("id", id_col)


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", target: dict[str, float] = TARGET, ridge: float = RIDGE) -> DataFrame:
    """Rows of ``docs`` in the mix (copies over 0), with their columns, mix_rate and mix_copies.

    Posteriors are worked out again beside the rows, which spares a shuffle of all texts."""
    model = train(docs, labels, id_col, text)
    multipliers = fit_rates(cut(posteriors(docs, model, id_col, text)), target, ridge)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(k)], ["text"])
            for i, j, data, bounds in textvec.slices(named, "text"):
                n, x = dense_features(data, bounds, shared.value.evidence)
                p = np.rint(posteriors_of(shared.value, x) * UNIT) / UNIT
                rate = np.where(n > 0, np.round(_rates(p, multipliers), 9), 1.0)
                part = batch.slice(i, j - i)
                copies = copies_of(part.column(h).to_numpy(), rate)
                out = pa.RecordBatch.from_arrays([*part.columns[:h], pa.array(rate), pa.array(copies)], [*[f.name for f in fields], "mix_rate", "mix_copies"])
                yield out.filter(pa.array(copies > 0))

    from pyspark.sql import types as T

    fields = [f for f in docs.schema.fields if f.name not in ("mix_rate", "mix_copies")]
    src = docs.select(*[f.name for f in fields], F.xxhash64(id_col))
    k, h = [f.name for f in fields].index(text), len(fields)
    schema = T.StructType([*fields, T.StructField("mix_rate", T.DoubleType()), T.StructField("mix_copies", T.LongType())])
    return src.mapInArrow(run, schema)
