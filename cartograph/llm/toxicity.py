"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - cut_k), cuts
increasing. Features are words and the first ``PREFIX_BYTES`` bytes of longer words (ASCII
punctuation stripped, A-Z lowered), so that inflected forms share a weight, hashed to buckets and
counted over the whole text with log(1 + count). Weights are kept at zero or above and fitted
with an L1 proximal step: words that say nothing have weight zero, so long clean texts stay
clean, and no amount of other text hides the words that do.

Where labels only say toxic or not, ``graded`` derives grades from them: words that occur in
toxic texts and almost never in others are counted, and toxic texts are cut into mild, strong
and severe at ``GRADE_CUTS`` such words.

A label column that holds grades of its own (values over 1) is taken as it is.

The fit uses a bounded sample of labelled rows (``max_rows`` ids, by hash of the id, one label each (the highest), the
classes evened out, whatever their texts' length); workers send back features and no texts. Scoring reads every whole text.

Defined results: null and empty texts have severity 0 and grade 0. With no label or one grade
only, every text has that grade (0 where there is none). Repeated rows are scored each; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm import textvec

BUCKET_BITS = 20
PREFIX_BYTES = 6
GRADE_CUTS = (3, 6)


@dataclass
class GradeModel:
    weights: np.ndarray  # by bucket
    cuts: np.ndarray


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, log(1 + count)) of a slice's words, ordered by row."""
    words = textvec.split_words(data, bounds, textvec.SPACES_PUNCT)
    long = np.flatnonzero(words.end - words.start > PREFIX_BYTES)
    stems = textvec.word_hashes(words.data, words.start[long], words.start[long] + PREFIX_BYTES)
    hashes = np.concatenate([words.hashes(), textvec.mix(stems + np.uint64(1))])
    row = np.concatenate([words.row, words.row[long]]).astype(np.int64)
    key, n = np.unique((row << BUCKET_BITS) | (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), np.log1p(n)


def text_features(chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all features of ``chosen`` (text, y), worked out by the workers, and y by row; rows in a fixed order."""

    def run(batches):
        for b in batches:
            for i, j, data, bounds in textvec.slices(b, "text"):
                rows, buckets, values = features(data, bounds)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=j - i))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (buckets.astype(np.int32), values.astype(np.float32))]
                key = np.array([hash_of(buckets[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(1).slice(i, j - i), *lists], ["k", "y", "b", "v"])

    got = chosen.mapInArrow(run, "k bigint, y int, b array<int>, v array<float>").toArrow().sort_by([("k", "ascending"), ("y", "ascending")]).combine_chunks()
    y = got["y"].to_numpy().astype(int)
    if not got.num_rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), y
    lists = got["b"].combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(y)), n), lists.flatten().to_numpy().astype(np.int64), got["v"].combine_chunks().flatten().to_numpy().astype(float), y


def hash_of(x: np.ndarray) -> int:
    """A number for a list of buckets, the same on every run."""
    return int(textvec.mix(np.array([np.bitwise_xor.reduce(textvec.mix(x.astype(np.uint64) + np.uint64(1)), initial=np.uint64(len(x)))], np.uint64)).view(np.int64)[0])


def graded(rows: np.ndarray, buckets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0..3 of labelled texts from a yes-or-no label (see above)."""
    size = 1 << BUCKET_BITS
    yes = toxic.astype(bool)
    bad = np.bincount(buckets[yes[rows]], minlength=size)
    fine = np.bincount(buckets[~yes[rows]], minlength=size)
    flagged = (bad >= max(3, 0.02 * yes.sum())) & (fine * max(1, yes.sum()) < 0.05 * bad * max(1, (~yes).sum()))
    hits = np.bincount(rows[flagged[buckets]], minlength=len(toxic))
    return np.where(yes, 1 + sum((hits >= c).astype(int) for c in GRADE_CUTS), 0)


def fit(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, grade: np.ndarray, rounds: int = 200, l1: float = 6e-3) -> GradeModel:
    """Proximal gradient with momentum on the mean ordinal loss, grades weighted evenly at the first cut."""
    k = int(grade.max(initial=0))
    if not k:
        return GradeModel(np.zeros(1 << BUCKET_BITS, np.float32), np.zeros(0))
    used, local = np.unique(buckets, return_inverse=True)
    df = np.bincount(local, minlength=len(used))
    keep = (df >= max(3, 0.002 * len(grade)))[local]
    rows, local, values = rows[keep], local[keep], values[keep]
    order = np.argsort(local, kind="stable")
    n = len(grade)
    over = (grade[:, None] > np.arange(k)).astype(float)
    # Words of middling frequency get comparable steps whatever their document counts.
    step = 1.0 / np.sqrt(np.maximum(df, 1) / n + 1e-3)
    w, mom = np.zeros(len(used)), np.zeros(len(used))
    cuts = np.linspace(1.0, 1.0 + k - 1, k)
    weight = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))
    for _ in range(rounds):
        s = np.bincount(rows, w[local] * values, n)
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
        g = (p - over) * weight[:, None]
        grad = np.bincount(local[order], (g.sum(1)[rows] * values)[order], len(used))
        mom = 0.9 * mom - 0.5 * step * grad
        new = w + mom
        w = np.maximum(new - 0.5 * step * l1, 0)
        mom[w == 0] = 0
        cuts = np.maximum.accumulate(cuts + 1.0 * g.sum(0) + 1e-9 * np.arange(k))
    table = np.zeros(1 << BUCKET_BITS, np.float32)
    table[used] = w
    return GradeModel(table, cuts)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 6000) -> GradeModel:
    """Fit on a bounded sample of ``labels`` (key, 0/1 label or grades), about half of it positive if there are enough.

    The sampled labels (about ``max_rows`` rows by construction) are broadcast to find their texts."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy((F.col("_y") > 0).cast("int")).count().collect()}
    share = F.xxhash64(F.lit("toxicity"), F.col(key)).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    most = F.when(F.col("_y") > 0, max_rows / 2 / max(1, counts.get(1, 0))).otherwise(max_rows / 2 / max(1, counts.get(0, 0)))
    chosen = known.where(share < most)
    own = docs.select(key, F.col(text).alias("text")).where(F.col("text").isNotNull())
    # An id counts once, however many rows repeat it (the least text).
    once = own.join(F.broadcast(chosen), key).groupBy(key).agg(F.min("text").alias("text"), F.max("_y").alias("y"))
    r, b, v, y = text_features(once.select("text", "y"))
    return fit(r, b, v, y if y.max(initial=0) > 1 or not len(y) else graded(r, b, y))


def predict(docs: DataFrame, model: GradeModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, severity (expected grade), grade (most likely), p_toxic (chance of a grade over 0), toxic."""
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.cuts))

    def run(batches):
        used, own, cuts = shared.value
        table = np.zeros(1 << BUCKET_BITS, np.float32)
        table[used] = own
        for batch in batches:
            for i, j, data, bounds in textvec.slices(batch, "text"):
                rows, buckets, values = features(data, bounds)
                s = np.bincount(rows, table[buckets] * values, j - i)
                over = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
                empty = np.bincount(rows, minlength=j - i) == 0
                over[empty] = 0
                at = np.concatenate([np.ones((j - i, 1)), over, np.zeros((j - i, 1))], 1)
                grade = (at[:, :-1] - at[:, 1:]).argmax(1)
                p = over[:, 0] if len(cuts) else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(over.sum(1)), pa.array(grade, pa.int64()), pa.array(p, pa.float64()), pa.array(p >= 0.5)],
                    ["id", "severity", "grade", "p_toxic", "toxic"],
                )

    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, severity double, grade bigint, p_toxic double, toxic boolean").withColumnRenamed("id", id_col)
