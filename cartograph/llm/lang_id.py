"""Language identification by error-correcting output codes.

Each language has a codeword; one linear classifier on byte 2- and 3-grams per bit is
fitted by logistic regression on a bounded labelled sample (``per_lang`` rows a language,
chosen by a hash of the id, whatever their length). Bits weigh by how far they beat chance on a fifth of that
sample that a first fit leaves out. A text gets the codeword of the least weighted logistic loss over all its
n-grams; a small margin to the next codeword is flagged as ambiguous. Prediction reads whole texts and nothing
but the text.

Defined results: null texts and texts without a letter are ``und`` with score 0. With one
learned language every text with a letter gets it; with none, all are ``und``. Of languages at the same loss the
first by name wins. Repeated rows are read each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm import textvec

BUCKETS = 1 << 16
UNKNOWN = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    bit_weight: np.ndarray
    weights: np.ndarray  # 2 * BUCKETS x bits
    bias: np.ndarray


def codewords(n: int, bits: int = 31) -> np.ndarray:
    """Exhaustive code up to five classes; beyond, a fixed pseudo-random code of distinct columns."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cols = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T
    rng = np.random.default_rng(7)
    best = max((rng.choice([-1, 1], (n, max(bits, 4 * n))) for _ in range(50)), key=lambda m: min((m[i] != m[j]).sum() for i in range(n) for j in range(i)))
    return best.astype(np.int8)


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature index per gram, and the gram bounds of rows. Digits and ASCII signs count as blanks.

    Each row gives its 2-grams and 3-grams; a blank stands before and after a row."""
    clean = textvec._LOWER[data].copy()
    clean[(clean < 97) | ((clean > 122) & (clean < 128))] = 32
    n = len(bounds) - 1
    padded = np.full(len(clean) + 3 * n, 32, np.uint32)
    place = np.arange(len(clean)) + np.repeat(np.arange(n) * 3 + 1, np.diff(bounds))
    padded[place] = clean
    own = bounds + 3 * np.arange(n + 1)
    a, b = padded[:-1], padded[1:]
    two = np.full(len(padded), 32 * 257, np.int64)
    two[:-1] = a * np.uint32(256) + b
    three = np.zeros(len(padded), np.int64)
    three[:-2] = ((two[:-2] * 256 + padded[2:]) * 2654435761 >> 16) & (BUCKETS - 1)
    three += BUCKETS
    blank = (padded == 32) & (np.append(padded[1:], 32) == 32)
    two[blank], three[blank] = 2 * BUCKETS, 2 * BUCKETS
    return np.stack([two, three], 1), own


def _row_means(table: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean weights of each row's grams, rows x bits, in pieces of bounded size."""
    idx, own = grams(data, bounds)
    total = np.zeros((len(own) - 1, table.shape[1]))
    seen = np.zeros(len(own) - 1)
    step = 400_000
    rows = np.repeat(np.arange(len(own) - 1), np.diff(own))
    for i in range(0, len(idx), step):
        part, r = idx[i : i + step], rows[i : i + step]
        vals = table[part[:, 0]] + table[part[:, 1]]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        total[r[first]] += np.add.reduceat(vals, first, axis=0)
        seen[r[first]] += np.add.reduceat((part[:, 0] < 2 * BUCKETS).astype(np.float64), first)
    return total / np.maximum(seen, 1)[:, None]


def _has_letter(data: np.ndarray, bounds: np.ndarray, text) -> np.ndarray:
    low = textvec._LOWER[data]
    ascii_letter = np.zeros(len(low) + 1, np.int64)
    np.cumsum((low >= 97) & (low <= 122), out=ascii_letter[1:])
    found = ascii_letter[bounds[1:]] > ascii_letter[bounds[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in text(i))
    return found


Grams = list[tuple[np.ndarray, np.ndarray]]  # of a text: features and their mean counts


def gram_means(text: bytes, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts over half of all grams) of a whole text, read in overlapping pieces."""
    total = np.zeros(2 * BUCKETS, np.int64)
    for at in range(0, max(1, len(text)), step):
        data = np.frombuffer(text[at : at + step], np.uint8)
        idx, _ = grams(data, np.array([0, len(data)]))
        total += np.bincount(idx[idx < 2 * BUCKETS], minlength=2 * BUCKETS)
    f = np.flatnonzero(total)
    return f, total[f] / max(1, total[f].sum() / 2)


def fit(texts: Grams, labels: list[str], rounds: int = 60) -> LanguageModel:
    """A model of all texts, its bits weighed by a first model that leaves every fifth text out."""
    langs = sorted(set(labels))
    code = codewords(len(langs))
    if len(langs) < 2:
        return LanguageModel(langs, code, np.ones(1), np.zeros((2 * BUCKETS + 1, 1), np.float32), np.ones(1))
    out = np.arange(len(texts)) % 5 == 4
    kept = [i for i in range(len(texts)) if not out[i]]
    y = code[[langs.index(x) for x in labels]].astype(np.float64)
    weight = np.ones(code.shape[1])
    if out.any() and {labels[i] for i in kept} == set(langs):
        first = _fit([texts[i] for i in kept], y[kept], langs, code, rounds)
        f = np.stack([(first.weights[texts[i][0]] * texts[i][1][:, None]).sum(0) + first.bias for i in np.flatnonzero(out)])
        weight = np.maximum(((f * y[out]) > 0).mean(0) - 0.5, 0.01)
    model = _fit(texts, y, langs, code, rounds)
    model.bit_weight = weight
    return model


def _fit(texts: Grams, y: np.ndarray, langs: list[str], code: np.ndarray, rounds: int) -> LanguageModel:
    """Fit all bits at once by gradient steps with momentum on mean n-gram features."""
    bits = code.shape[1]
    rows = [np.full(len(f), i) for i, (f, _) in enumerate(texts)]
    row, col, val = np.concatenate(rows), np.concatenate([f for f, _ in texts]), np.concatenate([c for _, c in texts])
    if not len(row):
        return LanguageModel(langs, code, np.ones(bits), np.zeros((2 * BUCKETS + 1, bits), np.float32), np.zeros(bits))
    order = np.argsort(col, kind="stable")
    row_of, val_of = row[order], val[order]
    used, first_col = np.unique(col[order], return_index=True)
    local = np.searchsorted(used, col)
    rare = np.sqrt(np.bincount(local, val, len(used)) / len(texts) + 1e-5)  # evens out the scales of common and rare grams
    val, val_of = val / rare[local], val_of / rare[np.searchsorted(used, col[order])]
    first_row = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    have = row[first_row]
    w, b = np.zeros((len(used), bits)), np.zeros(bits)
    v, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        f = np.tile(b, (len(texts), 1))
        f[have] += np.add.reduceat(w[local] * val[:, None], first_row, axis=0)
        g = -y / (1 + np.exp(np.clip(y * f, -30, 30))) / len(texts)
        gw = np.add.reduceat(g[row_of] * val_of[:, None], first_col, axis=0) + 1e-5 * w
        v, vb = 0.9 * v - 2.0 * gw, 0.9 * vb - 2.0 * g.sum(0)
        w, b = w + v, b + vb
    table = np.zeros((2 * BUCKETS + 1, bits), np.float32)
    table[used] = w / rare[:, None]
    return LanguageModel(langs, code, np.ones(bits), table, b)


def decode(m: LanguageModel, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its share 0..1, margin to the next) of rows of bit scores."""
    loss = np.stack([(np.log1p(np.exp(np.clip(-m.code[c] * f, -30, 30))) * m.bit_weight).sum(1) for c in range(len(m.langs))], 1) / m.bit_weight.sum()
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    rest = np.sort(loss, 1)
    margin = rest[:, 1] - rest[:, 0] if rest.shape[1] > 1 else np.full(len(rest), np.inf)
    return best, p[np.arange(len(p)), best], margin


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 500) -> LanguageModel:
    """Fit on a bounded sample of ``labelled``: about ``per_lang`` rows a language by hash of key and text, equal rows once.

    Workers count the n-grams of whole texts; texts don't leave them."""
    ok = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in ok.groupBy(lang).count().collect()}
    if not counts:
        return fit([], [])
    share = F.xxhash64(F.lit("language"), F.col(key), F.col(text)).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    most = F.coalesce(*[F.when(F.col(lang) == k, F.lit(per_lang / n)) for k, n in sorted(counts.items())])
    chosen = ok.where(share < most).groupBy(F.xxhash64(key, text).alias("k"), F.col(lang).alias("lang")).agg(F.min(text).alias("text")).select("text", "lang", "k")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                got = [gram_means(t.encode()) for t in part.column(0).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(f) for f, _ in got])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in ([f.astype(np.int32) for f, _ in got], [c.astype(np.float32) for _, c in got])]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), *lists], ["k", "lang", "f", "c"])

    rows = chosen.mapInArrow(run, "k bigint, lang string, f array<int>, c array<float>").toArrow().sort_by([("k", "ascending"), ("lang", "ascending")])
    pairs = [(f.values.to_numpy().astype(np.int64), c.values.to_numpy().astype(float)) for f, c in zip(rows["f"], rows["c"], strict=True)]
    return fit(pairs, rows["lang"].to_pylist())


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text", ambiguous_margin: float = 0.1) -> DataFrame:
    """id, lang_pred, score, ambiguous per row. The model (a few MB, fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            col = batch.column(1)
            for i, j, data, bounds in textvec.slices(batch, "text"):
                valid = np.array(col.slice(i, j - i).is_valid())
                letters = _has_letter(data, bounds, lambda k, i=i: col[i + int(k)].as_py() or "") & valid & bool(m.langs)
                if m.langs:
                    best, score, margin = decode(m, _row_means(m.weights, data, bounds) + m.bias)
                else:
                    best, score, margin = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i)
                best = np.where(letters, best, len(m.langs))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(names[best], pa.string()),
                        pa.array(np.where(letters, score, 0.0), pa.float64()),
                        pa.array(letters & (margin < ambiguous_margin), pa.bool_()),
                    ],
                    ["id", "lang_pred", "score", "ambiguous"],
                )

    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)
