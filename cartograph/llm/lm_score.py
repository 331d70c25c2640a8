"""Language-model scores: a gated recurrent network over words, class-factored output.

Words of all training documents are counted exactly (64-bit word hashes, partial counts before the
shuffle). The ``VOCAB`` most frequent words make the network's vocabulary, dealt by rank into classes
of ``CLASS_SIZE``; class 0 holds the end sign and the unknown word. The network is a GRU; the chance
of a token is softmax over classes times softmax within its class, with biases that start at the
counted frequencies. An unknown word's share is spread over all words outside the vocabulary by their
counts, so that a text's score is a full log10 probability over words.

Training is truncated backpropagation in numpy. The training documents are dealt into shards of about
``shard_docs`` documents each by a hash of the id; every shard fits the current network on its windows
of ``WINDOW`` tokens (state carried from window to window, gradients cut there) in lanes side by side, and the
shards' networks are averaged, weighted by tokens. The training documents are dealt into ``rounds`` equal parts by a hash
of the id, and each round fits on the next part: one pass over all of them, whatever the table's size.

Scoring reads whole texts, state carried across windows to the end sign. Documents are taken in blocks
of bounded tokens, sorted by length and run in lanes; lanes share nothing.

Counts of the ``TABLE`` most frequent words at most are broadcast (a bound in rows, some 12 MB); rarer
words of each document go through a join by hash, so the corpus's vocabulary is nowhere gathered.

Defined results: null and empty texts are one end sign. With no training document the base is
log10 of (0.1 / 0.1) = 0 a token and the network is its uniform start. Repeated rows count and are
scored each; an empty table gives an empty result; texts of any length are read whole; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm import textvec
from cartograph.session import cut

HIDDEN = 16
CLASS_SIZE = 64
CLASSES = 64
VOCAB = CLASSES * CLASS_SIZE - 2
WINDOW = 24
END, UNKNOWN = 0, 1
#: The end sign's place among word hashes.
END_HASH = 1
LANES = 1024
#: Lanes of a shard's fit at most, and windows (steps of the fit) that each lane has at least.
FIT_LANES = 512
STEPS = 24
TABLE = 1_000_000
#: Tokens scored as one block, and predictions worked out at once.
BLOCK_TOKENS = 3_000_000
AT_ONCE = 32_768
#: Columns of a softmax worked out at once.
BLOCK = 1024
_PLACES = np.arange(BLOCK)
_LOG10 = float(np.log(10.0))


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted hashes of the vocabulary's words
    ids: np.ndarray  # their token ids
    counts: np.ndarray  # training counts by token id; [UNKNOWN] sums the words outside


def n_classes(vocab: Vocabulary) -> int:
    return max(1, -(-len(vocab.counts) // CLASS_SIZE))


Params = dict[str, np.ndarray]


def start(vocab: Vocabulary, seed: int = 5) -> Params:
    """The first network: small random weights, output biases at log frequencies."""
    rng = np.random.default_rng(seed)
    c, h = n_classes(vocab), HIDDEN

    def small(*shape):
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    counts = np.zeros(c * CLASS_SIZE)
    counts[: len(vocab.counts)] = vocab.counts + 0.5
    by_class = counts.reshape(c, CLASS_SIZE)
    inner = np.where(by_class > 0, np.log(np.maximum(by_class, 1e-9)), -60.0)
    return {
        "x": small(c * CLASS_SIZE, 3 * h),  # input weights by token, for the update, reset and candidate gates
        "u": small(h, 3 * h),
        "b": np.zeros(3 * h, np.float32),
        "cw": small(h, c),
        "cb": np.log(by_class.sum(1) + 1e-9).astype(np.float32),
        "ww": small(c, h, CLASS_SIZE) * 0.3,
        "wb": inner.astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60.0, out=x), out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, by the exponential (which numpy works out many at a time)."""
    x *= -2.0
    _sigmoid_of_negative(x)
    x *= 2.0
    x -= 1.0
    return x


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place."""
    np.exp(np.minimum(x, 60.0, out=x), out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


def forward(p: Params, tokens: np.ndarray, state: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States before each token's prediction (T x B x H) and the state after the last.

    ``tokens`` (T x B) are inputs; the prediction at step t sees inputs up to t."""
    h = HIDDEN
    out = np.empty((*tokens.shape, h), np.float32)
    given = p["x"][tokens] + p["b"]
    fresh = (tokens != END)[:, :, None]  # a document starts afresh
    u_gates, u_new = np.ascontiguousarray(p["u"][:, : 2 * h]), np.ascontiguousarray(p["u"][:, 2 * h :])
    for t in range(len(tokens)):
        state = state * fresh[t]
        zr = state @ u_gates
        zr += given[t, :, : 2 * h]
        _sigmoid(zr)
        z, r = zr[:, :h], zr[:, h:]
        rs = r * state
        n = rs @ u_new
        n += given[t, :, 2 * h :]
        _tanh(n)
        if keep is not None:
            keep.append((state, z, r, n, rs))
        state = state + z * (n - state)
        out[t] = state
    return out, state


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(places in the order of their classes, a class and its part of that order each)."""
    cls = (targets // CLASS_SIZE).astype(np.uint16)
    order = np.argsort(cls, kind="stable")
    ends = np.cumsum(np.bincount(cls, minlength=1))
    return order, [(c, slice(int(ends[c - 1]) if c else 0, int(ends[c]))) for c in range(len(ends)) if ends[c] > (ends[c - 1] if c else 0)]


def _softmax(x: np.ndarray) -> np.ndarray:
    """Column shares, in place (columns, so that sums run over whole rows of numbers)."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _log_shares(weights: np.ndarray, bias: np.ndarray, own: np.ndarray, y: np.ndarray, at: slice, found: np.ndarray) -> None:
    """Adds the log share of each column's ``y`` to ``found``."""
    turned, column = np.ascontiguousarray(weights.T), bias[:, None]
    for i in range(at.start, at.stop, BLOCK):
        part = slice(i, min(i + BLOCK, at.stop))
        x = turned @ own[:, part]
        x += column
        x -= x.max(0)
        found[part] += x[y[part], _PLACES[: part.stop - i]]
        found[part] -= np.log(np.exp(x, out=x).sum(0))


def log_probs(p: Params, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log chances of flat ``targets`` from flat ``states`` (N x H)."""
    order, parts = _by_class(targets)
    own, y = np.ascontiguousarray(states[order].T), targets[order]
    found = np.zeros(len(y), np.result_type(own, p["cw"]))
    _log_shares(p["cw"], p["cb"], own, y // CLASS_SIZE, slice(0, len(y)), found)
    y = y % CLASS_SIZE
    for c, at in parts:
        _log_shares(p["ww"][c], p["wb"][c], own, y, at, found)
    out = np.empty_like(found)
    out[order] = found
    return out


def _descend(weights: np.ndarray, bias: np.ndarray, own: np.ndarray, y: np.ndarray, w: np.ndarray, at: slice, dw: np.ndarray, db: np.ndarray, dh: np.ndarray, chance: np.ndarray, first: bool) -> None:
    """Gradients of one softmax over the columns ``at`` of states ``own`` (H x N), added to dw, db and dh; block by block, so that numbers stay near."""
    turned, column = np.ascontiguousarray(weights.T), bias[:, None]
    for i in range(at.start, at.stop, BLOCK):
        part = slice(i, min(i + BLOCK, at.stop))
        k = _PLACES[: part.stop - i]
        d = turned @ own[:, part]
        d += column
        _softmax(d)
        got = d[y[part], k]
        d[y[part], k] = got - 1
        d *= w[part]
        dw += own[:, part] @ d.T
        db += d.sum(1)
        if first:
            dh[:, part] = weights @ d
            chance[part] = got
        else:
            dh[:, part] += weights @ d
            chance[part] *= got


def gradients(p: Params, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray, state: np.ndarray) -> tuple[Params, np.ndarray, float]:
    """Gradients of the summed loss over a window, the state after it, and the loss."""
    h = HIDDEN
    kept: list = []
    out, last = forward(p, inputs, state, kept)
    g = {k: np.zeros_like(v) for k, v in p.items() if k in ("u", "ww", "wb")}
    order, parts = _by_class(targets.ravel())
    own, w = np.ascontiguousarray(out.reshape(-1, h)[order].T), weight.ravel().astype(np.float32)[order]
    y = targets.ravel()[order]
    cls, y = y // CLASS_SIZE, y % CLASS_SIZE
    kind = np.result_type(own, p["cw"])
    chance, dh = np.empty(len(y), kind), np.empty(own.shape, kind)
    g["cw"], g["cb"] = np.zeros_like(p["cw"]), np.zeros_like(p["cb"])
    every = slice(0, len(y))
    _descend(p["cw"], p["cb"], own, cls, w, every, g["cw"], g["cb"], dh, chance, True)
    for c, at in parts:
        _descend(p["ww"][c], p["wb"][c], own, y, w, at, g["ww"][c], g["wb"][c], dh, chance, False)
    loss = -float((np.log(chance + np.float32(1e-37)) * w).sum())
    back = np.empty((len(y), h), dh.dtype)
    back[order] = dh.T
    dh = back.reshape(out.shape)
    ds = np.zeros_like(state)
    dx = np.empty((*inputs.shape, 3 * h), np.float32)
    fresh = (inputs != END)[:, :, None]
    u_gates, u_new = np.ascontiguousarray(p["u"][:, : 2 * h].T), np.ascontiguousarray(p["u"][:, 2 * h :].T)
    for t in range(len(inputs) - 1, -1, -1):
        s, z, r, n, rs = kept[t]
        ds = ds + dh[t]
        dzs = ds * z
        gate = dx[t]
        dn = gate[:, 2 * h :]
        np.multiply(dzs, 1 - n * n, out=dn)
        np.multiply(ds * (n - s), z * (1 - z), out=gate[:, :h])
        drs = dn @ u_new
        np.multiply(drs * s, r * (1 - r), out=gate[:, h : 2 * h])
        ds = (ds - dzs + drs * r + gate[:, : 2 * h] @ u_gates) * fresh[t]
    states = np.concatenate([k[0] for k in kept])
    resets = np.concatenate([k[4] for k in kept])
    flat_x = dx.reshape(-1, 3 * h)
    g["u"][:, : 2 * h] = states.T @ flat_x[:, : 2 * h]
    g["u"][:, 2 * h :] = resets.T @ flat_x[:, 2 * h :]
    g["b"] = flat_x.sum(0)
    # Input weights of the tokens seen only, summed by token.
    order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")
    seen, first = np.unique(inputs.ravel()[order], return_index=True)
    g["x"] = np.add.reduceat(flat_x[order], first, axis=0)
    g["seen"] = seen
    return g, last, loss


def fit_shard(p: Params, streams: list[np.ndarray], rate: float = 0.6) -> tuple[Params, int, float]:
    """One pass over token streams (each document's tokens, END last) with Adagrad: (network, tokens, loss).

    The streams are laid end to end and cut into lanes of equal length: as many as leave ``STEPS`` windows each, up to ``FIT_LANES``."""
    flat = np.concatenate(streams)
    lanes = max(1, min(FIT_LANES, len(flat) // (STEPS * WINDOW)))
    longest = -(-len(flat) // lanes)
    p = {k: v.copy() for k, v in p.items()}
    speed = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    y, w = np.zeros(longest * lanes, np.int64), np.zeros(longest * lanes, np.float32)
    y[: len(flat)], w[: len(flat)] = flat, 1
    x = np.concatenate([[END], y[:-1]]).reshape(lanes, longest).T
    y, w = y.reshape(lanes, longest).T, w.reshape(lanes, longest).T
    state, total = np.zeros((lanes, HIDDEN), np.float32), 0.0
    for t in range(0, longest, WINDOW):
        part = slice(t, t + WINDOW)
        g, state, loss = gradients(p, x[part], y[part], w[part], state)
        total += loss
        n = np.float32(max(1.0, float(w[part].sum())))
        for k in p:
            rows = g["seen"] if k == "x" else slice(None)  # other tokens' input weights have no gradient
            d = np.clip(g[k] / n, -0.05, 0.05)
            now = speed[k][rows] + d * d
            speed[k][rows] = now
            p[k][rows] -= rate * d / np.sqrt(now)
    return p, int(w.sum()), total


def pack(p: Params) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def unpack(data: bytes, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size * 4
        out[k] = np.frombuffer(data[at : at + n], np.float32).reshape(like[k].shape).copy()
        at += n
    return out


class Lookup:
    """Places of 64-bit hashes in a sorted list of distinct ones: the leading bits say where to look, so that a lookup is a step or two."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(8, min(22, int(len(hashes)).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't in the list."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        part = (h >> self.shift).astype(np.int64)
        at, end = self.first[part], self.first[part + 1]
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            met = self.hashes[at] == h[open_]
            out[open_[met]] = at[met]
            at += 1
            on = ~met & (at < end)
            open_, at, end = open_[on], at[on], end[on]
        return out


def encode(vocab: Vocabulary, hashes: np.ndarray, table: Lookup | None = None) -> np.ndarray:
    """Token ids of word hashes."""
    at = (table or Lookup(vocab.hashes)).find(hashes)
    return np.where(at >= 0, vocab.ids[at] if len(vocab.ids) else UNKNOWN, UNKNOWN).astype(np.int64)


def score_documents(p: Params, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log chances of documents (END last each; flat tokens and row bounds)."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def work_out():
        if held:
            rows, states, y = (np.concatenate(x) for x in zip(*held, strict=True))
            out[:] += np.bincount(rows, log_probs(p, states, y), len(sizes))
            held.clear()

    n_held = 0
    for at in range(0, len(order), LANES):
        own = order[at : at + LANES]
        size, first = sizes[own], bounds[own]
        state = np.zeros((len(own), HIDDEN), np.float32)
        last = np.full(len(own), END, np.int64)
        for t in range(0, int(size[0]), WINDOW):
            live = int(np.searchsorted(-size, -t, "left"))  # sizes fall: lanes with more than t tokens
            steps = np.arange(t, min(t + WINDOW, int(size[0])))[:, None]
            has = steps < size[None, :live]
            y = tokens[np.minimum(first[None, :live] + steps, len(tokens) - 1)].astype(np.int64)
            x = np.concatenate([last[None, :live], y[:-1]])
            states, state[:live] = forward(p, x, state[:live])
            last[:live] = y[-1]
            flat = np.flatnonzero(has.ravel())
            held.append((np.broadcast_to(own[:live], has.shape).ravel()[flat], states.reshape(-1, HIDDEN)[flat], y.ravel()[flat]))
            n_held += len(flat)
            if n_held >= AT_ONCE:
                work_out()
                n_held = 0
    work_out()
    return out


def fold(id_col: str, n: int = 10):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def _hash_rows(batch: pa.RecordBatch, text: str):
    """(first row, next row, words, hashes as signed longs) of slices."""
    for i, j, data, bounds in textvec.slices(batch, text):
        w = textvec.split_words(data, bounds)
        yield i, j, w, w.hashes()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """h, c: exact counts of word hashes (END_HASH is the end sign) over ``docs``; summed by task first."""

    def run(batches):
        def flush(parts):
            h, n = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            u, inv = np.unique(h, return_inverse=True)
            return u, np.bincount(inv, n).astype(np.int64)

        parts, held = [], 0
        for batch in batches:
            parts.append((np.array([END_HASH], np.uint64), np.array([batch.num_rows])))
            for _, _, _, h in _hash_rows(batch, "text"):
                parts.append(np.unique(h, return_counts=True))
                held += len(parts[-1][0])
                if held > 2_000_000:
                    parts = [flush(parts)]
                    if len(parts[0][0]) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["h", "c"])
                        parts = []
                    held = sum(len(x) for x, _ in parts)
        if parts:
            u, n = flush(parts)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "c"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, total: int) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The VOCAB most frequent words (ties by hash), and a table of frequent words' sorted hashes and counts.

    The table holds every word from some count on, at most TABLE of them."""
    by_count = sorted(((r[0], r[1]) for r in counts.groupBy("c").count().orderBy(F.desc("c")).collect()), reverse=True)
    least, n = None, 0
    for c, k in by_count:
        if n + k > TABLE:
            break
        least, n = c, n + k
    ends = counts.where(F.col("h") == END_HASH).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = counts.where(F.col("h") != END_HASH)
    top = words.orderBy(F.desc("c"), "h").limit(VOCAB).collect()
    found = words.where(F.col("c") >= least).toArrow() if least is not None else None
    th = found["h"].to_numpy().view(np.uint64) if found else np.zeros(0, np.uint64)
    tc = found["c"].to_numpy() if found else np.zeros(0, np.int64)
    place = np.argsort(th)
    h = np.array([r[0] for r in top], np.int64).view(np.uint64)
    c = np.array([r[1] for r in top], np.int64)
    order = np.argsort(h)
    ids = np.arange(2, len(h) + 2)
    return Vocabulary(h[order], ids[order], np.concatenate([[ends, total - ends - c.sum()], c]).astype(np.int64)), th[place], tc[place]


def fit(docs: DataFrame, vocab: Vocabulary, id_col: str, text: str, rounds: int = 3, shard_docs: int = 6400) -> Params:
    """Average of networks fitted on shards of the training documents ``docs``, in ``rounds`` rounds over a part of them each."""
    spark = docs.sparkSession
    p = start(vocab)
    chosen = docs.select(F.col(text).alias("text"), F.xxhash64(F.lit("shard"), F.col(id_col)).alias("o"))
    shared_vocab = spark.sparkContext.broadcast(vocab)

    def streams(batches):
        table = Lookup(shared_vocab.value.hashes)
        for batch in batches:
            for i, j, w, h in _hash_rows(batch, "text"):
                # Whole documents as bytes (two a token, the end sign last): cheaper to write and deal out than lists of numbers.
                ids = np.insert(encode(shared_vocab.value, h, table), w.row_words[1:], END).astype(np.uint16)
                ends = (w.row_words + np.arange(len(w.row_words))) * 2
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), packed.cast(pa.binary())], ["o", "ids"])

    tokens = cut(chosen.mapInArrow(streams, "o bigint, ids binary"))
    turn = F.pmod(F.xxhash64(F.lit("round"), "o"), F.lit(rounds))
    sizes = {r[0]: r[1] for r in tokens.groupBy(turn.alias("k")).count().collect()}
    for k, n in sorted(sizes.items()):
        shards = max(1, round(n / shard_docs))
        # One task a shard (a written table's files would be packed into fewer), a shard's documents in a fixed order. A session
        # that deals into more partitions than asked for still makes as many shards.
        dealt = tokens.where(turn == k).repartition(shards, "o").coalesce(shards)
        shared = spark.sparkContext.broadcast(p)

        def run(batches, shared=shared):
            docs_ = []
            for b in batches:
                docs_ += [(o, np.frombuffer(x, np.uint16).astype(np.int64)) for o, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            docs_.sort(key=lambda d: d[0])
            if docs_:
                q, seen, _ = fit_shard(shared.value, [d for _, d in docs_])
                yield pa.RecordBatch.from_arrays([pa.array([pack(q)], pa.binary()), pa.array([seen])], ["p", "n"])

        def average(batches):
            total, weight = None, 0
            for b in batches:
                for data, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    flat = np.frombuffer(data, np.float32).astype(np.float64) * k
                    total, weight = flat if total is None else total + flat, weight + k
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary()), pa.array([weight])], ["p", "n"])

        merged = cut(dealt.mapInArrow(run, "p binary, n bigint"))
        parts = merged.count()  # not the shards asked for: a session may deal into more
        while parts > 8:  # averages of up to 32 at a time, then of those
            parts = -(-parts // 32)
            merged = cut(merged.coalesce(parts).mapInArrow(average, "p binary, n bigint"))
        rows = merged.collect()
        weight = sum(r[1] for r in rows)
        mean = sum(np.frombuffer(bytes(r[0]), np.float32).astype(np.float64) * (r[1] / weight) for r in rows)
        p = unpack(mean.astype(np.float32).tobytes(), p)
        shared.destroy()  # the round's networks are written
    shared_vocab.destroy()
    return p


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_out_of: int = 10) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, unknown_tokens per row of ``docs``.

    Rows whose id has crc32 mod ``held_out_of`` = 0 are not learnt from. A null id counts as held out."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    held = F.coalesce(fold("id", held_out_of) == 0, F.lit(True))
    train = src.where(~held)
    counts = cut(word_counts(train, "id"))
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    vocab, table_h, table_c = vocabulary(counts, n_all)
    network = fit(train, vocab, "id", "text")
    v_out = v_all - len(vocab.hashes) - (1 if vocab.counts[END] else 0)
    shared = spark.sparkContext.broadcast((vocab, table_h, table_c, network))
    base_den = float(np.log10(n_all + 0.1 * (v_all + 1)))
    out_den = float(np.log10(float(vocab.counts[UNKNOWN]) + 0.1 * (v_out + 1)))

    def finish(block, p):
        """A scored block as record batches."""
        tokens = np.concatenate([b[0] for b in block])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([b[1] for b in block]))])
        lm = score_documents(p, tokens, bounds) / _LOG10
        at = 0
        for _, sizes, cols in block:
            yield pa.RecordBatch.from_arrays([*cols[:-2], pa.array(cols[-2] + lm[at : at + len(sizes)]), cols[-1]], ["id", "n_tokens", "n_known", "n_out", "base", "lm", "rare"])
            at += len(sizes)

    def run(batches):
        vocab, table_h, table_c, p = shared.value
        known, own, more = np.log10(vocab.counts + 0.1), Lookup(vocab.hashes), Lookup(table_h)
        block, held = [], 0
        for batch in batches:
            for i, j, w, h in _hash_rows(batch, "text"):
                rows, ids = j - i, encode(vocab, h, own)
                sizes = np.diff(w.row_words) + 1
                tokens = np.insert(ids, w.row_words[1:], END).astype(np.uint16)
                inside = ids != UNKNOWN
                base = np.bincount(w.row[inside], known[ids[inside]], rows) + known[END]
                n_known = np.bincount(w.row[inside], minlength=rows) + int(vocab.counts[END] > 0)
                uh, ur = h[~inside], w.row[~inside]
                n_out = np.bincount(ur, minlength=rows)
                if len(table_h) and len(uh):
                    at = more.find(uh)
                    met = at >= 0
                    lg = np.bincount(ur[met], np.log10(table_c[at[met]] + 0.1), rows)
                    n_known = n_known + np.bincount(ur[met], minlength=rows)
                    uh, ur = uh[~met], ur[~met]
                else:
                    lg = np.zeros(rows)
                ends = np.concatenate([[0], np.cumsum(np.bincount(ur, minlength=rows))]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(uh.view(np.int64)))
                block.append((tokens, sizes, [batch.column(0).slice(i, rows), pa.array(sizes.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(n_out.astype(np.int64)), pa.array(base + lg), lg, rare]))
                held += len(tokens)
                if held >= BLOCK_TOKENS:
                    yield from finish(block, p)
                    block, held = [], 0
        if block:
            yield from finish(block, p)

    kind = src.schema["id"].dataType.simpleString()
    scored = src.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, n_out bigint, base double, lm double, rare array<bigint>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    # Rare words by document: their counts come by hash, and sums go back to the document.
    words = scored.select("row", F.explode("rare").alias("h")).join(counts, "h", "left")
    per = words.groupBy("row").agg(
        F.count("c").alias("r_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("r_log")
    )
    out = scored.drop("rare").join(per, "row", "left")
    rare_log = F.coalesce("r_log", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * F.lit(base_den)).alias("base_score"),
        (F.col("lm") + rare_log - F.col("n_out") * F.lit(out_den)).alias("score"),
        F.col("n_out").alias("unknown_tokens"),
    )
