"""Token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of pieces popped on
following it, both computed once. Reading a word then takes one step a symbol, and the number
of greedy longest-match pieces comes out without any piece being built.

Symbols are the bytes of a word; the last byte of a word is a symbol of its own (the
vocabulary marks word ends), so a piece that ends a word and one that does not differ.

Defined results: null and empty texts have 0 tokens. A word with a symbol that the vocabulary
lacks counts as one token (an unknown word). Ties cannot arise: the longest match is unique. Repeated rows are counted
each; an empty table gives an empty result; texts of any length are read whole; extra columns are not read. A vocabulary
that can't be read raises an error before any work starts.
"""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A public vocabulary; the path is a parameter everywhere below.
DEFAULT_VOCAB = "/opt/tokenizers/word_bpe_49k.json"
#: Pieces of lower-cased text that are words to the automaton.
WORDS = regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
GAPS = regex.compile(r"\s+")
END = 256
#: Distinct words whose counts a worker keeps at once.
CACHE = 300_000


class Automaton:
    """Trie nodes are numbers, 0 the root; ``goto`` maps node * 512 + symbol to a node."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        goto: dict[int, int] = {}
        final, parent, symbol, order = [False], [0], [0], [[0]]
        for piece in pieces:
            node = 0
            for depth, s in enumerate(piece, 1):
                nxt = goto.get(node * 512 + s)
                if nxt is None:
                    nxt = goto[node * 512 + s] = len(final)
                    final.append(False)
                    parent.append(node)
                    symbol.append(s)
                    if depth == len(order):
                        order.append([])
                    order[depth].append(nxt)
                node = nxt
            final[node] = bool(piece) or final[node]
        fail, pops = [-1] * len(final), [0] * len(final)
        for level in order[1:]:
            for v in level:
                if final[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                u, n = fail[parent[v]], pops[parent[v]]
                while u >= 0:
                    w = goto.get(u * 512 + symbol[v])
                    if w is not None:
                        fail[v], pops[v] = w, n
                        break
                    n += pops[u]
                    u = fail[u]
        self.goto, self.fail, self.pops = goto, fail, pops

    def count(self, symbols: tuple[int, ...]) -> int:
        """Pieces of the greedy longest match of a word; 1 if no match covers it."""
        goto, fail, pops = self.goto, self.fail, self.pops
        node = n = 0
        for s in symbols:
            nxt = goto.get(node * 512 + s)
            while nxt is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = goto.get(node * 512 + s)
            node = nxt
        while node > 0:  # pop what is left
            n += pops[node]
            node = fail[node]
        return n if node == 0 else 1


def symbols_of(word: str) -> tuple[int, ...]:
    b = word.encode()
    return (*b[:-1], b[-1] + END)


def read_vocab(path: str = DEFAULT_VOCAB) -> list[tuple[int, ...]]:
    """Pieces of a word-end vocabulary file, as symbols."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    pieces = []
    for name in names:
        body = name.removesuffix("</w>")
        if body and all(c in shown for c in body):
            b = [shown[c] for c in body]
            pieces.append(tuple(b[:-1] + [b[-1] + END]) if body != name else tuple(b))
    return pieces


def word_count(automaton: Automaton, word: str) -> int:
    """Tokens of a text without white space."""
    return sum(automaton.count(symbols_of(w)) for w in WORDS.findall(word))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """id, n_tokens (long) and n_words (long) per row.

    The vocabulary is read on the driver and its pieces (fixed size, about a MB) broadcast;
    each worker builds the automaton once. Counts of words are kept in a bounded cache."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocab(vocab))

    def run(batches):
        auto = Automaton(shared.value)
        known: dict[str, int] = {}
        for batch in batches:
            tokens, words = [], []
            for i in range(batch.num_rows):
                t = (batch.column(1)[i].as_py() or "").lower()
                seen = Counter(GAPS.split(t)) if t else Counter()
                seen.pop("", None)
                if len(known) > CACHE:
                    known.clear()
                n = 0
                for w, k in seen.items():
                    c = known.get(w)
                    if c is None:
                        c = word_count(auto, w)
                        if len(w) < 64:
                            known[w] = c
                    n += c * k
                tokens.append(n)
                words.append(sum(seen.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], ["id", "n_tokens", "n_words"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_tokens bigint, n_words bigint").withColumnRenamed("id", id_col)
