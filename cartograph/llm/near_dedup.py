"""Near duplicates on 5-word shingles: a multi-index Hamming join over b-bit MinHash signatures.

A set's signature is ``LANES`` MinHash values of 16 bits, four to a long. Signature distance is
the number of lanes that differ. The ten longs are chunks: by pigeonhole two signatures at most
19 lanes apart have a chunk with at most one differing lane, and masking each lane of a chunk in
turn enumerates that error, so an equi-join on the 40 masked chunks finds every such pair. Pairs
found further apart are also looked at (stars up to ``MAX_DISTANCE``). At similarity 0.75 a pair is
missed with chance 2e-6, and less above it.

No bucket is expanded into all pairs. Sets that are equal are one class. In a bucket every class
is first paired with two fixed members (stars), one of them the most central: the class that
shares buckets with most others, in a group of copies the one nearest to all. Confirmed links give
components. Only buckets that then hold several components go on: there each class outside the
largest component meets the classes of other components. That join keeps a pair in the first bucket
the two share and only if set sizes and the symmetric difference of ``BITS``-bit maps of the sets
(a lower bound of the sets' own) leave the similarity possible.
Pairs within a component are never needed, so all components come out whole.

All candidates are confirmed on full shingle sets (64-bit hashes).

Defined results: null texts and texts without words have 0 shingles, are their own component and
are kept. Rows that repeat an id with the same text share a component and are all kept or not
alike. A row without an id joins the class of equal texts; a set that only such rows hold is linked with
nothing and kept. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.llm import textvec
from cartograph.operators.components import connected_components
from cartograph.session import cut

SHINGLE = 5
LANES = 40
CHUNKS = LANES // 4
MAX_DISTANCE = 26
BITS = 1024
#: Members of a bucket (about) in a piece, where a bucket holds several components.
PIECE = 256
SALTS = 64
#: Ids broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 500_000

_U = np.uint64
_MULT = textvec.mix(np.arange(1, LANES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_COEF = textvec.mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingles(words: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, rows), ordered by row and hash; short rows give one shingle."""
    h = words.hashes()
    n_words = np.diff(words.row_words)
    parts, rows = [], []
    if len(h) >= SHINGLE:
        m = len(h) - SHINGLE + 1
        s = np.zeros(m, np.uint64)
        for i in range(SHINGLE):
            s += h[i : i + m] * _COEF[i]
        inside = words.row[:m] == words.row[SHINGLE - 1 :]
        parts.append(textvec.mix(s[inside]))
        rows.append(words.row[:m][inside])
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        s = np.zeros(len(short), np.uint64)
        for i in range(SHINGLE - 1):
            has = n_words[short] > i
            s[has] += h[words.row_words[short[has]] + i] * _COEF[i]
        parts.append(textvec.mix(s + n_words[short].astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        rows.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s, r = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[new], r[new]


def describe(s: np.ndarray, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, two order-free fingerprints and packed signatures (n x CHUNKS) of rows."""
    size = np.bincount(r, minlength=n).astype(np.int64)
    have = np.flatnonzero(size)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    sig = np.zeros((n, CHUNKS), np.uint64)
    if len(have):
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        one[have] = np.add.reduceat(s, first)
        two[have] = np.add.reduceat(textvec.mix(s ^ _U(0x5851F42D4C957F2D)), first)
        for k in range(LANES):
            low = textvec.mix(np.minimum.reduceat(s * _MULT[k], first)) & _U(0xFFFF)
            sig[have, k // 4] |= low << _U(16 * (k % 4))
    return size, one, two, sig


def bit_maps(s: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """Maps (n x BITS / 64) of rows' sets: each hash sets one bit."""
    key = np.unique(r.astype(np.int64) * BITS + (s & _U(BITS - 1)).astype(np.int64))
    out = np.zeros(n * BITS // 64, np.uint64)
    if len(key):
        word = key >> 6
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] = np.add.reduceat(_U(1) << (key & 63).astype(np.uint64), first)
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, fp1, fp2 (fingerprint of the set), sig (array of CHUNKS longs) per row."""

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in textvec.slices(batch, "text"):
                s, r = shingles(textvec.split_words(data, bounds))
                size, one, two, sig = describe(s, r, j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * CHUNKS), _longs(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), _longs(one), _longs(two), lists], ["id", "n_shingles", "fp1", "fp2", "sig"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_shingles bigint, fp1 bigint, fp2 bigint, sig array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """n, fp1, fp2, set (array of hashes) and bits (its map) per row of ``docs`` (text)."""

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in textvec.slices(batch, "text"):
                s, r = shingles(textvec.split_words(data, bounds))
                size, one, two, _ = describe(s, r, j - i)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                maps = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * (BITS // 64)), _longs(bit_maps(s, r, j - i)))
                sets = pa.ListArray.from_arrays(pa.array(ends), _longs(s))
                yield pa.RecordBatch.from_arrays([pa.array(size), _longs(one), _longs(two), sets, maps], ["n", "fp1", "fp2", "set", "bits"])

    return docs.select("text").mapInArrow(run, "n bigint, fp1 bigint, fp2 bigint, set array<bigint>, bits array<bigint>")


def class_id(n: str = "n") -> Column:
    return F.xxhash64("fp1", "fp2", n)


def masked_chunks(sig: str = "sig") -> Column:
    """The keys of a signature: each chunk with each of its lanes replaced by the place's number."""
    keys = []
    for c in range(CHUNKS):
        for lane in range(4):
            clear = ~(0xFFFF << (16 * lane)) & (2**64 - 1)
            place = (c * 4 + lane) << (16 * lane)
            keys.append(F.get(sig, F.lit(c)).bitwiseAND(F.lit(clear - 2**64 if clear >= 2**63 else clear)).bitwiseOR(F.lit(place)))
    return F.array(*keys)


def _lane(k: int) -> int:
    """The mask of a lane of a long, signed."""
    m = 0xFFFF << (16 * k)
    return m - 2**64 if m >= 2**63 else m


def lanes_apart(a: str, b: str) -> Column:
    """Lanes in which two packed signatures (arrays) differ."""
    total = F.lit(0)
    for c in range(CHUNKS):
        x = F.get(a, F.lit(c)).bitwiseXOR(F.get(b, F.lit(c)))
        for k in range(4):
            total = total + (x.bitwiseAND(F.lit(_lane(k))) != 0).cast("int")
    return total


def first_shared(place: Column, a: list[Column], b: list[Column]) -> Column:
    """Whether ``place`` is the first key that two signatures (lists of chunks) with that key in common share."""
    first = F.lit(True)
    for c in range(CHUNKS - 1):
        x = a[c].bitwiseXOR(b[c])
        none = F.lit(True)
        for k in range(4):
            none = none & (x.bitwiseAND(F.lit(~_lane(k))) != 0)
        first = first & ((place < 4 * (c + 1)) | none)
    own = F.lit(False)  # equal chunks share all four keys, of which the first counts
    for c in range(CHUNKS):
        own = own | ((F.shiftright(place, 2) == c) & (a[c] != b[c]))
    return ((place.bitwiseAND(F.lit(3)) == 0) | own) & first


def possible(na: Column, nb: Column, a: list[Column], b: list[Column], percent: int) -> Column:
    """The maps' differing bits are no more than the similarity leaves: |A ^ B| <= (1 - s) / (1 + s) (|A| + |B|)."""
    bits = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return bits * (100 + percent) <= (100 - percent) * (na + nb)


def _near(na: str, nb: str, siga: str, sigb: str, percent: int) -> Column:
    """Neither set size nor signature distance rules the pair out."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (lanes_apart(siga, sigb) <= MAX_DISTANCE)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets have the similarity."""
    one = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id) per row."""
    sigs = cut(signatures(docs, id_col, text))
    full = sigs.where("n_shingles > 0")
    classes = cut(
        full.groupBy(F.col("n_shingles").alias("n"), "fp1", "fp2").agg(F.min("id").alias("rep"), F.any_value("sig").alias("sig")).withColumn("cid", class_id())
    )

    keys = classes.select(F.posexplode(masked_chunks()).alias("place", "key"), "cid")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    members = cut(keys.join(shared, "key"))
    central = members.groupBy("cid").agg(F.sum("many").alias("links"))
    hubs = members.join(central, "cid").groupBy("key").agg(
        F.max_by("cid", F.struct("links", "cid")).alias("c1"), F.min_by("cid", F.xxhash64("cid")).alias("c2")
    )

    own = classes.select("cid", "n", "sig")

    def sized(pairs: DataFrame) -> DataFrame:
        left = own.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga"))
        right = own.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb"))
        return pairs.join(left, "a").join(right, "b").where(_near("na", "nb", "siga", "sigb", percent)).select("a", "b")

    star = members.join(hubs, "key").select("cid", F.explode(F.array("c1", "c2")).alias("c")).where("cid <> c")
    stars = cut(sized(star.select(F.least("cid", "c").alias("a"), F.greatest("cid", "c").alias("b")).distinct()))

    # Texts are needed of classes that share a bucket with another one.
    ids = cut(members.select("cid").distinct().join(classes.select("cid", "rep"), "cid").select("rep").distinct())
    few = ids.count() <= BROADCAST_IDS
    src = docs.select(F.col(id_col).alias("rep"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    sets = cut(shingle_sets(src).where("n > 0").select(class_id().alias("cid"), "n", "set", "bits"))

    first = cut(_confirmed(stars, sets, percent))
    comp = connected_components(first, "a", "b")
    comp = cut(comp.select(F.col("id").alias("cid"), F.col("component").alias("comp")))

    placed = members.select("key", "place", "cid").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    by_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = by_comp.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("all")).where("comps > 1")
    mixed = mixed.withColumn("pieces", F.ceil(F.col("all") / PIECE).cast("int"))
    facts = own.join(sets.select("cid", "bits").groupBy("cid").agg(F.any_value("bits").alias("bits")), "cid").select(
        "cid", "n", *[F.get("sig", F.lit(i)).alias(f"s{i}") for i in range(CHUNKS)], *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITS // 64)]
    )
    # A bucket's members are dealt into pieces, and every piece meets every piece: no task holds a whole large bucket.
    piece, every = F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int"), F.sequence(F.lit(0), F.col("pieces") - 1)
    open_ = cut(placed.join(mixed.select("key", "main", "pieces"), "key").join(facts, "cid").withColumn("piece", piece))
    # Few bytes and much work: dealt to as many tasks as shuffles have.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = open_.where("comp <> main").withColumn("other", F.explode(every)).select([F.col(c).alias(f"{c}_a") for c in [*open_.columns, "other"]]).repartition(parts, "key_a", "piece_a", "other_a")
    b = open_.withColumn("other", F.explode(every)).select([F.col(c).alias(f"{c}_b") for c in [*open_.columns, "other"]]).repartition(parts, "key_b", "other_b", "piece_b")

    def side(x: str, letter: str, n: int) -> list[Column]:
        return [F.col(f"{letter}{i}_{x}") for i in range(n)]

    meet = a.join(
        b,
        (F.col("key_a") == F.col("key_b"))
        & (F.col("piece_a") == F.col("other_b"))
        & (F.col("other_a") == F.col("piece_b"))
        & (F.col("comp_a") != F.col("comp_b"))
        & ((F.col("comp_b") == F.col("main_a")) | (F.col("cid_a") < F.col("cid_b")))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & possible(F.col("n_a"), F.col("n_b"), side("a", "b", BITS // 64), side("b", "b", BITS // 64), percent)
        & first_shared(F.col("place_a"), side("a", "s", CHUNKS), side("b", "s", CHUNKS)),
    )
    late = meet.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    second = cut(_confirmed(late, sets, percent))
    if not second.isEmpty():
        named = comp.select(F.col("cid").alias("x"), "comp")
        over = second.join(named.select(F.col("x").alias("a"), F.col("comp").alias("ca")), "a", "left").join(named.select(F.col("x").alias("b"), F.col("comp").alias("cb")), "b", "left")
        over = cut(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        top = cut(connected_components(over, "a", "b").select(F.col("id").alias("comp"), F.col("component").alias("top")))
        nodes = comp.select("cid", "comp").union(second.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(comp.select("cid"), "cid", "left_anti").select("cid", F.col("cid").alias("comp")))
        comp = cut(nodes.join(top, "comp", "left").select("cid", F.coalesce("top", "comp").alias("comp")))

    named = classes.select("n", "fp1", "fp2", "rep", "cid").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    # Components of several classes only; a large one's rows are dealt over SALTS keys where it can't be broadcast.
    least = cut(named.where("comp <> cid").select("comp", "rep").union(named.where("comp = cid").join(comp.select("comp").distinct(), "comp", "left_semi").select("comp", "rep")).groupBy("comp").agg(F.min("rep").alias("component_id")))
    if least.count() <= BROADCAST_IDS:
        named = named.join(F.broadcast(least), "comp", "left")
    else:
        salted = least.select("comp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        named = named.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(salted, ["comp", "salt"], "left")
    named = named.select(F.col("n").alias("n_shingles"), "fp1", "fp2", F.coalesce("component_id", "rep").alias("component_id"))
    out = sigs.drop("sig").join(named, ["n_shingles", "fp1", "fp2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
