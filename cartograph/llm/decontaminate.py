"""Benchmark decontamination by template windows, DataFrame functions only.

Texts and items are made canonical: numbers, names (capitalised words inside a sentence) and
units after a number become typed placeholders, other words are lowered, signs go. Windows of
``WINDOW`` canonical words are hashed and joined with the items' windows. Along one alignment of
a text and an item the placeholders' own values must map consistently (an item's value always to
the same value of the text), so a re-parameterised question is caught while unrelated fillings of
a common pattern are not. A text is contaminated by an item when consistent windows cover at
least ``min_share`` of the item's, or an unbroken run of ``RUN_WORDS`` words matches in one alignment, however
long the item is. Windows that are mostly placeholders count where the placeholders' values are equal too.

Before windows leave a text's array they are tested against a bit map of the items' hashes (one row of
fixed size, broadcast; it only spares work), so rows are made for windows that may match and no others.

Defined results: null and empty texts or items match nothing. Items with under ``MIN_WORDS`` words
cannot be told from ordinary text and are not used; items
shorter than a window are one window. Rows that share an id count as one document; an item id
that repeats is one item with the windows of all its rows. Empty tables give an empty result; texts of any length are
read whole; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartograph.session import cut

WINDOW = 8
MIN_WORDS = 4
#: An unbroken run of so many matching words is a copy whatever its share of the item.
RUN_WORDS = 13
#: Bits of the map of the items' window hashes, held in longs.
MAP_BITS = 1 << 19
#: Item windows broadcast to the join; more are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000

# Marks of a number, a name, a unit, and of a sign inside a number.
NUMBER, NAME, UNIT, INNER = "\u0002", "\u0003", "\u0004", "\u0005"
MARKS = f"[{NUMBER}-{INNER}]"
# Units read as such after a number.
UNITS = (
    "km", "m", "cm", "mm", "miles?", "kg", "g", "mg", "lbs?", "l", "ml", "hours?", "hrs?", "minutes?", "mins?", "seconds?", "secs?",
    "days?", "weeks?", "months?", "years?", "dollars?", "euros?", "cents?", "percent", "degrees?", "mph", "feet", "ft", "inch(?:es)?",
)
GAP = rf"[^\p{{L}}\p{{M}}0-9{NUMBER}-{INNER}]+"


def templates(df: DataFrame, text: str) -> DataFrame:
    """``df`` with w (words, placeholders carrying their values after a mark) and c (placeholders bare) and
    hashes (of c) for ``text``.

    Each step is a column of its own, so that none is computed twice."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_t", F.when(t.rlike(MARKS), F.regexp_replace(t, MARKS, " ")).otherwise(t))
    inner = F.regexp_replace("_t", r"(?<=[0-9])[.,:](?=[0-9])", INNER)
    # Digits within a word (w12, b7db7aa) are part of the word; a unit may follow without a blank.
    alone = rf"(?<![\p{{L}}\p{{M}}0-9{INNER}])[0-9][0-9{INNER}]*(?=(?i:{'|'.join(UNITS)})(?!\p{{L}})|[^\p{{L}}\p{{M}}0-9{INNER}]|$)"
    numbers = F.regexp_replace(inner, alone, f" {NUMBER}$0 ")
    units = F.regexp_replace(numbers, rf"(?i)({NUMBER}[0-9{INNER}]+ )[ \t-]*({'|'.join(UNITS)})(?!\p{{L}})", f"$1{UNIT}$2")
    df = df.withColumn("_n", F.when(F.col("_t").rlike("[0-9]"), units).otherwise(F.col("_t"))).drop("_t")
    # A name starts after a blank that follows a word or a comma; the match starts at blanks only.
    df = df.withColumn("_n", F.lower(F.regexp_replace("_n", r"[ \t](?=\p{Lu}\p{Ll})(?<=[\p{L}0-9,;:][ \t]{1,3})", f"$0{NAME}")))
    bare = F.when(F.col("_n").rlike(f"[{NUMBER}-{UNIT}]"), F.split(F.regexp_replace("_n", rf"([{NUMBER}-{UNIT}])[\p{{L}}\p{{M}}0-9{INNER}]+", "$1"), GAP))
    df = df.withColumn("w", F.array_remove(F.split("_n", GAP), "")).withColumn("c", F.array_remove(bare, ""))
    return df.withColumn("c", F.coalesce("c", "w")).drop("_n").withColumn("hashes", F.transform("c", lambda x: F.xxhash64(x)))


def window_hash(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), F.slice(hashes, at, F.lit(size)))


def item_windows(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(windows: h, item_id, size, bpos, bwords, exact: values must be equal; items: item_id, n_windows)."""
    w = templates(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "text").where(F.size("w") >= MIN_WORDS)
    w = w.withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    spans = w.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("bpos"))
    spans = spans.withColumn("bc", F.slice("c", F.col("bpos"), F.col("size"))).withColumn("bwords", F.slice("w", F.col("bpos"), F.col("size")))
    plain = F.size(F.filter("bc", lambda x: ~x.rlike(f"^[{NUMBER}-{UNIT}]")))
    spans = spans.select(F.xxhash64("size", F.slice("hashes", F.col("bpos"), F.col("size"))).alias("h"), "item_id", "size", "bpos", "bwords", (plain * 2 <= F.col("size")).alias("exact"))
    return spans, spans.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(~F.col("exact")).alias("n_plain"))


def hash_map(windows: DataFrame) -> DataFrame:
    """One row: map (array of longs), a bit for every hash of ``windows`` modulo MAP_BITS."""
    bits = windows.select(F.pmod("h", F.lit(MAP_BITS)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits"))
    # MAP_BITS / 64 rows.
    places = windows.sparkSession.range(MAP_BITS // 64).withColumnRenamed("id", "place").join(bits, "place", "left")
    every = places.agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("x"))
    return every.select(F.col("x.bits").alias("map"))


def rarest(windows: DataFrame, totals: DataFrame, min_share: float) -> DataFrame:
    """h, item_id: of an item's n windows the n - m + 1 that fewest items have, m being the fewest windows that contaminate.

    Any m windows of the item hold one of these, so they find every pair."""
    run = RUN_WORDS - WINDOW + 1
    common = windows.groupBy("h").agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
    w = Window.partitionBy("item_id").orderBy("items", "h", "bpos")
    ranked = windows.join(common, "h").withColumn("rank", F.row_number().over(w))
    own = totals.withColumnRenamed("item_id", "_item")
    least = F.least(F.ceil(F.col("n_windows") * min_share), F.when(F.col("n_plain") > 0, F.ceil(F.col("n_plain") * min_share)).otherwise(F.col("n_windows")), F.lit(run))
    return ranked.join(own, F.col("item_id").eqNullSafe(F.col("_item"))).where(F.col("rank") <= F.col("n_windows") - F.greatest(least, F.lit(1)) + 1).select("h", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_share: float = 0.5) -> DataFrame:
    """One row per document and item that contaminates it: id, item_id, matched, n_windows, share, n_slots, verbatim."""
    windows, totals = (cut(x) for x in item_windows(items, item_id, item_text))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [WINDOW]  # WINDOW rows at most
    small = windows.count() <= BROADCAST_WINDOWS

    def may_match(h: Column) -> Column:
        slot = F.pmod(h, F.lit(MAP_BITS)).cast("int")
        return F.getbit(F.get("map", F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))) == 1

    def hits_of(words: Column, hashes: Column, size: int) -> Column:
        def row(i):
            return F.struct(i.alias("dpos"), window_hash(hashes, i, size).alias("h"), F.slice(words, i, F.lit(size)).alias("dwords"))

        places = F.filter(F.sequence(F.lit(1), F.size(hashes) - F.lit(size - 1)), lambda i: may_match(window_hash(hashes, i, size)))
        return F.when(F.size(hashes) >= size, F.transform(places, row))

    def hits(words: Column, hashes: Column) -> Column:
        found = [hits_of(words, hashes, size) for size in sizes]
        return F.flatten(F.array_compact(F.array(*found))) if len(found) > 1 else found[0]

    d = templates(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text")
    d = d.join(F.broadcast(hash_map(windows)), F.lit(True))
    # The outer form keeps Spark from testing the array's size first, which would work it out twice.
    d = d.select("id", F.explode_outer(hits(F.col("w"), F.col("hashes"))).alias("x")).where("x IS NOT NULL").select("id", "x.*")
    # Only windows that an item has are written; the map lets others through.
    own = windows.select("h").distinct()
    d = cut(d.join(F.broadcast(own) if small else own, "h", "left_semi"))
    # A text that an item contaminates holds so many of its windows that one of them is among the item's rarest; windows that many
    # items share so make no pairs.
    keys = rarest(windows, totals, min_share)
    pairs = d.select("id", "h").distinct().join(F.broadcast(keys) if small else keys, "h").select("id", "item_id").distinct()
    right = windows.select(F.col("item_id").alias("bitem"), F.col("h").alias("bh"), "size", "bpos", "bwords", "exact")
    wanted = pairs.join(F.broadcast(right) if small else right, F.col("item_id").eqNullSafe(F.col("bitem"))).withColumnRenamed("id", "bid").drop("bitem")
    met = d.join(wanted, F.col("id").eqNullSafe(F.col("bid")) & (F.col("h") == F.col("bh")) & (~F.col("exact") | (F.col("bwords") == F.col("dwords")))).drop("bid", "bh")

    filled = F.filter(
        F.arrays_zip("bwords", "dwords"), lambda x: x["bwords"].rlike(f"^[{NUMBER}-{UNIT}]")
    )
    # One alignment has one row per window of the item at most.
    # Windows that match by value stand for themselves; the others need a consistent alignment.
    free, fixed = F.when(~F.col("exact"), F.col("bpos")), F.when(F.col("exact"), F.col("bpos"))
    lined = met.groupBy("id", "item_id", (F.col("dpos") - F.col("bpos")).alias("shift")).agg(
        F.collect_set(free).alias("plain"), F.collect_set(fixed).alias("fixed"), F.max("size").alias("size"),
        F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("exact"), filled)))).alias("slots"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("exact"), filled)))).alias("equal"),
    )
    held = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["bwords"])))
    lined = lined.withColumns({k: F.when(held, F.col(k)).otherwise(F.slice(k, 1, 0)) for k in ("plain", "slots")})
    lined = lined.withColumn("bpos", F.array_sort(F.array_union("plain", "fixed"))).where(F.size("bpos") > 0)
    lined = lined.withColumn("same", F.forall("slots", lambda x: x["bwords"] == x["dwords"])).withColumn("slots", F.array_union("slots", "equal"))
    # Windows k apart in place and in order are one run without a gap.
    span = F.lit(RUN_WORDS) - F.col("size")
    lined = lined.withColumn("run", (F.col("size") == WINDOW) & F.exists(F.transform("bpos", lambda x, i: F.get("bpos", i + span) == x + span), lambda x: F.coalesce(x, F.lit(False))))
    by_item = lined.groupBy("id", "item_id").agg(
        F.some("run").alias("run"),
        F.size(F.array_distinct(F.flatten(F.collect_list("plain")))).alias("n_free"),
        F.size(F.array_distinct(F.flatten(F.collect_list("bpos")))).cast("long").alias("matched"),
        F.max(F.size("slots")).cast("long").alias("n_slots"),
        F.every("same").alias("verbatim"),
    )
    own = totals.withColumnRenamed("item_id", "_item")
    out = by_item.join(F.broadcast(own) if small else own, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    # An item with other values is known by its windows that allow them.
    share = F.greatest(F.col("matched") / F.col("n_windows"), F.when(F.col("n_plain") > 0, F.col("n_free") / F.col("n_plain")))
    out = out.withColumn("share", share).where((F.col("share") >= min_share) | F.col("run"))
    return out.select(F.col("id").alias(id_col), "item_id", "matched", "n_windows", "share", "n_slots", "verbatim")
