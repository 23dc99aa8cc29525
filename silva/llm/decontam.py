"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions alone.

Windows. A document's words give 5-word shingles; an item of m shingles is compared with windows as long as the item. The similarity
of a window is the sum of the smaller counts of shingles over the sum of the larger ones, so it can't reach the threshold
unless enough places in the window, nearly all of its m, hold a shingle of the item, in any order. The windows that do,
at every offset, are those to compare; all others are known to be less similar. Windows of equal words are one from there on,
and so are documents of equal text, however many there are.

Candidates. Windows and items get 64-bit SimHashes. RADIUS + 1 blocks of bits index them: two
fingerprints within the radius agree in one block at least. Candidates within the radius go on. A
similarity of 0.8 puts about 10 bits between two fingerprints, give or take 3, so 24 loses next to nothing. Blocks of so few bits
select little by themselves; what keeps the join small is that few windows get that far.

Verification. The exact weighted similarity of the two bags of shingles must reach the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_names, stage

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
RADIUS = 24
#: Rows that are broadcast at most (about 30 bytes each); a larger side is shuffled, where adaptive execution splits hot keys.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case; null gives none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def shingles(hashes: str, k: int) -> Column:
    """Hashes of all runs of k word hashes of the array column ``hashes``; none if there are fewer."""
    last = F.size(hashes) - k
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(k)]))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row, however often later expressions name it."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def simhash_sums(h: str, weight: str) -> list[Column]:
    """One weighted sum of signs for each bit of the hash column."""
    return [F.sum(F.when(F.shiftrightunsigned(h, b).bitwiseAND(1) == 1, F.col(weight)).otherwise(-F.col(weight))).alias(f"s{b}") for b in range(BITS)]


def simhash_value() -> Column:
    """The fingerprint from the sums: a bit is set where its sum is positive."""
    value = F.lit(0).cast("long")
    for b in range(BITS):
        value = value.bitwiseOR(F.when(F.col(f"s{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return value


def blocks(value: str, radius: int) -> Column:
    """radius + 1 pieces of the fingerprint as (block, bits), for posexplode."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(value, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])])


def _fingerprints(bags: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint from rows (keys, h, n)."""
    return bags.groupBy(*keys).agg(*simhash_sums("h", "n")).select(*keys, simhash_value().alias("fingerprint"))


def _small(df: DataFrame) -> DataFrame:
    """The staged table ``df``, to be broadcast if its size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _starts(least: float, shingle: int) -> Column:
    """Where a window may be similar enough, from the columns at (sorted places of the item's shingles), m, length and n (words of the text).

    A whole window needs 2 * least / (1 + least) * m places. One that the text's end cuts off needs least * m of them behind the last whole one's start.
    """
    whole = F.ceil(F.col("m") * (2 * least / (1 + least)) - 1e-9).cast("int")
    cut = F.ceil(F.col("m") * least - 1e-9).cast("int")
    many = F.size("at")
    last = F.col("n") - F.col("length")

    def span(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    inside = F.transform(span(F.lit(0), many - whole), lambda i: span(F.greatest(F.get("at", i + whole - 1) - F.col("m") + 1, F.lit(0)), F.least(F.get("at", i), last)))
    behind = F.size(F.filter("at", lambda p: p > last)) >= cut
    end = F.when(behind, span(F.greatest(last + 1, F.lit(0)), F.col("n") - (shingle - 1) - cut)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(F.flatten(inside), end))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per distinct text (its :func:`text_key` as k1, k2) and item that it leaks: k1, k2, item_id, similarity, start, length, as :func:`contaminated` says."""
    items = benchmark.select(F.col(item_col).alias("item_id"), hashed(words(F.col(item_text_col))).alias("w")).distinct()
    items = items.withColumn("shingles", shingles("w", shingle)).where(F.size("shingles") > 0)
    items = stage(items.select(F.xxhash64("item_id", "w").alias("item"), "item_id", F.size("w").alias("length"), F.size("shingles").alias("m"), "shingles"), "items")
    places = stage(items.select("item", "length", "m", F.explode(F.array_distinct("shingles")).alias("h")), "places")

    k1, k2 = text_key(F.col("text"))
    texts = docs.select(F.col(text_col).alias("text")).select(k1.alias("k1"), k2.alias("k2"), "text")
    spots = _once(texts, "w", hashed(words(F.col("text")))).select("k1", "k2", "w")
    spots = _once(spots, "shingles", shingles("w", shingle)).select("k1", "k2", F.size("w").alias("n"), F.posexplode("shingles").alias("p", "h"))
    hits = spots.join(_small(places), "h").groupBy("k1", "k2", "n", "item", "length", "m").agg(F.sort_array(F.collect_set("p")).alias("at"))  # a text's own places
    hits = hits.where(F.size("at") >= F.col("m") * least - 1e-9)
    starts = hits.select("k1", "k2", F.transform(_starts(least, shingle), lambda s: F.struct(s.alias("start"), F.col("length").alias("length"))).alias("x"))
    starts = stage(starts.where(F.size("x") > 0).groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("x")), "starts")  # a row per item
    bodies = texts.join(_small(starts.select("k1", "k2")), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    bodies = _once(bodies.join(starts, ["k1", "k2"]), "w", hashed(words(F.col("text")))).select("k1", "k2", "x", "w")
    windows = bodies.select("k1", "k2", F.explode(F.transform("x", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), F.slice("w", x["start"] + 1, x["length"]).alias("window")))).alias("x")).select("k1", "k2", "x.*")
    windows = stage(windows.withColumns({"c1": F.xxhash64("window"), "c2": F.xxhash64("length", "window")}), "windows")

    # one row per distinct window and length; bags of shingles
    bodies = windows.select("c1", "c2", "length", "window").distinct().withColumn("shingles", shingles("window", shingle))
    bags = stage(bodies.select("c1", "c2", "length", F.explode("shingles").alias("h")).groupBy("c1", "c2", "length", "h").agg(F.count("*").alias("n")), "bags")
    item_bags = stage(items.select("item", "item_id", "length", F.explode("shingles").alias("h")).groupBy("item", "item_id", "length", "h").agg(F.count("*").alias("n")), "item-bags")
    left = _fingerprints(bags, ["c1", "c2", "length"])
    right = _fingerprints(item_bags, ["item", "item_id", "length"])
    one = left.select("*", F.posexplode(blocks("fingerprint", radius)).alias("block", "bits"))
    two = stage(right.select("item", "item_id", "length", F.col("fingerprint").alias("other"), F.posexplode(blocks("fingerprint", radius)).alias("block", "bits")), "index")
    near = one.join(_small(two), ["length", "block", "bits"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= radius)
    pairs = near.select("c1", "c2", "item", "item_id").distinct()

    ours = bags.groupBy("c1", "c2").agg(F.sum("n").alias("total"))
    theirs = item_bags.groupBy("item").agg(F.sum("n").alias("item_total"))
    shared = pairs.join(bags.select("c1", "c2", "h", "n"), ["c1", "c2"]).join(item_bags.select("item", "h", F.col("n").alias("m")), ["item", "h"])
    shared = shared.groupBy("c1", "c2", "item", "item_id").agg(F.sum(F.least("n", "m")).alias("common")).join(ours, ["c1", "c2"]).join(theirs, "item")
    similarity = F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))
    found = shared.select("c1", "c2", "item_id", similarity.alias("similarity")).where(F.col("similarity") >= least)
    out = windows.select("k1", "k2", "start", "length", "c1", "c2").join(found, ["c1", "c2"])
    best = out.groupBy("k1", "k2", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "length")).alias("x"))
    return stage(best.select("k1", "k2", "item_id", "x.similarity", (-F.col("x.s")).cast("long").alias("start"), F.col("x.length").cast("long").alias("length")), "leaks")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, similarity, start and length (the best window in words; the first of equal ones).

    ``options`` are those of :func:`leaking_texts`. Items or documents of under ``shingle`` words, null or empty, match nothing. Rows that share an id count as one document
    or item for the report. Null ids are reported as null. A window at a document's end may be shorter than the item. Other columns are ignored;
    an empty table on either side gives no rows.
    """
    leaks = leaking_texts(docs, benchmark, text_col, **options)
    k1, k2 = text_key(F.col(text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2")).join(_small(leaks), ["k1", "k2"])
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "length")).alias("x"))
    return best.select("doc_id", "item_id", "x.similarity", (-F.col("x.s")).alias("start"), "x.length")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text leaks no item; whatever their ids."""
    names = new_names(docs, "k1", "k2")
    keys = stage(leaking_texts(docs, benchmark, text_col, **options).select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])).distinct(), "leaking")
    return docs.withColumns(dict(zip(names, text_key(F.col(text_col))))).join(_small(keys), names, "left_anti").select(*docs.columns)
