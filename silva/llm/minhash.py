"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Sketches. A document is the sequence of its 5-word shingles. Each shingle is labelled with how
often it has occurred before, so repeats count. Each of ``sketches`` hash functions picks the
``picks`` labelled shingles with the smallest values and keeps them in text order; two documents
with equal picks in equal order under any function are candidates. At an ordered similarity of
0.8 a sketch of 6 agrees with probability 0.24 or more, so 32 sketches miss 6 to 15 in 100,000
pairs; a passage that fills two fifths of two documents makes them candidates in one pair of eight.

Short documents. Picks are made without replacement, so sketches lose far more pairs of few shingles, and
all pairs of unequal length below PICKS. Pairs whose shorter text has SHORT shingles at most are found by prefixes
instead, without loss: of n labelled shingles at least 0.8 n must be common, so if each document orders its own from
the rarest to the commonest, two near ones share one of their first n - ceil(0.8 n) + 1.

Verification. Similarity is m / (n1 + n2 - m), where m is the longest common subsequence of the two
shingle sequences. Reaching the threshold leaves few insertions and deletions, so cells farther from
the diagonal than that count are outside the band and never matter.

Groups. Texts with equal words are one node from the start, numbered once. A bucket then links each node to the bucket's
smallest one, not to all others; only pairs that still lie in one bucket but different components are
compared in the last round, so no link found by any bucket is lost and no bucket is expanded
into all its pairs. Large buckets are compared there in blocks, and a pair goes on only if its
counts of shingles by hash prefix allow the threshold: the sum of their differences never exceeds
the number of shingles that the pair doesn't share. The members of buckets beyond CROWD (texts that share a passage, say)
meet again by prefixes instead, which loses none of their near pairs either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, drop_stages, mix64, shingle_hashes, stage, text_batches, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 32
PICKS = 6
#: Open buckets of more members than FEW are compared in blocks of at most BLOCK.
FEW, BLOCK = 16, 512
#: Members of an open bucket beyond which prefixes split it.
CROWD = 8192
#: Counts of shingles by hash that a document in such a block carries, and the coarser ones that are tried first.
BINS, FEWER = 1024, 256
#: Members of one bucket that may share a hub; larger buckets have several, joined in the next round.
FAN = 512
#: Pairs whose shorter text has so many shingles at most are found by prefixes.
SHORT = 40


def _occurrences(shingles: np.ndarray) -> np.ndarray:
    """How often each shingle has occurred before in the same array."""
    order = np.argsort(shingles, kind="stable")
    run = shingles[order]
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    out = np.empty(len(run), dtype=np.uint64)
    if len(first) == len(run):
        out[:] = 0
        return out
    out[order] = (np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))).astype(np.uint64)
    return out


def labelled_shingles(shingles: np.ndarray) -> np.ndarray:
    """The shingles, each mixed with how often it has occurred before: all distinct."""
    return mix64(shingles + _occurrences(shingles) * np.uint64(0xA24BAED4963EE407))


def order_minhash(shingles: np.ndarray, sketches: int, picks: int) -> np.ndarray:
    """The ``sketches`` values of one document's shingles (not empty), as uint64."""
    seeds = mix64(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    labelled = labelled_shingles(shingles)
    values = labelled[None, :] ^ seeds[:, None]
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0x9E3779B97F4A7C15)
    k = min(picks, len(shingles))
    at = np.argpartition(values, k - 1, axis=1)[:, :k] if k < len(shingles) else np.broadcast_to(np.arange(k), (sketches, k))
    at = np.sort(at, axis=1)
    out = seeds.copy()
    for j in range(k):
        out = mix64(out * np.uint64(3) + labelled[at[:, j]])
    return out


def common_in_order(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose matches lie within ``band`` of the diagonal.

    One row of the alignment is a whole number, a bit per cell of the band: 0 where the length grows (Hyyrö's recurrence). The band moves one
    cell a row; the cell that leaves it is counted. Repeated values cost no more than others.
    """
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    cells, found = full, 0
    met: dict[int, tuple[int, int, int]] = {}  # of a value: its places in the band as bits, the band's first cell then, places seen
    for i, x in enumerate(a):
        low = i - band
        if i:
            found += ~cells & 1
            cells = cells >> 1 | top
        at = places.get(x)
        if at is None:
            continue
        bits, then, k = met.get(x, (0, low, 0))
        bits >>= low - then
        while k < len(at) and at[k] < low + width:
            if at[k] >= low:
                bits |= 1 << (at[k] - low)
            k += 1
        met[x] = (bits, low, k)
        hit = cells & bits
        if hit:
            cells = ((cells + hit) | (cells - hit)) & full
    return found + width - cells.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Common share of two shingle sequences in order, m / (n1 + n2 - m); 0.0 if it is under ``least``."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return 0.0
    needed = int(np.ceil(least / (1 + least) * (n1 + n2) - 1e-9))
    if min(n1, n2) < needed:
        return 0.0
    short = min(n1, n2)
    head = int(np.argmin(np.append(a[:short] == b[:short], False)))
    tail = int(np.argmin(np.append(a[n1 - short + head :][::-1] == b[n2 - short + head :][::-1], False)))
    a, b = a[head : n1 - tail], b[head : n2 - tail]
    m = head + tail
    if len(a) and len(b):
        if m + min(int(np.count_nonzero(np.isin(a, b))), int(np.count_nonzero(np.isin(b, a)))) < needed:
            return 0.0
        m += common_in_order(a.tolist(), b.tolist(), n1 + n2 - 2 * needed)
    found = m / (n1 + n2 - m)
    return found if m >= needed and found >= least - 1e-12 else 0.0


def _digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes of a document's shingles in order."""
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    return int(np.sum(mix64(shingles + place)).view(np.int64)), int(np.sum(mix64(shingles ^ mix64(place))).view(np.int64))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketches: int = SKETCHES, picks: int = PICKS, shingle: int = SHINGLE, label_up_to: int = 0) -> DataFrame:
    """One row per document: id, hash (of its text), n (its shingles), digest_a and digest_b (of its words in order), sketch (array<long>, empty if n is 0), labelled (its labelled shingles, null if n exceeds ``label_up_to``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            words, counts = word_hashes(texts)
            n, first, second, kept, labelled = [], [], [], [], []
            for own in np.split(words, np.cumsum(counts)[:-1]):
                own = shingle_hashes(own, shingle)
                one, two = _digests(own) if len(own) else (0, 0)
                n.append(len(own))
                first.append(one)
                second.append(two)
                kept.append(order_minhash(own, sketches, picks).view(np.int64) if len(own) else np.zeros(0, dtype=np.int64))
                labelled.append(labelled_shingles(own).view(np.int64) if 0 < len(own) <= label_up_to else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(kept, pa.list_(pa.int64())), pa.array(labelled, pa.list_(pa.int64()))], ["id", "hash", "n", "digest_a", "digest_b", "sketch", "labelled"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    return rows.mapInArrow(run, "id long, hash long, n long, digest_a long, digest_b long, sketch array<long>, labelled array<long>")


def prefixes(labelled: DataFrame, least: float) -> DataFrame:
    """id, n, value: the rarest n - ceil(least * n) + 1 labelled shingles of each document (id, n, labelled), without those that no other has."""
    each = labelled.select("id", "n", F.explode("labelled").alias("value"))
    often = each.groupBy("value").agg(F.count("*").alias("often"))
    ranked = each.join(often, "value").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("ranked"))
    first = F.slice("ranked", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    return ranked.select("id", "n", F.explode(first).alias("x")).where("x.often > 1").select("id", "n", "x.value")


def _block_pairs(least: float):
    """Compares two blocks of one bucket (or one with itself): pairs of different components that length and bins allow."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, two = rows[rows.part == key[2]], rows[rows.part == key[3]]
        fine1, fine2 = (np.frombuffer(b"".join(x.bins), dtype=np.uint8).reshape(len(x), BINS).astype(np.int16) for x in (one, two))
        coarse1, coarse2 = (x.reshape(len(x), FEWER, -1).sum(axis=2, dtype=np.int16) for x in (fine1, fine2))
        n2, c2, id2 = two.n.to_numpy(), two.c.to_numpy(), two.id.to_numpy()
        a, b = [], []
        for k, (i, n, c) in enumerate(zip(one.id, one.n, one.c)):
            free = (n + n2) * (1 - least) / (1 + least) + 1e-6
            hit = np.flatnonzero((c2 != c) & (np.abs(n2 - n) <= free) & ((id2 < i) | (key[2] != key[3])))
            hit = hit[np.abs(coarse2[hit] - coarse1[k]).sum(axis=1) <= free[hit]]
            hit = hit[np.abs(fine2[hit] - fine1[k]).sum(axis=1) <= free[hit]]
            a.append(np.full(len(hit), i))
            b.append(id2[hit])
        a, b = np.concatenate(a) if a else np.zeros(0, dtype=np.int64), np.concatenate(b) if b else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


def shingled(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The shingle hashes, in order, of texts (id, text): id, hashes (8 bytes each). A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in text_batches(batches):
            words, counts = word_hashes(own)
            hashes = [shingle_hashes(w, shingle).tobytes() for w in np.split(words, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.binary())], ["id", "hashes"])

    return texts.select("id", "text").mapInArrow(run, "id long, hashes binary")


def labelled(shingles: DataFrame) -> DataFrame:
    """For each row of ``shingles`` (id, hashes): id, n, labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [labelled_shingles(np.frombuffer(x.as_buffer(), dtype=np.uint64)).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["id", "n", "labelled"])

    return shingles.select("id", "hashes").mapInArrow(run, "id long, n long, labelled array<long>")


def binned(shingles: DataFrame) -> DataFrame:
    """For each row of ``shingles`` (id, hashes): id, bins (BINS counts, at most 255, of shingles by their hash's first bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [(np.frombuffer(x.as_buffer(), dtype=np.uint64) >> np.uint64(64 - BINS.bit_length() + 1)).view(np.int64) for x in batch.column(1)]
            bins = [np.minimum(np.bincount(x, minlength=BINS), 255).astype(np.uint8).tobytes() for x in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins, pa.binary())], ["id", "bins"])

    return shingles.select("id", "hashes").mapInArrow(run, "id long, bins binary")


def verified(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """Those ``pairs`` (a, b) whose shingles (id, hashes; one row per id) align with similarity ``least`` or more, with the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2), batch.column(3)
            found = np.array([similarity(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), least) for x, y in zip(one, two)])
            keep = pa.array(np.flatnonzero(found > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(found).take(keep)], ["a", "b", "similarity"])

    one = shingles.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a"))
    two = shingles.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "hashes_a", "hashes_b")
    return both.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE, sketches: int = SKETCHES, picks: int = PICKS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (the smallest id that links reach, itself included), kept (doc_id = class_id).

    Links join documents whose ordered similarity is ``least`` or more. A null or wordless text links
    with nothing. Each row is a document of its own, also where rows share an id or have none; a null id is never a class's,
    unless no row of the class has one: then class_id is null and the row is kept.
    Letter case (A-Z) and punctuation don't count. Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    # a text within reach of a short one has its shingles labelled too
    sketched = stage(sketch(docs, id_col, text_col, sketches, picks, shingle, int(SHORT / least)), "sketch")
    key = ["digest_a", "digest_b", "n"]
    no_id = F.lit((1 << 63) - 1)
    # one node per distinct sequence of words, with one of the rows that have it; minima are combined before the shuffle
    lead = F.min(F.struct(F.coalesce("id", no_id).alias("id"), "hash")).alias("lead")
    nodes = sketched.where("n > 0").groupBy(*key).agg(lead, F.first("sketch").alias("sketch"), F.first("labelled").alias("labelled"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written once, so the numbers hold
    reps = nodes.select(F.col("node").alias("id"), "n", "sketch", "labelled")
    buckets = reps.select("id", "n", F.posexplode("sketch").alias("j", "value"))
    short = stage(prefixes(reps.where("labelled is not null"), least), "prefixes")
    buckets = buckets.unionByName(short.withColumn("j", F.lit(-1)))
    shared = buckets.groupBy("j", "value").agg(F.count("*").alias("size"), F.min("id").alias("hub")).where("size > 1")
    members = stage(buckets.join(shared, ["j", "value"]).select("j", "value", "size", "hub", "id", "n"), "buckets")

    # shingles of the nodes that share a bucket, from the text of one row each
    wanted = nodes.select("node", "lead.*").join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash")).join(wanted, ["id", "hash"])
    texts = texts.dropDuplicates(["id", "hash", "node"]).select(F.col("node").alias("id"), "text")
    shingles = stage(shingled(texts, shingle), "shingles")

    # round 1: each node with the smallest hub of all its buckets; a large bucket has hubs of its parts, which hang on the bucket's
    small, large = members.where(F.col("size") <= FAN).select("id", "hub"), members.where(F.col("size") > FAN)
    for seed in (1, 2):
        parted = large.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("size") / FAN)))
        near = parted.groupBy("j", "value", "part").agg(F.min("id").alias("near_hub"))
        small = small.unionByName(parted.join(near, ["j", "value", "part"]).select("id", F.col("near_hub").alias("hub"))).unionByName(parted.join(near, ["j", "value", "part"]).select(F.col("near_hub").alias("id"), "hub").distinct())
    hubs = stage(small.where("id <> hub").distinct(), "hubs")
    first = hubs.groupBy("id").agg(F.min("hub").alias("b")).select(F.col("id").alias("a"), "b")
    links = stage(verified(first, shingles, least).select("a", "b"), "links")
    labels = connected_components(links)

    def label(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(col), F.col("component").alias("_c")), col, "left").withColumn(name, F.coalesce("_c", col)).drop("_c")

    # round 2: every other hub of a bucket that lies in another component
    rest = label(label(hubs, "id", "c1"), "hub", "c2").where("c1 <> c2").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    more = stage(verified(rest, shingles, least).select("a", "b"), "links")
    both = stage(links.unionByName(more), "links")
    drop_stages(labels, links, more)
    labels = connected_components(both)

    # round 3: whatever still shares a bucket across components
    def open_buckets(members: DataFrame) -> DataFrame:
        placed = label(members, "id", "c")
        split = placed.groupBy("j", "value").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many")).where("lo < hi").select("j", "value", "many")
        return stage(placed.join(split, ["j", "value"]).select("j", "value", "many", "id", "n", "c"), "open")

    def few_pairs(found: DataFrame) -> DataFrame:
        few = found.where(F.col("many") <= FEW).drop("many")
        left, right = few.toDF("j", "value", "a", "na", "ca"), few.toDF("j", "value", "b", "nb", "cb")
        alike = (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))
        return left.join(right, ["j", "value"]).where(alike).select("a", "b")

    found = open_buckets(members)
    crowd = shingles.join(found.where(F.col("many") > CROWD).select("id").distinct(), "id", "left_semi")
    again, rarest = found.limit(0), found.limit(0)
    if (found.agg(F.max("many")).first()[0] or 0) > CROWD:
        rarest = stage(prefixes(labelled(crowd), least), "prefixes")
        again = open_buckets(rarest.withColumn("j", F.lit(-2)))
    whole = found.where((F.col("many") > FEW) & (F.col("many") <= CROWD)).unionByName(again.where(F.col("many") > FEW))
    bins = binned(shingles.join(whole.select("id").distinct(), "id", "left_semi"))
    parts = F.ceil(F.col("many") / BLOCK)
    blocks = whole.withColumn("part", F.pmod(F.xxhash64("id"), parts)).join(bins, "id")
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    pairs = few_pairs(found).unionByName(few_pairs(again)).unionByName(blocks.groupBy("j", "value", "p", "q").applyInPandas(_block_pairs(least), "a long, b long"))
    pairs = pairs.select("a", "b").distinct().join(hubs.select(F.col("id").alias("a"), F.col("hub").alias("b")), ["a", "b"], "left_anti")
    last = stage(verified(pairs, shingles, least).select("a", "b"), "links")
    done = connected_components(both.unionByName(last))
    drop_stages(members, short, rarest, shingles, hubs, labels, both, found, again, last)

    known = nodes.select(*key, "node", "lead.id").join(done, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = known.groupBy("component").agg(F.min("id").alias("class_id"))
    classes = known.join(low, "component").select(*key, F.when(F.col("class_id") < no_id, F.col("class_id")).alias("class_id"), F.lit(True).alias("worded"))
    out = sketched.select("id", *key).join(classes, key, "left")
    class_id = F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), class_id.alias("class_id"), F.col("id").eqNullSafe(class_id).alias("kept"))
