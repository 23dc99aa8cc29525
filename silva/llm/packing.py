"""Packing token sequences into as few bins as possible by a grouping genetic algorithm.

Pieces are dealt at random into groups of about GROUP pieces. In each group several islands, each a
row of a table and so a unit of work for any executor, evolve a population of packings. A crossover
takes one parent's bins, injects whole well-filled bins of another, removes bins that held
any of the same pieces, dissolves the emptiest of the rest, and places the displaced pieces anew by best fit: into a bin
with the longest piece left goes the piece, or the pair, that leaves least room, until none fits. After each epoch each
island's elite moves to the next island. The best packing of a group wins. The bins that remain poorly
filled are dissolved, their pieces dealt into new groups, and those evolve in the same way. A group whose packing reaches
the lower bound, its pieces' total over the capacity, is done.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, readers, stage, text_batches
from .tokens import encoder

CAPACITY = 2048
GROUP = 1500
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 16, 6
WELL_FILLED = 0.9995
END_ID = 0

Bins = list[list[int]]


def best_fit(items: list[int], lengths: list[int], bins: Bins, capacity: int) -> Bins:
    """Put ``items`` (positions in lengths) into ``bins`` in order, each where least room stays free; opens bins as needed."""
    room = sorted((capacity - sum(lengths[i] for i in own), k) for k, own in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            bisect.insort(room, (capacity - lengths[i], len(bins) - 1))
        else:
            free, k = room.pop(at)
            bins[k].append(i)
            bisect.insort(room, (free - lengths[i], k))
    return bins


def tight_fit(items: Iterable[int], lengths: list[int], capacity: int) -> Bins:
    """New bins for ``items``, one at a time: the longest left, then the single piece or pair that leaves least room, until none fits."""
    order = sorted(items, key=lambda i: lengths[i])
    size = [lengths[i] for i in order]
    bins = []
    while order:
        own, room = [order.pop()], capacity - size.pop()
        while order and size[0] <= room:
            low, high = 0, bisect.bisect_right(size, room) - 1
            most, pick = size[high], (high,)
            while low < high and most < room:
                both = size[low] + size[high]
                if both > room:
                    high -= 1
                else:
                    if both > most:
                        most, pick = both, (high, low)
                    low += 1
            for k in pick:
                own.append(order.pop(k))
                size.pop(k)
            room -= most
        bins.append(own)
    return bins


def fitness(bins: Bins, lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of equally many, uneven filling is."""
    return -len(bins), sum((sum(lengths[i] for i in own) / capacity) ** 2 for own in bins)


def crossover(one: Bins, two: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    def filled(own: list[int]) -> int:
        return sum(lengths[i] for i in own)

    good = sorted(two, key=filled, reverse=True)[: -(-len(two) // 2)]
    injected = rng.sample(good, max(1, len(good) // 3))
    taken = {i for own in injected for i in own}
    kept, displaced = [], []
    for own in one:
        if taken.isdisjoint(own):
            kept.append(own)
        else:
            displaced += [i for i in own if i not in taken]
    kept.sort(key=filled)
    loose = -(-len(kept) // rng.choice((4, 8, 16)))  # mutation: the emptiest bins are dissolved too
    displaced += [i for own in kept[:loose] for i in own]
    return injected + kept[loose:] + tight_fit(displaced, lengths, capacity)


def _bins(where: np.ndarray) -> Bins:
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order])) + 1
    return [own.tolist() for own in np.split(order, cuts)]


def _where(bins: Bins, n: int) -> bytes:
    out = np.zeros(n, dtype=np.int32)
    for k, own in enumerate(bins):
        out[own] = k
    return out.tobytes()


def evolve(lengths: list[int], elites: list[Bins], seed: int, capacity: int, generations: int = GENERATIONS, population: int = POPULATION) -> Bins:
    """The best packing an island finds in some generations, no worse than best fit of the longest first or the ``elites`` given."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    crowd: list[tuple[tuple[int, float], Bins]] = []

    def add(bins: Bins) -> bool:
        crowd.append((fitness(bins, lengths, capacity), bins))
        return len(bins) <= least

    everything = range(len(lengths))
    done = any([add(own) for own in elites])
    done = done or add(best_fit(sorted(everything, key=lambda i: -lengths[i]), lengths, [], capacity))
    done = done or add(tight_fit(everything, lengths, capacity))
    while not done and len(crowd) < population:
        done = add(best_fit(sorted(everything, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0)), lengths, [], capacity))
    for _ in range(0 if done else generations):
        crowd.sort(key=lambda x: x[0], reverse=True)
        del crowd[population:]
        (_, one), (_, two) = rng.sample(crowd[: population // 2 + 1], 2)
        if add(crossover(one, two, lengths, capacity, rng)) or add(crossover(two, one, lengths, capacity, rng)):
            break
    return max(crowd, key=lambda x: x[0])[1]


def _evolve_rows(capacity: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            best, count, score = [], [], []
            for group, island, lengths, *elites in zip(rows.grp, rows.island, rows.lengths, rows.elite, rows.guest):
                own = [int(x) for x in lengths]
                found = evolve(own, [_bins(np.frombuffer(e, dtype=np.int32)) for e in elites if e is not None], hash((group, island, epoch)), capacity)
                a, b = fitness(found, own, capacity)
                best.append(_where(found, len(own)))
                count.append(-a)
                score.append(b)
            yield pd.DataFrame({"grp": rows.grp, "island": rows.island, "lengths": rows.lengths, "elite": best, "bins": count, "score": score})

    return run


def pack_groups(items: DataFrame, groups: int, capacity: int, name: str) -> DataFrame:
    """``items`` (with grp, one of ``groups``, idx from 0 and length) with bin, the place of the winner's bin in its group, and fill, that bin's length."""
    state = items.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("idx", "length"))).alias("x"))  # GROUP pieces or so
    state = state.select("grp", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("x.length").alias("lengths"))
    state = state.withColumns({"elite": F.lit(None).cast("binary"), "guest": F.lit(None).cast("binary")})
    # with a number: adaptive execution would merge so few bytes, but much work, into one task
    tasks = readers(items.sparkSession, ISLANDS * groups)
    for epoch in range(EPOCHS):
        state = stage(state.repartition(tasks, "grp", "island").mapInPandas(_evolve_rows(capacity, epoch), "grp long, island int, lengths array<long>, elite binary, bins long, score double"), f"{name}-{epoch}")
        if epoch + 1 < EPOCHS:
            moved = state.select("grp", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
            state = state.drop("bins", "score").join(moved, ["grp", "island"])
    win = state.groupBy("grp").agg(F.max_by("elite", F.struct(-F.col("bins"), F.col("score"), -F.col("island"))).alias("elite"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, elite in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where = np.frombuffer(elite, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), group)), pa.array(np.arange(len(where))), pa.array(where.astype(np.int64))], ["grp", "idx", "bin"])

    placed = items.join(win.mapInArrow(expand, "grp long, idx long, bin long"), ["grp", "idx"])
    return placed.withColumn("fill", F.sum("length").over(Window.partitionBy("grp", "bin")))


def _grouped(items: DataFrame, groups: int, order: list[str]) -> DataFrame:
    dealt = items.withColumn("grp", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.withColumn("idx", (F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("length"), *order)) - 1).cast("long"))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenised documents cut into pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian uint32).

    A null or empty text is the end id alone. Null ids and repeated rows are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for part, texts in text_batches(batches):
            flat, counts = words.encode(texts, end_id)
            rows, at = [], 0
            for doc_id, n in zip(part.column(0).to_pylist(), counts.tolist()):
                for k, start in enumerate(range(0, n, capacity)):
                    own = flat[at + start : at + min(n, start + capacity)].astype("<u4").tobytes()
                    rows.append((doc_id, k, start, len(own) // 4, zlib.crc32(own), *[own] * with_ids))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.binary()) for k, c in enumerate(zip(*rows))], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    bound_batches(docs.sparkSession)
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (pieces: doc_id, piece, start, length, ids_crc32, maybe ids) with sequence_id and offset.

    Pieces of one sequence fill it from offset 0 without gaps, at most ``capacity`` in all. Empty in, empty out.
    """
    columns = found.columns
    order = ["doc_id", "piece", "start", "ids_crc32"]
    live, whole, before, turn = stage(found, "pieces"), None, None, 0
    left = live.count()
    poor = F.col("fill") < WELL_FILLED * capacity
    while True:
        # what groups leave poorly filled is dealt anew among fewer groups, until one holds it all or a pass saves no bin
        groups = max(1, -(-left // GROUP))
        packed = stage(pack_groups(stage(_grouped(live, groups, order), "dealt"), groups, capacity, f"pass{turn}").withColumn("turn", F.lit(turn)), "packed")
        bins = packed.select("grp", "bin", "fill").distinct()
        after, again = bins.count(), bins.where(poor).count()
        if groups == 1 or again < 2 or (before is not None and after >= before):
            whole = packed if whole is None else whole.unionByName(packed)
            break
        full = packed.where(~poor)
        whole = full if whole is None else whole.unionByName(full)
        live, before, turn = packed.where(poor).select(*columns), again, turn + 1
        left = live.count()
    bin_ = ["turn", "grp", "bin"]
    at = F.sum("length").over(Window.partitionBy(*bin_).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    number = F.col("turn") * (1 << 56) + F.col("grp") * (1 << 24) + F.col("bin")  # a group's bins are fewer than its pieces
    return whole.withColumn("offset", at).withColumn("sequence_id", number.cast("long")).select(*columns, "sequence_id", "offset")
