"""Helpers that several training-data operators share.

Nothing here keeps data on the driver: stage tables go to the folder in
``spark.checkpoint.dir``, which all executors see.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import drop_stages, new_path, stage

__all__ = ["bound_batches", "connected_components", "drop_stages", "freed_shuffles", "mix64", "new_names", "new_path", "readers", "shingle_hashes", "stage", "text_batches", "word_hashes"]

#: Bytes of text that one numpy pass holds at most, save for a single longer text; such a pass takes some 50 times as much memory.
BATCH_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to a Python worker; Spark's own bound is far above what a worker beside others may take.
ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ARROW_BYTES at most, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(ARROW_BYTES))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files when the query ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def readers(spark: SparkSession, files: int) -> int:
    """Tasks to read so many files back in. A small shuffle without a number of its own is merged into one task by adaptive execution."""
    return max(1, min(files, 4 * spark.sparkContext.defaultParallelism))


def new_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` has them."""
    taken, lead = {c.lower() for c in df.columns}, "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def text_batches(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with the texts of one column, ``most`` bytes or one text; a null text counts as empty."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            part = batch.slice(at, stop - at)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            at = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) on uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x9E3779B97F4A7C15)


_CLASS = np.zeros(256, dtype=bool)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the count of words in each text.

    A word is a run of ASCII letters or digits and of bytes beyond ASCII; A-Z count as a-z.
    The hash depends on the bytes of the word alone.
    """
    blob = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.array([len(b) + 1 for b in blob], dtype=np.int64))
    raw = np.frombuffer(b"\n".join([*blob, b""]), dtype=np.uint8)
    inside = _CLASS[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    powers = np.full(len(raw) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(powers[:-1] * (_LOWER[raw].astype(np.uint64) + np.uint64(1)), out=sums[1:])
    back = np.full(len(raw) + 1, _INVERSE, dtype=np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    words = mix64((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    return words, counts


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; a shorter text has one shingle, all its words; none has none."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : n - width + 1 + j]
    return mix64(out)


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes of undirected ``edges`` (columns a, b: long) with the smallest node reachable.

    Large-star and small-star steps in turn; each round is a pair of grouped minima and joins,
    written to the shared folder. Returns (node, component); nodes without edges don't appear,
    nor do those whose only edge is to themselves. Nulls are ignored. No edges: no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            out = stage(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
            drop_stages(e)
            return out
        before = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        after = stage(small.where("u <> v").distinct(), "edges")
        drop_stages(e)
        e = after
