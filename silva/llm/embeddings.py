"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and split into blocks of a few dimensions. Two vectors within
squared distance t are within t * (block's dimensions / all dimensions) in one block at least, so a range join of
each block under its share finds every such pair. Blocks of 16 dimensions let about one random pair in a million through, blocks of 8 one in 700.

The range join of a block buckets its first coordinate in steps of the block's radius and meets the same and the next
bucket only. A crowded bucket is split into chunks whose pairs are separate units of work. A unit verifies its candidates at once: a pair
counts in the first block that lets it through, so it counts once, and what leaves the unit is a count and a link per vector, not
the pairs, of which a large group of near copies has too many. Vectors travel in single precision; the few pairs too close to the
threshold for that are verified apart, in double precision. Exact copies are one vector until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, drop_stages, stage

COSINE = 0.93
BLOCK_DIMS = 16
#: Rows of a bucket that one unit of work compares with as many others.
CHUNK = 8192
#: Added to squared distances of blocks, for single-precision coordinates.
SLACK = 1e-5
#: Cosines of single-precision unit vectors are off by less than this.
UNSURE = 1e-6


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _shares(least: float, dims: int, block_dims: int) -> list[tuple[int, int, float]]:
    """(first dimension, end, squared-distance budget) of each block."""
    ends = [(at, min(dims, at + block_dims)) for at in range(0, dims, block_dims)]
    return [(a, b, (2 - 2 * least) * (b - a) / dims + SLACK) for a, b in ends]


def _rotated(least: float, block_dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(3)
            sizes = np.diff(v.offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == dims))
                x = v.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
                x = _scaled(x)
                u = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(dims)).astype(np.float32)
                packed = pa.array([r.tobytes() for r in u], pa.binary())
                for block, (first, _, budget) in enumerate(_shares(least, dims, block_dims)):
                    cells = np.floor(u[:, first] / np.sqrt(budget)).astype(np.int64)
                    own = [batch.column(k).take(at) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), block), pa.int64()), pa.array(np.full(len(at), dims), pa.int64()), pa.array(cells), packed], ["node", "part", "copies", "block", "dims", "cell", "u"])

    return run


def _range_join(least: float, block_dims: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, dims, p, q = key[1], key[3], key[4], key[5]
        x = np.frombuffer(b"".join(rows.u), dtype=np.float32).reshape(len(rows), dims)
        shares = _shares(least, dims, block_dims)
        first, end, budget = shares[block]
        nodes, copies, chunk, next_ = rows.node.to_numpy(), rows.copies.to_numpy(), rows.chunk.to_numpy(), rows.next.to_numpy()
        own = np.ascontiguousarray(x[:, first:end])
        squares = (own * own).sum(axis=1, dtype=np.float32)
        ones = np.ones_like(squares)
        # one product of matrices gives all squared distances
        left, right = np.column_stack([-2 * own, squares, ones]), np.column_stack([own, ones, squares]).T.copy()
        links, parent = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        unsure: list[np.ndarray] = []
        here = np.flatnonzero(~next_)
        for s in range(0, len(here), 256):
            i = here[s : s + 256]
            a, b = np.nonzero(left[i] @ right <= budget + SLACK)
            a = i[a]
            # a pair of one bucket is met twice, with the next bucket once; a chunk pair is met only by rows of both
            keep = next_[b] | (nodes[b] < nodes[a])
            if p != q:
                keep &= chunk[a] != chunk[b]
            a, b = a[keep], b[keep]
            for t in range(0, len(a), 1 << 15):
                u, v = a[t : t + (1 << 15)], b[t : t + (1 << 15)]
                d = x[u].astype(np.float64) - x[v]
                d *= d
                within = [np.ascontiguousarray(d[:, m:n]).sum(axis=1) <= most for m, n, most in shares[: block + 1]]
                mine = within[block] & ~np.any(within[:block], axis=0) if block else within[block]
                cosine = 1 - d.sum(axis=1) / 2  # of unit vectors
                sure, maybe = mine & (cosine >= least + UNSURE), mine & (np.abs(cosine - least) < UNSURE)
                unsure.append(np.column_stack([nodes[u[maybe]], nodes[v[maybe]]]))
                u, v = u[sure], v[sure]
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                edges = np.flatnonzero(np.diff(u)) + 1  # u is in order
                for k, others in zip(u[np.append(0, edges)] if len(u) else [], np.split(v, edges)):  # one link for each vector says what is connected
                    roots = np.unique(parent[np.append(others, k)])
                    if len(roots) > 1:
                        parent[np.isin(parent, roots)] = roots[0]
        met = np.flatnonzero(links)
        pairs = np.concatenate(unsure) if unsure else np.zeros((0, 2), dtype=np.int64)
        counted = pd.DataFrame({"a": nodes[met], "b": nodes[parent[met]], "n": links[met], "sure": True})
        return pd.concat([counted, pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "n": 0, "sure": False})])

    return run


def range_join(vectors: DataFrame, least: float, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """What the units of work find among ``vectors`` (node, part, copies, v) of one part and size: a, b, n, sure.

    A sure row says that a is linked with n vectors (copies counted) and connected with b. An unsure row is a pair that single precision can't decide.
    """
    placed = vectors.select("node", "part", "copies", "v").mapInArrow(_rotated(least, block_dims), "node long, part long, copies long, block long, dims long, cell long, u binary")
    placed = stage(placed, "blocks")
    keys = ["part", "block", "cell", "dims"]
    both = placed.withColumn("next", F.lit(False)).unionByName(placed.withColumns({"cell": F.col("cell") - 1, "next": F.lit(True)}))
    sizes = both.groupBy(*keys).agg(F.count("*").alias("size"), F.sum(F.when(F.col("next"), 0).otherwise(1)).alias("own")).where("own > 0 and size > 1")
    chunks = F.ceil(F.col("size") / CHUNK)
    dealt = both.join(sizes, keys).withColumns({"chunk": F.pmod(F.xxhash64("node"), chunks), "other": F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))})
    dealt = dealt.withColumns({"p": F.least("chunk", "other"), "q": F.greatest("chunk", "other")}).select(*keys, "p", "q", "node", "copies", "u", "chunk", "next")
    found = stage(dealt.groupBy(*keys, "p", "q").applyInPandas(_range_join(least, block_dims), "a long, b long, n long, sure boolean"), "found")
    drop_stages(placed)
    return found


def _cosines(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            dims = np.diff(a.offsets.to_numpy())
            keep = np.zeros(len(dims), dtype=bool)
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                x, y = (v.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1) for v in (a, b))
                x, y = _scaled(x), _scaled(y)
                keep[at.to_numpy()] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= least
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in (0, 1, 4, 5)], ["a", "b", "ca", "cb"])

    return run


def _usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Links join vectors of equal, non-null labels (and equal size) with a cosine of ``least`` or more in double precision. Vectors that
    are null, empty or zero, or hold a null or non-finite component, link with nothing, nor do rows with a null label or id. Each row is a vector of its own,
    so repeated rows link with each other, and rows that share an id may have different links. Other columns are ignored; an empty table gives no rows.
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("usable", _usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = stage(rows.withColumns({"part": F.xxhash64("label"), "k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(3), "v", "label")}).drop("label"), "vectors")
    usable = rows.where("usable")
    nodes = usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("part").alias("part"), F.first("v").alias("v"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written once, so the numbers hold
    found = range_join(nodes, least, block_dims)
    close = found.where("not sure").select("a", "b")
    both = close.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("va"), F.col("copies").alias("ca")), "a").join(nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"), F.col("copies").alias("cb")), "b")
    late = stage(both.select("a", "b", "va", "vb", "ca", "cb").mapInArrow(_cosines(least), "a long, b long, ca long, cb long"), "late")
    counts = found.where("sure").select("a", "n").unionByName(late.select("a", F.col("cb").alias("n"))).unionByName(late.select(F.col("b").alias("a"), F.col("ca").alias("n")))
    counts = counts.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    links = found.where("sure").select("a", "b").unionByName(late.select("a", "b"))
    known = nodes.select("k1", "k2", "node", "least", "copies").join(counts, "node", "left").join(connected_components(links), "node", "left")
    known = known.select("k1", "k2", "least", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    low = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(low, "component").select("k1", "k2", "n_links", "component_id")
    joined = usable.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = joined.unionByName(rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
