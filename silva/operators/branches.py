"""Cover sets of a region followed from its base into branches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import branch_rules
from . import cluster
from .tables import stage

#: Fixed value: layers looked ahead at most.
AHEAD = 6


def _around(sets: set[int], near: dict[int, set[int]], but: set[int]) -> set[int]:
    return set().union(*(near.get(s, set()) for s in sets)) - but


def _parts(sets: set[int], near: dict[int, set[int]], starts: list[set[int]] | None = None) -> list[set[int]]:
    """Connected parts of ``sets``, in the order of their smallest set; grown from ``starts``, whose sets count as connected, if given."""
    left, out = set(sets), []
    for start in starts or [{s} for s in sorted(sets)]:
        edge = start & left
        part: set[int] = set()
        while edge:
            part |= edge
            left -= edge
            edge = _around(edge, near, set()) & left
        if part:
            out.append(part)
    return out


def _is_branch(base: int, size: int, goes_on: bool, cut: int, study: int) -> tuple[bool, bool]:
    """(whether a part begins a branch, whether it continues the segment)."""
    ends, main = branch_rules(base, size, np.bool_(goes_on), cut, study)
    return bool(~ends & ~main), bool(main)


def follow(near: dict[int, set[int]], base: set[int]) -> dict[int, tuple[int, int]]:
    """(branch, parent) of each set that is reached: branches from 1 in the order their bases are found, the first with parent 0.

    A segment grows layer by layer. Where the next layer falls apart, a few layers ahead decide which part goes on and which begin branches of their own.
    """
    bases, parents, found, taken = [set(base)], [0], {}, set(base)
    number = 0
    while number < len(bases):
        layer, held, depth, blocked = bases[number], set(bases[number]), None, set(taken)
        while True:
            blocked |= layer
            cut = _around(layer, near, blocked)
            if not cut:
                break
            depth = min(len(cut), AHEAD) if depth is None else depth
            starts = _parts(cut, near)
            if len(starts) > 1:
                layers, beyond = [cut], blocked | cut
                while len(layers) < depth and (more := _around(layers[-1], near, beyond)):
                    layers.append(more)
                    beyond |= more
                parts = _parts(set().union(*layers), near, starts)
                if len(parts) > 1:
                    study = sum(map(len, parts))
                    kinds = [_is_branch(len(p & cut), len(p), bool(_around(p & layers[-1], near, beyond)), len(cut), study) for p in parts]
                    branching = [k for k, (branch, _) in enumerate(kinds) if branch]
                    if branching and not any(main for _, main in kinds):
                        branching.remove(max(branching, key=lambda k: (len(parts[k]), -k)))  # the largest goes on
                    for k in branching:
                        bases.append(parts[k] & cut)
                        parents.append(number + 1)
                        taken |= bases[-1]
                        blocked |= parts[k]
                    cut = cut - blocked
            if not cut:
                break
            held |= cut
            layer = cut
        taken |= held
        for s in held:
            found[s] = (number + 1, parents[number])
        number += 1
    return found


def split_branches(points: DataFrame, patch: float, ball: float, at_least: int = 3, more_than: int = 100, height: float = 1.0) -> DataFrame:
    """``points`` (pid, x, y, z, seg_id) with branch and parent, numbered from 1 within their segment.

    Segments of more than ``more_than`` points, over ``height`` from bottom to top, with more than two cover sets are followed from their lowest set; all others are branch 1.
    Points in no set, or in sets that the base doesn't reach, have nulls. The sets of one segment, not its points, meet in one task.
    """
    tall = points.groupBy("seg_id").agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("span")).where((F.col("n") > more_than) & (F.col("span") > height))
    some = stage(points.join(tall.select("seg_id"), "seg_id", "left_semi"), "tall")
    cover = stage(cluster.cover_sets(some, patch, ball, at_least, keys=["seg_id"]), "cover")
    touch = stage(cluster.cover_neighbours(some, cover, ball, keys=["seg_id"]), "touch")
    sets = cover.select(F.col("center_pid").alias("pid")).distinct().join(some.select("pid", "seg_id", "z"), "pid")
    many = sets.groupBy("seg_id").agg(F.count("*").alias("n")).where("n > 2").select("seg_id")
    sets = stage(sets.join(many, "seg_id", "left_semi"), "sets")
    pairs = touch.join(sets.select(F.col("pid").alias("set_id"), F.col("seg_id").alias("own")), "set_id").select("own", "set_id", "nbr_id")

    def run(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(links.set_id.tolist(), links.nbr_id.tolist()):
            near.setdefault(a, set()).add(b)
        found = follow(near, set(own.pid[own.z == own.z.min()].tolist()))
        return pd.DataFrame([(s, *v) for s, v in found.items()], columns=["center_pid", "branch", "parent"])

    numbered = sets.groupBy("seg_id").cogroup(pairs.groupBy("own")).applyInPandas(run, "center_pid long, branch int, parent int")
    named = cover.join(numbered, "center_pid").select("pid", "branch", "parent")
    out = points.join(many.withColumn("_split", F.lit(True)), "seg_id", "left").join(named, "pid", "left")
    whole = F.col("_split").isNull()
    return out.select(*points.columns, F.when(whole, 1).otherwise(F.col("branch")).alias("branch"), F.when(whole, 0).otherwise(F.col("parent")).alias("parent"))
