"""Labels on a weighted graph: their costs, and smoothing of the pairwise energy by minimal cuts of blocks, for two labels or, move by move, for more."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop_stages, numbered, stage

#: Points of a block to begin with, and of the largest that one task cuts.
EXACT, MOST = 5_000, 80_000


def unary(points: DataFrame, mode: int = 0, p: str = "p_wood") -> DataFrame:
    """pid, u0, u1: costs of leaf and wood by the chosen fidelity (0 squared, 1 minus p, 2 minus log), less the row's smaller one, over the mean of all."""
    wood, leaf = F.col(p), 1 - F.col(p)
    forms = {0: lambda own, other: (1 - own) * (1 - own) + other * other, 1: lambda own, other: -own, 2: lambda own, other: -F.log(F.greatest(own, F.lit(1e-12)))}
    raw = points.select("pid", forms[mode](leaf, wood).alias("r0"), forms[mode](wood, leaf).alias("r1"))
    low = raw.select("pid", (F.col("r0") - F.least("r0", "r1")).alias("s0"), (F.col("r1") - F.least("r0", "r1")).alias("s1"))
    mean = low.agg((F.sum(F.col("s0") + F.col("s1")) / (2 * F.count("*"))).alias("mean"))
    with_mean = low.crossJoin(F.broadcast(mean))
    return with_mean.select("pid", *[F.when(F.col("mean") > 0, F.col(f"s{i}") / F.col("mean")).otherwise(0.0).alias(f"u{i}") for i in (0, 1)])


def energy(labels: DataFrame, costs: DataFrame, edges: DataFrame, strength: float) -> float:
    """Unary costs of the labels plus ``strength`` times the weights of edges (each pair once) between unequal ones."""
    own = labels.join(costs, "pid").agg(F.sum(F.when(F.col("label") == 1, F.col("u1")).otherwise(F.col("u0")))).first()[0] or 0.0
    a, b = labels.select(F.col("pid").alias("src"), F.col("label").alias("la")), labels.select(F.col("pid").alias("dst"), F.col("label").alias("lb"))
    cut = edges.where("src < dst").join(a, "src").join(b, "dst").where("la <> lb").agg(F.sum("w")).first()[0] or 0.0
    return own + strength * cut


#: Room and excess up to this count as none, and the label of points from which nothing can reach the sink.
LEAST, NEVER = 1e-12, 1 << 40


class _Network:
    """Arcs with room for flow: arc e from ``to[e ^ 1]`` to ``to[e]`` has ``room[e]`` left."""

    def __init__(self, n: int):
        self.to, self.room, self.out = [], [], [[] for _ in range(n)]

    def add(self, i: int, j: int, there: float, back: float = 0.0) -> None:
        self.out[i].append(len(self.to))
        self.out[j].append(len(self.to) + 1)
        self.to += [j, i]
        self.room += [there, back]

    def levels(self, source: int) -> list[int]:
        """Arcs on the shortest way from the source to each point, -1 where there is none."""
        to, room, out = self.to, self.room, self.out
        depth = [-1] * len(out)
        depth[source] = 0
        line = [source]
        for i in line:
            for e in out[i]:
                if room[e] > LEAST and depth[to[e]] < 0:
                    depth[to[e]] = depth[i] + 1
                    line.append(to[e])
        return depth

    def push(self, source: int, sink: int) -> None:
        """As much more flow as there is room for, along shortest ways (levels first, then walks)."""
        to, room, out = self.to, self.room, self.out
        while (depth := self.levels(source))[sink] >= 0:
            turn = [0] * len(out)
            way: list[int] = []
            at = source
            while True:
                if at == sink:
                    flow = min(room[e] for e in way)
                    for e in way:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    cut = next(k for k, e in enumerate(way) if room[e] <= LEAST)
                    at = to[way[cut] ^ 1]
                    del way[cut:]
                    continue
                while turn[at] < len(out[at]) and not (room[out[at][turn[at]]] > LEAST and depth[to[out[at][turn[at]]]] == depth[at] + 1):
                    turn[at] += 1
                if turn[at] < len(out[at]):
                    way.append(out[at][turn[at]])
                    at = to[way[-1]]
                elif way:
                    at = to[way.pop() ^ 1]
                    turn[at] += 1
                else:
                    break


def minimal_cut(u0: np.ndarray, u1: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """Labels 0 or 1 of least energy: u0 or u1 of each point plus w of each edge (a, b) with labels 0 and 1, and ``back`` (w, if not given) of one with 1 and 0; where both are as good, 1.

    The maximal flow from a source to a sink leaves label 0 to the points that the source can still reach.
    """
    n = len(u0)
    source, sink = n, n + 1
    # a point on the source's side has label 0 and cuts its way to the sink, which costs u0; one on the sink's side u1
    base = np.minimum(u0, u1)
    net = _Network(n + 2)
    for end in zip(a.tolist(), b.tolist(), w.tolist(), (w if back is None else back).tolist()):
        net.add(*end)
    for i in range(n):
        if u1[i] > base[i]:
            net.add(source, i, float(u1[i] - base[i]))
    for i in range(n):
        if u0[i] > base[i]:
            net.add(i, sink, float(u0[i] - base[i]))
    net.push(source, sink)
    depth = net.levels(source)
    return np.array([0 if depth[i] >= 0 else 1 for i in range(n)])


def _block_labels(own: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    """pid and label of the points of one block that are the same whatever the labels beyond it are; null for the others."""
    own = own.sort_values("pid")
    pids = own.pid.to_numpy()
    n = len(pids)
    a, b, cap = np.searchsorted(pids, arcs.src.to_numpy()), np.searchsorted(pids, arcs.dst.to_numpy()), arcs.cap.to_numpy()
    pairs, at = np.unique(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b), return_inverse=True)
    there, back = np.zeros(len(pairs)), np.zeros(len(pairs))
    np.add.at(there, at, np.where(a < b, cap, 0.0))
    np.add.at(back, at, np.where(a < b, 0.0, cap))
    ends = pairs // n, pairs % n, there, back
    u0, u1 = own.u0.to_numpy(), own.u1.to_numpy()
    low = minimal_cut(u0, u1 + own.into.to_numpy(), *ends)  # all beyond have label 0
    if not own.out.any() and not own.into.any():
        return pd.DataFrame({"pid": pids, "label": pd.Series(low, dtype="Int32")})
    high = minimal_cut(u0 + own.out.to_numpy(), u1, *ends)  # all beyond have label 1
    return pd.DataFrame({"pid": pids, "label": pd.Series(low, dtype="Int32").where(low == high)})


def least_energy(costs: DataFrame, arcs: DataFrame, places: DataFrame | None = None, block: int = EXACT, most: int = MOST) -> DataFrame:
    """pid and label (0 or 1) of least energy: u0 or u1 of each point, plus ``cap`` of each arc (src, dst, cap) whose src has label 0 and dst 1.

    Blocks of about ``block`` points are cut twice, once as if all points beyond had label 0 and once as if all had 1. The energy is submodular, so the labels of
    its minimum (of several, that with the most ones) lie between both: where the two agree the label is final. It then joins its neighbours' own costs, and the points that are
    left go on in blocks of other borders, which grow where little was decided. Points that stay open in blocks of ``most`` get their labels by a flow between the blocks,
    :func:`_by_regions`, which ends at the same minimum. So the result doesn't depend on the blocks, and no task meets a whole component.
    Blocks follow the order of ``places`` (pid and columns to sort by, such as :func:`along_curve`); without it that of the pids.
    """
    order = ["pid"] if places is None else [*[c for c in places.columns if c != "pid"], "pid"]
    live = stage(costs.select("pid", "u0", "u1") if places is None else costs.select("pid", "u0", "u1").join(places, "pid"), "live")
    links = stage(arcs.where((F.col("cap") > 0) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.sum("cap").alias("cap")), "arcs")
    done, size, turn, left = None, block, 0, live.count()
    while left:
        several = left > size
        placed = stage(numbered(live, order, "_at") if several else live.withColumn("_at", F.lit(0).cast("long")), "placed")
        # borders lie elsewhere in every round
        blocks = stage(placed.withColumn("block", F.floor((F.col("_at") + turn * (size // 2)) / size) if several else F.col("_at")).drop("_at"), "blocks")
        ends = links.join(blocks.select(F.col("pid").alias("src"), F.col("block").alias("block")), "src").join(blocks.select(F.col("pid").alias("dst"), F.col("block").alias("beyond")), "dst")
        ends = stage(ends, "ends")
        crossing = ends.where("block <> beyond")
        border = crossing.select(F.col("src").alias("pid"), F.col("cap").alias("out"), F.lit(0.0).alias("into")).unionByName(crossing.select(F.col("dst").alias("pid"), F.lit(0.0).alias("out"), F.col("cap").alias("into")))
        border = border.groupBy("pid").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
        own = blocks.join(border, "pid", "left").na.fill(0.0, ["out", "into"]).select("block", "pid", "u0", "u1", "out", "into")
        inner = ends.where("block = beyond").select(F.col("block").alias("part"), "src", "dst", "cap")
        found = own.groupBy("block").cogroup(inner.groupBy("part")).applyInPandas(_block_labels, "pid long, label int")
        fixed = stage(found.where("label IS NOT NULL"), "fixed")
        done = fixed if done is None else done.unionByName(fixed)
        # what is decided weighs on its neighbours
        zero = ends.join(fixed.where("label = 0").select(F.col("pid").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("pid")).agg(F.sum("cap").alias("more1"))
        one = ends.join(fixed.where("label = 1").select(F.col("pid").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("pid")).agg(F.sum("cap").alias("more0"))
        open_ = live.join(fixed.select("pid"), "pid", "left_anti").join(zero, "pid", "left").join(one, "pid", "left")
        after = stage(open_.withColumns({"u0": F.col("u0") + F.coalesce("more0", F.lit(0.0)), "u1": F.col("u1") + F.coalesce("more1", F.lit(0.0))}).select(live.columns), "live")
        still = after.select("pid")
        fewer = stage(links.join(still.withColumnRenamed("pid", "src"), "src", "left_semi").join(still.withColumnRenamed("pid", "dst"), "dst", "left_semi"), "arcs")
        drop_stages(live, links, placed, blocks, ends)
        live, links, before, left, turn = after, fewer, left, after.count(), 1 - turn
        if left > 0.75 * before:
            size *= 2
        if left and size > most:
            return done.unionByName(_by_regions(live, links, order, most))
    return done if done is not None else costs.select("pid", F.lit(0).alias("label")).limit(0)


#: A block's points (0), its pairs of points (1), and what it sent over its border from a to b (2) and from b to a (3).
_SENT = "kind int, block long, a long, b long, x double, y double, d long"


def _discharged(own: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    """One block of :func:`_by_regions` after a round: its excess goes to the sink, then over the border to points of ever larger labels; then its points get new labels."""
    own = own.sort_values("pid")
    block, pids, n = int(own.block.iloc[0]), own.pid.to_numpy(), len(own)
    excess, drain, label = own.excess.to_numpy(), own.drain.to_numpy(), own.d.to_numpy()
    ends, room = arcs[["a", "b"]].to_numpy(dtype=np.int64), arcs[["there", "back"]].to_numpy(dtype=float)
    side = arcs.side.to_numpy()  # 0 of pairs within the block, else 1 if a, 2 if b is in it
    sent = np.zeros(len(arcs))
    if len(own) and ((excess > LEAST) & (label < NEVER)).any():
        mine = np.where(side == 2, ends[:, 1], ends[:, 0])
        other = np.where(side == 2, ends[:, 0], ends[:, 1])
        far = np.unique(other[side > 0])
        i = np.searchsorted(pids, mine)
        j = np.where(side > 0, n + np.searchsorted(far, other), np.searchsorted(pids, other))
        beyond = np.full(len(far), NEVER)
        beyond[j[side > 0] - n] = arcs.beyond.to_numpy()[side > 0]
        source, sink = n + len(far), n + len(far) + 1
        net = _Network(n + len(far) + 2)
        there, back = np.where(side == 2, room[:, 1], room[:, 0]), np.where(side == 0, room[:, 1], 0.0)
        for arc in zip(i.tolist(), j.tolist(), there.tolist(), back.tolist()):
            net.add(*arc)
        for v in range(n):
            net.add(source, v, float(excess[v]))
        for v in range(n):
            net.add(v, sink, float(drain[v]))
        net.push(source, sink)
        steps = sorted({int(k) for k in beyond if k < NEVER})
        for k in steps:
            for w in np.flatnonzero(beyond == k):
                net.add(n + int(w), sink, float("inf"))
            net.push(source, sink)
        m = 2 * len(arcs)
        left = np.array(net.room)
        room = np.where(side[:, None] == 0, np.stack([left[0:m:2], left[1:m:2]], axis=1), room)
        sent = np.where(side > 0, left[1:m:2], 0.0)
        excess, drain = left[m : m + 2 * n : 2], left[m + 2 * n : m + 4 * n : 2]
        # borders to pass on the way to the sink
        new = np.full(n, NEVER)
        over: dict[int, list[int]] = {}
        for e in np.flatnonzero((side > 0) & (left[0:m:2] > LEAST)):
            over.setdefault(int(beyond[j[e] - n]), []).append(int(i[e]))
        for step, starts in [(0, np.flatnonzero(drain > LEAST).tolist()), *((k + 1, over.get(k, [])) for k in steps)]:
            line = []
            for v in starts:
                if new[v] == NEVER:
                    new[v] = step
                    line.append(v)
            for v in line:
                for e in net.out[v]:
                    u = net.to[e]
                    if u < n and new[u] == NEVER and net.room[e ^ 1] > LEAST:
                        new[u] = step
                        line.append(u)
        label = np.maximum(label, new)
    points = pd.DataFrame({"kind": 0, "block": block, "a": pids, "b": 0, "x": excess, "y": drain, "d": label})
    within = side == 0
    pairs = pd.DataFrame({"kind": 1, "block": block, "a": ends[within, 0], "b": ends[within, 1], "x": room[within, 0], "y": room[within, 1], "d": 0})
    gone = sent > 0
    over_border = pd.DataFrame({"kind": side[gone] + 1, "block": block, "a": ends[gone, 0], "b": ends[gone, 1], "x": sent[gone], "y": 0.0, "d": 0})
    return pd.concat([points, pairs, over_border], ignore_index=True)


def _reached(own: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    """pid and block of the points of one block, not met before, that its starts reach by arcs with room."""
    start, met = own.pid[own.start].tolist(), set(own.pid[own.met].tolist())
    onward: dict[int, list[int]] = {}
    for a, b, there, back in zip(arcs.a.tolist(), arcs.b.tolist(), arcs.there.tolist(), arcs.back.tolist()):
        if there > LEAST:
            onward.setdefault(a, []).append(b)
        if back > LEAST:
            onward.setdefault(b, []).append(a)
    line = [v for v in start if v not in met]
    met.update(line)
    for v in line:
        for u in onward.get(v, []):
            if u not in met:
                met.add(u)
                line.append(u)
    return pd.DataFrame({"pid": pd.Series(line, dtype="int64"), "block": int(own.block.iloc[0])})


def _by_regions(live: DataFrame, links: DataFrame, order: list[str], size: int) -> DataFrame:
    """pid and label of least energy, as :func:`least_energy` says, by a maximal flow through blocks of ``size`` points that only tell each other what crosses their borders.

    Every point has a label, at most the number of borders on the way to the sink. In a round each block sends its excess to the sink, then over its border by growing labels
    (:func:`_discharged`); what would go to a point whose label meanwhile grew too large goes back. Labels only grow, and those above one that no point at a border has
    can't reach the sink any more. Without excess that could, the flow is maximal, whatever the blocks are: what excess reaches has label 0.
    """
    placed = numbered(live, order, "_at")
    lean = F.col("u1") - F.col("u0")
    points = placed.select(F.floor(F.col("_at") / size).alias("block"), "pid", F.greatest(lean, F.lit(0.0)).alias("excess"), F.greatest(-lean, F.lit(0.0)).alias("drain"), F.lit(0).cast("long").alias("d"))
    points = stage(points, "points")
    ahead = F.col("src") < F.col("dst")
    pairs = links.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.when(ahead, F.col("cap")).otherwise(0.0)).alias("there"), F.sum(F.when(ahead, 0.0).otherwise(F.col("cap"))).alias("back"))
    for e in "ab":
        pairs = pairs.join(points.select(F.col("pid").alias(e), F.col("block").alias(f"{e}_block")), e)
    pairs = stage(pairs, "pairs")
    inner = pairs.where("a_block = b_block").select(F.col("a_block").alias("block"), "a", "b", "there", "back")
    border = pairs.where("a_block <> b_block").select("a", "b", "there", "back", "a_block", "b_block", F.lit(0).cast("long").alias("a_d"), F.lit(0).cast("long").alias("b_d"))
    old = [points, pairs]
    while not points.where((F.col("excess") > LEAST) & (F.col("d") < NEVER)).isEmpty():
        arcs = inner.select(F.col("block").alias("part"), "a", "b", "there", "back", F.lit(0).alias("side"), F.lit(0).cast("long").alias("beyond"))
        for side, (mine, other) in enumerate(("ab", "ba"), 1):
            arcs = arcs.unionByName(border.select(F.col(f"{mine}_block").alias("part"), "a", "b", "there", "back", F.lit(side).alias("side"), F.col(f"{other}_d").alias("beyond")))
        moved = stage(points.groupBy("block").cogroup(arcs.groupBy("part")).applyInPandas(_discharged, _SENT), "moved")
        after = moved.where("kind = 0").select("block", F.col("a").alias("pid"), F.col("x").alias("excess"), F.col("y").alias("drain"), "d")
        inner = moved.where("kind = 1").select("block", "a", "b", F.col("x").alias("there"), F.col("y").alias("back"))
        met = border.drop("a_d", "b_d")
        for e, kind in (("a", 2), ("b", 3)):
            met = met.join(moved.where(F.col("kind") == kind).select("a", "b", F.col("x").alias(f"{e}_sent")), ["a", "b"], "left").join(after.select(F.col("pid").alias(e), F.col("d").alias(f"{e}_d")), e)
        taken = {e: F.when(F.col(f"{o}_d") <= F.col(f"{e}_d") + 1, F.coalesce(f"{e}_sent", F.lit(0.0))).otherwise(0.0) for e, o in ("ab", "ba")}
        met = met.select("a", "b", "a_block", "b_block", "a_d", "b_d", "there", "back", *[taken[e].alias(f"{e}_out") for e in "ab"], *[(F.coalesce(f"{e}_sent", F.lit(0.0)) - taken[e]).alias(f"{e}_again") for e in "ab"])
        met = stage(met, "border")
        known = {r[0] for r in met.select(F.explode(F.array("a_d", "b_d"))).distinct().collect()}  # no more than there were rounds
        gap = next(k for k in range(len(known) + 1) if k not in known)
        raised = lambda d: F.when(F.col(d) > gap, F.lit(NEVER)).otherwise(F.col(d))
        more = [met.select(F.col(e).alias("pid"), (F.col(f"{e}_again") + F.col(f"{o}_out")).alias("more")) for e, o in ("ab", "ba")]
        more = more[0].unionByName(more[1]).groupBy("pid").agg(F.sum("more").alias("more"))
        points = stage(after.join(more, "pid", "left").select("block", "pid", (F.col("excess") + F.coalesce("more", F.lit(0.0))).alias("excess"), "drain", raised("d").alias("d")), "points")
        flow = F.col("a_out") - F.col("b_out")
        border = met.select("a", "b", (F.col("there") - flow).alias("there"), (F.col("back") + flow).alias("back"), "a_block", "b_block", raised("a_d").alias("a_d"), raised("b_d").alias("b_d"))
        drop_stages(*old)
        old = [points, moved, met]
    zero = None
    starts = stage(points.where(F.col("excess") > LEAST).select("pid", "block"), "starts")
    room = stage(border.where(F.col("there") > LEAST).select(F.col("a").alias("src"), F.col("b").alias("pid"), F.col("b_block").alias("block")).unionByName(border.where(F.col("back") > LEAST).select(F.col("b").alias("src"), F.col("a").alias("pid"), F.col("a_block").alias("block"))), "room")
    none = points.select("pid").limit(0)
    while not starts.isEmpty():
        touched = starts.select("block").distinct()
        own = points.select("block", "pid").join(touched, "block", "left_semi").join(starts.select("pid", F.lit(True).alias("start")), "pid", "left")
        own = own.join((none if zero is None else zero.select("pid")).withColumn("met", F.lit(True)), "pid", "left").na.fill(False, ["start", "met"])
        found = stage(own.groupBy("block").cogroup(inner.join(touched, "block", "left_semi").groupBy("block")).applyInPandas(_reached, "pid long, block long"), "reached")
        zero = found if zero is None else zero.unionByName(found)
        starts = stage(room.join(found.select(F.col("pid").alias("src")), "src", "left_semi").select("pid", "block").distinct().join(zero.select("pid"), "pid", "left_anti"), "starts")
    if zero is None:
        return points.select("pid", F.lit(1).alias("label"))
    return points.select("pid").join(zero.select("pid", F.lit(0).alias("zero")), "pid", "left").select("pid", F.coalesce("zero", F.lit(1)).alias("label"))


def along_curve(points: DataFrame, size: float) -> DataFrame:
    """pid and curve: the place of each point's cube on a Z-shaped curve, whose stretches are compact; cubes beyond 2**20 to a side share their ends."""
    low = points.agg(*[F.min(a).alias(f"_{a}") for a in "xyz"])
    at = points.crossJoin(F.broadcast(low)).select("pid", *[F.least(F.floor((F.col(a) - F.col(f"_{a}")) / size), F.lit((1 << 20) - 1)).cast("long").alias(a) for a in "xyz"])
    bits = [F.shiftleft(F.shiftright(F.col(a), k).bitwiseAND(F.lit(1).cast("long")), 3 * k + i) for k in range(20) for i, a in enumerate("xyz")]
    code = bits[0]
    for bit in bits[1:]:
        code = code.bitwiseOR(bit)
    return at.select("pid", code.alias("curve"))


def smooth(costs: DataFrame, edges: DataFrame, strength: float, exact: int = EXACT, places: DataFrame | None = None) -> DataFrame:
    """pid and label (1 wood) of least energy, by :func:`least_energy` in blocks of ``exact`` points. ``edges`` hold each pair both ways; of several minima that with the most wood."""
    return least_energy(costs, edges.where("w > 0").select("src", "dst", (F.col("w") * strength).alias("cap")), places, exact)


def lower_bound(costs: DataFrame, edges: DataFrame, strength: float, block: int = EXACT, places: DataFrame | None = None) -> float:
    """What no labels can go below: the least energies of blocks, without the edges between them, added up."""
    order = ["pid"] if places is None else [*[c for c in places.columns if c != "pid"], "pid"]
    placed = costs.select("pid", "u0", "u1") if places is None else costs.select("pid", "u0", "u1").join(places, "pid")
    blocks = stage(numbered(placed, order, "_at").withColumn("block", F.floor(F.col("_at") / block)), "blocks")
    ends = edges.where("w > 0").join(blocks.select(F.col("pid").alias("src"), "block"), "src").join(blocks.select(F.col("pid").alias("dst"), F.col("block").alias("beyond")), "dst").where("block = beyond")
    inner = ends.select(F.col("block").alias("part"), "src", "dst", (F.col("w") * strength).alias("cap"))
    own = blocks.select("block", "pid", "u0", "u1", F.lit(0.0).alias("out"), F.lit(0.0).alias("into"))
    labels = stage(own.groupBy("block").cogroup(inner.groupBy("part")).applyInPandas(_block_labels, "pid long, label int"), "labels")
    return energy(labels, costs, inner.select("src", "dst", (F.col("cap") / strength if strength else F.lit(0.0)).alias("w")), strength)


#: Share of an even spread that two of the fidelities mix into the probabilities.
EVEN = 0.05


def class_costs(points: DataFrame, classes: list[str], mode: int = 0) -> DataFrame:
    """pid and u, the cost of each class as an array, from columns of probabilities: squared distance (0), minus p (1), cross entropy from (2) or minus logarithm of (3) the probabilities mixed with an even spread.

    The row's least cost is taken off, and all are divided by their mean over rows and classes.
    """
    n = len(classes)
    even = EVEN / n
    hit, miss = F.log(F.lit(even + 1 - EVEN)), F.log(F.lit(even))
    p = [F.col(c).cast("double") for c in classes]
    mixed = [even + (1 - EVEN) * x for x in p]
    forms = {
        0: lambda k: sum(((1.0 if j == k else 0.0) - x) * ((1.0 if j == k else 0.0) - x) for j, x in enumerate(p)),
        1: lambda k: -p[k],
        2: lambda k: -sum(m * (hit if j == k else miss) for j, m in enumerate(mixed)),
        3: lambda k: -F.log(mixed[k]),
    }
    raw = points.select("pid", F.array(*[forms[mode](k) for k in range(n)]).alias("r"))
    low = raw.select("pid", F.transform("r", lambda x: x - F.array_min("r")).alias("r"))
    mean = low.agg((F.sum(F.aggregate("r", F.lit(0.0), lambda a, b: a + b)) / (n * F.count("*"))).alias("mean"))
    return low.crossJoin(F.broadcast(mean)).select("pid", F.transform("r", lambda x: F.when(F.col("mean") > 0, x / F.col("mean")).otherwise(0.0)).alias("u"))


def class_energy(labels: DataFrame, costs: DataFrame, edges: DataFrame, strength: float, apart: list[list[float]] | None = None) -> float:
    """Costs ``u`` of the labels plus ``strength`` times weight times what two labels cost beside each other, over all pairs (``edges`` hold each both ways)."""
    own = labels.join(costs, "pid").agg(F.sum(F.get("u", F.col("label")))).first()[0] or 0.0
    a, b = labels.select(F.col("pid").alias("src"), F.col("label").alias("la")), labels.select(F.col("pid").alias("dst"), F.col("label").alias("lb"))
    pair = edges.where("src < dst").join(a, "src").join(b, "dst").agg(F.sum(F.col("w") * _beside(F.col("la"), F.col("lb"), apart))).first()[0] or 0.0
    return own + strength * pair


def _beside(a: Column, b: Column, apart: list[list[float]] | None) -> Column:
    """What label ``a`` beside label ``b`` costs: 1 for unequal ones, or the entry of the matrix."""
    if apart is None:
        return (a != b).cast("double")
    return F.get(F.get(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in apart]), a), b)


def expansion(costs: DataFrame, edges: DataFrame, strength: float = 1.0, apart: list[list[float]] | None = None, start: DataFrame | None = None, places: DataFrame | None = None, block: int = EXACT) -> DataFrame:
    """pid and label (from 0) of low energy by expansion moves: in turn each label offers itself to all points at once, and :func:`least_energy` takes the best set of those that change.

    ``costs``: pid and ``u``, the cost of each label; ``edges`` hold each pair both ways with weight ``w``; two labels side by side cost 1 if they differ, or what the matrix
    ``apart`` says (a metric: 0 for equal ones, symmetric, no way round is shorter). Begins with ``start`` (pid, label), or each point's cheapest label. Ends when no label
    lowers the energy any more; for two labels that is the least one, for more it is at most twice the least for unequal labels that cost the same.
    """
    many = len(apart) if apart is not None else (costs.select(F.size("u")).first() or [0])[0]
    cheapest = costs.select("pid", (F.array_position("u", F.array_min("u")) - 1).cast("int").alias("label"))
    labels = stage(start.select("pid", "label") if start is not None else cheapest, "labels")
    pairs = stage(edges.where((F.col("src") < F.col("dst")) & (F.col("w") > 0)).select("src", "dst", (F.col("w") * strength).alias("w")), "pairs")
    best = class_energy(labels, costs, edges, strength, apart)
    since, label = 0, 0
    while since < many:
        new = F.lit(label)
        met = pairs.join(labels.select(F.col("pid").alias("src"), F.col("label").alias("la")), "src").join(labels.select(F.col("pid").alias("dst"), F.col("label").alias("lb")), "dst")
        stay, left, right = _beside(F.col("la"), F.col("lb"), apart), _beside(new, F.col("lb"), apart), _beside(F.col("la"), new, apart)
        met = stage(met.select("src", "dst", (F.col("w") * (left - stay)).alias("first"), (-F.col("w") * left).alias("second"), (F.col("w") * (left + right - stay)).alias("cap")), "moves")
        shares = met.select(F.col("src").alias("pid"), F.col("first").alias("s")).unionByName(met.select(F.col("dst").alias("pid"), F.col("second").alias("s"))).groupBy("pid").agg(F.sum("s").alias("s"))
        two = labels.join(costs, "pid").join(shares, "pid", "left").select("pid", F.get("u", F.col("label")).alias("u0"), (F.get("u", new) + F.coalesce("s", F.lit(0.0))).alias("u1"))
        taken = least_energy(two, met.select("src", "dst", "cap"), places, block).where("label = 1").select("pid", new.alias("new"))
        after = stage(labels.join(taken, "pid", "left").select("pid", F.coalesce("new", "label").alias("label")), "labels")
        now = class_energy(after, costs, edges, strength, apart)
        if now < best - 1e-9 * max(1.0, abs(best)):
            labels, best, since = after, now, 0
        since, label = since + 1, (label + 1) % many
    return labels
