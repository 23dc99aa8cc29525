"""A model over tiles: loaded once a Python worker, called with several whole tiles at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Predictor = Callable[[pd.DataFrame], pd.DataFrame]
TILE = ["box_x", "box_y", "box_z"]

#: The model of this Python worker under the name of its plan; one at a time, as a model may be large.
_LOADED: dict[str, Predictor] = {}


def _model(name: str, load: Callable[[], Predictor]) -> Predictor:
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = load()
    return _LOADED[name]


def infer(tiled: DataFrame, load: Callable[[], Predictor], classes: list[str], batch: int = 10) -> DataFrame:
    """box_x, box_y, box_z, pid, x, y, z and ``classes`` of the rows of :func:`voxel.sample_tiles`.

    ``load`` is called in the worker and gives the predictor; later tasks of that worker find it loaded. The predictor gets x, y, z around the tile's middle and
    ``tile``, the tile's place in the batch, of ``batch`` whole tiles (fewer at a partition's end), in the order of pid within a tile, and returns a row of ``classes``
    for each. A task holds the rows of one batch and of the tile after it.
    """
    name = uuid.uuid4().hex

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        local = rows[["x", "y", "z"]] - rows[["local_x", "local_y", "local_z"]].to_numpy()
        local["tile"] = rows.groupby(TILE, sort=False).ngroup()
        return pd.concat([rows[[*TILE, "pid", "x", "y", "z"]], _model(name, load)(local)[classes].reset_index(drop=True)], axis=1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in parts:
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            begins = held[TILE].ne(held[TILE].shift()).any(axis=1).to_numpy().nonzero()[0]
            while len(begins) > batch:  # the batch is whole, as another tile has begun
                end = begins[batch]
                yield scored(held.iloc[:end])
                held, begins = held.iloc[end:].reset_index(drop=True), begins[batch:] - end
        if held is not None and len(held):
            yield scored(held)

    whole = tiled.select(*TILE, "pid", "x", "y", "z", "local_x", "local_y", "local_z").repartition(*TILE).sortWithinPartitions(*TILE, "pid")
    schema = ", ".join([f"{t} long" for t in TILE] + ["pid long"] + [f"{c} double" for c in ("x", "y", "z", *classes)])
    return whole.mapInPandas(run, schema)
