"""Scalp maps.

A thin-plate spline through electrodes is linear in their values: where the electrodes
are fixes a matrix of weights, a row for each point of the grid, and a map is that matrix
times the values.  The matrix is solved once for a set of electrodes and applied to any
number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .channels import project_2d


def grid_points(xy: np.ndarray, resolution: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``gx, gy``, their positions, and which lie over the head."""
    radius = 1.1 * np.abs(xy).max()
    axis = np.linspace(-radius, radius, resolution)
    gx, gy = (g.ravel() for g in np.meshgrid(np.arange(resolution), np.arange(resolution)))
    grid = np.column_stack([axis[gx], axis[gy]])
    return gx, gy, grid, np.hypot(*grid.T) <= radius


def map_weights(xy: np.ndarray, resolution: int) -> np.ndarray:
    """What each of the electrodes at ``xy`` adds to each point of the grid, a row a point; NaN outside the head."""
    n = len(xy)
    if n < 3:
        raise ValueError("a map needs three channels")
    if np.linalg.svd(xy - xy.mean(0), compute_uv=False)[-1] < 1e-8:
        raise ValueError("the channels lie on a line")
    a = np.zeros((n + 3, n + 3))
    a[:n, :n] = _plate(np.linalg.norm(xy[:, None] - xy[None], axis=2))
    a[:n, n:] = np.column_stack([np.ones(n), xy])
    a[n:, :n] = a[:n, n:].T
    _, _, grid, inside = grid_points(xy, resolution)
    at = np.column_stack([_plate(np.linalg.norm(grid[:, None] - xy[None], axis=2)), np.ones(len(grid)), grid])
    weights = np.linalg.solve(a, at.T)[:n].T  # the matrix is symmetric
    weights[~inside] = np.nan
    return weights


#: sets of electrodes whose weights a task remembers
KNOWN_SETS = 16


def scalp_map(values: DataFrame, montage: DataFrame, resolution: int = 100, by: str = "recording_id") -> DataFrame:
    """``by, gx, gy, x, y, value`` on a grid over the head, null outside it.

    ``values(by, channel, value)`` meet their positions (``unplaced_channels`` names those
    without one); values at one position are averaged.  Fewer than three positions, or
    positions on a line, are an error.  Maps of the same electrodes share one solved matrix
    and are products with it in Arrow batches.
    """
    placed = values.join(project_2d(montage), "channel").where("value is not null").select(by, "x2d", "y2d", "value")
    at = placed.groupBy(by, "x2d", "y2d").agg(F.avg("value").alias("value"))
    rows = at.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("x2d", "y2d", "value"))).alias("e"))
    vectors = rows.select(by, F.transform("e", lambda e: e["x2d"]).alias("x"), F.transform("e", lambda e: e["y2d"]).alias("y"), F.transform("e", lambda e: e["value"]).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            sets = [np.column_stack([x, y]) for x, y in zip(batch["x"], batch["y"], strict=True)]
            names = pd.Series([s.tobytes() for s in sets], index=batch.index)
            for name, part in batch.groupby(names):
                if name not in known:
                    if len(known) >= KNOWN_SETS:
                        known.clear()
                    xy = np.frombuffer(name).reshape(-1, 2)
                    known[name] = map_weights(xy, resolution), grid_points(xy, resolution)
                weights, (gx, gy, grid, _) = known[name]
                for low in range(0, len(part), 64):
                    some = part.iloc[low : low + 64]
                    out = np.stack(some["v"].to_list()) @ weights.T
                    n = len(some)
                    yield pd.DataFrame({by: np.repeat(some[by].to_numpy(), len(grid)), "gx": np.tile(gx, n), "gy": np.tile(gy, n), "x": np.tile(grid[:, 0], n), "y": np.tile(grid[:, 1], n), "value": out.ravel()})

    kind = placed.schema[by].dataType.simpleString()
    drawn = vectors.mapInPandas(run, f"{by} {kind}, gx int, gy int, x double, y double, value double")
    return drawn.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def _plate(r: np.ndarray) -> np.ndarray:
    return np.where(r > 0, r**2 * np.log(np.where(r > 0, r, 1)), 0.0)
