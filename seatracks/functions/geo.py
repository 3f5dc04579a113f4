"""Distances and path errors. A path is an array<struct<lat:double,lon:double>>."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_KM = 6371.0
EARTH_M = 6_371_000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    up, across = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def to_enu_m(lat: Column, lon: Column, ref_lat: Column, ref_lon: Column) -> Column:
    """struct(east_m, north_m): flat offset from the reference position."""
    north = F.radians(lat - ref_lat) * EARTH_M
    east = F.radians(lon - ref_lon) * EARTH_M * F.cos(F.radians((lat + ref_lat) / 2))
    return F.struct(east.alias("east_m"), north.alias("north_m"))


def from_enu_m(east: Column, north: Column, ref_lat: Column, ref_lon: Column) -> Column:
    """struct(lat, lon): inverse of :func:`to_enu_m`."""
    up = F.degrees(north / EARTH_M)
    scale = F.cos(F.radians(ref_lat + up / 2))
    across = F.degrees(east / (EARTH_M * F.when(scale == 0, F.lit(1e-9)).otherwise(scale)))
    return F.struct((ref_lat + up).alias("lat"), (ref_lon + across).alias("lon"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def step_distances(pred: Column, true: Column) -> Column:
    """Array of distances over the common length of two paths."""
    n = F.least(F.size(pred), F.size(true))
    return F.zip_with(F.slice(pred, 1, n), F.slice(true, 1, n), lambda p, t: haversine_km(t["lat"], t["lon"], p["lat"], p["lon"]))


def _mean(xs: Column) -> Column:
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs).cast("double"))


def path_ade_km(distances: Column) -> Column:
    """Mean distance (also the mean absolute error); null without steps."""
    return _mean(distances)


def path_mse_km2(distances: Column) -> Column:
    return _mean(F.transform(distances, lambda d: d * d))


def path_fde_km(distances: Column) -> Column:
    """Distance at the last common step."""
    return F.get(distances, F.size(distances) - 1)


def path_diagonal_km(distances: Column) -> Column:
    """Sum of pointwise distances: an upper bound of DTW for paths of one length."""
    return F.when(F.size(distances) > 0, F.aggregate(distances, F.lit(0.0), lambda s, x: s + x))


def dtw_batch(pred: list[np.ndarray], true: list[np.ndarray], most_cells: int = 4_000_000) -> np.ndarray:
    """DTW with great-circle cost of many pairs of (lat, lon) paths, those of one shape together.

    A row of the recurrence is ``S + running minimum of (min(above, above-left) - S shifted)`` with S the running
    sum of the row's costs, so no cell needs a Python step.
    """
    out = np.full(len(pred), np.nan)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (p, t) in enumerate(zip(pred, true)):
        if p is not None and t is not None and len(p) and len(t):
            shapes.setdefault((len(p), len(t)), []).append(i)
    for (n, m), own in shapes.items():
        step = max(1, most_cells // (n * m))
        for k in range(0, len(own), step):
            at = own[k : k + step]
            a, b = np.radians(np.stack([pred[i] for i in at])), np.radians(np.stack([true[i] for i in at]))
            up = np.sin((a[:, :, None, 0] - b[:, None, :, 0]) / 2) ** 2
            across = np.sin((a[:, :, None, 1] - b[:, None, :, 1]) / 2) ** 2
            cost = 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(up + np.cos(a[:, :, None, 0]) * np.cos(b[:, None, :, 0]) * across, 0, 1)))
            row = np.cumsum(cost[:, 0], axis=1)
            for i in range(1, n):
                total = np.cumsum(cost[:, i], axis=1)
                shifted = np.concatenate([np.zeros((len(at), 1)), total[:, :-1]], axis=1)
                best = row.copy()
                best[:, 1:] = np.minimum(row[:, 1:], row[:, :-1])
                row = total + np.minimum.accumulate(best - shifted, axis=1)
            out[at] = row[:, -1]
    return out


@F.pandas_udf(DoubleType())
def dtw_km(pred_lat: pd.Series, pred_lon: pd.Series, true_lat: pd.Series, true_lon: pd.Series) -> pd.Series:
    """DTW of two paths given as coordinate arrays; null for an empty or null path."""
    path = lambda lat, lon: [None if x is None else np.column_stack([x, y]) for x, y in zip(lat, lon)]
    return pd.Series(dtw_batch(path(pred_lat, pred_lon), path(true_lat, true_lon))).astype("Float64")


def path_dtw_km(pred: Column, true: Column) -> Column:
    return dtw_km(pred["lat"], pred["lon"], true["lat"], true["lon"])
