"""Great-circle geometry of numpy arrays, for the operators that run in Arrow batches. Points are (lon, lat) or (lon, lat, t)."""

from __future__ import annotations

import numpy as np

from .geo import RADIUS_M


def metres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by the mean-latitude form; the arguments broadcast."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    dlat = np.radians(b[..., 1] - a[..., 1]) / 2
    dlon = np.radians(b[..., 0] - a[..., 0]) / 2
    mean = np.radians(a[..., 1] + b[..., 1]) / 2
    f = np.sin(dlat) ** 2 * np.cos(dlon) ** 2 + np.sin(dlon) ** 2 * np.cos(mean) ** 2
    return 2 * RADIUS_M * np.arcsin(np.sqrt(np.minimum(f, 1.0)))


def pairwise(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """The matrix of distances between rows; ``metric`` is euclidean, squared or spherical."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if metric == "spherical":
        return metres(x[:, None, :], y[None, :, :])
    d = ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1)
    return d if metric == "squared" else np.sqrt(d)


def project(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The points of the segments a-b (n, 3) nearest to p (one, or one each) in the plane, with time by distance gone; p where a segment has no length."""
    d = b[:, :2] - a[:, :2]
    size = (d**2).sum(1)
    u = ((p[..., :2] - a[:, :2]) * d).sum(1) / np.where(size > 0, size, 1)
    at = a[:, :2] + np.clip(u, 0, 1)[:, None] * d
    whole, gone = metres(a, b), metres(a, at)
    t = a[:, 2] + (b[:, 2] - a[:, 2]) * np.where(whole > 0, gone / np.where(whole > 0, whole, 1), 0)
    out = np.column_stack([at, np.where(u < 0, a[:, 2], np.where(u > 1, b[:, 2], t))])
    return np.where((size == 0)[:, None], p, out)
