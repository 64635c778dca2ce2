"""Trips from a stream of positions: a pause longer than the gap ends a trip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import RADIUS_KM

TRIP = "uid long, tid long, n_points long, t0 double, t1 double, length_km double"
STATE = "ts array<double>, lons array<double>, lats array<double>, tid long, n long, t0 double, t1 double, lon double, lat double, km double"


def _km(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    lon1, lat1, lon2, lat2 = np.radians([lon1, lat1, lon2, lat2])
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return float(2 * RADIUS_KM * np.arcsin(np.sqrt(min(a, 1.0))))


def trips(points: DataFrame, gap_s: float, late: str = "10 minutes") -> DataFrame:
    """Closed trips of more than one point, of rows (uid, ts timestamp, lon, lat).

    Points wait in the state until the watermark has passed them, so those that come late but within the
    allowance are put in order; later ones are dropped. The state of a user is the open trip's sums and the
    points of the allowance, so it doesn't grow with the trip. A trip is given out once no point can extend it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, lons, lats, tid, n, t0, t1, lon, lat, km = state.get if state.exists else ([], [], [], 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
        mark = state.getCurrentWatermarkMs() / 1000
        wait = list(zip(ts, lons, lats, strict=True))
        if not state.hasTimedOut:
            for pdf in batches:
                wait += [p for p in pdf[["t", "lon", "lat"]].itertuples(index=False, name=None) if p[0] >= mark]
        wait.sort()
        done = []
        settled = [p for p in wait if p[0] < mark]
        wait = wait[len(settled) :]
        for t, x, y in settled:
            if n and t - t1 > gap_s:
                if n > 1:
                    done.append((key[0], tid, n, t0, t1, km))
                tid, n = tid + 1, 0
            t0, km = (t0, km + _km(lon, lat, x, y)) if n else (t, 0.0)
            n, t1, lon, lat = n + 1, t, x, y
        if n and mark - t1 > gap_s:
            if n > 1:
                done.append((key[0], tid, n, t0, t1, km))
            tid, n = tid + 1, 0
        # The number of the next trip is kept, so a user who comes back goes on counting.
        state.update(([p[0] for p in wait], [p[1] for p in wait], [p[2] for p in wait], tid, n, t0, t1, lon, lat, km))
        due = [p[0] for p in wait[:1]] + ([t1 + gap_s] if n else [])
        if due:
            state.setTimeoutTimestamp(int(max(min(due), mark) * 1000) + 1)
        yield pd.DataFrame(done, columns=["uid", "tid", "n_points", "t0", "t1", "length_km"])

    rows = points.withWatermark("ts", late).select("uid", "ts", F.col("ts").cast("double").alias("t"), "lon", "lat")
    return rows.groupBy("uid").applyInPandasWithState(step, TRIP, STATE, "append", GroupStateTimeout.EventTimeTimeout)
