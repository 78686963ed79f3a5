"""Picker sessions: ordered gestures move a camera; batch and streaming forms, and
roll-ups of frames over event time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo

OUT = "session long, event_id long, zoom int, lat double, lon double, moved boolean"
STATE = "zoom int, lat double, lon double, moved boolean"


@dataclass(frozen=True)
class Picker:
    """A screen, the zooms that it may show, and where it opens."""

    width: int = 1280
    height: int = 720
    ts: int = 256
    low: int = 2
    high: int = 15
    lat: float = 0.0
    lon: float = 0.0

    def start(self) -> tuple[int, float, float, bool]:
        return self.low, self.lat, self.lon, False

    def step(self, state: tuple[int, float, float, bool], kind: str, a: float, b: float) -> tuple[int, float, float, bool]:
        """Zoom, centre and whether it was moved, after one gesture.

        ``drag``: the map goes with the finger by a, b pixels, the camera the other
        way. ``recenter``: the place under the pixel a, b becomes the centre.
        ``zoom_in``, ``zoom_out``: one level within the limits; the centre, which is
        the choice, stays. ``reset``: as opened. Others, and numbers that aren't
        finite, change nothing."""
        zoom, lat, lon, moved = state
        if kind in ("zoom_in", "zoom_out"):
            return min(max(zoom + (1 if kind == "zoom_in" else -1), self.low), self.high), lat, lon, moved
        if kind == "reset":
            return self.start()
        if kind not in ("drag", "recenter") or not (math.isfinite(a) and math.isfinite(b)):
            return state
        dx, dy = (-a, -b) if kind == "drag" else (a - self.width * 0.5, b - self.height * 0.5)
        n = float(1 << zoom)
        x = (lon + 180.0) / 360.0 * n + dx / self.ts
        y = (1.0 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2.0 * n + dy / self.ts
        y = min(max(y, 0.0), n)
        lat = math.degrees(math.atan(math.sinh(math.pi * (1.0 - 2.0 * y / n))))
        return zoom, min(max(lat, -geo.MAX_LAT), geo.MAX_LAT), (x / n * 360.0) % 360.0 - 180.0, True


def replay(pdf: pd.DataFrame, picker: Picker, start: tuple[int, float, float, bool] | None = None) -> tuple[pd.DataFrame, tuple[int, float, float, bool]]:
    state, rows = start or picker.start(), []
    pdf = pdf.sort_values(["ts", "event_id"])
    for session, event, kind, a, b in zip(pdf.session.tolist(), pdf.event_id.tolist(), pdf.kind.tolist(), pdf.a.tolist(), pdf.b.tolist()):
        state = picker.step(state, kind, a, b)
        rows.append((session, event, *state))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")]), state


def sessions(gestures: DataFrame, picker: Picker = Picker()) -> DataFrame:
    """Batch form: session, ts, event_id, kind, a, b to the camera after each. The
    fold of a session is one task's work; sessions are independent."""
    return gestures.groupBy("session").applyInPandas(lambda pdf: replay(pdf, picker)[0], OUT)


def stream_sessions(gestures: DataFrame, picker: Picker = Picker()) -> DataFrame:
    """Streaming form: the camera of each session is state without expiry. Events
    of a batch are replayed in order; later batches go on from the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, end = replay(pd.concat(list(batches)), picker, tuple(state.get) if state.exists else None)
        state.update(end)
        yield rows

    return gestures.groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_rollup(frames: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Frames per window and scenario over event time; late rows go after ``delay``."""
    return frames.withWatermark("ts", delay).groupBy(F.window("ts", width), "scenario").agg(F.count("*").alias("frames"), F.sum("frame_ms").alias("total_ms"), F.min("frame_ms").alias("min_ms"), F.max("frame_ms").alias("max_ms"))
