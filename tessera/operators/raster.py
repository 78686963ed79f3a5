"""Drawing features: shapes to pixel spans, painter's compositing, images.

A shape is a row of frame, ordinal (its place in the paint order), shape (point,
rect, stroke or fill), rgb, px (stroke width in pixels) and paths of screen
points. Spans are inclusive runs of one pixel row inside the frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.geometry import clip_segment

Points = list[tuple[int, int]]


def _inside(spans: np.ndarray, width: int, height: int) -> np.ndarray:
    """Spans (y, first, last) cut to the frame; what is left of none goes."""
    spans = np.column_stack([spans[:, 0], np.maximum(spans[:, 1], 0), np.minimum(spans[:, 2], width - 1)])
    return spans[(spans[:, 0] >= 0) & (spans[:, 0] < height) & (spans[:, 1] <= spans[:, 2])]


def fill_spans(rings: list[Points], width: int, height: int) -> np.ndarray:
    """Even-odd fill. An edge crosses the rows from its upper end up to, without,
    its lower one, at an x cut toward its first end; both ends of a span count."""
    ys, xs = [], []
    for ring in rings:
        if len(ring) < 3:
            continue
        a = np.array(ring, np.int64)
        for (x0, y0), (x1, y1) in zip(a, np.roll(a, -1, axis=0)):
            rows = np.arange(max(min(y0, y1), 0), min(max(y0, y1), height), dtype=np.int64)
            if len(rows):
                over = (rows - y0) * (x1 - x0)
                ys.append(rows)
                xs.append(x0 + np.sign(over) * np.sign(y1 - y0) * (np.abs(over) // abs(y1 - y0)))
    if not ys:
        return np.empty((0, 3), np.int64)
    y, x = np.concatenate(ys), np.concatenate(xs)
    order = np.lexsort((x, y))  # closed rings cross each row an even number of times
    y, x = y[order].reshape(-1, 2), x[order].reshape(-1, 2)
    return _inside(np.column_stack([y[:, 0], x]), width, height)


def line_pixels(x0: int, y0: int, x1: int, y1: int) -> Points:
    """Bresenham's line, ends included."""
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    step_x, step_y = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    error, out = dx + dy, [(x0, y0)]
    while (x0, y0) != (x1, y1):
        twice = 2 * error
        if twice >= dy:
            error, x0 = error + dy, x0 + step_x
        if twice <= dx:
            error, y0 = error + dx, y0 + step_y
        out.append((x0, y0))
    return out


def stroke_spans(x0: int, y0: int, x1: int, y1: int, px: int, width: int, height: int) -> np.ndarray:
    """A square brush of ``px`` pixels along a line, one span per row: the pixels
    of the line in neighbouring rows touch, so what the brush covers has no gap."""
    none = np.empty((0, 3), np.int64)
    left = px // 2
    cut = clip_segment(x0, y0, x1, y1, -left, -left, width - 1 + left, height - 1 + left) if px > 0 and width > 0 and height > 0 else None
    if cut is None:
        return none
    line = np.array(line_pixels(*cut), np.int64)
    top = line[:, 1].min()
    n = line[:, 1].max() - top + 1
    first, last = np.full(n + px - 1, np.iinfo(np.int64).max), np.full(n + px - 1, np.iinfo(np.int64).min)
    for i in range(px):
        np.minimum.at(first, line[:, 1] - top + i, line[:, 0])
        np.maximum.at(last, line[:, 1] - top + i, line[:, 0])
    return _inside(np.column_stack([np.arange(n + px - 1) + top - left, first - left, last - left + px - 1]), width, height)


def shape_spans(shape: str, px: int, paths: list[Points], width: int, height: int) -> np.ndarray:
    """Spans of one shape. A rect's first path has its corner and its size; a
    shape of another kind draws nothing."""
    parts = [np.empty((0, 3), np.int64)]
    if shape == "fill":
        parts.append(fill_spans(paths, width, height))
    elif shape == "point":
        parts += [_inside(np.array([[y, x, x]]), width, height) for p in paths for x, y in p]
    elif shape == "stroke":
        parts += [stroke_spans(*a, *b, px, width, height) for p in paths for a, b in zip(p, p[1:])]
    elif shape == "rect" and paths and len(paths[0]) == 2 and min(paths[0][1]) > 0:
        (x, y), (w, h) = paths[0]
        rows = np.arange(max(y, 0), min(y + h, height))
        parts.append(_inside(np.column_stack([rows, np.full(len(rows), x), np.full(len(rows), x + w - 1)]), width, height))
    return np.concatenate(parts)


def spans(shapes: DataFrame, width: int, height: int, band_height: int | None = None) -> DataFrame:
    """frame, ordinal, rgb, y, x0, x1 of all shapes. Null paths draw nothing. With
    ``band_height``, shapes have a column band and draw the rows of it only."""
    names = ["frame", "ordinal", "rgb", "y", "x0", "x1"]

    def run(batches):
        for batch in batches:
            for frame, ordinal, rgb, shape, px, paths, band in zip(*(batch.column(i).to_pylist() for i in range(7))):
                got = shape_spans(shape, px or 0, [[(p["x"], p["y"]) for p in path] for path in paths or []], width, height)
                if band_height is not None:
                    got = got[got[:, 0] // band_height == band]
                if n := len(got):
                    yield pa.RecordBatch.from_arrays([pa.array([frame] * n, pa.int64()), pa.array([ordinal] * n, pa.int64()), pa.array([rgb] * n, pa.int32()), *(pa.array(got[:, i].astype(np.int32)) for i in range(3))], names)

    band = F.lit(None) if band_height is None else F.col("band")
    rows = shapes.select(F.col("frame").cast("long"), F.col("ordinal").cast("long"), F.col("rgb").cast("int"), "shape", "px", "paths", band.cast("long").alias("band"))
    return rows.mapInArrow(run, "frame long, ordinal long, rgb int, y int, x0 int, x1 int")


def composite(drawn: DataFrame) -> DataFrame:
    """frame, y, x, rgb: the colour of the last shape on each pixel. Rows of the
    frame are the unit of work: what is shuffled are spans, not pixels, and a task
    paints one row at a time."""

    def run(batches):
        key, rows = None, []

        def done():
            ordinal, x0, x1, rgb = (np.array(v) for v in zip(*sorted(rows)))
            left = x0.min()
            line = np.full(x1.max() - left + 1, -1, np.int64)
            for a, b, v in zip(x0 - left, x1 - left, rgb):
                line[a : b + 1] = v
            at = np.flatnonzero(line >= 0)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key[0]), pa.int64()), pa.array(np.full(len(at), key[1], np.int32)), pa.array((at + left).astype(np.int32)), pa.array(line[at].astype(np.int32))], ["frame", "y", "x", "rgb"])

        for batch in batches:
            for frame, y, ordinal, x0, x1, rgb in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (frame, y) != key:
                    if rows:
                        yield done()
                    key, rows = (frame, y), []
                rows.append((ordinal, x0, x1, rgb))
        if rows:
            yield done()

    lines = drawn.select("frame", "y", "ordinal", "x0", "x1", "rgb").repartition("frame", "y").sortWithinPartitions("frame", "y")
    return lines.mapInArrow(run, "frame long, y int, x int, rgb int")


def images(pixels: DataFrame, width: int, height: int, background: int = 0) -> DataFrame:
    """frame, image: each frame as a binary PPM; its size bounds a task's rows."""

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.full((height, width), background, np.int64)
        flat[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf.rgb
        rgb = np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], axis=-1).astype(np.uint8)
        return pd.DataFrame({"frame": pdf.frame[:1], "image": [b"P6\n%d %d\n255\n" % (width, height) + rgb.tobytes()]})

    return pixels.groupBy("frame").applyInPandas(paint, "frame long, image binary")
