"""Rings, lines and areas of features over arrays of points."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def area2(points: Column) -> Column:
    """Twice the signed area of a ring of integer points (shoelace), as long."""
    n = F.size(points)
    rolled = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, rolled, lambda p, q: p["x"].cast("long") * q["y"] - q["x"].cast("long") * p["y"])
    return F.aggregate(cross, F.lit(0).cast("long"), lambda s, v: s + v)


def segments(points: Column) -> Column:
    """Pairs of neighbouring points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def ring_parts(rings: DataFrame) -> DataFrame:
    """Number the polygon part of each ring (feature_id, ring, area2, n_points).

    Rings of fewer than 3 points go. The sign of a feature's first ring with an
    area is that of outer rings; each ring with that sign begins a part, others
    are holes of the part before; leading rings without area make a part."""
    order = Window.partitionBy("feature_id").orderBy("ring")
    rows = rings.filter("n_points >= 3").withColumn("sign", F.signum("area2").cast("int"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("outer", F.first(F.when(c("sign") != 0, c("sign")), ignorenulls=True).over(whole))
    starts = F.when((F.row_number().over(order) == 1) | (c("sign") == c("outer")), 1).otherwise(0)
    return rows.withColumn("starts", starts).withColumn("part", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("sign", "outer", "starts")


def clip_segment(x0: int, y0: int, x1: int, y1: int, left: int, top: int, right: int, bottom: int) -> tuple[int, int, int, int] | None:
    """The part of a segment inside an inclusive rectangle, exact, ends rounded
    half up; None if there is none."""
    enter, leave = Fraction(0), Fraction(1)
    dx, dy = x1 - x0, y1 - y0
    for p, q in ((-dx, x0 - left), (dx, right - x0), (-dy, y0 - top), (dy, bottom - y0)):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            enter = max(enter, Fraction(q, p))
        else:
            leave = min(leave, Fraction(q, p))
    if enter > leave:
        return None
    at = lambda a, d, t: int((a + d * t + Fraction(1, 2)).__floor__())
    return at(x0, dx, enter), at(y0, dy, enter), at(x0, dx, leave), at(y0, dy, leave)


#: ends within this distance are clipped in 64-bit integers, all products fit
NEAR = 1 << 20


def clip_arrays(x0, y0, x1, y1, left: int, top: int, right: int, bottom: int):
    """``clip_segment`` of int64 arrays whose numbers are at most NEAR: which are
    left, and their four ends. Places along a segment are fractions that are
    compared crosswise, so nothing is rounded before the end."""
    dx, dy = x1 - x0, y1 - y0
    one, zero = np.ones(len(x0), np.int64), np.zeros(len(x0), np.int64)
    enter, leave = (zero, one), (one, one)
    keep = np.ones(len(x0), bool)
    for p, q in ((-dx, x0 - left), (dx, right - x0), (-dy, y0 - top), (dy, bottom - y0)):
        keep &= (p != 0) | (q >= 0)
        later = (p < 0) & (-q * enter[1] > enter[0] * -p)
        enter = np.where(later, -q, enter[0]), np.where(later, -p, enter[1])
        sooner = (p > 0) & (q * leave[1] < leave[0] * p)
        leave = np.where(sooner, q, leave[0]), np.where(sooner, p, leave[1])
    keep &= enter[0] * leave[1] <= leave[0] * enter[1]
    at = lambda a, d, t: (2 * t[1] * a + 2 * d * t[0] + t[1]) // (2 * t[1])
    return keep, at(x0, dx, enter), at(y0, dy, enter), at(x0, dx, leave), at(y0, dy, leave)


def clip_segments(rows: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Clip x0 y0 x1 y1 of each row; rows outside go, as do those with a null end."""
    near_frame = max(map(abs, (left, top, right, bottom))) <= NEAR
    ends = ["x0", "y0", "x1", "y1"]

    def run(batches):
        for pdf in batches:
            pdf = pdf.dropna(subset=ends)
            values = pdf[ends].to_numpy(np.int64)
            near = (np.abs(values).max(axis=1, initial=0) <= NEAR) & near_frame
            out, keep = values.copy(), np.zeros(len(values), bool)
            held, *got = clip_arrays(*values[near].T, left, top, right, bottom)
            keep[near], out[near] = held, np.column_stack(got)
            for i in np.flatnonzero(~near):  # beyond 64 bits
                if clipped := clip_segment(*values[i].tolist(), left, top, right, bottom):
                    keep[i], out[i] = True, clipped
            left_over = pdf[keep].copy()
            left_over[ends] = out[keep]
            yield left_over

    return rows.mapInPandas(run, rows.schema)


def bands(rows: DataFrame, frame_height: int, band_height: int) -> DataFrame:
    """A row of each shape (y0, y1 inclusive) for every horizontal band of the
    frame that it touches, so bands can be drawn by different tasks. Shapes
    outside the frame, or with null bounds, are in no band."""
    seen = rows.filter((F.col("y1") >= 0) & (F.col("y0") < frame_height) & (F.col("y0") <= F.col("y1")))
    first, last = F.greatest("y0", F.lit(0)), F.least("y1", F.lit(frame_height - 1))
    size = F.lit(band_height)
    return seen.withColumn("band", F.explode(F.sequence(F.floor(first / size), F.floor(last / size))))
