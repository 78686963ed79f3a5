"""Web-Mercator tile arithmetic as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The latitude at which the square world ends, the deepest zoom.
MAX_LAT = 85.05112878
MAX_ZOOM = 31


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def clamp_lat(lat: Column) -> Column:
    return clamp(lat, F.lit(-MAX_LAT), F.lit(MAX_LAT))


def tiles_per_axis(zoom: Column) -> Column:
    """2**zoom; 0 for a zoom that doesn't exist."""
    return F.when(zoom.between(0, MAX_ZOOM), F.expr("1L") * F.pow(F.lit(2.0), zoom).cast("long")).otherwise(F.lit(0).cast("long"))


def asinh(t: Column) -> Column:
    # the built-in loses all digits for large negative arguments
    return F.signum(t) * F.asinh(F.abs(t))


def tile_x(lon: Column, n: Column) -> Column:
    return (wrap_lon(lon) + 180.0) / 360.0 * n


def tile_y(lat: Column, n: Column) -> Column:
    return (1.0 - asinh(F.tan(F.radians(clamp_lat(lat)))) / math.pi) / 2.0 * n


def lon_of(x: Column, n: Column) -> Column:
    return F.pmod(x, n.cast("double")) / n * 360.0 - 180.0


def lat_of(y: Column, n: Column) -> Column:
    inside = clamp(y, F.lit(0.0), n.cast("double"))
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * (inside / n)))))


def tile_index(x: Column, n: Column) -> Column:
    """Whole tile of a fractional coordinate, inside the world."""
    return clamp(F.floor(x).cast("double"), F.lit(0.0), n - 1.0).cast("long")


def tiles_before(zoom: Column) -> Column:
    """Tiles of all levels above ``zoom``: (4**zoom - 1) / 3."""
    return ((F.pow(F.lit(4.0), zoom).cast("decimal(20,0)") - 1) / 3).cast("long")


def hilbert(zoom: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place of a tile on the Hilbert curve of its level, for whole arrays.

    Bits are taken from the top; the frame of the rest is a swap of the axes
    and a flip of both, kept as one bit each."""
    place = np.zeros(len(x), np.int64)
    swap, flip = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for bit in range(int(zoom.max(initial=0)) - 1, -1, -1):
        on = zoom > bit
        bx, by = (x >> bit & 1).astype(bool), (y >> bit & 1).astype(bool)
        rx, ry = np.where(swap, by, bx) ^ flip, np.where(swap, bx, by) ^ flip
        digit = np.where(rx, np.where(ry, 2, 3), ry.astype(int))
        place = np.where(on, place * 4 + digit, place)
        flip ^= on & rx & ~ry
        swap ^= on & ~ry
    return place


def tile_ids(zoom: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (4 ** zoom.astype(object) - 1).astype(object) // 3 + hilbert(zoom, x, y)


def _tile_id(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    zoom = z.to_numpy(np.int64)
    before = np.array([(4**i - 1) // 3 for i in range(MAX_ZOOM + 1)], np.int64)
    return pd.Series(before[zoom] + hilbert(zoom, x.to_numpy(np.int64), y.to_numpy(np.int64)))


def tile_id(zoom: Column, x: Column, y: Column) -> Column:
    """Identifier of a tile: levels one after another, each along its curve."""
    return F.pandas_udf(_tile_id, "long")(zoom, x, y)


def readable(offset: Column, length: Column, size: Column) -> Column:
    """Bytes that a request may read: never past the end, 0 for none. The sum of
    offset and length is not formed."""
    return F.when((length <= 0) | (offset < 0) | (offset >= size), F.lit(0).cast("long")).otherwise(F.least(length, size - offset))
