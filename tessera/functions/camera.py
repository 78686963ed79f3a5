"""Cameras as rows: expressions over columns ``lat lon zoom width height ts``
(centre, zoom, size in pixels, pixels per tile)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo

c = F.col


def world() -> Column:
    return geo.tiles_per_axis(c("zoom"))


def valid() -> Column:
    return c("zoom").between(0, geo.MAX_ZOOM) & (c("width") > 0) & (c("height") > 0) & (c("ts") > 0) & c("lat").isNotNull() & c("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")


def centre_x() -> Column:
    return geo.tile_x(c("lon"), world())


def centre_y() -> Column:
    return geo.tile_y(c("lat"), world())


def screen_to_lon(sx: Column) -> Column:
    return geo.lon_of(centre_x() + (sx - c("width") * 0.5) / c("ts"), world())


def screen_to_lat(sy: Column) -> Column:
    return geo.lat_of(centre_y() + (sy - c("height") * 0.5) / c("ts"), world())


def wrapped_delta(x: Column, centre: Column, n: Column) -> Column:
    """Signed distance to the nearest world copy, in [-n/2, n/2)."""
    d = x - centre
    return d - n * F.floor((d + n * 0.5) / n)


def project_x(lon: Column) -> Column:
    return c("width") * 0.5 + wrapped_delta(geo.tile_x(lon, world()), centre_x(), world()) * c("ts")


def project_y(lat: Column) -> Column:
    return c("height") * 0.5 + (geo.tile_y(lat, world()) - centre_y()) * c("ts")


def pan(dx: Column, dy: Column) -> tuple[Column, Column]:
    """New centre (lat, lon) after the view moved by pixels east and south."""
    lat, lon = screen_to_lat(c("height") * 0.5 + dy), screen_to_lon(c("width") * 0.5 + dx)
    return geo.clamp_lat(lat), geo.wrap_lon(lon)


def visible_bounds() -> dict[str, Column]:
    wide = c("width") >= world() * c("ts")
    zero = F.lit(0.0)
    return {
        "min_lon": F.when(wide, -180.0).otherwise(screen_to_lon(zero)),
        "min_lat": screen_to_lat(c("height").cast("double")),
        "max_lon": F.when(wide, 180.0).otherwise(screen_to_lon(c("width").cast("double"))),
        "max_lat": screen_to_lat(zero),
    }


def zoom_at(sx: Column, sy: Column, delta: Column) -> tuple[Column, Column, Column]:
    """(zoom, lat, lon) after zooming so that the place under a pixel stays."""
    to = geo.clamp(c("zoom") + delta, F.lit(0), F.lit(geo.MAX_ZOOM))
    n = geo.tiles_per_axis(to)
    x = geo.tile_x(screen_to_lon(sx), n) - (sx - c("width") * 0.5) / c("ts")
    y = geo.tile_y(screen_to_lat(sy), n) - (sy - c("height") * 0.5) / c("ts")
    return to, geo.clamp_lat(geo.lat_of(y, n)), geo.wrap_lon(geo.lon_of(x, n))


def lon_span() -> Column:
    d = c("max_lon") - c("min_lon")
    return F.when((c("min_lon") == -180.0) & (c("max_lon") == 180.0), 360.0).otherwise(F.when(d < 0, d + 360.0).otherwise(d))


def y_span() -> Column:
    one = F.lit(1)
    return geo.tile_y(c("min_lat"), one) - geo.tile_y(c("max_lat"), one)


def valid_bounds() -> Column:
    """Finite, on the square world; the western edge may lie east of the eastern."""
    edges = [c(x) for x in ("min_lon", "min_lat", "max_lon", "max_lat")]
    ok = F.lit(True)
    for e in edges:
        ok = ok & e.isNotNull() & ~F.isnan(e)
    lon = c("min_lon").between(-180.0, 180.0) & c("max_lon").between(-180.0, 180.0)
    lat = c("min_lat").between(-geo.MAX_LAT, geo.MAX_LAT) & c("max_lat").between(-geo.MAX_LAT, geo.MAX_LAT)
    return ok & lon & lat & (c("min_lat") <= c("max_lat"))


def _zooms(test) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(geo.MAX_ZOOM)), test)


def fit_zoom(padding: int = 0) -> Column:
    """Deepest zoom at which the bounds fit on the screen, else 0; null if the
    padding leaves no screen."""
    w, h = c("width") - 2 * padding, c("height") - 2 * padding
    scale = lambda z: F.pow(F.lit(2.0), z) * c("ts")
    best = F.array_max(_zooms(lambda z: (lon_span() / 360.0 * scale(z) <= w) & (y_span() * scale(z) <= h)))
    return F.when((w > 0) & (h > 0), F.coalesce(best, F.lit(0)))


def min_fill_zoom() -> Column:
    """Least zoom at which the bounds cover the screen; null if none does."""
    scale = lambda z: F.pow(F.lit(2.0), z) * c("ts")
    return F.array_min(_zooms(lambda z: ((lon_span() >= 360.0) | (c("width") <= lon_span() / 360.0 * scale(z))) & (c("height") <= y_span() * scale(z))))


def world_view_zoom() -> Column:
    """Least zoom at which the world is as high as the screen."""
    return F.array_min(_zooms(lambda z: c("height") <= F.pow(F.lit(2.0), z) * c("ts")))


def bounds_centre() -> tuple[Column, Column]:
    """Projected middle of the bounds: (lat, lon)."""
    one = F.lit(1)
    y = (geo.tile_y(c("max_lat"), one) + geo.tile_y(c("min_lat"), one)) * 0.5
    return geo.lat_of(y, one), geo.wrap_lon(c("min_lon") + lon_span() * 0.5)


def frame_transform(old: tuple[Column, Column, Column, Column], new: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Scale and shift that show the picture of camera ``old`` in ``new``; each is
    (lat, lon, zoom, ts); the screen keeps its size."""
    (lat0, lon0, z0, ts0), (lat1, lon1, z1, ts1) = old, new
    n = geo.tiles_per_axis(z1)
    scale = F.pow(F.lit(2.0), z1 - z0) * ts1 / ts0
    dx = wrapped_delta(geo.tile_x(lon0, n), geo.tile_x(lon1, n), n) * ts1
    return scale, dx, (geo.tile_y(lat0, n) - geo.tile_y(lat1, n)) * ts1


# -- tiles of a view -----------------------------------------------------------


def _ranges(views: DataFrame) -> DataFrame:
    half_w, half_h = c("width") * 0.5 / c("ts"), c("height") * 0.5 / c("ts")
    rows = views.filter(valid()).withColumn("n", world()).withColumn("cx", centre_x()).withColumn("cy", centre_y())
    rows = rows.withColumns({
        "x0": F.floor(c("cx") - half_w), "x1": F.ceil(c("cx") + half_w) - 1,
        "y0": F.greatest(F.floor(c("cy") - half_h), F.lit(0)), "y1": F.least(F.ceil(c("cy") + half_h) - 1, c("n") - 1),
    })
    return rows.filter("x1 >= x0 and y1 >= y0")


def tile_placements(views: DataFrame) -> DataFrame:
    """A row for each tile copy on screen: columns of ``views``, ordinal (from
    the top, then from the left), x, y, unwrapped_x, tile counts per axis n."""
    rows = _ranges(views).withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("unwrapped_x", F.explode(F.sequence("x0", "x1")))
    rows = rows.withColumn("ordinal", (c("y") - c("y0")) * (c("x1") - c("x0") + 1) + c("unwrapped_x") - c("x0"))
    return rows.withColumn("x", F.pmod("unwrapped_x", "n")).drop("x0", "x1", "y0", "y1")


def visible_tiles(views: DataFrame) -> DataFrame:
    """A row for each different tile on screen; wide views meet a tile once."""
    rows = _ranges(views).withColumn("count", F.least(c("x1") - c("x0") + 1, c("n")))
    rows = rows.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), c("count") - 1)))
    rows = rows.withColumn("ordinal", (c("y") - c("y0")) * c("count") + c("k")).withColumn("x", F.pmod(c("x0") + c("k"), c("n")))
    return rows.drop("x0", "x1", "y0", "y1", "k", "count")


# -- fixed point ----------------------------------------------------------------


def q16(v: Column) -> Column:
    """Round to 1/65536, half up."""
    return F.floor(v * 65536.0 + 0.5).cast("long")


def project_local(origin_q16: Column, local: Column, scale_q16: Column) -> Column:
    """Pixel of a tile-local coordinate: floor of the fixed-point sum, as 32 bits."""
    return geo.clamp(F.shiftright(origin_q16 + local.cast("long") * scale_q16, 16), F.lit(-(2**31)), F.lit(2**31 - 1)).cast("int")


def nearest_placement(x: Column, n: Column) -> Column:
    """Unwrapped x of the copy of a tile that is nearest to the centre."""
    return F.round(centre_x() + wrapped_delta(x, centre_x(), n)).cast("long")


def screen_map(unwrapped_x: Column, y: Column, extent: Column) -> dict[str, Column]:
    """Where a tile copy lies: pixel of its corner and pixels for each local unit,
    as doubles and in 1/65536. No extent counts as 1, no tile size as one pixel."""
    ts = F.when(c("ts") <= 0, 1).otherwise(c("ts"))
    sx = (unwrapped_x - centre_x()) * ts + c("width") * 0.5
    sy = (y - centre_y()) * ts + c("height") * 0.5
    scale = ts / F.when(extent == 0, 1.0).otherwise(extent.cast("double"))
    return {"sx": sx, "sy": sy, "scale": scale, "sx_q16": q16(sx), "sy_q16": q16(sy), "scale_q16": q16(scale)}


# -- moving the camera ------------------------------------------------------------


def moved_to(lat: Column, lon: Column) -> dict[str, Column]:
    """A new centre: latitude clamped, longitude wrapped; not finite: the old one."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) != float("inf")) & (F.abs(lon) != float("inf"))
    return {"lat": F.when(ok, geo.clamp_lat(lat)).otherwise(c("lat")), "lon": F.when(ok, geo.wrap_lon(lon)).otherwise(c("lon"))}


def zoomed_to(zoom: Column) -> Column:
    return geo.clamp(zoom, F.lit(0), F.lit(geo.MAX_ZOOM))


def resized(width: Column, height: Column) -> dict[str, Column]:
    """A new screen; sides that aren't positive leave the old one."""
    ok = (width > 0) & (height > 0)
    return {"width": F.when(ok, width).otherwise(c("width")), "height": F.when(ok, height).otherwise(c("height"))}


# -- picking a place -------------------------------------------------------------


def usable_bounds() -> Column:
    """Bounds that a picker takes: valid, and with ground on both axes, so none
    over the antimeridian."""
    return F.coalesce(valid_bounds() & (c("min_lon") < c("max_lon")) & (c("min_lat") < c("max_lat")), F.lit(False))


def picker_zooms(low: Column, high: Column) -> tuple[Column, Column]:
    """Least and most zoom of a picker over data of zooms ``low`` to ``high``;
    nulls for bad zooms or screens. Where no zoom fills the screen, the data's
    own least one."""
    fill = F.when(c("max_lon") - c("min_lon") >= 360.0, world_view_zoom()).otherwise(min_fill_zoom())
    ok = low.between(0, geo.MAX_ZOOM) & high.between(0, geo.MAX_ZOOM) & (low <= high) & valid()
    return F.when(ok, F.coalesce(geo.clamp(fill, low, high), low)), F.when(ok, high)


def picker_begin(low: Column, high: Column) -> dict[str, Column]:
    """A picker's first view: its zooms, and the middle of the bounds (in degrees,
    not projected) at the least of them; all null where it can't open."""
    ok = usable_bounds()
    least, most = picker_zooms(low, high)
    lat, lon = geo.clamp_lat((c("min_lat") + c("max_lat")) / 2.0), geo.wrap_lon((c("min_lon") + c("max_lon")) / 2.0)
    ready = ok & least.isNotNull()
    return {"min_zoom": F.when(ready, least), "max_zoom": F.when(ready, most), "start_lat": F.when(ready, lat), "start_lon": F.when(ready, lon)}
