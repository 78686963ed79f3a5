"""From features to the screen: projection, painted bounds, tile scissors, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import camera, kinds
from tessera.operators import geometry, raster

c = F.col


def drawable(shown: Column, kind: Column) -> Column:
    """Features that are painted: of a known kind that isn't a label and that the
    style shows at this zoom."""
    return F.coalesce(kind.isNotNull() & ~kind.isin(*kinds.LABELS) & shown, F.lit(False))


def on_copies(features: DataFrame, placements: DataFrame) -> DataFrame:
    """Each feature of a tile (zoom, x, y) on every copy of the tile on screen.
    Placements (of views) are the small side; a tile that many views show is
    decoded once and joined here."""
    return features.join(placements, ["zoom", "x", "y"])


def to_screen(features: DataFrame) -> DataFrame:
    """Projected features: ``screen`` (paths in pixels), ``sign`` of each ring and
    painted bounds min_x, min_y, max_x, max_y that include a stroke's brush.

    features: geom_type, paths, width_px and the q16 columns sx_q16, sy_q16,
    scale_q16 of ``camera.screen_map``. Polygons lose rings of less than 3 points,
    lines paths of less than 2; features without paths left go."""
    least = F.when(c("geom_type") == "polygon", 3).when(c("geom_type") == "linestring", 2).otherwise(1)
    paths = F.filter("paths", lambda p: F.size(p) >= least)
    point = lambda p: F.struct(camera.project_local(c("sx_q16"), p["x"], c("scale_q16")).alias("x"), camera.project_local(c("sy_q16"), p["y"], c("scale_q16")).alias("y"))
    rows = features.withColumn("screen", F.transform(paths, lambda p: F.transform(p, point))).filter(F.size("screen") > 0)
    brush = F.when(c("geom_type") == "linestring", kinds.stroke_px(c("width_px"))).otherwise(1)
    before = F.floor(brush / 2).cast("int")
    after = F.when(brush > 0, brush - before - 1).otherwise(0)
    x, y = F.flatten("screen")["x"], F.flatten("screen")["y"]
    return rows.withColumns({
        "sign": F.when(c("geom_type") == "polygon", F.transform("screen", lambda p: F.signum(geometry.area2(p)).cast("int"))),
        "min_x": F.array_min(x) - before, "max_x": F.array_max(x) + after, "min_y": F.array_min(y) - before, "max_y": F.array_max(y) + after,
    })


def scissor(spans: DataFrame) -> DataFrame:
    """Spans (y, x0, x1 inclusive) cut to their tile's square: corner clip_x,
    clip_y, side ``ts``, without its right and lower edge."""
    inside = spans.filter((c("y") >= c("clip_y")) & (c("y") < c("clip_y") + c("ts")))
    cut = inside.withColumn("x0", F.greatest("x0", "clip_x")).withColumn("x1", F.least(c("x1"), c("clip_x") + c("ts") - 1))
    return cut.filter("x0 <= x1")


def in_bands(features: DataFrame, frame_height: int, band_height: int) -> DataFrame:
    """Projected features for each horizontal band that their painted bounds touch."""
    return geometry.bands(features.withColumn("y0", c("min_y")).withColumn("y1", c("max_y")), frame_height, band_height).drop("y0", "y1")


def draw_banded(shapes: DataFrame, width: int, height: int, band_height: int) -> DataFrame:
    """frame, y, x, rgb of all shapes, drawn band by band: each band paints only
    the shapes that touch it, cut to its rows, so bands are independent work. The
    same picture as drawing the whole frame. shapes: as for ``raster.spans``."""
    flat = F.flatten("paths")
    ys = F.transform(flat, lambda p: p["y"])
    brush = F.coalesce("px", F.lit(0)) + 1
    is_rect = c("shape") == "rect"  # a corner and a size
    low = F.when(is_rect, F.get(flat, F.lit(0))["y"]).otherwise(F.array_min(ys) - brush)
    high = F.when(is_rect, F.get(flat, F.lit(0))["y"] + F.get(flat, F.lit(1))["y"] - 1).otherwise(F.array_max(ys) + brush)
    dealt = geometry.bands(shapes.withColumns({"y0": low, "y1": high}), height, band_height)
    return raster.composite(raster.spans(dealt, width, height, band_height))
