import numpy as np
from pyspark.sql import functions as F

from tessera.functions import camera, geo, kinds
from tessera.operators.geometry import clip_segment

VIEW = "lat double, lon double, zoom int, width int, height int, ts int"


def test_wrap(spark):
    got = spark.createDataFrame([(180.0,), (190.0,), (-190.0,), (360.0,)], "x double").select(geo.wrap_lon(F.col("x")).alias("w")).collect()
    assert [r.w for r in got] == [-180.0, -170.0, 170.0, 0.0]


def test_tiles_of_points(spark):
    rows = [(85.0, -180.0, 2), (0.0, -180.0, 2), (44.0521, -123.0868, 5), (44.0521, -123.0868, 10), (44.0521, -123.0868, 14), (44.0521, -123.0868, 16), (89.9, 0.0, 5), (-89.9, 0.0, 5)]
    n = geo.tiles_per_axis(F.col("z"))
    got = spark.createDataFrame(rows, "lat double, lon double, z int").select(geo.tile_index(geo.tile_x(F.col("lon"), n), n).alias("x"), geo.tile_index(geo.tile_y(F.col("lat"), n), n).alias("y")).collect()
    assert [tuple(r) for r in got[:6]] == [(0, 0), (0, 2), (5, 11), (161, 372), (2590, 5954), (10360, 23816)]
    assert [r.y for r in got[6:]] == [0, 31]


def test_tile_ids():
    z, x, y = np.array([0, 1, 1, 1, 1, 2, 2, 2, 14, 14]), np.array([0, 0, 0, 1, 1, 0, 1, 3, 2593, 2593]), np.array([0, 0, 1, 1, 0, 0, 2, 3, 5953, 5954])
    assert geo.tile_ids(z, x, y).tolist() == [0, 1, 2, 3, 4, 5, 12, 15, 147917143, 147917148]


def test_tile_ids_are_a_walk():
    g = np.arange(16)
    x, y = np.repeat(g, 16), np.tile(g, 16)
    place = geo.hilbert(np.full(256, 4), x, y)
    order = np.argsort(place)
    assert sorted(place.tolist()) == list(range(256))
    assert (np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) == 1).all()


def test_visible_tiles(spark):
    rows = [(44.05, -123.022, 14, 1280, 720, 256), (0.0, 0.0, 0, 1280, 720, 256), (0.0, 0.0, 2, 1280, 600, 256), (0.0, 0.0, 40, 1280, 600, 256), (None, 0.0, 2, 1280, 600, 256)]
    views = spark.createDataFrame(rows, VIEW).withColumn("id", F.monotonically_increasing_id())
    count = lambda df: sorted(r["count"] for r in df.groupBy("id").count().collect())
    assert count(camera.visible_tiles(views)) == [1, 16, 24]
    assert count(camera.tile_placements(views)) == [5, 24, 24]


def test_zooms(spark):
    box = "min_lon double, min_lat double, max_lon double, max_lat double, width int, height int, ts int"
    rows = [(-123.055, 44.03, -122.96, 44.09, 1280, 600, 256), (-123.055, 44.03, -122.96, 44.09, 320, 170, 256)]
    got = spark.createDataFrame(rows, box).select(camera.fit_zoom(24).alias("fit"), camera.min_fill_zoom().alias("fill"), camera.world_view_zoom().alias("world")).collect()
    assert (got[0].fit, got[0].fill, got[0].world) == (13, 15, 2)
    assert (got[1].fill, got[1].world) == (13, 0)


def test_frame_transform(spark):
    v = spark.createDataFrame([(44.05, -123.022, 14, 1280, 720, 256)], VIEW)
    lat, lon = camera.pan(F.lit(45.0), F.lit(20.0))
    old = (F.col("lat"), F.col("lon"), F.col("zoom"), F.col("ts"))
    s, dx, dy = v.select(*camera.frame_transform(old, (lat, lon, F.col("zoom"), F.col("ts")))).first()
    assert (s, round(dx, 4), round(dy, 4)) == (1.0, -45.0, -20.0)


def test_fnv_and_colours(spark):
    got = spark.createDataFrame([("field-dark",), ("standard-light",), ("",)], "s string").select(kinds.fnv1a(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == [4173305314, 4247692921, 2166136261]
    assert spark.range(1).select(kinds.rgb565(F.lit(255), F.lit(255), F.lit(255))).first()[0] == 65535
    px = spark.createDataFrame([(0.0,), (0.5,), (1.8,), (2.5,), (90.0,)], "w double").select(kinds.stroke_px(F.col("w")).alias("p")).collect()
    assert [r.p for r in px] == [0, 1, 2, 3, 64]


def test_styles(spark):
    rules = kinds.style_rules(spark)
    assert rules.count() == 60
    assert rules.filter(kinds.shown(F.lit(25))).count() == 0
    assert kinds.drag_style(rules.filter("style = 'field-dark'")).filter("visible").count() == 6


def test_clip():
    assert clip_segment(-10, 5, 20, 5, 0, 0, 9, 9) == (0, 5, 9, 5)
    assert clip_segment(2, 3, 4, 5, 0, 0, 9, 9) == (2, 3, 4, 5)
    assert clip_segment(-5, 0, -1, 9, 0, 0, 9, 9) is None
    assert clip_segment(-1, -1, 10, 10, 0, 0, 9, 9) == (0, 0, 9, 9)
