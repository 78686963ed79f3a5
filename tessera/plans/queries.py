"""The library's registered queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import camera, geo, kinds
from tessera.operators import directory, geometry, labels, packs
from tessera.plans import surrogate as s

c = F.col


def r6(x, name):
    """Doubles are compared to six places. The shift keeps exact halves, which
    engines round by the last bit, off the border."""
    return (F.round(x + 3.7e-8, 6) + 0.0).alias(name)


def tile_of_point(spark, d):
    n = geo.tiles_per_axis(c("z"))
    rows = s.places(spark, d).withColumn("z", F.expr("cast(event_id % 17 as int)"))
    return rows.select("event_id", "z", geo.tile_index(geo.tile_x(c("lon"), n), n).alias("x"), geo.tile_index(geo.tile_y(c("lat"), n), n).alias("y"))


def tile_corner(spark, d):
    n = geo.tiles_per_axis(c("z"))
    t = tile_of_point(spark, d)
    return t.select("event_id", r6(geo.lon_of(c("x"), n), "lon"), r6(geo.lat_of(c("y"), n), "lat"))


def wrap_clamp(spark, d):
    rows = s.places(spark, d)
    return rows.select("event_id", r6(geo.wrap_lon(c("lon") * 3.0), "lon"), r6(geo.clamp_lat(c("lat") * 1.1), "lat"))


def hilbert_tile_id(spark, d):
    t = tile_of_point(spark, d)
    return t.select("event_id", geo.tile_id(c("z"), c("x"), c("y")).alias("tile_id"), geo.tiles_before(c("z")).alias("before"))


def _density(spark, d, top):
    rows = s.places(spark, d).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(top))))
    n = geo.tiles_per_axis(c("z"))
    t = rows.select("z", geo.tile_index(geo.tile_x(c("lon"), n), n).alias("x"), geo.tile_index(geo.tile_y(c("lat"), n), n).alias("y"))
    return t.groupBy("z", "x", "y").agg(F.count("*").alias("n"))


def tile_density_by_zoom(spark, d):
    return _density(spark, d, 8)


def visible_tiles(spark, d):
    return camera.visible_tiles(s.views(spark, d)).select("view_id", "zoom", "x", "y", "ordinal")


def tile_placements(spark, d):
    return camera.tile_placements(s.views(spark, d)).select("view_id", "zoom", "x", "y", "unwrapped_x", "ordinal")


def distinct_tiles(spark, d):
    return camera.tile_placements(s.views(spark, d)).groupBy("view_id", "x", "y").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("copies"))


def _tiles_in_view(spark, d, places, *columns):
    """Places counted by the tiles that some view shows: rows are spread to the
    views' zooms only and cleared by the visible tiles before they are shuffled."""
    seen = visible_tiles(spark, d).select("zoom", "x", "y").distinct()
    zooms = F.broadcast(s.views(spark, d).select("zoom").distinct())  # 32 at most
    n = geo.tiles_per_axis(c("zoom"))
    spread = places.crossJoin(zooms).select("zoom", geo.tile_index(geo.tile_x(c("lon"), n), n).alias("x"), geo.tile_index(geo.tile_y(c("lat"), n), n).alias("y"), *columns)
    kept = spread.join(directory.broadcast_checked(seen), ["zoom", "x", "y"], "left_semi")
    return kept.groupBy("zoom", "x", "y", *columns).agg(F.count("*").alias("n"))


def present_missing_tiles(spark, d):
    have = _tiles_in_view(spark, d, s.places(spark, d))
    return visible_tiles(spark, d).join(have, ["zoom", "x", "y"], "left").groupBy("view_id").agg(F.count("n").alias("present"), F.sum(c("n").isNull().cast("long")).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("places"))


def camera_bounds(spark, d):
    return s.views(spark, d).select("view_id", *(r6(v, k) for k, v in camera.visible_bounds().items()))


def project_point(spark, d):
    v = s.views(spark, d)
    p = s.places(spark, d).select("event_id", c("lon").alias("p_lon"), c("lat").alias("p_lat"), F.expr("cast(event_id % 25 as int)").alias("view_id"))
    return p.join(v, "view_id").select("view_id", "event_id", F.round(camera.project_x(c("p_lon")), 3).alias("sx"), F.round(camera.project_y(c("p_lat")), 3).alias("sy"))


def pan(spark, d):
    lat, lon = camera.pan(F.lit(45.0), F.lit(-20.0))
    return s.views(spark, d).select("view_id", r6(lat, "lat"), r6(lon, "lon"))


def zoom_at_point(spark, d):
    z, lat, lon = camera.zoom_at(F.lit(100.0), F.lit(60.0), F.expr("view_id % 5 - 2"))
    return s.views(spark, d).select("view_id", z.alias("zoom"), r6(lat, "lat"), r6(lon, "lon"))


def frame_transform(spark, d):
    lat, lon = camera.pan(F.lit(45.0), F.lit(20.0))
    old = (c("lat"), c("lon"), c("zoom"), c("ts"))
    scale, dx, dy = camera.frame_transform(old, (lat, lon, c("zoom"), c("ts")))
    return s.views(spark, d).select("view_id", r6(scale, "scale"), F.round(dx, 3).alias("dx"), F.round(dy, 3).alias("dy"))


def fit_bounds(spark, d):
    lat, lon = camera.bounds_centre()
    return s.boxes(spark, d).select("s_suppkey", camera.fit_zoom(24).alias("zoom"), r6(lat, "lat"), r6(lon, "lon"))


def fill_bounds(spark, d):
    lat, lon = camera.bounds_centre()
    return s.boxes(spark, d).select("s_suppkey", camera.min_fill_zoom().alias("zoom"), camera.world_view_zoom().alias("world_zoom"), r6(lat, "lat"), r6(lon, "lon"))


def zoom_floor(spark, d):
    rows = s.boxes(spark, d).withColumns({"lo": F.expr("s_suppkey % 4"), "hi": F.expr("9 + s_suppkey % 4"), "fill": camera.min_fill_zoom()})
    return rows.groupBy("lo").agg(F.min(F.when(c("fill") <= c("hi"), geo.clamp(c("fill"), c("lo"), c("hi")))).cast("long").alias("floor"), F.count("*").alias("packs"))


def picker_zoom_range(spark, d):
    rows = s.boxes(spark, d).withColumns({"lo": F.expr("cast(s_suppkey % 4 as int)"), "hi": F.expr("cast(6 + s_suppkey % 9 as int)")})
    fill = F.when(c("max_lon") - c("min_lon") >= 360.0, camera.world_view_zoom()).otherwise(camera.min_fill_zoom())
    return rows.select("s_suppkey", F.coalesce(geo.clamp(fill, c("lo"), c("hi")), c("lo")).alias("min_zoom"), c("hi").alias("max_zoom"))



def classify_openmaptiles(spark, d):
    k = kinds.openmaptiles(c("layer"), c("class"), c("subclass"), c("geometry"))
    return s.roads(spark, d).groupBy("layer", "class", "subclass", "geometry", k.alias("kind_out")).agg(F.count("*").alias("n"))


def classify_overview(spark, d):
    return s.roads(spark, d).groupBy("layer", kinds.overview(c("layer")).alias("kind_out")).agg(F.count("*").alias("n"))


def classify_protomaps(spark, d):
    k = kinds.protomaps(c("layer"), c("kind"), c("kind_detail"), c("geometry"))
    return s.roads(spark, d).groupBy("layer", "kind", "kind_detail", "geometry", k.alias("kind_out")).agg(F.count("*").alias("n"))


def kinds_by_layer(spark, d):
    k = kinds.openmaptiles(c("layer"), c("class"), c("subclass"), c("geometry"))
    rows = s.roads(spark, d).filter(~c("layer").isin(*kinds.TEXT_LAYERS)).withColumn("k", F.coalesce(k, F.lit("skipped")))
    return rows.groupBy("layer", "k").agg(F.count("*").alias("n"))


def layer_geom_rollup(spark, d):
    return s.roads(spark, d).rollup("layer", "geometry").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def sample_values(spark, d):
    """The first eight different classes of each layer, in order of arrival."""
    from pyspark.sql import Window

    first = s.roads(spark, d).filter("class is not null").groupBy("layer", "class").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy("at", "class"))).filter("place <= 8").select("layer", "class", "place")


def style_resolve(spark, d):
    rules = kinds.style_rules(spark).withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(geo.MAX_ZOOM))))
    return rules.select("style", "kind", "zoom", kinds.shown(c("zoom")).alias("shown"), kinds.rgb565(c("r"), c("g"), c("b")).alias("rgb565"), kinds.stroke_px(c("width_px")).alias("px"))


def visible_kinds_by_zoom(spark, d):
    return style_resolve(spark, d).filter("shown").groupBy("style", "zoom").agg(F.count("*").alias("kinds"))


def cache_key_fnv(spark, d):
    return s.read(spark, d, "part").select("p_partkey", kinds.fnv1a(c("p_name")).alias("fnv"))


def pack_identity(spark, d):
    return s.packs(spark, d).select("ordinal", packs.pack_identity().alias("identity"))


def pack_validate(spark, d):
    return packs.first_valid(s.packs(spark, d)).select("ordinal", "status")


def pack_resolve(spark, d):
    ok = packs.first_valid(s.packs(spark, d)).filter("status = 'none'")
    return packs.resolve(s.requests(spark, d), ok)


def pack_resolve_tiered(spark, d):
    ok = packs.first_valid(s.packs(spark, d)).filter("status = 'none'")
    return packs.resolve_tiered(s.requests(spark, d), ok)


def radius_bbox(spark, d):
    rows = s.read(spark, d, "supplier").selectExpr("s_suppkey", f"{s.lat('s_suppkey')} as lat", f"{s.lon('s_suppkey')} as lon", "cast(s_suppkey % 50 + 1 as double) * 20.0D as km")
    return rows.select("s_suppkey", *(r6(v, k) for k, v in packs.radius_box(c("lat"), c("lon"), c("km")).items()))


def _directory(spark, d):
    return s.read(spark, d, "part").selectExpr("p_partkey % 5 as archive", "cast(p_partkey as bigint) as k", "cast(p_partkey % 3 + 1 as bigint) as run_length", "cast(p_size * 100 as bigint) as length")


def _encoded(spark, d):
    """Delta columns of a directory per archive; every seventh offset is explicit."""
    rows = _directory(spark, d).selectExpr("archive", "k div 5 as i", "run_length", "length", "cast(case when k div 5 = 0 then k else 5 end as bigint) as d_id", "cast(case when k div 5 % 7 = 0 then k * 1000 + 1 else 0 end as bigint) as raw_offset")
    return rows


def directory_decode(spark, d):
    return directory.decode_columns(_encoded(spark, d)).select("archive", "i", "tile_id", "run_length", "length", "offset")


def asof_tile_lookup(spark, d):
    """Every event's tile in every archive."""
    entries = directory.decode_columns(_encoded(spark, d))
    archives = F.broadcast(_directory(spark, d).select("archive").distinct())
    asked = s.read(spark, d, "events").selectExpr("event_id", "event_id * 3 % 2500 as tile_id").crossJoin(archives)
    return directory.lookup(asked, entries).select("event_id", "archive", "tile_id", "offset", "length")


def size_summary(spark, d):
    return directory.size_summary(s.read(spark, d, "part"), ["p_brand"], "p_size")


def ring_area(spark, d):
    return s.rings(spark, d).select("feature_id", "ring", F.size("points").alias("n_points"), geometry.area2(c("points")).alias("area2"))


def ring_parts(spark, d):
    return geometry.ring_parts(ring_area(spark, d)).select("feature_id", "ring", "part")


def painted_bounds(spark, d):
    x, y = F.col("points.x"), F.col("points.y")
    return s.rings(spark, d).select("ring", F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def band_shapes(spark, d):
    return geometry.bands(painted_bounds(spark, d), 4096, 256).select("ring", F.col("band").cast("long").alias("band"))


def band_load(spark, d):
    """Shapes that each band has to draw."""
    return band_shapes(spark, d).groupBy("band").agg(F.count("*").alias("shapes"))


def line_segments(spark, d):
    return s.rings(spark, d).select("ring", F.posexplode(geometry.segments(c("points"))).alias("i", "s")).select("ring", "i", "s.x0", "s.y0", "s.x1", "s.y1")


def clip_segments(spark, d):
    return geometry.clip_segments(line_segments(spark, d), 512, 512, 3583, 3583)


def project_q16(spark, d):
    v = s.views(spark, d).withColumn("scale", camera.q16(c("ts") / 4096.0)).withColumn("ox", camera.q16(F.round(F.lit(0.5) * c("width") - c("view_id") * 300.25, 6)))
    p = s.read(spark, d, "part").selectExpr("p_partkey", "cast((p_partkey * 37) % 5000 - 400 as int) as x", "cast(p_partkey % 25 as int) as view_id")
    return p.join(F.broadcast(v), "view_id").select("p_partkey", camera.project_local(c("ox"), c("x"), c("scale")).alias("px"))


def _labels(spark, d):
    """Label candidates of three frames from parts."""
    rows = s.read(spark, d, "part").selectExpr("p_partkey", "p_partkey % 3 as frame", "p_name as text", "cast(p_partkey * 7 % 40 * 30 as int) as x", "cast(p_partkey * 11 % 30 * 20 as int) as y", "p_size", "p_type")
    return rows.select("frame", c("p_partkey").alias("id"), "text", "x", "y", labels.priority(F.when(F.expr("p_partkey % 2 = 0"), c("p_size").cast("double") + 0.5), c("p_size").cast("double"), F.lit(50.0), F.expr("p_partkey % 4 < 2")).alias("priority"))


def label_priority(spark, d):
    return _labels(spark, d).select("id", "priority")


def label_pool(spark, d):
    return labels.pool(_labels(spark, d)).select("frame", "id", "place")


def label_layout(spark, d):
    return labels.layout(labels.pool(_labels(spark, d)), 1280, 600).select("frame", "id", "place")


def label_utf8_valid(spark, d):
    rows = s.read(spark, d, "part").selectExpr("p_partkey", "concat(p_name, repeat('é', cast(p_partkey % 60 as int)), case when p_partkey % 9 = 0 then '\t' else '' end) as text")
    return rows.select("p_partkey", labels.printable(c("text")).alias("ok"))


def stage_means(spark, d):
    """Sweep totals per stage: frames, least, most and mean, frames a second."""
    rows = s.read(spark, d, "events").withColumn("ms", F.expr("cast(round(value * 100) as bigint)"))
    g = rows.groupBy("event_type").agg(F.count("*").alias("frames"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.sum("ms").alias("total_ms"))
    return g.withColumn("mean_ms", F.round(c("total_ms") / c("frames"), 6)).withColumn("fps", F.round(F.when(c("total_ms") > 0, 1000.0 * c("frames") / c("total_ms")).otherwise(0.0), 6))


def attribution_required(spark, d):
    """Different credits in the order in which sources first ask for them."""
    from pyspark.sql import Window

    rows = s.read(spark, d, "nation").selectExpr("n_nationkey", "concat('© region ', cast(n_regionkey as string)) as credit").filter("n_nationkey % 4 <> 0")
    first = rows.groupBy("credit").agg(F.min("n_nationkey").alias("at"), F.count("*").alias("sources"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("at"))).select("credit", "place", "sources")


def gesture_session(spark, d):
    """The camera after every gesture of each user's session."""
    from tessera.streaming.sessions import sessions

    kind = F.when(c("event_type") == "click", "zoom_in").when(c("event_type") == "error", "zoom_out").when(c("event_type") == "view", "drag").when(c("event_type") == "purchase", "reset").otherwise("recenter")
    return sessions(s.read(spark, d, "events").select(c("user_id").alias("session"), "ts", "event_id", kind.alias("kind"), c("value").alias("a"), (c("value") / 2).alias("b")))


def view_tile_kinds(spark, d):
    """The flagship: places per tile and kind of every view, with style."""
    views = s.views(spark, d)
    places = s.places(spark, d).withColumn("kind", F.when(c("event_type") == "view", "water").when(c("event_type") == "click", "minor_road").when(c("event_type") == "signup", "park").when(c("event_type") == "purchase", "building").otherwise("label_primary"))
    counts = _tiles_in_view(spark, d, places, "kind")
    rules = F.broadcast(kinds.style_rules(spark).filter(c("style") == kinds.DEFAULT_STYLE))
    return camera.visible_tiles(views).drop("n").join(counts, ["zoom", "x", "y"]).join(rules, "kind").select("view_id", "zoom", "x", "y", "kind", "n", kinds.shown(c("zoom")).alias("shown"))
