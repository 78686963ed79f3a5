"""Packs: identity, validation, and which one serves a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import camera, geo
from tessera.functions.kinds import known_profile

c = F.col
# Fixed value: text fields that a manifest must fill, in order.
REQUIRED = ("pack_id", "pack_version", "display_name", "region_id", "region_name", "content_profile", "schema_version", "source_snapshot", "builder", "builder_version", "builder_commit", "build_date", "pack_class")


def half_away(v: Column) -> Column:
    """Round half away from zero."""
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)).cast("long")


def pack_identity() -> Column:
    e7 = [half_away(c(x) * 1e7).cast("string") for x in ("min_lon", "min_lat", "max_lon", "max_lat")]
    return F.concat(
        F.concat_ws("__", *(F.lower(x) for x in ("source_snapshot", "schema_version", "content_profile", "region_id"))),
        F.lit("__b"), F.concat_ws("_", *e7), F.lit("__z"), c("min_zoom").cast("string"), F.lit("-"), c("max_zoom").cast("string"),
    )


def validation(identity: Column | None = None, aliases: dict[str, str] | None = None) -> Column:
    """The first rule that a manifest breaks, or ``none``. Missing text counts as
    empty; ``aliases`` are other ids of known schemas."""
    empty = F.lit(False)
    for name in REQUIRED:
        empty = empty | (F.coalesce(c(name), F.lit("")) == "")
    part = r"^[A-Za-z0-9.-]+$"
    ids = F.coalesce("provenance_ids", F.array().cast("array<string>"))
    credits = F.coalesce("required_attribution", F.array().cast("array<string>"))
    return (
        F.when(empty, "required_field")
        .when(~camera.valid_bounds(), "bounds")
        .when(~(c("min_zoom").between(0, 31) & c("max_zoom").between(0, 31) & (c("min_zoom") <= c("max_zoom"))), "zoom_range")
        .when((c("pmtiles_version") != 3) | known_profile(c("schema_version"), aliases).isNull() | ~c("pack_class").isin("clean", "permissive", "open"), "compatibility")
        .when((F.size(ids) == 0) | F.exists(ids, lambda x: F.coalesce(x, F.lit("")) == ""), "provenance")
        .when(F.exists(credits, lambda x: F.coalesce(x, F.lit("")) == ""), "attribution")
        .when((F.coalesce("size_bytes", F.lit(0)) <= 0) | ~F.coalesce(c("output_sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False)), "archive")
        .when(~(c("region_id").rlike(part) & c("content_profile").rlike(part) & c("source_snapshot").rlike(part) & c("schema_version").rlike(part)) | (c("pack_id") != (pack_identity() if identity is None else identity)), "identity")
        .otherwise("none")
    )


def segments(west: Column, east: Column) -> Column:
    """Longitude ranges of a box; two if it crosses the antimeridian."""
    one = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return F.when(west <= east, F.array(one(west, east))).otherwise(F.array(one(west, F.lit(180.0)), one(F.lit(-180.0), east)))


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    """Whether box (west, south, east, north) holds another."""
    o, i = segments(outer[0], outer[2]), segments(inner[0], inner[2])
    covered = F.forall(i, lambda s: F.exists(o, lambda t: (t["a"] <= s["a"]) & (s["b"] <= t["b"])))
    return (outer[1] <= inner[1]) & (inner[3] <= outer[3]) & covered


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Plain overlap of boxes; boxes over the antimeridian aren't split."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(c(prefix + x) for x in ("min_lon", "min_lat", "max_lon", "max_lat"))


CELL = 10.0


def _cells(box: tuple[Column, ...]) -> Column:
    """Cells of longitude and latitude that a box meets, those of both segments of
    one over the antimeridian: an equi-join key for containment and overlap."""
    grid = lambda v: F.floor((v + 180.0) / CELL).cast("int")
    west, south, east, north = box
    columns = F.flatten(F.transform(segments(west, east), lambda s: F.sequence(grid(s["a"]), grid(s["b"]))))
    rows = F.when(south <= north, F.sequence(grid(south), grid(north)))
    return F.array_distinct(F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: y * 100 + x))))


def valid_request() -> Column:
    """Requests with valid bounds and zoom; others meet no pack."""
    west, south, east, north = box("q_")
    ok = west.between(-180.0, 180.0) & east.between(-180.0, 180.0) & south.between(-geo.MAX_LAT, geo.MAX_LAT) & north.between(-geo.MAX_LAT, geo.MAX_LAT) & (south <= north)
    return F.coalesce(ok & c("zoom").between(0, geo.MAX_ZOOM), F.lit(False))


def candidates(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """Pairs of a request (req_id, zoom, q_ box) and a pack whose zooms hold the
    request's and whose box holds or meets it; ``inside`` tells which.

    Boxes are dealt to cells, so the join has keys; a pair is made once, in the
    first cell that both have. Plain overlap of boxes over the antimeridian takes
    their edges as they are, so it is found in the cells of the pack's segments or
    not at all."""
    q = requests.filter(valid_request()).withColumn("q_cells", _cells(box("q_")))
    p = packs.withColumn("p_cells", _cells(box()))
    pairs = q.withColumn("cell", F.explode("q_cells")).join(p.withColumn("cell", F.explode("p_cells")), "cell")
    j = pairs.filter(c("zoom").between(c("min_zoom"), c("max_zoom")))
    j = j.filter(c("cell") == F.array_min(F.array_intersect("q_cells", "p_cells")))
    j = j.withColumn("inside", contains(box(), box("q_")))
    return j.filter(c("inside") | overlaps(box(), box("q_"))).drop("cell", "p_cells", "q_cells")


def resolve(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """req_id, pack_id: of the packs that hold a request the one with the highest
    priority, then the last by id; null without any."""
    held = candidates(requests, packs).filter("inside")
    best = held.groupBy("req_id").agg(F.max(F.struct("priority", "pack_id")).alias("b")).select("req_id", "b.pack_id")
    return requests.select("req_id").join(best, "req_id", "left")


def resolve_tiered(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """req_id, tier, pack_id: a pack that holds the request (tier 1), else the one
    of highest priority that meets it, first by ``ordinal`` (tier 2), else none."""
    found = candidates(requests, packs)
    one = F.max(F.when(c("inside"), F.struct("priority", "pack_id"))).alias("one")
    two = F.min(F.when(overlaps(box(), box("q_")), F.struct((-c("priority")).alias("p"), "ordinal", "pack_id"))).alias("two")
    best = found.groupBy("req_id").agg(one, two)
    out = requests.select("req_id").join(best, "req_id", "left")
    return out.select("req_id", F.when(c("one").isNotNull(), 1).when(c("two").isNotNull(), 2).otherwise(0).alias("tier"), F.coalesce("one.pack_id", "two.pack_id").alias("pack_id"))


def first_valid(packs: DataFrame) -> DataFrame:
    """Mark packs with ``status``: ``none``, the rule broken, or ``duplicate`` for
    a valid pack whose id an earlier valid one (by name) has."""
    rows = packs.withColumn("error", validation())
    order = Window.partitionBy("pack_id", c("error") == "none").orderBy("name")
    return rows.withColumn("status", F.when(c("error") != "none", c("error")).when(F.row_number().over(order) > 1, "duplicate").otherwise("none")).drop("error")


# -- regions -----------------------------------------------------------------------

KM_PER_DEGREE, BUILDER_MAX_LAT = 111.32, 85.0511287798066


def radius_box(lat: Column, lon: Column, km: Column) -> dict[str, Column]:
    d_lat = km / KM_PER_DEGREE
    cos = F.cos(F.radians(F.least(F.abs(lat) + d_lat, F.lit(89.9))))
    d_lon = F.when(cos <= 1e-9, 180.0).otherwise(km / (KM_PER_DEGREE * cos))
    whole = d_lon >= 180.0
    return {
        "min_lon": F.when(whole, -180.0).otherwise(F.greatest(lon - d_lon, F.lit(-180.0))), "min_lat": F.greatest(lat - d_lat, F.lit(-BUILDER_MAX_LAT)),
        "max_lon": F.when(whole, 180.0).otherwise(F.least(lon + d_lon, F.lit(180.0))), "max_lat": F.least(lat + d_lat, F.lit(BUILDER_MAX_LAT)),
    }
