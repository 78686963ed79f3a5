"""What features are: rules from layer and attributes to kinds, and their styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds by code, layers left out without text or while dragging.
KINDS = ("background", "land", "water", "motorway", "primary_road", "secondary_road", "minor_road", "rail", "boundary", "building", "park", "airport", "label_primary", "label_secondary", "label_muted")
TEXT_LAYERS = ("housenumber", "transportation_name", "water_name", "mountain_peak", "poi", "place")
DRAG_LAYERS = (*TEXT_LAYERS, "building")
#: schemas by what they mean; packs may name the overview by ids of their own,
#: which callers pass as ``aliases`` or write in a table
PROFILES = ("openmaptiles-3.16", "world-overview-1", "protomaps-v4")
LABELS = ("label_primary", "label_secondary", "label_muted")

# Red, green, blue, width in pixels, least zoom per style and kind.
STYLES = {
    "field-dark": [(8, 10, 12, 1, 0), (16, 19, 22, 1, 0), (19, 32, 43, 1, 0), (58, 70, 80, 3, 0), (49, 59, 68, 2.5, 4), (38, 46, 53, 1.8, 8), (29, 35, 41, 1, 12), (42, 47, 51, 1, 9), (46, 58, 66, 1, 0), (23, 27, 30, 1, 15), (22, 32, 26, 1, 6), (61, 74, 82, 2, 5), (216, 222, 227, 1, 0), (138, 147, 155, 1, 8), (90, 97, 105, 1, 0)],
    "standard-light": [(247, 247, 245, 1, 0), (242, 240, 234, 1, 0), (169, 205, 232, 1, 0), (232, 151, 78, 3, 0), (247, 195, 107, 2.5, 4), (253, 253, 251, 1.8, 8), (227, 224, 216, 1, 12), (185, 180, 168, 1, 9), (183, 159, 203, 1, 0), (217, 211, 197, 1, 15), (200, 227, 176, 1, 6), (201, 182, 217, 2, 5), (43, 43, 38, 1, 0), (92, 92, 84, 1, 8), (140, 140, 130, 1, 0)],
    "high-contrast-field": [(255, 255, 255, 1, 0), (255, 255, 255, 1, 0), (21, 101, 192, 1, 0), (0, 0, 0, 4, 0), (32, 32, 32, 3, 4), (75, 75, 75, 2, 10), (122, 122, 122, 1, 14), (0, 0, 0, 1, 9), (176, 0, 32, 1.5, 0), (208, 208, 208, 1, 17), (63, 143, 70, 1, 6), (13, 71, 161, 3, 5), (0, 0, 0, 1, 0), (51, 51, 51, 1, 8), (102, 102, 102, 1, 0)],
    "night-red-safe": [(0, 0, 0, 1, 0), (10, 0, 0, 1, 0), (26, 5, 5, 1, 0), (107, 20, 20, 3, 0), (85, 16, 16, 2.5, 4), (64, 12, 12, 1.8, 8), (46, 8, 8, 1, 12), (58, 10, 10, 1, 9), (74, 16, 16, 1, 0), (28, 5, 5, 1, 15), (36, 8, 8, 1, 6), (122, 24, 24, 2, 5), (179, 58, 58, 1, 0), (122, 38, 38, 1, 8), (74, 23, 23, 1, 0)],
}
HIDDEN = {("high-contrast-field", "rail")}
DEFAULT_STYLE, MAX_STYLE_ZOOM = "standard-light", 24


def transportation(cls: Column, sub: Column) -> Column:
    return (
        F.when((cls == "rail") | (sub == "rail"), "rail").when(cls.isNull(), "minor_road").when(cls.isin("motorway", "trunk"), "motorway")
        .when(cls == "primary", "primary_road").when(cls.isin("secondary", "tertiary"), "secondary_road").otherwise("minor_road")
    )


def openmaptiles(layer: Column, cls: Column, sub: Column, geometry: Column) -> Column:
    """Kind of a feature of the OpenMapTiles schema, null if there is none."""
    use = F.when(cls.isin("pitch", "playground", "cemetery", "forest", "grass", "park"), "park").when(
        cls.isin("residential", "commercial", "industrial", "retail", "school", "kindergarten", "military", "railway", "stadium", "track", "bus_station"), "land"
    )
    return (
        F.when(layer.isin("water", "waterway", "ocean"), "water")
        .when(layer.isin("road", "roads", "transportation", "transport"), transportation(cls, sub))
        .when(layer.isin("rail", "railway"), "rail").when(layer.isin("building", "buildings"), "building")
        .when(layer == "park", F.when(geometry == "polygon", "park").otherwise("label_primary"))
        .when(layer == "landcover", F.when(sub.isin("park", "recreation_ground", "garden"), "park").otherwise("land"))
        .when(layer.isin("land", "earth"), "land").when(layer == "landuse", use).when(layer.isin("boundary", "boundaries"), "boundary")
        .when(layer.isin("airport", "aerodrome", "aerodrome_label", "aeroway"), "airport").when(layer.isin("place", "place_label", "poi"), "label_primary")
    )


def overview(layer: Column) -> Column:
    return F.when(layer == "land", "land").when(layer.isin("water", "waterway"), "water").when(layer == "boundary", "boundary").when(layer == "place", "label_primary")


def protomaps(layer: Column, kind: Column, detail: Column, geometry: Column) -> Column:
    """Kind of a feature of the Protomaps v4 schema, null if there is none."""
    detail = F.coalesce(detail, F.lit(""))
    roads = (
        F.when(kind == "rail", "rail").when(kind == "aeroway", "airport").when(kind == "highway", "motorway")
        .when(kind == "major_road", F.when(detail.isin("secondary", "secondary_link", "tertiary", "tertiary_link"), "secondary_road").otherwise("primary_road"))
        .when(kind.isin("minor_road", "path"), "minor_road")
    )
    green = kind.isin("forest", "wood", "park", "national_park", "nature_reserve", "protected_area", "recreation_ground", "garden", "golf_course")
    rules = (
        F.when((layer == "roads") & (geometry == "linestring"), roads)
        .when((layer == "boundaries") & (geometry == "linestring"), "boundary")
        .when(layer == "water", F.when(geometry.isin("polygon", "linestring"), "water").when(geometry == "point", "label_muted"))
        .when((layer == "places") & (geometry == "point"), F.when(kind.isin("country", "region", "locality"), F.when(detail.isin("village", "hamlet", "isolated_dwelling"), "label_secondary").otherwise("label_primary")))
        .when((layer == "earth") & (geometry == "polygon") & (kind == "earth"), "land")
        .when(layer.isin("landcover", "landuse") & (geometry == "polygon"), F.when(green, "park").otherwise("land"))
        .when((layer == "buildings") & (geometry == "polygon") & (kind == "building"), "building")
    )
    return F.when(kind.isNotNull() & (kind != ""), rules)


def known_profile(profile: Column, aliases: dict[str, str] | None = None) -> Column:
    """The id in PROFILES that a pack's schema stands for, null if none does."""
    named = F.coalesce(*(F.when(profile == k, F.lit(v)) for k, v in (aliases or {}).items()), profile)
    return F.when(named.isin(*PROFILES), named)


def for_profile(profile: Column, layer: Column, cls: Column, sub: Column, kind: Column, detail: Column, geometry: Column) -> Column:
    """Kind by the rules that a pack's schema names; unknown schemas give none."""
    return F.when(profile == PROFILES[0], openmaptiles(layer, cls, sub, geometry)).when(profile == PROFILES[1], overview(layer)).when(profile == PROFILES[2], protomaps(layer, kind, detail, geometry))


def style_rules(spark: SparkSession) -> DataFrame:
    """60 rows: style, version, kind, code, colour, width, zooms, visible."""
    rows = [(s, 1, k, i, *v[:3], 255, float(v[3]), v[4], MAX_STYLE_ZOOM, (s, k) not in HIDDEN) for s, vs in STYLES.items() for i, (k, v) in enumerate(zip(KINDS, vs))]
    return spark.createDataFrame(rows, "style string, version int, kind string, code int, r int, g int, b int, a int, width_px float, min_zoom int, max_zoom int, visible boolean")


def style_or(wanted: Column, before: Column) -> Column:
    """A built-in style by id; an unknown id leaves the one before."""
    return F.when(wanted.isin(*STYLES), wanted).otherwise(before)


def shown(zoom: Column) -> Column:
    return F.col("visible") & zoom.between(F.col("min_zoom"), F.col("max_zoom"))


# Names of codes, by code.
TILE_TYPES = ("unknown", "mvt", "png", "jpeg", "webp", "avif")
RULES = ("none", "required_field", "bounds", "zoom_range", "compatibility", "provenance", "attribution", "archive", "identity")


def name_of(code: Column, names: tuple[str, ...], other: str = "unknown") -> Column:
    """Name of a code; codes out of range have the name ``other``."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.when(code >= 0, code.cast("int")).otherwise(len(names))), F.lit(other))


# Fixed value: the version that cached pictures carry.
RENDERER = 1


def cache_key(pack_id: Column, style: Column, version: Column) -> Column:
    """What a cached picture of a tile depends on, beside the tile."""
    return F.struct(fnv1a(pack_id).alias("pack"), fnv1a(style).alias("style"), version.alias("version"), F.lit(RENDERER).alias("renderer"))


# Fixed value: kinds hidden while the map is dragged.
DRAG_HIDDEN = ("minor_road", "secondary_road", "rail", "building", "park", "boundary", *LABELS)


def drag_style(rules: DataFrame) -> DataFrame:
    """A style for a map that is being dragged."""
    return rules.withColumn("visible", F.col("visible") & ~F.col("kind").isin(*DRAG_HIDDEN))


def rgb565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.bitwiseAND(0xF8), 8).bitwiseOR(F.shiftleft(g.bitwiseAND(0xFC), 3)).bitwiseOR(F.shiftright(b, 3))


def stroke_px(width: Column) -> Column:
    """Whole pixels of a stroke: 0 for none, 1 up to 1, else rounded, 2 to 64."""
    return F.when(width.isNull() | F.isnan(width) | (width <= 0) | (width == float("inf")), 0).when(width <= 1, 1).otherwise(F.least(F.greatest(F.floor(width + 0.5), F.lit(2)), F.lit(64))).cast("int")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as an unsigned number."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(F.hex(text.cast("binary")), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    body = F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.octet_length(text) > 0, body).otherwise(F.lit(2166136261).cast("long"))
