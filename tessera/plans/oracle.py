"""SQL for the registered queries, for DuckDB on the same tables. Written from
the definitions, not from the plans."""

from __future__ import annotations

from tessera.functions import kinds
from tessera.functions.geo import MAX_LAT

PI = "3.141592653589793::DOUBLE"


def lon(k):
    return f"(CAST((CAST({k} AS BIGINT) * 7919) % 3600000 AS DOUBLE) / 10000.0::DOUBLE - 180.0::DOUBLE)"


def lat(k):
    return f"(CAST((CAST({k} AS BIGINT) * 104729) % 1700000 AS DOUBLE) / 10000.0::DOUBLE - 85.0::DOUBLE)"


def pmod(a, b):
    return f"(((({a}) % ({b})) + ({b})) % ({b}))"


def wrap(x):
    return f"({pmod(f'({x}) + 180.0::DOUBLE', '360.0::DOUBLE')} - 180.0::DOUBLE)"


def clampl(x):
    return f"least(greatest({x}, -{MAX_LAT}::DOUBLE), {MAX_LAT}::DOUBLE)"


def n(z):
    return f"(1::BIGINT << ({z})::INTEGER)::DOUBLE"


def tx(x, z):
    return f"(({wrap(x)} + 180.0::DOUBLE) / 360.0::DOUBLE * {n(z)})"


def ty(y, z):
    return f"((1.0::DOUBLE - asinh(tan(radians({clampl(y)}))) / {PI}) / 2.0::DOUBLE * {n(z)})"


def idx(v, z):
    return f"CAST(least(greatest(floor({v}), 0), {n(z)} - 1) AS BIGINT)"


def lonof(x, z):
    return f"({pmod(x, n(z))} / {n(z)} * 360.0::DOUBLE - 180.0::DOUBLE)"


def latof(y, z):
    return f"degrees(atan(sinh({PI} * (1.0::DOUBLE - 2.0::DOUBLE * (least(greatest({y}, 0.0::DOUBLE), {n(z)}) / {n(z)})))))"


def r6(x):
    return f"round({x} + 3.7e-8::DOUBLE, 6) + 0.0::DOUBLE"


PLACES = f"(SELECT event_id, {lon('event_id')} AS lon, {lat('event_id')} AS lat, event_type, value FROM events)"
VIEWS = f"""(SELECT *, {tx('lon', 'zoom')} AS cx, {ty('lat', 'zoom')} AS cy, 1::BIGINT << zoom AS n FROM (SELECT n_nationkey AS view_id, {lat('n_nationkey::BIGINT * 31 + 7')} AS lat, {lon('n_nationkey::BIGINT * 31 + 7')} AS lon, n_nationkey % 15 AS zoom,
 CASE n_nationkey % 3 WHEN 0 THEN 1280 WHEN 1 THEN 320 ELSE 480 END AS width, CASE n_nationkey % 3 WHEN 0 THEN 720 WHEN 1 THEN 170 ELSE 320 END AS height, 256 AS ts FROM nation))"""
RANGES = f"""(SELECT *, CAST(floor(cx - width * 0.5::DOUBLE / ts) AS BIGINT) AS x0, CAST(ceil(cx + width * 0.5::DOUBLE / ts) AS BIGINT) - 1 AS x1,
 greatest(CAST(floor(cy - height * 0.5::DOUBLE / ts) AS BIGINT), 0) AS y0, least(CAST(ceil(cy + height * 0.5::DOUBLE / ts) AS BIGINT) - 1, n - 1) AS y1 FROM {VIEWS})"""
PLACED = f"(SELECT view_id, zoom, n, y, ux, (y - y0) * (x1 - x0 + 1) + ux - x0 AS ordinal FROM (SELECT *, unnest(range(x0, x1 + 1)) AS ux FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM {RANGES})))"
SEEN = f"(SELECT view_id, zoom, y, {pmod('x0 + k', 'n')} AS x, (y - y0) * cnt + k AS ordinal FROM (SELECT *, unnest(range(0, cnt)) AS k FROM (SELECT *, least(x1 - x0 + 1, n) AS cnt, unnest(range(y0, y1 + 1)) AS y FROM {RANGES})))"
TILES = f"(SELECT event_id, z, {idx(tx('lon', 'z'), 'z')} AS x, {idx(ty('lat', 'z'), 'z')} AS y FROM (SELECT *, CAST(event_id % 17 AS INTEGER) AS z FROM {PLACES}))"
def density(top):
    return f"(SELECT z, x, y, count(*) AS n FROM (SELECT z, {idx(tx('lon', 'z'), 'z')} AS x, {idx(ty('lat', 'z'), 'z')} AS y FROM (SELECT *, CAST(unnest(range(0, {top})) AS INTEGER) AS z FROM {PLACES})) GROUP BY z, x, y)"


def slon(x):
    return lonof(f"(cx + (({x}) - width * 0.5::DOUBLE) / ts)", "zoom")


def slat(y):
    return latof(f"(cy + (({y}) - height * 0.5::DOUBLE) / ts)", "zoom")


def delta(x, cx, nn):
    return f"(({x}) - ({cx}) - {nn} * floor((({x}) - ({cx}) + {nn} * 0.5::DOUBLE) / {nn}))"


BOXES = f"""(SELECT *, CASE WHEN max_lon - min_lon < 0 THEN max_lon - min_lon + 360 ELSE max_lon - min_lon END AS span, {ty('max_lat', '0')} AS ny, {ty('min_lat', '0')} AS sy FROM (
 SELECT s_suppkey, {lon('s_suppkey')} * 0.9::DOUBLE - h AS min_lon, {lat('s_suppkey')} * 0.9::DOUBLE - h AS min_lat, {lon('s_suppkey')} * 0.9::DOUBLE + h AS max_lon, {lat('s_suppkey')} * 0.9::DOUBLE + h AS max_lat FROM (SELECT *, (s_suppkey % 13)::DOUBLE * 0.5::DOUBLE + 0.25::DOUBLE AS h FROM supplier)))"""
MID = f"{r6(latof('((ny + sy) * 0.5::DOUBLE)', '0'))} AS lat, {r6(wrap('min_lon + span * 0.5::DOUBLE'))} AS lon"
FILL = "(SELECT min(z) FROM range(0, 32) t(z) WHERE 1280 <= span / 360.0::DOUBLE * (1::BIGINT << z::INTEGER) * 256 AND 600 <= (sy - ny) * (1::BIGINT << z::INTEGER) * 256)"
FILLED = f"(SELECT *, CAST({FILL} AS INTEGER) AS fill FROM {BOXES})"

ARRAYS = {
    "layer": "['water', 'roads', 'transportation', 'building', 'park', 'landcover', 'landuse', 'boundary', 'place', 'aeroway', 'earth', 'poi', 'places', 'boundaries', 'buildings', 'housenumber', 'land'][l_partkey % 17 + 1]",
    "class": "['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'rail', 'service', 'forest', 'residential', 'park', 'farm', NULL][l_suppkey % 12 + 1]",
    "subclass": "['park', 'garden', 'rail', 'wood', NULL][l_orderkey % 5 + 1]",
    "kind": "['highway', 'major_road', 'minor_road', 'path', 'rail', 'aeroway', 'country', 'locality', 'earth', 'building', 'forest', 'garden', '', NULL][(l_suppkey + l_partkey) % 14 + 1]",
    "kind_detail": "['secondary', 'tertiary_link', 'village', 'hamlet', NULL][l_partkey % 5 + 1]",
    "geometry": "['point', 'linestring', 'polygon', 'unknown'][(l_orderkey + l_linenumber) % 4 + 1]",
}
ROADS = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f'{v} AS "{k}"' for k, v in ARRAYS.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey)"
ROAD = "CASE WHEN class = 'rail' OR subclass = 'rail' THEN 'rail' WHEN class IS NULL THEN 'minor_road' WHEN class IN ('motorway', 'trunk') THEN 'motorway' WHEN class = 'primary' THEN 'primary_road' WHEN class IN ('secondary', 'tertiary') THEN 'secondary_road' ELSE 'minor_road' END"
OMT = f"""CASE WHEN layer IN ('water', 'waterway', 'ocean') THEN 'water' WHEN layer IN ('road', 'roads', 'transportation', 'transport') THEN {ROAD} WHEN layer IN ('rail', 'railway') THEN 'rail' WHEN layer IN ('building', 'buildings') THEN 'building'
 WHEN layer = 'park' THEN CASE WHEN geometry = 'polygon' THEN 'park' ELSE 'label_primary' END WHEN layer = 'landcover' THEN CASE WHEN subclass IN ('park', 'recreation_ground', 'garden') THEN 'park' ELSE 'land' END WHEN layer IN ('land', 'earth') THEN 'land'
 WHEN layer = 'landuse' THEN CASE WHEN class IN ('pitch', 'playground', 'cemetery', 'forest', 'grass', 'park') THEN 'park' WHEN class IN ('residential', 'commercial', 'industrial', 'retail', 'school', 'kindergarten', 'military', 'railway', 'stadium', 'track', 'bus_station') THEN 'land' END
 WHEN layer IN ('boundary', 'boundaries') THEN 'boundary' WHEN layer IN ('airport', 'aerodrome', 'aerodrome_label', 'aeroway') THEN 'airport' WHEN layer IN ('place', 'place_label', 'poi') THEN 'label_primary' END"""
OVERVIEW = "CASE WHEN layer = 'land' THEN 'land' WHEN layer IN ('water', 'waterway') THEN 'water' WHEN layer = 'boundary' THEN 'boundary' WHEN layer = 'place' THEN 'label_primary' END"
PROTO = """CASE WHEN kind IS NULL OR kind = '' THEN NULL
 WHEN layer = 'roads' AND geometry = 'linestring' THEN CASE kind WHEN 'rail' THEN 'rail' WHEN 'aeroway' THEN 'airport' WHEN 'highway' THEN 'motorway' WHEN 'major_road' THEN CASE WHEN kind_detail IN ('secondary', 'secondary_link', 'tertiary', 'tertiary_link') THEN 'secondary_road' ELSE 'primary_road' END WHEN 'minor_road' THEN 'minor_road' WHEN 'path' THEN 'minor_road' END
 WHEN layer = 'boundaries' AND geometry = 'linestring' THEN 'boundary' WHEN layer = 'water' THEN CASE WHEN geometry IN ('polygon', 'linestring') THEN 'water' WHEN geometry = 'point' THEN 'label_muted' END
 WHEN layer = 'places' AND geometry = 'point' THEN CASE WHEN kind IN ('country', 'region', 'locality') THEN CASE WHEN kind_detail IN ('village', 'hamlet', 'isolated_dwelling') THEN 'label_secondary' ELSE 'label_primary' END END
 WHEN layer = 'earth' AND geometry = 'polygon' THEN CASE WHEN kind = 'earth' THEN 'land' END
 WHEN layer IN ('landcover', 'landuse') AND geometry = 'polygon' THEN CASE WHEN kind IN ('forest', 'wood', 'park', 'national_park', 'nature_reserve', 'protected_area', 'recreation_ground', 'garden', 'golf_course') THEN 'park' ELSE 'land' END
 WHEN layer = 'buildings' AND geometry = 'polygon' THEN CASE WHEN kind = 'building' THEN 'building' END END"""
STYLES = ", ".join(f"('{s}', '{k}', {r}, {g}, {b}, {w}::FLOAT, {z}, {str((s, k) not in kinds.HIDDEN).lower()})" for s, v in kinds.STYLES.items() for k, (r, g, b, w, z) in zip(kinds.KINDS, v))
STYLED = f"""(SELECT style, kind, CAST(zoom AS INTEGER) AS zoom, visible AND zoom BETWEEN min_zoom AND 24 AS shown, ((r & 248) << 8) | ((g & 252) << 3) | (b >> 3) AS rgb565, CAST(CASE WHEN w <= 1 THEN 1 ELSE floor(w + 0.5) END AS INTEGER) AS px
 FROM (VALUES {STYLES}) t(style, kind, r, g, b, w, min_zoom, visible), range(0, 32) q(zoom))"""


def e7(x):
    return f"CAST(CASE WHEN {x} >= 0 THEN floor({x} * 10000000::DOUBLE + 0.5) ELSE ceil({x} * 10000000::DOUBLE - 0.5) END AS BIGINT)"


PACKS0 = """(SELECT s_suppkey AS ordinal, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'r-' || (s_suppkey % 40) END AS region_id, CASE WHEN s_suppkey % 17 = 0 THEN 'other-1' WHEN s_suppkey % 3 = 0 THEN 'protomaps-v4' ELSE 'openmaptiles-3.16' END AS schema_version, 'Snap' || (s_suppkey % 4) AS source_snapshot,
 CASE WHEN s_suppkey % 19 = 0 THEN 'closed' ELSE 'open' END AS pack_class, (s_suppkey % 36 * 10)::DOUBLE - 180 AS min_lon, (s_suppkey % 15 * 10)::DOUBLE - 80 AS min_lat, CASE WHEN s_suppkey % 36 >= 33 THEN (s_suppkey % 36 * 10)::DOUBLE - 500 ELSE (s_suppkey % 36 * 10)::DOUBLE - 140 END AS max_lon,
 (s_suppkey % 15 * 10)::DOUBLE - CASE WHEN s_suppkey % 23 = 0 THEN 90 ELSE 60 END AS max_lat, s_suppkey % 4 AS min_zoom, CASE WHEN s_suppkey % 29 = 0 THEN 1 ELSE 8 + s_suppkey % 7 END AS max_zoom, s_suppkey % 5 AS priority, s_suppkey * 1000 % 7000 AS size_bytes, s_suppkey % 31 = 0 AS no_source, s_name FROM supplier)"""
IDENTITY = f"lower(source_snapshot) || '__' || lower(schema_version) || '__basemap__' || lower(region_id) || '__b' || {e7('min_lon')} || '_' || {e7('min_lat')} || '_' || {e7('max_lon')} || '_' || {e7('max_lat')} || '__z' || min_zoom || '-' || max_zoom"
PACKS = f"""(SELECT *, CASE WHEN error = 'none' AND row_number() OVER (PARTITION BY pack_id, error = 'none' ORDER BY ordinal) > 1 THEN 'duplicate' ELSE error END AS status FROM (
 SELECT *, CASE WHEN region_id = '' OR s_name = '' THEN 'required_field' WHEN min_lat > max_lat OR abs(min_lat) > {MAX_LAT} OR abs(max_lat) > {MAX_LAT} OR abs(min_lon) > 180 OR abs(max_lon) > 180 THEN 'bounds' WHEN min_zoom > max_zoom THEN 'zoom_range' WHEN schema_version = 'other-1' OR pack_class = 'closed' THEN 'compatibility' WHEN no_source THEN 'provenance'
 WHEN size_bytes = 0 THEN 'archive' WHEN pack_id <> {IDENTITY} THEN 'identity' ELSE 'none' END AS error FROM (SELECT *, CASE WHEN ordinal % 13 = 0 THEN 'wrong' ELSE {IDENTITY} END AS pack_id FROM {PACKS0})))"""
REQUESTS = f"(SELECT req_id, zoom, lon - 1 AS w, lat - 1 AS s, lon + 1 AS e, lat + 1 AS n FROM (SELECT n_nationkey AS req_id, n_nationkey % 12 AS zoom, {lon('n_nationkey::BIGINT * 101 + 3')} * 0.9::DOUBLE AS lon, {lat('n_nationkey::BIGINT * 101 + 3')} * 0.7::DOUBLE AS lat FROM nation))"
INSIDE = "min_lat <= s AND n <= max_lat AND CASE WHEN min_lon <= max_lon THEN min_lon <= w AND e <= max_lon ELSE w >= min_lon OR e <= max_lon END"
MEETS = "min_lon <= e AND w <= max_lon AND min_lat <= n AND s <= max_lat"
ENCODED = "(SELECT p_partkey % 5 AS archive, p_partkey // 5 AS i, p_partkey % 3 + 1 AS run_length, CAST(p_size * 100 AS BIGINT) AS length, CASE WHEN p_partkey // 5 = 0 THEN p_partkey ELSE 5 END AS d_id, CASE WHEN p_partkey // 5 % 7 = 0 THEN p_partkey * 1000 + 1 ELSE 0 END AS raw FROM part)"
DIRECTORY = f"""(SELECT archive, i, CAST(tile_id AS BIGINT) AS tile_id, run_length, length, CAST(greatest(first_value(raw) OVER w - 1, 0) + coalesce(sum(length) OVER (PARTITION BY archive, island ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (
 SELECT *, sum(d_id) OVER (PARTITION BY archive ORDER BY i) AS tile_id, sum(CASE WHEN raw > 0 OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY archive ORDER BY i) AS island FROM {ENCODED}) WINDOW w AS (PARTITION BY archive, island ORDER BY i))"""
POINTS = "(SELECT l_orderkey AS ring, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey * 37 + l_linenumber * 911) % 4096, (l_suppkey * 53 + l_partkey * 17) % 4096) - 1 AS i, CAST((l_partkey * 37 + l_linenumber * 911) % 4096 AS INTEGER) AS x, CAST((l_suppkey * 53 + l_partkey * 17) % 4096 AS INTEGER) AS y FROM lineitem)"
AREA = f"""(SELECT o_custkey AS feature_id, ring, CAST(count(*) AS INTEGER) AS n_points, CAST(sum(x::BIGINT * y1 - x1::BIGINT * y) AS BIGINT) AS area2 FROM (SELECT ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM {POINTS} WINDOW w AS (PARTITION BY ring ORDER BY i)) JOIN orders ON o_orderkey = ring GROUP BY o_custkey, ring)"""
SEGMENTS = f"(SELECT ring, CAST(i AS INTEGER) AS i, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM {POINTS} WHERE ring IN (SELECT o_orderkey FROM orders) WINDOW w AS (PARTITION BY ring ORDER BY i))"
LABELS = "(SELECT p_partkey % 3 AS frame, p_partkey AS id, p_name AS text, CAST(p_partkey * 7 % 40 * 30 AS INTEGER) AS x, CAST(p_partkey * 11 % 30 * 20 AS INTEGER) AS y, CAST(trunc(CASE WHEN p_partkey % 4 < 2 THEN 20000 ELSE 10000 END + least(greatest(CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.5 ELSE 100 - p_size END, 0), 100) * 100) AS INTEGER) AS priority FROM part)"
KM = f"(SELECT s_suppkey, {lat('s_suppkey')} AS lat, {lon('s_suppkey')} AS lon, (s_suppkey % 50 + 1)::DOUBLE * 20 AS km FROM supplier)"
PAN = f"(SELECT *, {clampl(slat('height * 0.5::DOUBLE + 20'))} AS lat1, {wrap(slon('width * 0.5::DOUBLE + 45'))} AS lon1 FROM {VIEWS})"
ZOOMED = f"(SELECT *, least(greatest(zoom + view_id % 5 - 2, 0), 31) AS z1, {slat('60.0::DOUBLE')} AS alat, {slon('100.0::DOUBLE')} AS alon FROM {VIEWS})"

def along(num, den):
    """A place along a segment: as a double to compare, and as a fraction."""
    return f"{{'t': ({num})::DOUBLE / ({den}), 'num': ({num})::BIGINT, 'den': ({den})::BIGINT}}"


FIRST, LAST = along("0", "1"), along("1", "1")


def entering(v):
    return f"CASE WHEN d{v} > 0 THEN {along(f'512 - {v}0', f'd{v}')} WHEN d{v} < 0 THEN {along(f'{v}0 - 3583', f'-d{v}')} END"


def leaving(v):
    return f"CASE WHEN d{v} > 0 THEN {along(f'3583 - {v}0', f'd{v}')} WHEN d{v} < 0 THEN {along(f'{v}0 - 512', f'-d{v}')} END"


def clipped(v, t):
    return f"CAST(floor((2 * {t}.den * {v}0 + 2 * d{v} * {t}.num + {t}.den)::DOUBLE / (2 * {t}.den)) AS INTEGER)"


ORACLE = {
    "tile_of_point": f"SELECT * FROM {TILES}",
    "tile_corner": f"SELECT event_id, {r6(lonof('x::DOUBLE', 'z'))} AS lon, {r6(latof('y::DOUBLE', 'z'))} AS lat FROM {TILES}",
    "wrap_clamp": f"SELECT event_id, {r6(wrap('lon * 3.0::DOUBLE'))} AS lon, {r6(clampl('lat * 1.1::DOUBLE'))} AS lat FROM {PLACES}",
    "hilbert_tile_id": f"""WITH RECURSIVE t AS (SELECT * FROM {TILES}), h AS (SELECT event_id, z, x, y, (1::BIGINT << z) // 2 AS s, 0::BIGINT AS d FROM t UNION ALL
 SELECT event_id, z, CASE WHEN y & s <> 0 THEN x ELSE CASE WHEN x & s <> 0 THEN s - 1 - (y & (s - 1)) ELSE y & (s - 1) END END, CASE WHEN y & s <> 0 THEN y ELSE CASE WHEN x & s <> 0 THEN s - 1 - (x & (s - 1)) ELSE x & (s - 1) END END, s // 2, d + s * s * xor(CASE WHEN x & s <> 0 THEN 3 ELSE 0 END, CASE WHEN y & s <> 0 THEN 1 ELSE 0 END) FROM h WHERE s > 0)
 SELECT event_id, ((1::BIGINT << (2 * z)) - 1) // 3 + d AS tile_id, ((1::BIGINT << (2 * z)) - 1) // 3 AS before FROM h WHERE s = 0""",
    "tile_density_by_zoom": f"SELECT * FROM {density(9)}",
    "visible_tiles": f"SELECT * FROM {SEEN}",
    "tile_placements": f"SELECT view_id, zoom, {pmod('ux', 'n')} AS x, y, ux AS unwrapped_x, ordinal FROM {PLACED}",
    "distinct_tiles": f"SELECT view_id, {pmod('ux', 'n')} AS x, y, min(ordinal) AS ordinal, count(*) AS copies FROM {PLACED} GROUP BY 1, 2, 3",
    "present_missing_tiles": f"SELECT view_id, count(d.n) AS present, CAST(sum(CASE WHEN d.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS places FROM {SEEN} s LEFT JOIN {density(15)} d ON s.zoom = d.z AND s.x = d.x AND s.y = d.y GROUP BY view_id",
    "camera_bounds": f"SELECT view_id, {r6('CASE WHEN width >= n * ts THEN -180 ELSE ' + slon('0.0::DOUBLE') + ' END')} AS min_lon, {r6(slat('height::DOUBLE'))} AS min_lat, {r6('CASE WHEN width >= n * ts THEN 180 ELSE ' + slon('width::DOUBLE') + ' END')} AS max_lon, {r6(slat('0.0::DOUBLE'))} AS max_lat FROM {VIEWS}",
    "project_point": f"SELECT v.view_id, p.event_id, round(width * 0.5::DOUBLE + {delta(tx('p.lon', 'zoom'), 'cx', 'n')} * ts, 3) AS sx, round(height * 0.5::DOUBLE + ({ty('p.lat', 'zoom')} - cy) * ts, 3) AS sy FROM {PLACES} p JOIN {VIEWS} v ON p.event_id % 25 = v.view_id",
    "pan": f"SELECT view_id, {r6(clampl(slat('height * 0.5::DOUBLE - 20')))} AS lat, {r6(wrap(slon('width * 0.5::DOUBLE + 45')))} AS lon FROM {VIEWS}",
    "zoom_at_point": f"SELECT view_id, z1 AS zoom, {r6(clampl(latof('(' + ty('alat', 'z1') + ' - (60 - height * 0.5::DOUBLE) / ts)', 'z1')))} AS lat, {r6(wrap(lonof('(' + tx('alon', 'z1') + ' - (100 - width * 0.5::DOUBLE) / ts)', 'z1')))} AS lon FROM {ZOOMED}",
    "frame_transform": f"SELECT view_id, 1.0::DOUBLE AS scale, round({delta('cx', tx('lon1', 'zoom'), 'n')} * ts, 3) AS dx, round((cy - {ty('lat1', 'zoom')}) * ts, 3) AS dy FROM {PAN}",
    "fit_bounds": f"SELECT s_suppkey, CAST(coalesce((SELECT max(z) FROM range(0, 32) t(z) WHERE span / 360.0::DOUBLE * (1::BIGINT << z::INTEGER) * 256 <= 1232 AND (sy - ny) * (1::BIGINT << z::INTEGER) * 256 <= 552), 0) AS INTEGER) AS zoom, {MID} FROM {BOXES}",
    "fill_bounds": f"SELECT s_suppkey, fill AS zoom, 2 AS world_zoom, {MID} FROM {FILLED}",
    "zoom_floor": f"SELECT s_suppkey % 4 AS lo, CAST(min(CASE WHEN fill <= 9 + s_suppkey % 4 THEN least(greatest(fill, s_suppkey % 4), 9 + s_suppkey % 4) END) AS BIGINT) AS floor, count(*) AS packs FROM {FILLED} GROUP BY 1",
    "picker_zoom_range": f"SELECT s_suppkey, CAST(coalesce(least(greatest(fill, s_suppkey % 4), 6 + s_suppkey % 9), s_suppkey % 4) AS INTEGER) AS min_zoom, CAST(6 + s_suppkey % 9 AS INTEGER) AS max_zoom FROM {FILLED}",
    "classify_openmaptiles": f"SELECT layer, class, subclass, geometry, {OMT} AS kind_out, count(*) AS n FROM {ROADS} GROUP BY ALL",
    "classify_overview": f"SELECT layer, {OVERVIEW} AS kind_out, count(*) AS n FROM {ROADS} GROUP BY ALL",
    "classify_protomaps": f"SELECT layer, kind, kind_detail, geometry, {PROTO} AS kind_out, count(*) AS n FROM {ROADS} GROUP BY ALL",
    "kinds_by_layer": f"SELECT layer, coalesce({OMT}, 'skipped') AS k, count(*) AS n FROM {ROADS} WHERE layer NOT IN {kinds.TEXT_LAYERS} GROUP BY ALL",
    "layer_geom_rollup": f"SELECT layer, geometry, count(*) AS n, CAST(grouping(layer, geometry) AS INTEGER) AS level FROM {ROADS} GROUP BY ROLLUP (layer, geometry)",
    "sample_values": f"SELECT layer, class, CAST(place AS INTEGER) AS place FROM (SELECT layer, class, row_number() OVER (PARTITION BY layer ORDER BY a, class) AS place FROM (SELECT layer, class, min(row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS a FROM {ROADS} WHERE class IS NOT NULL GROUP BY ALL)) WHERE place <= 8",
    "style_resolve": f"SELECT * FROM {STYLED}",
    "visible_kinds_by_zoom": f"SELECT style, zoom, count(*) AS kinds FROM {STYLED} WHERE shown GROUP BY ALL",
    "cache_key_fnv": "WITH RECURSIVE b AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part), f AS (SELECT p_partkey, h, 1 AS i, 2166136261::BIGINT AS v FROM b UNION ALL SELECT p_partkey, h, i + 2, (xor(v, (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1) * 16777619) & 4294967295 FROM f WHERE i < length(h)) SELECT p_partkey, v AS fnv FROM f WHERE i > length(h)",
    "pack_identity": f"SELECT ordinal, {IDENTITY} AS identity FROM {PACKS0}",
    "pack_validate": f"SELECT ordinal, status FROM {PACKS}",
    "pack_resolve": f"SELECT r.req_id, b.pack_id FROM {REQUESTS} r LEFT JOIN (SELECT req_id, max(row(priority, pack_id)) AS m, last(pack_id ORDER BY priority, pack_id) AS pack_id FROM {REQUESTS}, {PACKS} WHERE status = 'none' AND zoom BETWEEN min_zoom AND max_zoom AND {INSIDE} GROUP BY req_id) b USING (req_id)",
    "pack_resolve_tiered": f"SELECT r.req_id, CASE WHEN a.pack_id IS NOT NULL THEN 1 WHEN b.pack_id IS NOT NULL THEN 2 ELSE 0 END AS tier, coalesce(a.pack_id, b.pack_id) AS pack_id FROM {REQUESTS} r LEFT JOIN (SELECT req_id, last(pack_id ORDER BY priority, pack_id) AS pack_id FROM {REQUESTS}, {PACKS} WHERE status = 'none' AND zoom BETWEEN min_zoom AND max_zoom AND {INSIDE} GROUP BY req_id) a USING (req_id) LEFT JOIN (SELECT req_id, first(pack_id ORDER BY priority DESC, ordinal) AS pack_id FROM {REQUESTS}, {PACKS} WHERE status = 'none' AND zoom BETWEEN min_zoom AND max_zoom AND {MEETS} GROUP BY req_id) b USING (req_id)",
    "radius_bbox": f"SELECT s_suppkey, {r6('CASE WHEN dl >= 180 THEN -180 ELSE greatest(lon - dl, -180) END')} AS min_lon, {r6('greatest(lat - km / 111.32::DOUBLE, -85.0511287798066::DOUBLE)')} AS min_lat, {r6('CASE WHEN dl >= 180 THEN 180 ELSE least(lon + dl, 180) END')} AS max_lon, {r6('least(lat + km / 111.32::DOUBLE, 85.0511287798066::DOUBLE)')} AS max_lat FROM (SELECT *, km / (111.32::DOUBLE * cos(radians(least(abs(lat) + km / 111.32::DOUBLE, 89.9::DOUBLE)))) AS dl FROM {KM})",
    "directory_decode": f"SELECT * FROM {DIRECTORY}",
    "asof_tile_lookup": f'SELECT event_id, e.archive, e.tile_id, CASE WHEN e.tile_id < d.tile_id + d.run_length THEN d."offset" END AS "offset", CASE WHEN e.tile_id < d.tile_id + d.run_length THEN d.length END AS length FROM (SELECT event_id, event_id * 3 % 2500 AS tile_id, archive FROM events, (SELECT DISTINCT p_partkey % 5 AS archive FROM part)) e ASOF LEFT JOIN {DIRECTORY} d ON e.archive = d.archive AND e.tile_id >= d.tile_id',
    "size_summary": "SELECT p_brand, count(*) AS n, min(p_size) AS min, list_sort(list(p_size))[count(*) // 2 + 1] AS upper_median, max(p_size) AS max FROM part GROUP BY p_brand",
    "ring_area": f"SELECT * FROM {AREA}",
    "ring_parts": f"""WITH a AS (SELECT *, sign(area2) AS sg FROM {AREA} WHERE n_points >= 3), o AS (SELECT feature_id, arg_min(sg, ring) AS outer_sign FROM a WHERE sg <> 0 GROUP BY feature_id)
 SELECT feature_id, ring, CAST(sum(CASE WHEN r = 1 OR sg = outer_sign THEN 1 ELSE 0 END) OVER (PARTITION BY feature_id ORDER BY ring) AS BIGINT) AS part FROM (SELECT a.*, outer_sign, row_number() OVER (PARTITION BY feature_id ORDER BY ring) AS r FROM a LEFT JOIN o USING (feature_id))""",
    "band_shapes": f"SELECT ring, CAST(unnest(range(greatest(y0, 0) // 256, least(y1, 4095) // 256 + 1)) AS BIGINT) AS band FROM (SELECT ring, min(y) AS y0, max(y) AS y1 FROM {POINTS} WHERE ring IN (SELECT o_orderkey FROM orders) GROUP BY ring) WHERE y1 >= 0 AND y0 < 4096",
    "band_load": f"SELECT band, count(*) AS shapes FROM (SELECT ring, CAST(unnest(range(greatest(y0, 0) // 256, least(y1, 4095) // 256 + 1)) AS BIGINT) AS band FROM (SELECT ring, min(y) AS y0, max(y) AS y1 FROM {POINTS} WHERE ring IN (SELECT o_orderkey FROM orders) GROUP BY ring) WHERE y1 >= 0 AND y0 < 4096) GROUP BY band",
    "painted_bounds": f"SELECT ring, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {POINTS} WHERE ring IN (SELECT o_orderkey FROM orders) GROUP BY ring",
    "line_segments": f"SELECT * FROM {SEGMENTS} WHERE x1 IS NOT NULL",
    "clip_segments": f"""WITH s AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM {SEGMENTS} WHERE x1 IS NOT NULL), t AS (SELECT *, list_max([{FIRST}, {entering('x')}, {entering('y')}]) AS a, list_min([{LAST}, {leaving('x')}, {leaving('y')}]) AS b FROM s
 WHERE (dx <> 0 OR x0 BETWEEN 512 AND 3583) AND (dy <> 0 OR y0 BETWEEN 512 AND 3583)) SELECT ring, i, {clipped('x', 'a')} AS x0, {clipped('y', 'a')} AS y0, {clipped('x', 'b')} AS x1, {clipped('y', 'b')} AS y1 FROM t WHERE a.t <= b.t""",
    "project_q16": "SELECT p_partkey, CAST(floor((ox + x * sc) / 65536.0::DOUBLE) AS INTEGER) AS px FROM (SELECT p_partkey, CAST((p_partkey * 37) % 5000 - 400 AS BIGINT) AS x, CAST(floor(256 / 4096.0::DOUBLE * 65536 + 0.5) AS BIGINT) AS sc, CAST(floor(round(0.5::DOUBLE * CASE (p_partkey % 25) % 3 WHEN 0 THEN 1280 WHEN 1 THEN 320 ELSE 480 END - (p_partkey % 25) * 300.25::DOUBLE, 6) * 65536 + 0.5) AS BIGINT) AS ox FROM part)",
    "label_priority": f"SELECT id, priority FROM {LABELS}",
    "label_pool": f"SELECT frame, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY priority DESC, id, text, x, y) AS place FROM (SELECT * FROM {LABELS} QUALIFY row_number() OVER (PARTITION BY frame, x, y, text ORDER BY priority DESC, id, text, x, y) = 1)) WHERE place <= 128",
    "label_utf8_valid": "SELECT p_partkey, strlen(t) BETWEEN 1 AND 95 AND NOT contains(t, chr(9)) AS ok FROM (SELECT p_partkey, p_name || repeat('é', CAST(p_partkey % 60 AS INTEGER)) || CASE WHEN p_partkey % 9 = 0 THEN chr(9) ELSE '' END AS t FROM part)",
    "stage_means": "SELECT *, round(total_ms::DOUBLE / frames, 6) AS mean_ms, round(CASE WHEN total_ms > 0 THEN 1000.0::DOUBLE * frames / total_ms ELSE 0 END, 6) AS fps FROM (SELECT event_type, count(*) AS frames, min(ms) AS min_ms, max(ms) AS max_ms, CAST(sum(ms) AS BIGINT) AS total_ms FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS ms FROM events) GROUP BY event_type)",
    "attribution_required": "SELECT credit, CAST(row_number() OVER (ORDER BY first_at) AS INTEGER) AS place, sources FROM (SELECT '© region ' || n_regionkey AS credit, min(n_nationkey) AS first_at, count(*) AS sources FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY 1)",
    "view_tile_kinds": f"""WITH p AS (SELECT *, CASE event_type WHEN 'view' THEN 'water' WHEN 'click' THEN 'minor_road' WHEN 'signup' THEN 'park' WHEN 'purchase' THEN 'building' ELSE 'label_primary' END AS kind FROM {PLACES}),
 t AS (SELECT zoom, {idx(tx('lon', 'zoom'), 'zoom')} AS x, {idx(ty('lat', 'zoom'), 'zoom')} AS y, kind FROM (SELECT *, CAST(unnest(range(0, 15)) AS INTEGER) AS zoom FROM p)), g AS (SELECT zoom, x, y, kind, count(*) AS n FROM t GROUP BY ALL)
 SELECT view_id, s.zoom, s.x, s.y, g.kind, g.n, y.shown FROM {SEEN} s JOIN g ON s.zoom = g.zoom AND s.x = g.x AND s.y = g.y JOIN {STYLED} y ON y.style = 'standard-light' AND y.kind = g.kind AND y.zoom = s.zoom""",
}
