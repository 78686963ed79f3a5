"""SQL for the host queries, for DuckDB, written from the rules."""

from __future__ import annotations

from tessera.functions import kinds, wire
from tessera.operators import manifests
from tessera.plans import oracle as o
from tessera.plans.host_inputs import CLASSES, P, RIGHTS, source

D = "::DOUBLE"
PD = CLASSES[:4]
NAMED, TARGETS, RECTS = source("named"), source("targets"), source("rects")
EDGES = ("min_lon", "min_lat", "max_lon", "max_lat")


def lit(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def names(values) -> str:
    return "list_value(" + ", ".join(f"'{v}'" for v in values) + ")"


HILBERT = f"""WITH RECURSIVE t AS (SELECT * FROM {source('wanted')}), h AS (SELECT event_id, archive, z, x, y, x AS x0, y AS y0, (1::BIGINT << z) // 2 AS s, 0::BIGINT AS d FROM t UNION ALL
 SELECT event_id, archive, z, CASE WHEN y & s <> 0 THEN x ELSE CASE WHEN x & s <> 0 THEN s - 1 - (y & (s - 1)) ELSE y & (s - 1) END END, CASE WHEN y & s <> 0 THEN y ELSE CASE WHEN x & s <> 0 THEN s - 1 - (x & (s - 1)) ELSE x & (s - 1) END END, x0, y0, s // 2, d + s * s * xor(CASE WHEN x & s <> 0 THEN 3 ELSE 0 END, CASE WHEN y & s <> 0 THEN 1 ELSE 0 END) FROM h WHERE s > 0),
 i AS (SELECT event_id, archive, z, x0 AS x, y0 AS y, ((1::BIGINT << (2 * z)) - 1) // 3 + d AS tile_id FROM h WHERE s = 0)"""
SHAPES = f"(SELECT *, row_number() OVER (PARTITION BY tile_id, layer ORDER BY k) - 1 AS place FROM {source('shapes')})"
BROKEN = "CASE s_suppkey % 16 WHEN 1 THEN 'malformed' WHEN 2 THEN 'not-an-object' WHEN 3 THEN 'wrong-type' WHEN 4 THEN 'missing-field' WHEN 5 THEN 'out-of-range' WHEN 6 THEN 'too-deep' WHEN 7 THEN 'too-large' WHEN 8 THEN 'malformed' WHEN 11 THEN 'missing-field' WHEN 12 THEN 'wrong-type' WHEN 14 THEN 'malformed' ELSE 'none' END"
PACK = "'p' || lpad(CAST(ordinal AS VARCHAR), 8, '0')"
FOUND = f"""(SELECT *, CASE WHEN unreadable THEN 'unreadable' WHEN json <> 'none' THEN 'bad-json' WHEN error <> 'none' THEN 'invalid-manifest' WHEN ordinal % 7 = 2 THEN 'archive-missing' WHEN ordinal % 9 = 4 THEN 'archive-size-mismatch' END AS reason
 FROM (SELECT *, ordinal % 25 = 3 AS unreadable, CASE ordinal % 16 WHEN 1 THEN 'malformed' WHEN 2 THEN 'not-an-object' WHEN 4 THEN 'missing-field' ELSE 'none' END AS json FROM {o.PACKS}))"""


def _audit() -> str:
    r = f"(SELECT *, NOT broken AND coalesce(id, '') <> '' AS usable FROM {source('records')})"
    p = f"(SELECT *, CASE WHEN usable THEN row_number() OVER (PARTITION BY id, usable ORDER BY file) END AS place FROM {r})"
    rules = [("broken", "invalid-json", ""), ("NOT broken AND coalesce(id, '') = ''", "missing-field", "id"), ("place IS NOT NULL AND id <> stem", "id-filename-mismatch", "id"), ("place > 1", "duplicate-id", "id")]
    flags = (*RIGHTS, "official_pack_allowed", "clean_pack_allowed")
    rules += [(f"place = 1 AND {x} IS NULL", "missing-field", x) for x in ("name", "publisher", "url", "retrieved", "license", "license_class", "rights_url", "reviewed_date", "confidence", *flags)]
    rules += [(f"place = 1 AND {x} NOT IN ('true', 'false')", "wrong-type", x) for x in flags]
    known = f"place = 1 AND license_class IN {lit(CLASSES[:11])}"
    rules += [("place = 1 AND license_class = 'WEIRD'", "unknown-license-class", "license_class"), (f"{known} AND confidence = 'MAYBE'", "unknown-confidence", "confidence")]
    must = {"commercial_use_allowed": ((*PD, "ODBL"), ("NONCOMMERCIAL",)), "redistribution_allowed": ((*PD, "ODBL"), ()), "modification_allowed": ((*PD, "ODBL"), ("NO_DERIVATIVES",)), "attribution_required": (("ODBL",), ()), "share_alike_required": (("ODBL",), (*PD, "PERMISSIVE_ATTRIBUTION", "CDLA_PERMISSIVE", "PROPRIETARY_APPROVED"))}
    for field, sides in must.items():
        wrong = " OR ".join(f"(license_class IN {lit(cls)} AND {field} <> '{v}')" for v, cls in zip(("true", "false"), sides) if cls)
        rules.append((f"{known} AND ({wrong})", "license-class-mismatch", field))
    for rule, code, field in (
        (f"clean_pack_allowed = 'true' AND license_class NOT IN {lit(PD)}", "clean-pack-not-eligible", "clean_pack_allowed"), ("official_pack_allowed = 'true' AND license_class = 'UNKNOWN'", "unknown-not-official", "official_pack_allowed"),
        ("official_pack_allowed = 'true' AND license_class = 'NONCOMMERCIAL'", "noncommercial-not-official", "official_pack_allowed"), ("official_pack_allowed = 'true' AND confidence = 'REVIEW_REQUIRED'", "review-required-not-official", "official_pack_allowed"), ("clean_pack_allowed = 'true' AND confidence = 'REVIEW_REQUIRED'", "review-required-not-clean", "clean_pack_allowed"),
    ):
        rules.append((f"{known} AND {rule}", code, field))
    rules += [(f"place = 1 AND NOT ({x} LIKE 'http://%' OR {x} LIKE 'https://%')", "bad-url", x) for x in ("url", "rights_url")]
    rules += [(f"place = 1 AND NOT regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')", "bad-date", x) for x in ("retrieved", "reviewed_date")]
    return f"WITH p AS (SELECT * FROM {p}) " + " UNION ALL ".join(f"SELECT file, '{code}' AS code, '{field}' AS field FROM p WHERE {rule}" for rule, code, field in rules)


def _fault(credits: str, links: str, ids: str) -> str:
    c, l, i = (f"coalesce({x}, CAST([] AS VARCHAR[]))" for x in (credits, links, ids))  # noqa: E741
    return f"""CASE WHEN schema_version LIKE 'openmaptiles-%' THEN CASE WHEN NOT list_contains({i}, 'openmaptiles') THEN 'missing-schema-provenance' WHEN len(list_filter({c}, lambda x: contains(x, 'OpenMapTiles'))) = 0 THEN 'missing-schema-attribution'
 WHEN NOT list_contains({l}, 'https://openmaptiles.org/') THEN 'missing-schema-attribution-link' WHEN len(list_filter({c}, lambda x: contains(x, 'Â'))) > 0 THEN 'mangled-attribution-encoding' END END"""


CREDITED = f"""(SELECT *, {_fault('required_attribution', 'attribution_links', 'provenance_ids')} AS fault, coalesce(list_filter(provenance_ids, lambda x: NOT (needs AND x = 'openmaptiles'))[1], provenance_ids[1]) AS primary_id,
 CASE WHEN needs AND len(list_filter(c0, lambda x: contains(x, '© OpenMapTiles'))) = 0 THEN list_prepend('© OpenMapTiles', c0) ELSE c0 END AS c1, CASE WHEN needs AND NOT list_contains(l0, 'https://openmaptiles.org/') THEN list_prepend('https://openmaptiles.org/', l0) ELSE l0 END AS l1, CASE WHEN needs AND NOT list_contains(i0, 'openmaptiles') THEN list_append(i0, 'openmaptiles') ELSE i0 END AS i1
 FROM (SELECT *, schema_version LIKE 'openmaptiles-%' AS needs, coalesce(required_attribution, CAST([] AS VARCHAR[])) AS c0, coalesce(attribution_links, CAST([] AS VARCHAR[])) AS l0, coalesce(provenance_ids, CAST([] AS VARCHAR[])) AS i0 FROM {source('credited')}))"""
BUILT = f"""(SELECT *, CASE WHEN NOT a AND NOT m THEN 'absent' WHEN NOT a OR NOT m OR k % 11 = 3 THEN 'incomplete' WHEN k % 17 = 2 THEN 'not-an-archive' WHEN k % 13 = 0 OR k % 19 = 3 THEN 'header-zoom' WHEN k % 23 = 4 THEN 'corrupt' ELSE 'ready' END AS status
 FROM (SELECT *, k % 11 <> 1 AS a, NOT (k % 11 = 2 OR (k % 11 = 1 AND k % 2 = 0)) AS m FROM {TARGETS} WHERE fault_free))"""
COPIES = f"(SELECT *, {o.pmod('ux', 'n')} AS x FROM (SELECT *, unnest(range(x0, x1 + 1)) AS ux FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM {o.RANGES})))"
Q16 = "CAST(floor(({}) * 65536 + 0.5) AS BIGINT)"
SCREEN = f"""WITH f AS (SELECT * FROM {source('polys')} WHERE CASE geom_type WHEN 'polygon' THEN points >= 3 WHEN 'linestring' THEN points >= 2 ELSE true END),
 kd AS (SELECT *, CASE layer WHEN 'water' THEN 'water' WHEN 'boundary' THEN 'boundary' WHEN 'land' THEN 'land' WHEN 'place' THEN 'label_primary' WHEN 'rail' THEN 'rail' END AS kind FROM f),
 j AS (SELECT v.view_id, v.zoom, v.ux, kd.k, kd.kind, kd.geom_type, kd.points, kd.px, kd.py, y.px AS stroke, {Q16.format('(v.ux - v.cx) * 256 + v.width * 0.5::DOUBLE')} AS ox, {Q16.format('(v.y - v.cy) * 256 + v.height * 0.5::DOUBLE')} AS oy FROM kd JOIN {COPIES} v ON v.zoom = kd.zoom AND v.x = kd.x AND v.y = kd.y JOIN {o.STYLED} y ON y.style = 'standard-light' AND y.kind = kd.kind AND y.zoom = kd.zoom AND y.shown WHERE kd.kind <> 'label_primary'),
 p AS (SELECT *, CAST(floor((ox + (px + 40 * i) * 4096) / 65536.0::DOUBLE) AS BIGINT) AS sx, CAST(floor((oy + (py + (i % 3) * 90) * 4096) / 65536.0::DOUBLE) AS BIGINT) AS sy FROM (SELECT *, unnest(range(points)) AS i FROM j)),
 e AS (SELECT *, coalesce(lead(sx) OVER w, first_value(sx) OVER w) AS sx1, coalesce(lead(sy) OVER w, first_value(sy) OVER w) AS sy1 FROM p WINDOW w AS (PARTITION BY view_id, k, ux ORDER BY i)),
 g AS (SELECT view_id, k, ux AS unwrapped_x, kind, geom_type, CASE WHEN geom_type = 'linestring' THEN any_value(stroke) ELSE 1 END AS brush, min(sx) AS x0, max(sx) AS x1, min(sy) AS y0, max(sy) AS y1, sign(sum(sx * sy1 - sx1 * sy)) AS s FROM e GROUP BY view_id, k, ux, kind, geom_type),
 b AS (SELECT view_id, k, unwrapped_x, kind, x0 - brush // 2 AS min_x, y0 - brush // 2 AS min_y, x1 + brush - brush // 2 - 1 AS max_x, y1 + brush - brush // 2 - 1 AS max_y, CASE WHEN geom_type = 'polygon' THEN CAST(s AS INTEGER) ELSE 9 END AS sign FROM g)"""
PAINTED = f"""SELECT frame, rgb, count(*) AS pixels, CAST(min(px) AS INTEGER) AS x0, CAST(max(py) AS INTEGER) AS y1 FROM (SELECT frame, px, py, arg_max(rgb, ordinal) AS rgb FROM (SELECT *, unnest(range(greatest(x, 0), least(x + w, 96))) AS px FROM (SELECT *, unnest(range(greatest(y, 0), least(y + h, 64))) AS py FROM {RECTS})) GROUP BY frame, px, py) GROUP BY frame, rgb"""
PICK = f"""(SELECT *, {o.ty('max_lat', '0')} AS ny, {o.ty('min_lat', '0')} AS sy, max_lon - min_lon AS span, CASE WHEN hi < lo THEN NULL WHEN width <= 0 THEN NULL ELSE 1 END AS ok FROM {source('pickers')})"""
PICKED = f"""(SELECT *, CASE WHEN span >= 360 THEN 2 ELSE (SELECT min(z) FROM range(0, 32) t(z) WHERE 1280 <= (CASE WHEN span < 0 THEN span + 360 ELSE span END) / 360.0::DOUBLE * (1::BIGINT << z::INTEGER) * 256 AND 600 <= (sy - ny) * (1::BIGINT << z::INTEGER) * 256) END AS fill, min_lon < max_lon AND min_lat < max_lat AS usable FROM {PICK})"""
REASON = "CASE WHEN strlen(text) > 95 THEN 'oversized' WHEN text = '' OR contains(text, chr(9)) THEN 'invalid' WHEN x < 0 OR y < 0 OR x >= 1000 OR y >= 500 THEN 'offscreen' ELSE 'ok' END"
NODE = "(SELECT view_id, x, y, count(*) AS copies FROM " + COPIES + " GROUP BY view_id, x, y)"

SQL = {
    "read_clamp": f"SELECT *, CAST(CASE WHEN len <= 0 OR start < 0 OR start >= size THEN 0 ELSE least(len, size - start) END AS BIGINT) AS n FROM {source('reads')}",
    "tile_by_place": HILBERT + f""" SELECT i.event_id, i.archive, i.z, i.x, i.y, d."offset" IS NOT NULL AS there, d."offset", d.length FROM i LEFT JOIN {o.DIRECTORY} d ON i.archive = d.archive AND i.tile_id >= d.tile_id AND i.tile_id < d.tile_id + d.run_length""",
    "mvt_roundtrip": f"SELECT tile_id, layer, CAST(place AS INTEGER) AS feature_ordinal, geometry AS geom_type, 1 AS paths, points, CAST(points * x + 7 * points * (points - 1) / 2 AS BIGINT) AS sum_x, CAST(points * y - 3 * points * (points - 1) / 2 AS BIGINT) AS sum_y, name, printf('%g', rank / 4.0::DOUBLE) AS share, rank > 25 AS big FROM {SHAPES}",
    "tile_accounts": f"SELECT *, round(classified::DOUBLE / features, 6) AS classified_share FROM (SELECT tile_id, count(*) AS features, count(*) AS paths, CAST(sum(points) AS BIGINT) AS points, CAST(sum(CASE WHEN rank > 25 THEN 4 ELSE 3 END) AS BIGINT) AS keys, CAST(sum(strlen(layer) + 13 + strlen(name) + CASE WHEN rank > 25 THEN 3 ELSE 0 END) AS BIGINT) AS string_bytes, CAST(sum(CASE WHEN layer <> 'road' THEN 1 ELSE 0 END) AS BIGINT) AS classified, CAST(sum(CASE WHEN layer = 'road' THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM {SHAPES} GROUP BY tile_id)",
    "pmtiles_roundtrip": f"SELECT archive, tile_id, CAST((SELECT max(z) FROM range(0, 31) t(z) WHERE ((1::BIGINT << (2 * z)::INTEGER) - 1) // 3 <= tile_id) AS INTEGER) AS z, sha256('tile ' || content) AS sha256 FROM {source('stored')}",
    "gzip_status": f"SELECT k, CASE WHEN k % 6 = 0 THEN n END AS bytes, CASE WHEN k % 6 IN (1, 3) THEN 'broken' ELSE 'ok' END AS status, CASE WHEN k % 6 NOT IN (1, 3) THEN n END AS loose_bytes, CASE WHEN k % 6 IN (0, 4) THEN true WHEN k % 6 IN (2, 5) THEN false END AS crc_ok FROM (SELECT k, strlen(name) * (k % 50 + 1) AS n FROM {NAMED})",
    "payload_summary": f"""SELECT archive, CAST(sum(run_length) AS BIGINT) AS addressed, count(*) AS entries, count(DISTINCT "offset") AS contents, CAST(sum(length * run_length) AS BIGINT) AS bytes, max(length) AS max_bytes, any_value(m) AS median_bytes, any_value(q) AS p95_bytes, round(sum(length * run_length)::DOUBLE / sum(run_length), 6) AS mean_bytes FROM {o.DIRECTORY} JOIN (SELECT archive, round(quantile_cont(length, 0.5), 6) AS m, round(quantile_cont(length, 0.95), 6) AS q FROM (SELECT archive, length, unnest(range(run_length)) FROM {o.DIRECTORY}) GROUP BY archive) USING (archive) GROUP BY archive""",
    "property_display": f"SELECT k, CASE t WHEN 'string' THEN text WHEN 'double' THEN printf('%g', d) WHEN 'int' THEN CAST(n AS VARCHAR) WHEN 'uint' THEN CAST(n AS VARCHAR) WHEN 'bool' THEN CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END ELSE '' END AS shown, CASE t WHEN 'double' THEN d WHEN 'int' THEN n::DOUBLE WHEN 'uint' THEN n::DOUBLE END AS number FROM {source('values')}",
    "frame_totals": "SELECT *, lookup + decode + draw AS total_ms FROM (SELECT view_id, count(*) AS visible, CAST(sum(copies) AS BIGINT) AS placements, " + ", ".join(f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in ("present", "missing", "skipped")) + ", " + ", ".join(f"CAST(coalesce(sum(CASE WHEN status = 'present' THEN {e} END), 0) AS BIGINT) AS {n}" for n, e in (("features", "k % 90"), ("stored", "k % 700"), ("raw", "k % 900 + 100"), ("lookup", "k % 7"), ("decode", "k % 13"), ("draw", "k % 3"))) + f" FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'missing' WHEN k % 11 = 0 THEN 'skipped' ELSE 'present' END AS status FROM (SELECT *, x * 31 + y * 17 + view_id AS k FROM {NODE})) GROUP BY view_id)",
    "primitive_counts": f"SELECT frame, prim, count(*) AS calls, CAST(sum(CASE prim WHEN 'line' THEN greatest(abs(x1 - x0), abs(y1 - y0)) + 1 WHEN 'rect' THEN x1 * y1 ELSE 1 END) AS BIGINT) AS span FROM {source('prims')} GROUP BY frame, prim",
    "deepest_pack": f"SELECT region, max_zoom, pack_id FROM {source('depths')} QUALIFY row_number() OVER (PARTITION BY region ORDER BY max_zoom DESC, ordinal) = 1",
    "content_digests": f"SELECT k AS path, CAST(strlen(name) AS BIGINT) AS bytes, sha256(name) AS sha256 FROM {NAMED}",
    "manifest_json": f"SELECT ordinal, e AS error, CASE WHEN e = 'none' THEN min_lon END AS min_lon, CASE WHEN e = 'none' THEN max_zoom::INTEGER END AS max_zoom, CASE WHEN e = 'none' THEN 3 END AS pmtiles_version, CASE WHEN e = 'none' THEN priority::INTEGER END AS priority, CASE WHEN e = 'none' THEN CASE WHEN ordinal % 16 = 10 THEN 'é�' ELSE '1' END END AS builder_version, CASE WHEN e = 'none' THEN 1 END AS sources FROM (SELECT *, {BROKEN.replace('s_suppkey', 'ordinal')} AS e FROM {o.PACKS0})",
    "pack_discovery": f"SELECT {PACK} || '.manifest.json' AS name, CASE WHEN NOT unreadable AND json = 'none' THEN pack_id END AS pack_id, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY pack_id, reason IS NULL ORDER BY ordinal) > 1 THEN 'duplicate' END AS rejection, CASE WHEN reason = 'bad-json' THEN json WHEN reason = 'invalid-manifest' THEN error WHEN reason LIKE 'archive%' THEN {PACK} || '.pmtiles' END AS detail FROM {FOUND}",
    "manifest_names": f"SELECT k, file LIKE '%.manifest.json' AND file NOT LIKE '.%' AND file NOT LIKE '%/%' AS listed, CASE WHEN file LIKE '%.manifest.json' THEN left(file, length(file) - 14) || '.pmtiles' ELSE '' END AS archive, CASE WHEN folder = '' OR folder LIKE '%/' OR right(folder, 1) = chr(92) THEN folder || file ELSE folder || '/' || file END AS path FROM {source('files')}",
    "header_agreement": f"SELECT {PACK} || '.manifest.json' AS name, ordinal % 8 <> 5 AS readable, CASE WHEN ordinal % 8 <> 5 THEN ordinal % 6 = 1 END AS wider, CASE WHEN ordinal % 8 <> 5 THEN ordinal % 10 = 0 END AS deeper FROM {o.PACKS0}",
    "sidecars": f"SELECT {PACK} AS stem, sha256(s_name) AS sha256, CAST(strlen(s_name) AS BIGINT) AS bytes, max_lat, CASE WHEN no_source THEN '' ELSE 'osm' END AS source, sha256(s_name) || '  ' || {PACK} || '.pmtiles' || chr(10) AS checksum FROM {o.PACKS0}",
    "provenance_audit": _audit(),
    "pack_sources": f"""WITH p AS (SELECT *, NOT broken AND coalesce(id, '') <> '' AS usable FROM {source('records')}), r AS (SELECT id, official_pack_allowed, clean_pack_allowed FROM p WHERE usable QUALIFY row_number() OVER (PARTITION BY id ORDER BY file) = 1),
 m AS (SELECT * FROM {source('sourced')}), e AS (SELECT name, pack_class, unnest(provenance_ids) AS provenance_id FROM m), j AS (SELECT e.*, r.id, official_pack_allowed, clean_pack_allowed FROM e LEFT JOIN r ON e.provenance_id = r.id)
 SELECT name, NULL::VARCHAR AS provenance_id, CASE WHEN provenance_ids IS NULL THEN 'missing-field' ELSE 'missing-provenance-id' END AS code FROM m WHERE provenance_ids IS NULL OR len(provenance_ids) = 0
 UNION ALL SELECT name, provenance_id, 'missing-provenance-id' FROM j WHERE coalesce(provenance_id, '') = '' UNION ALL SELECT name, provenance_id, 'unknown-provenance-id' FROM j WHERE provenance_id <> '' AND id IS NULL
 UNION ALL SELECT name, provenance_id, 'source-not-official' FROM j WHERE id IS NOT NULL AND coalesce(official_pack_allowed, '') <> 'true' UNION ALL SELECT name, provenance_id, 'source-not-clean' FROM j WHERE id IS NOT NULL AND pack_class = 'clean' AND coalesce(clean_pack_allowed, '') <> 'true'""",
    "schema_credits": f"SELECT k, fault, primary_id, {_fault('c1', 'l1', 'i1')} AS fault_after, array_to_string(c1, '|') AS required_attribution, array_to_string(l1, '|') AS attribution_links, array_to_string(i1, '|') AS provenance_ids FROM {CREDITED}",
    "same_inputs": f"SELECT grp, NOT bool_or(k % 19 = 3 OR k % 23 = 4) AS same FROM {source('pinned')} GROUP BY grp",
    "target_faults": f"SELECT * FROM (SELECT code, stem, CASE WHEN NOT regexp_matches(code, '^[A-Z]{{2}}$') OR region_id <> 'US-' || code THEN 'region' WHEN min_zoom < 0 OR max_zoom > 31 OR min_zoom > max_zoom THEN 'zoom' WHEN NOT regexp_matches(stem, '^us-[a-z0-9-]+$') OR count(*) OVER (PARTITION BY stem) > 1 THEN 'stem' WHEN min_lon >= max_lon OR min_lat >= max_lat THEN 'bounds' END AS fault FROM {TARGETS}) WHERE fault IS NOT NULL",
    "state_selection": f"""WITH a AS (SELECT ordinal, selector, regexp_replace(upper(trim(selector)), '^US-', '') AS key FROM {source('selectors')}), n AS (SELECT ordinal, selector, count(code) AS n, min(code) AS code FROM a LEFT JOIN (SELECT code, code AS key FROM {source('states')} UNION SELECT code, upper(name) FROM {source('states')}) USING (key) GROUP BY ordinal, selector)
 SELECT ordinal, selector, CASE WHEN n = 1 THEN code END AS code, CASE WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN row_number() OVER (PARTITION BY n = 1, code ORDER BY ordinal) > 1 THEN 'repeated' ELSE 'ok' END AS status FROM n""",
    "build_preflight": f"""SELECT t.stem, CASE WHEN s.source_id IS NULL THEN 'no-source' WHEN s.schema_version <> 'openmaptiles-3.16' THEN 'schema' WHEN s.actual_bytes <> s.size_bytes THEN 'size' WHEN t.min_zoom < 0 OR t.min_zoom > t.max_zoom OR t.max_zoom > 31 THEN 'zoom-override' WHEN t.min_zoom < s.min_zoom OR t.max_zoom > s.max_zoom THEN 'zoom' WHEN t.min_zoom < s.h_min OR t.max_zoom > s.h_max THEN 'header-zoom'
 WHEN t.min_lon < s.min_lon OR t.min_lat < s.min_lat OR t.max_lon > s.max_lon OR t.max_lat > s.max_lat THEN 'bounds' END AS fault FROM {TARGETS} t LEFT JOIN {source('supplies')} s USING (source_id)""",
    "built_packs": f"SELECT stem, status FROM {BUILT}",
    "ready_states": f"SELECT code, count(*) AS parts, bool_and(status = 'ready') AS ready, CAST(sum(CASE WHEN status = 'incomplete' THEN 1 ELSE 0 END) AS BIGINT) AS incomplete FROM {BUILT} GROUP BY code",
    "dataset_faults": f"""SELECT * FROM (SELECT ordinal, CASE WHEN scale IS NULL OR archive IS NULL OR url IS NULL THEN 'missing-field' WHEN row_number() OVER (PARTITION BY scale, dataset ORDER BY ordinal) > 1 OR scale = '1m' OR geometry = 'cube' THEN 'dataset' WHEN url NOT LIKE 'https://naturalearth.s3.amazonaws.com/%' THEN 'url' WHEN archive <> 'ne_' || scale || '_' || dataset || '.zip' OR url <> 'https://naturalearth.s3.amazonaws.com/p/ne_' || scale || '_' || dataset || '.zip' THEN 'archive'
 WHEN expected_bytes <= 0 THEN 'size' WHEN sha256 = 'zz' THEN 'sha256' END AS fault FROM {source('datasets')}) WHERE fault IS NOT NULL""",
    "overview_features": f"""SELECT k, "use" AS layer, CASE "use" WHEN 'land' THEN 'polygon' WHEN 'water' THEN 'polygon' WHEN 'place' THEN 'point' ELSE 'line' END AS geometry, CASE scale WHEN '110m' THEN 0 WHEN '50m' THEN 3 ELSE 6 END AS min_zoom, CASE scale WHEN '110m' THEN 2 WHEN '50m' THEN 5 ELSE 8 END AS max_zoom, CASE WHEN "use" = 'boundary' THEN CASE WHEN contains(archive, 'admin_0') THEN 0 ELSE 1 END END AS admin_level,
 CASE WHEN "use" IN ('place', 'waterway') THEN coalesce(tag_name, tag_upper_name) END AS title, coalesce(tag_scalerank, tag_upper_scalerank) AS rank FROM {source('overview')} WHERE "use" <> 'other' AND scale <> '5m'""",
    "shapefile_probe": f"SELECT k, k * 1000 AS records, CASE WHEN k % 10 <> 9 THEN ['point', 'line', 'polygon', 'point', 'line', 'polygon', 'point', NULL][k % 8 + 1] END AS geometry FROM {NAMED}",
    "zip_check": f"SELECT k, CASE WHEN k % 9 = 4 THEN 'broken' WHEN k % 7 IN (2, 3) THEN 'unsafe' WHEN k % 5 = 1 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN k % 9 <> 4 AND k % 7 NOT IN (2, 3) THEN CASE WHEN k % 5 = 1 THEN 3 ELSE 4 END END AS members FROM {NAMED}",
    "geojson_box": f"""SELECT {P} AS k, CASE {P} % 6 WHEN 0 THEN {P} % 170 WHEN 1 THEN 0 WHEN 3 THEN -({P} % 60) END{D} AS min_lon, CASE {P} % 6 WHEN 0 THEN {P} % 80 WHEN 1 THEN -({P} % 80) WHEN 3 THEN 0 END{D} AS min_lat, CASE {P} % 6 WHEN 0 THEN {P} % 170 WHEN 1 THEN {P} % 90 + 20 WHEN 3 THEN 1 END{D} AS max_lon, CASE {P} % 6 WHEN 0 THEN {P} % 80 WHEN 1 THEN 1.5 WHEN 3 THEN 2 END{D} AS max_lat, CASE {P} % 6 WHEN 2 THEN 'invalid-json' WHEN 4 THEN 'no-coordinates' WHEN 5 THEN 'outside' END AS error FROM part""",
    "region_requests": f"SELECT k, CASE WHEN t THEN w END AS min_lon, CASE WHEN t THEN s END AS min_lat, CASE WHEN t THEN e END AS max_lon, CASE WHEN t THEN n END AS max_lat, lon BETWEEN s_min_lon AND s_max_lon AND lat BETWEEN s_min_lat AND s_max_lat AS inside, CASE WHEN greatest(lo, s_lo) <= least(hi, s_hi) THEN greatest(lo, s_lo) END AS low, CASE WHEN greatest(lo, s_lo) <= least(hi, s_hi) THEN least(hi, s_hi) END AS high FROM (SELECT *, w < e AND s < n AS t FROM (SELECT *, greatest(min_lon, s_min_lon) AS w, greatest(min_lat, s_min_lat) AS s, least(max_lon, s_max_lon) AS e, least(max_lat, s_max_lat) AS n FROM {source('regions')}))",
    "picker_begin": f"SELECT k, usable, CASE WHEN r THEN CAST(coalesce(least(greatest(fill, lo), hi), lo) AS INTEGER) END AS min_zoom, CASE WHEN r THEN hi END AS max_zoom, CASE WHEN r THEN {o.r6(o.clampl('(min_lat + max_lat) / 2'))} END AS start_lat, CASE WHEN r THEN {o.r6(o.wrap('(min_lon + max_lon) / 2'))} END AS start_lon FROM (SELECT *, usable AND ok IS NOT NULL AS r FROM {PICKED})",
    "camera_moves": f"SELECT k, zoom <= 31 AND width > 0 AS valid, {o.r6(f'CASE WHEN good THEN {o.clampl("to_lat")} ELSE lat END')} AS lat, {o.r6(f'CASE WHEN good THEN {o.wrap("to_lon")} ELSE lon END')} AS lon, least(greatest(to_zoom, 0), 31) AS zoom, CASE WHEN to_width > 0 AND to_height > 0 THEN to_width ELSE width END AS width, CASE WHEN to_width > 0 AND to_height > 0 THEN to_height ELSE height END AS height FROM (SELECT *, to_lon IS NOT NULL AND NOT isnan(to_lat) AS good FROM {source('moves')})",
    "screen_maps": f"SELECT view_id, x, y, ux AS unwrapped_x, CAST(round(cx + {o.delta('x', 'cx', 'n')}) AS BIGINT) AS nearest_x, round((ux - cx) * 256 + width * 0.5::DOUBLE, 3) AS sx, round((y - cy) * 256 + height * 0.5::DOUBLE, 3) AS sy, 4096::BIGINT AS scale_q16 FROM {COPIES}",
    "screen_features": SCREEN + " SELECT view_id, k, unwrapped_x, kind, 1 AS paths, min_x::INTEGER AS min_x, min_y::INTEGER AS min_y, max_x::INTEGER AS max_x, max_y::INTEGER AS max_y, sign FROM b",
    "feature_bands": SCREEN + ", d AS (SELECT view_id, CAST(unnest(range(greatest(min_y, 0) // 90, least(max_y, 719) // 90 + 1)) AS BIGINT) AS band FROM b WHERE max_y >= 0 AND min_y < 720) SELECT view_id, band, count(*) AS features FROM d GROUP BY view_id, band",
    "painter_composite": PAINTED,
    "painter_banded": PAINTED,
    "polygon_spans": f"""WITH v AS (SELECT ring, i, x >> 6 AS x, y >> 6 AS y, count(*) OVER (PARTITION BY ring) AS n FROM {o.POINTS} WHERE ring IN (SELECT o_orderkey FROM orders)),
 e AS (SELECT ring, x::BIGINT AS x0, y::BIGINT AS y0, (coalesce(lead(x) OVER w, first_value(x) OVER w))::BIGINT AS x1, (coalesce(lead(y) OVER w, first_value(y) OVER w))::BIGINT AS y1 FROM v WHERE n >= 3 WINDOW w AS (PARTITION BY ring ORDER BY i)),
 h AS (SELECT ring, y, x0 + sign((y - y0) * (x1 - x0)) * sign(y1 - y0) * (abs((y - y0) * (x1 - x0)) // abs(y1 - y0)) AS x FROM (SELECT *, unnest(range(least(y0, y1), greatest(y0, y1))) AS y FROM e)),
 s AS (SELECT ring, y, min(x) AS a, max(x) AS b FROM (SELECT *, (row_number() OVER (PARTITION BY ring, y ORDER BY x) - 1) // 2 AS pair FROM h) GROUP BY ring, y, pair)
 SELECT ring, count(*) AS spans, CAST(sum(b - a + 1) AS BIGINT) AS pixels, CAST(min(y) AS INTEGER) AS y0, CAST(max(y) AS INTEGER) AS y1 FROM s GROUP BY ring""",
    "stroke_pixels": f"WITH l AS (SELECT *, unnest(range(0, greatest(dx, dy) + 1)) AS i FROM {source('strokes')}), b AS (SELECT k, x + CASE WHEN dx > 0 THEN i ELSE 0 END - px // 2 + a AS x, y + CASE WHEN dy > 0 THEN i ELSE 0 END - px // 2 + c AS y FROM (SELECT *, unnest(range(px)) AS a FROM (SELECT *, unnest(range(px)) AS c FROM l))), d AS (SELECT DISTINCT k, x, y FROM b WHERE x BETWEEN 0 AND 95 AND y BETWEEN 0 AND 63) SELECT k, count(*) AS pixels, CAST(min(x) AS INTEGER) AS x0, CAST(max(y) AS INTEGER) AS y1 FROM d GROUP BY k",
    "tile_scissors": f"SELECT * FROM (SELECT ordinal, y, greatest(x, frame * 16) AS x0, least(x + w - 1, frame * 16 + 31) AS x1 FROM {RECTS} WHERE y >= frame * 8 AND y < frame * 8 + 32) WHERE x0 <= x1",
    "label_offers": f"""SELECT k, CASE WHEN coalesce(english, '') <> '' THEN english ELSE local_name END AS text, CAST(trunc(CASE WHEN kind = 'label_primary' THEN 20000 ELSE 10000 END + least(greatest(CASE WHEN population >= 0 THEN population ELSE 100 - coalesce(scalerank, 100) END, 0), 100) * 100) AS INTEGER) AS priority, CAST(x AS INTEGER) AS local_x, CAST(y AS INTEGER) AS local_y
 FROM {source('places')} WHERE layer <> 'poi' AND geom_type = 'point' AND kind <> 'water' AND shown AND coalesce(from_zoom, 0) <= 6 AND x BETWEEN 0 AND 4095 AND y BETWEEN 0 AND 4095""",
    "label_stats": f"SELECT frame, count(*) AS offered, " + ", ".join(f"CAST(sum(CASE WHEN r = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS {x}" for x in ("oversized", "invalid", "offscreen")) + f", CAST(count(CASE WHEN r = 'ok' THEN 1 END) - count(DISTINCT CASE WHEN r = 'ok' THEN text || '|' || x || '|' || y END) AS BIGINT) AS duplicates FROM (SELECT *, {REASON} AS r FROM {source('candidates')}) GROUP BY frame",
    "label_scripts": f"SELECT k, octets IN ('4142', 'C3A9', 'F48FBFBF', 'E4B8AD41', 'D8A7', 'E2808B') AS valid, octets IN ('4142', 'C3A9', 'E4B8AD41') AS simple, CASE octets WHEN '4142' THEN 16 WHEN 'E4B8AD41' THEN 16 WHEN 'C3A9' THEN 8 WHEN 'F48FBFBF' THEN 8 WHEN 'D8A7' THEN 8 WHEN 'E2808B' THEN 8 END AS width FROM {source('scripts')}",
    "code_names": "SELECT k, " + ", ".join(f"CASE WHEN code BETWEEN 0 AND {len(v) - 1} THEN {names(v)}[code + 1] ELSE 'unknown' END AS {n}" for n, v in (("kind", kinds.KINDS), ("rule", kinds.RULES), ("json_error", manifests.JSON_ERRORS), ("rejection", manifests.REJECTIONS), ("compression", wire.COMPRESSIONS), ("tile_type", kinds.TILE_TYPES))) + f" FROM {source('codes')}",
    "profile_kinds": f"SELECT profile, CASE profile WHEN 'openmaptiles-3.16' THEN {o.OMT} WHEN 'world-overview-1' THEN {o.OVERVIEW} WHEN 'my-overview' THEN {o.OVERVIEW} WHEN 'protomaps-v4' THEN {o.PROTO} END AS kind_out, count(*) AS n FROM (SELECT *, ['openmaptiles-3.16', 'world-overview-1', 'protomaps-v4', 'other-1', 'my-overview'][l_orderkey % 5 + 1] AS profile FROM {o.ROADS}) GROUP BY 1, 2",
    "drag_layers": f"SELECT k, count(*) AS n, count(CASE WHEN k NOT IN {lit(kinds.DRAG_HIDDEN)} THEN 1 END) AS drawn FROM (SELECT {o.OMT} AS k FROM {o.ROADS} WHERE layer NOT IN {lit(kinds.DRAG_LAYERS)}) WHERE k IS NOT NULL GROUP BY k",
    "style_choice": f"SELECT k, CASE WHEN wanted IN {lit(kinds.STYLES)} THEN wanted ELSE held END AS style FROM {source('styles')}",
    "tile_cache_keys": f"""WITH RECURSIVE b AS (SELECT k, hex(encode(name)) AS h FROM {NAMED}), f AS (SELECT k, h, 1 AS i, 2166136261::BIGINT AS v FROM b UNION ALL SELECT k, h, i + 2, (xor(v, (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1) * 16777619) & 4294967295 FROM f WHERE i < length(h))
 SELECT k, v AS pack, 4247692921::BIGINT AS style, CAST(k % 3 AS INTEGER) AS version, 1 AS renderer FROM f WHERE i > length(h)""",
    "metric_records": f"""SELECT '{{"record":"frame","frame":' || frame || ',"scenario":"' || scenario || '","ms":' || ms || ',"heap":' || coalesce(CAST(heap AS VARCHAR), 'null') || '}}' AS line FROM {source('frames')}""",
}
