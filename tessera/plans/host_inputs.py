"""Inputs of the host queries: columns over the test tables in SQL that Spark and
DuckDB read alike. LIST, EMPTY and NOLIST stand for lists of each."""

from __future__ import annotations


def pick(n: str, *items: str) -> str:
    """Item number ``n`` modulo their count."""
    return f"CASE ({n}) % {len(items)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(items)) + " END"


def div(a: str, b: int) -> str:
    return f"cast(floor(cast({a} as double) / {b}) as bigint)"


def num(x: str) -> str:
    return f"cast({x} as double)"


def listed(*items: str) -> str:
    return "LIST(" + ", ".join(items) + ")"


def spark(expr: str) -> str:
    return expr.replace("LIST(", "array(").replace("NOLIST", "cast(null as array<string>)").replace("EMPTY", "cast(array() as array<string>)")


def duck(expr: str) -> str:
    return expr.replace("LIST(", "list_value(").replace("NOLIST", "CAST(NULL AS VARCHAR[])").replace("EMPTY", "CAST([] AS VARCHAR[])")


P, S, N = "p_partkey", "s_suppkey", "cast(n_nationkey as bigint)"
CODE = f"concat(chr(cast(65 + {P} % 26 as int)), chr(cast(65 + {div(P, 26)} % 26 as int)))"
FULL = "lpad(cast({} as string), 6, '0')"
CLASSES = ("CC0", "PDDL", "PUBLIC_DOMAIN_VERIFIED", "US_FEDERAL_PUBLIC_DOMAIN", "PERMISSIVE_ATTRIBUTION", "CDLA_PERMISSIVE", "ODBL", "PROPRIETARY_APPROVED", "NONCOMMERCIAL", "NO_DERIVATIVES", "UNKNOWN", "WEIRD")
RIGHTS = ("commercial_use_allowed", "redistribution_allowed", "modification_allowed", "attribution_required", "share_alike_required", "source_disclosure_required")
ARCHIVE = f"concat('ne_', {pick(P, "'10m'", "'50m'", "'110m'", "'1m'", 'null')}, '_d', cast({P} % 300 as string), '.zip')"
FILE_FAULTS = f"({P} % 30 = 11 or {P} % 33 = 2 or {P} % 27 = 9 or {P} % 28 = 3)"

INPUTS: dict[str, tuple[str, dict[str, str]]] = {
    "reads": ("lineitem", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "start": "case when l_linenumber = 7 then 9223372036854775800 else l_partkey * 37 - 50 end", "len": "l_suppkey % 97 * 13 - 20", "size": "l_orderkey % 1000 * 90"}),
    "wanted": ("events", {"event_id": "event_id", "archive": "event_id % 5", "z": "cast(event_id % 6 as int)", "x": f"cast(event_id * 7 % ({pick('event_id', '1', '2', '4', '8', '16', '32')}) as bigint)", "y": f"cast(event_id * 13 % ({pick('event_id', '1', '2', '4', '8', '16', '32')}) as bigint)"}),
    "shapes": ("part", {"k": P, "tile_id": f"{P} % 40", "layer": pick(f"{P} * 7", "'land'", "'water'", "'road'", "'place'"), "geometry": pick(P, "'point'", "'linestring'", "'polygon'"), "points": f"cast(3 + {P} % 4 as int)", "x": f"{P} * 37 % 4000", "y": f"{P} * 53 % 4000", "name": "p_name", "rank": "p_size"}),
    "stored": ("part", {"archive": f"{P} % 5", "tile_id": div(P, 5), "content": "p_size"}),
    "named": ("part", {"k": P, "name": f"concat(p_name, ' ', cast({P} as string))"}),
    "values": ("part", {"k": P, "t": pick(P, "'string'", "'double'", "'int'", "'uint'", "'bool'", "null"), "text": "p_name", "d": f"{num('p_size')} * {pick(P + ' * 5', num('0.1'), num('10000000'), num('0.00001'), num('1234567.5'))}", "n": f"{P} * 7"}),
    "prims": ("part", {"frame": f"{P} % 9", "prim": pick(P, "'line'", "'rect'", "'point'", "'span'"), "x0": f"{P} % 50", "y0": f"{P} * 3 % 40", "x1": f"{P} * 7 % 60", "y1": f"{P} * 11 % 30"}),
    "depths": ("supplier", {"region": f"{S} % 6", "ordinal": S, "pack_id": f"concat('p', cast({S} as string))", "max_zoom": f"cast(8 + {S} % 7 as int)"}),
    "files": ("part", {"k": P, "file": pick(P, "concat(p_name, '.manifest.json')", "'.hidden.manifest.json'", "'sub/a.manifest.json'", "'x.json'", f"concat('m', cast({P} as string), '.manifest.json')", "'.manifest.json'"), "folder": pick(P, "''", "'packs'", "'packs/'", "concat('a', chr(92))")}),
    "records": ("part", {
        "file": f"concat('f', {FULL.format(P)}, '.json')", "stem": f"concat('f', {FULL.format(P)})", "broken": f"{P} % 31 = 0",
        "id": f"case when {P} % 29 = 0 then '' when {P} % 17 = 0 then concat('f', {FULL.format(P + ' - 1')}) else concat('f', {FULL.format(P)}) end",
        "name": f"case when {P} % 37 = 1 then null else p_name end", "publisher": "'pub'", "url": pick(P, "'https://a.example'", "'http://b.example'", "'ftp://c.example'", "'https://d.example'", "null"),
        "retrieved": pick(P, "'2024-01-02'", "'2024-1-2'", "null", "'2020-12-31'"), "license": "'L'", "license_class": pick(P, *(f"'{x}'" for x in CLASSES), "null"),
        **{r: pick(f"{div(P, 13)} + {j}", "'true'", "'false'", "'true'", "'yes'", "null") for j, r in enumerate(RIGHTS)},
        "rights_url": "'https://r.example'", "reviewed_date": "'2024-05-06'", "confidence": pick(P, "'CONFIRMED'", "'REVIEW_REQUIRED'", "'MAYBE'"),
        "official_pack_allowed": pick(div(P, 7), "'true'", "'false'", "'true'"), "clean_pack_allowed": pick(div(P, 11), "'true'", "'false'", "'true'", "null"),
    }),
    "sourced": ("supplier", {"name": f"concat('m', cast({S} as string))", "pack_class": pick(S, "'clean'", "'open'", "'clean'"), "provenance_ids": pick(S, "NOLIST", "EMPTY", listed("''"), listed("'f000001'", "'osm'"), listed(f"concat('f', {FULL.format(S)})"), listed("'f000003'", "null"))}),
    "credited": ("supplier", {
        "k": S, "schema_version": pick(S, "'openmaptiles-3.16'", "'protomaps-v4'", "'openmaptiles-x'"), "required_attribution": pick(S, "EMPTY", listed("'© OpenMapTiles'"), listed("'by OpenMapTiles team'"), listed("'Â© OpenMapTiles'"), "NOLIST"),
        "attribution_links": pick(S, listed("'https://openmaptiles.org/'"), "EMPTY", "NOLIST", listed("'https://x.example'", "'https://openmaptiles.org/'")),
        "provenance_ids": pick(S, listed("'openmaptiles'"), listed("'osm'"), listed("'openmaptiles'", "'osm'"), listed("'osm'", "'openmaptiles'"), "EMPTY", "NOLIST", listed("'a'", "'b'")),
    }),
    "pinned": ("supplier", {"grp": "s_nationkey", "ordinal": S, "k": S, "archive": f"concat('a', cast({S} as string))", "sha256": "s_name"}),
    "targets": ("part", {
        "k": P, "source_id": f"case when {P} % 41 = 40 then 9 else {P} % 4 end", "code": f"case when {P} % 21 = 5 then lower({CODE}) else {CODE} end", "region_id": f"case when {P} % 22 = 7 then 'US' else concat('US-', case when {P} % 21 = 5 then lower({CODE}) else {CODE} end) end",
        "min_zoom": f"cast({P} % 4 as int)", "max_zoom": f"cast(case when {P} % 27 = 9 then 40 when {P} % 28 = 3 then -1 else 8 + {P} % 7 end as int)",
        "stem": f"case when {P} % 30 = 11 then 'us-dup' when {P} % 33 = 2 then concat('bad_', cast({P} as string)) else concat('us-', lower({CODE}), '-', cast({P} as string)) end",
        "min_lon": num(f"{P} % 36 * 10 - 180"), "min_lat": num(f"{P} % 15 * 10 - 80"), "max_lon": num(f"{P} % 36 * 10 - 180 + case when {P} % 34 = 8 then 0 else 5 end"), "max_lat": num(f"{P} % 15 * 10 - 76"), "fault_free": f"not {FILE_FAULTS}",
    }),
    "supplies": ("region", {
        "source_id": "cast(r_regionkey as bigint)", "schema_version": "case when r_regionkey = 2 then 'other' else 'openmaptiles-3.16' end", "pmtiles_version": "3", "size_bytes": "cast(100 as bigint)", "actual_bytes": "cast(case when r_regionkey = 3 then 99 else 100 end as bigint)",
        "min_zoom": "cast(r_regionkey as int)", "max_zoom": "13", "h_min": "0", "h_max": "12", "min_lon": num("-175"), "min_lat": num("-75"), "max_lon": num("175"), "max_lat": num("55"),
    }),
    "states": ("nation", {"code": "concat(chr(cast(65 + n_nationkey % 26 as int)), 'X')", "name": "n_name"}),
    "selectors": ("supplier", {"ordinal": S, "selector": pick(S, f"lower(concat(chr(cast(65 + {S} % 26 as int)), 'X'))", f"concat('us-', chr(cast(65 + {S} * 3 % 26 as int)), 'x')", f"concat(' nation_', cast({S} % 27 as string))", f"concat('zz', cast({S} as string))")}),
    "datasets": ("part", {
        "ordinal": P, "scale": pick(P, "'10m'", "'50m'", "'110m'", "'1m'", "null"), "dataset": f"concat('d', cast({P} % 300 as string))", "geometry": pick(P, "'point'", "'line'", "'polygon'", "'cube'", "'line'", "'line'", "'polygon'"),
        "url": pick(P, f"concat('http://naturalearth.s3.amazonaws.com/p/', {ARCHIVE})", f"concat('https://other.example/p/', {ARCHIVE})", "'https://naturalearth.s3.amazonaws.com/p/y.zip'", *[f"concat('https://naturalearth.s3.amazonaws.com/p/', {ARCHIVE})"] * 8),
        "archive": f"case when {P} % 13 = 5 then 'x.zip' else {ARCHIVE} end", "expected_bytes": f"{P} % 17 - 1", "sha256": pick(f"{P} * 7", "null", "'zz'", *["repeat('a', 64)"] * 4),
    }),
    "overview": ("part", {
        "k": P, "archive": pick(P, "'ne_10m_admin_0'", "'ne_50m_admin_1'", "'ne_110m_x'"), "scale": pick(P, "'10m'", "'50m'", "'110m'", "'5m'"), "use": pick(P, "'land'", "'water'", "'waterway'", "'boundary'", "'place'", "'other'"),
        "tag_name": f"case when {P} % 5 = 0 then null else p_name end", "tag_upper_name": f"case when {P} % 10 = 0 then null else upper(p_name) end", "tag_scalerank": f"case when {P} % 3 = 0 then null else p_size end", "tag_upper_scalerank": f"case when {P} % 9 = 0 then null else p_size + 1 end",
    }),
    "geojson": ("part", {"k": P, "text": pick(P,
        f"concat('{{\"type\":\"Point\",\"coordinates\":[', cast({P} % 170 as string), ',', cast({P} % 80 as string), ']}}')",
        f"concat('{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Polygon\",\"coordinates\":[[[', cast({P} % 90 as string), ',1],[', cast({P} % 90 + 20 as string), ',1.5],[0,-', cast({P} % 80 as string), ']]]}}}}')",
        "'{\"type\":'", f"concat('{{\"features\":[{{\"geometry\":{{\"coordinates\":[-', cast({P} % 60 as string), ',0,9]}}}},{{\"geometry\":{{\"geometries\":[{{\"coordinates\":[1,2]}}]}}}}]}}')", "'{}'", f"concat('{{\"coordinates\":[', cast({P} % 50 + 181 as string), ',0]}}')")}),
    "regions": ("supplier", {
        "k": S, "lat": num(f"{S} * 29 % 150 - 75"), "lon": num(f"{S} * 37 % 340 - 170"), **{e: f"{num(f'{S} * {m} - {o}')} {sign} ({num(f'{S} % 13')} / 2 + {num('0.25')})" for e, m, o, sign in (("min_lon", "37 % 340", 170, "-"), ("min_lat", "29 % 150", 75, "-"), ("max_lon", "37 % 340", 170, "+"), ("max_lat", "29 % 150", 75, "+"))},
        "s_min_lon": num(f"{S} % 5 * 60 - 180"), "s_min_lat": num("-60"), "s_max_lon": num(f"{S} % 5 * 60 - 60"), "s_max_lat": num("60"), "lo": f"cast({S} % 5 as int)", "hi": f"cast(6 + {S} % 5 as int)", "s_lo": f"cast({S} % 3 as int)", "s_hi": f"cast(3 + {S} % 6 as int)",
    }),
    "pickers": ("supplier", {
        "k": S, "lat": num("0"), "lon": num("0"), "zoom": "0", "width": f"case when {S} % 10 = 7 then 0 else 1280 end", "height": "600", "ts": "256",
        "min_lon": f"case when {S} % 8 = 3 then {num('-180')} when {S} % 9 = 4 then {num('50')} else {num(f'{S} * 37 % 300 - 170')} end", "max_lon": f"case when {S} % 8 = 3 then {num('180')} when {S} % 9 = 4 then {num('40')} else {num(f'{S} * 37 % 300 - 170 + 1 + {S} % 20')} end",
        "min_lat": num(f"{S} * 29 % 120 - 75"), "max_lat": num(f"{S} * 29 % 120 - 74 + {S} % 15"), "lo": f"cast({S} % 4 as int)", "hi": f"cast(case when {S} % 12 = 5 then -1 else 6 + {S} % 9 end as int)",
    }),
    "moves": ("supplier", {
        "k": S, "lat": num(f"{S} * 29 % 150 - 75"), "lon": num(f"{S} * 37 % 340 - 170"), "zoom": f"cast({S} % 36 as int)", "width": f"case when {S} % 10 = 7 then 0 else 1280 end", "height": "600", "ts": "256",
        "to_lat": f"case when {S} % 11 = 3 then cast('NaN' as double) else {num(f'{S} * 17 % 220 - 110')} end", "to_lon": f"case when {S} % 13 = 5 then null else {num(f'{S} * 53 % 900 - 450')} end", "to_zoom": f"cast({S} % 40 - 4 as int)", "to_width": f"cast({S} % 5 * 100 as int)", "to_height": f"cast({S} % 7 * 50 as int)",
    }),
    "polys": ("part", {"k": P, "zoom": f"cast({P} % 5 as int)", "x": f"{P} * 11 % cast(power(2, {P} % 5) as bigint)", "y": f"{P} * 7 % cast(power(2, {P} % 5) as bigint)", "layer": pick(f"{P} * 5", "'water'", "'boundary'", "'land'", "'place'", "'rail'", "'unknown'"), "geom_type": pick(f"{P} * 2", "'polygon'", "'linestring'", "'point'"), "points": f"cast(1 + {P} % 7 as int)", "px": f"cast({P} * 37 % 4096 as int)", "py": f"cast({P} * 91 % 4096 as int)"}),
    "rects": ("part", {"frame": f"{P} % 7", "ordinal": P, "rgb": f"cast({P} * 2654435 % 16777216 as int)", "x": f"{P} * 13 % 100 - 10", "y": f"{P} * 7 % 70 - 8", "w": f"1 + {P} % 23", "h": f"1 + {P} % 11"}),
    "strokes": ("part", {"k": P, "x": f"5 + {P} % 70", "y": f"5 + {P} % 40", "dx": pick(P, f"{P} % 17", "0", f"{P} % 17", "0"), "dy": pick(P, "0", f"{P} % 17", f"{P} % 17", "0"), "px": f"cast(1 + {P} % 5 as int)"}),
    "places": ("part", {
        "k": P, "layer": pick(P, "'place'", "'places'", "'place_label'", "'poi'"), "geom_type": pick(P, "'point'", "'point'", "'point'", "'point'", "'polygon'"), "kind": pick(P, "'label_primary'", "'label_secondary'", "'label_muted'", "'water'", "'label_primary'", "'label_primary'"), "shown": f"{P} % 7 <> 3",
        "x": f"{P} * 37 % 4500 - 100", "y": f"{P} * 53 % 4500 - 100", "local_name": f"case when {P} % 8 = 1 then '' else p_name end", "english": f"case when {P} % 3 = 0 then upper(p_name) when {P} % 3 = 1 then '' end",
        "scalerank": f"case when {P} % 4 = 1 then null else {P} % 15 end", "population": f"case when {P} % 5 = 2 then {num(f'{P} % 120 - 10')} + {num('0.5')} end", "from_zoom": f"case when {P} % 6 = 5 then {P} % 12 end",
    }),
    "candidates": ("part", {"frame": f"{P} % 3", "text": pick(P, "repeat('x', 100)", "''", "concat('a', chr(9), 'b')", *["p_name"] * 6), "x": f"{P} % 50 * 22 - 20", "y": f"{P} % 25 * 22 - 20"}),
    "scripts": ("part", {"k": P, "octets": pick(P, "'4142'", "'C3A9'", "'C080'", "'EDA080'", "'F48FBFBF'", "'F4908080'", "'E280A8'", "'41C285'", "'E4B8AD41'", "'D8A7'", "'E2808B'", "''")}),
    "codes": ("part", {"k": P, "code": f"cast({P} % 17 - 1 as int)"}),
    "styles": ("part", {"k": P, "wanted": pick(P, "'standard-light'", "'night-red-safe'", "'nope'", "null"), "held": "'field-dark'"}),
    "frames": ("part", {"frame": P, "scenario": "p_name", "ms": "cast(p_size as bigint)", "heap": f"case when {P} % 3 = 0 then null else {P} * 10 end"}),
}


def source(name: str) -> str:
    """The input as a DuckDB subquery."""
    table, columns = INPUTS[name]
    return "(SELECT " + ", ".join(f'{duck(v)} AS "{k}"' for k, v in columns.items()) + f" FROM {table})"
