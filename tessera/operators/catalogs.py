"""Catalogs of build targets and data sets: rules, selection, checks of built
packs, and probes of the files that data come in."""

from __future__ import annotations

import io
import json
import math
import struct
import zipfile
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.manifests import ARCHIVE, EDGES
from tessera.operators.packs import BUILDER_MAX_LAT

c = F.col

# Shapes of names, scales with their zooms, geometries, layers,
# shape types of shapefiles, the host that data sets come from.
STEM, REGION_PREFIX = "^us-[a-z0-9-]+$", "US-"
SCALES = {"110m": (0, 2), "50m": (3, 5), "10m": (6, 8)}
GEOMETRIES = ("point", "line", "polygon")
LAYERS = {"land": "polygon", "water": "polygon", "waterway": "line", "boundary": "line", "place": "point"}
SHAPES = {1: "point", 3: "line", 5: "polygon", 8: "point", 13: "line", 15: "polygon", 18: "point"}
COMPONENTS = (".shp", ".shx", ".dbf", ".prj")
HOST = "naturalearth.s3.amazonaws.com"
SUPPORTED_SCHEMA = "openmaptiles-3.16"


# -- build targets ------------------------------------------------------------------


def target_faults(parts: DataFrame) -> DataFrame:
    """stem, code, fault of the parts of states that break a rule, the first one
    each. parts: code, region_id, min_zoom, max_zoom, stem, edges."""
    again = F.count("*").over(Window.partitionBy("stem"))
    ordered = F.lit(True)
    for low, high, most in (("min_lon", "max_lon", 180.0), ("min_lat", "max_lat", BUILDER_MAX_LAT)):
        ordered = ordered & (c(low) >= -most) & (c(low) < c(high)) & (c(high) <= most)
    ok_zoom = c("min_zoom").between(0, 31) & c("max_zoom").between(0, 31) & (c("min_zoom") <= c("max_zoom"))
    fault = (
        F.when(~c("code").rlike("^[A-Z]{2}$") | (c("region_id") != F.concat(F.lit(REGION_PREFIX), c("code"))), "region")
        .when(~ok_zoom, "zoom").when(~c("stem").rlike(STEM) | (again > 1), "stem").when(~F.coalesce(ordered, F.lit(False)), "bounds")
    )
    return parts.select("code", "stem", fault.alias("fault")).filter("fault is not null")


def selected(states: DataFrame, selectors: DataFrame) -> DataFrame:
    """ordinal, selector, code, status: each selector (code, prefixed code or name,
    in any case) must meet exactly one state, and no state twice: the first by
    ordinal has it. states: code, name."""
    asked = F.regexp_replace(F.upper(F.trim("selector")), f"^{REGION_PREFIX}", "")
    keys = states.select("code", F.explode(F.array_distinct(F.array("code", F.upper("name")))).alias("key"))
    met = selectors.withColumn("key", asked).join(keys, "key", "left")
    one = met.groupBy("ordinal", "selector").agg(F.count("code").alias("n"), F.min("code").alias("code"))
    place = F.row_number().over(Window.partitionBy(c("n") == 1, "code").orderBy("ordinal"))
    status = F.when(c("n") == 0, "unknown").when(c("n") > 1, "ambiguous").when(place > 1, "repeated").otherwise("ok")
    return one.select("ordinal", "selector", F.when(c("n") == 1, c("code")).alias("code"), status.alias("status"))


def preflight(parts: DataFrame, source: DataFrame, zoom_override: int | None = None) -> DataFrame:
    """stem, fault: the first reason why a source can't supply a part, null if it
    can. source: one row per source_id with schema_version, pmtiles_version,
    size_bytes, actual_bytes, min_zoom, max_zoom, h_min, h_max and edges; every
    part names its source_id."""
    s = source.select("source_id", *(c(x).alias(f"s_{x}") for x in source.columns if x != "source_id"))
    top = c("max_zoom") if zoom_override is None else F.lit(zoom_override)
    narrow = (c("min_lon") < c("s_min_lon")) | (c("min_lat") < c("s_min_lat")) | (c("max_lon") > c("s_max_lon")) | (c("max_lat") > c("s_max_lat"))
    fault = (
        F.when(c("s_schema_version").isNull() & c("s_size_bytes").isNull(), "no-source")
        .when((c("s_schema_version") != SUPPORTED_SCHEMA) | (c("s_pmtiles_version") != 3), "schema").when(~c("s_actual_bytes").eqNullSafe(c("s_size_bytes")), "size")
        .when(~(c("min_zoom").between(0, 31) & (c("min_zoom") <= top) & (top <= 31)), "zoom-override")
        .when((c("min_zoom") < c("s_min_zoom")) | (top > c("s_max_zoom")), "zoom").when((c("min_zoom") < c("s_h_min")) | (top > c("s_h_max")), "header-zoom").when(narrow, "bounds")
    )
    return parts.join(s, "source_id", "left").select("stem", fault.alias("fault"))


def file_facts(files: DataFrame) -> DataFrame:
    """path, size, digest and the head of binary ``files`` (path, content): what
    the checks of built packs ask of an archive."""
    head = F.substring("content", 1, 127)
    at = lambda i: F.when(F.length(head) >= 127, F.conv(F.hex(F.substring("content", i + 1, 1)), 16, 10).cast("int"))
    is_archive = (F.length(head) >= 127) & (F.substring("content", 1, 8) == F.unhex(F.lit("504D54696C657303")))
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), is_archive.alias("is_archive"), at(100).alias("h_min"), at(101).alias("h_max"))


def verified(parts: DataFrame, archives: DataFrame, manifests: DataFrame, checksums: DataFrame, source_hash: str | None = None) -> DataFrame:
    """stem, status of each part's pack: ``ready``, ``absent``, ``incomplete`` or
    the first check that fails.

    parts: stem, region_id, min_zoom, edges. archives: stem and ``file_facts``.
    manifests: stem, region_id, schema_version, min_zoom, max_zoom, size_bytes,
    output_sha256, input_hashes (array), edges. checksums: stem, text.
    """
    a = archives.select("stem", "bytes", "sha256", "is_archive", "h_min", "h_max", F.lit(True).alias("has_a"))
    m = manifests.select("stem", *(c(x).alias(f"m_{x}") for x in ("region_id", "schema_version", "min_zoom", "max_zoom", "size_bytes", "output_sha256", "input_hashes", *EDGES)), F.lit(True).alias("has_m"))
    k = checksums.select("stem", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("words"), F.lit(True).alias("has_k"))
    met = parts.join(a, "stem", "left").join(m, "stem", "left").join(k, "stem", "left")
    there = sum((F.coalesce(c(x), F.lit(False)).cast("int") for x in ("has_a", "has_m", "has_k")), F.lit(0))
    other = (c("m_region_id") != c("region_id")) | (c("m_schema_version") != SUPPORTED_SCHEMA) | (c("m_min_zoom") != c("min_zoom")) | (c("m_max_zoom") < c("min_zoom")) | (c("m_max_zoom") > 31) | ~c("m_size_bytes").eqNullSafe(c("bytes"))
    for e in EDGES:
        other = other | ~c(f"m_{e}").eqNullSafe(c(e))
    if source_hash is not None:
        other = other | ~F.exists(F.coalesce("m_input_hashes", F.array().cast("array<string>")), lambda x: F.lower(x) == source_hash.lower())
    corrupt = ~c("m_output_sha256").eqNullSafe(c("sha256")) | (F.size("words") != 2) | ~F.lower(F.get("words", F.lit(0))).eqNullSafe(c("sha256")) | ~F.get("words", F.lit(1)).eqNullSafe(F.concat(c("stem"), F.lit(ARCHIVE)))
    status = (
        F.when(there == 0, "absent").when(there < 3, "incomplete").when(~c("is_archive"), "not-an-archive")
        .when((c("h_min") != c("m_min_zoom")) | (c("h_max") < F.coalesce("m_max_zoom", F.lit(32))), "header-zoom").when(F.coalesce(other, F.lit(True)), "metadata").when(corrupt, "corrupt").otherwise("ready")
    )
    return met.select("stem", status.alias("status"))


def ready_states(parts: DataFrame, status: DataFrame) -> DataFrame:
    """code, parts, ready, incomplete: states are ready when all their parts are."""
    met = parts.select("code", "stem").join(status, "stem", "left")
    return met.groupBy("code").agg(F.count("*").alias("parts"), F.bool_and(F.coalesce(c("status") == "ready", F.lit(False))).alias("ready"), F.sum((c("status") == "incomplete").cast("long")).alias("incomplete"))


# -- data sets ------------------------------------------------------------------------


def dataset_faults(datasets: DataFrame) -> DataFrame:
    """ordinal, fault of entries that break a rule, the first one each. datasets:
    ordinal, scale, dataset, geometry, url, archive, expected_bytes, sha256 (may be
    null)."""
    seen = F.row_number().over(Window.partitionBy("scale", "dataset").orderBy("ordinal")) > 1
    expected = F.concat(F.lit("ne_"), "scale", F.lit("_"), "dataset", F.lit(".zip"))
    missing = F.lit(False)
    for x in ("scale", "dataset", "geometry", "url", "archive", "expected_bytes"):
        missing = missing | c(x).isNull()
    host, path = F.parse_url(c("url"), F.lit("HOST")), F.element_at(F.split(F.parse_url(c("url"), F.lit("PATH")), "/"), -1)
    fault = (
        F.when(missing, "missing-field").when(seen | ~c("scale").isin(*SCALES) | ~c("geometry").isin(*GEOMETRIES), "dataset")
        .when(~c("url").startswith("https://") | ~host.eqNullSafe(F.lit(HOST)), "url").when((c("archive") != expected) | ~path.eqNullSafe(expected), "archive")
        .when(c("expected_bytes") <= 0, "size").when(c("sha256").isNotNull() & ~c("sha256").rlike("^[0-9a-fA-F]{64}$"), "sha256")
    )
    return datasets.select("ordinal", fault.alias("fault")).filter("fault is not null")


def overview_features(sources: DataFrame) -> DataFrame:
    """Features of the overview from rows of its data sets: archive, scale, use,
    and tags name, NAME, scalerank, SCALERANK. Unknown uses and scales give none.

    Adds layer, geometry, min_zoom, max_zoom, admin_level (boundaries: 0 or 1),
    name (places and waterways) and scalerank."""
    per = lambda values, key: F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in values.items()))
    rows = sources.filter(c("use").isin(*LAYERS) & c("scale").isin(*SCALES))
    return rows.withColumns({
        "layer": c("use"), "geometry": per(LAYERS, c("use")), "min_zoom": per({k: v[0] for k, v in SCALES.items()}, c("scale")), "max_zoom": per({k: v[1] for k, v in SCALES.items()}, c("scale")),
        "admin_level": F.when(c("use") == "boundary", F.when(c("archive").contains("admin_0"), 0).otherwise(1)),
        "title": F.when(c("use").isin("place", "waterway"), F.coalesce("tag_name", "tag_upper_name")), "rank": F.coalesce("tag_scalerank", "tag_upper_scalerank"),
    })


# -- probes -------------------------------------------------------------------------


def _le32(content: Column, at: int) -> Column:
    """Little-endian unsigned 32 bits at a byte; null beyond the end."""
    four = F.substring(content, at + 1, 4)
    turned = F.concat(*(F.substring(four, i, 1) for i in (4, 3, 2, 1)))
    return F.when(F.octet_length(four) == 4, F.conv(F.hex(turned), 16, 10).cast("long"))


def shapefile(dbf: Column, shp: Column) -> tuple[Column, Column]:
    """Number of records by the table's header, geometry by the shape file's; null
    for other shapes or files that are too short."""
    kind = _le32(shp, 32)
    return _le32(dbf, 4), F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in SHAPES.items()))


def zip_members(content: Column, stem: Column) -> Column:
    """Struct status, members: ``unsafe`` if a member's path is absolute or climbs, ``missing`` if one of
    the components of ``stem`` lacks, ``broken`` for no ZIP, else ``ok``; and how
    many members have the stem."""
    return F.pandas_udf(_zip_members, "struct<status: string, members: int>")(content, stem)


def _zip_members(content: pd.Series, stem: pd.Series) -> pd.DataFrame:
    out = []
    for data, name in zip(content, stem):
        try:
            paths = [PurePosixPath(x.filename) for x in zipfile.ZipFile(io.BytesIO(data or b"")).infolist()]
        except (zipfile.BadZipFile, ValueError, struct.error):
            out.append(("broken", None))
            continue
        mine = [p for p in paths if p.stem == name]
        unsafe = any(p.is_absolute() or ".." in p.parts for p in paths)
        missing = set(COMPONENTS) - {p.suffix.lower() for p in mine}
        out.append(("unsafe" if unsafe else "missing" if missing else "ok", None if unsafe else len(mine)))
    return pd.DataFrame({"status": [x for x, _ in out], "members": pd.array([n for _, n in out], "Int32")})


def _points(value) -> list[tuple[float, float]]:
    out, todo = [], [value]
    is_number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo.extend(x[k] for k in ("geometry", "geometries", "features", "coordinates") if k in x)
        elif isinstance(x, list):
            if len(x) >= 2 and is_number(x[0]) and is_number(x[1]):
                out.append((float(x[0]), float(x[1])))
            else:
                todo.extend(x)
    return out


def geojson_bounds(text: Column) -> Column:
    """Struct of edges and error: box of all coordinates of a GeoJSON text; an error for broken JSON, no
    coordinates, or some outside the Mercator square."""
    return F.pandas_udf(_geojson_bounds, "struct<min_lon: double, min_lat: double, max_lon: double, max_lat: double, error: string>")(text)


def _geojson_bounds(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        try:
            points = _points(json.loads(t or ""))
        except ValueError:
            out.append((None, None, None, None, "invalid-json"))
            continue
        if not points:
            out.append((None, None, None, None, "no-coordinates"))
            continue
        (x, y) = zip(*points)
        box = (min(x), min(y), max(x), max(y))
        inside = all(map(math.isfinite, box)) and box[0] >= -180 and box[2] <= 180 and box[1] >= -BUILDER_MAX_LAT and box[3] <= BUILDER_MAX_LAT
        out.append((*box, None) if inside else (None, None, None, None, "outside"))
    return pd.DataFrame(out, columns=[*EDGES, "error"])


# -- requests for a region ----------------------------------------------------------


def clamped(box: tuple[Column, ...], source: tuple[Column, ...]) -> tuple[Column, ...]:
    """Common part of two boxes (west, south, east, north); nulls without any."""
    w, s, e, n = F.greatest(box[0], source[0]), F.greatest(box[1], source[1]), F.least(box[2], source[2]), F.least(box[3], source[3])
    there = (w < e) & (s < n)
    return tuple(F.when(there, x) for x in (w, s, e, n))


def pin_within(lat: Column, lon: Column, source: tuple[Column, ...]) -> Column:
    return lon.between(source[0], source[2]) & lat.between(source[1], source[3])


def zoom_overlap(asked: tuple[Column, Column], held: tuple[Column, Column]) -> tuple[Column, Column]:
    """Zooms that are asked for and held; nulls without any."""
    low, high = F.greatest(asked[0], held[0]), F.least(asked[1], held[1])
    return F.when(low <= high, low), F.when(low <= high, high)


