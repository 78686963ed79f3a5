"""Registered queries over packs, catalogs, provenance, labels, tile bytes and
drawing. Inputs are made of the test tables; what SQL can read alike is in
``host_inputs``."""

from __future__ import annotations

import gzip
import io
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import camera, geo, kinds, wire
from tessera.operators import catalogs, directory, inspect, labels, manifests, provenance, raster, render
from tessera.plans import host_inputs as i
from tessera.plans import queries as q
from tessera.plans import surrogate as s

c = F.col
EDGES = manifests.EDGES


def take(spark, d, name):
    """An input that SQL reads alike."""
    table, columns = i.INPUTS[name]
    return s.read(spark, d, table).selectExpr(*(f"{i.spark(v)} as {k}" for k, v in columns.items()))


def texts(*names):
    """Arrays as one text, so that results compare."""
    return [F.concat_ws("|", n).alias(n) for n in names]


# -- bytes and tiles ---------------------------------------------------------------


def read_clamp(spark, d):
    return take(spark, d, "reads").withColumn("n", geo.readable(c("start"), c("len"), c("size")))


def _wanted(spark, d):
    t = take(spark, d, "wanted")
    return t.withColumn("tile_id", geo.tile_id(c("z"), c("x"), c("y")))


def _entries(spark, d):
    return directory.decode_columns(q._encoded(spark, d))


def tile_by_place(spark, d):
    """Offset and length of tiles by zoom, x and y, and whether they are there."""
    got = directory.lookup(_wanted(spark, d), _entries(spark, d))
    return got.select("event_id", "archive", "z", "x", "y", c("offset").isNotNull().alias("there"), "offset", "length")


def _encoded_tiles(spark, d):
    """A vector tile of the parts of each of 40 places, encoded by groups."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        layers: dict = {}
        for r in pdf.sort_values("k").itertuples():
            line = [(int(r.x) + 7 * j, int(r.y) - 3 * j) for j in range(r.points)]
            props = {"name": r.name, "rank": int(r.rank)} | ({"big": True} if r.rank > 25 else {}) | {"share": float(r.rank) / 4}
            layers.setdefault(r.layer, []).append((r.geometry, [line], props))
        return pd.DataFrame({"archive": ["a"], "tile_id": [pdf.tile_id.iloc[0]], "run_length": [1], "tile_compression": ["gzip"], "payload": [gzip.compress(wire.encode_tile(sorted(layers.items())), 1, mtime=0)]})

    return take(spark, d, "shapes").groupBy("tile_id").applyInPandas(encode, "archive string, tile_id long, run_length long, tile_compression string, payload binary")


def _decoded(spark, d):
    from tessera.sources.archive import features

    return features(_encoded_tiles(spark, d))


def mvt_roundtrip(spark, d):
    """Features of the parts, encoded as vector tiles and decoded again."""
    value = lambda k: inspect.first_value(c("props"), k)
    path = c("paths")[0]
    total = lambda axis: F.aggregate(path, F.lit(0).cast("long"), lambda n, p: n + p[axis])
    return _decoded(spark, d).select("tile_id", "layer", "feature_ordinal", "geom_type", F.size("paths").alias("paths"), F.size(path).alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"), value("name")["s"].alias("name"), inspect.display(value("share")).alias("share"), F.coalesce(value("big")["b"], F.lit(False)).alias("big"))


def tile_accounts(spark, d):
    """Accounts of decoded tiles, kinds by the layers of the overview."""
    sized = inspect.feature_sizes(_decoded(spark, d)).withColumn("kind", kinds.overview(c("layer")))
    out = inspect.tile_accounts(sized, "tile_id")
    return out.withColumn("classified_share", F.round(inspect.ratio(c("classified"), c("features")), 6))


def pmtiles_roundtrip(spark, d):
    """Tiles of five archives, written by tasks and read by the data source: each
    tile with the digest of its bytes."""
    from tessera.sources.archive import read_archive, tiles, write_archives

    folder = _folder(spark, "archives")
    t = take(spark, d, "stored")
    write_archives(t.select(F.concat(F.lit("a"), c("archive").cast("string")).alias("archive"), "tile_id", F.concat(F.lit("tile "), c("content").cast("string")).alias("payload")), folder, leaf_size=16)
    held = tiles(read_archive(spark, folder, "tiles"))
    name = F.regexp_extract("archive", r"a([0-9]+)\.pmtiles$", 1).cast("long")
    raw = F.pandas_udf(lambda v: v.map(lambda b: wire.decompress(b, "gzip", 1000)), "binary")(c("payload"))
    return held.select(name.alias("archive"), "tile_id", "z", F.sha2(raw, 256).alias("sha256"))


def _folder(spark, name):
    """A new folder that all executors share."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def gzip_status(spark, d):
    """Gzip members, whole and broken in five ways, strictly and leniently read."""

    def run(batches):
        for b in batches:
            out = []
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = gzip.compress(name.encode() * (k % 50 + 1), mtime=0)
                cut = {1: data[:-9], 2: data[:-8] + bytes([data[-8] ^ 1]) + data[-7:], 3: b"x" + data, 4: data + data, 5: data[:-1] + bytes([data[-1] ^ 1])}.get(k % 6, data)
                try:
                    strict = len(wire.decompress(cut, "gzip", 1 << 20))
                except ValueError:
                    strict = None
                out.append((k, strict, *wire.gzip_report(cut, 1 << 20)))
            yield pa.RecordBatch.from_pylist([dict(zip(("k", "bytes", "status", "loose_bytes", "crc_ok"), r)) for r in out], pa.schema([("k", pa.int64()), ("bytes", pa.int64()), ("status", pa.string()), ("loose_bytes", pa.int64()), ("crc_ok", pa.bool_())]))

    return take(spark, d, "named").select("k", "name").mapInArrow(run, "k long, bytes long, status string, loose_bytes long, crc_ok boolean")


def payload_summary(spark, d):
    out = inspect.payload_summary(_entries(spark, d))
    return out.select("archive", "addressed", "entries", "contents", "bytes", "max_bytes", *(F.round(x, 6).alias(x) for x in ("median_bytes", "p95_bytes", "mean_bytes")))


def property_display(spark, d):
    """Values of all types as text."""
    t = take(spark, d, "values")
    v = F.struct(c("t"), c("text").alias("s"), c("d"), c("n").alias("i"), c("n").cast("decimal(20,0)").alias("u"), (c("n") % 2 == 0).alias("b"))
    return t.select("k", inspect.display(v).alias("shown"), inspect.number(v).alias("number"))


def frame_totals(spark, d):
    """Totals of frames over the tiles of every view."""
    seen = camera.tile_placements(s.views(spark, d)).groupBy("view_id", "x", "y").agg(F.count("*").alias("copies"))
    k = c("x") * 31 + c("y") * 17 + c("view_id")
    status = F.when(k % 5 == 0, "missing").when(k % 11 == 0, "skipped").otherwise("present")
    t = seen.select("view_id", "copies", status.alias("status"), (k % 90).cast("long").alias("features"), (k % 700).cast("long").alias("stored"), (k % 900 + 100).cast("long").alias("raw"), (k % 7).cast("long").alias("lookup"), (k % 13).cast("long").alias("decode"), (k % 3).cast("long").alias("draw"))
    return inspect.frame_totals(t, ("lookup", "decode", "draw"), "view_id")


def primitive_counts(spark, d):
    return inspect.primitive_counts(take(spark, d, "prims"), "frame")


def deepest_pack(spark, d):
    return inspect.deepest(take(spark, d, "depths"), "region")


def content_digests(spark, d):
    return inspect.digests(take(spark, d, "named").select(c("k").alias("path"), c("name").cast("binary").alias("content")))


# -- manifests ------------------------------------------------------------------------


def _manifest_texts(spark, d):
    """A manifest for each supplier's pack as JSON text."""
    p = s.packs(spark, d)
    order = [*manifests.TEXT_FIELDS, "min_zoom", "max_zoom", "pmtiles_version", "size_bytes", "priority", "required_attribution"]
    sources = F.transform("provenance_ids", lambda x: F.struct(x.alias("provenance_id"))).alias("sources")
    return p.withColumn("text", F.to_json(F.struct(*order, F.struct(*EDGES).alias("bounds"), sources)))


#: what is done to the text of a manifest, by ordinal
BROKEN = {
    1: "substring(text, 1, length(text) - 5)", 2: "'[]'", 3: "replace(text, '\"region_name\":\"Region\"', '\"region_name\":7')", 4: "replace(text, '\"builder\":', '\"maker\":')",
    5: "replace(text, '\"pmtiles_version\":3', '\"pmtiles_version\":3.5')", 6: "concat('{\"x\":', repeat('[', 13), repeat(']', 13), ',', substring(text, 2))", 7: "concat(text, repeat(' ', 70000))", 8: "concat(text, 'x')",
    9: "concat('{\"priority\":\"a\",', substring(text, 2))", 10: "replace(text, '\"builder_version\":\"1\"', '\"builder_version\":\"\\\\u00e9\\\\ud800\"')", 11: "replace(text, '\"provenance_id\"', '\"id\"')", 12: "replace(text, '[\"credit\"]', '[\"credit\",1]')",
    13: "replace(text, '\"pmtiles_version\":3', '\"pmtiles_version\":+03e0')", 14: "replace(text, '\"pmtiles_version\":3', '\"pmtiles_version\":1e999')", 15: "concat('{\"x\":', repeat('[', 12), repeat(']', 12), ',', substring(text, 2))",
}


def _broken_texts(spark, d, kinds_of):
    rule = F.col("text")
    for k in kinds_of:
        rule = F.when(c("ordinal") % 16 == k, F.expr(BROKEN[k])).otherwise(rule)
    return _manifest_texts(spark, d).select("ordinal", "name", rule.alias("text"))


def manifest_json(spark, d):
    """Strict reading of manifests, most of them broken in one way."""
    files = _broken_texts(spark, d, BROKEN).select("ordinal", "name", c("text").cast("binary").alias("content"))
    return manifests.parse_manifests(files).select("ordinal", "error", "min_lon", "max_zoom", "pmtiles_version", "priority", "builder_version", F.size("provenance_ids").alias("sources"))


def pack_discovery(spark, d):
    """One reason for every manifest of a folder."""
    files = _broken_texts(spark, d, (1, 2, 4)).select("name", F.when(c("ordinal") % 25 != 3, c("text").cast("binary")).alias("content"))
    sizes = s.packs(spark, d).filter("ordinal % 7 <> 2").select(manifests.archive_of(c("name")).alias("name"), (c("size_bytes") + F.when(c("ordinal") % 9 == 4, 1).otherwise(0)).alias("size_bytes"))
    return manifests.discover(files, sizes)


def manifest_names(spark, d):
    t = take(spark, d, "files")
    return t.select("k", manifests.is_manifest_name(c("file")).alias("listed"), manifests.archive_of(c("file")).alias("archive"), manifests.join_path(c("folder"), c("file")).alias("path"))


def header_agreement(spark, d):
    p = s.packs(spark, d)
    held = p.filter("ordinal % 8 <> 5").select(manifests.archive_of(c("name")).alias("name"), *((F.round(c(e) * 1e7).cast("long") + F.when(c("ordinal") % 6 == 1, 20).otherwise(3)).alias(f"{e}_e7") for e in EDGES), (c("min_zoom") + F.when(c("ordinal") % 10 == 0, 1).otherwise(0)).alias("min_zoom"), c("max_zoom"))
    return manifests.header_agreement(p, held)


def sidecars(spark, d):
    p = s.packs(spark, d).withColumns({"stem": F.regexp_replace("name", r"\.manifest\.json$", ""), "content": c("display_name").cast("binary"), "sources": F.transform("provenance_ids", lambda x: F.struct(x.alias("provenance_id"))), "attribution_links": F.array().cast("array<string>")})
    return manifests.sidecars(p).select("stem", F.get_json_object("manifest", "$.output_sha256").alias("sha256"), F.get_json_object("manifest", "$.size_bytes").cast("long").alias("bytes"), F.get_json_object("manifest", "$.bounds.max_lat").cast("double").alias("max_lat"), F.get_json_object("manifest", "$.sources[0].provenance_id").alias("source"), "checksum")


# -- provenance -----------------------------------------------------------------------


def provenance_audit(spark, d):
    return provenance.audit(take(spark, d, "records"))


def pack_sources(spark, d):
    return provenance.pack_sources(take(spark, d, "sourced"), take(spark, d, "records"))


def schema_credits(spark, d):
    """What the schema asks for, before and after it is added."""
    t = take(spark, d, "credited")
    done = provenance.with_schema_credits(t.withColumn("fault", provenance.schema_fault()).withColumn("primary_id", provenance.primary_source()))
    return done.withColumn("fault_after", provenance.schema_fault()).select("k", "fault", "primary_id", "fault_after", *texts("required_attribution", "attribution_links", "provenance_ids"))


def same_inputs(spark, d):
    """Pinned inputs against local ones, by supplier nation."""
    t = take(spark, d, "pinned")
    local = t.filter("k % 19 <> 3").withColumn("sha256", F.when(c("k") % 23 == 4, "other").otherwise(c("sha256")))
    return provenance.same_records(t, local, "grp", ("archive", "sha256"))


# -- catalogs -------------------------------------------------------------------------


def target_faults(spark, d):
    return catalogs.target_faults(take(spark, d, "targets"))


def state_selection(spark, d):
    return catalogs.selected(take(spark, d, "states"), take(spark, d, "selectors"))


def build_preflight(spark, d):
    return catalogs.preflight(take(spark, d, "targets"), take(spark, d, "supplies"))


def _built(spark, d):
    t = take(spark, d, "targets").filter("fault_free")
    content = F.concat(F.expr("unhex('504D54696C657303')"), F.expr("cast(repeat('x', 92) as binary)"), F.expr("unhex(lpad(hex(cast(min_zoom + case when k % 13 = 0 then 1 else 0 end as bigint)), 2, '0'))"), F.expr("unhex(lpad(hex(cast(max_zoom as bigint)), 2, '0'))"), F.expr("cast(concat(repeat('y', 30), stem) as binary)"))
    files = t.filter("k % 11 <> 1").select("stem", c("stem").alias("path"), F.when(c("k") % 17 == 2, F.lit(b"short")).otherwise(content).alias("content"), "k")
    facts = catalogs.file_facts(files).withColumnRenamed("path", "stem")
    told = t.filter("not (k % 11 = 2 or (k % 11 = 1 and k % 2 = 0))").join(facts.select("stem", "bytes", "sha256"), "stem", "left").select("stem", "region_id", F.lit(catalogs.SUPPORTED_SCHEMA).alias("schema_version"), "min_zoom", F.when(c("k") % 19 == 3, 40).otherwise(c("max_zoom")).alias("max_zoom"), c("bytes").alias("size_bytes"), c("sha256").alias("output_sha256"), F.array(F.lit("H")).alias("input_hashes"), *EDGES)
    sums = files.filter("k % 11 <> 3").select("stem", F.concat(F.when(c("k") % 23 == 4, "0").otherwise(F.sha2("content", 256)), F.lit("  "), c("stem"), F.lit(".pmtiles\n")).alias("text"))
    return t, catalogs.verified(t, facts, told, sums, "h")


def built_packs(spark, d):
    return _built(spark, d)[1]


def ready_states(spark, d):
    t, status = _built(spark, d)
    return catalogs.ready_states(t, status)


def dataset_faults(spark, d):
    return catalogs.dataset_faults(take(spark, d, "datasets"))


def overview_features(spark, d):
    t = catalogs.overview_features(take(spark, d, "overview"))
    return t.select("k", "layer", "geometry", "min_zoom", "max_zoom", "admin_level", "title", "rank")


def shapefile_probe(spark, d):
    t = take(spark, d, "named").withColumn("kind", F.expr("cast(element_at(array(1, 3, 5, 8, 13, 15, 18, 31), cast(k % 8 + 1 as int)) as bigint)"))
    le = lambda v: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(v, 8 * j).bitwiseAND(255)), 2, "0")) for j in range(4)))
    dbf = F.concat(F.lit(b"\x03abc"), le(c("k") * 1000))
    shp = F.when(c("k") % 10 == 9, F.lit(b"cut off")).otherwise(F.concat(F.lit(b"\x00" * 32), le(c("kind"))))
    n, geometry_of = catalogs.shapefile(dbf, shp)
    return t.select("k", n.alias("records"), geometry_of.alias("geometry"))


def zip_check(spark, d):
    def archive(k: pd.Series) -> pd.Series:
        out = []
        for v in k.tolist():
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for suffix in catalogs.COMPONENTS[: 3 if v % 5 == 1 else 4]:
                    z.writestr(f"dir/s{v}{suffix.upper() if v % 2 else suffix}", b"")
                z.writestr("../up.txt" if v % 7 == 2 else "/root.txt" if v % 7 == 3 else "readme.txt", b"")
            out.append(held.getvalue()[: 20 if v % 9 == 4 else None])
        return pd.Series(out)

    t = take(spark, d, "named")
    return t.withColumn("r", catalogs.zip_members(F.pandas_udf(archive, "binary")("k"), F.concat(F.lit("s"), c("k").cast("string")))).select("k", "r.status", "r.members")


def geojson_box(spark, d):
    t = take(spark, d, "geojson")
    return t.withColumn("b", catalogs.geojson_bounds(c("text"))).select("k", *(c(f"b.{e}").alias(e) for e in EDGES), "b.error")


def region_requests(spark, d):
    """Boxes around pins, cut to what a source holds, and the zooms that it has."""
    t = take(spark, d, "regions")
    own, held = (tuple(c(p + e) for e in EDGES) for p in ("", "s_"))
    low, high = catalogs.zoom_overlap((c("lo"), c("hi")), (c("s_lo"), c("s_hi")))
    return t.select("k", *(x.alias(e) for x, e in zip(catalogs.clamped(own, held), EDGES)), catalogs.pin_within(c("lat"), c("lon"), held).alias("inside"), low.alias("low"), high.alias("high"))


# -- cameras --------------------------------------------------------------------------


def picker_begin(spark, d):
    t = take(spark, d, "pickers")
    return t.select("k", camera.usable_bounds().alias("usable"), *(q.r6(v, n) if n.startswith("start") else v.alias(n) for n, v in camera.picker_begin(c("lo"), c("hi")).items()))


def camera_moves(spark, d):
    """New centres, zooms and screens, with some that are refused."""
    t = take(spark, d, "moves")
    at, size = camera.moved_to(c("to_lat"), c("to_lon")), camera.resized(c("to_width"), c("to_height"))
    return t.select("k", camera.valid().alias("valid"), q.r6(at["lat"], "lat"), q.r6(at["lon"], "lon"), camera.zoomed_to(c("to_zoom")).alias("zoom"), size["width"].alias("width"), size["height"].alias("height"))


def screen_maps(spark, d):
    """Where every tile copy on screen lies; its nearest copy; in 1/65536 pixels."""
    t = camera.tile_placements(s.views(spark, d))
    m = camera.screen_map(c("unwrapped_x"), c("y"), F.lit(4096))
    return t.select("view_id", "x", "y", "unwrapped_x", camera.nearest_placement(c("x"), c("n")).alias("nearest_x"), F.round(m["sx"], 3).alias("sx"), F.round(m["sy"], 3).alias("sy"), m["scale_q16"].alias("scale_q16"))


# -- features on the screen -------------------------------------------------------------


def _placed(spark, d):
    """Shapes of a tile on all copies of it in the first views."""
    m = {k: v for k, v in camera.screen_map(c("unwrapped_x"), c("y"), F.lit(4096)).items() if k.endswith("q16")}
    copies = camera.tile_placements(s.views(spark, d)).withColumns(m)
    rules = kinds.style_rules(spark).filter(c("style") == kinds.DEFAULT_STYLE)
    t = take(spark, d, "polys").withColumns({"kind": kinds.openmaptiles(c("layer"), F.lit(None).cast("string"), F.lit(None).cast("string"), c("geom_type"))})
    paths = F.expr("array(transform(sequence(0, points - 1), j -> struct(cast(px + 40 * j as int) as x, cast(py + (j % 3) * 90 as int) as y)))")
    met = render.on_copies(t.withColumn("paths", paths), copies)
    styled = met.join(F.broadcast(rules), "kind", "left")
    return styled.filter(render.drawable(kinds.shown(c("zoom")), c("kind")))


def screen_features(spark, d):
    """Projected features of drawable kinds with painted bounds."""
    f = render.to_screen(_placed(spark, d))
    return f.select("view_id", "k", "unwrapped_x", "kind", F.size("screen").alias("paths"), *("min_x", "min_y", "max_x", "max_y"), F.coalesce(F.get("sign", F.lit(0)), F.lit(9)).alias("sign"))


def feature_bands(spark, d):
    """How many features each band of each view has to draw."""
    f = render.in_bands(render.to_screen(_placed(spark, d)), 720, 90)
    return f.groupBy("view_id", "band").agg(F.count("*").alias("features"))


def _rects(spark, d):
    rect = "array(array(struct(cast(x as int) as x, cast(y as int) as y), struct(cast(w as int) as x, cast(h as int) as y)))"
    return take(spark, d, "rects").selectExpr("frame", "ordinal", "rgb", "'rect' as shape", "0 as px", f"{rect} as paths")


def painter_composite(spark, d):
    """Pixels that each rectangle keeps in its frame when all are painted."""
    pixels = raster.composite(raster.spans(_rects(spark, d), 96, 64))
    return pixels.groupBy("frame", "rgb").agg(F.count("*").alias("pixels"), F.min("x").alias("x0"), F.max("y").alias("y1"))


def painter_banded(spark, d):
    """The same picture, drawn in bands."""
    pixels = render.draw_banded(_rects(spark, d), 96, 64, 16)
    return pixels.groupBy("frame", "rgb").agg(F.count("*").alias("pixels"), F.min("x").alias("x0"), F.max("y").alias("y1"))


def polygon_spans(spark, d):
    """Filled rows of every order's ring, scaled to 64 x 64."""
    small = F.transform("points", lambda p: F.struct(F.shiftright(p["x"], 6).alias("x"), F.shiftright(p["y"], 6).alias("y")))
    shapes = s.rings(spark, d).select(F.lit(0).alias("frame"), c("ring").alias("ordinal"), F.lit(1).alias("rgb"), F.lit("fill").alias("shape"), F.lit(0).alias("px"), F.array(small).alias("paths"))
    return raster.spans(shapes, 64, 64).groupBy(c("ordinal").alias("ring")).agg(F.count("*").alias("spans"), F.sum((c("x1") - c("x0") + 1).cast("long")).alias("pixels"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def stroke_pixels(spark, d):
    """Pixels that strokes of straight and diagonal lines paint."""
    t = take(spark, d, "strokes")
    line = "array(array(struct(cast(x as int) as x, cast(y as int) as y), struct(cast(x + dx as int) as x, cast(y + dy as int) as y)))"
    shapes = t.selectExpr("0 as frame", "k as ordinal", "1 as rgb", "'stroke' as shape", "px", f"{line} as paths")
    return raster.spans(shapes, 96, 64).groupBy(c("ordinal").alias("k")).agg(F.sum((c("x1") - c("x0") + 1).cast("long")).alias("pixels"), F.min("x0").alias("x0"), F.max("y").alias("y1"))


def tile_scissors(spark, d):
    t = take(spark, d, "rects").selectExpr("ordinal", "x as x0", "x + w - 1 as x1", "y", "frame * 16 as clip_x", "frame * 8 as clip_y", "cast(32 as bigint) as ts")
    return render.scissor(t).select("ordinal", "y", "x0", "x1")


# -- labels ---------------------------------------------------------------------------


def label_offers(spark, d):
    """Place features that offer labels, with name, priority and point."""
    t = take(spark, d, "places")
    prop = lambda key, value, kind: F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(F.lit(kind).alias("t"), (value.cast("string") if kind == "string" else F.lit(None).cast("string")).alias("s"), (value.cast("double") if kind == "double" else F.lit(None).cast("double")).alias("d"), (value.cast("long") if kind == "int" else F.lit(None).cast("long")).alias("i"), F.lit(None).cast("decimal(20,0)").alias("u"), F.lit(None).cast("boolean").alias("b")).alias("value")))
    props = F.filter(F.array(prop("name", c("local_name"), "string"), prop("name:en", c("english"), "string"), prop("scalerank", c("scalerank"), "int"), prop("population_rank", c("population"), "double"), prop("min_zoom", c("from_zoom"), "int"), prop("name", F.lit("late"), "string")), lambda p: p.isNotNull())
    point = F.array(F.array(F.struct(c("x").cast("int").alias("x"), c("y").cast("int").alias("y"))))
    rows = t.select("k", "layer", "geom_type", "kind", "shown", F.lit(4096).alias("extent"), point.alias("paths"), props.alias("props"))
    return labels.offers(rows, F.lit(6)).select("k", "text", "priority", "local_x", "local_y")


def label_stats(spark, d):
    t = take(spark, d, "candidates")
    return labels.offer_stats(t, 1000, 500)


def label_scripts(spark, d):
    """Valid and simple texts among byte strings, and their size on screen."""
    t = take(spark, d, "scripts").withColumn("raw", F.unhex("octets"))
    e = labels.text_extent(c("raw").cast("string"))
    return t.select("k", labels.printable_bytes(c("raw")).alias("valid"), labels.simple_text(c("raw")).alias("simple"), F.when(labels.printable_bytes(c("raw")), e["width"]).alias("width"))


# -- names and styles -------------------------------------------------------------------


def code_names(spark, d):
    t = take(spark, d, "codes")
    named = {"kind": kinds.KINDS, "rule": kinds.RULES, "json_error": manifests.JSON_ERRORS, "rejection": manifests.REJECTIONS, "compression": wire.COMPRESSIONS, "tile_type": kinds.TILE_TYPES}
    return t.select("k", *(kinds.name_of(c("code"), v).alias(n) for n, v in named.items()))


def profile_kinds(spark, d):
    """Kinds by the profile that a pack names; unknown profiles give none."""
    roads = s.roads(spark, d)
    profile = F.element_at(F.array(*map(F.lit, (*kinds.PROFILES, "other-1", "my-overview"))), (c("l_orderkey") % 5 + 1).cast("int"))
    known = kinds.known_profile(profile, {"my-overview": kinds.PROFILES[1]})
    k = kinds.for_profile(known, c("layer"), c("class"), c("subclass"), c("kind"), c("kind_detail"), c("geometry"))
    return roads.select(profile.alias("profile"), k.alias("kind_out")).groupBy("profile", "kind_out").agg(F.count("*").alias("n"))


def drag_layers(spark, d):
    """Features left while the map is dragged, and the kinds that its style shows."""
    roads = s.roads(spark, d).filter(~c("layer").isin(*kinds.DRAG_LAYERS))
    k = kinds.openmaptiles(c("layer"), c("class"), c("subclass"), c("geometry"))
    rules = kinds.drag_style(kinds.style_rules(spark).filter(c("style") == kinds.DEFAULT_STYLE)).select("kind", "visible")
    return roads.withColumn("k", k).join(F.broadcast(rules.withColumnRenamed("kind", "k")), "k").groupBy("k").agg(F.count("*").alias("n"), F.count(F.when(render.drawable(c("visible"), c("k")), 1)).alias("drawn"))


def style_choice(spark, d):
    return take(spark, d, "styles").select("k", kinds.style_or(c("wanted"), c("held")).alias("style"))


def tile_cache_keys(spark, d):
    t = take(spark, d, "named").withColumn("key", kinds.cache_key(c("name"), F.lit("standard-light"), (c("k") % 3).cast("int")))
    return t.select("k", "key.pack", "key.style", "key.version", "key.renderer")


def metric_records(spark, d):
    t = take(spark, d, "frames")
    return inspect.metric_lines(t, "frame", "frame", "scenario", "ms", "heap").withColumnRenamed("value", "line")

