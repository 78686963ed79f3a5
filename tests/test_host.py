"""Packs, manifests, catalogs, probes and tile bytes on small fixtures."""

import gzip
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import wire
from tessera.operators import catalogs, inspect, labels, manifests, provenance, raster, render
from tessera.operators.geometry import clip_arrays, clip_segment
from tessera.sources import archive


def manifest_text(region="x", **more):
    """A valid manifest of a region."""
    west, south, east, north = -10.0, -5.0, 10.0, 5.0
    fields = dict(pack_version="1", display_name="D", region_id=region, region_name="R", content_profile="basemap", schema_version="protomaps-v4", source_snapshot="S1", builder="b", builder_version="1", builder_commit="c", build_date="2024-01-01", pack_class="open", output_sha256="0" * 64, min_zoom=0, max_zoom=5, pmtiles_version=3, size_bytes=4)
    fields |= {"pack_id": f"s1__protomaps-v4__basemap__{region}__b-100000000_-50000000_100000000_50000000__z0-5", "bounds": dict(min_lon=west, min_lat=south, max_lon=east, max_lat=north), "sources": [{"provenance_id": "osm"}], "required_attribution": ["c"]}
    return json.dumps(fields | more)


def fault(text):
    try:
        return manifests.parse_json(text if isinstance(text, bytes) else text.encode())
    except manifests.JsonError as e:
        return e.code


def test_strict_json():
    good = {"[]": [], " {} ": {}, "[1,-2.5,+3,007,.5,1.]": [1, -2.5, 3, 7, 0.5, 1], '{"a":1,"a":2}': {"a": 2}, "[true,false,null]": [True, False, None], '"\\ud83d\\u00e9\\/\\n"': "\ufffdé/\n", "1e2": 100.0, '"raw\ttab"': "raw\ttab", "[" * 12 + "]" * 12: fault("[" * 12 + "]" * 12)}
    for text, want in good.items():
        assert fault(text) == want, text
    for text in ("", " ", "{", "[1,]", "[1 2]", '{"a"}', "{a:1}", '{"a":1,}', "tru", "nulls", "1e", "1e+", "+", "-", ".", "1e999", "[1]x", '"a', '"\\x"', '"\\u12"', "01x", "NaN", "Infinity", "'a'", "[" * 12):
        assert fault(text) == "malformed", text
    assert fault("[" * 14) == "too-deep" and fault("[" * 14 + "]" * 14) == "too-deep" and isinstance(fault("[" * 13 + "]" * 13), list)
    assert fault("[" * 200_000) == "too-deep"
    rng = random.Random(1)
    for _ in range(400):  # plain JSON of the standard library reads alike
        value = rng.choice([rng.random() * 1e6, "é\"\\" * rng.randrange(3), None, True, {"k": [1.0, {"x": "y"}]}, [[], {}, [0.5]]])
        for text in (json.dumps(value), json.dumps(value, indent=1, ensure_ascii=False)):
            assert fault(text) == value


def test_manifest_folder(spark, tmp_path):
    """Discovery over real files: order, reasons, what is never listed."""
    put = lambda name, data: (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    for name, text in {"a": manifest_text(), "b": manifest_text(), "c": "[]", "d": manifest_text("d", pack_class="closed"), "e": manifest_text("e"), "f": manifest_text("f"), "g": manifest_text("g") + " " * 70_000, "h h": manifest_text("h"), ".i": manifest_text("i")}.items():
        put(f"{name}.manifest.json", text)
    for name in ("a", "b", "c", "d", "g", "h h"):
        put(f"{name}.pmtiles", b"1234")
    put("f.pmtiles", b"123")
    os.mkdir(tmp_path / "sub")
    put("sub/j.manifest.json", manifest_text("j"))
    where = f"file://{tmp_path}"
    files = manifests.read_manifests(spark, where)
    assert [r.name[0] for r in files.collect()] == list("abcdefgh")
    got = {r.name[0]: (r.rejection, r.detail) for r in manifests.discover(files, manifests.archive_sizes(spark, where)).collect()}
    assert got == {"a": (None, None), "b": ("duplicate", None), "c": ("bad-json", "not-an-object"), "d": ("invalid-manifest", "compatibility"), "e": ("archive-missing", "e.pmtiles"), "f": ("archive-size-mismatch", "f.pmtiles"), "g": ("unreadable", None), "h": (None, None)}
    os.mkdir(tmp_path / "empty")
    assert manifests.read_manifests(spark, where + "/empty").collect() == []
    with pytest.raises(Exception):
        manifests.read_manifests(spark, where + "/nowhere").collect()


def test_sidecar_files_are_read_back(spark, tmp_path):
    fields = json.loads(manifest_text())
    row = {k: v for k, v in fields.items() if k not in ("bounds", "output_sha256", "size_bytes")} | fields["bounds"] | {"stem": "a b", "content": bytearray(b"1234"), "attribution_links": ["l"]}
    built = spark.createDataFrame([row], "stem string, content binary, " + ", ".join(f"{k} string" for k in manifests.TEXT_FIELDS if k != "output_sha256") + ", min_lon double, min_lat double, max_lon double, max_lat double, min_zoom int, max_zoom int, pmtiles_version int, priority int, sources array<struct<provenance_id: string>>, required_attribution array<string>, attribution_links array<string>")
    manifests.write_sidecars(manifests.sidecars(built.withColumn("priority", F.lit(7))), str(tmp_path))
    (tmp_path / "a b.pmtiles").write_bytes(b"1234")
    read = manifests.parse_manifests(manifests.read_manifests(spark, f"file://{tmp_path}")).first()
    assert (read.error, read.priority, read.size_bytes, read.provenance_ids) == ("none", 7, 4, ["osm"])
    digest, name = (tmp_path / "a b.sha256").read_text().split("  ")
    assert digest == read.output_sha256 and name == "a b.pmtiles\n"
    found = manifests.discover(manifests.read_manifests(spark, f"file://{tmp_path}"), manifests.archive_sizes(spark, f"file://{tmp_path}")).first()
    assert found.rejection is None and sorted(os.listdir(tmp_path)) == ["a b.manifest.json", "a b.pmtiles", "a b.sha256"]


def test_registry_files(spark, tmp_path):
    record = {"id": "osm", "name": "n", "publisher": "p", "source": {"url": "https://u", "retrieved": "2024-01-01"}, "rights": {"license": "L", "license_class": "ODBL"} | {k: k != "source_disclosure_required" for k in provenance.RIGHTS}, "evidence": {"rights_url": "https://r", "reviewed_date": "2024-01-01", "confidence": "CONFIRMED"}, "policy": {"official_pack_allowed": True, "clean_pack_allowed": False}}
    for name, text in {"osm.json": json.dumps(record), "other.json": json.dumps(record | {"rights": record["rights"] | {"share_alike_required": False}}), "bad.json": "{", "list.json": "[1]"}.items():
        (tmp_path / name).write_text(text)
    got = {tuple(r) for r in provenance.audit(provenance.read_records(spark, f"file://{tmp_path}")).collect()}
    assert got == {("other.json", "id-filename-mismatch", "id"), ("other.json", "duplicate-id", "id"), ("bad.json", "invalid-json", ""), ("list.json", "invalid-json", "")}


def test_clip_of_arrays():
    rng = np.random.default_rng(3)
    for reach, frame in ((40, (-7, -3, 20, 11)), (1 << 20, (0, 0, 1279, 719)), (5, (0, 0, 0, 0))):
        ends = rng.integers(-reach, reach + 1, (4, 3000))
        keep, *got = clip_arrays(*ends, *frame)
        for i in range(3000):
            want = clip_segment(*ends[:, i].tolist(), *frame)
            assert (want is not None) == keep[i] and (want is None or want == tuple(int(g[i]) for g in got))


def test_bands_draw_the_same_picture(spark):
    """Strokes, fills, points and rectangles of several frames, whole and in bands."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        shape = rng.choice(["point", "rect", "stroke", "fill"])
        points = [{"x": rng.randrange(-20, 120), "y": rng.randrange(-20, 90)} for _ in range({"point": 2, "rect": 1, "stroke": 4, "fill": 5}[shape])]
        paths = [[points[0], {"x": rng.randrange(1, 40), "y": rng.randrange(1, 30)}]] if shape == "rect" else [points]
        rows.append((i % 2, i, shape, 0x10101 * i, rng.randrange(1, 9), paths))
    shapes = spark.createDataFrame(rows, "frame long, ordinal long, shape string, rgb int, px int, paths array<array<struct<x: int, y: int>>>")
    whole = {tuple(r) for r in raster.composite(raster.spans(shapes, 100, 70)).collect()}
    assert whole and whole == {tuple(r) for r in render.draw_banded(shapes, 100, 70, 16).collect()} == {tuple(r) for r in render.draw_banded(shapes, 100, 70, 7).collect()}


def test_tiles_by_place(spark, tmp_path):
    tiles = {archive.tile_id(3, x, y): f"{x}-{y}".encode() for x in range(8) for y in range(8) if (x + y) % 3}
    (tmp_path / "a.pmtiles").write_bytes(archive.encode_archive(tiles, leaf_size=5, compression="gzip"))
    got = archive.tiles(archive.read_archive(spark, f"file://{tmp_path}/a.pmtiles", tiles="3/1/1,3/0/0,3/7/6,3/2/5,2/0/0")).select("z", "x", "y", "payload").collect()
    assert {(r.z, r.x, r.y): gzip.decompress(bytes(r.payload)) for r in got} == {(3, 1, 1): b"1-1", (3, 7, 6): b"7-6", (3, 2, 5): b"2-5"}
    zoom, x, y = archive.tile_places(np.array([archive.tile_id(5, i, 31 - i) for i in range(32)]))
    assert list(zip(zoom.tolist(), x.tolist(), y.tolist())) == [(5, i, 31 - i) for i in range(32)]
    for bad in ("3/8/0", "32/0/0", "1/-1/0"):
        with pytest.raises(Exception):
            archive.read_archive(spark, f"file://{tmp_path}/a.pmtiles", tiles=bad).collect()


def test_gzip_report_and_varints():
    data = gzip.compress(b"tile " * 100)
    assert wire.gzip_report(data, 500) == ("ok", 500, True) and wire.gzip_report(data, 499)[0] == "large" and wire.gzip_report(None, 9)[0] == "broken"
    named = data[:3] + bytes([8 | 4 | 2]) + data[4:10] + b"\3\0abc" + b"file\0" + b"\1\2" + data[10:]
    assert wire.gzip_report(named, 500) == ("ok", 500, True)
    rng = random.Random(2)
    numbers = [rng.getrandbits(rng.choice([1, 7, 8, 31, 64])) for _ in range(500)]
    assert wire.varints(b"".join(map(wire.to_varint, numbers))) == numbers and wire.varints(b"") == [] and wire.varints(b"\x05\x80\x01") == [5, 128]
    for bad in (b"\x80", b"\x01\xff", b"\x80" * 10 + b"\x01", b"\x01" * 60 + b"\xff", b"\x01" * 60 + b"\x80" * 10 + b"\x01"):
        with pytest.raises(ValueError):
            wire.varints(bad)


def test_metric_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 'q"\n')], "frame int, heap long, name string")
    inspect.write_metrics(inspect.metric_lines(rows, "frame", "frame", "heap", "name"), f"file://{tmp_path}/m")
    inspect.write_metrics(inspect.metric_lines(rows, "storage", "frame"), f"file://{tmp_path}/m")
    lines = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/m").collect()]
    assert {"record": "frame", "frame": 1, "heap": None, "name": 'q"\n'} in lines and {"record": "storage", "frame": 1} in lines


def test_simple_scripts(spark):
    points = [*range(1, 0x3200), *range(0x33F0, 0x3410), 0x9FFF, 0xA000, 0xABFF, 0xAC00, 0xD7AF, 0xD7B0, 0xF8FF, 0xF900, 0xFB00, 0xFF00, 0xFFEF, 0xFFF0, 0x1F600]
    ranges = [(0x20, 0x2AF), (0x370, 0x58F), (0x10A0, 0x10FF), (0x1E00, 0x1EFF), (0x2000, 0x200A), (0x2010, 0x2027), (0x2030, 0x205E), (0x2E80, 0x3098), (0x309B, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF)]
    rows = spark.createDataFrame([(p, bytearray(chr(p).encode())) for p in points], "p int, raw binary")
    got = {r.p for r in rows.filter(labels.simple_text(F.col("raw"))).collect()}
    assert got == {p for p in points if any(a <= p <= b for a, b in ranges) and not 0x7F <= p <= 0x9F}


def test_catalog_edges(spark):
    assert catalogs._points({"features": [{"geometry": {"coordinates": [True, 1, [2, 3]]}}]}) == [(2.0, 3.0)]
    none = spark.createDataFrame([], "ordinal long, scale string, dataset string, geometry string, url string, archive string, expected_bytes long, sha256 string")
    assert catalogs.dataset_faults(none).collect() == []


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_directories_in_chunks(spark, chunk):
    from tessera.operators import directory

    rng = random.Random(chunk)
    rows, want = [], set()
    for archive_id in range(3):
        tile = end = 0
        for i in range(40):
            step, length, raw = rng.randrange(1, 9), rng.randrange(1, 50), rng.choice([0, 0, 0, rng.randrange(1, 900)])
            tile, start = tile + step, raw - 1 if raw else end
            end = start + length
            rows.append((archive_id, i, step, 1, length, raw))
            want.add((archive_id, i, tile, start))
    df = spark.createDataFrame(rows, "archive long, i long, d_id long, run_length long, length long, raw_offset long")
    got = directory.decode_columns(df, chunk)
    assert {(r.archive, r.i, r.tile_id, r.offset) for r in got.collect()} == want
    assert sorted(got.columns) == ["archive", "i", "length", "offset", "run_length", "tile_id"]


def test_layout_counts_and_measures(spark):
    """Every label of a pool is drawn or counted for one reason; another metric."""
    rng = random.Random(4)
    rows = [(f, i, rng.choice(["ab", "a long label", "x"]), rng.randrange(-5, 300), rng.randrange(-5, 200), rng.randrange(900)) for f in range(3) for i in range(90)]
    pooled = labels.pool(spark.createDataFrame(rows, "frame int, id int, text string, x int, y int, priority int")).cache()
    for measure, limit in ((labels.fixed_metric, 64), (lambda t: None if t == "x" else (4 * len(t), 6), 5)):
        drawn = labels.layout(pooled, 300, 200, measure, limit).collect()
        stats = {r.frame: r for r in labels.layout_stats(pooled, 300, 200, measure, limit).collect()}
        for f in range(3):
            own, r = [x for x in drawn if x.frame == f], stats[f]
            assert len(own) == r.drawn <= limit and r.drawn + r.unsupported + r.offscreen + r.overlap + r.draw_limit == pooled.filter(f"frame = {f}").count()
            boxes = [(x.x - measure(x.text)[0] // 2 - 4, x.y, x.x - measure(x.text)[0] // 2 + measure(x.text)[0] + 4, x.y + measure(x.text)[1] + 8) for x in own]
            assert all(a >= 0 and b >= 0 and c <= 300 and d <= 200 for a, b, c, d in boxes)
            assert all(p[0] >= q[2] or q[0] >= p[2] or p[1] >= q[3] or q[1] >= p[3] for i, p in enumerate(boxes) for q in boxes[:i])
        assert limit == 64 or (any(r.draw_limit for r in stats.values()) and not any(x.text == "x" for x in drawn))


def test_archives_are_written_by_tasks(spark, tmp_path):
    rng = random.Random(12)
    rows = [(f"x{a}", archive.tile_id(6, i % 64, i // 64), bytearray(rng.choice([b"sea", b"land", b"t%d" % i]))) for a in range(4) for i in range(700)]
    rng.shuffle(rows)
    tiles = spark.createDataFrame(rows, "archive string, tile_id long, payload binary").repartition(5)
    told = archive.write_archives(tiles, f"file://{tmp_path}/out", leaf_size=None).collect()
    assert sorted(os.listdir(tmp_path / "out")) == [f"x{a}.pmtiles" for a in range(4)]
    assert {r.archive for r in told} == {f"x{a}" for a in range(4)} and all(r.tiles == 700 and r.contents < r.entries <= 700 for r in told)
    assert {r.archive: r.bytes for r in told} == {f"x{a}": os.path.getsize(tmp_path / f"out/x{a}.pmtiles") for a in range(4)}
    got = archive.tiles(archive.read_archive(spark, f"file://{tmp_path}/out")).collect()
    assert {(os.path.basename(r.archive)[:2], r.tile_id, gzip.decompress(bytes(r.payload))) for r in got} == {(a, t, bytes(p)) for a, t, p in rows}
    header = archive.read_archive(spark, f"file://{tmp_path}/out", "header").first()
    assert (header.min_zoom, header.max_zoom, header.addressed_tiles_count) == (6, 6, 700) and header.root_dir_length <= archive.MAX_ROOT
    big = archive.encode_archive({i * 3: b"%d" % i for i in range(30_000)}, compression="none")
    assert archive._at(big)["root_dir_length"] <= archive.MAX_ROOT and archive._at(big)["leaf_dirs_length"] > 0
    with pytest.raises(Exception):
        archive.write_archives(tiles.union(tiles), f"file://{tmp_path}/twice")


@pytest.mark.parametrize("backwards", [False, True])
def test_audit_of_equal_names_does_not_depend_on_row_order(spark, tmp_path, backwards):
    """Names hold six digits of a key: 100000 and 1000000 to 1000009 share one."""
    import duckdb

    from tessera import catalog

    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT * REPLACE (k AS p_partkey) FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM '/root/testdata/sf0.001/part.parquet') p JOIN (SELECT row_number() OVER (ORDER BY k) AS n, k FROM (SELECT unnest(range(100000, 100006)) AS k UNION ALL SELECT unnest(range(1000000, 1000014)))) USING (n)")
    con.execute(f"COPY (SELECT * EXCLUDE (n, k) FROM part ORDER BY p_partkey {'DESC' if backwards else ''}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    sql = catalog.ORACLE["provenance_audit"]
    rest = ", ".join(f"{x} NULLS FIRST" for x in ("stem", *provenance.TEXTS, *provenance.RIGHTS, *provenance.POLICY))
    want = con.execute(sql.replace("ORDER BY file", f"ORDER BY file, {rest}")).fetchall()
    assert len({w[0] for w in want}) < 20
    assert sorted(map(tuple, catalog.QUERIES["provenance_audit"](spark, str(tmp_path)).collect())) == sorted(want)
