"""Every registered query of the library against its SQL on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v is pd.NA or v != v:
        return ""
    return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    tidy = lambda df: sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))
    assert tidy(a) == tidy(b)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_label_layout_draws_one_of_a_stack(spark):
    from tessera.operators import labels

    rows = [(0, i, f"t{i:03}", 200, 200, 10000 + i) for i in range(140)]
    pooled = labels.pool(spark.createDataFrame(rows, "frame int, id int, text string, x int, y int, priority int"))
    assert pooled.count() == 128
    assert [r.id for r in labels.layout(pooled, 400, 400).collect()] == [139]


def test_project_point_has_every_event(spark):
    import math

    from tessera.plans import queries, surrogate

    got = {r.event_id: (r.view_id, r.sx, r.sy) for r in queries.project_point(spark, SF).collect()}
    views = {v.view_id: v for v in surrogate.views(spark, SF).collect()}
    places = surrogate.places(spark, SF).collect()
    assert len(got) == len(places)
    y = lambda lat: (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2
    for p in places:
        v = views[p.event_id % 25]
        n = 1 << v.zoom
        dx = ((p.lon - v.lon) / 360 + 0.5) % 1 - 0.5
        view_id, sx, sy = got[p.event_id]
        assert view_id == v.view_id and abs(sy - (v.height / 2 + (y(p.lat) - y(v.lat)) * n * 256)) < 0.002
        off = sx - (v.width / 2 + dx * n * 256)
        assert min(abs(off), abs(abs(off) - n * 256)) < 0.002


def test_lookup_in_all_archives(spark):
    from tessera.plans import queries

    got = {(r.event_id, r.archive): (r.offset, r.length) for r in queries.asof_tile_lookup(spark, SF).collect()}
    entries = queries.directory_decode(spark, SF).collect()
    held = {(e.archive, e.tile_id + i): (e.offset, e.length) for e in entries for i in range(e.run_length)}
    archives = {e.archive for e in entries}
    asked = [(r.event_id, a, r.event_id * 3 % 2500) for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect() for a in archives]
    assert len(archives) == 5 and got == {(i, a): held.get((a, t), (None, None)) for i, a, t in asked}


def test_present_missing_tiles_has_every_view(spark):
    from tessera.plans import queries

    seen = {}
    for r in queries.visible_tiles(spark, SF).collect():
        seen[r.view_id] = seen.get(r.view_id, 0) + 1
    got = {r.view_id: r.present + r.missing for r in queries.present_missing_tiles(spark, SF).collect()}
    assert len(got) == 25 and got == seen
