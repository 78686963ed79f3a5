"""Streaming forms give what the batch forms give."""

import os
import random

from pyspark.sql import functions as F

from test_host import manifest_text

from tessera.functions import geo
from tessera.streaming.discovery import stream_packs
from tessera.streaming.sessions import Picker, sessions, stream_rollup, stream_sessions

GESTURES = "session long, ts long, event_id long, kind string, a double, b double"


def _files(spark, rows, schema, path, parts):
    """``rows`` as files that a stream reads one after another."""
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.parquet(f"{path}/all/part={i}")
        for f in os.listdir(f"{path}/all/part={i}"):
            os.utime(f"{path}/all/part={i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/all").select(*[x.split()[0] for x in schema.split(", ")])


def _run(stream, name, mode, path):
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def test_sessions(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(5), i, i, rng.choice(["zoom_in", "zoom_out", "drag", "recenter", "reset", "none"]), float(rng.randrange(-300, 300)), float(rng.randrange(-300, 300))) for i in range(120)]
    got = _run(stream_sessions(_files(spark, rows, GESTURES, tmp_path, 3)), "sessions_out", "append", tmp_path)
    want = sessions(spark.createDataFrame(rows, GESTURES))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.filter("moved").count() > 60


def test_picker_steps():
    p = Picker(low=1, high=3, lat=10.0, lon=20.0)
    start = p.start()
    assert p.step(start, "zoom_out", 0, 0) == start and p.step(start, "none", 5, 5) == start and p.step(start, "drag", float("nan"), 0) == start
    assert p.step((3, 10.0, 20.0, True), "zoom_in", 0, 0) == (3, 10.0, 20.0, True) and p.step(start, "zoom_in", 0, 0) == (2, 10.0, 20.0, False)
    # the middle of the screen is the centre; a drag and its way back meet
    zoom, lat, lon, moved = p.step(start, "recenter", 640, 360)
    assert (zoom, round(lat, 9), round(lon, 9), moved) == (1, 10.0, 20.0, True)
    there = p.step(start, "drag", 33, -12)
    back = p.step(there, "drag", -33, 12)
    assert there[2] < 20 and round(back[1], 9) == 10.0 and round(back[2], 9) == 20.0
    assert p.step(back, "reset", 0, 0) == start
    # 512 pixels are the world at this level; beyond the pole the camera stays on it
    assert round(p.step(start, "drag", 512, 0)[2], 9) == 20.0 and abs(p.step(start, "drag", 0, 9999)[1] - geo.MAX_LAT) < 1e-8


def test_packs_that_appear(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (name, pack) in enumerate([("b", "x"), ("a", "x"), ("c", "y"), (".d", "z")]):
        (tmp_path / f"in/{name}.manifest.json").write_text(manifest_text(pack))
        os.utime(tmp_path / f"in/{name}.manifest.json", (1_700_000_000 + i, 1_700_000_000 + i))
    (tmp_path / "in/e.manifest.json").write_text("{")
    got = _run(stream_packs(spark, f"file://{tmp_path}/in"), "packs_out", "append", tmp_path).collect()
    assert len(got) == 2 and len({r.pack_id for r in got}) == 2 and {r.name[0] for r in got} <= {"a", "b", "c"}


def test_rollup(spark, tmp_path):
    rows = [(f"s{i % 3}", i * 137, float(i % 17)) for i in range(200)]
    stream = _files(spark, rows, "scenario string, at long, frame_ms double", tmp_path, 2).withColumn("ts", F.timestamp_seconds("at"))
    got = _run(stream_rollup(stream), "rollup_out", "complete", tmp_path)
    want: dict = {}
    for s, at, ms in rows:
        want.setdefault((s, at // 3600), []).append(ms)
    told = {(r.scenario, int(r.start)): (r.frames, r.total_ms, r.min_ms, r.max_ms) for r in got.select("*", (F.unix_timestamp("window.start") / 3600).alias("start")).collect()}
    assert told == {k: (len(v), sum(v), min(v), max(v)) for k, v in want.items()}
