"""What tiles and archives hold: properties, sizes of geometry, payloads, frames
and sweeps."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


# -- properties -----------------------------------------------------------------


def first_value(props: Column, key: str) -> Column:
    """The value of the first property with a key; null without one. Properties
    are an ordered array of (key, value): keys may repeat."""
    return F.get(F.filter(props, lambda p: p["key"] == key), F.lit(0))["value"]


def number(value: Column) -> Column:
    """A property value as a finite double; null for texts, truth values, others."""
    n = F.when(value["t"] == "double", value["d"]).when(value["t"] == "int", value["i"].cast("double")).when(value["t"] == "uint", value["u"].cast("double"))
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def _short(d: pd.Series) -> pd.Series:
    return d.map(lambda x: "%g" % x)


def display(value: Column) -> Column:
    """A property value as text: doubles with six digits, truth values as words,
    nothing for a value without type. Only doubles leave the JVM."""
    return (
        F.when(value["t"] == "string", value["s"]).when(value["t"] == "double", F.pandas_udf(_short, "string")(value["d"])).when(value["t"] == "int", value["i"].cast("string"))
        .when(value["t"] == "uint", value["u"].cast("string")).when(value["t"] == "bool", value["b"].cast("string")).otherwise("")
    )


# -- accounts of tiles ---------------------------------------------------------


def feature_sizes(features: DataFrame) -> DataFrame:
    """``features`` with paths, points, keys and string bytes of each feature."""
    texts = F.aggregate("props", F.octet_length("layer").cast("long"), lambda n, p: n + F.octet_length(p["key"]) + F.coalesce(F.octet_length(p["value"]["s"]), F.lit(0)))
    points = F.aggregate("paths", F.lit(0).cast("long"), lambda n, p: n + F.size(p))
    return features.withColumns({"n_paths": F.size("paths").cast("long"), "n_points": points, "n_keys": F.size("props").cast("long"), "string_bytes": texts})


def tile_accounts(sized: DataFrame, *keys: str) -> DataFrame:
    """Totals per tile of ``feature_sizes`` with a column kind: features, paths,
    points, keys, string bytes, classified, skipped."""
    total = lambda x, name: F.sum(x).alias(name)
    return sized.groupBy(*keys).agg(
        F.count("*").alias("features"), total("n_paths", "paths"), total("n_points", "points"), total("n_keys", "keys"), total("string_bytes", "string_bytes"),
        F.count("kind").alias("classified"), F.sum(c("kind").isNull().cast("long")).alias("skipped"),
    )


def ratio(part: Column, whole: Column) -> Column:
    """``part`` / ``whole``, 0 where there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def payload_summary(directory: DataFrame) -> DataFrame:
    """archive, addressed, entries, contents and the distribution of stored bytes
    over addressed tiles: each entry counts as often as its run is long. Contents
    are different offsets. Sizes are counted before they are ranked, so what is
    sorted is the different sizes of an archive."""
    counts = directory.groupBy("archive").agg(F.sum("run_length").alias("addressed"), F.count("*").alias("entries"), F.count_distinct("offset").alias("contents"), F.sum(c("length") * c("run_length")).alias("bytes"), F.max("length").alias("max_bytes"))
    sizes = directory.groupBy("archive", "length").agg(F.sum("run_length").alias("n"))
    half = F.percentile("length", F.lit(0.5), c("n")).alias("median_bytes")
    late = F.percentile("length", F.lit(0.95), c("n")).alias("p95_bytes")
    return counts.join(sizes.groupBy("archive").agg(half, late), "archive").withColumn("mean_bytes", c("bytes") / c("addressed"))


def frame_totals(tiles: DataFrame, stages: tuple[str, ...], *keys: str) -> DataFrame:
    """A row per frame: visible tiles, placements, present, missing and skipped
    tiles, features, bytes as stored and unpacked, and the sum of each stage's
    milliseconds with their total. tiles: keys, copies, status (present, missing,
    skipped), features, stored, raw, stages. Only present tiles count beyond that."""
    here = c("status") == "present"
    of = lambda x: F.coalesce(F.sum(F.when(here, c(x))), F.lit(0))
    sums = [of(s).alias(s) for s in stages]
    out = tiles.groupBy(*keys).agg(
        F.count("*").alias("visible"), F.sum("copies").alias("placements"), *(F.sum((c("status") == s).cast("long")).alias(s) for s in ("present", "missing", "skipped")),
        of("features").alias("features"), of("stored").alias("stored"), of("raw").alias("raw"), *sums,
    )
    return out.withColumn("total_ms", reduce(lambda a, b: a + b, (c(s) for s in stages)))


def primitive_counts(prims: DataFrame, *keys: str) -> DataFrame:
    """Calls and covered pixels of each kind of drawing call; a line counts the
    longer of its sides and one, a rectangle its area, others one."""
    span = F.when(c("prim") == "line", F.greatest(F.abs(c("x1") - c("x0")), F.abs(c("y1") - c("y0"))) + 1).when(c("prim") == "rect", c("x1").cast("long") * c("y1")).otherwise(1)
    return prims.groupBy(*keys, "prim").agg(F.count("*").alias("calls"), F.sum(span.cast("long")).alias("span"))


def deepest(packs: DataFrame, *keys: str) -> DataFrame:
    """The pack of the deepest zoom of each group, the first by ordinal of equals."""
    return packs.groupBy(*keys).agg(F.min(F.struct((-c("max_zoom")).alias("z"), "ordinal", "pack_id")).alias("b")).select(*keys, (-c("b.z")).alias("max_zoom"), "b.pack_id")


def digests(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 of binary files."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


# -- records of a benchmark ---------------------------------------------------------


def metric_lines(records: DataFrame, kind: str, *columns: str) -> DataFrame:
    """One JSON text a row, ``record`` first; a missing probe is a null, not left out."""
    return records.select(F.to_json(F.struct(F.lit(kind).alias("record"), *columns), {"ignoreNullFields": "false"}).alias("value"))


def write_metrics(lines: DataFrame, path: str) -> None:
    """Append metric lines as JSON lines files."""
    lines.select("value").write.mode("append").text(path)

