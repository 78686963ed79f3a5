"""Maps made of the test tables: places, views, packs, roads and rings whose
numbers both engines compute alike, integers first and one division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LON = "(cast((({id}) * 7919) % 3600000 as double) / 10000.0D - 180.0D)"
LAT = "(cast((({id}) * 104729) % 1700000 as double) / 10000.0D - 85.0D)"


def lon(id: str) -> str:
    return LON.format(id=id)


def lat(id: str) -> str:
    return LAT.format(id=id)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", f"{lon('event_id')} as lon", f"{lat('event_id')} as lat", "event_type", "value")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "cast(n_nationkey as bigint)"
    return read(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as view_id", f"{lat(k + ' * 31 + 7')} as lat", f"{lon(k + ' * 31 + 7')} as lon", "n_nationkey % 15 as zoom",
        "case n_nationkey % 3 when 0 then 1280 when 1 then 320 else 480 end as width", "case n_nationkey % 3 when 0 then 720 when 1 then 170 else 320 end as height", "256 as ts",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box around each supplier, on a screen of 1280 by 600 pixels."""
    k = "s_suppkey"
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{lat(k)} * 0.9D as lat", f"{lon(k)} * 0.9D as lon", "cast(s_suppkey % 13 as double) * 0.5D + 0.25D as half").selectExpr(
        "s_suppkey", "lon - half as min_lon", "lat - half as min_lat", "lon + half as max_lon", "lat + half as max_lat", "1280 as width", "600 as height", "256 as ts"
    )


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest per supplier, some of which break a rule."""
    rows = read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as ordinal", "concat('p', lpad(cast(s_suppkey as string), 8, '0'), '.manifest.json') as name", "'1' as pack_version", "s_name as display_name",
        "case when s_suppkey % 11 = 0 then '' else concat('r-', cast(s_suppkey % 40 as string)) end as region_id", "'Region' as region_name", "'basemap' as content_profile",
        "case when s_suppkey % 17 = 0 then 'other-1' when s_suppkey % 3 = 0 then 'protomaps-v4' else 'openmaptiles-3.16' end as schema_version", "concat('Snap', cast(s_suppkey % 4 as string)) as source_snapshot",
        "'b' as builder", "'1' as builder_version", "'c' as builder_commit", "'2024-01-01' as build_date", "case when s_suppkey % 19 = 0 then 'closed' else 'open' end as pack_class",
        "cast(s_suppkey % 36 * 10 as double) - 180.0D as min_lon", "cast(s_suppkey % 15 * 10 as double) - 80.0D as min_lat",
        "case when s_suppkey % 36 >= 33 then cast(s_suppkey % 36 * 10 as double) - 500.0D else cast(s_suppkey % 36 * 10 as double) - 140.0D end as max_lon",
        "cast(s_suppkey % 15 * 10 as double) - case when s_suppkey % 23 = 0 then 90.0D else 60.0D end as max_lat", "cast(s_suppkey % 4 as int) as min_zoom", "cast(case when s_suppkey % 29 = 0 then 1 else 8 + s_suppkey % 7 end as int) as max_zoom",
        "3 as pmtiles_version", "cast(s_suppkey % 5 as int) as priority", "cast(s_suppkey * 1000 % 7000 as bigint) as size_bytes", "sha2(cast(s_suppkey as string), 256) as output_sha256",
        "case when s_suppkey % 31 = 0 then array('') else array('osm') end as provenance_ids", "array('credit') as required_attribution",
    )
    from tessera.operators.packs import pack_identity

    return rows.withColumn("pack_id", F.when(F.expr("ordinal % 13 = 0"), F.lit("wrong")).otherwise(pack_identity()))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "cast(n_nationkey as bigint) * 101 + 3"
    return read(spark, sf_dir, "nation").selectExpr("n_nationkey as req_id", "n_nationkey % 12 as zoom", f"{lon(k)} * 0.9D as lon", f"{lat(k)} * 0.7D as lat").selectExpr(
        "req_id", "zoom", "lon - 1.0D as q_min_lon", "lat - 1.0D as q_min_lat", "lon + 1.0D as q_max_lon", "lat + 1.0D as q_max_lat"
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature per line item: layer, class, subclass, geometry."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return read(spark, sf_dir, "lineitem").join(part, F.expr("l_partkey = p_partkey")).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "element_at(array('water', 'roads', 'transportation', 'building', 'park', 'landcover', 'landuse', 'boundary', 'place', 'aeroway', 'earth', 'poi', 'places', 'boundaries', 'buildings', 'housenumber', 'land'), cast(l_partkey % 17 + 1 as int)) as layer",
        "element_at(array('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'rail', 'service', 'forest', 'residential', 'park', 'farm', cast(null as string)), cast(l_suppkey % 12 + 1 as int)) as class",
        "element_at(array('park', 'garden', 'rail', 'wood', cast(null as string)), cast(l_orderkey % 5 + 1 as int)) as subclass",
        "element_at(array('highway', 'major_road', 'minor_road', 'path', 'rail', 'aeroway', 'country', 'locality', 'earth', 'building', 'forest', 'garden', '', cast(null as string)), cast((l_suppkey + l_partkey) % 14 + 1 as int)) as kind",
        "element_at(array('secondary', 'tertiary_link', 'village', 'hamlet', cast(null as string)), cast(l_partkey % 5 + 1 as int)) as kind_detail",
        "element_at(array('point', 'linestring', 'polygon', 'unknown'), cast((l_orderkey + l_linenumber) % 4 + 1 as int)) as geometry",
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring per order of its line items' points, in a fixed order; the feature
    of a ring is its customer."""
    points = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast((l_partkey * 37 + l_linenumber * 911) % 4096 as int) as x, cast((l_suppkey * 53 + l_partkey * 17) % 4096 as int) as y) as p")
    lines = points.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("p")).alias("p")).selectExpr("l_orderkey", "transform(p, q -> struct(q.x as x, q.y as y)) as points")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.expr("o_orderkey = l_orderkey")).selectExpr("o_custkey as feature_id", "o_orderkey as ring", "points")
