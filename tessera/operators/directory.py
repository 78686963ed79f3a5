"""Tile directories as tables: delta columns, lookups, payload statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def decode_columns(rows: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """archive, i, d_id, run_length, length, raw_offset to tile_id and offset.

    Ids are running sums; a raw offset of 0 follows the entry before, others are
    the offset plus 1. Sums run within chunks of ``chunk`` entries first, and what
    each chunk carries over to the next is one row, so a huge archive is spread
    over many tasks and only its chunks' rows meet in one."""
    rows = rows.withColumn("chunk", F.expr(f"cast(i as bigint) div {chunk}"))
    order = Window.partitionBy("archive", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    explicit = (c("raw_offset") > 0) | (c("i") == 0)
    rows = rows.withColumn("own_id", F.sum("d_id").over(order)).withColumn("island", F.sum(F.when(explicit, 1).otherwise(0)).over(order))
    inside = Window.partitionBy("archive", "chunk", "island").orderBy("i")
    start = F.when(c("island") > 0, F.first(F.greatest(c("raw_offset") - 1, F.lit(0))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", start).withColumn("before", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    last = F.max_by(F.struct("start", (c("before") + c("length")).alias("length")), "i").alias("last")
    ends = rows.groupBy("archive", "chunk").agg(F.sum("d_id").alias("ids"), last)
    earlier = Window.partitionBy("archive").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base_id", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).withColumn("run", F.sum(F.when(c("last.start").isNotNull(), 1).otherwise(0)).over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("archive", "run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("end", F.first("last.start").over(run) + F.sum("last.length").over(run))
    ends = ends.select("archive", "chunk", "base_id", F.lag("end").over(Window.partitionBy("archive").orderBy("chunk")).alias("carried"))

    done = rows.join(ends, ["archive", "chunk"])
    done = done.withColumn("tile_id", c("base_id") + c("own_id")).withColumn("offset", F.coalesce("start", "carried") + c("before"))
    return done.drop("chunk", "island", "own_id", "start", "before", "base_id", "carried", "d_id", "raw_offset")


#: rows that are sent to all tasks at most
BROADCAST_ROWS = 1_000_000


def broadcast_checked(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` to be sent to all tasks if they are ``most`` at most, which is
    counted first; else a plain side of a join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def lookup(tiles: DataFrame, directory: DataFrame, width: int = 1 << 12) -> DataFrame:
    """archive and tile_id of ``tiles`` with offset and length of the entry of
    that archive whose run holds the tile, null without one.

    Runs are dealt to blocks of ``width`` ids, so the range join has a key."""
    runs = directory.withColumn("block", F.explode(F.sequence(F.expr(f"tile_id div {width}"), F.expr(f"(tile_id + run_length - 1) div {width}"))))
    runs = runs.select("block", c("archive").alias("pack"), c("tile_id").alias("first"), "run_length", "offset", "length")
    asked = tiles.withColumn("block", F.expr(f"tile_id div {width}"))
    hit = asked.join(runs, (asked["block"] == runs["block"]) & (c("archive") == c("pack")) & (c("tile_id") >= c("first")) & (c("tile_id") < c("first") + c("run_length")), "left")
    return hit.select(*[tiles[x] for x in tiles.columns], "offset", "length")


def size_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, upper median (place n / 2 from 0), max of a value per group. Equal
    values are counted first, so what is put in order are different ones."""
    counts = rows.filter(c(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("k").over(Window.partitionBy(*keys)))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("min"), F.min(F.when(c("upto") > F.expr("n div 2"), c(value))).alias("upper_median"), F.max(value).alias("max"))
