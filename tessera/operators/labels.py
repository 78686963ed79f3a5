"""Place labels: priorities, the bounded pool, and greedy layout."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.inspect import first_value, number

c = F.col
POOL, DRAWN, BYTES = 128, 64, 95


def priority(population_rank: Column, scalerank: Column, fallback: Column, primary: Column) -> Column:
    """20000 for primary labels, else 10000, plus a hundredth of the rank's share."""
    rank = F.when(population_rank >= 0, population_rank).otherwise(F.lit(100.0) - F.coalesce(scalerank, fallback))
    return (F.when(primary, 20000).otherwise(10000) + F.least(F.greatest(rank, F.lit(0.0)), F.lit(100.0)) * 100).cast("int")


def printable(text: Column) -> Column:
    """Not empty, at most 95 bytes, no control characters or line separators."""
    return (F.octet_length(text).between(1, BYTES)) & ~text.rlike("[\\x00-\\x1F\\x7F-\\x9F\\u2028\\u2029]")


#: Names of a place in order, layers and kinds of labels, the code
#: points of scripts that need no shaping.
NAME_KEYS, PLACE_LAYERS = ("name:en", "name_en", "name"), ("place", "places", "place_label")
SIMPLE = r"^[\x{20}-\x{2AF}\x{370}-\x{58F}\x{10A0}-\x{10FF}\x{1E00}-\x{1EFF}\x{2000}-\x{200A}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{2E80}-\x{3098}\x{309B}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]+$"


def printable_bytes(raw: Column) -> Column:
    """Strict UTF-8 without control characters or line separators; not empty."""
    return F.coalesce(F.octet_length(raw) > 0, F.lit(False)) & F.is_valid_utf8(raw.cast("string")) & ~raw.cast("string").rlike("[\\x00-\\x1F\\x7F-\\x9F\\u2028\\u2029]")


def simple_text(raw: Column) -> Column:
    """Printable text of scripts that are drawn glyph after glyph."""
    return printable_bytes(raw) & raw.cast("string").rlike(SIMPLE)


def preferred_name(props: Column) -> Column:
    """The English name, else the local one; only texts that aren't empty."""
    texts = (F.when(v["t"] == "string", F.nullif(v["s"], F.lit(""))) for v in (first_value(props, k) for k in NAME_KEYS))
    return F.coalesce(*texts)


def offers(features: DataFrame, zoom: Column) -> DataFrame:
    """Label candidates of place features: one for each point inside its tile.

    features: layer, geom_type, kind, shown (whether the style shows the kind),
    extent, paths, props, feature_id. A ``min_zoom`` above the zoom hides a place;
    numbers that aren't finite count as missing."""
    get = lambda key: number(first_value(c("props"), key))
    kind = c("kind").isin("label_primary", "label_secondary", "label_muted")
    rows = features.filter((c("geom_type") == "point") & c("layer").isin(*PLACE_LAYERS) & kind & c("shown") & (F.coalesce(get("min_zoom"), F.lit(0.0)) <= zoom))
    rank = F.coalesce(get("rank"), get("scalerank"), F.lit(100.0))
    rows = rows.withColumn("priority", priority(F.coalesce(get("population_rank"), F.lit(-1.0)), rank, F.lit(100.0), c("kind") == "label_primary"))
    point = rows.withColumn("text", F.coalesce(preferred_name(c("props")), F.lit(""))).withColumn("p", F.explode(F.flatten("paths")))
    extent = F.when(c("extent") == 0, 4096).otherwise(c("extent"))
    return point.filter(c("p.x").between(0, extent - 1) & c("p.y").between(0, extent - 1)).select(*features.columns, "priority", "text", c("p.x").alias("local_x"), c("p.y").alias("local_y"))


def offer_stats(candidates: DataFrame, width: int, height: int) -> DataFrame:
    """frame, offered, oversized, invalid, offscreen, duplicates: why candidates
    (frame, text, x, y) don't reach the pool. Each counts for the first reason;
    duplicates are further ones of the same text and place."""
    reason = F.when(F.octet_length("text") > BYTES, "oversized").when(~printable(c("text")), "invalid").when((c("x") < 0) | (c("y") < 0) | (c("x") >= width) | (c("y") >= height), "offscreen").otherwise("ok")
    rows = candidates.withColumn("reason", reason)
    of = lambda r: F.sum((c("reason") == r).cast("long") * c("n"))
    same = rows.groupBy("frame", "reason", "text", "x", "y").agg(F.count("*").alias("n"))
    again = F.sum(F.when(c("reason") == "ok", c("n") - 1).otherwise(0))
    return same.groupBy("frame").agg(F.sum("n").alias("offered"), *(of(r).alias(r) for r in ("oversized", "invalid", "offscreen")), again.alias("duplicates"))


def text_extent(text: Column, char_w: int = 8, char_h: int = 24) -> dict[str, Column]:
    """Size of a label in a fixed metric, in pixels; none for empty text."""
    n = F.char_length(text)
    return {"width": F.when(n > 0, n * char_w), "height": F.when(n > 0, F.lit(char_h))}


def pool(candidates: DataFrame, size: int = POOL) -> DataFrame:
    """The best ``size`` candidates of each frame (frame, priority, id, text, x,
    y): of equal text and place one stays; ``place`` is the order of drawing."""
    best = [c("priority").desc(), c("id"), c("text"), c("x"), c("y")]
    same = Window.partitionBy("frame", "x", "y", "text").orderBy(*best)
    one = candidates.withColumn("r", F.row_number().over(same)).filter("r = 1").drop("r")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("frame").orderBy(*best))).filter(c("place") <= size)


#: Fixed value: pixels around a label's box, and between its point and its text.
PADDING = 4
Measure = Callable[[str], "tuple[int, int] | None"]


def fixed_metric(text: str) -> tuple[int, int] | None:
    """Width and height of a text in glyphs of 8 by 24 pixels."""
    return (8 * len(text), 24) if text else None


def _draw(frame: pd.DataFrame, width: int, height: int, measure: Measure, limit: int) -> tuple[list, dict[str, int]]:
    """Which rows are drawn, and what became of the others."""
    boxes: list[tuple[int, int, int, int]] = []
    keep, stats = [], dict.fromkeys(("drawn", "unsupported", "offscreen", "overlap", "draw_limit"), 0)
    frame = frame.sort_values("place")
    for at, (index, text, x, y) in enumerate(zip(frame.index, frame.text, frame.x.tolist(), frame.y.tolist())):
        if len(boxes) == limit:
            stats["draw_limit"] = len(frame) - at
            break
        size = measure(text)
        if not size or min(size) <= 0:
            stats["unsupported"] += 1
            continue
        left, top = x - size[0] // 2 - PADDING, y
        right, bottom = left + size[0] + 2 * PADDING, top + size[1] + 2 * PADDING
        if left < 0 or top < 0 or right > width or bottom > height:
            stats["offscreen"] += 1
        elif any(left < c and a < right and top < d and b < bottom for a, b, c, d in boxes):
            stats["overlap"] += 1
        else:
            boxes.append((left, top, right, bottom))
            keep.append(index)
    return keep, stats | {"drawn": len(keep)}


def layout(pooled: DataFrame, width: int, height: int, measure: Measure = fixed_metric, limit: int = DRAWN) -> DataFrame:
    """The labels of each frame that are drawn, in order: fully on screen, none
    over another, ``limit`` at most. A frame has at most POOL rows. ``measure``
    tells the size of a text as it will be drawn, None for one it can't draw."""
    return pooled.groupBy("frame").applyInPandas(lambda pdf: pdf.loc[_draw(pdf, width, height, measure, limit)[0]], pooled.schema)


def layout_stats(pooled: DataFrame, width: int, height: int, measure: Measure = fixed_metric, limit: int = DRAWN) -> DataFrame:
    """frame, drawn, unsupported, offscreen, overlap, draw_limit: what became of
    the pool of each frame. Those after the last label that may be drawn count for
    the limit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"frame": pdf.frame.iloc[0]} | _draw(pdf, width, height, measure, limit)[1]])

    kind = dict(pooled.dtypes)["frame"]
    return pooled.groupBy("frame").applyInPandas(run, f"frame {kind}, drawn long, unsupported long, offscreen long, overlap long, draw_limit long")
