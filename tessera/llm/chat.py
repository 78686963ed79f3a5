"""Chat formatting after cumulative-snapshot collapse.

Chat logs often hold a conversation once per turn, each a prefix of the next.
Rolling hashes of turn prefixes identify them: a conversation stays only if its
hash is no proper prefix of another's, and of equal ones the least conv_id stays.
Conversations of equal hashes are compared turn by turn; where they differ, the
turns themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import forget, materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _half(at: int, bits: int) -> Column:
    """Some bits of a digest of position, role and text, with their lengths in
    front, so that no two turns have the same bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = F.concat_ws(" ", F.col("place").cast("string"), F.octet_length(role).cast("string"), role, text)
    whole = F.conv(F.substring(F.md5(body.cast("binary")), 1 + 16 * at, 15), 16, 10).cast("long")
    return whole if bits >= 60 else F.pmod(whole, F.lit(1 << bits))


def escaped(text: Column) -> Column:
    """A marker in a text gets a backslash after its first sign, one more if it has
    some already: reversible, and no text can look like the end of a turn."""
    return F.regexp_replace(text, r"<(\\*)\|(im_start|im_end)\|>", r"<$1\\|$2|>")


def escaped_role(role: Column) -> Column:
    """As texts; a line feed becomes backslash and n, a backslash two."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def collapse_and_render(conversations: DataFrame, bits: int = 60) -> DataFrame:
    """conv_id, n_turns, snapshots (how many conversations equal it), rendered.

    Turns are ordered by turn, then role, text. Null role or text counts as
    empty, a null turn comes first; rows without conv_id belong to none and are
    left out. Repeated rows are repeated turns. An empty table gives an empty
    result; other columns are ignored. The rolling hash is the exclusive or of
    two parts of ``bits`` bits of a digest of each turn and its place (tests make
    them few, so that unlike conversations meet). Markers in roles and texts are
    escaped, so equal renderings are equal conversations.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("place", F.row_number().over(order)).withColumn("a", _half(0, bits)).withColumn("b", _half(1, bits))
    run = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv_id", "place", F.bit_xor("a").over(run).alias("a"), F.bit_xor("b").over(run).alias("b"))
    hashes = materialize(rolled.withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id"))), "prefixes")

    # of each hash: the least whole conversation, and one that is longer
    key = ["place", "a", "b"]
    whole = hashes.filter("place = n_turns").select("conv_id", *key)
    kept = whole.groupBy(*key).agg(F.min("conv_id").alias("keep"), F.count("*").alias("snapshots"))
    longer = hashes.filter("place < n_turns").groupBy(*key).agg(F.min("conv_id").alias("longer"))
    groups = materialize(kept.join(longer, key, "left"), "groups")

    # equal hashes are believed once the turns have been compared
    said = placed.select("conv_id", "place", F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    claims = whole.join(groups.filter("snapshots > 1"), key).filter("conv_id <> keep").select("conv_id", F.col("keep").alias("other"), *key)
    claims = claims.union(groups.filter("longer is not null").select(F.col("keep").alias("conv_id"), F.col("longer").alias("other"), *key))
    claims = claims.withColumnRenamed("place", "n")
    one = claims.join(said, "conv_id").select("conv_id", "other", "n", "a", "b", "place", "said")
    two = said.select(F.col("conv_id").alias("other"), "place", F.col("said").alias("again"))
    unlike = one.join(two, ["other", "place"]).filter("said <> again").select(F.col("n").alias("place"), "a", "b").distinct()
    unlike = materialize(unlike, "unlike")
    good = groups.select("keep", *key, "snapshots").filter("longer is null")
    if not unlike.isEmpty():
        good = good.join(unlike, key, "left_anti").unionByName(_by_turns(hashes.join(unlike, key, "left_semi"), said))
    else:
        forget(unlike)
    good = good.select(F.col("keep").alias("conv_id"), F.col("place").alias("n_turns"), "snapshots")

    part = F.concat(F.lit(OPEN), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"), escaped(F.coalesce("text", F.lit(""))), F.lit(CLOSE + "\n"))
    lines = placed.select("conv_id", "place", part.alias("line"))
    joined = lines.join(good, "conv_id").groupBy("conv_id", "n_turns", "snapshots").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return joined.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "snapshots", F.array_join("lines.line", "").alias("rendered"))


def _by_turns(hashes: DataFrame, said: DataFrame) -> DataFrame:
    """keep, place, a, b, snapshots of the conversations that stay among those
    whose hashes met but whose turns differ: the turns are the key."""
    n = hashes.select("conv_id", F.col("place").alias("n"), "a", "b", (F.col("place") == F.col("n_turns")).alias("whole"))
    prefix = n.join(said, "conv_id").filter("place <= n").groupBy("conv_id", "n", "a", "b", "whole").agg(F.array_sort(F.collect_list(F.struct("place", "said"))).alias("prefix"))
    same = prefix.groupBy("n", "a", "b", "prefix").agg(F.min(F.when(F.col("whole"), F.col("conv_id"))).alias("keep"), F.sum(F.col("whole").cast("long")).alias("snapshots"), F.max(~F.col("whole")).alias("longer"))
    return same.filter("keep is not null and not longer").select("keep", F.col("n").alias("place"), "a", "b", "snapshots")


SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    '<|im_start|>' || regexp_replace(replace(replace(coalesce(role, ''), '\', '\\'), chr(10), '\n'), '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g') || chr(10)
    || regexp_replace(coalesce(text, ''), '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g') || '<|im_end|>' || chr(10) AS line
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, place, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n FROM t),
f AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS snapshots, prefix AS rendered FROM p WHERE place = n GROUP BY n, prefix)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(snapshots AS BIGINT) AS snapshots, rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = f.n_turns AND p.prefix = f.rendered)
"""


def op10_chat_formatting(spark, sf_dir):
    """All conversations, collapsed to maximal ones and rendered."""
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
