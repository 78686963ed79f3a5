"""Exact deduplication with stateful streaming.

Texts are equal when identical after each run of ASCII white space has become one
space. A streaming query folds rows into disk-backed keyed state (RocksDB) that
never expires: per digest the stable identifier of the first row (the least
doc_id), the locator of its content (file and row in it) and the number of rows.
Rows are combined within each task before they reach the state, so a hot text is
no hot key. Wherever a digest was hit again, the text that the state's locator
points to is read and its full bytes are compared with those of the hit; rows of
a digest with unlike texts are grouped by text.

With a folder for the state, later calls go on from it: their rows meet those of
all calls before, whose texts are read from their files.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ADDRESS, addressed, forget, materialize, maybe_in, remove, scratch, without_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: streaming batches that the rows of a call are dealt to
BATCHES = 4
AT = ["file", "at"]


def normalized(text):
    """Null as empty; each run of space, tab, LF, VT, FF, CR as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", " ")


def digest(norm, size: int):
    return F.substring(F.unhex(F.sha2(norm.cast("binary"), 256)), 1, size)


def fold(stream: DataFrame) -> DataFrame:
    """The stateful operator: ``stream`` has key, doc_id, file, at. No watermark,
    so no state is ever dropped. Works on static input as well."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at"))
    return stream.groupBy("key").agg(first.alias("first"), F.count("*").alias("n"))


def stream_state(spark: SparkSession, folder: str, schema, per_trigger: int) -> DataFrame:
    """Run the streaming query over the files in ``folder``/rows that it hasn't
    seen, and return its state: key, doc_id, file, at, n. A restarted query goes
    on from its checkpoint; a batch that is written again replaces itself."""
    told, base = f"{folder}/told", "spark.sql.streaming.stateStore."
    # many stores share an executor: bound the memory of all of them together,
    # and let none of them reserve disk ahead; checkpoints hold changes only
    wanted = {base + "providerClass": ROCKSDB, base + "rocksdb.boundedMemoryUsage": "true", base + "rocksdb.maxMemoryUsageMB": "128", base + "rocksdb.allowFAllocate": "false", base + "rocksdb.changelogCheckpointing.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in wanted}

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{told}/batch={number}")

    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/rows/*")
        query = fold(source).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    shape = "key binary, first struct<none: boolean, doc_id: bigint, file: string, at: bigint>, n bigint, batch int"
    said = spark.read.schema(shape).option("basePath", told).option("recursiveFileLookup", "false").parquet(told)
    # a key is told again in each batch that touches it
    last = said.groupBy("key").agg(F.max(F.struct("batch", "n", "first")).alias("l"))
    return last.select("key", "l.first.doc_id", "l.first.file", "l.first.at", "l.n")


def fetch(places: DataFrame) -> DataFrame:
    """``places`` (file, at and more) with the normalised text that stands there."""
    spark = places.sparkSession
    paths = [unquote(r.file) for r in places.select("file").distinct().collect()]
    texts = spark.read.parquet(*paths).select(normalized(F.col("text")).alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    maybe = maybe_in(places.select(F.xxhash64(*AT)))
    return texts.filter(maybe(F.xxhash64(*AT))).join(places, AT)


def decide(docs: DataFrame, state: str | None = None, label: str | None = None, digest_bytes: int = 32, batches: int = BATCHES) -> tuple[DataFrame, list[DataFrame]]:
    """What ``deduplicate`` returns for rows of ``addressed`` and their address
    (file, at), and the tables that it reads."""
    spark = docs.sparkSession
    folder = state or scratch(spark, "dedup-state")
    path = f"{folder}/rows/{label or uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("long"), normalized(F.col("text")).alias("norm"), F.col("__file").alias("file"), F.col("__at").alias("at"))
    rows = texts.select("doc_id", digest(F.col("norm"), 32).alias("sha"), *AT)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):  # else a call goes on that broke off
        rows.withColumn("key", F.substring("sha", 1, digest_bytes)).write.mode("overwrite").parquet(path)
    rows = spark.read.schema("doc_id long, sha binary, file string, at long, key binary").parquet(path)
    rows.scratch_path = path
    groups = stream_state(spark, folder, rows.schema, max(1, -(-len(rows.inputFiles()) // batches))).filter("n > 1")
    groups = materialize(groups.select("key", F.col("doc_id").alias("keep_id"), F.col("file").alias("keep_file"), F.col("at").alias("keep_at"), "n"), "dedup-groups")

    # rows of keys that occur once need no join
    maybe = maybe_in(groups.select(F.xxhash64("key")))(F.xxhash64("key"))
    hits = rows.filter(maybe).join(groups, "key")
    first = (F.col("file") == F.col("keep_file")) & (F.col("at") == F.col("keep_at"))
    hits = materialize(hits.select("doc_id", "sha", *AT, "key", "keep_id", "keep_file", "keep_at", "n", first.alias("kept")), "dedup-hits")
    pointed = materialize(hits.select("key", F.col("keep_file").alias("file"), F.col("keep_at").alias("at")).distinct(), "dedup-pointed")

    # full bytes: each hit against the text that the state points to. Texts are
    # found by their address and shuffled by digest; a hot one is split by Spark
    def found(at: DataFrame) -> DataFrame:
        maybe = maybe_in(at.select(F.xxhash64(*AT)))
        return texts.filter(maybe(F.xxhash64(*AT))).withColumn("key", digest(F.col("norm"), digest_bytes))

    held = found(pointed).join(pointed, ["key", *AT], "left_semi").select("key", F.col("norm").alias("held"))
    older = pointed.join(rows, AT, "left_anti") if state else None
    if older is not None and not older.isEmpty():
        held = held.union(fetch(older).select("key", F.col("norm").alias("held")))
    again = found(hits.filter("not kept")).select("key", "norm")
    unlike = materialize(again.join(held, "key").filter("norm <> held").select("key"), "dedup-unlike")

    out = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"), *AT]
    once = rows.withColumn("keep_id", F.col("doc_id")).withColumn("n", F.lit(1).cast("long")).withColumn("kept", F.lit(True))
    plain, tables = hits, [rows, groups, hits]
    if not unlike.isEmpty():
        unlike = unlike.distinct()
        every = spark.read.schema(rows.schema).parquet(f"{folder}/rows/*").join(unlike, "key", "left_semi")
        every = materialize(fetch(materialize(every, "dedup-clash")), "dedup-texts")
        least = every.groupBy("key", "norm").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *AT)).alias("f"), F.count("*").alias("n"))
        own = every.join(rows.select(*AT), AT, "left_semi").join(least, ["key", "norm"])
        own = own.withColumn("keep_id", F.col("f.doc_id")).withColumn("kept", (F.col("f.file") == F.col("file")) & (F.col("f.at") == F.col("at")))
        plain = hits.join(unlike, "key", "left_anti").select(*out).union(own.select(*out))
    else:
        plain = hits.select(*out)
        forget(unlike)
    if not state:
        remove(spark, f"{folder}/told")
        remove(spark, f"{folder}/checkpoint")
    forget(pointed)
    alone = once.filter(~maybe).select(*out).union(once.filter(maybe).join(groups, "key", "left_anti").select(*out))
    return alone.union(plain), tables


def deduplicate(docs: DataFrame, state: str | None = None, label: str | None = None, digest_bytes: int = 32, batches: int = BATCHES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    The row with the least doc_id stays; of repeated rows with that id, the first
    by address. Null text counts as empty; null ids come after all others. An
    empty table gives an empty result. Other columns are ignored.

    ``state`` is a folder in the shared file system that keeps state, checkpoint
    and row addresses for later calls; without it, each call begins anew. Rows
    then count and meet all rows of the calls before, which must still be where
    they were. A call that broke off goes on if it is repeated with its ``label``.
    The rows of a call are dealt to ``batches`` streaming batches. ``digest_bytes``
    shortens the key of the state (tests force collisions with it).
    """
    return decide(addressed(docs), state, label, digest_bytes, batches)[0].drop(*AT)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, with all their columns;
    rows are told apart by their address."""
    placed = addressed(docs)
    told, tables = decide(placed)
    gone = materialize(told.filter("not kept").select(*(F.col(a).alias(b) for a, b in zip(AT, ADDRESS))), "dedup-gone")
    forget(*tables)
    return without_rows(placed, gone).select(docs.columns)


SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def op8_exact_dedup(spark, sf_dir):
    """Every row of documents with the row that stays of its equal texts."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
