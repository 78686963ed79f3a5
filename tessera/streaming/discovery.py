"""Packs that appear in a folder while a query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import manifests, packs

SHAPE = "path string, modificationTime timestamp, length long, content binary"


def stream_packs(spark: SparkSession, directory: str) -> DataFrame:
    """name and pack_id of valid manifests as they appear in ``directory``, each
    identity once. Which of several manifests with an identity comes first is the
    order of arrival, not of names as in ``manifests.discover``; identities are
    kept without expiry. Archives are not looked at."""
    files = spark.readStream.schema(SHAPE).format("binaryFile").option("pathGlobFilter", f"*{manifests.MANIFEST}").load(directory)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    small = files.filter(F.col("length") <= manifests.MAX_BYTES).select(name.alias("name"), "content")
    read = manifests.parse_manifests(small.filter(manifests.is_manifest_name(F.col("name")))).filter("error = 'none'")
    return read.filter(packs.validation() == "none").select("name", "pack_id").dropDuplicates(["pack_id"])
