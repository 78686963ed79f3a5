"""Provenance of map data: records of sources and their rights, what packs may
use, and the credits that a tile schema asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col

# Licence classes, what they force, confidence, shapes of fields.
PUBLIC_DOMAIN = ("CC0", "PDDL", "PUBLIC_DOMAIN_VERIFIED", "US_FEDERAL_PUBLIC_DOMAIN")
LICENSE_CLASSES = (*PUBLIC_DOMAIN, "PERMISSIVE_ATTRIBUTION", "CDLA_PERMISSIVE", "ODBL", "PROPRIETARY_APPROVED", "NONCOMMERCIAL", "NO_DERIVATIVES", "UNKNOWN")
FREE = {"commercial_use_allowed": True, "redistribution_allowed": True, "modification_allowed": True}
FORCED = {k: FREE | {"share_alike_required": False} for k in PUBLIC_DOMAIN} | {
    "PERMISSIVE_ATTRIBUTION": {"share_alike_required": False}, "CDLA_PERMISSIVE": {"share_alike_required": False}, "PROPRIETARY_APPROVED": {"share_alike_required": False},
    "ODBL": FREE | {"attribution_required": True, "share_alike_required": True}, "NONCOMMERCIAL": {"commercial_use_allowed": False}, "NO_DERIVATIVES": {"modification_allowed": False},
}
CONFIDENCE = ("CONFIRMED", "REVIEW_REQUIRED")
RIGHTS = ("commercial_use_allowed", "redistribution_allowed", "modification_allowed", "attribution_required", "share_alike_required", "source_disclosure_required")
POLICY = ("official_pack_allowed", "clean_pack_allowed")
TEXTS = ("name", "publisher", "url", "retrieved", "license", "license_class", "rights_url", "reviewed_date", "confidence")
SCHEMA_PREFIX, SCHEMA_SOURCE, SCHEMA_CREDIT, SCHEMA_WORD, SCHEMA_LINK = "openmaptiles-", "openmaptiles", "© OpenMapTiles", "OpenMapTiles", "https://openmaptiles.org/"

RECORD = (
    "id string, name string, publisher string, source struct<url: string, retrieved: string>, "
    "rights struct<license: string, license_class: string, " + ", ".join(f"{x}: string" for x in RIGHTS) + ">, "
    "evidence struct<rights_url: string, reviewed_date: string, confidence: string>, policy struct<official_pack_allowed: string, clean_pack_allowed: string>"
)


def read_records(spark: SparkSession, directory: str) -> DataFrame:
    """Records of the JSON files in ``directory``: file, stem, broken, and the flat
    fields that ``audit`` takes. Truth values stay texts here, so that a value of
    another type can be told from a missing one; numbers and texts in their place
    aren't truth values."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(directory)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    text = files.select(name.alias("file"), F.decode("content", "UTF-8").alias("text"))
    told = text.withColumn("r", F.from_json("text", RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    flat = [c("r.id"), c("r.name"), c("r.publisher"), c("r.source.url"), c("r.source.retrieved"), c("r.rights.license"), c("r.rights.license_class"), *(c(f"r.rights.{x}") for x in RIGHTS), c("r.evidence.rights_url"), c("r.evidence.reviewed_date"), c("r.evidence.confidence"), *(c(f"r.policy.{x}") for x in POLICY)]
    return told.select("file", F.regexp_replace("file", r"\.json$", "").alias("stem"), (c("r._bad").isNotNull() | ~F.ltrim("text").startswith("{")).alias("broken"), *flat)


def registered(records: DataFrame) -> DataFrame:
    """``records`` with ``place``: 1 for the first file by name of each id; broken
    files and records without id have none. A folder has a name once; records of
    one name and id are ordered by their fields, whatever order they come in."""
    usable = ~c("broken") & (F.coalesce(c("id"), F.lit("")) != "")
    order = Window.partitionBy("id", usable).orderBy("file", "stem", *TEXTS, *RIGHTS, *POLICY)
    return records.withColumn("place", F.when(usable, F.row_number().over(order)))


def audit(records: DataFrame) -> DataFrame:
    """file, code, field: a row for every rule that a record breaks.

    records: file, stem, broken, id, the TEXTS, the RIGHTS and POLICY as texts
    (``true``, ``false``, another value, or null for missing). Of files with the
    same id the first by name is checked further, the others are duplicates.
    """
    rows = registered(records)
    is_true = lambda x: c(x) == "true"
    found: list[tuple[Column, str, str]] = [
        (c("broken"), "invalid-json", ""), (~c("broken") & (F.coalesce(c("id"), F.lit("")) == ""), "missing-field", "id"),
        (c("place").isNotNull() & (c("id") != c("stem")), "id-filename-mismatch", "id"), (c("place") > 1, "duplicate-id", "id"),
    ]
    first = c("place") == 1
    found += [(first & c(x).isNull(), "missing-field", x) for x in (*TEXTS, *RIGHTS, *POLICY)]
    found += [(first & ~c(x).isin("true", "false"), "wrong-type", x) for x in (*RIGHTS, *POLICY)]
    known = first & c("license_class").isin(*LICENSE_CLASSES)
    found += [(first & ~c("license_class").isin(*LICENSE_CLASSES), "unknown-license-class", "license_class"), (known & ~c("confidence").isin(*CONFIDENCE), "unknown-confidence", "confidence")]
    for field in RIGHTS:
        wrong = F.lit(False)
        for value in (True, False):
            classes = [k for k, v in FORCED.items() if v.get(field) is value]
            if classes:
                wrong = wrong | (c("license_class").isin(*classes) & (c(field) != str(value).lower()))
        found.append((known & wrong, "license-class-mismatch", field))
    official, clean, review = is_true("official_pack_allowed"), is_true("clean_pack_allowed"), c("confidence") == "REVIEW_REQUIRED"
    found += [
        (known & clean & ~c("license_class").isin(*PUBLIC_DOMAIN), "clean-pack-not-eligible", "clean_pack_allowed"), (known & official & (c("license_class") == "UNKNOWN"), "unknown-not-official", "official_pack_allowed"),
        (known & official & (c("license_class") == "NONCOMMERCIAL"), "noncommercial-not-official", "official_pack_allowed"), (known & official & review, "review-required-not-official", "official_pack_allowed"), (known & clean & review, "review-required-not-clean", "clean_pack_allowed"),
    ]
    found += [(first & ~c(x).rlike("^https?://"), "bad-url", x) for x in ("url", "rights_url")]
    found += [(first & ~c(x).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "bad-date", x) for x in ("retrieved", "reviewed_date")]
    told = F.filter(F.array(*(F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))) for rule, code, field in found)), lambda x: x.isNotNull())
    return rows.select("file", F.inline(told))


def pack_sources(manifests: DataFrame, records: DataFrame) -> DataFrame:
    """name, provenance_id, code: faults of the sources that manifests name.

    manifests: name, pack_class, provenance_ids (null: missing). records: as for
    ``audit``; ids are looked up among the first of each. The list of sources is
    joined once, so a source that all packs share is a hot key on one side only.
    """
    known = registered(records).filter("place = 1").select(c("id").alias("provenance_id"), (c("official_pack_allowed") == "true").alias("official"), (c("clean_pack_allowed") == "true").alias("clean"), F.lit(True).alias("known"))
    none = F.when(c("provenance_ids").isNull(), "missing-field").when(F.size("provenance_ids") == 0, "missing-provenance-id")
    whole = manifests.select("name", F.lit(None).cast("string").alias("provenance_id"), none.alias("code")).filter("code is not null")
    each = manifests.select("name", "pack_class", F.explode("provenance_ids").alias("provenance_id")).join(known, "provenance_id", "left")
    bare = F.coalesce(c("provenance_id"), F.lit("")) == ""
    reasons = F.array(
        F.when(bare, "missing-provenance-id"), F.when(~bare & c("known").isNull(), "unknown-provenance-id"),
        F.when(c("known") & ~F.coalesce("official", F.lit(False)), "source-not-official"), F.when(c("known") & (c("pack_class") == "clean") & ~F.coalesce("clean", F.lit(False)), "source-not-clean"),
    )
    told = each.select("name", "provenance_id", F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("code"))
    return whole.union(told)


def schema_fault() -> Column:
    """The first credit that a schema asks for and a manifest lacks, over columns
    schema_version, provenance_ids, required_attribution, attribution_links."""
    credits, links, ids = (F.coalesce(c(x), F.array().cast("array<string>")) for x in ("required_attribution", "attribution_links", "provenance_ids"))
    return F.when(c("schema_version").startswith(SCHEMA_PREFIX), (
        F.when(~F.array_contains(ids, SCHEMA_SOURCE), "missing-schema-provenance")
        .when(~F.exists(credits, lambda x: F.coalesce(x.contains(SCHEMA_WORD), F.lit(False))), "missing-schema-attribution")
        .when(~F.array_contains(links, SCHEMA_LINK), "missing-schema-attribution-link")
        .when(F.exists(credits, lambda x: F.coalesce(x.contains("Â"), F.lit(False))), "mangled-attribution-encoding")
    ))


def with_schema_credits(manifests: DataFrame) -> DataFrame:
    """Put the credit, link and source that the schema asks for into
    required_attribution, attribution_links (in front) and provenance_ids (last)."""
    needs = F.coalesce(c("schema_version").startswith(SCHEMA_PREFIX), F.lit(False))
    credits, links, ids = (F.coalesce(c(x), F.array().cast("array<string>")) for x in ("required_attribution", "attribution_links", "provenance_ids"))
    held = F.exists(credits, lambda x: F.coalesce(x.contains(SCHEMA_CREDIT), F.lit(False)))
    return manifests.withColumns({
        "required_attribution": F.when(needs & ~held, F.concat(F.array(F.lit(SCHEMA_CREDIT)), credits)).otherwise(credits),
        "attribution_links": F.when(needs & ~F.array_contains(links, SCHEMA_LINK), F.concat(F.array(F.lit(SCHEMA_LINK)), links)).otherwise(links),
        "provenance_ids": F.when(needs & ~F.array_contains(ids, SCHEMA_SOURCE), F.concat(ids, F.array(F.lit(SCHEMA_SOURCE)))).otherwise(ids),
    })


def primary_source() -> Column:
    """The first source that isn't there for the schema's sake, else the first."""
    data = F.filter("provenance_ids", lambda x: ~(c("schema_version").startswith(SCHEMA_PREFIX) & (x == SCHEMA_SOURCE)))
    return F.coalesce(F.get(data, F.lit(0)), F.get("provenance_ids", F.lit(0)))


def same_records(pinned: DataFrame, local: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, same: whether the ordered records of each set agree in ``fields``.
    Both tables have the key, ``ordinal`` and the fields; nulls are equal."""
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~c(f"p.{f}").eqNullSafe(c(f"l.{f}"))
    on = (c(f"p.{key}") == c(f"l.{key}")) & (c("p.ordinal") == c("l.ordinal"))
    met = pinned.alias("p").join(local.alias("l"), on, "full")
    one_side = c("p.ordinal").isNull() | c("l.ordinal").isNull()
    return met.groupBy(F.coalesce(f"p.{key}", f"l.{key}").alias(key)).agg((~F.bool_or(one_side | differs)).alias("same"))
