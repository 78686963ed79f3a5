"""Pack manifests: listing, strict JSON, discovery with one reason for each
manifest that is refused, agreement with archive headers, sidecar files."""

from __future__ import annotations

import math
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import packs

c = F.col
MANIFEST, ARCHIVE = ".manifest.json", ".pmtiles"

# Limits of a manifest file, its text fields and reasons of refusal.
MAX_BYTES, MAX_DEPTH = 65_536, 12
TEXT_FIELDS = ("pack_id", "pack_version", "display_name", "region_id", "region_name", "content_profile", "schema_version", "source_snapshot", "builder", "builder_version", "builder_commit", "build_date", "pack_class", "output_sha256")
EDGES = ("min_lon", "min_lat", "max_lon", "max_lat")
WHOLE_FIELDS = {"min_zoom": (0, 31), "max_zoom": (0, 31), "pmtiles_version": (0, 255), "size_bytes": (0, 2**53)}
JSON_ERRORS = ("none", "too-large", "too-deep", "malformed", "not-an-object", "wrong-type", "missing-field", "out-of-range")
REJECTIONS = ("unreadable", "bad-json", "invalid-manifest", "archive-missing", "archive-size-mismatch", "duplicate")


# -- files ----------------------------------------------------------------------


def is_manifest_name(name: Column) -> Column:
    """A plain file of one directory: the suffix, no leading dot, no path."""
    return name.endswith(MANIFEST) & ~name.startswith(".") & ~name.contains("/") & ~name.contains("\\")


def join_path(directory: Column, name: Column) -> Column:
    bare = (directory == "") | directory.endswith("/") | directory.endswith("\\")
    return F.when(bare, F.concat(directory, name)).otherwise(F.concat(directory, F.lit("/"), name))


def archive_of(name: Column) -> Column:
    """Name of the archive beside a manifest: its stem and the archive's suffix;
    empty for other names. Nothing inside a manifest can name another file."""
    stem = F.substring(name, F.lit(1), F.length(name) - len(MANIFEST))
    return F.when(name.endswith(MANIFEST), F.concat(stem, F.lit(ARCHIVE))).otherwise("")


def read_manifests(spark: SparkSession, directory: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """name, content of the manifests directly in ``directory``, by name. Content
    is null for files of more than ``max_bytes``: they are refused, never cut. A
    directory that can't be listed raises; an empty one gives an empty table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{MANIFEST}").load(directory)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    kept = files.select(name.alias("name"), F.when(c("length") <= max_bytes, c("content")).alias("content"))
    return kept.filter(is_manifest_name(c("name"))).orderBy("name")


def archive_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """name, size_bytes of the archives directly in ``directory``; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ARCHIVE}").load(directory)
    return files.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"), c("length").alias("size_bytes"))


# -- strict JSON ------------------------------------------------------------------

_NUMBER = re.compile(rb"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?")
_BROKEN_EXPONENT = re.compile(rb"[eE]")
_SPACE = re.compile(rb"[ \t\n\r]*")
_PLAIN = re.compile(rb'[^"\\]*')
_ESCAPES = {ord(a): b for a, b in zip('"\\/bfnrt', (b'"', b"\\", b"/", b"\b", b"\f", b"\n", b"\r", b"\t"))}


class JsonError(ValueError):
    """``code`` is one of JSON_ERRORS."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def parse_json(data: bytes, max_depth: int = MAX_DEPTH):
    """Strict JSON with an explicit stack: of equal keys the last counts, numbers
    may have a leading plus or zeros and must be finite, a surrogate escape is
    U+FFFD, nothing may follow. Depth is counted from 0 at the top."""
    at = 0

    def space() -> None:
        nonlocal at
        at = _SPACE.match(data, at).end()

    def text() -> str:
        nonlocal at
        if data[at : at + 1] != b'"':
            raise JsonError("malformed")
        at, out = at + 1, []
        while True:
            m = _PLAIN.match(data, at)
            out.append(m[0])
            at = m.end()
            if at >= len(data):
                raise JsonError("malformed")
            if data[at] == 0x22:
                at += 1
                return b"".join(out).decode("utf-8", "replace")
            kind = data[at + 1] if at + 1 < len(data) else -1
            if kind == 0x75:
                digits = data[at + 2 : at + 6]
                if not re.fullmatch(rb"[0-9a-fA-F]{4}", digits):
                    raise JsonError("malformed")
                point = int(digits, 16)
                out.append("�".encode() if 0xD800 <= point <= 0xDFFF else chr(point).encode())
                at += 6
            elif kind in _ESCAPES:
                out.append(_ESCAPES[kind])
                at += 2
            else:
                raise JsonError("malformed")

    top: list = []
    stack: list = [top]  # containers that are open; keys wait beside them
    keys: list = [None]

    def put(value) -> None:
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = value
        else:
            stack[-1].append(value)

    def key() -> None:
        nonlocal at
        keys[-1] = text()
        space()
        if data[at : at + 1] != b":":
            raise JsonError("malformed")
        at += 1
        space()

    space()
    while True:  # one value
        if len(stack) - 1 > max_depth:
            raise JsonError("too-deep")
        first = data[at : at + 1]
        if first in (b"{", b"["):
            value = {} if first == b"{" else []
            put(value)
            at += 1
            space()
            if data[at : at + 1] == (b"}" if first == b"{" else b"]"):
                at += 1
            else:
                stack.append(value)
                keys.append(None)
                if first == b"{":
                    key()
                continue
        elif first == b'"':
            put(text())
        elif word := next((w for w in (b"true", b"false", b"null") if data.startswith(w, at)), None):
            put({b"true": True, b"false": False, b"null": None}[word])
            at += len(word)
        else:
            m = _NUMBER.match(data, at)
            if not m or _BROKEN_EXPONENT.match(data, m.end()):
                raise JsonError("malformed")
            number = float(m[0])
            if not math.isfinite(number):
                raise JsonError("malformed")
            put(number)
            at = m.end()
        while len(stack) > 1:  # what follows a value in a container
            space()
            mark, is_object = data[at : at + 1], isinstance(stack[-1], dict)
            at += 1
            if mark == b",":
                space()
                if is_object:
                    key()
                break
            if mark != (b"}" if is_object else b"]"):
                raise JsonError("malformed")
            stack.pop()
            keys.pop()
        if len(stack) == 1:
            break
    space()
    if at != len(data):
        raise JsonError("malformed")
    return top[0]


def _field(record: dict, name: str, kind: type):
    if name not in record:
        raise JsonError("missing-field")
    value = record[name]
    if type(value) is not kind:
        raise JsonError("wrong-type")
    return value


def _whole(record: dict, name: str, low: float, high: float) -> int:
    value = _field(record, name, float)
    if value != math.floor(value) or not low <= value <= high:
        raise JsonError("out-of-range")
    return int(value)


def read_manifest(data: bytes | None) -> dict:
    """Fields of a manifest, or ``error`` with the first fault in reading order.
    Unknown fields are ignored; a known one of a wrong type is a fault."""
    try:
        if data is None or len(data) > MAX_BYTES:
            raise JsonError("too-large")
        root = parse_json(bytes(data))
        if type(root) is not dict:
            raise JsonError("not-an-object")
        out = {name: _field(root, name, str) for name in TEXT_FIELDS}
        bounds = _field(root, "bounds", dict)
        out |= {name: _field(bounds, name, float) for name in EDGES}
        out |= {name: _whole(root, name, *limits) for name, limits in WHOLE_FIELDS.items()}
        out["priority"] = _whole(root, "priority", -(2**31), 2**31 - 1) if "priority" in root else 0
        ids = []
        for source in _field(root, "sources", list):
            if type(source) is not dict:
                raise JsonError("wrong-type")
            ids.append(_field(source, "provenance_id", str))
        out["provenance_ids"] = ids
        for name in ("required_attribution", "attribution_links"):
            out[name] = _field(root, name, list) if name in root else []
            if any(type(x) is not str for x in out[name]):
                raise JsonError("wrong-type")
        return out | {"error": "none"}
    except JsonError as e:
        return {"error": e.code}


MANIFEST_SCHEMA = (
    ", ".join(f"{name} string" for name in TEXT_FIELDS) + ", " + ", ".join(f"{name} double" for name in EDGES)
    + ", min_zoom int, max_zoom int, pmtiles_version int, size_bytes long, priority int, provenance_ids array<string>, required_attribution array<string>, attribution_links array<string>, error string"
)
_NAMES = [x.split()[0] for x in MANIFEST_SCHEMA.split(", ")]


def _manifests(content: pd.Series) -> pd.DataFrame:
    rows = [read_manifest(x) for x in content]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in _NAMES})


def parse_manifests(files: DataFrame) -> DataFrame:
    """``files`` (name, content) with the fields of each manifest and ``error``."""
    parsed = F.pandas_udf(_manifests, f"struct<{', '.join(x.replace(' ', ': ', 1) for x in MANIFEST_SCHEMA.split(', '))}>")
    told = files.withColumn("__m", parsed(c("content").cast("binary")))
    return told.select(*files.columns, *(c(f"__m.{n}").alias(n) for n in _NAMES))


# -- discovery ----------------------------------------------------------------------


def discover(files: DataFrame, archives: DataFrame) -> DataFrame:
    """name, pack_id, rejection, detail for each manifest of ``files`` (name,
    content; null content could not be read) beside ``archives`` (name, size_bytes).

    One reason each, in this order: unreadable, bad JSON (detail: its error), an
    invalid manifest (detail: the rule), a missing archive, another size, an
    identity that an earlier valid manifest by name has. Null: the pack is added.
    """
    read = parse_manifests(files.filter(is_manifest_name(c("name")))).withColumn("readable", c("content").isNotNull()).drop("content")
    ruled = read.withColumn("rule", F.when(c("error") == "none", packs.validation()))
    sizes = archives.select(c("name").alias("archive"), c("size_bytes").alias("actual"))
    met = ruled.withColumn("archive", archive_of(c("name"))).join(sizes, "archive", "left")
    reason = (
        F.when(~c("readable"), "unreadable").when(c("error") != "none", "bad-json").when(c("rule") != "none", "invalid-manifest")
        .when(c("actual").isNull(), "archive-missing").when(c("actual") != c("size_bytes"), "archive-size-mismatch")
    )
    met = met.withColumn("rejection", reason)
    order = Window.partitionBy("pack_id", c("rejection").isNull()).orderBy("name")
    again = F.when(c("rejection").isNull() & (F.row_number().over(order) > 1), "duplicate")
    detail = F.when(c("rejection") == "bad-json", c("error")).when(c("rejection") == "invalid-manifest", c("rule")).when(c("rejection").startswith("archive"), c("archive"))
    return met.select("name", F.when(c("error") == "none", c("pack_id")).alias("pack_id"), F.coalesce("rejection", again).alias("rejection"), detail.alias("detail"))


def header_agreement(manifests: DataFrame, headers: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """name, readable, wider, deeper: whether a manifest claims more ground or
    zooms than the header of its archive. headers: name, min_zoom, max_zoom and
    edges in 1e-7 degrees (``min_lon_e7`` and so on); a missing one is unreadable."""
    h = headers.select(c("name").alias("archive"), *(c(f"{e}_e7").alias(f"h_{e}") for e in EDGES), c("min_zoom").alias("h_min"), c("max_zoom").alias("h_max"))
    met = manifests.withColumn("archive", archive_of(c("name"))).join(h, "archive", "left")
    wider = F.lit(False)
    for edge in EDGES:
        own, held = c(edge), c(f"h_{edge}") / 1e7
        wider = wider | (own < held - tolerance if edge.startswith("min") else own > held + tolerance)
    deeper = (c("min_zoom") < c("h_min")) | (c("max_zoom") > c("h_max"))
    return met.select("name", c("h_min").isNotNull().alias("readable"), wider.alias("wider"), deeper.alias("deeper"))


# -- sidecars -------------------------------------------------------------------------


def sidecars(built: DataFrame) -> DataFrame:
    """stem, manifest, checksum: texts of the two files beside an archive. built:
    stem, content (binary) and the manifest's fields with ``sources`` (structs)."""
    digest = F.sha2("content", 256)
    order = ["pack_id", "pack_version", "display_name", "region_id", "region_name"]
    late = ["content_profile", "pmtiles_version", "schema_version", "source_snapshot", "builder", "builder_version", "builder_commit", "build_date", "sources", "pack_class", "required_attribution", "attribution_links", "priority"]
    fields = [F.lit(1).alias("manifest_version"), *order, F.struct(*EDGES).alias("bounds"), "min_zoom", "max_zoom", *late, F.octet_length("content").cast("long").alias("size_bytes"), digest.alias("output_sha256")]
    return built.select("stem", F.to_json(F.struct(*fields)).alias("manifest"), F.concat(digest, F.lit("  "), c("stem"), F.lit(ARCHIVE + "\n")).alias("checksum"))


def write_sidecars(files: DataFrame, directory: str) -> None:
    """Write both files of each row into ``directory``, a file at a time from the
    executors through a hidden name, so that a lost task leaves no half file. The
    directory is a path that all executors share."""

    def run(batches):
        import os

        for batch in batches:
            for stem, text, checksum in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for suffix, body in ((MANIFEST, text + "\n"), (".sha256", checksum)):
                    at = os.path.join(directory, quote(stem, safe=" ()+,;=@!$&'~") + suffix)
                    part = os.path.join(directory, f".{os.path.basename(at)}.{os.getpid()}")
                    with open(part, "w", encoding="utf-8") as f:
                        f.write(body)
                    os.replace(part, at)
            yield batch.slice(0, 0)

    files.select("stem", "manifest", "checksum").mapInArrow(run, "stem string, manifest string, checksum string").write.format("noop").mode("overwrite").save()
