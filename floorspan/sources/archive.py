"""Venue archives: zip files of a manifest and one GeoJSON collection for each feature type."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.functions.text import FEATURE_TYPES
from floorspan.session import ship

#: Limits of one archive.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_BYTES = 10_000, 256 << 20, 1 << 30
REQUIRED = ("manifest.json", "address.geojson", "building.geojson", "footprint.geojson", "level.geojson", "unit.geojson", "venue.geojson")


class ArchiveError(ValueError):
    """An archive that can't be read safely; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def unsafe(name: str) -> bool:
    """Absolute, with backslashes or drive letters, or leading out of the archive."""
    return name.startswith("/") or "\\" in name or ":" in name or ".." in name.split("/") or "\0" in name


def entry_problems(listing: DataFrame) -> DataFrame:
    """(archive, name, code) of entries (archive, name, is_dir, encrypted, size) that keep an archive from being read.

    Paths that are unsafe, encrypted entries, names that differ in case only, entries and archives beyond the limits; directories
    don't count.
    """
    files = listing.filter(~F.col("is_dir"))
    name = F.col("name")
    bad = name.startswith("/") | name.contains("\\") | name.contains(":") | F.array_contains(F.split(name, "/"), "..") | name.contains("\0")
    own = F.array_compact(F.array(F.when(bad, "unsafe_path"), F.when(F.col("encrypted"), "encrypted"), F.when(F.col("size") > MOST_ENTRY_BYTES, "too_large")))
    out = files.select("archive", "name", F.explode(own).alias("code"))
    twice = files.groupBy("archive", F.lower("name").alias("k")).agg(F.count("*").alias("n"), F.max("name").alias("name")).filter("n > 1").select("archive", "name", F.lit("duplicate_entry").alias("code"))
    whole = files.groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    codes = F.array_compact(F.array(F.when(F.col("n") > MOST_ENTRIES, "too_many_entries"), F.when(F.col("size") > MOST_BYTES, "too_large")))
    return out.union(twice).union(whole.select("archive", F.lit(None).cast("string").alias("name"), F.explode(codes).alias("code")))


def canonical_texts(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text, problem): JSON texts in canonical form."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, problems_ = [], []
            for raw in batch.column(1).to_pylist():
                try:
                    texts.append(None if raw is None else json.dumps(canonical(json.loads(raw)), ensure_ascii=False))
                    problems_.append(None)
                except ArchiveError as e:
                    texts.append(None)
                    problems_.append(e.code)
                except ValueError:
                    texts.append(None)
                    problems_.append("bad_json")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(problems_, pa.string())], [key, "text", "problem"])

    return rows.select(key, column).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string, problem string")


def entries(data: bytes) -> dict[str, bytes]:
    """The archive's files by name in byte order, or an ArchiveError."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ArchiveError("not_a_zip") from e
    infos = [i for i in z.infolist() if not i.is_dir()]
    if len(infos) > MOST_ENTRIES:
        raise ArchiveError("too_many_entries")
    seen: set[str] = set()
    total = 0
    for i in infos:
        if unsafe(i.filename):
            raise ArchiveError("unsafe_path", i.filename)
        if i.flag_bits & 1:
            raise ArchiveError("encrypted", i.filename)
        if i.filename.lower() in seen:
            raise ArchiveError("duplicate_entry", i.filename)
        seen.add(i.filename.lower())
        total += i.file_size
        if i.file_size > MOST_ENTRY_BYTES or total > MOST_BYTES:
            raise ArchiveError("too_large", i.filename)
    return {i.filename: z.read(i) for i in sorted(infos, key=lambda i: i.filename.encode())}


def canonical(value: object) -> object:
    """JSON with sorted keys and without negative zeros; NaN and infinities are errors."""
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ArchiveError("non_finite_number")
        return value + 0.0
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [canonical(v) for v in value]
    return value


def features(files: dict[str, bytes]) -> Iterator[tuple[str, int, str | None, str | None, str, str | None]]:
    """(feature_type, place, id, geometry, properties, problem) of every feature in canonical order of types."""
    missing = [name for name in REQUIRED if name not in files]
    if missing:
        raise ArchiveError("missing_file", missing[0])
    by_type = {posixpath.basename(n)[: -len(".geojson")]: b for n, b in files.items() if n.endswith(".geojson")}
    for kind in FEATURE_TYPES:
        if kind not in by_type:
            continue
        try:
            doc = json.loads(by_type[kind])
        except ValueError as e:
            raise ArchiveError("bad_json", kind) from e
        if doc.get("type") != "FeatureCollection" or not isinstance(doc.get("features"), list):
            raise ArchiveError("not_a_collection", kind)
        for place, f in enumerate(doc["features"]):
            problem = None if isinstance(f.get("id"), str) and f.get("type") == "Feature" else "bad_feature"
            if problem is None and f.get("feature_type", kind) != kind:
                problem = "wrong_feature_type"
            g = f.get("geometry")
            yield kind, place, f.get("id"), None if g is None else json.dumps(canonical(g)), json.dumps(canonical(f.get("properties") or {}), ensure_ascii=False), problem


SCHEMA = "path string, feature_type string, place int, id string, geometry string, properties string, problem string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Features of all archives under a path.  A bad archive gives one row with its problem; archives are read in parallel."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = list(features(entries(data)))
                except ArchiveError as e:
                    rows = [(None, 0, None, None, None, e.code)]
                columns = list(zip(*[(name, *r) for r in rows], strict=True)) or [[]] * 7
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["path", "feature_type", "place", "id", "geometry", "properties", "problem"])

    return files.mapInArrow(run, SCHEMA)


def write_archives(df: DataFrame, folder: str, key: str = "venue") -> None:
    """One zip of GeoJSON collections for each venue of (venue, feature_type, id, geometry, properties), through Spark's own writer.

    The archives are binary rows, so executors write them to any store that Spark reaches.
    """
    archives(df, key).write.mode("overwrite").parquet(folder)


def archives(df: DataFrame, key: str = "venue") -> DataFrame:
    """(venue, content): the zip of each venue; a venue has to fit into a worker, as its archive does."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def pack(t: pa.Table) -> pa.Table:
        by_type: dict[str, list[dict]] = {}
        for r in t.sort_by([("feature_type", "ascending"), ("id", "ascending")]).to_pylist():
            by_type.setdefault(r["feature_type"], []).append(
                {"id": r["id"], "type": "Feature", "feature_type": r["feature_type"], "geometry": json.loads(r["geometry"]) if r["geometry"] else None, "properties": json.loads(r["properties"] or "{}")}
            )
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("manifest.json"), json.dumps({"version": "1.0.0", "language": "en"}))
            for k in sorted(by_type):
                z.writestr(zipfile.ZipInfo(f"{k}.geojson"), json.dumps({"type": "FeatureCollection", "features": by_type[k]}, sort_keys=True, ensure_ascii=False))
        return pa.table({key: t[key].slice(0, 1), "content": pa.array([out.getvalue()], pa.binary())})

    return df.groupBy(key).applyInArrow(pack, f"{key} {kind}, content binary")


def problems(features_: DataFrame) -> DataFrame:
    """Problems of whole archives: repeated ids, not exactly one venue, no level."""
    twice = features_.filter("id is not null").groupBy("path", "id").agg(F.count("*").alias("n")).filter("n > 1").select("path", F.lit("duplicate_id").alias("code"), F.col("id").alias("detail"))
    counts = features_.groupBy("path").agg(F.count_if(F.col("feature_type") == "venue").alias("venues"), F.count_if(F.col("feature_type") == "level").alias("levels"))
    shape = counts.select("path", F.explode(F.array_compact(F.array(F.when(F.col("venues") != 1, "not_one_venue"), F.when(F.col("levels") == 0, "no_level")))).alias("code")).withColumn("detail", F.lit(None).cast("string"))
    return twice.unionByName(shape).unionByName(features_.filter("problem is not null").select("path", F.col("problem").alias("code"), F.col("id").alias("detail")))


def unpack(packed: DataFrame, key: str = "venue") -> DataFrame:
    """(venue, feature_type, id, geometry, properties) of archives given as (venue, content)."""
    ship(packed.sparkSession)
    kind = packed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            venues, kinds, ids, shapes, properties = [], [], [], [], []
            for venue, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, body in entries(data).items():
                    if name.endswith(".geojson"):
                        for f in json.loads(body)["features"]:
                            venues.append(venue)
                            kinds.append(f["feature_type"])
                            ids.append(f["id"])
                            shapes.append(None if f["geometry"] is None else json.dumps(f["geometry"]))
                            properties.append(json.dumps(f["properties"]))
            yield pa.RecordBatch.from_arrays([pa.array(venues, batch.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(ids, pa.string()), pa.array(shapes, pa.string()), pa.array(properties, pa.string())], [key, "feature_type", "id", "geometry", "properties"])

    return packed.select(key, "content").mapInArrow(run, f"{key} {kind}, feature_type string, id string, geometry string, properties string")
