"""Binary glTF: header, chunks, accessors and primitives."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from floorspan.session import ship

#: Fixed values of the format.
MAGIC, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 0x4E4F534A, 0x004E4942
COMPONENTS = {5120: np.int8, 5121: np.uint8, 5122: np.int16, 5123: np.uint16, 5125: np.uint32, 5126: np.float32}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}


def chunks(data: bytes) -> tuple[dict, bytes]:
    magic, version, length = struct.unpack_from("<III", data, 0)
    if magic != MAGIC or version != 2 or length > len(data):
        raise ValueError("not a binary glTF 2 file")
    doc, blob, at = None, b"", 12
    while at + 8 <= length:
        size, kind = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == JSON_CHUNK and doc is None:
            doc = json.loads(body)
        elif kind == BIN_CHUNK and not blob:
            blob = body
        at += 8 + size
    if doc is None:
        raise ValueError("no JSON chunk")
    return doc, blob


def accessor(doc: dict, blob: bytes, index: int) -> np.ndarray:
    """The values of an accessor, a row for each element."""
    a = doc["accessors"][index]
    view = doc["bufferViews"][a["bufferView"]]
    kind, width = np.dtype(COMPONENTS[a["componentType"]]), WIDTHS[a["type"]]
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    stride = view.get("byteStride") or kind.itemsize * width
    if start + stride * max(0, a["count"] - 1) + kind.itemsize * width > len(blob):
        raise ValueError("accessor runs over its buffer")
    return np.ndarray((a["count"], width), kind.newbyteorder("<"), blob, start, (stride, kind.itemsize))


def primitives(data: bytes) -> Iterator[tuple[int, int, int, int, list[float], list[float]]]:
    """(mesh, primitive, vertices, triangles, least corner, greatest corner) of every primitive."""
    doc, blob = chunks(data)
    for m, mesh in enumerate(doc.get("meshes", ())):
        for k, p in enumerate(mesh["primitives"]):
            points = accessor(doc, blob, p["attributes"]["POSITION"])
            n = doc["accessors"][p["indices"]]["count"] if "indices" in p else len(points)
            yield m, k, len(points), n // 3, points.min(axis=0).astype(float).tolist(), points.max(axis=0).astype(float).tolist()


def pack(meshes: list[np.ndarray]) -> bytes:
    """A binary glTF file of meshes of one primitive each, from triangles' corners (n, 3)."""
    views, accessors, blobs, at = [], [], [], 0
    for points in meshes:
        body = np.ascontiguousarray(points, dtype="<f4").tobytes()
        views.append({"buffer": 0, "byteOffset": at, "byteLength": len(body)})
        accessors.append({"bufferView": len(views) - 1, "componentType": 5126, "count": len(points), "type": "VEC3"})
        blobs.append(body)
        at += len(body)
    doc = {"asset": {"version": "2.0"}, "buffers": [{"byteLength": at}], "bufferViews": views, "accessors": accessors, "meshes": [{"primitives": [{"attributes": {"POSITION": i}}]} for i in range(len(meshes))]}
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = b"".join(blobs)
    return struct.pack("<III", MAGIC, 2, 28 + len(text) + len(body)) + struct.pack("<II", len(text), JSON_CHUNK) + text + struct.pack("<II", len(body), BIN_CHUNK) + body


PRIMITIVES = "path string, mesh int, primitive int, vertices long, triangles long, least array<double>, greatest array<double>"


def primitives_of(files: DataFrame) -> DataFrame:
    """The primitives of binary glTF files (path, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, *p) for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in primitives(data)]
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "mesh", "primitive", "vertices", "triangles", "least", "greatest"])

    return files.select("path", "content").mapInArrow(run, PRIMITIVES)


def read_glb(spark: SparkSession, path: str) -> DataFrame:
    """Primitives of all binary glTF files under a path."""
    return primitives_of(spark.read.format("binaryFile").load(path))


def packed(triangles: DataFrame, key: str) -> DataFrame:
    """(path, content): a file for each key of triangles with corners x1, y1, z1 to x3, y3, z3; one level's mesh fits into a worker."""
    ship(triangles.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        corners = np.stack([t[f"{k}{i}"].to_numpy() for i in (1, 2, 3) for k in "xyz"], axis=1).reshape(-1, 3)
        return pa.table({"path": pa.array([str(t[key][0].as_py())]), "content": pa.array([pack([corners])], pa.binary())})

    corners = [f"{k}{i}" for i in (1, 2, 3) for k in "xyz"]
    return triangles.select(key, *corners).groupBy(key).applyInArrow(run, "path string, content binary")
