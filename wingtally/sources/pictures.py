"""Tags of pictures (position, time, camera), pictures with new tags, and meshes as files."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import _decoded

# Field types as (code, bytes), and the tags in use.
_FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 7: ("s", 1), 9: ("i", 4), 10: ("ii", 8)}
_MAKE, _MODEL, _TIME, _GPS, _MORE, _COMMENT, _TAKEN = 271, 272, 306, 34853, 34665, 37510, 36867


def _fields(data: bytes, order: str, at: int) -> dict[int, object]:
    """The fields of one directory; text without its zeros, fractions as floats."""
    out = {}
    if at + 2 > len(data):
        return out
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        p = at + 2 + 12 * i
        if p + 12 > len(data):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", data, p)
        if kind not in _FIELDS:
            continue
        code, size = _FIELDS[kind]
        place = p + 8 if n * size <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
        if place + n * size > len(data):
            continue
        if code == "s":
            out[tag] = data[place : place + n].rstrip(b"\0").decode("utf-8", "replace")
        else:
            v = struct.unpack_from(f"{order}{n * len(code)}{code[0]}", data, place)
            out[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)] if len(code) == 2 else list(v)
    return out


def picture_tags(content: bytes) -> dict:
    """lat, lon, alt, ts, make, model and comment of a JPEG's tags; what is not there is None, an altitude without a value 0."""
    none = dict.fromkeys(("lat", "lon", "alt", "ts", "make", "model", "comment"))
    at = content.find(b"Exif\0\0")
    if at < 0 or content[:2] != b"\xff\xd8":
        return none
    data = content[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return none
    top = _fields(data, order, struct.unpack_from(order + "I", data, 4)[0])
    more = _fields(data, order, top[_MORE][0]) if _MORE in top else {}
    out = none | {"make": top.get(_MAKE), "model": top.get(_MODEL), "comment": top.get(_COMMENT) or more.get(_COMMENT)}
    ts = top.get(_TIME)
    out["ts"] = pd.to_datetime(ts, format="%Y:%m:%d %H:%M:%S", errors="coerce") if ts else None
    if _GPS in top:
        gps = _fields(data, order, top[_GPS][0])
        for name, tag, against in (("lat", 2, "S"), ("lon", 4, "W")):
            if tag in gps:
                d, m, s = (*gps[tag], 0, 0, 0)[:3]
                out[name] = (d + m / 60 + s / 3600) * (-1 if gps.get(tag - 1, "").startswith(against) else 1)
        below = gps.get(5) == [1]
        out["alt"] = float(gps[6][0]) * (-1 if below else 1) if gps.get(6) else 0.0
    return out


def read_picture_tags(spark: SparkSession, path: str) -> DataFrame:
    """A row for each picture: file, lat, lon, alt, ts, make, model, comment."""

    def rows(path: str, content: bytes):
        t = picture_tags(content)
        yield path, t["lat"], t["lon"], t["alt"], None if t["ts"] is None or pd.isna(t["ts"]) else t["ts"].strftime("%Y-%m-%d %H:%M:%S"), t["make"], t["model"], t["comment"]

    out = _decoded(spark, path, "file string, lat double, lon double, alt double, ts string, make string, model string, comment string", rows, "*.{jpg,jpeg,JPG}")
    return out.withColumn("ts", F.try_to_timestamp("ts"))


def _directory(fields: list[tuple[int, int, int, bytes]], at: int) -> bytes:
    """A directory that begins at `at`: fields (tag, type, count, data) with what does not fit behind it."""
    head, more, after = b"", b"", at + 6 + 12 * len(fields)
    for tag, kind, n, data in sorted(fields):
        head += struct.pack("<HHI", tag, kind, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", after + len(more)))
        more += data + b"\0" * (len(data) % 2) if len(data) > 4 else b""
    return struct.pack("<H", len(fields)) + head + b"\0" * 4 + more


def _parts(degrees: float) -> bytes:
    """Degrees, minutes and seconds to 1/10,000 as fractions."""
    left = round(abs(degrees) * 36_000_000)
    d, left = divmod(left, 36_000_000)
    m, s = divmod(left, 600_000)
    return struct.pack("<6I", d, 1, m, 1, s, 10_000)


def with_tags(content: bytes, lat: float, lon: float, alt: float, make: str = "", model: str = "", ts: str | None = None, comment: str | None = None) -> bytes:
    """A JPEG with these tags in place of those it has, its other segments as they are; a negative altitude is below the sea; ts as `yyyy:MM:dd HH:mm:ss`."""
    text = lambda tag, s: (tag, 2, len(s.encode()) + 1, s.encode() + b"\0")
    fields = [text(_MAKE, make), text(_MODEL, model)]
    fields += [text(t, ts) for t in (_TIME, _TAKEN, _TAKEN + 1)] if ts else []
    fields += [text(_COMMENT, comment)] if comment else []
    gps = [
        (0, 1, 4, b"\2\3\0\0"), (1, 2, 2, b"N\0" if lat >= 0 else b"S\0"), (2, 5, 3, _parts(lat)), (3, 2, 2, b"E\0" if lon >= 0 else b"W\0"), (4, 5, 3, _parts(lon)),
        (5, 1, 1, b"\0" if alt >= 0 else b"\1"), (6, 5, 1, struct.pack("<2I", round(abs(alt) * 1000), 1000)), (9, 2, 2, b"A\0"), (18, 2, 7, b"WGS-84\0"),
    ]
    size = len(_directory([*fields, (_GPS, 4, 1, b"\0" * 4)], 8))
    data = b"II\x2a\0\x08\0\0\0" + _directory([*fields, (_GPS, 4, 1, struct.pack("<I", 8 + size))], 8) + _directory(gps, 8 + size)
    rest, at = content[2:], 0
    out = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data
    while rest[at : at + 1] == b"\xff" and rest[at + 1] not in (0xDA, 0xD9):  # the other segments, XMP among them, without old tags
        n = 2 + int.from_bytes(rest[at + 2 : at + 4], "big")
        if not (rest[at + 1] == 0xE1 and rest[at + 4 : at + 10] == b"Exif\0\0"):
            out += rest[at : at + n]
        at += n
    return out + rest[at:]


def tagged(pictures: DataFrame) -> DataFrame:
    """file and content of pictures (file, content, lat, lon, alt, make, model, ts, comment) with their tags written; see write_files for files of them."""

    def run(batches):
        for pdf in batches:
            text = lambda v: None if v is None or pd.isna(v) else str(v)
            new = [with_tags(bytes(r.content), r.lat, r.lon, r.alt, text(r.make) or "", text(r.model) or "", text(r.ts), text(r.comment)) for r in pdf.itertuples()]
            yield pd.DataFrame({"file": pdf["file"], "content": new})

    rows = pictures.select("file", "content", "lat", "lon", "alt", "make", "model", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("ts"), "comment")
    return rows.mapInPandas(run, "file string, content binary")


def glb(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A binary glTF file of one mesh."""
    v, f = np.ascontiguousarray(vertices, "<f4"), np.ascontiguousarray(faces, "<u4")
    body = v.tobytes() + f.tobytes()
    head = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "buffers": [{"byteLength": len(body)}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "mode": 4}]}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": v.nbytes, "target": 34962}, {"buffer": 0, "byteOffset": v.nbytes, "byteLength": f.nbytes, "target": 34963}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(v), "type": "VEC3", "min": v.min(0).tolist(), "max": v.max(0).tolist()}, {"bufferView": 1, "componentType": 5125, "count": f.size, "type": "SCALAR"}],
    }
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body


def glb_faces(content: bytes) -> np.ndarray:
    """(faces, 3) of the first mesh."""
    size = struct.unpack_from("<I", content, 12)[0]
    head = json.loads(content[20 : 20 + size])
    a = head["accessors"][head["meshes"][0]["primitives"][0]["indices"]]
    view = head["bufferViews"][a["bufferView"]]
    kind = {5121: "<u1", 5123: "<u2", 5125: "<u4"}[a["componentType"]]
    return np.frombuffer(content, kind, a["count"], 28 + size + view.get("byteOffset", 0) + a.get("byteOffset", 0)).reshape(-1, 3)


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """file and the vertices a, b, c of each face of binary glTF files."""

    def rows(path: str, content: bytes):
        for f in glb_faces(content):
            yield path, *map(int, f)

    return _decoded(spark, path, "file string, a long, b long, c long", rows, "*.glb")


def mesh_files(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """file and content of a binary glTF for each file of vertices (file, v, x, y, z) and faces (file, a, b, c); vertices are numbered anew in order of v. One file is one task's."""

    def run(v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if v.empty:
            return pd.DataFrame({"file": [], "content": []})
        v = v.sort_values("v")
        at = np.searchsorted(v["v"].to_numpy(), f[["a", "b", "c"]].to_numpy())
        return pd.DataFrame({"file": [v["file"].iloc[0]], "content": [glb(v[["x", "y", "z"]].to_numpy(float), at)]})

    return vertices.select("file", "v", "x", "y", "z").groupBy("file").cogroup(faces.select("file", "a", "b", "c").groupBy("file")).applyInPandas(run, "file string, content binary")


def flat_mesh(spark: SparkSession, file: str, x: float, y: float, z: float, extent: float) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a level square of two triangles around a place."""
    h = extent / 2
    corners = [(file, i, x + a * h, y + b * h, z) for i, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))]
    return spark.createDataFrame(corners, "file string, v long, x double, y double, z double"), spark.createDataFrame([(file, 0, 1, 2), (file, 0, 2, 3)], "file string, a long, b long, c long")
