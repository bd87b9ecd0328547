"""Readers of binary files, one file a row, decoded in Arrow batches."""

from __future__ import annotations

import io
import json
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _decoded(spark: SparkSession, path: str, schema: str, rows, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in rows(p, c)]
            yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(run, schema)


def tracklets(path: str, content: bytes):
    """(file, track, frame, box, confidence, class) of an archive of key points: the box is the extent of the finite ones; frames that are no numbers are left out. Without an id array, the id is the file name's."""
    z = np.load(io.BytesIO(content), allow_pickle=False)
    xs, ys = (np.stack([z[k] for k in sorted(z.files, key=len) if re.fullmatch(rf"pose{a}\d+", k)]) for a in "XY")
    xs[~np.isfinite(xs)], ys[~np.isfinite(ys)] = np.nan, np.nan
    named = re.search(r"id(\d+)[^/]*$", path)
    track = int(z["id"].ravel()[0]) if "id" in z.files else int(named[1]) if named else 0
    for i, f in enumerate(z["frame"]):
        x, y = xs[:, i][~np.isnan(xs[:, i])], ys[:, i][~np.isnan(ys[:, i])]
        if np.isfinite(f) and len(x) and len(y):
            yield path, track, int(f), float(x.min()), float(y.min()), float(x.max()), float(y.max()), float(z["detection_p"][i]) if "detection_p" in z.files else 1.0, int(z["detection_class"][i]) if "detection_class" in z.files else 0


def read_tracklets(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, "file string, track_id long, frame long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id long", tracklets, "*.npz")


def glb_vertices(path: str, content: bytes):
    """(file, v, x, y, z) of the first mesh of a binary glTF file."""
    magic, _, _ = struct.unpack_from("<4sII", content)
    if magic != b"glTF":
        return
    size, _ = struct.unpack_from("<II", content, 12)
    head = json.loads(content[20 : 20 + size])
    data = content[20 + size + 8 :]
    a = head["accessors"][head["meshes"][0]["primitives"][0]["attributes"]["POSITION"]]
    view = head["bufferViews"][a["bufferView"]]
    at = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    for i, p in enumerate(np.frombuffer(data, "<f4", a["count"] * 3, at).reshape(-1, 3)):
        yield path, i, *map(float, p)


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, "file string, v long, x double, y double, z double", glb_vertices, "*.glb")


_XMP = re.compile(rb'drone-dji:([A-Za-z]+)="([^"]*)"')


def drone_tags(path: str, content: bytes):
    """(file, lat, lon, alt, yaw, pitch, roll) of a picture's flight tags; roll within 5 degrees of half a turn is 0; without a position, nothing."""
    tags = {k.decode(): v.decode("utf-8", "replace") for k, v in _XMP.findall(content)}

    def num(*names: str) -> float | None:
        for n in names:
            try:
                return float(tags[n])
            except (KeyError, ValueError):
                continue
        return None

    lat, lon = num("GpsLatitude"), num("GpsLongitude", "GpsLongtitude")
    if lat is None or lon is None:
        return
    roll, yaw = num("GimbalRollDegree"), num("GimbalYawDegree")
    yield path, lat, lon, num("AbsoluteAltitude"), None if yaw is None else yaw % 360, num("GimbalPitchDegree"), None if roll is None else 0.0 if abs(abs(roll) - 180) <= 5 else roll


def read_drone_tags(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, "file string, lat double, lon double, alt double, yaw double, pitch double, roll double", drone_tags, "*.[jJ][pP]*[gG]")


def ber_length(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([0x80 | (len(b := n.to_bytes((n.bit_length() + 7) // 8, "big")))]) + b


def checksum(data: bytes) -> int:
    """Sum of 16-bit words, the odd byte last as the high one."""
    return sum(b << (8 * ((i + 1) % 2)) for i, b in enumerate(data)) & 0xFFFF


def klv(tags: list[tuple[int, bytes]], universal_key: bytes) -> bytes:
    """A packet: key, length, tags with lengths, and the checksum as tag 1."""
    body = b"".join(bytes([t]) + ber_length(len(v)) + v for t, v in tags)
    head = universal_key + ber_length(len(body) + 4) + body + b"\x01\x02"
    return head + struct.pack(">H", checksum(head))


# Bytes that cameras put after their thermal block, the likeliest first; raw values of -100 to 500 degrees and of outliers.
_TAILS, _WARM, _EXTREME = (512, 0, 256, 128, 768, 64, 1024, 32, 2048), (11_000, 50_000), (500, 64_500)


def jpeg_size(content: bytes) -> tuple[int, int] | None:
    """Height and width from the frame header of a JPEG."""
    at = 2
    while at + 9 < len(content) and content[at] == 0xFF:
        kind, n = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 5 : at + 7], "big"), int.from_bytes(content[at + 7 : at + 9], "big")
        at += 2 if kind == 0xFF else 2 + n
    return None


def thermal(content: bytes) -> np.ndarray | None:
    """Degrees Celsius (rows, columns) of the block of 64ths of a kelvin near the end of a thermal picture: of the places where it may lie, that with most values in range and fewest outliers; None where none will do."""
    size = jpeg_size(content)
    if not size:
        return None
    n, best, score = size[0] * size[1], None, 0.0
    for tail in _TAILS:
        start = len(content) - 2 * n - tail
        if start < 0:
            continue
        block = np.frombuffer(content, "<u2", n, start)
        warm = ((block >= _WARM[0]) & (block <= _WARM[1])).mean()
        value = warm * max(0.0, 1 - 200 * ((block < _EXTREME[0]) | (block > _EXTREME[1])).mean()) if warm >= 0.9 else 0.0
        if value > score:
            best, score = block, value
    return None if best is None else best.reshape(size) / 64.0 - 273.15


def read_thermal(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col and temperature of each pixel of thermal pictures; pictures without a block give no rows."""

    def rows(path: str, content: bytes):
        t = thermal(content)
        for r, line in enumerate(t if t is not None else ()):
            yield from ((path, r, c, float(v)) for c, v in enumerate(line))

    return _decoded(spark, path, "file string, row long, col long, celsius double", rows, "*.{jpg,jpeg,JPG}")
