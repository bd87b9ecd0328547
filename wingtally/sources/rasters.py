"""Georeferenced rasters: TIFF files as tables of cells (row 0 is north) and back, with their world files.

A file is one task's: its strips or tiles are decoded one after the other and leave as rows at once. Classic and 64-bit
files are read, plain or with LZW, deflate or PackBits compression, with or without differences along rows, of whole numbers
or of the bytes of floating ones; plain deflate is written."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy

# TIFF field types as (code, bytes) and sample kinds by (format, bits).
_FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def tags(content: bytes) -> tuple[str, dict[int, tuple]]:
    """The byte order and the fields of the first picture of a TIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    magic = struct.unpack_from(order + "H", content, 2)[0] if order else 0
    if magic not in (42, 43) or magic == 43 and struct.unpack_from(order + "HH", content, 4) != (8, 0):
        raise ValueError("no TIFF file")
    # 64-bit files have wider counts, fields and offsets
    wide, entry, many, head = (("Q", 20, "Q", 8) if magic == 43 else ("I", 12, "H", 4))
    room = struct.calcsize(order + wide)
    at = struct.unpack_from(order + wide, content, head)[0]
    first = at + struct.calcsize(order + many)
    out = {}
    for i in range(struct.unpack_from(order + many, content, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HH" + wide, content, first + entry * i)
        if kind not in _FIELDS:
            continue
        code, size = _FIELDS[kind]
        place = first + entry * (i + 1) - room
        if size * n > room:
            place = struct.unpack_from(order + wide, content, place)[0]
        out[tag] = (content[place : place + n].rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack_from(f"{order}{n * len(code)}{code[0]}", content, place)
    return order, out


def unpacked(data: bytes) -> bytes:
    """PackBits: runs of bytes as they are, and repeated ones."""
    out, i = bytearray(), 0
    while i < len(data):
        n, i = data[i], i + 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def unfolded(raw: bytes, kind: np.dtype, rows: int, width: int, each: int) -> np.ndarray:
    """Floating numbers whose rows hold first all highest bytes, then all next ones, each as a difference from the sample before."""
    planes = np.frombuffer(raw, np.uint8, rows * width * each * kind.itemsize).reshape(rows, -1, each)
    planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * each)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, each).astype(kind.newbyteorder("="))


def unlzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bits first, 256 clears and 257 ends."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        item = table[code] if code < len(table) else last + last[:1]
        out += item
        if last:
            table.append(last + item[:1])
        last = item
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def info(content: bytes) -> dict:
    """Size, bands, bounds, cell, epsg and nodata of a TIFF file; bounds are null without a place."""
    _, t = tags(content)
    w, h = t[256][0], t[257][0]
    out = {"width": w, "height": h, "bands": t.get(277, (1,))[0], "min_x": None, "min_y": None, "max_x": None, "max_y": None, "cell_w": None, "cell_h": None, "epsg": None, "nodata": None}
    if 33550 in t and 33922 in t:
        (sx, sy), (i, j, _, x, y) = t[33550][:2], t[33922][:5]
        out |= {"cell_w": sx, "cell_h": sy, "min_x": x - i * sx, "max_y": y + j * sy}
        out |= {"max_x": out["min_x"] + w * sx, "min_y": out["max_y"] - h * sy}
    keys = t.get(34735, ())
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    out["epsg"] = found.get(3072, found.get(2048))
    if 42113 in t:
        try:
            out["nodata"] = float(t[42113][0])
        except ValueError:
            pass
    return out


def parts(content: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first band, row, column, values (rows, columns, bands)) of each strip or tile, cut to the picture."""
    order, t = tags(content)
    w, h, bands = t[256][0], t[257][0], t.get(277, (1,))[0]
    kind = np.dtype(order + _KINDS[t.get(339, (1,))[0], t[258][0]])
    packing, step, apart = t.get(259, (1,))[0], t.get(317, (1,))[0], t.get(284, (1,))[0] == 2
    tiled = 322 in t
    pw, ph = (t[322][0], t[323][0]) if tiled else (w, min(h, t.get(278, (h,))[0]))
    across, down = -(-w // pw), -(-h // ph)
    each = 1 if apart else bands
    for k, (at, n) in enumerate(zip(t[324 if tiled else 273], t[325 if tiled else 279], strict=True)):
        raw = content[at : at + n]
        if packing == 5:
            raw = unlzw(raw)
        elif packing in (8, 32946):
            raw = zlib.decompress(raw)
        elif packing == 32773:
            raw = unpacked(raw)
        elif packing != 1:
            raise ValueError(f"compression {packing} is not read")
        band, place = divmod(k, across * down)
        row, col = place // across * ph, place % across * pw
        rows = ph if tiled else min(ph, h - row)
        if step == 3 and kind.kind == "f":
            yield band, row, col, unfolded(raw, kind, rows, pw, each)[: h - row, : w - col]
            continue
        v = np.frombuffer(raw, kind, rows * pw * each).reshape(rows, pw, each)
        if step == 2:
            v = np.cumsum(v, axis=1, dtype=v.dtype.newbyteorder("="))
        elif step != 1:
            raise ValueError(f"predictor {step} is not read")
        yield band, row, col, v[: h - row, : w - col]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").load(path).select("path", "content")


def read_raster_info(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: its size, bands, bounds, cell, epsg and nodata."""
    schema = "file string, width long, height long, bands long, min_x double, min_y double, max_x double, max_y double, cell_w double, cell_h double, epsg long, nodata double"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([{"file": p, **info(c)} for p, c in zip(pdf["path"], pdf["content"], strict=True)]).astype({"epsg": "Int64"})

    return _files(spark, path).mapInPandas(run, schema)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """file, band (from 1), row, col and value of each cell; null where it is the file's nodata or no number."""

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                none = info(c)["nodata"]
                for band, row, col, v in parts(c):
                    r, k, b = np.indices(v.shape)
                    out = pd.DataFrame({"file": p, "band": band + b.ravel() + 1, "row": row + r.ravel(), "col": col + k.ravel()})
                    value = pd.Series(v.ravel().astype(float))
                    yield out.assign(value=value.where(value.notna() & (value != none) if none is not None else value.notna()).astype(object).where(lambda s: s.notna(), None))

    return _files(spark, path).mapInPandas(run, "file string, band int, row long, col long, value double")


def read_elevation(spark: SparkSession, path: str, zero_is_missing: bool = True) -> DataFrame:
    """file, row, col and z of the first band; nodata, and by default 0, are null."""
    z = F.nullif(F.col("value"), F.lit(0.0)) if zero_is_missing else F.col("value")
    return read_raster(spark, path).where("band = 1").select("file", "row", "col", z.alias("z"))


def tiff(values: np.ndarray, bounds: tuple[float, float, float, float], epsg: int, nodata: float | None = None) -> bytes:
    """A deflated TIFF file of (rows, columns, bands) over bounds, a strip of some 64 rows after the other."""
    h, w, bands = values.shape
    kind = values.dtype.newbyteorder("<")
    form, bits = next(k for k, v in _KINDS.items() if v == kind.str[1:])
    strips = [zlib.compress(np.ascontiguousarray(values[a : a + 64], kind).tobytes()) for a in range(0, h, 64)]
    sx, sy = (bounds[2] - bounds[0]) / w, (bounds[3] - bounds[1]) / h
    place = epsg if epsg not in (4326,) else None
    keys = (1, 1, 0, 3, 1024, 0, 1, 1 if place else 2, 1025, 0, 1, 1, 3072 if place else 2048, 0, 1, epsg)
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s) + len(s) % 2
    fields = [
        (256, "I", (w,)), (257, "I", (h,)), (258, "H", (bits,) * bands), (259, "H", (8,)), (262, "H", (1,)), (273, "I", offsets), (277, "H", (bands,)), (278, "I", (64,)),
        (279, "I", [len(s) for s in strips]), (284, "H", (1,)), (339, "H", (form,) * bands), (33550, "d", (sx, sy, 0.0)), (33922, "d", (0.0, 0.0, 0.0, bounds[0], bounds[3], 0.0)), (34735, "H", keys),
    ]
    if nodata is not None:
        fields.append((42113, "s", f"{nodata:g}\0".encode()))
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    head, more, after = b"", b"", at + 6 + 12 * len(fields)
    for tag, c, v in fields:
        data = v if c == "s" else struct.pack(f"<{len(v)}{c}", *v)
        n = len(v)
        if len(data) <= 4:
            head += struct.pack("<HHI", tag, code[c], n) + data.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, code[c], n, after + len(more))
            more += data + b"\0" * (len(data) % 2)
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(fields)) + head + struct.pack("<I", 0) + more


def raster_files(cells: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int, epsg: int, nodata: float = -9999.0, kind: str = "f4") -> DataFrame:
    """file and content of a TIFF for each file of cells (file, row, col, value); cells that are missing or null are nodata. One file is one task's, of the given size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.full((height, width, 1), nodata, kind)
        ok = pdf["value"].notna() & pdf["row"].between(0, height - 1) & pdf["col"].between(0, width - 1)
        v[pdf["row"][ok], pdf["col"][ok], 0] = pdf["value"][ok]
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "content": [tiff(v, bounds, epsg, nodata)]})

    return cells.select("file", "row", "col", "value").groupBy("file").applyInPandas(run, "file string, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Each row (file, content) as a file of that name in the folder, written where the row is; the folder is one that all executors share. A task that runs again writes the same files."""

    def run(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{base}/{r.file}") as out:
                out.write(bytes(r.content))

    files.select("file", "content").foreachPartition(run)


def world_file(bounds: tuple[float, float, float, float], width: int, height: int) -> str:
    """Cell size and the centre of the upper left cell, six lines."""
    sx, sy = (bounds[2] - bounds[0]) / width, -(bounds[3] - bounds[1]) / height
    return "".join(f"{v}\n" for v in (f"{sx:.10f}", "0.0", "0.0", f"{sy:.10f}", f"{bounds[0] + sx / 2:.10f}", f"{bounds[3] + sy / 2:.10f}"))


def world_file_name(file: str) -> str:
    """The world file's name beside a picture: the first and last letter of its kind and a w, or .wld after the name."""
    stem, _, kind = file.rpartition(".")
    ext = {"tif": "tfw", "tiff": "tfw", "png": "pgw", "jpg": "jgw", "jpeg": "jgw"}.get(kind.lower())
    return f"{stem}.{ext}" if ext else f"{file}.wld"


def projection_text(epsg: int) -> str:
    """The definition of a UTM zone of WGS 84 as well-known text."""
    meridian, north = geodesy.zone(epsg)
    zone = f"{epsg % 100}{'S' if north else 'N'}"
    return (
        f'PROJCS["WGS 84 / UTM zone {zone}",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],'
        f'PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{meridian:g}],PARAMETER["scale_factor",0.9996],'
        f'PARAMETER["false_easting",500000],PARAMETER["false_northing",{north:g}],UNIT["metre",1],AUTHORITY["EPSG","{epsg}"]]'
    )


def merged(rasters: DataFrame, placed: DataFrame, cell: float) -> tuple[DataFrame, dict]:
    """Cells of rasters (file, row, col, value) on one grid over all of placed (file, min_x, max_y, max_x, min_y), and that grid. Where files overlap the first by name that has a value wins."""
    r = placed.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    grid = {"min_x": r[0], "min_y": r[1], "max_x": r[2], "max_y": r[3], "cell": cell, "width": round((r[2] - r[0]) / cell), "height": round((r[3] - r[1]) / cell)} if r[0] is not None else {}
    at = placed.select("file", F.round((F.col("min_x") - (r[0] or 0.0)) / cell).cast("long").alias("_c"), F.round(((r[3] or 0.0) - F.col("max_y")) / cell).cast("long").alias("_r"))
    out = rasters.where("value is not null").join(at, "file").select((F.col("row") + F.col("_r")).alias("row"), (F.col("col") + F.col("_c")).alias("col"), "file", "value")
    return out.groupBy("row", "col").agg(F.min_by("value", "file").alias("value")), grid


def clipped(cells: DataFrame, grid: dict, box: tuple[float, float, float, float]) -> DataFrame:
    """Cells that a box touches."""
    x, y = grid["min_x"] + F.col("col") * grid["cell"], grid["max_y"] - F.col("row") * grid["cell"]
    return cells.where((x <= box[2]) & (x + grid["cell"] >= box[0]) & (y >= box[1]) & (y - grid["cell"] <= box[3]))


def thinned(cells: DataFrame, n: int) -> DataFrame:
    """Every n-th row and column, counted anew."""
    return cells.where((F.col("row") % n == 0) & (F.col("col") % n == 0)).withColumn("row", (F.col("row") / n).cast("long")).withColumn("col", (F.col("col") / n).cast("long"))
