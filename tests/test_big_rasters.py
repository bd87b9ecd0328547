"""64-bit TIFF files, PackBits and differences of floating numbers, against files built here."""

import struct
import zlib

import numpy as np
import pytest

from wingtally.sources import rasters


def packed(data):
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n > 2:
            out += bytes([257 - n, data[i]])
        else:
            n = min(2, len(data) - i)
            out += bytes([n - 1]) + data[i : i + n]
            if n == 2 and i % 3 == 0:
                out += b"\x80"  # means nothing
        i += n
    return bytes(out)


def folded(v):
    """Rows of floats as planes of bytes, highest first, each less the one before it by samples."""
    rows, width, each = v.shape
    planes = v.astype(v.dtype.newbyteorder(">")).reshape(rows, -1).view(np.uint8).reshape(rows, width * each, v.dtype.itemsize).transpose(0, 2, 1).reshape(rows, -1, each)
    first = np.concatenate([np.zeros((rows, 1, each), np.uint8), planes[:, :-1]], 1)
    return (planes - first).astype(np.uint8).tobytes()


def tiff(v, big, order, packing=1, step=1, strip=5):
    """A file of strips; v: rows, columns, bands."""
    h, w, bands = v.shape
    kind = {"f": 3, "u": 1, "i": 2}[v.dtype.kind]
    strips = []
    for r in range(0, h, strip):
        part = v[r : r + strip]
        if step == 3:
            raw = folded(part)
        else:
            if step == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
            raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
        strips.append({1: lambda x: x, 8: zlib.compress, 32773: packed}[packing](raw))
    wide = "Q" if big else "I"
    fields = [(256, "I", [w]), (257, "I", [h]), (258, "H", [v.dtype.itemsize * 8] * bands), (259, "H", [packing]), (273, wide, None), (277, "H", [bands]), (278, "I", [strip]), (279, wide, [len(s) for s in strips]), (317, "H", [step]), (339, "H", [kind] * bands), (33550, "d", [2.0, 2.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 100.0, 900.0, 0.0])]
    types, room = {"H": 3, "I": 4, "d": 12, "Q": 16}, 8 if big else 4
    head = struct.pack(order + "2sHHHQ", (b"II" if order == "<" else b"MM"), 43, 8, 0, 16) if big else struct.pack(order + "2sHI", (b"II" if order == "<" else b"MM"), 42, 8)
    size = len(head) + (8 if big else 2) + len(fields) * (20 if big else 12) + room
    behind, entries, spare = size, b"", b""
    sizes = {t: struct.calcsize(order + c) * (len(strips) if x is None else len(x)) for t, c, x in fields}
    start = behind + sum(n for n in sizes.values() if n > room)
    offsets = [start + sum(map(len, strips[:k])) for k in range(len(strips))]
    for t, c, x in fields:
        x = offsets if x is None else x
        data = struct.pack(f"{order}{len(x)}{c}", *x)
        if len(data) <= room:
            place = data.ljust(room, b"\0")
        else:
            place = struct.pack(order + wide, behind + len(spare))
            spare += data
        entries += struct.pack(order + "HH" + wide, t, types[c], len(x)) + place
    return head + struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + b"\0" * room + spare + b"".join(strips)


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("kind", "packing", "step"), [("f4", 8, 3), ("f8", 32773, 3), ("f4", 1, 1), ("u1", 32773, 1), ("i2", 32773, 2), ("u2", 8, 2)])
def test_packings(spark, tmp_path, big, order, kind, packing, step):
    rng = np.random.RandomState(1)
    v = np.round(rng.normal(50, 20, (17, 9, 2)), 2).astype(kind)
    v[3:6] = 7
    content = tiff(v, big, order, packing, step)
    got = np.zeros(v.shape)
    for band, row, col, values in rasters.parts(content):
        got[row : row + values.shape[0], col : col + values.shape[1]] = values
        assert band == 0
    assert (got == v).all()
    about = rasters.info(content)
    assert (about["width"], about["height"], about["bands"], about["min_x"], about["max_y"]) == (9, 17, 2, 100.0, 900.0)


def test_a_big_file_as_a_table(spark, tmp_path):
    v = np.arange(60, dtype="f4").reshape(10, 6, 1) / 3
    (tmp_path / "a.tif").write_bytes(tiff(v, True, "<", 8, 3))
    rows = rasters.read_raster(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 60 and {(r["row"], r["col"]): r["value"] for r in rows}[4, 5] == pytest.approx(float(v[4, 5, 0]))
    with pytest.raises(ValueError):
        rasters.tags(b"II\x2b\0\x04\0\0\0" + bytes(40))
