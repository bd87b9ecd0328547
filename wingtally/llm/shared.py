"""What the text operators share: the folder for written tables and the byte kernels.

The kernels work on the UTF-8 buffer of an Arrow string column, many documents
at a time, so that no Python object is made for a word or a byte.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel handles at once; one longer document is handled alone.
CHUNK = 1 << 19

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is
    unset, one of this machine, which will do for a session of one machine (as in tests) and no other."""
    put = spark.conf.get("spark.checkpoint.dir", None)
    if put:
        return put.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return _made.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="wingtally-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wingtally-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- byte kernels

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A random odd number for each byte value.
_BYTE = np.random.RandomState(71).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _places(n: int) -> np.ndarray:
    """A random number for each of the first n places in a word, none a power of another."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_PLACE = _places(1 << 12)


def pieces(batch: pa.RecordBatch, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose column 'text' holds at most limit bytes, or one row."""
    text = batch.column(batch.schema.get_field_index("text"))
    if batch.num_rows == 0:
        return
    size = np.diff(offsets(text)[0])
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        stop = max(stop, at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def offsets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 (a null is empty) and the bytes of an Arrow string column."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    if len(text) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = text.buffers()
    off = np.frombuffer(offs, kind, len(text) + 1, text.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[off[0] : off[-1]]
    return off - off[0], data


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of each text in a column: start, end (bytes) and doc (row)."""

    def __init__(self, text: pa.Array, lower: bool = True):
        self.off, data = offsets(text)
        self.data = _LOWER[data] if lower else data
        self.n = len(self.off) - 1
        solid = ~_SPACE[self.data]
        self.solid = solid
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        begins = self.off[:-1][self.off[:-1] < self.off[1:]]
        first[begins] = solid[begins]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        #: word offsets of each row: words off_w[i] to off_w[i + 1] are row i's
        self.off_w = np.searchsorted(self.start, self.off)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return spans_hash(self.data, self.start, self.end)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: each byte's number times its place's, summed, with the span's length."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    place = np.arange(begin[-1] + size[-1]) - np.repeat(begin, size)
    table = _PLACE if int(size.max()) <= len(_PLACE) else _places(int(size.max()))
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(_BYTE[data[place + np.repeat(start, size)]] * table[place], out=sums[1:])
    return mixed((sums[begin + size] - sums[begin]) ^ mixed(size.astype(np.uint64)))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number; the last places are filled up with zeros."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for k in (1, 2, 4):
        x[:-k] |= x[k:] << np.uint64(8 * k)
    return x[: len(data)]


def grams(wide: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes (8 or more) from each place; wide is mixed(eights(data)), which does not depend on what is hashed later."""
    steps = [*range(0, size - 7, 8)] + [size - 8] * (size % 8 > 0)
    if isinstance(at, slice):
        parts = (wide[at.start + k : at.stop + k] for k in steps)
    else:
        parts = (wide[at + k] for k in steps)
    out = None
    for part, weight in zip(parts, _ORDER, strict=False):
        out = part * weight if out is None else out + part * weight
    return mixed(out)


_ORDER = [np.uint64(2 * int(x) + 1) for x in np.random.RandomState(5).randint(0, 2**62, 64)]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k following word hashes; it starts at each of the first len(h) - k + 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _ORDER[0]
    for j in range(1, k):
        out += h[j : j + n] * _ORDER[j]
    return mixed(out)
