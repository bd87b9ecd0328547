"""Line formats as data sources of Spark: `spark.read.format("survey_mot").load(path)` and `df.write.format("survey_mot").save(path)`.

A file is read in ranges of bytes, each a partition, so that one huge file is many tasks: a range has the lines that
begin in it. Rows travel as Arrow batches. A task writes a file of its own below a hidden folder of the job; only the
job's commit moves the files to their place, and its abort removes them, so a job that fails leaves no file, and a
task that runs twice counts once. Paths are URIs of any store that pyarrow reaches (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a range, and rows of a batch.
RANGE, ROWS = 64 << 20, 50_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), posixpath.abspath(path)


def _files(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The file, or all files below a folder but for hidden ones, by name."""
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda f: any(p.startswith((".", "_")) for p in f.path[len(path) :].split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and not hidden(f)), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


def lines_of(file, begin: int, end: int, size: int, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Lines that begin within begin to end, each with the byte it begins at."""
    at = max(0, begin - 1)
    file.seek(at)
    held, first = b"", begin > 0
    while at < end:
        data = file.read(min(block, size - at - len(held)))
        whole = not data
        held += data
        if first:  # what another range has read
            cut = held.find(b"\n")
            if cut < 0 and not whole:
                continue
            first, used = False, len(held) if cut < 0 else cut + 1
            at, held = at + used, held[used:]
        *lines, rest = held.split(b"\n")
        if whole and rest:
            lines, rest = [*lines, rest], b""
        for line in lines:
            if at >= end:
                return
            yield at, line
            at += len(line) + 1
        held = rest
        if whole:
            return


@dataclass
class Moved(WriterCommitMessage):
    file: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int, columns: list[str], parse: Callable[[str], tuple | None], schema):
        self.path, self.size, self.columns, self.parse, self.schema = path, size, columns, parse, schema

    def partitions(self) -> list[Range]:
        store, path = _store(self.path)
        return [Range(f.path, b, min(b + self.size, f.size)) for f in _files(store, path) for b in range(0, f.size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _store(self.path)
        schema, rows = to_arrow_schema(self.schema), []
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        with store.open_input_file(partition.file) as file:
            for at, line in lines_of(file, partition.begin, partition.end, file.size()):
                row = self.parse(line.decode("utf-8", "replace").strip())
                if row is not None:
                    rows.append((partition.file, at, *row))
                if len(rows) == ROWS:
                    yield as_batch(rows)
                    rows = []
        if rows:
            yield as_batch(rows)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, form: Callable[[dict], str], needed: list[str], columns: list[str]):
        missing = [c for c in needed if c not in columns]
        if missing:
            raise ValueError(f"columns {missing} are missing")
        self.path, self.overwrite, self.form, self.needed = path, overwrite, form, needed
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        store, path = _store(self.path)
        file, n = f"{path}/{self.job}/part-{uuid.uuid4().hex}.txt", 0
        store.create_dir(posixpath.dirname(file), recursive=True)
        with store.open_output_stream(file) as out:
            for batch in iterator:
                for row in batch.select(self.needed).to_pylist():
                    out.write(self.form(row).encode() + b"\n")
                n += batch.num_rows
        return Moved(file, n)

    def commit(self, messages: list[Moved | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        old = [f.path for f in _files(store, path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.rows:
                store.move(m.file, f"{path}/{posixpath.basename(m.file)}")
        for f in old:
            store.delete_file(f)
        self.abort(messages)

    def abort(self, messages: list[Moved | None]) -> None:
        store, path = _store(self.path)
        if store.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.job}")


class Lines(DataSource):
    """A format of one row a line. Its rows have file, and row_id, the byte that the line begins at."""

    columns: dict[str, str]

    @classmethod
    def name(cls) -> str:
        raise NotImplementedError

    @staticmethod
    def parse(line: str) -> tuple | None:
        """The row of a line, None for a line without one."""
        raise NotImplementedError

    @staticmethod
    def form(row: dict) -> str:
        raise NotImplementedError

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in ({"file": "string", "row_id": "long"} | self.columns).items())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE)), list(self.columns), self.parse, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite, self.form, [c for c in self.columns if c != "extra"], schema.names)


def _number(cells: list[str], i: int, default: float) -> float:
    return float(cells[i]) if len(cells) > i and cells[i] else default


class Detections(Lines):
    """`frame x1 y1 x2 y2 [confidence [class]]`, by blanks; lines that begin with # are comments, lines of fewer cells are left out."""

    columns = {"frame": "long", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "confidence": "double", "class_id": "long"}

    @classmethod
    def name(cls) -> str:
        return "survey_detections"

    @staticmethod
    def parse(line: str) -> tuple | None:
        cells = line.split()
        if line.startswith("#") or len(cells) < 5:
            return None
        return int(float(cells[0])), *map(float, cells[1:5]), _number(cells, 5, 1.0), int(_number(cells, 6, 0))

    @staticmethod
    def form(row: dict) -> str:
        return "%d %.2f %.2f %.2f %.2f %.4f %d" % tuple(row[c] for c in Detections.columns)


class Mot(Lines):
    """`frame,id,left,top,width,height[,confidence[,class]]` as corners; a track of -1 is null."""

    columns = {"frame": "long", "track_id": "long", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "confidence": "double", "class_id": "long"}

    @classmethod
    def name(cls) -> str:
        return "survey_mot"

    @staticmethod
    def parse(line: str) -> tuple | None:
        cells = [c.strip() for c in line.split(",")]
        if line.startswith("#") or len(cells) < 6:
            return None
        track, (x, y, w, h) = int(float(cells[1])), map(float, cells[2:6])
        return int(float(cells[0])), None if track == -1 else track, x, y, x + w, y + h, _number(cells, 6, 1.0), int(_number(cells, 7, 0))

    @staticmethod
    def form(row: dict) -> str:
        given = lambda c: -1 if row[c] is None else row[c]
        return "%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,%d,1.00" % (row["frame"], given("track_id"), row["x1"], row["y1"], row["x2"] - row["x1"], row["y2"] - row["y1"], given("confidence"), given("class_id"))


def register(spark: SparkSession, *formats: type[Lines]) -> None:
    """Makes the formats of this module, and others of the same kind, known to a session by their names."""
    for f in (Detections, Mot, *formats):
        spark.dataSource.register(f)
