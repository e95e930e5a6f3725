"""``spark.read.format("test_results")``: test-result files of any dialect as rows, each file opened once.

Rows are records, and rejects (``reason`` is set) of a record or of a whole file. Small files are packed into partitions by size; an XML file of more than
``splitBytes`` whose first record tells its dialect is read in parts, which begin at record borders. Files are reached through pyarrow's file systems
(local, hdfs, s3, gs, abfs); for other stores ``results.load_results`` lets Spark read the bytes.

A file that needs the whole (JSON, TRX, whose definitions stand apart from its results, and kinds unknown) is one task's. A part that begins within a
comment or CDATA section that itself holds record elements would take these for records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from triage.sources import records as R

SCHEMA = "file string, modified timestamp, dialect string, ord long, name string, status string, message string, reason string"
_ARROW = pa.schema([("file", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("dialect", pa.string()), ("ord", pa.int64()), ("name", pa.string()), ("status", pa.string()), ("message", pa.string()), ("reason", pa.string())])
SPLIT, PACK, HEAD = 64 << 20, 32 << 20, 1 << 20
#: Rows of a batch, and how far a part reads on at a time for the end of its last record.
ROWS, MORE = 10_000, 1 << 20
ENDINGS = (".xml", ".trx", ".json")


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """(file system, path in it, what stands before the path in a URI)."""
    local = re.match(r"file:/+(.*)", path)
    if local:
        return pyarrow.fs.LocalFileSystem(), "/" + unquote(local[1]), "file://"
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pyarrow.fs.LocalFileSystem(), path, "file://"
    store, inner = pyarrow.fs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def reachable(path: str) -> bool:
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


@dataclass
class Part(InputPartition):
    """Files (path, URI, modification time in microseconds), or bytes [begin, end) of one file in a dialect."""

    files: list
    begin: int = 0
    end: int | None = None
    dialect: str | None = None


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def as_rows(uri: str, modified: int, found: list[R.Record], rejects: list[R.Reject]) -> Iterator[tuple]:
    for r in found:
        yield uri, modified, r.dialect, r.ord, r.name, r.status, r.message, None
    for r in rejects:
        yield uri, modified, None, r.ord, None, None, None, r.reason


class ResultReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.paths = json.loads(options["files"]) if "files" in options else [options["path"]]
        self.dialect = options.get("dialect")
        self.split, self.pack = int(options.get("splitbytes", SPLIT)), int(options.get("packbytes", PACK))

    def partitions(self) -> list[Part]:
        out, held, size = [], [], 0
        for path in self.paths:
            store, inner, scheme = opened(path)
            info = store.get_file_info(inner)
            if info.type == pyarrow.fs.FileType.NotFound:
                raise FileNotFoundError(path)
            under = [info] if info.is_file else sorted((f for f in store.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True)) if f.is_file), key=lambda f: f.path)
            for f in under:
                parts = f.path[len(inner) :].split("/") if not info.is_file else [f.base_name]
                if not f.path.endswith(ENDINGS) or any(p.startswith(("_", ".")) for p in parts):
                    continue
                own = (f.path, scheme + quote(f.path, safe="/+!$&'()*,;=:@~"), int(f.mtime_ns or 0) // 1000, path)
                dialect = None
                if f.size > self.split and not self.dialect:
                    with store.open_input_file(f.path) as file:
                        dialect = R.split_dialect(f.path, file.read(min(HEAD, f.size)))
                if dialect:
                    out.extend(Part([own], b, min(f.size, b + self.split), dialect) for b in range(0, f.size, self.split))
                    continue
                if held and size + f.size > self.pack:
                    out.append(Part(held))
                    held, size = [], 0
                held.append(own)
                size += f.size
        return [*out, Part(held)] if held or not out else out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, uri, modified, given in part.files:
                store, _, _ = opened(given)
                with store.open_input_file(path) as file:
                    if part.dialect is None:
                        found, rejects = R.file_records(path, file.read(), self.dialect)
                    else:
                        found, rejects = self._part(file, part)
                yield from as_rows(uri, modified, found, rejects)

        yield from batches(rows())

    def _part(self, file: pa.NativeFile, part: Part) -> tuple[list[R.Record], list[R.Reject]]:
        """The records that begin in the part; reads on until the last of them is closed."""
        size, stop = file.size(), part.end
        while True:
            file.seek(part.begin)
            content = file.read(min(size, stop + MORE) - part.begin)
            found, rejects = R.xml_records(content, part.end - part.begin, part.dialect)
            if stop + MORE >= size or not any(r.reason.endswith("closed") for r in rejects):
                break
            stop += 4 * MORE
        return [r._replace(ord=r.ord + part.begin) for r in found], [r._replace(ord=None if r.ord is None else r.ord + part.begin) for r in rejects]


class ResultFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "test_results"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ResultReader(dict(self.options))
