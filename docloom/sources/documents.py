"""Files of any kind as a Spark data source, batch and stream: ``spark.read.format("document_files")``.

Rows are (document_id, filename, size_bytes, content). Partitions are cut by total bytes, so
a folder of many small files and one of few large ones are both read in even parts; a
partition sends its files in batches of bounded bytes, one file being the least. Options:

* ``path`` - a folder, read with all below it, or a file;
* ``partition_bytes`` - bytes of a partition, 64 MB by default;
* ``suffixes`` - comma-separated; other files are not read;
* ``without`` - comma-separated suffixes that are not read;
* ``content`` - ``false``: the files are listed and not opened, ``content`` is null.

A stream takes files by (time of change, path): what a batch took is told by the last one of
it, so a batch that runs again after a failure has the same files. A file that appears with
a time before that of a file already taken is not seen.

A file that is gone when it is read has a null content. Files are reached by pyarrow's file
systems, which every executor needs; other stores are read by Spark's ``binaryFile``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "document_files"
PARTITION_BYTES = 64 << 20
#: Bytes of the files that are sent together.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    changed: int

    @property
    def place(self) -> tuple[int, str]:
        return self.changed, self.path


@dataclass
class Part(InputPartition):
    files: tuple[Found, ...]


def suffix_of(path: str) -> str:
    """As ``parsing.file_suffix``: lower case with the dot, none for a name that begins with its only one."""
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return name[dot:].lower() if dot > 0 and name[dot - 1] != "." and dot < len(name) - 1 else ""


def cut(files: list[Found], most: int) -> list[tuple[Found, ...]]:
    """Runs of files of ``most`` bytes in all; a larger file is a run of its own."""
    runs: list[list[Found]] = []
    total = 0
    for f in files:
        if not runs or total + f.size > most:
            runs.append([])
            total = 0
        runs[-1].append(f)
        total += f.size
    return [tuple(r) for r in runs]


class _Folder:
    def __init__(self, options: dict):
        self.root = options["path"]
        said = lambda k: {s.strip().lower() for s in options.get(k, "").split(",") if s.strip()}
        self.suffixes, self.without = said("suffixes"), said("without")
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.opened = options.get("content", "true").lower() != "false"

    def found(self) -> list[Found]:
        """The folder's files in the order of their paths; hidden ones are left out."""
        fs, at = pyarrow.fs.FileSystem.from_uri(self.root)
        info = fs.get_file_info(at)
        every = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True, allow_not_found=True))
        out = []
        for f in every:
            kind = suffix_of(f.path)
            if f.type != pyarrow.fs.FileType.File or f.base_name[0] in "._":
                continue
            if (self.suffixes and kind not in self.suffixes) or kind in self.without:
                continue
            out.append(Found(f.path, f.size, f.mtime_ns or 0))
        return sorted(out, key=lambda f: f.path)

    def rows(self, files: tuple[Found, ...]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.root)
        for run in cut(list(files), BATCH_BYTES):
            content = []
            for f in run:
                try:
                    if self.opened:
                        with fs.open_input_file(f.path) as file:
                            content.append(file.read())
                    else:
                        content.append(None)
                except FileNotFoundError:
                    content.append(None)
            ids = [hashlib.sha256(f"{f.path}|{f.size}".encode()).hexdigest()[:32] for f in run]
            columns = [pa.array(ids), pa.array([f.path.rsplit("/", 1)[-1] for f in run]), pa.array([f.size for f in run], pa.int64()), pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["document_id", "filename", "size_bytes", "content"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def partitions(self) -> list[InputPartition]:
        return [Part(run) for run in cut(self.folder.found(), self.folder.bytes)] or [Part(())]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.folder.rows(partition.files)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max((f.place for f in self.folder.found()), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return [Part(run) for run in cut([f for f in self.folder.found() if low < f.place <= high], self.folder.bytes)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.folder.rows(partition.files)


class DocumentFiles(DataSource):
    """See the module's text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "document_id string, filename string, size_bytes long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def read_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """(document_id, filename, size_bytes, content) of the files below a path."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(NAME).options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def stream_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same as a stream."""
    spark.dataSource.register(DocumentFiles)
    return spark.readStream.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)
