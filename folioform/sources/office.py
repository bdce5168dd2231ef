"""Documents as data sources of Spark: one file gives many rows, many small files are one task, and written files appear together or not at all.

    office.register(spark)
    spark.read.format("folioform-office").load(folder)     # schema.RUN: runs of Word and PowerPoint files
    spark.read.format("folioform-text").load(folder)       # (path, text), any charset
    spark.read.format("folioform-html").load(folder)       # (path, node_no, tag, text): text nodes
    df.write.format("folioform-files").mode("append").save(folder)    # rows (name, content) as files

Options of the readers: `taskBytes` (64 MB), how much goes to a task; `badFiles`, `skip` (the default) or `fail`. The writer takes
mode("append"), which adds files, and mode("overwrite"), which replaces the folder's. Folders are addresses of any file system that
Arrow knows (a local or mounted path, hdfs, s3, gs).
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .files import RUNS, decode, runs_of
from .html import nodes_of

TASK_BYTES = 64 << 20
#: Where writers put files until they are committed. Names that begin so are no documents.
STAGE = "_stage-"
#: A folder of committed files.
MADE = "files-"


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", address):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))
    return fs.LocalFileSystem(), address


@dataclass
class Files(InputPartition):
    """Documents that one task reads."""

    names: list[str]


class DocumentReader(DataSourceReader):
    """Reads the files with a source's suffixes below a folder, in tasks of about taskBytes; a file is never split."""

    def __init__(self, source: Documents, schema: StructType) -> None:
        self.address, self.rows_of, self.suffixes, self.schema = source.options.get("path", ""), source.rows_of, source.suffixes, to_arrow_schema(schema)
        self.most = int(source.options.get("taskBytes", TASK_BYTES))
        self.fail = source.options.get("badFiles", "skip").lower() == "fail"

    def partitions(self) -> list[Files]:
        store, folder = opened(self.address)
        info = store.get_file_info(folder)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.address)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(folder, recursive=True))
        hidden = lambda path: any(p.startswith(("_", ".")) for p in path[len(folder) :].split("/"))
        found = sorted((f.path, f.size or 0) for f in found if f.is_file and f.path.lower().endswith(self.suffixes) and not (hidden(f.path) and f.path != folder))
        tasks, size = [], 0
        for path, n in found:
            if not tasks or size + n > self.most:
                tasks.append(Files([]))
                size = 0
            tasks[-1].names.append(path)
            size += n
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.address)
        for name in partition.names:
            with store.open_input_stream(name) as f:
                data = f.read()
            try:
                rows = [(name, *r) for r in self.rows_of(data)]
            except (zipfile.BadZipFile, ElementTree.ParseError) as e:
                if self.fail:
                    raise ValueError(f"{name} cannot be read: {e}") from e
                continue
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000]), self.schema.types)], schema=self.schema)


class Documents(DataSource):
    """Base of the readers: rows_of gives the rows of a file without its path."""

    suffixes: ClassVar[tuple[str, ...]] = ()
    ddl: ClassVar[str] = ""

    @staticmethod
    def rows_of(data: bytes) -> list[tuple]:
        raise NotImplementedError

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self, schema)


class Office(Documents):
    suffixes, ddl, rows_of = (".docx", ".pptx"), RUNS, staticmethod(runs_of)

    @classmethod
    def name(cls) -> str:
        return "folioform-office"


class Text(Documents):
    suffixes, ddl = (".txt",), "path string, text string"

    @classmethod
    def name(cls) -> str:
        return "folioform-text"

    @staticmethod
    def rows_of(data: bytes) -> list[tuple]:
        return [(decode(data),)]


class Html(Documents):
    suffixes, ddl = (".html", ".htm"), "path string, node_no int, tag string, text string"

    @classmethod
    def name(cls) -> str:
        return "folioform-html"

    @staticmethod
    def rows_of(data: bytes) -> list[tuple]:
        return [(k, tag, text) for k, (tag, text) in enumerate(nodes_of(decode(data)))]


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder below the stage, and how many files."""

    folder: str
    files: int


class FileWriter(DataSourceArrowWriter):
    """Each task writes to a folder of its own below a stage; commit puts these folders in place, abort removes the stage.

    A task that is tried again writes to another folder; only folders of tasks that the driver heard of are put in place.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.address, self.overwrite, self.stage = options["path"], overwrite, f"{STAGE}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, folder = opened(self.address)
        own, count = f"{folder}/{self.stage}/{uuid.uuid4().hex}", 0
        for batch in iterator:
            names, contents = (batch.column(batch.schema.get_field_index(k)) for k in ("name", "content"))
            for name, content in zip(names, contents):
                if not name.is_valid or not content.is_valid or "/" in name.as_py() or name.as_py().startswith((".", "_")):
                    raise ValueError(f"neither a name nor content of a file may be null, or a name have a folder: {name}")
                if not count:
                    store.create_dir(own)
                with store.open_output_stream(f"{own}/{name.as_py()}") as f:
                    f.write(content.as_py())
                count += 1
        return Staged(own if count else "", count)

    def commit(self, messages: list[Staged | None]) -> None:
        store, folder = opened(self.address)
        store.create_dir(folder)
        before = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(STAGE)] if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                store.move(m.folder, f"{folder}/{MADE}{m.folder.rsplit('/', 1)[1]}")
        for path in before:  # what was there stays until all that is new is there
            (store.delete_dir if store.get_file_info(path).type == fs.FileType.Directory else store.delete_file)(path)
        self._clear(store, folder)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.address))

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(f"{folder}/{self.stage}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.stage}")


class Made(DataSource):
    """Writes rows (name string, content binary) as files, and reads them again as (path, content)."""

    suffixes, ddl, rows_of = ("",), "path string, content binary", staticmethod(lambda data: [(data,)])

    @classmethod
    def name(cls) -> str:
        return "folioform-files"

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds != {"name": "string", "content": "binary"}:
            raise ValueError("files are written from rows (name string, content binary)")
        return FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (Office, Text, Html, Made):
        spark.dataSource.register(source)
