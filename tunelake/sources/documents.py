"""Spark data sources for telemetry: folders of small documents, and logs.

`telemetry_documents` reads every document below a folder as (path, name, folder, text). Small
files share partitions of about `partition_bytes`; `pattern` and pushed filters on the three path
columns choose files before one is opened. It also writes: documents go into bundles (plain
tar files, one stream per task), and a commit lists the bundles that count. A bundle that no
commit lists, such as that of a failed task, is never read, and a commit id counts once, so an
append may be repeated.

`telemetry_log` reads log files as records of any number of lines, (path, offset, time, file,
line_no, level, message). Partitions are byte ranges; a record belongs to the range in which its
first byte lies and is read beyond the end of the range, so no line is lost or read twice. Pushed
filters on level and file spare the records their way into the JVM.

Filters are pushed down on request only (`pushdown`). Spark 4.1 keeps what it pushed with the
table and not with the scan, so two scans of one such DataFrame under different filters would
both read what the last one wants; ask for it where a DataFrame is read under one filter.

Paths are opened with pyarrow's file systems, in the executors, from any place that all of them
reach. `register_sources` makes the formats known to a session.
"""

from __future__ import annotations

import fnmatch
import io
import json
import re
import sys
import tarfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

DOCUMENT_SCHEMA = "path string, name string, folder string, text string"
LOG_SCHEMA = "path string, offset long, time string, file string, line_no int, level string, message string"
# The first line of a log record, and how a bundle is named.
LOG_HEAD = re.compile(rb"\[([^\]]*?):([^:\]]+)#L(\d+):([A-Z]+)\]: (.*)", re.DOTALL)
BUNDLE, COMMITS = ".bundle.tar", "_commits"
BUNDLE_END = bytes(1024)
PARTITION_BYTES, BUNDLE_BYTES, BATCH_BYTES = 32 << 20, 64 << 20, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    plain = re.sub(r"^file:/+", "/", path)
    if "://" in plain:
        return fs.FileSystem.from_uri(plain)
    return fs.LocalFileSystem(), unquote(plain) if plain != path else plain


def listed(path: str) -> list[fs.FileInfo]:
    """All files below a folder (or the file itself) in name order; hidden ones and bookkeeping are left out."""
    system, root = opened(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    plain = [f for f in found if f.type == fs.FileType.File and not re.search(r"/[._]", f.path[len(root) :])]
    return sorted(plain, key=lambda f: f.path)


def committed_bundles(path: str) -> set[str]:
    """Names of the bundles that commits list."""
    system, root = opened(path)
    folder = f"{root}/{COMMITS}"
    if system.get_file_info(folder).type != fs.FileType.Directory:
        return set()
    names: set[str] = set()
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.path.endswith(".json"):
            with system.open_input_stream(info.path) as stream:
                names |= set(json.loads(stream.read())["bundles"])
    return names


# The header of a tar member without a name and size, and what its bytes other than these and the checksum add up to.
BLANK = tarfile.TarInfo().tobuf(tarfile.USTAR_FORMAT)
BLANK_SUM = sum(BLANK[:124]) + sum(BLANK[135:148]) + 8 * ord(" ") + sum(BLANK[156:])


def member_header(path: str, size: int) -> bytes:
    """The header of a bundle's member, what tarfile makes of it; short plain names are filled in, which takes a small part of the time."""
    name, digits = path.encode(), b"%011o" % size
    if len(name) > 100 or not name.isascii() or len(digits) > 11:
        member = tarfile.TarInfo(path)
        member.size = size
        return member.tobuf(tarfile.PAX_FORMAT)
    return b"%b%b%b%b%06o\0 %b" % (name.ljust(100, b"\0"), BLANK[100:124], digits, BLANK[135:148], BLANK_SUM + sum(name) + sum(digits), BLANK[156:])


def members(system: fs.FileSystem, path: str, wanted: Callable[[str], bool]) -> Iterator[tuple[str, bytes]]:
    """Names and contents of a bundle's wanted members; from the first one with a header that is not plain on, tarfile reads them."""
    with system.open_input_file(path) as raw:
        stream, offset = io.BufferedReader(pa.PythonFile(raw, mode="r"), 1 << 20), 0
        while True:
            head = stream.read(512)
            if head[156:157] != b"0" or head[257:263] != b"ustar\0" or head[345:346] != b"\0" or head[124] & 0x80:
                break
            name, size = head[:100].rstrip(b"\0").decode(), int(head[124:136].rstrip(b" \0"), 8)
            data = stream.read(size + -size % 512)
            if len(data) < size:
                raise tarfile.ReadError(f"unexpected end of {path}")
            if wanted(name):
                yield name, data[:size]
            offset += 512 + size + -size % 512
    with system.open_input_file(path) as raw:
        raw.seek(offset)
        if offset and not raw.read(512).strip(b"\0"):
            return
        raw.seek(offset)
        with tarfile.open(fileobj=raw, mode="r|") as bundle:
            for member in bundle:
                if wanted(member.name):
                    yield member.name, bundle.extractfile(member).read()


def path_columns(path: str) -> dict[str, str]:
    folder, _, name = path.rpartition("/")
    return {"path": path, "name": name, "folder": folder.rpartition("/")[2]}


TESTS: dict[type, Callable[[Filter], Callable[[str], bool]]] = {
    EqualTo: lambda f: lambda v: v == f.value,
    In: lambda f: lambda v: v in f.value,
    StringStartsWith: lambda f: lambda v: v.startswith(f.value),
    StringEndsWith: lambda f: lambda v: v.endswith(f.value),
    IsNotNull: lambda f: lambda v: True,
}


class Pushed:
    """Filters that a reader evaluates itself: (column, kind and value) on its own text columns."""

    def __init__(self, columns: Iterable[str]):
        self.columns, self.filters = set(columns), []

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if type(f) in TESTS and len(f.attribute) == 1 else None
            if column in self.columns:
                self.filters.append(f)
            else:
                yield f

    def keep(self) -> Callable[[dict[str, str]], bool]:
        tests = [(f.attribute[0], TESTS[type(f)](f)) for f in self.filters]
        return lambda row: all(test(row[column]) for column, test in tests)


class TakesFilters:
    """What a reader with `pushed` does with the filters of a plan: it evaluates those it knows and returns the others."""

    pushed: Pushed

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.pushed.take(filters))


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 100
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class DocumentReader(DataSourceReader):
    """Documents of plain files and of committed bundles."""

    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.pushed = Pushed(["path", "name", "folder"])

    def choice(self) -> Callable[[str], bool]:
        keep, named = self.pushed.keep(), re.compile(fnmatch.translate(self.pattern)).match

        def wanted(path: str) -> bool:
            row = path_columns(path)
            return named(row["name"]) is not None and keep(row)

        return wanted

    def partitions(self) -> list[InputPartition]:
        committed = committed_bundles(self.root)
        groups, size, wanted = [[]], 0, self.choice()
        for info in listed(self.root):
            if info.base_name in committed if info.base_name.endswith(BUNDLE) else wanted(info.path):
                if groups[-1] and size + info.size > self.most:
                    groups.append([])
                    size = 0
                groups[-1].append(info.path)
                size += info.size
        return [Files(g) for g in groups]

    def documents(self, paths: list[str]) -> Iterator[tuple[str, str, str, str]]:
        system, _ = opened(self.root)
        wanted = self.choice()
        for path in paths:
            if path.endswith(BUNDLE):
                for name, data in members(system, path, wanted):
                    yield (*path_columns(name).values(), data.decode())
            else:
                with system.open_input_stream(path) as stream:
                    yield (*path_columns(path).values(), stream.read().decode())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("path", "name", "folder", "text")])
        return in_batches(self.documents(partition.paths), schema)


class FilteringDocumentReader(TakesFilters, DocumentReader):
    pass


@dataclass
class Bundles(WriterCommitMessage):
    names: list[str]
    documents: int


class DocumentWriter(DataSourceArrowWriter):
    """Rows (path, text) as members of bundles; a commit of its own id lists them."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.commit_id = options.get("commit_id") or uuid.uuid4().hex
        self.most = int(options.get("bundle_bytes", BUNDLE_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Bundles:
        system, root = opened(self.root)
        system.create_dir(root, recursive=True)
        names, n, stream, size = [], 0, None, 0
        try:
            for batch in batches:
                for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                    if stream is None or size >= self.most:
                        if stream is not None:
                            stream.write(BUNDLE_END)
                            stream.close()
                        names.append(f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{BUNDLE}")
                        stream, size = system.open_output_stream(f"{root}/{names[-1]}"), 0
                    data = (text or "").encode()
                    stream.write(b"%b%b%b" % (member_header(path, len(data)), data, b"\0" * (-len(data) % 512)))
                    size += len(data) + 1024
                    n += 1
        finally:
            if stream is not None:
                stream.write(BUNDLE_END)
                stream.close()
        return Bundles(names, n)

    def commit(self, messages: list[Bundles]) -> None:
        """A commit appears as a whole, by a rename. The first one of an id counts; what a repetition wrote goes."""
        system, root = opened(self.root)
        names, target = [n for m in messages for n in m.names], f"{root}/{COMMITS}/{self.commit_id}.json"
        if system.get_file_info(target).type == fs.FileType.File:
            self.abort(messages)
            return
        system.create_dir(f"{root}/{COMMITS}", recursive=True)
        draft = f"{target}.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as stream:
            stream.write(json.dumps({"bundles": names, "documents": sum(m.documents for m in messages)}).encode())
        system.move(draft, target)

    def abort(self, messages: list[Bundles | None]) -> None:
        system, root = opened(self.root)
        for message in messages:
            for name in message.names if message else ():
                system.delete_file(f"{root}/{name}")


class TelemetryDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetry_documents"

    def schema(self) -> str:
        return DOCUMENT_SCHEMA

    def reader(self, schema) -> DocumentReader:
        return (FilteringDocumentReader if self.options.get("pushdown") == "true" else DocumentReader)(self.options)

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if overwrite:
            raise ValueError("telemetry_documents only appends")
        return DocumentWriter(self.options)


class LogReader(DataSourceReader):
    """Records of log files, cut into byte ranges."""

    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.pushed = Pushed(["path", "level", "file"])

    def partitions(self) -> list[InputPartition]:
        files = [f for f in listed(self.root) if fnmatch.fnmatchcase(f.base_name, self.pattern) and f.size]
        return [ByteRange(f.path, start, min(start + self.most, f.size)) for f in files for start in range(0, f.size, self.most)] or [ByteRange("", 0, 0)]

    def records(self, part: ByteRange) -> Iterator[tuple[int, re.Match | None, list[bytes]]]:
        """(offset, head, further lines) of the records that begin in the range; lines before the first head of a file are one without a head."""
        system, _ = opened(self.root)
        with system.open_input_file(part.path) as raw:
            raw.seek(max(part.start - 1, 0))
            stream = io.BufferedReader(pa.PythonFile(raw, mode="r"), 1 << 20)
            offset = part.start
            if part.start:  # the line that crosses the start, or ends right before it, is another range's
                offset += len(stream.readline()) - 1
            found = None if part.start else (0, None, [])
            for line in stream:
                head = LOG_HEAD.match(line)
                if head:
                    if found and (found[1] or found[2]):
                        yield found
                    found = None
                    if offset >= part.end:
                        break
                    found = (offset, head, [])
                elif found:
                    found[2].append(line)
                elif offset >= part.end:
                    break
                offset += len(line)
            if found and (found[1] or found[2]):
                yield found

    def rows(self, part: ByteRange) -> Iterator[tuple]:
        keep = self.pushed.keep()
        for offset, head, more in self.records(part):
            time, file, line_no, level, first = head.groups() if head else (None, None, None, None, b"")
            texts = {"path": part.path, "level": level.decode() if head else None, "file": file.decode() if head else None}
            if (head or not self.pushed.filters) and keep(texts):
                message = (first + b"".join(more)).decode(errors="replace")
                yield (part.path, offset, time.decode() if head else None, texts["file"], int(line_no) if head else None, texts["level"], message.removesuffix("\n"))

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
        return in_batches(self.rows(partition), pa.schema(list(zip(names, types)))) if partition.path else iter(())


class FilteringLogReader(TakesFilters, LogReader):
    pass


class TelemetryLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetry_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> LogReader:
        return (FilteringLogReader if self.options.get("pushdown") == "true" else LogReader)(self.options)


def register_sources(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets readers that ask for it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    for source in (TelemetryDocuments, TelemetryLog):
        spark.dataSource.register(source)


def read_documents(spark: SparkSession, path: str, pattern: str = "*", pushdown: bool = False, **options: str) -> DataFrame:
    register_sources(spark)
    return spark.read.format("telemetry_documents").options(pattern=pattern, pushdown=pushdown, **options).load(path)


def read_log(spark: SparkSession, path: str, pattern: str = "*", pushdown: bool = False, **options: str) -> DataFrame:
    register_sources(spark)
    return spark.read.format("telemetry_log").options(pattern=pattern, pushdown=pushdown, **options).load(path)


def append_documents(documents: DataFrame, path: str, commit_id: str | None = None, **options: str) -> None:
    """Appends (path, text) rows; one with the same `commit_id` adds nothing a second time, and does not make its rows again."""
    register_sources(documents.sparkSession)
    if commit_id:
        system, root = opened(path)
        if system.get_file_info(f"{root}/{COMMITS}/{commit_id}.json").type == fs.FileType.File:
            return
        options["commit_id"] = commit_id
    documents.select("path", "text").write.format("telemetry_documents").mode("append").options(**options).save(path)
