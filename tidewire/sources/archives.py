"""Zip archives of text lines as a data source: ``zip_lines``, for batches, streams and writing.

Archives are listed and their directories read when a scan is planned; a member is the unit of work. Small
members share a task up to ``partitionBytes``, a large one has its own, and a task reads only its members' bytes and
hands lines on in blocks. No archive or member is ever one value.

Options: ``path``; ``glob`` of file names (``*.zip``); ``members`` (``all``, or ``first`` of every archive);
``partitionBytes``; ``settleSeconds``, how long a file must have been there before a stream takes it. Paths are local, or
addresses of a store that Arrow's file systems know.

A stream takes files in the order of their modification time, then path. A file that appears with a time before one that was
taken is not seen, so files should be landed by a move into the folder that renews it.

Written rows are ``archive, member, line``, sorted by both within a task, and an archive is written by one task (see
:func:`write_zips`). Archives become visible when all tasks have ended; a failed job leaves none.
"""

from __future__ import annotations

import io
import sys
import time
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from posixpath import basename, dirname, join

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

# Workers get these classes themselves, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

READ = pa.schema([("path", pa.string()), ("member", pa.string()), ("line", pa.string())])
WRITTEN = "archive string, member string, line string"
BLOCK = 8 << 20
#: Bytes of an archive without members: its end record alone.
EMPTY = 22


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Members(InputPartition):
    """(archive, member) that one task reads."""

    listed: tuple[tuple[str, str], ...]


@dataclass
class Written(WriterCommitMessage):
    archives: tuple[str, ...]


class _Scan:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.glob = options.get("glob", "*.zip")
        self.first_only = options.get("members", "all") == "first"
        self.target = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.settle = float(options.get("settleseconds", options.get("settleSeconds", 0)))

    def files(self) -> list[tuple[int, str]]:
        """(modification time in nanoseconds, path) of every archive, in that order."""
        system, root = _located(self.path)
        one = system.get_file_info(root)
        found = [one] if one.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda p: any(part[:1] in "._" for part in p[len(root) :].split("/") if part)
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and fnmatch(f.base_name, self.glob) and not hidden(f.path))

    def planned(self, paths: list[str]) -> list[Members]:
        system, _ = _located(self.path)

        def listed(path: str) -> list[tuple[str, str, int]]:
            with system.open_input_file(path) as file:
                if file.size() == EMPTY:
                    return []
                with zipfile.ZipFile(file) as archive:
                    inside = [(path, i.filename, i.compress_size) for i in archive.infolist() if not i.is_dir()]
            return inside[:1] if self.first_only else inside

        out: list[Members] = []
        held: list[tuple[str, str]] = []
        size = 0
        with ThreadPoolExecutor(16) as pool:
            for path, member, n in (m for members in pool.map(listed, paths) for m in members):
                if held and size + n > self.target:
                    out.append(Members(tuple(held)))
                    held, size = [], 0
                held.append((path, member))
                size += n
        return [*out, Members(tuple(held))] if held else out

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        """Lines of the members; a scan without any is given none to read."""
        system, _ = _located(self.path)
        for path, member in partition.listed if partition else ():
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive, archive.open(member) as data:
                text = io.TextIOWrapper(data, encoding="utf-8", errors="replace", newline="\n")
                while lines := text.readlines(BLOCK):
                    stripped = [line.rstrip("\r\n") for line in lines]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(lines)), pa.array([member] * len(lines)), pa.array(stripped)], schema=READ
                    )


class _Batch(_Scan, DataSourceReader):
    def partitions(self) -> list[Members]:
        return self.planned([path for _, path in self.files()])


class _Stream(_Scan, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        settled = [f for f in self.files() if not self.settle or f[0] <= until]
        return {"time": str(settled[-1][0]), "path": settled[-1][1]} if settled else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Members]:
        after, until = ((int(o["time"]), o["path"]) for o in (start, end))
        return self.planned([f[1] for f in self.files() if after < f <= until])

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that were done."""


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.run = options["path"], uuid.uuid4().hex

    def _waiting(self, root: str) -> str:
        return join(root, f"_writing-{self.run}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _located(self.path)
        folder = join(self._waiting(root), uuid.uuid4().hex)
        done: list[str] = []
        now: tuple[str | None, str | None] = (None, None)
        file = archive = member = None
        try:
            for batch in iterator:
                names = zip(*(batch.column(i).to_pylist() for i in range(2)))
                for place, line in zip(names, batch.column(2).to_pylist()):
                    if place != now:
                        if member:
                            member.close()
                        if place[0] != now[0]:
                            if archive:
                                archive.close()
                                file.close()
                            done.append(join(folder, place[0] + ".zip"))
                            system.create_dir(dirname(done[-1]), recursive=True)
                            file = system.open_output_stream(done[-1])
                            archive = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                        member = archive.open(place[1], "w", force_zip64=True)
                        now = place
                    member.write((line or "").encode() + b"\n")
        finally:
            for part in (member, archive, file):
                if part:
                    part.close()
        if len(set(done)) != len(done):
            raise ValueError("rows must be sorted by archive within a task")
        return Written(tuple(done))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _located(self.path)
        ready = [a for m in messages if m for a in m.archives]
        if len({basename(a) for a in ready}) != len(ready):
            self.abort(messages)
            raise ValueError("an archive must be written by one task")
        for archive in ready:
            system.move(archive, join(root, basename(archive)))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _located(self.path)
        if system.get_file_info(self._waiting(root)).type != fs.FileType.NotFound:
            system.delete_dir(self._waiting(root))


class ZipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "path string, member string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are added; overwriting is not supported")
        return _Writer(dict(self.options))


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, member and line of all archives under ``path``."""
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").options(**options).load(path)


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same of archives as they arrive, each once."""
    spark.dataSource.register(ZipLines)
    return spark.readStream.format("zip_lines").options(**options).load(path)


def write_zips(lines: DataFrame, path: str) -> None:
    """Adds archives ``<archive>.zip`` with the members and lines of ``lines(archive, member, line)``.

    An archive is one task's, so its size is what one task writes; lines of a member are in no stated order.
    """
    lines.sparkSession.dataSource.register(ZipLines)
    rows = lines.select(*[F.col(c).cast("string").alias(c) for c in ("archive", "member", "line")])
    rows.repartition("archive").sortWithinPartitions("archive", "member").write.format("zip_lines").mode("append").save(path)
