"""Archives as a Spark data source: ``spark.read.format("byteplan-archive")`` and ``df.write``.

Partitions are byte ranges of archives; a task walks the frames before its range without reading their payloads, so
one large archive is decoded by many tasks. An archive of more than ``MOST_RANGES`` ranges is walked once, by the
driver. Option ``metadataOnly`` leaves payloads alone. The writer makes an archive for each ``shardBytes`` of payload
(it holds no more) and checks at the commit that every archive is there with all its entries; files of failed
attempts are removed. What was written stands in ``_written.json``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..kernels import containers
from ..kernels.errors import FormatError

#: Names of archive files in a folder; a file named directly may have any.
SUFFIX = ".archive"
#: Up to so many ranges, each task finds its own frames.
MOST_RANGES = 16
_SCHEMA = "path string, method string, original_size bigint, compressed_size bigint, content binary"


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def _archives(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [inner]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX))


@dataclass
class _Range(InputPartition):
    """Frames that begin within a range of a file, or those given."""

    file: str
    start: int
    stop: int
    entries: list[containers.Entry] | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bare = options["path"], options.get("metadataOnly", "false").lower() == "true"
        self.share = int(options.get("partitionBytes", 64 << 20))

    def partitions(self) -> list[_Range]:
        out = []
        system, _ = _open(self.path)
        for file in _archives(self.path):
            size = system.get_file_info(file).size
            if size <= MOST_RANGES * self.share:
                starts = range(0, max(size, 1), self.share)
                out += [_Range(file, at, at + self.share if at + self.share < size else size + 1) for at in starts]  # an empty last payload begins at the end
                continue
            with system.open_input_file(file) as f:
                entries, _ = _index(f)
            group, at = [], 0
            for e in entries:
                group.append(e)
                if e.offset + e.compressed_size - at >= self.share:
                    out.append(_Range(file, 0, size, group))
                    group, at = [], e.offset + e.compressed_size
            if group:
                out.append(_Range(file, 0, size, group))
        return out

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # no archives
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as f:
            # The walk ends with this task's range; that of the last range checks the whole file.
            entries, dictionary = _index(f, partition.stop) if partition.entries is None else (partition.entries, _head(f)[1])
            for e in entries:
                if partition.entries is None and not partition.start <= e.offset < partition.stop:
                    continue
                content = None
                if not self.bare:
                    f.seek(e.offset)
                    content = containers.decode_entry(e.method, f.read(e.compressed_size), dictionary)
                    if len(content) != e.original_size:
                        raise FormatError("LENGTH_MISMATCH", e.path)
                yield e.path, e.method, e.original_size, e.compressed_size, content


def _head(f) -> tuple[int, dict[bytes, bytes], int]:
    """Count, dictionary and length of the header of an open file."""
    f.seek(0)
    head = f.read(10)
    if len(head) == 10 and head[5] & containers.HAS_DICTIONARY:
        size = f.read(4)
        head += size + f.read(int.from_bytes(size, "little"))
    return *containers.read_header(containers.Reader(head, error="TOO_SHORT")), len(head)


def _index(f, stop: int | None = None) -> tuple[list[containers.Entry], dict[bytes, bytes]]:
    """Entries and dictionary from an open file, by seeking over payloads; those whose payload begins before ``stop``."""
    count, dictionary, at = _head(f)
    out, end = [], f.size()
    stop = end if stop is None else stop
    for _ in range(count):
        f.seek(at)
        n = int.from_bytes(f.read(2), "little")
        frame = containers.Reader(f.read(n + 13), error="TOO_SHORT")
        path, method = frame.take(n).decode(), containers.METHOD_NAMES.get(frame.number("B"))
        if method is None:
            raise FormatError("BAD_METHOD")
        out.append(containers.Entry(path, method, frame.number("Q"), frame.number("I"), at + n + 15))
        at = out[-1].offset + out[-1].compressed_size
        if at > end:
            raise FormatError("TOO_SHORT")
        if out[-1].offset >= stop and stop < end:
            return out, dictionary
    if at != end:
        raise FormatError("COUNT_MISMATCH")
    return out, dictionary


@dataclass
class _Written(WriterCommitMessage):
    """(file, entries, bytes, original size) of each archive of a task."""

    files: list[tuple[str, int, int, int]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.path, self.force = options["path"], options.get("forcePrograms", "false").lower() == "true"
        self.shard, self.overwrite = int(options.get("shardBytes", 128 << 20)), overwrite

    def write(self, iterator: Iterator) -> _Written:
        system, inner = _open(self.path)
        system.create_dir(inner, recursive=True)
        done, frames, held = [], [], 0

        def close() -> None:
            file = f"{inner.rstrip('/')}/part-{uuid.uuid4().hex}{SUFFIX}"
            data = containers.write_archive(frames)
            done.append((file, len(frames), len(data), sum(n for _, _, n, _ in frames)))
            with system.open_output_stream(file) as f:
                f.write(data)

        try:
            for row in iterator:
                data = bytes(row["content"])
                method, payload = containers.encode_entry(data, force_programs=self.force)
                frames.append((row["path"], method, len(data), payload))
                held += len(payload)
                if held >= self.shard:
                    close()
                    frames, held = [], 0
            if frames:
                close()
        except BaseException:
            _remove(system, [f for f, *_ in done])
            raise
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inner = _open(self.path)
        files = [f for m in messages if m for f in m.files]
        for file, entries, size, _ in files:
            info = system.get_file_info(file)
            with system.open_input_file(file) as f:
                if info.size != size or _head(f)[0] != entries:
                    raise FormatError("COUNT_MISMATCH", file)
        if self.overwrite:
            _remove(system, sorted(set(_archives(self.path)) - {f for f, *_ in files}))
        total = {"archives": len(files), **{k: sum(f[i] for f in files) for i, k in ((1, "entries"), (2, "size"), (3, "original_size"))}}
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner.rstrip('/')}/_written.json") as f:
            f.write(json.dumps(total).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        _remove(_open(self.path)[0], [f for m in messages if m for f, *_ in m.files])


def _remove(system, files: list[str]) -> None:
    for file in files:
        try:
            system.delete_file(file)
        except FileNotFoundError:
            pass


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byteplan-archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    from .files import BlobSource, ProgramSource, SnapshotSource

    for source in (ArchiveSource, BlobSource, ProgramSource, SnapshotSource):
        spark.dataSource.register(source)


def write_files(archives: DataFrame, path: str) -> None:
    """Write (first_path, n, data) rows as files under ``path``, from the executors; it must be a shared folder."""
    system, inner = _open(path)
    system.create_dir(inner, recursive=True)

    def save(rows: Iterator) -> Iterator[tuple[int]]:
        target, folder = _open(path)
        for row in rows:
            name = f"{folder.rstrip('/')}/part-{uuid.uuid5(uuid.NAMESPACE_URL, row['first_path']).hex}{SUFFIX}"
            with target.open_output_stream(f"{name}.tmp-{os.getpid()}") as f:
                f.write(bytes(row["data"]))
            target.move(f"{name}.tmp-{os.getpid()}", name)  # a task that runs again writes the same file
        return iter(())

    archives.foreachPartition(save)


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Write (path, content) rows as files under a shared folder, from the executors; unsafe paths are errors."""

    def save(rows: Iterator) -> Iterator[tuple[int]]:
        target, folder = _open(path)
        for row in rows:
            name = f"{folder.rstrip('/')}/{containers.safe_path(row['path'])}"
            target.create_dir(os.path.dirname(name), recursive=True)
            with target.open_output_stream(f"{name}.tmp-{os.getpid()}") as f:
                f.write(bytes(row["content"]))
            target.move(f"{name}.tmp-{os.getpid()}", name)
        return iter(())

    blobs.select("path", "content").foreachPartition(save)
