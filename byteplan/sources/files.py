"""Files that hold one thing each as data sources: blobs, program files and dictionary snapshots.

``spark.read.format("byteplan-blob" | "byteplan-program" | "byteplan-snapshot")`` gives a row for each file under a
folder with the format's suffix (a file named directly may have any), and ``df.write`` makes a file for each row of
(path, content). A file that cannot be read is an error. Files written twice, by a task that runs again, are the same.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..kernels import containers
from .archive import _open, _remove


@dataclass
class _Files(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, source: type[_Source], options: dict) -> None:
        self.source, self.path, self.share = source, options["path"], int(options.get("partitionBytes", 64 << 20))

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, inner = _open(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [_Files([inner])]
        out, group, size = [], [], 0
        for f in sorted(system.get_file_info(fs.FileSelector(inner, recursive=True)), key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.endswith(self.source.suffix):
                group.append(f.path)
                size += f.size
                if size >= self.share:
                    out.append(_Files(group))
                    group, size = [], 0
        return [*out, _Files(group)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, inner = _open(self.path)
        for name in partition.names:
            relative = name[len(inner.rstrip("/")) + 1 :] or os.path.basename(name)
            with system.open_input_stream(name) as f:
                yield relative.removesuffix(self.source.suffix), *self.source.parse(f.read())


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Refuses unsafe paths, and content that is not what the format holds."""

    def __init__(self, source: type[_Source], options: dict) -> None:
        self.source, self.path = source, options["path"]

    def write(self, iterator: Iterator) -> _Written:
        system, inner = _open(self.path)
        names = []
        for row in iterator:
            name = f"{inner.rstrip('/')}/{containers.safe_path(row['path'])}{self.source.suffix}"
            data = self.source.make(bytes(row["content"]))
            system.create_dir(os.path.dirname(name), recursive=True)
            with system.open_output_stream(f"{name}.tmp-{os.getpid()}") as f:
                f.write(data)
            system.move(f"{name}.tmp-{os.getpid()}", name)
            names.append(name)
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        pass

    def abort(self, messages: list[_Written | None]) -> None:
        _remove(_open(self.path)[0], [name for m in messages if m for name in m.names])


class _Source(DataSource):
    format = suffix = columns = ""

    @classmethod
    def name(cls) -> str:
        return cls.format

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return _Reader(type(self), self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a folder of files is only added to")
        return _Writer(type(self), self.options)

    @staticmethod
    def parse(data: bytes) -> tuple:
        raise NotImplementedError

    @staticmethod
    def make(content: bytes) -> bytes:
        raise NotImplementedError


class BlobSource(_Source):
    """Blobs; ``content`` is what they hold, written as the shortest program found."""

    format, suffix = "byteplan-blob", ".blob"
    columns = "path string, content binary, length bigint, stored_size bigint"

    @staticmethod
    def parse(data: bytes) -> tuple:
        content = containers.decode_blob(data)
        return content, len(content), len(data)

    @staticmethod
    def make(content: bytes) -> bytes:
        return containers.encode_blob(content)


class ProgramSource(_Source):
    """Program files; ``content`` is the file itself, to be run by ``operators.snapshots.run_program_files``."""

    format, suffix = "byteplan-program", ".program"
    columns = "path string, content binary, source string, snapshot string, urls array<string>, program binary, n_macros int, n_patterns int"

    @staticmethod
    def parse(data: bytes) -> tuple:
        p = containers.ProgramFile.decode(data)
        return data, p.source, p.snapshot and p.snapshot.hex(), p.urls, p.program, len(p.macros), len(p.dictionary)

    @staticmethod
    def make(content: bytes) -> bytes:
        containers.ProgramFile.decode(content)
        return content


class SnapshotSource(_Source):
    """Snapshots; ``content`` is the file itself, for ``operators.snapshots.snapshot_table``. Seals are checked."""

    format, suffix = "byteplan-snapshot", ".snapshot"
    columns = "path string, content binary, hash string, domain string, version string, n_patterns int"

    @staticmethod
    def parse(data: bytes) -> tuple:
        s = containers.Snapshot.decode(data)
        return data, s.hash.hex(), s.domain, "%d.%d" % s.version, len(s.patterns)

    @staticmethod
    def make(content: bytes) -> bytes:
        containers.Snapshot.decode(content)
        return content
