"""Reading and writing the containers through Spark."""

from .archive import ArchiveSource, register, write_files
from .files import BlobSource, ProgramSource, SnapshotSource

__all__ = ["ArchiveSource", "BlobSource", "ProgramSource", "SnapshotSource", "register", "write_files"]
