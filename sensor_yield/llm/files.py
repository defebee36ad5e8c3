"""Binary files in a store that all executors share, opened by URI inside tasks."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system behind a URI (file, hdfs, s3, gs, ...) and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), os.path.abspath(uri)


class AtomicWriter:
    """Writes under a name of its own attempt and takes the final name when complete, so a
    task that is run again, or twice at once, leaves one whole file."""

    def __init__(self, uri: str, attempt: int):
        self.fs, self.path = resolve(uri)
        self.partial = f"{self.path}.{attempt}.partial"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.partial, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        self.out.flush()

    def seekable(self) -> bool:
        return False

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.partial, self.path)


class RangeReader:
    """Reads byte ranges of one file."""

    def __init__(self, uri: str):
        filesystem, path = resolve(uri)
        self.file = filesystem.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise ValueError(f"range {start}+{length} outside a file of {self.size} bytes")
        return self.file.read_at(length, start)

    def close(self) -> None:
        self.file.close()


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Strings of an Arrow column as UTF-8; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
