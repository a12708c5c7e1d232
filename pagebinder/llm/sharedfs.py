"""Binary files in a folder that all executors share, by pyarrow's file systems: local paths, hdfs:// and object stores."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Written:
    """A file that appears under its name only when it is whole; attempts of a task don't meet."""

    def __init__(self, uri: str):
        self.fs, self.path = opened(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.size = 0

    def __enter__(self) -> Written:
        self.out = self.fs.open_output_stream(self.temporary)
        return self

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)


class Ranges:
    """Reads ranges of a file."""

    def __init__(self, uri: str):
        of, path = opened(uri)
        self.size = of.get_file_info(path).size
        self.file = of.open_input_file(path)

    def __call__(self, at: int, length: int) -> bytes:
        data = self.file.read_at(length, at)
        if len(data) != length:
            raise EOFError(f"{length} bytes wanted at {at}, {len(data)} there")
        return data

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()
