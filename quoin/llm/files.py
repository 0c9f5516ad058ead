"""Files of our own formats in the shared folder, from Python workers, by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, stem: str, data, suffix: str = "") -> str:
    """Write bytes under a name no other task attempt uses; the URI goes into a manifest, so what a
    lost attempt left behind is never read."""
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}.part") as f:
        f.write(data)
    system.move(f"{path}/{name}.part", f"{path}/{name}")
    return f"{folder.rstrip('/')}/{name}"


class RangeFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = _at(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(length, start)

    def close(self) -> None:
        self.file.close()
