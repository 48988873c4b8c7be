"""Plain files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

import pyarrow.fs as fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class NewFile:
    """A file that appears under its name only when it is complete. The name is new for each
    attempt, so an attempt that is repeated elsewhere never meets the files of a lost one."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.system, self.at = opened(self.path)
        self.system.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(f"{self.at}.part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends and returns the offset."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()
        self.system.move(f"{self.at}.part", self.at)
