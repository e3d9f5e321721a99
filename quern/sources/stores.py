"""The little that readers and writers of binary files ask of a file system, in tasks and at the commit.

A store is found by the path: POSIX paths and file: URIs, or what Arrow's file systems open (s3, gs, abfs, hdfs). Any other
one is named as ``module:callable``, which tasks import and call with the path of the folder.
"""

from __future__ import annotations

import importlib
import shutil
from pathlib import Path
from typing import BinaryIO, Protocol
from urllib.parse import unquote, urlparse


class Store(Protocol):
    """Paths are whole paths as the user writes them; folders come about as they are needed."""

    def create(self, path: str) -> BinaryIO: ...

    def open(self, path: str) -> BinaryIO: ...

    def rename(self, old: str, new: str) -> None: ...

    def delete_folder(self, path: str) -> None: ...


class LocalStore:
    """A folder that all executors mount."""

    @staticmethod
    def _plain(path: str) -> Path:
        return Path(unquote(urlparse(path).path) if path.startswith("file:") else path)

    def create(self, path: str) -> BinaryIO:
        plain = self._plain(path)
        plain.parent.mkdir(parents=True, exist_ok=True)
        return plain.open("wb")

    def open(self, path: str) -> BinaryIO:
        return self._plain(path).open("rb")

    def rename(self, old: str, new: str) -> None:
        self._plain(new).parent.mkdir(parents=True, exist_ok=True)
        self._plain(old).replace(self._plain(new))

    def delete_folder(self, path: str) -> None:
        if self._plain(path).exists():
            shutil.rmtree(self._plain(path))


class ArrowStore:
    """Object stores and other file systems that Arrow opens; a rename is a copy where a store knows no renames."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.system, _ = fs.FileSystem.from_uri(folder)

    @staticmethod
    def _plain(path: str) -> str:
        parts = urlparse(path)
        return f"{parts.netloc}{parts.path}".rstrip("/")

    def create(self, path: str) -> BinaryIO:
        self.system.create_dir(self._plain(path).rpartition("/")[0])
        return self.system.open_output_stream(self._plain(path))

    def open(self, path: str) -> BinaryIO:
        return self.system.open_input_file(self._plain(path))

    def rename(self, old: str, new: str) -> None:
        self.system.move(self._plain(old), self._plain(new))

    def delete_folder(self, path: str) -> None:
        from pyarrow import fs

        if self.system.get_file_info(self._plain(path)).type == fs.FileType.Directory:
            self.system.delete_dir(self._plain(path))


def store_of(folder: str, named: str | None = None) -> Store:
    if named:
        module, _, name = named.partition(":")
        return getattr(importlib.import_module(module), name)(folder)
    return LocalStore() if "://" not in folder or folder.startswith("file:") else ArrowStore(folder)
