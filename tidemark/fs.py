"""Files of the control plane: local paths directly, every other scheme through Hadoop's file systems."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import shutil
import tempfile
from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class FileStat:
    path: str
    size: int
    mtime_ns: int

    @property
    def mtime(self) -> float:
        return self.mtime_ns / 1e9


class LocalFs:
    def list(self, root: str, pattern: str, recursive: bool, exclude: tuple[str, ...] = ()) -> list[FileStat]:
        """The files below a folder that match a glob, sorted by path."""
        base = Path(root)
        if not base.is_dir():
            return []
        barred = [os.path.realpath(e) + os.sep for e in exclude]
        out = []
        for path in base.rglob(pattern) if recursive else base.glob(pattern):
            full = os.path.realpath(path)
            if any(full.startswith(b) for b in barred):
                continue
            try:
                stat = os.stat(full)
            except FileNotFoundError:  # removed since it was listed
                continue
            if path.is_file():
                out.append(FileStat(full, stat.st_size, stat.st_mtime_ns))
        return sorted(out, key=lambda f: f.path)

    def names(self, folder: str) -> list[str]:
        return sorted(os.listdir(folder)) if os.path.isdir(folder) else []

    def stat(self, path: str) -> FileStat | None:
        try:
            found = os.stat(path)
        except FileNotFoundError:
            return None
        return FileStat(path, found.st_size, found.st_mtime_ns)

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def is_dir(self, path: str) -> bool:
        return os.path.isdir(path)

    def mkdirs(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)

    def read(self, path: str) -> bytes:
        return Path(path).read_bytes()

    def write(self, path: str, data: bytes) -> None:
        """Write so that the file is either whole or not there, also after a crash."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, temp = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".tmp-")
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temp, path)
        self._sync_dir(os.path.dirname(path))

    def create(self, path: str, data: bytes) -> bool:
        """Write a file that must not exist; False if it does."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, temp = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".tmp-")
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(temp, path)  # fails if the name is taken, and never shows part of the file
        except FileExistsError:
            return False
        finally:
            os.unlink(temp)
        self._sync_dir(os.path.dirname(path))
        return True

    def rename(self, old: str, new: str) -> None:
        os.makedirs(os.path.dirname(new), exist_ok=True)
        os.rename(old, new)
        self._drop_checksum(old)
        self._drop_checksum(new)

    @staticmethod
    def _drop_checksum(path: str) -> None:
        """Hadoop's local checksum file, which speaks of what the name held before."""
        try:
            os.unlink(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
        except FileNotFoundError:
            pass

    def delete(self, path: str) -> bool:
        if os.path.isdir(path) and not os.path.islink(path):
            shutil.rmtree(path)
            return True
        self._drop_checksum(path)
        try:
            os.unlink(path)
        except FileNotFoundError:
            return False
        return True

    def _sync_dir(self, folder: str) -> None:
        try:
            handle = os.open(folder, os.O_RDONLY)
        except OSError:
            return
        try:
            os.fsync(handle)
        except OSError:
            pass
        finally:
            os.close(handle)


class HadoopFs:
    """The same over Hadoop's FileSystem; a rename is as atomic as that file system makes it."""

    def __init__(self, path: str):
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(path).getFileSystem(conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def list(self, root: str, pattern: str, recursive: bool, exclude: tuple[str, ...] = ()) -> list[FileStat]:
        if not self.fs.exists(self._path(root)):
            return []
        found, out = self.fs.listFiles(self._path(root), recursive or "/" in pattern), []
        base = self.fs.makeQualified(self._path(root)).toString().rstrip("/") + "/"
        barred = [self.fs.makeQualified(self._path(e)).toString().rstrip("/") + "/" for e in exclude]
        while found.hasNext():
            status = found.next()
            path = status.getPath().toString()
            name = path.rsplit("/", 1)[-1] if recursive else path.removeprefix(base)
            if fnmatch.fnmatchcase(name, pattern) and not any(path.startswith(b) for b in barred):
                out.append(FileStat(path, status.getLen(), status.getModificationTime() * 1_000_000))
        return sorted(out, key=lambda f: f.path)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def stat(self, path: str) -> FileStat | None:
        if not self.exists(path):
            return None
        status = self.fs.getFileStatus(self._path(path))
        return FileStat(path, status.getLen(), status.getModificationTime() * 1_000_000)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def is_dir(self, path: str) -> bool:
        return self.exists(path) and self.fs.getFileStatus(self._path(path)).isDirectory()

    def mkdirs(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _put(self, path: str, data: bytes) -> None:
        stream = self.fs.create(self._path(path), True)
        try:
            stream.write(data)
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        temp = f"{path}.tmp-{os.getpid()}"
        self._put(temp, data)
        if self.exists(path):
            self.fs.delete(self._path(path), False)
        self.fs.rename(self._path(temp), self._path(path))

    def create(self, path: str, data: bytes) -> bool:
        if self.exists(path):
            return False
        temp = f"{path}.tmp-{os.getpid()}"
        self._put(temp, data)
        done = self.fs.rename(self._path(temp), self._path(path))  # false if the name is taken
        if not done:
            self.fs.delete(self._path(temp), False)
        return bool(done)

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._path(new).getParent())
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"could not rename {old} to {new}")

    def delete(self, path: str) -> bool:
        return bool(self.fs.delete(self._path(path), True))


_local = LocalFs()


def local_path(path: Any) -> str:
    """A path without the file scheme."""
    return re.sub(r"^file:(//)?(?=/)", "", str(path))


def is_local(path: Any) -> bool:
    return "://" not in local_path(path) and not re.match(r"^[a-z][a-z0-9+.-]+:/", local_path(path))


def fs_for(path: Any) -> LocalFs | HadoopFs:
    return _local if is_local(path) else HadoopFs(str(path))


def read_json(fs, path: str) -> Any:
    return json.loads(fs.read(path)) if fs.exists(path) else None


def write_json(fs, path: str, payload: Any) -> None:
    fs.write(path, json.dumps(payload, indent=2, sort_keys=True).encode())


def escape_glob(path: str) -> str:
    """A path that Spark's readers take literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
