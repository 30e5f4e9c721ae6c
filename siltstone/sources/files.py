"""File operations of the driver, by Hadoop's file systems, so that a store may lie on any of them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from siltstone.model import StoreIOError


class Files:
    """Paths below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString()
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(name if "://" in name or name.startswith("file:/") else self.path(name))

    def _do(self, operation: str, name: str, f: object) -> object:
        try:
            return f(self._at(name))
        except Py4JJavaError as e:
            raise StoreIOError(operation, self.path(name), e.java_exception.toString()) from e

    def make(self, name: str) -> None:
        self._do("mkdir", name, self._fs.mkdirs)

    def exists(self, name: str) -> bool:
        return self._do("exists", name, self._fs.exists)

    def size(self, name: str) -> int:
        return self._do("size", name, lambda p: self._fs.getFileStatus(p).getLen())

    def remove(self, name: str) -> bool:
        """Delete a file or folder; a missing one is no error."""
        return self._do("remove", name, lambda p: self._fs.delete(p, True))

    def names(self, folder: str) -> Iterator[tuple[str, int, bool]]:
        """(name, bytes, whether a folder) of what lies in a folder."""
        if not self.exists(folder):
            return
        for s in self._do("list", folder, self._fs.listStatus):
            yield s.getPath().getName(), s.getLen(), s.isDirectory()

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self._do("status", name, lambda p: self._fs.getFileStatus(p).getModificationTime()) / 1000

    def write(self, name: str, data: bytes) -> None:
        """Write a file, or replace it."""

        def run(p: object) -> None:
            stream = self._fs.create(p, True)
            try:
                stream.write(bytearray(data))
            finally:
                stream.close()

        self._do("write", name, run)

    def read(self, name: str) -> bytes:
        def run(p: object) -> bytes:
            stream = self._fs.open(p)
            try:
                return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()

        return self._do("read", name, run)

    def write_new(self, name: str, data: bytes) -> bool:
        """Write a whole file unless there is one of that name: false then.  Readers see all of it or none."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"

        def run(p: object) -> None:
            stream = self._fs.create(p, False)
            try:
                stream.write(bytearray(data))
                stream.hsync()
            finally:
                stream.close()

        self._do("write", part, run)
        if self.exists(name):
            self.remove(part)
            return False
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            self._context.rename(self._at(part), self._at(name), options)
        except Py4JJavaError as e:
            self.remove(part)
            if self.exists(name):
                return False
            raise StoreIOError("rename", self.path(name), e.java_exception.toString()) from e
        return True

    def fetch(self, name: str, local: str) -> None:
        """Copy a file to the driver's disk."""
        self._do("fetch", name, lambda p: self._fs.copyToLocalFile(False, p, self._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True))

    def put(self, local: str, name: str) -> None:
        self._do("put", name, lambda p: self._fs.copyFromLocalFile(False, True, self._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), p))
