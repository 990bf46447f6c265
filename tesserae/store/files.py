"""Files on any Hadoop file system, made visible whole or not at all."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """A folder. `publish` never overwrites: who comes second gets FileExistsError."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(path)) if not n.startswith("."))

    def numbers(self, folder: str, suffix: str = "") -> list[int]:
        found = (n.removesuffix(suffix) for n in self.names(folder) if n.endswith(suffix))
        return sorted(int(n) for n in found if n.isdigit())

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def read_json(self, name: str) -> Any:
        return json.loads(self.read(name).decode())

    def _write(self, name: str, data: bytes) -> None:
        out = self._fs.create(self._path(name), False)
        out.write(bytearray(data))
        out.close()

    def publish(self, name: str, data: bytes) -> None:
        """The file appears with all its bytes. Local files are written aside and linked, those of HDFS renamed without overwriting; other
        stores show an object only when its stream is closed."""
        if self.exists(name):
            raise FileExistsError(name)
        scheme = self._fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            try:
                return self._write(name, data)
            except Exception as e:
                raise FileExistsError(name) from e
        folder, _, last = name.rpartition("/")
        aside = f"{folder}/.{last}.{uuid.uuid4().hex}".lstrip("/")
        self._write(aside, data)
        try:
            if scheme == "file":
                local = lambda n: self._jvm.java.io.File(self._path(n).toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(name), local(aside))
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(aside), self._path(name), none)
        except Exception as e:
            if self.exists(name):
                raise FileExistsError(name) from e
            raise
        finally:
            self.delete(aside)

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(name), self._path(to)):
            raise FileNotFoundError(name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
