"""Small files of a tree on any file system that Spark reaches, by its Hadoop path.

A path without a scheme belongs to the session's default file system, as it does for ``spark.read``.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self._jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
        self._base = self._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
        self._fs = self._base.getFileSystem(conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._base, name) if name else self._base

    def uri(self, name: str = "") -> str:
        """The full address of a file or folder."""
        return self._fs.makeQualified(self._path(name)).toString()

    def names(self, name: str = "") -> list[str]:
        """What a folder holds, in order; nothing if there is none."""
        try:
            return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))
        except Py4JJavaError as e:
            if "FileNotFoundException" in e.java_exception.getClass().getName():
                return []
            raise

    def read(self, name: str) -> str | None:
        """The text of a file, decoded leniently; None if there is none."""
        path = self._path(name)
        if not self._fs.exists(path) or self._fs.getFileStatus(path).isDirectory():
            return None
        stream = self._fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
