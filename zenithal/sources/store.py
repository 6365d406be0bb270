"""Small files beside the tables: logs and schemas in whatever file system the warehouse lies in."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """Files by path, through Hadoop's file systems, so that every driver that sees the warehouse sees them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no folder."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def create(self, path: str, text: str = "") -> bool:
        """Write a file that is not there yet; false if it is."""
        p, fs = self._at(path)
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        file = fs.open(p)
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)
