"""Small files and folders on whatever file system a path names."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Hadoop's file systems from the driver: facts and folders, not data."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(str(path))
        return at.getFileSystem(self._conf), at

    def is_file(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isFile()

    def is_dir(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isDirectory()

    def names(self, path: str) -> list[str]:
        """Of what lies directly in a folder, sorted."""
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if self.is_dir(path) else []

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        except Py4JJavaError as e:
            raise ValueError(f"{path} can't be read: {e.java_exception}") from e
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, at = self._at(path)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def move(self, path: str, to: str) -> None:
        fs, at = self._at(path)
        if not fs.rename(at, self._at(to)[1]):
            raise OSError(f"{path} can't be moved to {to}")
