"""Small files and folders on any store that Spark reaches, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def fs(self, path: str):
        return self.path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self.fs(path).exists(self.path(path))

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs(path).listStatus(self.path(path)) if s.isDirectory())

    def make(self, path: str) -> None:
        self.fs(path).mkdirs(self.path(path))

    def move(self, old: str, new: str) -> None:
        if not self.fs(old).rename(self.path(old), self.path(new)):
            raise OSError(f"can't move {old} to {new}")

    def remove(self, path: str) -> None:
        self.fs(path).delete(self.path(path), True)

    def read(self, path: str) -> str:
        stream = self.fs(path).open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Whether the file was made; False where there is one."""
        try:
            self.write(path, text, overwrite=False)
            return True
        except Exception:
            if self.exists(path):
                return False
            raise

    def write(self, path: str, text: str, overwrite: bool = True) -> None:
        stream = self.fs(path).create(self.path(path), overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
