"""Small files by Hadoop's file systems, so a store can stand wherever Spark reads and writes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Text files and folders below one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def make_folder(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file; False if the name is taken. Durable when it returns, as far as the file system has that."""
        try:
            out = self.fs.create(self._path(name), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Write beside, then rename over it in one step."""
        beside = f"{name}.{uuid.uuid4().hex}"
        self.create(beside, text)
        self.move(beside, name)

    def move(self, src: str, dst: str) -> None:
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        how = self.jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.OVERWRITE.getClass(), 1)
        how[0] = fs.Options.Rename.OVERWRITE
        context.rename(self._path(src), self._path(dst), how)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
