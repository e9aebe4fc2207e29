"""Files through Hadoop's file system interface, so tables can lie in any store that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self.path(name))

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes beside and renames over: readers see the old text or the new one."""
        beside = self.path(f"{name}.new")
        self.write(f"{name}.new", text)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.conf).rename(beside, self.path(name), how)

    def names(self, name: str = "") -> list[str]:
        if not self.fs.exists(self.path(name)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
