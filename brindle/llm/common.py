"""What the operators share: the shared folder, tables kept in it, byte-level word tools."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where one machine does all."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if where := spark.sparkContext.getCheckpointDir():
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Kept:
    """A table written to the shared folder: it cuts lineage and survives lost executors. `by`: a folder for each value.

    It is deleted by drop(), at the end of passing(), or else when the driver ends.
    """

    _passing: list[list[Kept]] = []

    def __init__(self, df: DataFrame, label: str, by: list[str] | None = None, **options: str):
        self.spark = df.sparkSession
        for tables in Kept._passing:
            tables.append(self)
        self.path = f"{shared_dir(self.spark)}/brindle-{uuid.uuid4().hex}-{label}"
        writer = df.write.option("compression", "zstd").options(**options)
        (writer.partitionBy(*by) if by else writer).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        path, files = self._place()
        files.deleteOnExit(path)

    def _place(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        path, files = self._place()
        files.delete(path, True)

    @classmethod
    @contextmanager
    def passing(cls):
        """Tables kept inside are deleted at the end, but for those that the caller takes out of the list; of one passing()
        within another they go with the outer one."""
        cls._passing.append([])
        try:
            yield cls._passing[-1]
        finally:
            for one in cls._passing.pop():
                one.drop()


def keep(df: DataFrame, label: str) -> DataFrame:
    return Kept(df, label).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merged(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the table: it is met by shuffle, whatever size Spark takes the sides for.

    The size of a kept table is that of its compressed files, and an explode is taken to add no rows, so a broadcast can
    be a hundred times as large on the driver as was thought.
    """
    return df.hint("merge")


def one_row_each(docs: DataFrame, gone: DataFrame, several: DataFrame) -> DataFrame:
    """The documents but for those in gone, and one row of each in several; both have _id and _key, xxhash64 of the text.

    They are kept first, so that their sizes are known: documents are shuffled only where those that go are many.
    """
    same = lambda d: docs["doc_id"].eqNullSafe(d["_id"]) & (F.xxhash64(docs["text"]) == d["_key"])
    several = Kept(several.select("_id", "_key").distinct(), "several").df
    gone, again = gone.select("_id", "_key"), None
    if not several.isEmpty():
        # They all leave the first part, and one row of each makes the second.
        gone = gone.union(several)
        own = docs.join(several, same(several), "left_semi")
        whole = own.select(F.struct(*[own[c] for c in own.columns]).alias("_doc"), own["doc_id"].alias("_id"), F.xxhash64(own["text"]).alias("_key"))
        again = whole.dropDuplicates(["_id", "_key"]).select("_doc.*")  # whatever else the columns are called
    gone = Kept(gone.distinct(), "gone").df
    stay = docs.join(gone, same(gone), "left_anti")
    return stay.union(again) if again is not None else stay


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts (-1 for a null id): the held-out folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def raw(array: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


def slices(batches, text: str = "text", most: int = 8 << 20):
    """Arrow batches cut into runs of rows with at most about so many text bytes (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def process_cache() -> dict:
    """A dict for each Python process: functions come to workers by value, so their modules' own globals do not last."""
    import sys

    return sys.__dict__.setdefault("_brindle_cache", {})


def sent(spark: SparkSession, kind: str, value):
    """Broadcasts a value of this package's classes -> a function that gives it in a worker, which need not have the
    package. A process keeps one value of each kind."""
    import pickle

    from pyspark import cloudpickle

    holder, number = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def get():
        held = process_cache()
        if held.get(("sent", kind), (None,))[0] != number:
            held["sent", kind] = (number, pickle.loads(holder.value))
        return held["sent", kind][1]

    return get
