"""Tables between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []
_open: list[Scratch] = []


def mark() -> int:
    """A mark for `sweep`: the number of calls whose tables are still there."""
    return len(_open)


def sweep(since: int) -> None:
    """Remove the tables of all calls since a mark, once nothing reads them any more: their results are lazy, so only
    the caller knows when that is."""
    for s in _open[since:]:
        s.remove(s.root)
    del _open[since:]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one given to the context; where there is none and all runs in one
    process (tests), a temporary one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="graphloom-"))
        atexit.register(_remove_local, _own[0])
    return "file://" + _own[0]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Written tables of one operator call.  `drop` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _open.append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write df as Parquet and read it back: lineage ends here and survives lost executors."""
        path = self.path(name)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def settle(self) -> None:
        """Have the driver collect its garbage now: its heap shrinks to what is in use, and Spark removes shuffles and
        broadcasts of steps that are over only when their objects are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._scratch_path)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
