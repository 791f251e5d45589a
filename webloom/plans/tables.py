"""Reading input tables and writing intermediate tables to shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read from fewer files than there are cores, dealt out to all; costly steps on its rows then run everywhere.

    Meant for rows as they are read, before they grow. A table of many files stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or len(df.inputFiles()) >= cores else df.repartition(cores)


#: Bytes of the rows that Spark sends to a Python worker at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of this session by ``BATCH_BYTES``, unless it has a bound of its own.

    Spark's own bound is 10,000 rows, however long their texts, and both the executor and the worker hold a whole batch.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spare(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened as long as ``df`` has columns of that name (case does not count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode, where one machine runs everything.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="webloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Stash:
    """Intermediate tables of one run, written as Parquet under the shared folder.

    A written table cuts lineage: a lost executor costs a re-read, not a recomputation. Results are read from these
    tables, so they stay as long as the driver runs; its file system removes them when it ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/webloom/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        if self.n == 1:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._webloom_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._webloom_path)  # type: ignore[attr-defined]
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def put_sorted(df: DataFrame, path: str, key: str, buckets: int) -> str:
    """Writes ``df`` under ``path``, hashed by ``key`` into buckets, each sorted by it. Nothing stays in the catalog."""
    spark, name = df.sparkSession, f"webloom_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    spark.sql(f"drop table {name}")  # its files are external and stay
    return path


def bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table of :func:`put_sorted`, in this session's catalog so that joins on the key need not move it."""
    name = f"webloom_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'")
    out = spark.table(name)
    out._webloom_name = name  # type: ignore[attr-defined]
    return out


def children(spark: SparkSession, folder: str) -> list[str]:
    """The names of the finished tables in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(path(s.getPath(), "_SUCCESS"))]


#: Bytes in memory of a table that may be broadcast, and what a row and a cell take there besides their text.
BROADCAST_BYTES = 64 << 20
ROW_BYTES, CELL_BYTES = 32, 8


def bounded(written: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if it is small as counted: its rows, cells, texts and numbers in arrays.

    Else, and if it has cells of other shapes, joins shuffle it.
    """
    sizes = []
    for f in written.schema:
        kind, name = f.dataType.typeName(), f"`{f.name}`"
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(name))
        elif kind == "array" and f.dataType.elementType.typeName() in ("byte", "short", "integer", "long", "float", "double"):
            sizes.append(F.greatest(F.size(name), F.lit(0)) * CELL_BYTES)
        elif kind in ("array", "map", "struct", "variant"):
            return written
    rows, *sums = written.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(s), F.lit(0)) for s in sizes)).first()
    size = rows * (ROW_BYTES + CELL_BYTES * len(written.columns)) + sum(sums)
    return F.broadcast(written) if size <= most else written
