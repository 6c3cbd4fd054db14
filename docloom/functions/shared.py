"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir where the session names one; only where that is unset (tests, a
    laptop) a temporary folder is made and kept in the session's own setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.docloom.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.docloom.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)  # only what is there can be marked
    store.deleteOnExit(place)
    return f"{path}/table"


def write_shared(df: DataFrame, name: str = "tables", compression: str | None = None, waves: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, outlives executors. compression: Spark's choice if None.

    waves: the most files for each core of the cluster, where there would be one for each partition."""
    path = new_path(df.sparkSession, name)
    if waves is not None:
        df = df.coalesce(max(4, waves * df.sparkSession.sparkContext.defaultParallelism))
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame, *by: str | Column) -> DataFrame:
    """Short rows dealt out by columns before long work on them: four parts for each core, however few files or row groups they come from."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
