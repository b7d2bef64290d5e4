"""Tables in the folder that all executors share, for plans whose lineage has to be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a table for each core under which it is dealt out anew.
SPLIT_BYTES = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a local folder if it runs on this machine alone, as in tests, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, **options: object) -> DataFrame:
    """``df`` written to the shared folder and read back; the path is kept on the frame for ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._seqloom_path = path  # noqa: SLF001
    return back


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)  # noqa: SLF001


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_seqloom_path", None):
            delete(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it is so small that its splits would not keep them busy; a larger table stays as it is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # noqa: SLF001
    return df.repartition(4 * cores) if size < cores * SPLIT_BYTES else df
