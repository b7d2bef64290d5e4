"""Shared-folder tables, Arrow plumbing and table reading used by the llm operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at once; bounds the numpy temporaries.
SLAB_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests) a local folder is set; a cluster without one is an error, since
    what executors write to their own disks nobody else reads.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors cost nothing.

    The path is kept on the returned frame so that ``discard`` can delete it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._seqloom_path = path  # noqa: SLF001
    return back


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)  # noqa: SLF001


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)  # noqa: SLF001


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``materialise`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_seqloom_path", None)
        if path:
            delete(df.sparkSession, path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slabs(batch: pa.RecordBatch, text: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    import numpy as np

    if not batch.num_rows:
        return
    sizes = batch.column(batch.schema.get_field_index(text))
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def clean_name(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that extra columns of any name cannot clash with working ones."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])
