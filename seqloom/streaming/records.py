"""Running statistics over records and events that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.operators.minimizers import kmer_rows


def stream_table(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def kmer_counts(records: DataFrame, k: int) -> DataFrame:
    """Counts of k-mers so far, for a stream of ``(seq_id, seq)`` (output mode ``complete`` or ``update``)."""
    return kmer_rows(records, k).groupBy("kmer").agg(F.count("*").alias("n"))


def windowed_features(features: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Features by type and event-time window, with a watermark that bounds the state."""
    return features.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), "type").agg(F.count("*").alias("n"), F.sum("length").alias("total")).select("w.start", "w.end", "type", "n", "total")
