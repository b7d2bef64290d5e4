"""Ranges from annotation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.ranges import format_range
from seqloom.functions.sequence import simplify_name


def unescaped(value: Column) -> Column:
    """An attribute's value with its percent escapes decoded; as it is where they are broken."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def feature_ranges(features: DataFrame, tag: str = "gene", key: str = "ID", assembly: Column | None = None, simplify: bool = False, simplify_seq: bool = False) -> DataFrame:
    """``(key, range)`` of the features of one type: the attribute (``NA`` if absent or a list) and ``assembly.seqid(strand):start-end``.

    ``assembly`` is the column ``genome`` unless given; only strand ``-`` is reverse.  Attributes are as in the file: what a comma separates is a list, an escaped comma is none.
    """
    value = F.col("attributes")[key]
    name = F.when(value.isNull() | value.contains(","), "NA").otherwise(unescaped(value))
    seqid = F.col("seqid").cast("string")
    if simplify:
        name = simplify_name(name)
    if simplify_seq:
        seqid = simplify_name(seqid)
    strand = F.when(F.col("strand") == "-", "-").otherwise("+")
    own = F.concat_ws(".", F.col("genome") if assembly is None else assembly, seqid)
    return features.where(F.lower("type") == tag.lower()).select(name.alias("key"), format_range(own, strand, F.col("start"), F.col("end")).alias("range"))
