"""Bloom filters of 60-bit hashes as small tables.

A filter is ``(word, bits)``, the words that are not empty.  Inserting is an aggregation: each task ors the bits of its own values before anything is shuffled, so what
is merged has at most as many rows as the filter has words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import bloom_size, hash60

#: Bytes of a filter that is sent to all tasks at most.
SHARED_BYTES = 1 << 28


def places(text: Column, bits: int, hashes: int) -> Column:
    """The bits of a string: the first of two hashes, and steps of the second from there."""
    first, step = F.pmod(hash60(text), F.lit(bits)), F.pmod(hash60(F.concat(text, F.lit("#"))), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(first + i * step, F.lit(bits)))


def _dense(words: Column, size: int) -> Column:
    """Words of a filter as one array with the empty ones."""

    def filled(columns: pd.Series) -> pd.Series:
        out = np.zeros((len(columns), size), np.int64)
        for i, row in enumerate(columns):
            for r in row:
                out[i, r["word"]] = r["bits"]
        return pd.Series(list(out))

    return F.pandas_udf(filled, "array<long>")(words)


def build(values: DataFrame, text: str, n: int, rate: float) -> DataFrame:
    """The filter of a column of strings, for ``n`` distinct ones at a rate of false positives.  Nulls are left out."""
    bits, hashes = bloom_size(n, rate)
    at = values.where(F.col(text).isNotNull()).select(F.explode(places(F.col(text), bits, hashes)).alias("p"))
    return at.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of what any of several filters of one size has."""
    rows = filters[0]
    for other in filters[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def maybe_in(df: DataFrame, text: str, filter_: DataFrame, n: int, rate: float) -> DataFrame:
    """Rows whose string may be in a filter made for ``n`` values at ``rate``: all that are, and few others.  The filter goes to all tasks as one array; its size is known from ``n``."""
    bits, hashes = bloom_size(n, rate)
    if bits > 8 * SHARED_BYTES:
        raise ValueError("the filter is too large to be sent to all tasks; take a higher rate, or join the values themselves")
    size = bits // 64 + 1
    listed = filter_.agg(F.array_sort(F.collect_list(F.struct(F.col("word").cast("int").alias("word"), "bits"))).alias("w"))
    shared = F.broadcast(listed.select(_dense(F.col("w"), size).alias("_bloom")))
    bit = lambda p: F.call_function("shiftrightunsigned", F.get("_bloom", F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return df.where(F.col(text).isNotNull()).crossJoin(shared).where(F.forall(places(F.col(text), bits, hashes), lambda p: bit(p) == 1)).drop("_bloom")
