"""Sequences that share translated minimizers with a set of proteins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.hashing import hash60_of, kmer_words, words_of
from seqloom.functions.shared import spread
from seqloom.operators.minimizers import minimizer_sets, window_places
from seqloom.operators.records import frame_batches

#: Minimizers of proteins that are sent to all tasks at most; more are joined.
SHARED_HASHES = 1 << 20
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TABLES: dict[int, np.ndarray] = {}


def _table(k: int) -> np.ndarray:
    """The hashes of all strings of ``k`` capitals, by five bits a letter."""
    if k not in _TABLES:
        letters = np.frombuffer(_LETTERS.encode(), np.uint8)
        every = np.stack(np.meshgrid(*[letters] * k, indexing="ij"), -1).reshape(-1, k)
        codes = np.zeros(len(every), np.int64)
        for i in range(k):
            codes = codes << 5 | (every[:, i] & 31)
        table = np.zeros(1 << 5 * k, np.int64)
        table[codes] = hash60_of("md5", kmer_words(words_of(every.ravel()), np.arange(len(every)) * k, k), k)
        _TABLES[k] = table
    return _TABLES[k]


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k-mer at every byte of some capitals that has ``k`` from there on; short k-mers are looked up."""
    n = len(data) - k + 1
    if k > 4:
        return hash60_of("md5", kmer_words(words_of(data), slice(0, n), k), k)
    codes = np.zeros(n, np.int32)
    for i in range(k):
        codes = codes << 5 | (data[i : i + n] & 31)
    return _table(k)[codes]


def _least(hashes: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` hashes in a row."""
    if w > 8:
        return hashes[window_places(hashes, w)]
    n = len(hashes) - w + 1
    best = hashes[:n]
    for i in range(1, w):
        best = np.minimum(best, hashes[i : i + n])
    return best


def _minimizers(proteins: pa.StringArray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the windows of each protein, runs of one hash once; proteins are hashed as one string, windows across two of them left out."""
    offsets = np.frombuffer(proteins.buffers()[1], np.int32, len(proteins) + 1, proteins.offset * 4)
    data = np.frombuffer(proteins.buffers()[2], np.uint8, offsets[-1])[offsets[0] :] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    if len(data) < k + w - 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = _least(_hashes(data, k), w)
    windows = np.maximum(np.diff(offsets) - (k + w - 2), 0)
    row = np.repeat(np.arange(len(windows)), windows)
    at = np.repeat(offsets[:-1] - offsets[0] - (np.cumsum(windows) - windows), windows) + np.arange(len(row))
    found = least[at]
    new = np.ones(len(row), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return row[new], found[new]


def prefilter(contigs: DataFrame, proteins: DataFrame, k: int = 7, w: int = 2, least: int = 15, name: str = "name", seq: str = "seq") -> DataFrame:
    """``(name, strand, frame, start, end, n_shared)`` of every open stretch of a contig that shares minimizers with any protein.

    A stretch is translated and sketched in the task that reads its record.  The proteins' minimizers go to all tasks if they are few; if not, the stretches' are joined with them.
    """
    known = minimizer_sets(proteins.withColumn("seq_id", F.col(name)), k, w, seq=seq, both_strands=False).select("hash").distinct()
    source = spread(contigs.select(name, seq))
    columns = f"`{name}` {source.schema[name].dataType.simpleString()}, strand string, frame int, start long, end long"
    # no more than what is shared leaves the executors
    few = known.limit(SHARED_HASHES + 1).toArrow().column(0).to_numpy()
    if len(few) > SHARED_HASHES:

        def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in frame_batches(batches, name, least):
                row, hashes = _minimizers(batch.column(5), k, w)
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=batch.num_rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[new]))], [*batch.schema.names[:5], "hashes"])

        # records may share a name, so rows are numbered
        own = source.mapInArrow(sketched, f"{columns}, hashes array<bigint>").withColumn("_row", F.monotonically_increasing_id())
        keys = ["_row", name, "strand", "frame", "start", "end"]
        return own.select(*keys, F.explode("hashes").alias("hash")).join(known, "hash", "left_semi").groupBy(*keys).agg(F.count("*").alias("n_shared")).drop("_row")
    shared = contigs.sparkSession.sparkContext.broadcast(np.sort(few))
    mask = (1 << 22) - 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        # most hashes are sorted out by their low bits
        low = np.zeros(mask + 1, bool)
        low[listed & mask] = True
        for batch in frame_batches(batches, name, least):
            row, hashes = _minimizers(batch.column(5), k, w)
            maybe = low[hashes & mask]
            row, hashes = row[maybe], hashes[maybe]
            at = np.searchsorted(listed, hashes)
            there = at < len(listed)
            there[there] = listed[at[there]] == hashes[there]
            pairs = np.unique(row[there] * (len(listed) + 1) + at[there])
            n = np.bincount(pairs // (len(listed) + 1), minlength=batch.num_rows)
            hit = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([*[c.take(hit) for c in batch.columns[:5]], pa.array(n[n > 0].astype(np.int64))], [*batch.schema.names[:5], "n_shared"])

    return source.mapInArrow(counted, f"{columns}, n_shared long")
