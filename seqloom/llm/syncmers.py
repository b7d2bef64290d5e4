"""Document fingerprints from closed syncmers, and what an edit does to them.

A window of ``K`` bytes is an anchor if the smallest hash among its runs of ``S`` bytes is that of its first or last run.  Whether
it is one depends on the window alone, so unchanged text keeps its anchors wherever it moves, and two texts can be matched by
place.  A fingerprint lists the anchors' 32-bit hashes in text order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._store import SLAB_BYTES, as_bytes, clean_name, map_arrow, slabs

#: Bytes of a window and of its runs: short, so that texts of a line have anchors too; two windows in 17 are anchors.
K, S = 24, 8
_BASE = 0x9E3779B97F4A7C15
_SEED = 20240229


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, in a logarithmic number of passes."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(places, hashes)`` of each text's closed syncmers, in text order.

    A text without one (shorter than ``k``, or a little longer) has one anchor, the hash of the whole text at 0; an empty text none.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    n = len(data)
    places, hashes = np.empty(0, np.int64), np.empty(0, np.uint32)
    up, down = _powers(1 << max(10, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[:n], out=sums[1:])
    if n >= k:
        runs = _mix((sums[s:] - sums[:-s]) * down[: n - s + 1])
        least = window_min(runs, k - s + 1)
        at = np.flatnonzero((least == runs[: n - k + 1]) | (least == runs[k - s :]))
        owner = np.searchsorted(ends, at, side="right")
        at = at[at + k <= ends[owner]]
        places = at
        hashes = (_mix((sums[at + k] - sums[at]) * down[at]) >> np.uint64(32)).astype(np.uint32)
    first = np.searchsorted(places, ends - sizes)
    last = np.searchsorted(places, ends)
    out = []
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        begin = int(ends[i] - sizes[i])
        if a < b:
            out.append((places[a:b] - begin, hashes[a:b]))
        elif sizes[i]:
            whole = _mix((sums[ends[i]] - sums[begin : begin + 1]) * down[begin])
            out.append((np.zeros(1, np.int64), (whole >> np.uint64(32)).astype(np.uint32)))
        else:
            out.append((np.empty(0, np.int64), np.empty(0, np.uint32)))
    return out


def listed(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the shared distinct anchors over all distinct anchors of both; 1 for two empty texts, 0 for an empty and another."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    return 2.0 * float((both[1:] == both[:-1]).sum()) / (len(a) + len(b))


def matched_places(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Places in both texts of anchors that occur once in each, in order of the first."""
    pa_, ia, ca = np.unique(a[1], return_index=True, return_counts=True)
    pb, ib, cb = np.unique(b[1], return_index=True, return_counts=True)
    _, x, y = np.intersect1d(pa_[ca == 1], pb[cb == 1], assume_unique=True, return_indices=True)
    return sorted(zip(a[0][ia[ca == 1][x]].tolist(), b[0][ib[cb == 1][y]].tolist(), strict=True))


def syncmer_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """``(id, places, hashes)``, one row per row of ``docs``; places are bytes.  Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for part in slabs(batch, "text") for x in anchors(as_bytes(part.column(1)), k, s)]
            yield pa.record_batch(
                [batch.column(0), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1].astype(np.int64) for x in found], pa.list_(pa.int64()))],
                ["id", "places", "hashes"],
            )

    source = clean_name(docs, id_col, text_col).toDF("id", "text")
    return map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, places array<long>, hashes array<long>")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as much of ``following``, or all of it."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(bucket, guest, id, h, text)`` dealt out by ranges of ids and sorted; each bucket ends with a guest, the row that follows its last one.

    Bucket bounds are id quantiles, one bucket for each shuffle partition; a bucket's first row also goes to the bucket before
    it (the very first row to the last bucket).  What the driver holds is one row for each bucket.  Equal ids are ordered by
    the hash of their text, then the text; null ids come first.
    """
    spark = docs.sparkSession
    source = clean_name(docs, id_col, text_col).toDF("id", "text").withColumn("h", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = source.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    if cuts:
        # a search in two steps: among every width-th bound, then between two of those
        width = max(1, int(len(cuts) ** 0.5))
        bounds, coarse = F.lit(cuts), F.lit(cuts[::width])
        step = F.size(F.filter(coarse, lambda c: c <= F.col("id")))
        begin = F.greatest(step - 1, F.lit(0)) * width
        bucket = F.when(F.col("id").isNull() | (step == 0), F.lit(0)).otherwise(begin + F.size(F.filter(F.slice(bounds, begin + 1, width), lambda c: c <= F.col("id"))))
    else:
        bucket = F.lit(0)
    source = source.withColumn("bucket", bucket.cast("int"))
    firsts = sorted((r["bucket"], r["f"]["id"], r["f"]["h"]) for r in source.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("f")).collect())
    if not firsts:
        return source.select("bucket", F.lit(False).alias("guest"), "id", "h", "text")
    kind = source.schema["id"].dataType.simpleString()
    before = [(firsts[i - 1][0], x[1], x[2]) for i, x in enumerate(firsts)]
    # one row for each bucket, so its broadcast is bounded by the number of partitions
    heads = F.broadcast(spark.createDataFrame(before, f"_to int, _id {kind}, _h long"))
    guests = source.join(heads, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select(F.col("_to").alias("bucket"), F.lit(True).alias("guest"), "id", "h", "text")
    return (
        source.select("bucket", F.lit(False).alias("guest"), "id", "h", "text")
        .unionByName(guests)
        .repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("guest", "id", "h", "text")
    )


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Each document's fingerprint, that of its edited text (see ``edited``; what follows is the next document by id, the first after the last), and their likeness.

    Very long texts are fingerprinted whole.  One row per row of ``docs``: ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.  Null texts count
    as empty; equal ids are ordered by text; a lone document follows itself; an empty table gives an empty result; other columns are ignored.
    """
    rows = in_id_order(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, str]] = []

        def pairs() -> pa.RecordBatch | None:
            ids = [x[0] for x in held[:-1]]
            texts = [x[1] for x in held]
            if not ids:
                return None
            changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
            own = anchors([t.encode() for t in texts], k, s)
            new = anchors(changed, k, s)
            del held[:-1]
            return pa.record_batch(
                [
                    pa.array(ids, id_type),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
                    pa.array([listed(x[1]) for x in own[:-1]]),
                    pa.array([listed(x[1]) for x in new]),
                    pa.array([likeness(a[1], b[1]) for a, b in zip(own, new, strict=False)]),
                    pa.array([likeness(a[1], b[1]) for a, b in zip(own, own[1:], strict=False)]),
                ],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        size, done, id_type = 0, False, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            guest, ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("guest", "id", "text"))
            for i in range(batch.num_rows):
                if done:
                    break
                text = texts[i].as_py() or ""
                held.append((ids[i].as_py(), text))
                size += len(text)
                done = guest[i].as_py()
                if size > SLAB_BYTES // 2 or done:
                    size = 0
                    if (out := pairs()) is not None:
                        yield out

    out = map_arrow(
        rows, run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("id", id_col)
