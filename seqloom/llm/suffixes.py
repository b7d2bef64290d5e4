"""Removal of long repeated byte strings with bucketed suffix arrays.

Every start of a ``LENGTH``-byte window belongs to one anchor, the leftmost of the smallest hashes of the window's ``GRAM``-byte strings.  The anchor
depends on the window's bytes alone, so equal windows anywhere have equal anchor strings, and a corpus-wide suffix array falls into one bucket
for each anchor string that occurs twice.  Starts that share an anchor form a region; equal regions are one class with a count.  In a bucket
the classes' suffixes are sorted in two stages: those smaller than their successors directly, the others induced by scanning
the buckets of first bytes.  Neighbours with a common prefix of ``LENGTH`` bytes form runs; a run with two places is repeated.

A hot bucket (many different surroundings of one passage) is first split by the bytes around the anchor, and its parts are sorted in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._store import as_bytes, clean_name, discard, map_arrow, materialise, slabs

LENGTH, GRAM = 400, 100
#: Classes of one bucket that are sorted in one task; larger buckets are split into parts.
BUCKET_CLASSES = 500
#: Starts of one stretch of a region in such a bucket (near the root of a region's usual number of starts, which needs the fewest rows).
STRETCH = 16
#: Classes of stretches with one core that are sorted in one task; of more, single windows meet as whole strings.
STRETCH_CLASSES = 4096
#: Starts of one piece of a text; longer texts are cut into pieces that overlap by a window.
PIECE = 1 << 20
#: Bytes that are sorted at once.
SORT_BYTES = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 24) - 1)


@lru_cache(4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(2)
def _byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(500 + which).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sums(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(12, int(len(data)).bit_length()), _BASES[which])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(which)[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def regions(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, two class hashes, first start, starts)`` of the regions of one text (at most 2^24 bytes)."""
    n = len(data)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    sums, down = _sums(data, 0)
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_window_min(ranked, length - gram + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(first, len(anchor)))
    at = anchor[first]
    shape = _mix((count.astype(np.uint64) << np.uint64(32)) | (at - first).astype(np.uint64))
    kinds = [_mix(((s[first + count + length - 1] - s[first]) * d[first]) ^ shape).view(np.int64) for s, d in ((sums, down), _sums(data, 1))]
    return grams[at].view(np.int64), kinds[1], kinds[0], first, count


def anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(id, key, g, f, f2, lo, n)`` for every region of ``(id, key, text)``; ``f`` and ``f2`` together name its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, "text"):
                texts = as_bytes(part.column(2))
                rows, found = [], []
                for i, text in enumerate(texts):
                    for base in range(0, max(1, len(text) - length + 1), PIECE):
                        g, f, f2, lo, n = regions(np.frombuffer(text[base : base + PIECE + length - 1], np.uint8), length, gram)
                        rows.append(np.full(len(g), i))
                        found.append((g, f, f2, lo + base, n))
                at = pa.array(np.concatenate(rows))
                yield pa.record_batch(
                    [part.column(0).take(at), part.column(1).take(at), *[pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]], ["id", "key", "g", "f", "f2", "lo", "n"]
                )

    return map_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, key long, g long, f long, f2 long, lo long, n long")


def _windows(data: np.ndarray, length: int) -> np.ndarray:
    """Each place's next ``length`` bytes, as one fixed-width string (a view; places near the end are padded with zeros)."""
    padded = np.concatenate((data, np.zeros(length, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded, (len(data), length), (1, 1))


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places in the order of their suffixes, compared to at least ``depth`` bytes.

    A suffix is of type S if it is smaller than its successor, else of type L.  S suffixes are sorted directly.  An L suffix is its first byte and
    its successor, so it follows from the successor's rank: buckets of first bytes are scanned upwards, and each suffix that is placed appends its L predecessor to
    that one's bucket.  Only wanted places, and the L chains behind them down to the next S suffix, take part.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    # a run of equal bytes has the type of its end
    place = np.where(step != 0, np.arange(n), n)
    place = np.minimum.accumulate(place[::-1])[::-1]
    smaller = step[place] > 0
    take = np.zeros(n, bool)
    take[wanted] = True
    # the chain of an L place ends at the next S place
    next_s = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1]
    chain = np.zeros(n + 2, np.int64)
    large = wanted[~smaller[wanted]]
    np.add.at(chain, large, 1)
    np.add.at(chain, np.minimum(next_s[large], n - 1) + 1, -1)
    take |= np.cumsum(chain[:n]) > 0
    direct = np.flatnonzero(take & smaller)
    strings = np.ascontiguousarray(_windows(data, depth)[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(strings, kind="stable")]
    s_from = np.searchsorted(data[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    pushed: list[list[np.ndarray]] = [[] for _ in range(256)]
    if take[n - 1]:
        pushed[data[n - 1]].append(np.array([n - 1]))

    def before(placed: np.ndarray) -> np.ndarray:
        p = placed[placed > 0] - 1
        return p[take[p] & ~smaller[p]]

    out = []
    for c in range(256):
        waves = []
        wave = np.concatenate(pushed[c]) if pushed[c] else np.empty(0, np.int64)
        while len(wave):
            waves.append(wave)
            p = before(wave)
            wave = p[data[p] == c]
        bucket = np.concatenate([*waves, direct[s_from[c] : s_from[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        p = before(bucket)
        p = p[data[p] > c]
        if len(p):
            p = p[np.argsort(data[p], kind="stable")]
            cuts = np.flatnonzero(np.diff(data[p])) + 1
            for part in np.split(p, cuts):
                pushed[data[part[0]]].append(part)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    mark = np.zeros(n, bool)
    mark[wanted] = True
    return order[mark[order]]


def adjacent_common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, in bytes and ``depth`` at most, of each place in ``order`` with the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    windows = _windows(data, depth)
    for at in range(1, len(order), 1 << 14):
        part = order[at - 1 : at + (1 << 14)]
        other = windows[part[1:]] != windows[part[:-1]]
        out[at : at + len(part) - 1] = np.where(other.any(1), other.argmax(1), depth)
    return out


def repeated_starts(texts: list[bytes], starts: list[int], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its first ``starts`` windows occur at two places; a text stands for ``counts`` equal ones."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes, n = np.fromiter(map(len, texts), np.int64, len(texts)), np.array(starts, np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), n)
    wanted = begin[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order = two_stage_order(data, wanted, length)
    run = np.cumsum(adjacent_common_prefixes(data, order, length) < length)
    of = np.zeros(len(data), np.int64)
    of[wanted] = owner
    places = np.bincount(run, np.array(counts, float)[of[order]])
    hit = np.zeros(len(data), bool)
    hit[order] = places[run] >= 2
    return [hit[b : b + k] for b, k in zip(begin.tolist(), starts, strict=True)]


def _ranges(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [{"b": int(b), "e": int(e)} for b, e in edge.reshape(-1, 2)]


_FLAGS = "c1 long, c2 long, c3 long, ranges array<struct<b:long,e:long>>"
_FLAG_TYPE = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))


def _sorted_buckets(classes: DataFrame, length: int) -> DataFrame:
    """``(c1, c2, c3, ranges)`` of the repeated starts of the classes ``(bucket, c1, c2, c3, cnt, n, body)``, bucket by bucket."""

    def sort(rows: dict[tuple[int, int, int], tuple[bytes, int, int]]) -> pa.RecordBatch:
        hits = repeated_starts(*map(list, zip(*rows.values(), strict=True)), length)
        keep = [(*name, _ranges(h)) for name, h in zip(rows, hits, strict=True) if h.any()]
        return pa.record_batch([pa.array([k[i] for k in keep], _FLAG_TYPE if i == 3 else pa.int64()) for i in range(4)], ["c1", "c2", "c3", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[bytes, int, int]] = {}
        size, last = 0, None
        for batch in batches:
            bucket, *names, cnt, n = (batch.column(k).to_pylist() for k in range(6))
            for i, name in enumerate(zip(*names, strict=True)):
                if size > SORT_BYTES and bucket[i] != last:
                    yield sort(held)
                    held, size = {}, 0
                last = bucket[i]
                if name not in held:
                    body = batch.column(6)[i].as_py()
                    held[name] = (body, n[i], cnt[i])
                    size += len(body)
        if held:
            yield sort(held)

    return map_arrow(classes.select("bucket", "c1", "c2", "c3", "cnt", "n", "body").repartition("bucket").sortWithinPartitions("bucket"), run, _FLAGS)


def _anchor_place(body: np.ndarray, length: int, gram: int) -> int:
    """Where the anchor of a region's windows lies in it."""
    sums, down = _sums(body[:length], 0)
    grams = _mix((sums[gram : length + 1] - sums[: length - gram + 1]) * down[: length - gram + 1])
    return int(np.argmin((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)))


def _stretches(classes: DataFrame, length: int, gram: int) -> DataFrame:
    """``(g, f, f2, cnt, b, n, k1, k2, x1, x2, body)``: the classes cut into stretches.

    The starts that lie ``STRETCH * j`` to ``STRETCH * (j + 1) - 1`` bytes before the anchor form stretch ``j``.  Its windows share a core (named by ``k1`` and ``k2``), and equal windows
    have equal cores; ``x1`` and ``x2`` name the whole stretch, which begins at ``b`` and has ``n`` starts.
    """
    stretch = max(1, min(STRETCH, length // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = []
                body = np.frombuffer(batch.column(5)[row].as_buffer(), np.uint8)
                g, f, f2, cnt, n = (batch.column(k)[row].as_py() for k in range(5))
                off = _anchor_place(body, length, gram)
                tables = [_sums(body, which) for which in (0, 1)]
                for j in range((off - n + 1) // stretch, off // stretch + 1):
                    b, e = max(0, off - stretch * j - stretch + 1), min(n, off - stretch * j + 1)
                    c, d = off - stretch * j, off - stretch * (j + 1) + 1 + length
                    core = [int(_mix(((s[d : d + 1] - s[c : c + 1]) * w[c]) + np.uint64(j)).view(np.int64)[0]) for s, w in tables]
                    whole = [int(_mix((s[e - 1 + length : e + length] - s[b : b + 1]) * w[b] + np.uint64(e - b << 32 | off - b)).view(np.int64)[0]) for s, w in tables]
                    rows.append((g, f, f2, cnt, b, e - b, *core, *whole, body[b : e - 1 + length].tobytes()))
                yield pa.record_batch([pa.array(list(x), pa.binary() if i == 10 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], names)

    names = ["g", "f", "f2", "cnt", "b", "n", "k1", "k2", "x1", "x2", "body"]
    return map_arrow(classes.select("g", "f", "f2", "cnt", "n", "body"), run, ", ".join(f"{c} {'binary' if c == 'body' else 'long'}" for c in names))


def _split_buckets(classes: DataFrame, length: int, gram: int, stretch_classes: int) -> DataFrame:
    """What ``_sorted_buckets`` gives, for buckets with too many classes for one task: stretches of their regions are sorted core by core.

    As with whole regions, equal stretches are one class with a count, a core seen once has no repeated window, and one whose stretches are all equal has only
    such.  A core with over ``stretch_classes`` different stretches (a passage's end in as many surroundings) has its single windows grouped as whole strings.
    """
    rows = materialise(_stretches(classes, length, gram))
    place = ["g", "f", "f2", "b"]
    kinds = rows.groupBy("k1", "k2", "x1", "x2").agg(F.sum("cnt").alias("cnt"), F.min(F.struct(*place, "n")).alias("one"))
    cores = kinds.groupBy("k1", "k2").agg(F.sum("cnt").alias("t"), F.count("*").alias("classes")).where("t > 1").drop("t")
    shared = materialise(kinds.join(cores, ["k1", "k2"]).select("k1", "x1", "x2", "cnt", "classes", "one.*"))
    bodies = materialise(rows.select(*place, "body").join(shared.where("classes > 1"), place).select(F.col("k1").alias("bucket"), "x1", "x2", "cnt", "n", "classes", "body"))
    alike = shared.where("classes = 1").select("x1", "x2", F.array(F.struct(F.lit(0).cast("long").alias("b"), F.col("n").alias("e"))).alias("ranges"))
    parts = bodies.where(F.col("classes") <= stretch_classes).select("bucket", F.col("x1").alias("c1"), F.col("x2").alias("c2"), F.lit(0).cast("long").alias("c3"), "cnt", "n", "body")
    single = bodies.where(F.col("classes") > stretch_classes).select("x1", "x2", "cnt", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    single = single.select("x1", "x2", "cnt", "b", F.substring("body", F.col("b").cast("int") + 1, F.lit(length)).alias("w"))
    again = single.groupBy("w").agg(F.sum("cnt").alias("t")).where("t > 1").select("w")
    met = single.join(again, "w", "left_semi").select("x1", "x2", F.array(F.struct("b", (F.col("b") + 1).alias("e"))).alias("ranges"))
    flags = materialise(_sorted_buckets(parts, length).select(F.col("c1").alias("x1"), F.col("c2").alias("x2"), "ranges").unionByName(alike).unionByName(met))
    hit = rows.select(*place, "x1", "x2").join(flags, ["x1", "x2"]).select("g", "f", "f2", F.transform("ranges", lambda r: F.struct((F.col("b") + r["b"]).alias("b"), (F.col("b") + r["e"]).alias("e"))).alias("r"))
    out = materialise(hit.groupBy("g", "f", "f2").agg(_joined(F.array_sort(F.flatten(F.collect_list("r")))).alias("ranges")))
    discard(rows, shared, bodies, flags)
    return out.toDF("c1", "c2", "c3", "ranges")


def _joined(ranges: F.Column) -> F.Column:
    """Sorted ranges with those that touch made one, so that an occurrence of a class has a row for each run of its starts."""
    none = F.array().cast("array<struct<b:bigint,e:bigint>>")

    def add(done: F.Column, r: F.Column) -> F.Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["b"].alias("b"), F.greatest(last["e"], r["e"]).alias("e"))
        return F.when(last["e"] >= r["b"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, none, add)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_classes: int = BUCKET_CLASSES, stretch_classes: int = STRETCH_CLASSES) -> DataFrame:
    """``(id, key, ranges)``: the byte ranges of each ``(id, key, text)`` that a repeated window covers, unmerged; ``key`` is the text's hash."""
    name = ["g", "f", "f2"]
    found = materialise(anchor_table(docs, length, gram))
    classes = found.groupBy(*name).agg(F.count("*").alias("cnt"), F.min(F.struct("id", "key", "lo", "n")).alias("one"))
    buckets = classes.groupBy("g").agg(F.sum("cnt").alias("places"), F.count("*").alias("classes")).where("places > 1").drop("places")
    shared = materialise(classes.join(buckets, "g").select(*name, "cnt", "one.*", "classes"))
    alone = shared.where("classes = 1").select(*name, F.array(F.struct(F.lit(0).cast("long").alias("b"), F.col("n").alias("e"))).alias("ranges"))
    wanted = shared.where("classes > 1").groupBy("id", "key").agg(F.collect_list(F.struct(*name, "cnt", "lo", "n", "classes")).alias("rows"))
    columns = [*name, "cnt", "n", "classes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, rows in zip(as_bytes(batch.column(0)), batch.column(1), strict=True):
                rows = rows.as_py()
                bodies = [text[r["lo"] : r["lo"] + r["n"] + length - 1] for r in rows]
                yield pa.record_batch([*[pa.array([r[c] for r in rows], pa.int64()) for c in columns], pa.array(bodies, pa.binary())], [*columns, "body"])

    source = docs.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "text")
    joined = source.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key"))).select("text", "rows")
    bodies = materialise(map_arrow(joined, cut, ", ".join(f"{c} long" for c in columns) + ", body binary"))
    whole = bodies.where(F.col("classes") <= bucket_classes).select(F.col("g").alias("bucket"), F.col("g").alias("c1"), F.col("f").alias("c2"), F.col("f2").alias("c3"), "cnt", "n", "body")
    split = _split_buckets(bodies.where(F.col("classes") > bucket_classes), length, gram, stretch_classes)
    flags = materialise(_sorted_buckets(whole, length).unionByName(split).toDF(*name, "ranges").unionByName(alone))
    discard(bodies, shared, split)
    spans = found.join(flags, name).select("id", "key", F.explode(F.transform("ranges", lambda r: F.struct((F.col("lo") + r["b"]).alias("b"), (F.col("lo") + r["e"] + (length - 1)).alias("e")))).alias("r"))
    ranges = materialise(spans.groupBy("id", "key").agg(F.collect_list("r").alias("ranges")))
    discard(found, flags)
    return ranges


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_classes: int = BUCKET_CLASSES, stretch_classes: int = STRETCH_CLASSES) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept, kept_sha256)``, one row per row of ``docs``.

    A byte of a text's UTF-8 goes if a ``length``-byte string covers it that also starts anywhere else, in the same text or another.  ``kept`` are the other bytes.
    Regions and stretches count as equal if two 64-bit hashes of their bytes agree (and, for regions, that of their anchor); all else is compared byte by byte.
    Very long texts are cut into overlapping pieces of ``PIECE`` starts.  Which of several equal places is first makes no difference: all lose the bytes.
    Null and empty texts, and texts shorter than ``length``, lose nothing.  Repeated rows are copies of each other and lose all if long enough; null
    ids take part like any; an empty table gives an empty result; other columns are ignored.
    """
    source = clean_name(docs, id_col, text_col).toDF("id", "text").select("id", F.xxhash64("text").alias("key"), "text")
    ranges = repeated_ranges(source, length, gram, bucket_classes, stretch_classes).withColumnsRenamed({"id": "_id", "key": "_key"})
    joined = source.join(ranges, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
                merged: list[list[int]] = []
                for b, e in sorted((r["b"].as_py(), r["e"].as_py()) for r in spans) if spans.is_valid else ():
                    if merged and b <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([b, e])
                parts, last = [], 0
                for b, e in merged:
                    parts.append(text[last:b])
                    last = e
                kept = b"".join([*parts, text[last:]])
                rows.append((len(text), len(text) - len(kept), len(merged), kept, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
            yield pa.record_batch([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = map_arrow(joined, run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


#: DuckDB SQL for the rows of ``remove_repeats`` without the kept bytes: all windows in hex, met by digest.
ORACLE = """
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
ch AS (SELECT doc_id, c, substr(h, 2048 * c + 1, 2846) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2048 + 1)) AS c FROM x)),
st AS (SELECT doc_id, c * 1024 + i AS i, md5(substr(part, 2 * i + 1, 800)) AS m FROM (SELECT *, unnest(range(0, length(part) // 2 - 399)) AS i FROM ch)),
rp AS (SELECT doc_id, i FROM st WHERE m IN (SELECT m FROM st GROUP BY m HAVING count(*) > 1)),
mk AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS new FROM rp WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
sp AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mk) GROUP BY doc_id, k),
bf AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM sp),
ag AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM bf JOIN x USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM x LEFT JOIN ag USING (doc_id)
"""
