"""Near-duplicate removal on word shingles, by self-joins of SimHash tries.

A set's SimHash is that of its distinct shingles, so a line that is repeated often weighs no more than others.  Close copies are found by the join of the
whole table's trie, as in ``simhash``.  At a similarity of 0.8 fingerprints differ in some 10 bits, too many for shared prefixes to deal out one
trie, so there tries are dealt out by buckets, which come from pairs of minimum hashes of the shingle set (eight pairs; two sets of similarity 0.8 share no
bucket once in 3,500 times).  The pairs that a bucket's walk leaves are compared by 256 minimum hashes of 16 bits.  All this only deals sets out into
groups, with a margin; inside a group the texts are read again and pairs are decided by their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._store import as_bytes, clean_name, discard, map_arrow, materialise, slabs
from seqloom.llm.graph import connected_components
from seqloom.llm.simhash import fingerprint, forest, hamming_links, shingle_hashes, trie_pairs

WORDS, SIMILARITY = 5, 0.8
#: How far below the similarity an estimate still makes a candidate; at 0.8 the estimate has a deviation of 0.025.
MARGIN = 0.12
BINS, BANDS, WIDE = 256, 8, 16
#: Bits in which fingerprints of similar sets differ at most.  A similarity of 0.8 makes more of them for one pair in 2 billion (sets of five
#: shingles: in 14 million); two thirds of unrelated pairs differ in more.
MAX_BITS = 30
#: Bits in which close copies differ at most; they are looked for in the whole table, without buckets.
CLOSE_BITS = 3
#: Pairs of a walk that are compared at once.
PAIRS_AT_ONCE = 1 << 12
#: Members of a bucket that one task compares; larger buckets are cut into chunks, each pair of chunks by itself.
BUCKET_ROWS = 512
#: Keys that are broadcast at most (numbers of 16 bytes); more meet the texts in a shuffle.
BROADCAST_KEYS = 500_000
_NONE = np.uint64((1 << 64) - 1)


def minima(unique: np.ndarray) -> np.ndarray:
    """256 minimum hashes of 16 bits of a sorted set of hashes; 0 for an empty bin."""
    which = (unique >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(which, prepend=-1))
    bins = np.zeros(BINS, np.uint16)
    bins[which[first]] = 1 + (unique[first] & np.uint64(0xFFFFFFFF)).astype(np.int64) % 65535
    return bins


def sketch(hashes: np.ndarray) -> tuple[bytes, int, bytes, list[int]]:
    """``(set, fingerprint, bins, bands)`` of a text's shingle hashes: a 128-bit name of the set, its SimHash, its minimum hashes, and up to eight bucket keys."""
    unique = np.unique(hashes)
    name = xxhash.xxh128_digest(unique.tobytes())
    wide = (unique >> np.uint64(60)).astype(np.int64)
    first = np.flatnonzero(np.diff(wide, prepend=-1))
    least = np.full(WIDE, _NONE)
    least[wide[first]] = unique[first]
    pairs = least.reshape(BANDS, 2)
    bands = [xxhash.xxh64_intdigest(p.tobytes(), b) - (1 << 63) for b, p in enumerate(pairs) if (p != _NONE).any()]
    return name, fingerprint(unique), minima(unique).tobytes(), bands


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``(id, key, name, fp, bins, bands)`` of every row of ``(id, text)``; ``key`` is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, "text"):
                rows = [sketch(shingle_hashes(t, words)) for t in as_bytes(part.column(2))]
                fp = pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64))
                columns = [pa.array([r[0] for r in rows], pa.binary()), fp, pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
                yield pa.record_batch([part.column(0), part.column(1), *columns], ["id", "key", "name", "fp", "bins", "bands"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, key long, name binary, fp long, bins binary, bands array<long>"
    return map_arrow(docs.select("id", F.xxhash64("text").alias("key"), "text"), run, schema)


def _alike(bins: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The estimated similarity of a row of minimum hashes, or of each of some rows, to each of the others."""
    return ((others == bins) & (bins != 0)).sum(1) / np.maximum(((others | bins) != 0).sum(1), 1)


def close_links(sets: DataFrame, max_bits: int = CLOSE_BITS) -> DataFrame:
    """Links ``(a, b)`` between names of sets, whose closure is that of all pairs whose fingerprints differ in ``max_bits`` or fewer, by the trie join of ``simhash``."""
    prints = materialise(sets.groupBy("fp").agg(F.min("name").alias("first")))
    same = sets.join(prints, "fp").where("name <> first").select(F.col("name").alias("a"), F.col("first").alias("b"))
    left, right = (prints.select(F.col("fp").alias(k), F.col("first").alias(f"_{k}")) for k in "ab")
    return same.unionByName(hamming_links(prints.select("fp"), max_bits).join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def similar_links(sets: DataFrame, similarity: float, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(a, b)`` between names of sets, whose closure is that of all pairs that share a bucket, differ in ``max_bits`` or fewer bits and are similar."""
    dealt = sets.select("name", "fp", "bins", F.explode("bands").alias("band"))
    sizes = dealt.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / bucket_rows).cast("int").alias("m"))
    spread = (
        dealt.join(sizes, "band")
        .withColumn("c", F.pmod(F.xxhash64("name"), F.col("m")).cast("int"))
        .select("name", "fp", "bins", "band", "c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
        .select("name", "fp", "bins", "band", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    )

    def links(names: list[bytes], fp: np.ndarray, bins: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        order = np.argsort(fp, kind="stable")
        fp, bins = fp[order], bins[order]
        a, b = trie_pairs(fp, np.array([0]), np.array([len(fp)]), 0, max_bits)
        # likeliest pairs first, so that fewer are left to compare
        likely = np.argsort(np.bitwise_count(fp[a] ^ fp[b]), kind="stable")
        a, b = a[likely], b[likely]
        root = np.arange(len(fp))
        while len(a):
            i, j, a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE], a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]
            close = _alike(bins[i], bins[j]) >= similarity
            if close.any():
                root = forest(len(fp), np.concatenate((np.arange(len(fp)), i[close])), np.concatenate((root, j[close])))
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
        child = np.flatnonzero(root != np.arange(len(fp)))
        return [names[order[k]] for k in child], [names[order[k]] for k in root[child]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> pa.RecordBatch:
            got = pa.Table.from_batches(held)
            names = got.column("name").to_pylist()
            bins = np.frombuffer(b"".join(got.column("bins").to_pylist()), np.uint16).reshape(-1, BINS)
            left, right = links(names, got.column("fp").to_numpy().view(np.uint64), bins)
            held.clear()
            return pa.record_batch([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

        for batch in batches:
            group = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)])
            cut = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cut, cut[1:], strict=False):
                if s == e:
                    continue
                own = tuple(group[:, s].tolist())
                if own != last and held:
                    yield flush()
                last = own
                held.append(batch.slice(s, e - s))
        if held:
            yield flush()

    return map_arrow(spread.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j"), run, "a binary, b binary")


def _exact_roots(sets: list[np.ndarray], bins: np.ndarray, similarity: float) -> np.ndarray:
    """For each set one that it reaches over pairs of at least the similarity, likeliest pairs first; pairs already joined are not compared."""
    root = np.arange(len(sets))
    sizes = np.array([len(x) for x in sets])
    for x in range(len(sets) - 1):
        y = x + 1 + np.flatnonzero(root[x + 1 :] != root[x])
        y = y[np.minimum(sizes[y], sizes[x]) >= similarity * np.maximum(sizes[y], sizes[x])]
        if len(y) > 1:
            near = _alike(bins[x], bins[y])
            order = np.argsort(-near, kind="stable")
            y = y[order][near[order] >= similarity - MARGIN]
        while len(y):
            z, y = y[0], y[1:]
            both = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
            if both / max(sizes[x] + sizes[z] - both, 1) >= similarity:
                root[root == root[z]] = root[x]
                y = y[root[y] != root[x]]
    return root


def exact_links(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between the names of ``_members``, whose closure is that of all pairs of a group that are similar by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        last = None

        def flush() -> pa.RecordBatch:
            names = list(held)
            sets = [np.unique(h) for h in held.values()]
            bins = np.stack([minima(x) for x in sets])
            root = _exact_roots(sets, bins, similarity)
            child = np.flatnonzero(root != np.arange(len(root))).tolist()
            held.clear()
            return pa.record_batch([pa.array([names[k] for k in child], pa.binary()), pa.array([names[root[k]] for k in child], pa.binary())], ["a", "b"])

        for batch in batches:
            for name, text, own in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True), strict=True):
                if own != last and held:
                    yield flush()
                last = own
                if name not in held:
                    held[name] = shingle_hashes(text, words)
        if held:
            yield flush()

    return map_arrow(members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").select("name", "text", "root", "i", "j"), run, "a binary, b binary")


def _few(keys: DataFrame) -> DataFrame:
    """``keys`` with the advice to broadcast it where it is short enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _members(components: DataFrame, sets: DataFrame, texts: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """``(name, root, text, i, j)``: a text of each set of a group, once for every pair of chunks that it is in; a group over ``rows`` is cut into chunks."""
    sizes = components.groupBy("root").agg(F.ceil(F.count("*") / rows).cast("int").alias("m"))
    known = materialise(components.withColumnRenamed("node", "name").join(sizes, "root").join(sets.select("name", F.col("least.id").alias("_id"), F.col("least.key").alias("_key")), "name"))
    read = _few(known).join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    return (
        read.withColumn("c", F.pmod(F.xxhash64("name"), F.col("m")).cast("int"))
        .select("name", "root", "text", "c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
        .select("name", "root", "text", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, but one of each group of near copies: that with the smallest id (then the smallest hash of its text).

    Texts link if their sets of ``words``-word shingles (A-Z lower-cased; the whole sequence if shorter) have a Jaccard similarity of at least ``similarity``;
    groups are what links reach.  Very long texts are compared whole.  Texts without words, null ones included, are copies of each other.  Of repeated rows one stays; null ids come
    before others; an empty table gives an empty result.
    """
    names = docs.columns
    work = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    made = materialise(sketches(clean_name(docs, id_col, text_col).toDF("id", "text"), words))
    own = materialise(made.groupBy("id", "key", "name").agg(F.count("*").alias("n")))
    sets = made.groupBy("name").agg(F.min_by(F.struct("fp", "bins", "bands"), F.struct("id", "key")).alias("s"), F.min(F.struct("id", "key")).alias("least"))
    sets = materialise(sets.select("name", "s.*", "least"))
    discard(made)
    loose = connected_components(close_links(sets).unionByName(similar_links(sets, similarity - MARGIN)))
    texts = clean_name(docs, id_col, text_col).toDF("id", "text").withColumn("key", F.xxhash64("text"))
    components = connected_components(exact_links(_members(loose, sets, texts), words, similarity))
    rooted = sets.select("name", "least").join(components.withColumnRenamed("node", "name"), "name", "left").select("name", "least", F.coalesce("root", "name").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("k"))
    decided = own.join(rooted.select("name", "root"), "name").join(least, "root").select(F.col("id").alias("_id"), F.col("key").alias("_key"), (F.col("id").eqNullSafe(F.col("k.id")) & (F.col("key") == F.col("k.key"))).alias("_stays"), "n")
    # only keys of rows that go, or of which one of several stays, have to meet the texts
    known = materialise(decided.where("not _stays or n > 1").select("_id", "_key", "_stays"))
    discard(own)
    met = work.withColumn("_own", F.xxhash64(text)).join(_few(known), F.col(ident).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left")
    kept = met.where("_stays is null")
    if not known.where("_stays").isEmpty():
        once = met.where("_stays").withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_own"))).where("_n = 1").drop("_n")
        kept = kept.unionByName(once)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
