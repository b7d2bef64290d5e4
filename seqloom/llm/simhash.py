"""SimHash near-duplicate detection by a self-join of binary tries.

Fingerprints lie in a binary trie.  The join walks pairs of trie nodes from the top, adds up the bits in
which their paths differ, and drops a pair when the sum passes the Hamming budget.  For a cluster the walk
is dealt out by the pigeonhole principle: with ``b`` blocks of bits and a budget of ``d < b`` at least ``b - d``
blocks agree, so every choice of ``b - d`` blocks, put on top of the bit order, makes one table of sub-tries
whose pairs share that prefix.  Sub-tries of more than ``SUBTRIE_ROWS`` leaves are cut into chunks and each pair of chunks
is walked by itself, so no task holds a hot sub-trie.  A task returns a spanning forest of its links, not the links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._store import as_bytes, clean_name, map_arrow, materialise, slabs
from seqloom.llm.graph import connected_components

BITS = 64
#: Leaves of a sub-trie that one task walks; larger ones are cut into chunks.
SUBTRIE_ROWS = 1024
#: Leaves that are walked at once inside a task.
WALK_ROWS = 1 << 16
#: A pair of nodes with at most so many leaf pairs is compared leaf by leaf.
SMALL = 32
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_ONE = np.uint64(1)


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words (A-Z lower-cased), repeats included; the whole sequence if shorter; none without a word."""
    found = _WORD.findall(text.lower())
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)].astype(">u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)``, one row per row of ``docs``; ``fp`` is the fingerprint as a signed long.  Null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t, words)) for part in slabs(batch, "text") for t in as_bytes(part.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "fp"])

    source = clean_name(docs, id_col, text_col).toDF("id", "text")
    return map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def trie_pairs(keys: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of ``keys`` that differ in at most ``budget`` bits.

    ``keys`` is sorted inside each root node ``[first, last)``, whose keys share their first ``depth`` bits.
    A trie node is a range of the sorted keys; its children are split by a running count of the next bit.
    """
    a0, a1, b0, b1 = first, last, first, last
    err = np.zeros(len(first), np.int64)
    found_i, found_j = [], []
    while len(a0):
        pairs = (a1 - a0) * (b1 - b0)
        same = a0 == b0
        done = (pairs <= SMALL) | (depth >= BITS)
        if done.any():
            n, width = pairs[done], (b1 - b0)[done]
            at = np.repeat(np.cumsum(n) - n, n)
            within = np.arange(n.sum()) - at
            i = np.repeat(a0[done], n) + within // np.repeat(width, n)
            j = np.repeat(b0[done], n) + within % np.repeat(width, n)
            ok = (~np.repeat(same[done], n) | (i < j)) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            found_i.append(i[ok])
            found_j.append(j[ok])
            a0, a1, b0, b1, err, same = (x[~done] for x in (a0, a1, b0, b1, err, same))
            if not len(a0):
                break
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & _ONE).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        cross = ~same
        parts = (
            (a0, am, b0, bm, err, None),
            (am, a1, bm, b1, err, None),
            (a0, am, bm, b1, err + 1, None),
            (am, a1, b0, bm, err + 1, cross),
        )
        kept = []
        for p0, p1, q0, q1, e, only in parts:
            ok = (p1 > p0) & (q1 > q0) & (e <= budget)
            ok &= ~((p0 == q0) & (p1 - p0 == 1) & (p1 == q1))
            if only is not None:
                ok &= only
            kept.append([x[ok] for x in (p0, p1, q0, q1, e)])
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*kept, strict=True))
        depth += 1
    none = np.empty(0, np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _on_top(x: np.ndarray, blocks: int, chosen: tuple[int, ...]) -> np.ndarray:
    """``x`` with the chosen blocks of bits first, the other blocks after them."""
    edges = block_edges(blocks)
    out = np.zeros_like(x)
    for b in (*chosen, *(b for b in range(blocks) if b not in chosen)):
        width = edges[b + 1] - edges[b]
        out = (out << np.uint64(width)) | ((x >> np.uint64(edges[b])) & np.uint64((1 << width) - 1))
    return out


def block_edges(blocks: int) -> list[int]:
    """Where the blocks of bits begin, and where the last one ends."""
    return [BITS * b // blocks for b in range(blocks + 1)]


def best_blocks(n: int, max_bits: int, subtrie_rows: int = SUBTRIE_ROWS) -> int:
    """The number of blocks that makes the fewest copies of ``n`` fingerprints: one for each table and each chunk of a sub-trie, if bits were random."""

    def copies(blocks: int) -> float:
        depth = (BITS // blocks) * (blocks - max_bits)
        return math.comb(blocks, max_bits) * max(1.0, n / 2.0**depth / subtrie_rows)

    return min(range(max_bits + 1, max_bits + 6), key=copies)


def hamming_links(prints: DataFrame, max_bits: int = 3, blocks: int | None = None, subtrie_rows: int = SUBTRIE_ROWS) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints in column ``fp`` whose closure is that of all pairs at ``max_bits`` or fewer.

    ``blocks`` is over ``max_bits``; more blocks make longer shared prefixes and more tables (4 blocks and 3 bits: four tables with 16-bit prefixes;
    6 blocks: 20 tables with some 32 bits).  Any choice gives the same closure; unless given it follows from the number of fingerprints (``best_blocks``).
    """
    if blocks is None:
        blocks = best_blocks(prints.count(), max_bits, subtrie_rows)
    if not max_bits < blocks <= BITS:
        raise ValueError("blocks must be over max_bits and 64 at most")
    edges = block_edges(blocks)
    tables = list(combinations(range(blocks), blocks - max_bits))
    depth = min(sum(edges[b + 1] - edges[b] for b in chosen) for chosen in tables)

    def prefix(chosen: tuple[int, ...]) -> F.Column:
        out = F.lit(0).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", edges[b]).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return out

    dealt = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), prefix(c).alias("p")) for t, c in enumerate(tables)])).alias("k")).select(
        "fp", "k.t", "k.p"
    )
    sizes = dealt.groupBy("t", "p").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / subtrie_rows).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m")).cast("int")
    spread = (
        dealt.join(sizes.withColumn("m", chunks), ["t", "p"])
        .withColumn("c", own)
        .select("fp", "t", "p", "c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
        .select("fp", "t", "p", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        got = pa.Table.from_batches(rows)
        fp = got.column("fp").to_numpy().view(np.uint64)
        group = np.stack([got.column(c).to_numpy().astype(np.int64) for c in ("t", "p", "i", "j")])
        key = np.empty(len(fp), np.uint64)
        for t, chosen in enumerate(tables):
            at = group[0] == t
            key[at] = _on_top(fp[at], blocks, chosen)
        order = np.lexsort((key, group[3], group[2], group[1], group[0]))
        key, fp, group = key[order], fp[order], group[:, order]
        first = np.flatnonzero(np.concatenate(([True], (group[:, 1:] != group[:, :-1]).any(0))))
        last = np.append(first[1:], len(fp))
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(last, first[at] + WALK_ROWS, side="right")))
            base, end = first[at], last[to - 1]
            i, j = trie_pairs(key[base:end], first[at:to] - base, last[at:to] - base, depth, max_bits)
            root = forest(end - base, i, j)
            child = np.flatnonzero(root != np.arange(end - base))
            part = fp[base:end].view(np.int64)
            yield pa.record_batch([pa.array(part[child]), pa.array(part[root[child]])], ["a", "b"])
            at = to

    return map_arrow(spread.repartition("t", "p", "i", "j"), walk, "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, blocks: int | None = None
) -> DataFrame:
    """``(id_col, fingerprint, component_id)``, one row per row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; a component is what links reach, named by its smallest id.
    Very long texts are read whole; hashes set in exactly half leave a bit at 0.  A fingerprint that many rows share is one key of the last join, which Spark's skew join splits.
    Null, empty and blank texts have fingerprint zero, which links like any other.  Repeated rows each give a row; rows with a null id
    take part and give a row, and name a component only if it has no other id.  An empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    prints = materialise(fingerprints(docs, id_col, text_col, words))
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")))
    components = connected_components(hamming_links(distinct.select("fp"), max_bits, blocks))
    rooted = distinct.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").cast(kind).alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

