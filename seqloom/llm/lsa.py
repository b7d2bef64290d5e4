"""Benchmark decontamination by latent semantic retrieval.

Every document is cut into passages of 24 words, every 8 words.  Passages are TF-IDF vectors over hashed terms; a randomised
factorisation of their Gram matrix (one pass over all passages, sketch ``G W``, then Nystrom) gives the leading right singular vectors.
Passages and benchmark items meet in that latent space: pairs over a cosine are candidates; items under 24 words also meet passages of 8 and 16
words, whose surroundings dilute them less.  A run of words of an item that is long enough to count makes a candidate too, whatever the cosine.
A candidate counts if the longest common subsequence of words covers enough of the item and of its answer (its last sentence).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.llm._store import as_bytes, clean_name, map_arrow, slabs

#: Hashed terms, latent dimensions, and extra columns of the random sketch.
TERMS, RANK, EXTRA = 2048, 96, 8
#: Words of a block, and blocks of a passage.
STEP, SPAN = 8, 3
#: A candidate's least cosine; the least share of an item's words, and of its answer's, in common order; the share that needs no answer.
COSINE, SHARE, ANSWER, SURE = 0.5, 0.6, 0.5, 0.8
#: A copied run of the share of an item's words (so many at least, and at most that of an item of a passage's length) always makes a candidate.
LEAST_RUN = 3
#: Benchmark items that are held at once; more are searched in blocks of so many.
ITEMS_AT_ONCE = 20_000
_SEED = 77
_SLAB = 1 << 18
#: Item vectors, and passages, that one product of the cosine search takes.
TILE = 2048
_LETTER = np.array([48 <= c < 58 or 97 <= c < 123 or c >= 128 for c in range(256)])
_APART = bytes(c if _LETTER[c] else 32 for c in range(256))
_IS_LETTER = bytes(map(int, _LETTER))
#: Bytes beyond which a word is hashed by itself; masks of the first bytes of eight.
_LONG, _FIRST = 64, np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BASE = 0x9E3779B97F4A7C15


def lowered(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode()


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters and digits (bytes over 127 count as letters)."""
    return lowered(text).translate(_APART).split()


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any run of values follows."""
    up, down = _powers(1 << max(12, int(len(values)).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (see ``words_of``) of texts laid end to end, and how many words each text has."""
    low = [lowered(t) for t in texts]
    joined = b"".join([b"\n", *[part for t in low for part in (t, b"\n")], bytes(8)])
    edges = np.flatnonzero(np.diff(np.frombuffer(joined.translate(_IS_LETTER), np.int8))) + 1
    start, end = edges[0::2], edges[1::2]
    out, at, left = (end - start).astype(np.uint64), start, end - start
    eights = np.lib.stride_tricks.as_strided(np.frombuffer(joined, np.uint8), (len(joined) - 7, 8), (1, 1))
    alive = np.flatnonzero(left <= _LONG)
    at, left = at[alive], left[alive]
    while len(alive):
        chunk = eights[at].view(np.uint64).ravel() & _FIRST[np.minimum(left, 8)]
        out[alive] = _mix((out[alive] ^ chunk) * np.uint64(_BASE))
        more = left > 8
        alive, at, left = alive[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(end - start > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(joined[start[i] : end[i]])
    return out, np.diff(np.searchsorted(start, np.cumsum([1, *[len(t) + 1 for t in low]])))


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % TERMS


def term_ids(words: list[bytes]) -> np.ndarray:
    return terms_of(word_hashes([b" ".join(words)])[0])


def run_length(n: int) -> int:
    """Words of a run that makes an item of ``n`` words a candidate."""
    return max(LEAST_RUN, math.ceil(SHARE * min(n, STEP * SPAN)))


def run_hashes(sums: np.ndarray, down: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words, from the running sums of their hashes."""
    n = len(sums) - length
    return _mix((sums[length:] - sums[:n]) * down[:n]) if n > 0 else np.empty(0, np.uint64)


def _blocks(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists laid end to end, each cut into blocks of ``width``: starts of the blocks, each block's list, and its places as rows (places past a list's end are the total size)."""
    n = -(-sizes // width)
    owner = np.repeat(np.arange(len(sizes)), n)
    ends = np.cumsum(sizes)
    start = (ends - sizes)[owner] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * width
    places = np.arange(width)[:, None] + start
    places[places >= ends[owner]] = sizes.sum()
    return start, owner, places


def _summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows of ``table``: column ``i`` of ``rows`` lists those of sum ``i``."""
    out = np.empty((rows.shape[1], table.shape[1]), table.dtype)
    held = np.empty((512, table.shape[1]), table.dtype)
    for a in range(0, len(out), 512):
        part, total = rows[:, a : a + 512], out[a : a + 512]
        other = held[: len(total)]
        np.take(table, part[0], axis=0, out=total, mode="clip")
        for row in part[1:]:
            np.take(table, row, axis=0, out=other, mode="clip")
            total += other
    return out


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.concatenate((table, np.zeros((1, table.shape[1]), table.dtype)))


def add_passages(total: np.ndarray, test: np.ndarray, texts: list[bytes]) -> None:
    """Add the passages of some texts to ``total``: NᵀN W, the passages that have each term, and in the last column's first row all passages.  ``test`` is W with a last row of zeros."""
    columns = test.shape[1]
    hashes, sizes = word_hashes(texts)
    if not len(hashes):
        return
    ids = terms_of(hashes)
    start, _, places = _blocks(sizes, STEP * SPAN)
    sums = _with_zero(_summed(test, np.append(ids, TERMS)[places]))
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))[order]
    count = np.bincount(ids, minlength=TERMS)
    _, term, places = _blocks(count, 8)
    groups = _summed(sums, np.append(of, len(start))[places])
    at = np.flatnonzero(np.diff(term, prepend=-1))
    total[term[at], :columns] += np.add.reduceat(groups, at, axis=0)
    ids = ids[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])))
    total[:, columns] += np.bincount(ids[new], minlength=TERMS)
    total[0, columns + 1] += len(start)


def _tree_sum(parts: DataFrame, shape: tuple[int, ...], pieces: int, spread: int = 16) -> np.ndarray:
    """Sum of the arrays in ``(piece, salt, data)`` rows, in two levels; the result has a fixed size, whatever the input's."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                values = np.frombuffer(data.as_buffer(), np.float32)
                total[piece] = total[piece] + values if piece in total else values.astype(np.float32)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()])], ["piece", "salt", "data"])

    schema = "piece int, salt int, data binary"
    once = map_arrow(parts.withColumn("salt", F.col("salt") % spread).repartition("piece", "salt"), add, schema)
    out = np.zeros((pieces, int(np.prod(shape)) // pieces), np.float32)
    for row in map_arrow(once.repartition("piece"), add, schema).collect():
        out[row["piece"]] += np.frombuffer(row["data"], np.float32)
    return out.reshape(shape)


def _emit(total: np.ndarray, pieces: int) -> pa.RecordBatch:
    salt = TaskContext.get().partitionId()
    data = [x.tobytes() for x in total.astype(np.float32).reshape(pieces, -1)]
    return pa.record_batch([pa.array(range(pieces), pa.int32()), pa.array([salt] * pieces, pa.int32()), pa.array(data)], ["piece", "salt", "data"])


@dataclass(frozen=True)
class LatentSpace:
    """``to_latent`` maps term counts to whitened latent coordinates (IDF included)."""

    to_latent: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text", rank: int = RANK) -> LatentSpace:
        """Randomised factorisation of the passages' TF-IDF matrix A = N D (counts by IDF), over all documents, in one pass.

        The pass sums document frequencies and NᵀN W for a random W.  With the test matrix T = D⁻¹ W that is all that Nystrom's AᵀA ~ S (TᵀS)⁻¹ Sᵀ needs,
        since S = AᵀA T = D NᵀN W.  Passages are here those that share no block.
        """
        columns = rank + EXTRA
        test = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((TERMS, columns)))[0].astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((TERMS, columns + 2), np.float64)
            for batch in batches:
                for part in slabs(batch, "text", _SLAB):
                    add_passages(total, _with_zero(test), as_bytes(part.column(0)))
            yield _emit(total, 8)

        parts = map_arrow(clean_name(docs, text_col).toDF("text"), run, "piece int, salt int, data binary")
        return cls.solve(_tree_sum(parts, (TERMS, columns + 2), 8).astype(float), test, rank)

    @classmethod
    def solve(cls, total: np.ndarray, test: np.ndarray, rank: int) -> LatentSpace:
        """The space from the sums over all passages, see ``add_passages``."""
        columns = test.shape[1]
        idf = np.maximum(np.log((total[0, columns + 1] + 1) / (total[:, columns] + 1)), 1e-3)
        sketch, trial = idf[:, None] * total[:, :columns], test / idf[:, None]
        sketch += 1e-6 * max(np.linalg.norm(sketch), 1e-9) / np.linalg.norm(trial) * trial
        core = trial.T @ sketch
        low = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / len(core) * np.eye(len(core)))
        u, s, _ = np.linalg.svd(np.linalg.solve(low, sketch.T).T, full_matrices=False)
        u, s = u[:, :rank], s[:rank]
        return cls((idf[:, None] * u / np.maximum(s, 1e-3 * s[0])).astype(np.float32))


def word_masks(item: list[bytes]) -> dict[bytes, int]:
    """For each word the bits of its places in the item."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def in_order(masks: dict[bytes, int], other: list[bytes], least: float = 0) -> int:
    """Length of the longest common subsequence (bit-parallel) of an item, given by its masks, and other words; 0 if they share too few words for ``least``."""
    shared = list(filter(None, map(masks.get, other)))
    if len(shared) < least:
        return 0
    row = 0
    for m in shared:
        x = row | m
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def windows(lo: int, hi: int, n: int) -> Iterator[tuple[int, int]]:
    """Parts of a region in which a copy of ``n`` words, edited and with a quarter more words between them, lies whole: half as many words again and eight, a quarter of them apart."""
    size, step = n + n // 2 + 8, max(1, n // 4)
    for a in range(lo, max(lo, hi - size) + step, step):
        yield a, min(a + size, hi)


def common_subsequence(item: list[bytes], other: list[bytes]) -> int:
    """Length of the longest common subsequence of two lists of words."""
    return in_order(word_masks(item), other)


class Items:
    """Benchmark items with the latent vectors of their passages and the hashes of their runs."""

    def __init__(self, rows: list[tuple[object, str | None]], space: LatentSpace) -> None:
        self.space = space
        self.rows: list[tuple[object, int, dict[bytes, int], int, dict[bytes, int]]] = []
        vectors, owners = [], []
        runs: dict[int, list[tuple[np.ndarray, int]]] = {}
        width = STEP * SPAN
        for ident, text in rows:
            words = words_of((text or "").encode())
            if not words:
                continue
            last = [w for part in _SENTENCE.split(text.strip()) if (w := words_of(part.encode()))][-1:]
            answer = last[0] if last and len(last[0]) < len(words) else words[-5:]
            hashes, _ = word_hashes([b" ".join(words)])
            at = {*range(0, max(1, len(words) - width + 1), width), max(0, len(words) - width)}
            for s in sorted(at):
                vectors.append(space.to_latent[terms_of(hashes[s : s + width])].sum(0))
                owners.append(len(self.rows))
            length = run_length(len(words))
            runs.setdefault(length, []).append((np.unique(run_hashes(*_sums(hashes), length)), len(self.rows)))
            self.rows.append((ident, len(words), word_masks(words), len(answer), word_masks(answer)))
        v = np.array(vectors, np.float32).reshape(-1, space.to_latent.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        self.owners = np.array(owners, np.int64)
        self.short = np.flatnonzero(np.array([self.rows[i][1] < width for i in owners], bool))
        #: By length: the sorted hashes of runs, the items that they are of, and which leading 16 bits occur.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, own in runs.items():
            keys, of = np.concatenate([h for h, _ in own]), np.repeat([i for _, i in own], [len(h) for h, _ in own])
            order = np.argsort(keys, kind="stable")
            known = np.zeros(1 << 16, bool)
            known[keys >> np.uint64(48)] = True
            self.runs[length] = keys[order], of[order], known

    def _run_hits(self, hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(word, item number, words)`` of every run of an item in documents laid end to end; ``ends`` has each word's document's end."""
        sums, down = _sums(hashes)
        for length, (keys, of, known) in self.runs.items():
            own = run_hashes(sums, down, length)
            there = np.flatnonzero(known[own >> np.uint64(48)])
            there = there[there + length <= ends[there]]
            own = own[there]
            first, last = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
            hit = np.flatnonzero(first < last)
            for at, a, b in zip(there[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                for item in of[a:b].tolist():
                    yield at, item, length

    def _cosine(self, ids: np.ndarray, item: int) -> float:
        """The largest cosine of an item's passages to the given words."""
        v = self.space.to_latent[ids].sum(0)
        a, b = np.searchsorted(self.owners, [item, item + 1])
        return float((self.vectors[a:b] @ v).max() / max(np.linalg.norm(v), 1e-12))

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, float, float, float]]]:
        """For each text ``(item number, first word, end word, cosine, share, answer share)`` of every item that it leaks."""
        out: list[list[tuple[int, int, int, float, float, float]]] = [[] for _ in texts]
        hashes, sizes = word_hashes(texts)
        if not len(hashes) or not len(self.vectors):
            return out
        ids = terms_of(hashes)
        starts, owner, places = _blocks(sizes, STEP)
        sums = _summed(_with_zero(self.space.to_latent), np.append(ids, TERMS)[places])
        begin = np.cumsum(sizes) - sizes
        found: dict[tuple[int, int], list[tuple[int, float, int]]] = {}
        passage = sums.copy()
        for span in range(1, SPAN + 1):
            if span > 1:
                k = span - 1
                same = owner[k:] == owner[:-k]
                passage[:-k] += np.where(same[:, None], sums[k:], 0)
            # passages under the full length are for short items only
            columns = np.arange(len(self.vectors)) if span == SPAN else self.short
            if not len(columns):
                continue
            unit = passage / np.maximum(np.sqrt(np.einsum("ij,ij->i", passage, passage)), 1e-12)[:, None]
            for a in range(0, len(unit), TILE):
                for c in range(0, len(columns), TILE):
                    some = columns[c : c + TILE]
                    scores = (unit[a : a + TILE] @ self.vectors[some].T).ravel()
                    for place in np.flatnonzero(scores >= COSINE).tolist():
                        block, vector = a + place // len(some), some[place % len(some)]
                        doc = int(owner[block])
                        found.setdefault((doc, int(self.owners[vector])), []).append((int(starts[block] - begin[doc]), float(scores[place]), STEP * span))
        of_word = np.repeat(np.arange(len(sizes)), sizes)
        past: dict[tuple[int, int], int] = {}
        for at, item, length in self._run_hits(hashes, (begin + sizes)[of_word]):
            doc = int(of_word[at])
            # a run that overlaps the one before or lies in a passage that was found adds nothing to what is compared
            if at < past.get((doc, item), 0):
                continue
            past[doc, item] = at + length
            hits = found.setdefault((doc, item), [])
            place = int(at - begin[doc])
            if not any(h[0] <= place and place + length <= h[0] + h[2] for h in hits):
                hits.append((place, self._cosine(ids[at : at + length], item), length))
        each: dict[int, list[bytes]] = {}
        for (doc, item), hits in found.items():
            if doc not in each:
                each[doc] = words_of(texts[doc])
            _, n, words, n_answer, answer = self.rows[item]
            best = None
            hits.sort()
            at = 0
            while at < len(hits):
                to = at
                while to + 1 < len(hits) and hits[to + 1][0] - hits[to][0] <= n:
                    to += 1
                lo, hi = max(0, hits[at][0] - n), min(len(each[doc]), max(h[0] + h[2] for h in hits[at : to + 1]) + n)
                # hits may follow one another without end where a text has an item's topic: what is compared is no longer than an edited copy
                for a, b in windows(lo, hi, n) if in_order(words, each[doc][lo:hi], SHARE * n) >= SHARE * n else ():
                    share = in_order(words, each[doc][a:b], SHARE * n) / n
                    if share >= SHARE:
                        known = in_order(answer, each[doc][a:b]) / n_answer
                        if known >= ANSWER or share >= SURE:
                            row = (item, a, b, max(h[1] for h in hits[at : to + 1]), share, known)
                            best = row if best is None or row[4] > best[4] else best
                at = to + 1
            if best:
                out[doc].append(best)
        return out


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, space: LatentSpace, at_once: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``at_once`` items each, so that what a worker holds is bounded."""
    rows = clean_name(benchmark, item_col, text_col).toDF("item", "text").where("text is not null").distinct()
    blocks = -(-rows.count() // at_once)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        yield Items(sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1])), space)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", at_once: int = ITEMS_AT_ONCE
) -> DataFrame:
    """``(id, item, first_word, end_word, cosine, share, answer_share)``: a row for every row of ``docs`` and every benchmark item that it leaks.

    Of an item's places in a text the one with the largest share counts, the first of several; a place is no longer than an edited copy (``windows``), so a long text that has an item's
    words in another order leaks nothing.  Very long texts are searched whole, in one slab each.
    Places are words (runs of letters and digits); the cosine is that of the best passage, or of the run that made the candidate.  Null and empty texts and items leak nothing.  Repeated rows of ``docs`` each give their rows; repeated
    items count once; an empty table on either side gives an empty result; other columns are ignored.
    """
    source = clean_name(docs, id_col, text_col).toDF("id", "text")
    space = LatentSpace.fit(source)
    kind = source.schema["id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {item_col} {item_kind}, first_word long, end_word long, cosine double, share double, answer_share double"
    found = source.sparkSession.createDataFrame([], schema)
    names = found.columns
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    for items in _item_blocks(benchmark, item_col, item_text_col, space, at_once):

        held = source.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast[Items] = held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                rows = []
                for part in slabs(batch, "text", _SLAB):
                    for ident, leaks in zip(part.column(0).to_pylist(), items.search(as_bytes(part.column(1))), strict=True):
                        rows += [(ident, items.rows[i][0], *rest) for i, *rest in leaks]
                kinds = [batch.schema.types[0], item_type, *[pa.int64()] * 2, *[pa.float64()] * 3]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        found = found.unionByName(map_arrow(source, run, schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no benchmark item (see ``find_leaks``).

    Null and empty texts leak nothing and stay; repeated rows go or stay together; very long texts are searched whole; an empty table on either side gives back ``docs``.
    """
    space = LatentSpace.fit(docs, text_col)
    kept = docs
    at = docs.columns.index(text_col)
    names = docs.columns
    for items in _item_blocks(benchmark, item_col, item_text_col, space, at_once):

        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast[Items] = held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                clean = [not leaks for part in slabs(batch, names[at], _SLAB) for leaks in items.search(as_bytes(part.column(at)))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
