"""Token ids as Parquet lists: one row per document, in id order, with row groups, pages and encodings chosen for selective reads.

A file holds ``(shard, doc_id, at, n_tokens, ids)``: the number of the task that has written it, the document, the ids before it in its file, its number of ids
and the ids.  Ids are dictionary-encoded (a vocabulary fits into one dictionary page, so an id takes the bits that the vocabulary needs); the other columns are
delta-encoded.  Row groups are small enough for one task each, pages hold few rows, and Parquet's page index lists the range of each, so that a reader of some
documents opens only their pages, and a reader of lengths opens no ids at all.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm._store import clean_name, delete, map_arrow, materialise, shared_dir, slabs

VOCABULARY = "byte_bpe_50k.json"
#: Ends each document.
END = 2
ROW_GROUP_BYTES = 1 << 24
PAGE_BYTES = 1 << 16
PAGE_ROWS = 256
#: Words of which a worker remembers the ids, in each of two generations, and the longest of them.
MEMORY_WORDS, MEMORY_LENGTH = 1 << 18, 64

#: Single spaces between other characters part a text; a space beside other white space belongs to a longer run.
_PARTS = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")
#: Bytes of texts that are cut into words at once.
SLAB = 1 << 22
#: Characters of new words that the library sees in one call.
CALL_LENGTH = 1 << 15


#: Marks that end a word after a letter are a token or tokens of their own.
MARKS = ".,;:!?"
#: Texts of more bytes go through the library whole.
LONG = 1 << 28


def _odd(words: pa.Array) -> np.ndarray:
    """The words beside which a single space or line end may not be where a text can be cut: empty ones, and those with white space at an end."""
    body = pc.if_else(pc.starts_with(words, " "), pc.utf8_slice_codeunits(words, 1), words)
    fine = pc.and_(pc.and_(pc.equal(pc.utf8_trim_whitespace(body), body), pc.greater(pc.binary_length(body), 0)), pc.invert(pc.match_substring(words, "\u180e")))
    return ~pc.or_(fine, pc.equal(words, "\n")).to_numpy(zero_copy_only=False)


def _stems(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Words without the marks behind a last letter of ASCII or Latin-1, the places of those that had some, and these marks."""
    stems = pc.utf8_rtrim(words, MARKS)
    size, whole = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (stems, words))
    some = np.flatnonzero((size < whole) & (size > 0))
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)].astype(np.int64)[some]
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(some) else np.empty(0, np.uint8)
    size, whole = size[some], whole[some]
    last = data[offsets + size - 1]
    # in UTF-8 the letters from U+00C0 to U+00FF are C3 and a second byte, but for two signs
    before = np.where(size > 1, data[np.maximum(offsets + size - 2, 0)], 0)
    letter = (((last | 32) >= ord("a")) & ((last | 32) <= ord("z")) & (last < 128)) | ((before == 0xC3) & (last >= 128) & (last != 0x97) & (last != 0xB7))
    some, spans = some[letter], np.stack(((offsets + size)[letter], (offsets + whole)[letter]), 1).astype(np.int32)
    cut = np.zeros(len(words), bool)
    cut[some] = True
    # marks and what lies between them, by turns
    turns = pa.StringArray.from_buffers(max(0, spans.size - 1), pa.py_buffer(spans.ravel()), words.buffers()[2] or pa.py_buffer(b"")) if len(some) else pa.array([], pa.string())
    return pc.if_else(pa.array(cut), stems, words), some, turns.take(pa.array(np.arange(0, len(turns), 2)))


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids end to end as one binary value for each end."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int64)), pa.py_buffer(ids)])


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, cut before single spaces and on both sides of line ends, as views of the texts; where each text's words end, and which texts have white space that isn't single."""
    begin = np.frombuffer(texts.buffers()[1] or bytes(4), np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2] or pa.py_buffer(b"")
    data = np.frombuffer(held, np.uint8)[begin[0] : begin[-1]]
    line = data == ord("\n")
    white = line | (data == ord(" "))
    first, last = begin[:-1] - begin[0], begin[1:] - begin[0]
    # white space beside white space, both in one text
    double = np.flatnonzero(white[1:] & white[:-1]) + 1
    owner = np.searchsorted(last, double, side="right")
    apart = np.zeros(len(texts), bool)
    apart[owner[first[owner] < double]] = True
    full = first < last
    apart[full] |= white[first[full]] | white[last[full] - 1]
    # a word begins at each space or line end, behind each line end and with each text
    white[1:] |= line[:-1]
    white[first[full]] = True
    at = np.flatnonzero(white)
    offsets = np.append(at, len(data)).astype(np.int32) + begin[0]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), held), np.searchsorted(at, last), apart


class Memory:
    """Words and their ids, as Arrow arrays that batches of words are looked up in."""

    def __init__(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def __len__(self) -> int:
        return len(self.words)

    def __contains__(self, word: str) -> bool:
        return pc.index(self.words, word).as_py() >= 0

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 for words that aren't here."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: pa.Array, ids: pa.Array) -> None:
        # long words are rare and would fill the memory
        short = pc.less_equal(pc.utf8_length(words), MEMORY_LENGTH)
        self.words, self.ids = pa.concat_arrays([self.words, words.filter(short)]), pa.concat_arrays([self.ids, ids.filter(short)])


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, by the tokenizers library.

    No token of this vocabulary reaches over a single space between two other characters, except by beginning with it, nor over a single line end, nor from a
    letter into the marks behind it.  So texts are cut there, each distinct word goes through the library once, many in one call, and its ids are remembered for the texts that follow.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))
        names = self.library.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(names.values()) + 1, bool)
        # the byte-level alphabet writes a space so
        self.begins[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids[0]
        self.recent, self.older = Memory(), Memory()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: pa.Array, between: str) -> pa.Array:
        """The ids of each word: all begin with a space, as only their first ids do (``between`` is empty), or none does and line ends go between them."""
        sizes = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + len(between))
        out, at = [pa.array([], pa.large_binary())], 0
        while at < len(words):
            upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CALL_LENGTH)) + 1
            part = words[at:upto]
            at += len(part)
            (ids,) = self._ids([pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), between)[0].as_py()])
            found = np.frombuffer(ids, "<u4")
            own = found != self.line_end if between else np.ones(len(found), bool)
            starts = np.append(0, np.cumsum(own)[~own]) if between else np.flatnonzero(self.begins[found])
            if len(starts) == len(part):
                out.append(_lists(found[own], np.append(starts[1:], own.sum())))
            else:
                out.append(pa.array(self._ids(part.to_pylist()), pa.large_binary()))
        return pa.concat_arrays(out)

    def _remember(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, a space before them included, known ones from memory."""
        if len(self.recent) > MEMORY_WORDS:
            self.recent, self.older = Memory(), self.recent
        known, place = [self.recent.ids], self.recent.find(words)
        base = len(self.recent)

        def add(where: np.ndarray, ids: pa.Array, names: pa.Array) -> None:
            nonlocal base
            place[where] = base + np.arange(len(where))
            base += len(where)
            known.append(ids)
            self.recent.add(names, ids)

        absent = np.flatnonzero(place < 0)
        names = words.take(pa.array(absent))
        before = self.older.find(names)
        some = np.flatnonzero(before >= 0)
        add(absent[some], self.older.ids.take(pa.array(before[some])), names.take(pa.array(some)))
        for spaced in (True, False):
            new = np.flatnonzero((before < 0) & (pc.starts_with(names, " ").to_numpy(zero_copy_only=False) == spaced))
            part = names.take(pa.array(new))
            add(absent[new], self._joined(part, "" if spaced else "\n"), part)
        return pa.concat_arrays(known).take(pa.array(place))

    def _slowly(self, text: str) -> bytes:
        """A text with runs of white space."""
        first, *words = _PARTS.split(text)
        return b"".join(self._ids([first]) + self._ids([" " + w for w in words]))

    def flat(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, with ``end`` behind each, and how many each text has; a null is empty.  Words are told apart by Arrow, so Python sees each once a call."""
        texts = pc.fill_null(texts, "")
        apart = pc.greater(pc.binary_length(texts), LONG).to_numpy(zero_copy_only=False).copy()
        cut, ends, double = _cut(pc.if_else(pa.array(apart), "", texts) if apart.any() else texts)
        apart |= double
        coded = cut.dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        odd = _odd(words)
        if odd.any():
            apart[np.searchsorted(ends, np.flatnonzero(odd[at]), side="right")] = True
            words = pc.if_else(pa.array(odd), "-", words)
        stems, some, marks = _stems(words)
        stems = stems.dictionary_encode()
        # a word's ids are those of its stem and of the marks behind it; a slab has few different marks
        marks = marks.dictionary_encode()
        parts = pa.concat_arrays([self._remember(stems.dictionary), pa.array([b"", *self._ids(marks.dictionary.to_pylist())], pa.large_binary())])
        both = np.full((len(words), 2), len(stems.dictionary))
        both[:, 0] = stems.indices.to_numpy()
        both[some, 1] += 1 + marks.indices.to_numpy()
        pool = parts.take(pa.array(both.ravel()))
        pool = _lists(np.frombuffer(pool.buffers()[2] or b"", "<u4"), np.frombuffer(pool.buffers()[1], np.int64)[2 : 2 * len(words) + 1 : 2] // 4)
        slow = [self._slowly(texts[i].as_py()) for i in np.flatnonzero(apart).tolist()]
        # behind each text's words its ids if it was not cut, and the end
        sizes = np.diff(ends, prepend=0)
        at = at[np.repeat(~apart, sizes)]
        closed = np.cumsum(np.where(apart, 0, sizes))
        more = np.full(len(texts) + len(slow), len(pool))
        more[np.flatnonzero(apart) + np.arange(len(slow))] = len(pool) + 1 + np.arange(len(slow))
        got = pa.concat_arrays([pool, pa.array([end, *slow], pa.large_binary())]).take(pa.array(np.insert(at, np.repeat(closed, 1 + apart), more)))
        upto = np.frombuffer(got.buffers()[1], np.int64)[np.append(0, closed + np.cumsum(1 + apart))] // 4 if len(texts) else np.zeros(1, np.int64)
        return np.frombuffer(got.buffers()[2], "<u4")[: upto[-1]] if upto[-1] else np.empty(0, "<u4"), np.diff(upto)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null is empty."""
        ids, sizes = self.flat(texts)
        ends = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


@lru_cache(1)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The worker's encoder; it outlives a task, and so do the words that it remembers."""
    return Encoder(vocabulary)


def layout(row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """Options of Spark's Parquet writer for token tables."""
    return {
        "compression": "zstd",
        # second version: whole numbers without a dictionary are delta-encoded
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.block.size": str(row_group_bytes),
        "parquet.block.size.row.check.min": "16",
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.page.size.row.check.min": "16",
    }


def write_token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, **how: int) -> None:
    """Encode ``docs`` into Parquet files under ``path``, ascending by id through all files; ``how`` goes to ``layout``.

    Null texts are empty; an empty text is its end id alone.  Null ids come first.  Rows of one id follow the table's order, each with a place of its own, so many of
    them are dealt out like any others.  A text is one row however long it is.  An empty table makes a folder without rows.
    """
    placed = clean_name(docs, id_col, text_col).toDF("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    # the row's number parts what has one id
    ranged = placed.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, last, shard, at = encoder(vocabulary).flat, np.array([end], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slabs(batch, "text", SLAB):
                ids, sizes = flat(part.column(1), last)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.record_batch([pa.array(np.full(part.num_rows, shard, np.int32)), part.column(0), pa.array(at + ends - sizes), pa.array(sizes), lists], ["shard", "doc_id", "at", "n_tokens", "ids"])
                at += int(ends[-1])

    kind = ranged.schema["doc_id"].dataType.simpleString()
    map_arrow(ranged, run, f"shard int, doc_id {kind}, at long, n_tokens long, ids array<int>").write.options(**layout(**how)).parquet(path)


def file_bases(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, base, size)``: how many ids a file has and how many the files before it have; reads no ids."""
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.max(F.col("at") + F.col("n_tokens")).alias("size"))
    # one row per file
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("shard", F.coalesce(before, F.lit(0)).alias("base"), "size")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens)`` of every document, from the metadata columns alone."""
    rows = spark.read.parquet(path).select("shard", "doc_id", "at", "n_tokens")
    return rows.join(F.broadcast(file_bases(spark, path)), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens")


def read_documents(spark: SparkSession, path: str, first: object, last: object) -> DataFrame:
    """``(doc_id, ids)`` of the documents from ``first`` to ``last``: the scan skips files, row groups and pages outside."""
    return spark.read.parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def read_span(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """``(doc_id, start, ids)``: what each document has of the ids ``begin`` to ``end`` (exclusive) of the whole table, ``start`` being the place of its first one here.

    The files that hold them are found by their sizes; inside a file the place before a document is a sorted column, so other pages stay closed.
    """
    held = file_bases(spark, path).where((F.col("base") < end) & (F.col("base") + F.col("size") > begin)).orderBy("shard").collect()
    rows = spark.read.parquet(path)
    parts = None
    if not held:
        return rows.select("doc_id", F.col("at").alias("start"), "ids").where("false")
    # whole files in the middle need no places
    inner = [r for r in held if r["base"] >= begin and r["base"] + r["size"] <= end]
    edges = [r for r in held if r not in inner]
    if inner:
        middle = rows.where(F.col("shard").between(inner[0]["shard"], inner[-1]["shard"])).join(F.broadcast(file_bases(spark, path)), "shard")
        parts = middle.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")
    for r in edges:
        base = int(r["base"])
        found = rows.where((F.col("shard") == r["shard"]) & (F.col("at") < end - base)).where(F.col("at") + F.col("n_tokens") > begin - base)
        skip = F.greatest(F.lit(begin - base) - F.col("at"), F.lit(0)).cast("int")
        size = F.least(F.col("n_tokens"), F.lit(end - base) - F.col("at")).cast("int") - skip
        own = found.select("doc_id", (F.col("at") + base + skip).alias("start"), F.slice("ids", skip + 1, size).alias("ids"))
        parts = own if parts is None else parts.unionByName(own)
    return parts


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, the checksum over its ids as they are read back."""
    rows = spark.read.parquet(path).select("shard", "doc_id", "at", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    summed = map_arrow(rows, run, f"shard int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return summed.join(F.broadcast(file_bases(spark, path)), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encoded_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, **how: int) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)``: ``docs`` written as a token table into the shared folder, read back, and the files deleted.

    Nulls, empty and very long texts, repeated rows and empty tables as in ``write_token_table``; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-tables/{uuid.uuid4().hex}"
    write_token_table(docs, path, id_col, text_col, vocabulary, end, **how)
    found = materialise(id_digests(spark, path).withColumnRenamed("doc_id", id_col))
    delete(spark, path)
    return found
