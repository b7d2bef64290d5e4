"""Token counts from flat token files, by a separator scan.

A token file is a bare stream of 16-bit big-endian ids without index or header; a separator id ends each document.  The scan
cuts files into blocks, searches each block for separators at once, and stitches documents that cross blocks with two prefix
scans over the block summaries: a running count of separators (which document) and a running maximum of the last
separator's place (where it began).  The task that writes a token file also lists, beside it, whose documents it has written.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm._store import clean_name, delete, exists, map_arrow, materialise, shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ends each document: beyond the vocabulary, and its two bytes are one UTF-8 character, so Spark's text writer can put it after each row.
SEPARATOR = 50304
#: Tokens that one block has.
BLOCK = 1 << 20
#: Bytes after which a task begins another file, so that a file stays far below what one row can hold.
FILE_BYTES = 1 << 25
#: Files that a task may have: all stay open until it ends.
TASK_FILES = 1024
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@lru_cache(2)
def tokenizer(path: str = VOCABULARY, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, file_bytes: int = FILE_BYTES) -> None:
    """Tokenise ``docs`` into flat files under ``path/kind=tokens``, documents in row order, and list ``(shard, file, ordinal, id)`` of each document under ``path/kind=ids``.

    Null and empty texts become a bare separator.  One task writes both, in one go, so that lists and files agree whatever order another read of ``docs`` would have;
    Spark's own writer commits them, so retried tasks leave nothing behind.  A task's files are numbered; each ends after the document that fills it.
    """
    source = clean_name(docs, id_col, text_col).toDF("id", "text")
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        shard = TaskContext.get().partitionId()
        file = ordinal = size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows, files, ordinals, held, first = [], [], [], 0, at
                while at < batch.num_rows and held < 1 << 22:
                    if size >= file_bytes:
                        file, ordinal, size = file + 1, 0, 0
                        if file == TASK_FILES:
                            raise ValueError("a partition has too many tokens for one task's files; read the table in smaller partitions")
                    rows.append(np.array(encode(batch.column(1)[at].as_py() or ""), ">u2").tobytes())
                    files.append(file)
                    ordinals.append(ordinal)
                    size, held, ordinal, at = size + len(rows[-1]) + 2, held + len(rows[-1]), ordinal + 1, at + 1
                columns = [pa.array([shard] * len(rows), pa.int32()), pa.array(files, pa.int32()), pa.array(ordinals, pa.int64()), pa.array(rows, pa.binary())]
                yield pa.record_batch([batch.column(0).slice(first, len(rows)), *columns], ["id", "shard", "file", "ordinal", "ids"])

    ids = map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, shard int, file int, ordinal long, ids binary")
    end = SEPARATOR.to_bytes(2, "big").decode()
    both = ids.select(
        "file",
        F.explode(
            F.array(
                F.struct(F.lit("tokens").alias("kind"), F.col("ids").cast("string").alias("value")),
                F.struct(F.lit("ids").alias("kind"), F.replace(F.to_json(F.struct("shard", "file", "ordinal", "id")), F.lit(end), F.lit(f"\\u{ord(end):04x}")).alias("value")),
            )
        ).alias("r"),
    )
    before = spark.conf.get(_OPEN_FILES, None)
    # rows go straight to their files: sorting them by file first would lose their order and spill them all
    spark.conf.set(_OPEN_FILES, str(2 * TASK_FILES))
    try:
        both.select("r.kind", "file", "r.value").write.partitionBy("kind", "file").option("lineSep", end).text(path)
    finally:
        if before is None:
            spark.conf.unset(_OPEN_FILES)
        else:
            spark.conf.set(_OPEN_FILES, before)


def read_ids(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(shard, file, ordinal, id)`` of every document, as ``write_token_files`` has listed them; ``kind`` is the type of the ids."""
    lines = spark.read.schema("value string").option("recursiveFileLookup", "true").option("lineSep", SEPARATOR.to_bytes(2, "big").decode()).text(f"{path}/kind=ids")
    return lines.select(F.from_json("value", f"shard int, file int, ordinal long, id {kind}").alias("r")).select("r.*")


def shard_of(path: Column) -> Column:
    """The number of the task that has written a file, from the file's name."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^part-(\d+)-", 1).cast("int")


def file_of(path: Column) -> Column:
    """The file's number among those of its task, from its folder's name."""
    return F.regexp_extract(F.substring_index(path, "/", -2), r"^file=(\d+)/", 1).cast("int")


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK, separator: int = SEPARATOR) -> DataFrame:
    """``(path, block, begin, size, ends)``: for each block of each file the places, in the file, just after its separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer() or b"", ">u2")
                for k, begin in enumerate(range(0, len(ids), block)):
                    part = ids[begin : begin + block]
                    ends = np.flatnonzero(part == separator) + (begin + 1)
                    yield pa.record_batch(
                        [pa.array([name.as_py()]), pa.array([k], pa.int64()), pa.array([begin], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                        ["path", "block", "begin", "size", "ends"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return map_arrow(files, run, "path string, block long, begin long, size long, ends array<long>")


def document_spans(blocks: DataFrame) -> DataFrame:
    """``(path, ordinal, start, n_tokens, terminated)`` for every document of the files, from their block summaries.

    Two prefix scans over a file's blocks: separators so far, and the end of the last one.  A document may cross any number of blocks.
    Tokens after a file's last separator are a last document that is not ``terminated``.
    """
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.withColumns(
        {
            "first": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"),
            "open": F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(0)).cast("long"),
        }
    )
    ended = scanned.select("path", "first", "open", "ends", F.posexplode("ends").alias("i", "end")).select(
        "path",
        (F.col("first") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.element_at("ends", F.greatest(F.col("i"), F.lit(1)))).alias("start"),
        "end",
    )
    rest = (
        blocks.groupBy("path")
        .agg(F.sum("size").alias("size"), F.sum(F.size("ends")).cast("long").alias("ordinal"), F.coalesce(F.max(F.array_max("ends")), F.lit(0)).alias("start"))
        .where("size > start")
    )
    return ended.select("path", "ordinal", "start", (F.col("end") - F.col("start") - 1).alias("n_tokens"), F.lit(True).alias("terminated")).unionByName(
        rest.select("path", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    )


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block: int = BLOCK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``(id, shard, file, ordinal, start_token, n_tokens)``, one row per row of ``docs``, by way of flat token files in the shared folder.

    The files have no index; a document's place in them is its number among the separators of its file, and whose place it is the list of ids tells that the
    same task has written.  A listed document that the scan doesn't find fails the query.  Null and empty texts have no tokens; very long texts cross as
    many blocks as they fill; repeated rows each have their own place; null ids stay null; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_token_files(docs, path, id_col, text_col, vocabulary, file_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    if not exists(spark, f"{path}/kind=tokens"):
        return spark.createDataFrame([], f"`{id_col}` {kind}, shard int, file int, ordinal long, start_token long, n_tokens long")
    found = document_spans(read_blocks(spark, f"{path}/kind=tokens", block)).select(shard_of(F.col("path")).alias("shard"), file_of(F.col("path")).alias("file"), "ordinal", "start", "n_tokens")
    joined = read_ids(spark, path, kind).join(found, ["shard", "file", "ordinal"], "left")
    counted = materialise(
        joined.select(
            F.col("id").alias(id_col),
            "shard",
            "file",
            "ordinal",
            F.col("start").alias("start_token"),
            F.coalesce("n_tokens", F.raise_error(F.lit("a document is missing from its token file")).cast("long")).alias("n_tokens"),
        )
    )
    delete(spark, path)
    return counted
