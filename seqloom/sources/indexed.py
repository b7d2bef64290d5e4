"""Records of indexed sequence files by name: only the blocks that hold them are read.

An index lists ``name, offset, size`` of each record, in bytes of the plain text.  A block-compressed file is a chain of gzip members of at most 64 KiB of text, each with its own
compressed size in its header, so any of them can be inflated alone; where they begin is in a second index (``.gzi``), or is found from header to header.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of plain text whose records one task reads.
GROUP_BYTES = 1 << 24


class Blocks:
    """The text of a block-compressed file by place; a plain file is read as it is."""

    def __init__(self, path: str, starts: np.ndarray | None) -> None:
        system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(name)
        self.starts, self.bytes_read = starts, 0

    def _take(self, at: int, n: int) -> bytes:
        got = self.file.read_at(n, at)
        self.bytes_read += len(got)
        return got

    def block_size(self, at: int) -> int:
        """Compressed bytes of the block at a place; 0 behind the last one."""
        head = self._take(at, 12)
        if len(head) < 12:
            return 0
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block-compressed file")
        extra = self._take(at + 12, struct.unpack("<H", head[10:12])[0])
        i = 0
        while i + 4 <= len(extra):
            kind, n = extra[i : i + 2], struct.unpack("<H", extra[i + 2 : i + 4])[0]
            if kind == b"BC":
                return struct.unpack("<H", extra[i + 4 : i + 6])[0] + 1
            i += 4 + n
        raise ValueError("a block without its size")

    def index(self) -> np.ndarray:
        """``(compressed, plain)`` places of all blocks, from header to header."""
        at = plain = 0
        found = []
        while size := self.block_size(at):
            found.append((at, plain))
            plain += struct.unpack("<I", self._take(at + size - 4, 4))[0]
            at += size
        return np.array(found, np.int64).reshape(-1, 2)

    def read(self, offset: int, size: int) -> bytes:
        if self.starts is None:
            return self._take(offset, size)
        k = bisect_right(self.starts[:, 1].tolist(), offset) - 1
        out, skip = b"", offset - int(self.starts[k, 1])
        while len(out) < skip + size and k < len(self.starts):
            at = int(self.starts[k, 0])
            end = int(self.starts[k + 1, 0]) if k + 1 < len(self.starts) else at + self.block_size(at)
            out += zlib.decompress(self._take(at, end - at), wbits=31)
            k += 1
        return out[skip : skip + size]


def read_gzi(path: str) -> np.ndarray:
    """Places of all blocks from a ``.gzi`` file, which leaves out the first."""
    with Blocks(path, None).file as f:
        content = f.read()
    n = struct.unpack("<Q", content[:8])[0]
    return np.concatenate([[[0, 0]], np.frombuffer(content, "<u8", 2 * n, 8).reshape(-1, 2).astype(np.int64)])


def read_indexed(spark: SparkSession, path: str, index: DataFrame, names: DataFrame, gzi: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(name, seq, bytes_read)`` of the records of ``names`` ``(name)`` that ``index`` ``(name, offset, size)`` has, from a plain or block-compressed FASTA file that all executors see.

    Records are read in groups of neighbouring blocks, each a task's own; ``bytes_read`` is what a task has read of the file until it had a record.  A name asked for several times is read once, names
    that the index lacks are left out, and a record whose text doesn't begin with its header fails the query.
    """
    compressed = path.endswith((".gz", ".bgz"))
    starts = None if not compressed else read_gzi(gzi) if gzi else Blocks(path, None).index()
    wanted = index.join(names.select("name").distinct(), "name", "left_semi").withColumn("group", F.floor(F.col("offset") / group_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(path, starts)
        for batch in batches:
            for name, offset, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = blocks.read(offset, size).decode()
                head, _, body = text.partition("\n")
                if not head.startswith(">") or head[1:].split()[:1] != [name]:
                    raise ValueError(f"the index has another record in place of {name}")
                yield pa.record_batch([pa.array([name]), pa.array(["".join(body.split())]), pa.array([blocks.bytes_read], pa.int64())], ["name", "seq", "bytes_read"])

    dealt = wanted.repartition("group").sortWithinPartitions("group", "offset").select("name", "offset", "size")
    return dealt.mapInArrow(run, "name string, seq string, bytes_read long")
