"""Operators on sequence records, each a row with a name and a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.ranges import parse_range, parse_region
from seqloom.functions.sequence import AMINO_ACIDS, CODON_ORDER, reverse_complement, simplify_name, upper_ascii
from seqloom.functions.shared import spread
from seqloom.operators.prefix import running_sum


def size(records: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    return records.select(name, F.length(seq).alias("size"))


def count_bases(records: DataFrame, name: str = "name", seq: str = "seq", bases: str = "ACGTN") -> DataFrame:
    """Letters of each kind, either case, by record, and a last row ``total``."""
    counts = [F.regexp_count(seq, F.lit(f"[{b}{b.lower()}]")).cast("long").alias(f"n_{b.lower()}") for b in bases]
    each = records.select(F.col(name).cast("string").alias("name"), F.length(seq).cast("long").alias("len"), *counts)
    total = each.agg(*[F.sum(c).alias(c) for c in each.columns[1:]]).select(F.lit("total").alias("name"), *each.columns[1:])
    return each.unionByName(total)


def runs(records: DataFrame, name: str = "name", seq: str = "seq", symbols: str = "a-zN") -> DataFrame:
    """``(name, start, end)``, from 1 and inclusive, of each maximal run of symbols (lower case and N: what is masked)."""
    # several records may have one name
    own = records.select(F.monotonically_increasing_id().alias("_row"), name, seq)
    parts = own.select("_row", name, F.posexplode(F.regexp_extract_all(seq, F.lit(f"([{symbols}]+|[^{symbols}]+)"), 0)).alias("i", "part"))
    end = F.sum(F.length("part")).over(Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("end", end).withColumn("start", F.col("end") - F.length("part") + 1)
    return placed.where(F.col("part").rlike(f"^[{symbols}]")).select(name, "start", "end")


def nx(records: DataFrame, seq: str = "seq", percents: tuple[int, ...] = (50,)) -> DataFrame:
    """One row: Nx for each percentage, sum, average, E-size and count.  Records are first counted by length, so the window runs over distinct lengths."""
    lengths = records.select(F.length(seq).cast("long").alias("len")).groupBy("len").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.col("len").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = lengths.withColumn("reached", F.sum(F.col("len") * F.col("n")).over(down)).withColumn("whole", F.sum(F.col("len") * F.col("n")).over(Window.partitionBy(F.lit(1))))
    parts = [F.max(F.when(F.col("reached") * 100 >= F.col("whole") * p, F.col("len"))).alias(f"n{p}") for p in percents]
    mass = F.sum(F.col("len") * F.col("n"))
    return ranked.agg(
        *parts,
        mass.alias("sum"),
        F.round(mass / F.sum("n"), 4).alias("avg"),
        F.round(F.sum((F.col("len") * F.col("len") * F.col("n")).cast("double")) / mass, 4).alias("e_size"),
        F.sum("n").alias("count"),
    )


def one(records: DataFrame, value: object, name: str = "name") -> DataFrame:
    return records.where(F.col(name) == F.lit(value))


def some(records: DataFrame, names: DataFrame, name: str = "name", invert: bool = False) -> DataFrame:
    return records.join(names.select(name), name, "left_anti" if invert else "left_semi")


def in_order(records: DataFrame, listed: DataFrame, name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """Listed records with the list's ordinal, by which a writer sorts."""
    return listed.select(name, ordinal).join(records, name)


def split_about(records: DataFrame, about: int, order: str = "name", seq: str = "seq") -> DataFrame:
    """Records with a ``chunk`` number, a new one once ``about`` symbols came before."""
    sized = records.withColumn("_len", F.length(seq).cast("long"))
    return running_sum(sized, [order], "_len", "_reached").withColumn("chunk", F.floor((F.col("_reached") - F.col("_len")) / about)).drop("_len", "_reached")


def split_by_name(records: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    """One folder of FASTA files for each record name."""
    lines = records.select(F.col(name).alias("name"), F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))
    lines.write.partitionBy("name").mode("errorifexists").text(path)


def replace_names(records: DataFrame, mapping: DataFrame, name: str = "name", new: str = "new_name") -> DataFrame:
    return records.join(mapping.select(name, F.col(new).alias("_new")), name, "left").withColumn(name, F.coalesce("_new", F.col(name).cast("string"))).drop("_new")


def reverse_complements(records: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    return records.withColumns({name: F.concat(F.lit("RC_"), F.col(name).cast("string")), seq: reverse_complement(F.col(seq))})


def filter_records(
    records: DataFrame, name: str = "name", seq: str = "seq", least: int = 0, most: int | None = None, unique: bool = False, upper: bool = False, iupac: bool = False, simplify: bool = False, order: str | None = None
) -> DataFrame:
    """Records by length, made unique by name (the first by ``order``), upper-cased, with odd symbols as N, or with names cut short."""
    out = records.where(F.length(seq) >= least)
    if most is not None:
        out = out.where(F.length(seq) <= most)
    if simplify:
        out = out.withColumn(name, simplify_name(F.col(name)))
    if unique:
        by = order or seq
        out = out.groupBy(name).agg(F.min_by(F.struct(*[c for c in out.columns if c != name]), F.col(by)).alias("_r")).select(name, "_r.*")
    if upper:
        out = out.withColumn(seq, upper_ascii(F.col(seq)))
    if iupac:
        out = out.withColumn(seq, F.regexp_replace(seq, "[^ACGTRYMKSWHBVDNacgtrymkswhbvdn-]", "N"))
    return out


def _copy_key(name: str, seq: str, by: str, both_strands: bool, ignore_case: bool) -> Column:
    """What copies share, as a digest: that keeps the sequences themselves out of the shuffle."""
    key: Column = F.col(name if by == "name" else seq)
    if ignore_case:
        key = upper_ascii(key)
    if both_strands:
        key = F.least(key, reverse_complement(key))
    return F.sha2(key.cast("string"), 256)


def dedup(records: DataFrame, name: str = "name", seq: str = "seq", by: str = "seq", both_strands: bool = False, ignore_case: bool = False) -> DataFrame:
    """``(name, n_copies)`` of the first record of each group of equal names or sequences, either strand if asked."""
    return records.select(_copy_key(name, seq, by, both_strands, ignore_case).alias("k"), name).groupBy("k").agg(F.min(name).alias(name), F.count("*").alias("n_copies")).drop("k")


def duplicates(records: DataFrame, name: str = "name", seq: str = "seq", by: str = "seq", both_strands: bool = False, ignore_case: bool = False) -> DataFrame:
    """``(kept, dropped)`` pairs of records with different names, the report of ``dedup``."""
    keyed = records.select(_copy_key(name, seq, by, both_strands, ignore_case).alias("k"), F.col(name))
    first = keyed.groupBy("k").agg(F.min(name).alias("kept"))
    return keyed.join(first, "k").where(F.col(name) != F.col("kept")).select("kept", F.col(name).alias("dropped"))


def mask(records: DataFrame, regions: DataFrame, name: str = "name", seq: str = "seq", hard: bool = False) -> DataFrame:
    """Records with regions ``(name, start, end)`` in lower case, or as N."""
    by_record = regions.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_r"))
    one_region = lambda s, r: F.overlay(
        s,
        F.repeat(F.lit("N"), (F.least(r["end"], F.length(s)) - r["start"] + 1).cast("int")) if hard else F.lower(F.substring(s, r["start"].cast("int"), (r["end"] - r["start"] + 1).cast("int"))),
        r["start"].cast("int"),
    )
    masked = F.aggregate("_r", F.col(seq), lambda s, r: F.when(r["start"] <= F.length(s), one_region(s, r)).otherwise(s))
    return records.join(by_record, name, "left").withColumn(seq, F.when(F.col("_r").isNull(), F.col(seq)).otherwise(masked)).drop("_r")


#: Symbols that are translated at once, of short records together.
FRAME_SLAB = 1 << 19
#: Each byte's place in the order of codons (4: no base), and each codon's residue by its three places (fixed values).
_PLACES = np.full(256, 4, np.uint8)
_PLACES[[ord(c) for c in CODON_ORDER + "U"]] = 0, 1, 2, 3, 0
_RESIDUES = np.full(512, ord("X"), np.uint8)
_RESIDUES[[a << 6 | b << 3 | c for a in range(4) for b in range(4) for c in range(4)]] = np.frombuffer(AMINO_ACIDS.encode(), np.uint8)
#: Complements: the order of codons is TCAG.
_OTHERS = np.array([2, 3, 0, 1, 4], np.uint8)


def _stretches(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, frame: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of records in one array of bases, the stretches between stops in one frame: their records, residues before them, lengths and, joined, residues."""
    triples = np.zeros(len(codes), np.uint16)
    if len(codes) > 2:
        triples[:-2] = codes[:-2].astype(np.uint16) << 6 | codes[1:-1].astype(np.uint16) << 3 | codes[2:]
    residues = _RESIDUES[triples]
    m = np.maximum(sizes - frame, 0) // 3
    ends = np.cumsum(m + 1)
    begins = ends - m - 1
    # a stop behind each record's last codon ends its last stretch
    text = np.full(int(ends[-1]) if len(ends) else 0, ord("*"), np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = residues[np.repeat(starts + frame - 3 * (begins - np.arange(len(m))), m) + 3 * np.arange(int(m.sum()))]
    stops = np.flatnonzero(text == ord("*"))
    first = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    length = stops - first
    kept = length >= least
    first, length = first[kept], length[kept]
    record = np.searchsorted(ends, first, "right")
    edges = np.zeros(len(text) + 1, np.int8)
    edges[first] += 1
    edges[first + length] -= 1
    return record, first - begins[record], length, text[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]


def frame_batches(batches: Iterator[pa.RecordBatch], name: str, least: int) -> Iterator[pa.RecordBatch]:
    """``six_frames`` of batches of names and sequences, inside a task."""
    for batch in batches:
        seqs, at = batch.column(1), 0
        sizes = pc.fill_null(pc.utf8_length(seqs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.is_valid(seqs).to_numpy(zero_copy_only=False)
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), FRAME_SLAB, "right")) + at)
            rows = at + np.flatnonzero(known[at:end])
            at = end
            if not len(rows):
                continue
            whole = "".join(seqs.take(pa.array(rows)).to_pylist())
            # a symbol beyond ASCII is one symbol that is no base
            data = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.minimum(np.frombuffer(whole.encode("utf-32-le"), np.uint32), 255).astype(np.uint8)
            size, codes = sizes[rows], _PLACES[data]
            starts = np.cumsum(size) - size
            for strand in "+-":
                own, begins = (codes, starts) if strand == "+" else (_OTHERS[codes[::-1]], len(codes) - starts - size)
                for frame in range(3):
                    record, before, length, text = _stretches(own, begins, size, frame, least)
                    b = before * 3 + frame + 1
                    e = b + length * 3 - 1
                    low, high = (b, e) if strand == "+" else (size[record] - e + 1, size[record] - b + 1)
                    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    protein = pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))
                    columns = [batch.column(0).take(pa.array(rows[record])), pa.array(np.full(len(length), strand, object), pa.string()), pa.array(np.full(len(length), frame, np.int32)), pa.array(low), pa.array(high), protein]
                    yield pa.RecordBatch.from_arrays(columns, [name, "strand", "frame", "start", "end", "protein"])


def six_frames(records: DataFrame, name: str = "name", seq: str = "seq", least: int = 1) -> DataFrame:
    """``(name, strand, frame, start, end, protein)`` of every stretch between stops of at least ``least`` residues; places from 1 on the forward strand.

    Only whole codons count, X stands where a base is unknown.  The records of a batch are translated together, as one array of bases.
    """
    source = spread(records.select(name, seq))
    return source.mapInArrow(lambda batches: frame_batches(batches, name, least), f"`{name}` {source.schema[name].dataType.simpleString()}, strand string, frame int, start long, end long, protein string")


def extract_ranges(records: DataFrame, ranges: DataFrame, name: str = "name", seq: str = "seq", text: str = "range", loose: bool = False) -> DataFrame:
    """``(range, seq)`` of each range string, the reverse complement on ``-``; places from 1, cut at the record's end.  ``loose`` takes ``name``, ``name:5`` and ``name:5-9`` too."""
    asked = ranges.select(F.col(text), (parse_region if loose else parse_range)(F.col(text)).alias("_r")).where("_r is not null")
    body = F.substring(F.col(seq), F.col("_r.start").cast("int"), (F.col("_r.end") - F.col("_r.start") + 1).cast("int"))
    body = F.when(F.col("_r.start").isNull(), F.col(seq)).otherwise(body)
    found = asked.join(records, F.col("_r.name") == F.col(name).cast("string"))
    return found.select(text, F.when(F.col("_r.strand") == "-", reverse_complement(body)).otherwise(body).alias("seq"))


def interleave(first: DataFrame, second: DataFrame, order: str = "name") -> DataFrame:
    """Mates of two tables in turn: sorted by ``order``, then ``mate``."""
    return first.withColumn("mate", F.lit(1)).unionByName(second.withColumn("mate", F.lit(2)))


def fastq_to_fasta(reads: DataFrame) -> DataFrame:
    return reads.select("name", "seq")
