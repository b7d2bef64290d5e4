"""Readers of sequence, annotation and block files, and their writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.ranges import flip_strand, format_range, parse_range
from seqloom.functions.sequence import file_stem
from seqloom.functions.shared import stored


def _file_numbers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, file_no)`` of every file, in the order in which paths are given, those of one path by name: one row per file."""
    given = [paths] if isinstance(paths, str) else list(paths)
    files = dict.fromkeys(f for p in given for f in sorted(spark.read.text(p).inputFiles()))
    return spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, file_no int").select(_one_slash(F.col("file")).alias("file"), "file_no")


def _one_slash(path: Column) -> Column:
    """Paths as Spark writes them here and there: with one or three slashes behind the scheme."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def _placed(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    """``(value, file, place)`` of every line: where it stands among all files, as ``(file_no, start, row)``.

    ``start`` is where the split begins that a task reads, and rows of one split are numbered as they are read, so places rise through a file however it is cut.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(paths).select("value", _one_slash(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.join(F.broadcast(_file_numbers(spark, paths)), "file").select("value", "file", F.struct("file_no", "start", "row").alias("place"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(genome, name, description, seq, place)``, one row per record; the genome is the file's name up to its first point, places rise in file and record order.  Gzipped files are read too."""
    # a record begins with > at a line's start; elsewhere the sign is part of a description
    raw = _placed(spark, paths, "\n>").withColumn("value", F.regexp_replace("value", r"^\s*>", ""))
    head = F.regexp_extract("value", r"^[^\r\n]*", 0)
    return raw.where(F.trim("value") != "").select(
        file_stem(F.col("file")).alias("genome"),
        F.regexp_extract(head, r"^\S*", 0).alias("name"),
        head.alias("description"),
        F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "").alias("seq"),
        "place",
    )


#: Symbols of a piece of a long record.
PIECE = 1 << 20


def _segments(spark: SparkSession, paths: str | list[str], size: int) -> DataFrame:
    """``(file_no, start, rec, off, head, description, seq)``: runs of sequence lines joined, each of some ``size`` symbols, in the split that a task reads.

    ``rec`` counts the split's headers so far and ``off`` the symbols since the last of them, or since the split's beginning; ``head`` is that header, if the split has it, and a
    row of its own, with the ``description``.
    """
    lines = _placed(spark, paths).select("value", "place.file_no", "place.start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rec, off, held, head, parts = None, 0, 0, 0, None, []
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal off, held
            whole = "".join(parts)
            for at in range(0, len(whole), size):
                rows.append((*key, rec, off + at, head, None, whole[at : at + size]))
            off, held = off + len(whole), 0
            parts.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["file_no", "start", "rec", "off", "head", "description", "seq"])

        for batch in batches:
            for value, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    flush()
                    key, rec, off, head = own, 0, 0, None
                if value.startswith(">"):
                    flush()
                    rec, off, head = rec + 1, 0, (value[1:].split() or [""])[0]
                    rows.append((*key, rec, 0, head, value[1:].rstrip(), ""))
                else:
                    parts.append("".join(value.split()))
                    held += len(parts[-1])
                    if held >= size:
                        flush()
            if rows:
                yield out()
        flush()
        if rows:
            yield out()

    return lines.mapInArrow(run, "file_no int, start long, rec long, off long, head string, description string, seq string")


def read_fasta_pieces(spark: SparkSession, paths: str | list[str], overlap: int, size: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Records ``(seq_id, genome, name, description, length)``, numbered from 1 in file and record order, and their pieces ``(seq_id, name, offset, first, last, seq)``.

    A piece answers for the places from ``first``, a multiple of ``size``, to before ``last``; its ``seq`` begins at ``offset`` and has ``overlap`` symbols more on either side, as far as the record
    goes, so that every window of up to ``overlap`` + 1 symbols with one of its places lies in it.  No record is ever one row: each task joins the lines of its split, two prefix
    scans over the splits' summaries (headers so far, symbols since the last one) tell where in which record that is, and a shuffle by record and piece puts pieces together.  What
    precedes a file's first header is left out.
    """
    raw = stored(_segments(spark, paths, size))
    ends = raw.groupBy("file_no", "start").agg(F.max("rec").alias("n"), F.max_by(F.col("off") + F.length("seq"), F.struct("rec", "off", F.length("seq"))).alias("tail"), F.max_by("head", "rec").alias("head"))
    # one row per split
    by_file = Window.partitionBy("file_no").orderBy("start")
    runs = ends.withColumn("g", F.sum((F.col("n") > 0).cast("int")).over(by_file))
    runs = runs.withColumn("since", F.sum("tail").over(Window.partitionBy("file_no", "g").orderBy("start")))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = runs.select(
        "file_no", "start", earlier(Window.orderBy("file_no", "start")).alias("before"), earlier(by_file).alias("in_file"), F.coalesce(F.lag("since").over(by_file), F.lit(0)).alias("carry"),
        F.last("head", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1)).alias("open_head"),
    )
    at = raw.join(F.broadcast(known), ["file_no", "start"]).where("rec > 0 or in_file > 0")
    at = at.select("file_no", (F.col("before") + F.col("rec")).alias("seq_id"), (F.col("off") + F.when(F.col("rec") == 0, F.col("carry")).otherwise(0)).alias("offset"), F.coalesce("head", "open_head").alias("name"), "description", "seq")
    files = _file_numbers(spark, paths).select("file_no", file_stem(F.col("file")).alias("genome"))
    lengths = at.groupBy("seq_id").agg(F.max(F.col("offset") + F.length("seq")).alias("length"))
    heads = at.where("description is not null").join(F.broadcast(files), "file_no").select("seq_id", "genome", "name", "description")
    at = at.where("seq <> ''")
    first, last = F.greatest(F.floor((F.col("offset") - overlap) / size), F.lit(0)), F.floor((F.col("offset") + F.length("seq") - 1 + overlap) / size)
    dealt = at.select("seq_id", "name", "offset", "seq", F.explode(F.sequence(first, last)).alias("piece"))
    # what of a segment is in the piece and its margins
    begin = F.greatest(F.col("piece") * size - overlap, "offset")
    end = F.least((F.col("piece") + 1) * size + overlap, F.col("offset") + F.length("seq"))
    cut = dealt.select("seq_id", "name", "piece", begin.alias("at"), F.substring(F.col("seq"), (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int")).alias("part")).where("part <> ''")
    whole = cut.groupBy("seq_id", "name", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    placed = whole.select("seq_id", "name", F.col("p")[0]["at"].alias("offset"), (F.col("piece") * size).alias("first"), F.array_join("p.part", "").alias("seq"))
    # behind a record's end there is nothing to answer for
    pieces = placed.withColumn("last", F.least(F.col("first") + size, F.col("offset") + F.length("seq"))).where("last > first").select("seq_id", "name", "offset", "first", "last", "seq")
    return heads.join(lengths, "seq_id"), pieces


def numbered(records: DataFrame, *order: str) -> DataFrame:
    """Records with ``seq_id`` from 1 in the given order, that of files and records unless given, and ``display`` names (with the genome if there are several).

    The records are stored once, in that order, and keep their sequences.
    """
    from seqloom.operators.prefix import number_rows

    counted = number_rows(records, list(order) or ["place"], "seq_id")
    return counted.join(display_names(counted.select("seq_id", "genome", "name")), "seq_id")


def display_names(records: DataFrame) -> DataFrame:
    """``(seq_id, display)``: names, with the genome in front if there are several."""
    genomes = records.agg(F.count_distinct("genome").alias("_genomes"))
    return records.crossJoin(F.broadcast(genomes)).select("seq_id", F.when(F.col("_genomes") > 1, F.concat_ws(".", "genome", "name")).otherwise(F.col("name")).alias("display"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file_no, record_no, name, seq, quality)`` of four-line records, both numbers from 0; a first line without ``@`` or a third without ``+`` fails the query.

    A quality may begin like a name, so lines count by their number: each split's lines are counted, and a line's number is that of the splits before it and its own in its split.
    Blank lines at a file's end are left out.
    """
    lines = _placed(spark, paths)
    splits = lines.groupBy("place.file_no", "place.start").agg(F.count("*").alias("n"), F.min("place.row").alias("first"))
    # one row per split
    before = Window.partitionBy("file_no").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file_no", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered_lines = lines.select("value", "place.*").join(F.broadcast(bases), ["file_no", "start"]).withColumn("line", F.col("row") + F.col("shift"))
    four = numbered_lines.groupBy("file_no", F.floor(F.col("line") / 4).alias("record_no")).agg(*[F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(f"l{k}") for k in range(4)])
    whole = four.where(F.length(F.trim(F.concat_ws("", "l0", "l1", "l2", "l3"))) > 0)
    bad = F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("l0", F.lit("")))).cast("string")
    head = F.when(F.startswith("l0", F.lit("@")) & F.startswith("l2", F.lit("+")) & F.col("l3").isNotNull(), F.col("l0")).otherwise(bad)
    return whole.select("file_no", "record_no", F.regexp_extract(head, r"^@(\S*)", 1).alias("name"), F.col("l1").alias("seq"), F.col("l3").alias("quality"))


def read_gff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """GFF3 records with attributes as a map, escapes kept; lines that are no record fail the query."""
    lines = spark.read.text(paths).select("value", file_stem(F.col("_metadata.file_path")).alias("genome"))
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("c", F.split("value", "\t"))
    checked = F.when(F.size("c") == 9, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("not a GFF3 record: "), "value")).cast("array<string>"))
    rows = rows.withColumn("c", checked)
    attributes = F.str_to_map(F.col("c")[8], F.lit(";"), F.lit("="))
    names = ["seqid", "source", "type", "start", "end", "score", "strand", "phase"]
    picked = [F.col("c")[i].cast("long").alias(n) if n in ("start", "end") else F.col("c")[i].alias(n) for i, n in enumerate(names)]
    return rows.select("genome", *picked, attributes.alias("attributes"))


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, line_no, value)`` of every line; numbers only order the lines of one file."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")


def read_positions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(acc, mol, start, end, line_no)`` from two-column lines; other lines are left out."""
    rows = _lines(spark, paths).withColumn("c", F.split("value", "\t")).where(F.size("c") == 2)
    place = F.col("c")[1]
    return rows.select(
        F.col("c")[0].alias("acc"),
        F.regexp_extract(F.regexp_extract(place, r"^(.*):[^:]*$", 1), r"^[^(]*", 0).alias("mol"),
        F.regexp_extract(place, r":(\d+)-", 1).cast("long").alias("start"),
        F.regexp_extract(place, r"-(\d+)$", 1).cast("long").alias("end"),
        "line_no",
    )


def read_matches(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(acc1, acc2, similarity, line_no)``; blank lines, comments and lines of fewer than three fields are left out, a bad number counts as 0."""
    rows = _lines(spark, paths).withColumn("v", F.trim("value")).where("v <> '' and not startswith(v, '#')").withColumn("c", F.split("v", "\t")).where(F.size("c") >= 3)
    return rows.select(F.col("c")[0].alias("acc1"), F.col("c")[1].alias("acc2"), F.coalesce(F.col("c")[2].try_cast("double"), F.lit(0.0)).alias("similarity"), "line_no")


def read_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(genome, chrom, length)`` from name and length columns, the genome by file."""
    rows = spark.read.text(paths).select("value", file_stem(F.col("_metadata.file_path")).alias("genome")).withColumn("c", F.split("value", "\t")).where(F.size("c") >= 2)
    return rows.select("genome", F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("length"))


def read_pairs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(n1, n2, value, line_no)`` from the first three columns."""
    rows = _lines(spark, paths).withColumn("c", F.split("value", "\t")).where(F.size("c") >= 3)
    return rows.select(F.col("c")[0].alias("n1"), F.col("c")[1].alias("n2"), F.col("c")[2].cast("double").alias("value"), "line_no")


def read_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(block_id, ord, seq_name, strand, start, end, score)``: lines of consecutive equal ids make a block, numbered from 1; comments and bad lines are left out."""
    from seqloom.operators.merge import group_blocks

    rows = _lines(spark, paths).where("trim(value) <> '' and not startswith(trim(value), '#')").withColumn("c", F.split("value", "\t")).where(F.size("c") >= 3)
    rows = rows.withColumn("r", parse_range(F.col("c")[1])).where("r is not null").withColumn("raw_id", F.trim(F.col("c")[0]).try_cast("long")).where("raw_id is not null").select("file", "line_no", "raw_id", "r.*", F.coalesce(F.col("c")[2].try_cast("double"), F.lit(0.0)).alias("score"))
    return group_blocks(rows.withColumnRenamed("name", "seq_name"), ["file"], ["line_no"], "raw_id")


def read_run_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(name, start, end)`` of JSON objects of run lists, ``{"name": "1-100,205"}``; a run of one place is its number alone, ``-`` is the empty list."""
    files = spark.read.text(paths, wholetext=True).select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    return parsed_runs(files.select(F.explode("m").alias("name", "runs")), "name", "runs")


def parsed_runs(rows: DataFrame, name: str, runs: str) -> DataFrame:
    """``(name, start, end)`` of a column of run lists; what is no run fails the query."""
    run = r"^(-?\d+)(?:-(-?\d+))?$"
    each = rows.where(F.trim(runs) != "-").select(F.col(name).alias("name"), F.explode(F.split(F.regexp_replace(runs, r"\s", ""), ",")).alias("r")).where("r <> ''")
    checked = F.when(F.col("r").rlike(run), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a run: "), "r")).cast("string"))
    ends = each.select("name", F.regexp_extract(checked, run, 1).cast("long").alias("start"), F.regexp_extract("r", run, 2).alias("e"))
    return ends.select("name", "start", F.when(F.col("e") == "", F.col("start")).otherwise(F.col("e").try_cast("long")).alias("end"))


def run_list_lines(intervals: DataFrame, name: str = "name") -> DataFrame:
    """``(name, runs)``: disjoint intervals of each name as a run list."""
    run = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    return intervals.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", run.alias("r")))), lambda x: x["r"]), ",").alias("runs"))


def read_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(name, offset, size)`` of an offset index."""
    return spark.read.csv(paths, sep="\t", schema="name string, offset bigint, size bigint")


def fastq_lines(name: Column, seq: Column, quality: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), quality)


def fasta_lines(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def block_lines(rows: DataFrame, third: str, fourth: str | None = None) -> DataFrame:
    """Block rows as text lines; all strands of a block are inverted if its first range is on ``-``."""
    first = F.min_by("strand", "ord").alias("_first")
    flips = rows.groupBy("block_id").agg(first)
    out = rows.join(flips, "block_id").withColumn("strand", flip_strand(F.col("strand"), F.col("_first") == "-"))
    columns = [F.col("block_id").cast("string"), format_range(F.col("seq_name"), F.col("strand"), F.col("start"), F.col("end")), F.col(third).cast("string")]
    if fourth:
        columns.append(F.col(fourth).cast("string"))
    return out.select("block_id", "ord", F.concat_ws("\t", *columns).alias("line"))


def phylip_lines(matrix: DataFrame, mode: str = "full") -> DataFrame:
    """``(row_no, line)`` of a distance matrix ``(i, j, n1, value)``: ``full`` (tabs), ``strict`` (padded) or ``lower`` (lower triangle)."""
    cells = matrix.where("j < i") if mode == "lower" else matrix
    form = "%.6f"
    rows = cells.groupBy("i", "n1").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("v"))
    if mode == "lower":
        rows = matrix.select("i", "n1").distinct().join(rows, ["i", "n1"], "left")
    values = F.transform(F.coalesce("v", F.array().cast("array<struct<j:int,value:double>>")), lambda x: F.format_string(form, x["value"]))
    name = F.rpad("n1", 10, " ") if mode == "strict" else F.col("n1")
    return rows.select(F.col("i").alias("row_no"), F.concat_ws(" " if mode == "strict" else "\t", F.array(name), values).alias("line"))
