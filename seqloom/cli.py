"""Command line: one subcommand for each file-to-file operation.

Results are lines of text, printed, or with ``-o`` written as a folder of text files by Spark.
"""

from __future__ import annotations

import argparse
import functools
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.ranges import format_range, parse_region
from seqloom.functions.shared import stored
from seqloom.operators import align, annotations, chain, cluster, distance, layout, merge, minimizers, records, synteny
from seqloom.operators.prefix import number_rows, running_sum
from seqloom.sources import indexed
from seqloom.sources import text as io


def _tabbed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns or df.columns]).alias("line"))


def _fasta(df: DataFrame) -> DataFrame:
    return df.select(io.fasta_lines(F.col("name").cast("string"), F.col("seq")).alias("line"))


def _emit(lines: DataFrame, out: str | None, header: str | None = None, order: list[str] | None = None) -> None:
    if order:
        lines = lines.orderBy(*order)
    lines = lines.select("line")
    if out:
        if header:
            # parts are written in order, so the first one has the header
            lines = lines.sparkSession.createDataFrame([(header,)], "line string").coalesce(1).union(lines)
        lines.write.text(out)
        return
    if header:
        print(header)
    for row in lines.toLocalIterator():
        print(row["line"])


def _sizes(spark: SparkSession, files: list[str], blocks: DataFrame, default: str | None = None) -> DataFrame:
    if not files:
        return layout.inferred_sizes(blocks, default)
    sizes = io.read_sizes(spark, files)
    # blocks may name a sequence with its genome in front, each genome's in its own way
    named = blocks.select("seq_name").distinct().withColumn("known", F.lit(True))
    full = F.concat_ws(".", "genome", "chrom")
    found = sizes.withColumn("full", full).join(named.select(F.col("seq_name").alias("full"), F.col("known").alias("in_full")), "full", "left").join(named.select(F.col("seq_name").alias("chrom"), "known"), "chrom", "left")
    return found.select("genome", F.when(F.col("in_full") & F.col("known").isNull(), F.col("full")).otherwise(F.col("chrom")).alias("chrom"), "length")


def _interleave(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mates by their places in two files; without a second file each read is followed by an empty mate (``N`` of the lowest quality)."""
    if a.fq:
        mates = [io.read_fastq(spark, f).select(F.struct("file_no", "record_no").alias("n"), "name", "seq", "quality") for f in (a.files, a.list) if f]
        empty = mates[0].select("n", "name", F.lit("N").alias("seq"), F.lit("!").alias("quality"))
    else:
        mates = [number_rows(io.read_fasta(spark, f).select("name", "seq", "place"), ["place"], "n").drop("place") for f in (a.files, a.list) if f]
        empty = mates[0].select("n", "name", F.lit("N").alias("seq"))
    both = records.interleave(mates[0], mates[1] if len(mates) > 1 else empty)
    line = io.fastq_lines(F.col("name"), F.col("seq"), F.col("quality")) if a.fq else io.fasta_lines(F.col("name"), F.col("seq"))
    _emit(both.select("n", "mate", line.alias("line")), a.out, order=["n", "mate"])


def _draw(svg: str, out: str | None) -> None:
    if out:
        with open(out, "w") as f:
            f.write(svg)
    else:
        print(svg)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    c = a.command
    if c in ("size", "count", "masked", "n50", "one", "some", "order", "split-about", "split-name", "replace", "rc", "filter", "dedup", "mask", "sixframe", "range"):
        fa = io.read_fasta(spark, a.files).select("name", "seq")
        if c == "size":
            _emit(_tabbed(records.size(fa)), a.out)
        elif c == "count":
            _emit(_tabbed(records.count_bases(fa)), a.out)
        elif c == "masked":
            _emit(records.runs(fa).select(F.concat("name", F.lit(":"), F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))).alias("line")), a.out)
        elif c == "n50":
            _emit(_tabbed(records.nx(fa, percents=(a.percent,))), a.out)
        elif c == "one":
            _emit(_fasta(records.one(fa, a.name)), a.out)
        elif c in ("some", "order"):
            listed = spark.read.text(a.list).select(F.col("value").alias("name"), F.monotonically_increasing_id().alias("ordinal")).where("name <> ''")
            found = records.some(fa, listed, invert=a.invert) if c == "some" else records.in_order(fa, listed).orderBy("ordinal")
            _emit(_fasta(found), a.out)
        elif c == "split-about":
            records.split_about(fa, a.bases).select(io.fasta_lines(F.col("name"), F.col("seq")).alias("line"), "chunk").write.partitionBy("chunk").text(a.out)
        elif c == "split-name":
            records.split_by_name(fa, a.out)
        elif c == "replace":
            mapping = spark.read.csv(a.list, sep="\t", schema="name string, new_name string")
            _emit(_fasta(records.replace_names(fa, mapping)), a.out)
        elif c == "rc":
            _emit(_fasta(records.reverse_complements(fa)), a.out)
        elif c == "filter":
            _emit(_fasta(records.filter_records(fa, least=a.minsize, most=a.maxsize, unique=a.unique, upper=a.upper, iupac=a.iupac, simplify=a.simplify)), a.out)
        elif c == "dedup":
            how = {"by": "seq" if a.seq else "name", "both_strands": a.both, "ignore_case": a.case}
            if a.file:
                _emit(_tabbed(records.duplicates(fa, **how)), None if a.file == "stdout" else a.file)
            kept = records.dedup(fa, **how)
            _emit(_fasta(records.some(fa, kept)), a.out)
        elif c == "mask":
            regions = io.read_run_lists(spark, a.list) if a.list.endswith(".json") else spark.read.csv(a.list, sep="\t", schema="name string, start bigint, end bigint")
            _emit(_fasta(records.mask(fa, regions, hard=a.hard)), a.out)
        elif c == "sixframe":
            found = records.six_frames(fa, least=a.len).withColumn("name", F.concat(format_range(F.col("name"), F.col("strand"), F.col("start"), F.col("end")), F.lit("|frame="), F.col("frame").cast("string")))
            _emit(_fasta(found.withColumnRenamed("protein", "seq")), a.out)
        else:
            asked = spark.read.text(a.list).withColumnRenamed("value", "range").where("range <> ''")
            if a.index:
                fa = indexed.read_indexed(spark, a.files[0], io.read_index(spark, a.index), asked.select(parse_region(F.col("range"))["name"].alias("name")), a.gzi)
            _emit(_fasta(records.extract_ranges(fa, asked, loose=True).withColumnRenamed("range", "name")), a.out)
    elif c == "interleave":
        _interleave(spark, a)
    elif c == "fq2fa":
        reads = io.read_fastq(spark, a.files)
        _emit(reads.select("file_no", "record_no", io.fasta_lines(F.col("name"), F.col("seq")).alias("line")), a.out, order=["file_no", "record_no"])
    elif c == "gff-rg":
        found = annotations.feature_ranges(io.read_gff(spark, a.files), a.tag, a.key, F.lit(a.asm) if a.asm else None, a.simplify, a.ss)
        _emit(_tabbed(found), a.out)
    elif c == "dist-seq":
        given = [[r["value"] for r in spark.read.text(f).where("value <> ''").collect()] for f in a.files] if a.list else [[f] for f in a.files]

        def sets(files: list[str]) -> DataFrame:
            """Each record's minimizers, or each file's; ``mod`` is the mod-minimizer of both strands."""
            parts = [io.read_fasta(spark, f).select((F.lit(f) if a.merge else F.col("name")).alias("name"), "seq") for f in files]
            records = functools.reduce(DataFrame.unionByName, parts)
            mod = a.hasher == "mod"
            return minimizers.minimizer_sets(records, a.k, a.w, "name", mode="mod" if mod and a.w > 1 else a.mode, both_strands=a.both or mod, hasher=a.hasher)

        # the first file against the second, or against itself
        first, second = sets(given[0]), sets(given[1]) if len(given) > 1 else None
        _emit(_tabbed(distance.set_distances(first, a.k, other=second, zero=a.zero, detail=a.merge, similarity=a.sim)), a.out)
    elif c == "dist-vector":
        v = io._lines(spark, a.files).select(F.split("value", "\t").alias("c")).select(F.col("c")[0].alias("vec_id"), F.transform(F.split(F.col("c")[1], ","), lambda x: x.cast("double")).alias("embedding"))  # noqa: SLF001
        _emit(_tabbed(distance.vector_pairs(v, v, a.mode, binary=a.bin)), a.out)
    elif c in ("clust-cc", "clust-dbscan", "clust-mcl", "clust-km"):
        rows = spark.read.text(a.files).select(F.split("value", "\t").alias("c"))
        pairs = rows.select(F.col("c")[0].alias("n1"), F.col("c")[1].alias("n2"), F.coalesce(F.try_element_at("c", F.lit(3)).try_cast("double"), F.lit(1.0)).alias("value"))
        if c == "clust-cc":
            found = cluster.components(pairs).withColumnRenamed("component", "cluster")
        elif c == "clust-dbscan":
            found = cluster.dbscan(pairs, a.eps, a.min_points).where("cluster is not null")
        elif c == "clust-mcl":
            found = cluster.mcl(pairs.withColumnRenamed("value", "weight"), a.inflation)
        else:
            found = cluster.k_medoids(pairs, a.k).withColumnRenamed("medoid", "cluster")
        if a.format == "pair":
            _emit(_tabbed(cluster.representative_pairs(found)), a.out)
        else:
            _emit(found.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("node")), "\t").alias("line"), F.count("*").alias("n")), a.out, order=[F.col("n").desc(), "line"])
    elif c == "mat-phylip":
        matrix = distance.pair_matrix(io.read_pairs(spark, a.files), a.same, a.missing)
        _emit(io.phylip_lines(matrix, a.mode), a.out, None if a.mode == "lower" else str(matrix.where("i = j").count()), order=["row_no"])
    elif c == "manifold":
        coords = distance.pcoa(io.read_pairs(spark, a.files), a.dim, a.same, a.missing)
        _emit(coords.groupBy("name").pivot("axis", list(range(a.dim))).agg(F.first("value")).select(F.concat_ws("\t", "name", *[F.col(f"`{i}`").cast("string") for i in range(a.dim)]).alias("line"), "name"), a.out, order=["name"])
    elif c == "synt-mmg":
        given = {k: v for k, v in {"rounds": tuple(map(synteny.parse_round, a.rounds.split(","))) if a.rounds else None, "block_size": a.block_size, "chain_gap": a.chain_gap}.items() if v is not None}
        options = synteny.BlockOptions.for_divergence(a.divergence, k=a.k, min_weight=a.min_weight, max_freq=a.max_freq, soft_mask=a.soft_mask, sampling=a.sampling, **given)
        names, pieces = io.read_fasta_pieces(spark, a.files, synteny.overlap_of(options))
        found = synteny.find_blocks(stored(pieces), options).join(io.display_names(names), "seq_id", "left").withColumn("seq_name", F.coalesce("display", F.concat(F.lit("Seq_"), F.col("seq_id").cast("string")))).withColumn("ord", F.col("seq_id"))
        _emit(io.block_lines(found, "count", "round") if found.columns else found, a.out, "# Block_ID\tRange\tCount\tRound", order=["block_id", "ord"])
    elif c == "synt-dag":
        features, matches = io.read_positions(spark, a.files[0]), io.read_matches(spark, a.files[1])
        options = chain.ChainOptions(a.go, a.ge, a.bgs, a.mms, a.mdm, a.mna, a.mas)
        found = chain.chain_ranges(chain.chains(chain.anchors(matches, features, options=options), options), features)
        ids = number_rows(found.select("mol1", "mol2", "chain").distinct(), ["mol1", "mol2", "chain"], "block_id", 0)
        _emit(io.block_lines(found.join(ids, ["mol1", "mol2", "chain"]), "count", "score"), a.out, "# Block_ID\tRange\tCount\tScore", order=["block_id", "ord"])
    elif c == "synt-merge":
        gap = merge.gap_for_divergence(a.divergence) if a.chain_gap is None else a.chain_gap
        found = merge.merge_blocks(io.read_blocks(spark, a.files), gap).withColumn("_one", F.when(F.col("ord") == 1, 1).otherwise(0))
        found = running_sum(found, ["first_seq", "island", "ord"], "_one", "block_id").withColumn("score", F.format_string("%.1f", "score"))
        _emit(io.block_lines(found, "score"), a.out, "# Block_ID\tRange\tScore", order=["block_id", "ord"])
    elif c == "synt-das":
        rows = spark.read.text(a.files).select(F.split("value", "\t").alias("c")).where("size(c) >= 2")
        token = lambda i: F.filter(F.split(F.col("c")[i], a.sep), lambda x: x != "")
        done = align.align_pairs(rows.select(token(0).alias("s"), token(1).alias("t")), "s", "t", a.ma, a.mm, a.gp)
        _emit(done.select(F.concat_ws("\t", F.array_join("row1", ""), F.array_join("row2", ""), F.format_string("%.4f", "score")).alias("line")), a.out)
    elif c == "synt-ribbon":
        blocks = io.read_blocks(spark, a.files[:1])
        _draw(layout.ribbon_svg(blocks, _sizes(spark, a.files[1:], blocks), a.width or 1000, a.height, not a.no_label), a.out)
    elif c == "synt-circle":
        blocks = io.read_blocks(spark, a.files[:1])
        _draw(layout.circle_svg(blocks, _sizes(spark, a.files[1:], blocks, "Genome"), a.width or 800, a.track_width, not a.no_label), a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple) -> None:
        s = sub.add_parser(name)
        s.add_argument("files", nargs="+")
        s.add_argument("-o", "--out")
        for names, how in flags:
            s.add_argument(*names.split(), **how)

    on, number, integer = {"action": "store_true"}, {"type": float}, {"type": int}
    for name in ("size", "count", "masked", "rc", "fq2fa"):
        add(name)
    add("n50", ("-N --percent", integer | {"default": 50}))
    add("one", ("--name", {"required": True}))
    add("interleave", ("--list", {}), ("--fq", on))
    add("range", ("--list", {"required": True}), ("--index", {}), ("--gzi", {}))
    for name in ("order", "replace"):
        add(name, ("--list", {"required": True}))
    add("some", ("--list", {"required": True}), ("-i --invert", on))
    add("mask", ("--list", {"required": True}), ("--hard", on))
    add("split-about", ("-c --bases", integer | {"required": True}))
    add("split-name")
    add("filter", ("-a --minsize", integer | {"default": 0}), ("-z --maxsize", integer), ("-u --unique", on), ("-U --upper", on), ("--iupac", on), ("-s --simplify", on))
    add("dedup", ("-s --seq", on), ("-b --both", on), ("-c --case", on), ("-f --file", {}))
    add("sixframe", ("--len", integer | {"default": 1}))
    add("gff-rg", ("--tag", {"default": "gene"}), ("--key", {"default": "ID"}), ("--asm", {}), ("-s --simplify", on), ("--ss", on))
    add("dist-seq", ("-k", integer | {"default": 7}), ("-w", integer | {"default": 1}), ("--merge", on), ("--zero", on), ("--sim", on), ("--both", on), ("--list", on), ("--mode", {"default": "sliding"}), ("--hasher", {"default": "md5"}))
    add("dist-vector", ("--mode", {"default": "euclid"}), ("--bin", on))
    pair = ("--format", {"choices": ["cluster", "pair"], "default": "cluster"})
    add("clust-cc", pair)
    add("clust-dbscan", pair, ("--eps", number | {"default": 0.05}), ("--min_points", integer | {"default": 1}))
    add("clust-mcl", pair, ("--inflation", number | {"default": 2.0}))
    add("clust-km", pair, ("-k", integer | {"default": 2}))
    same = (("--same", number | {"default": 0.0}), ("--missing", number | {"default": 1.0}))
    add("mat-phylip", ("--mode", {"default": "full"}), *same)
    add("manifold", ("--dim", integer | {"default": 2}), ("--mode", {"choices": ["pcoa"], "default": "pcoa"}), *same)
    add("synt-mmg", ("-k", integer | {"default": 24}), ("-d --divergence", number), ("-r --rounds", {}), ("-b --block-size", integer), ("--chain-gap", integer), ("--min-weight", integer | {"default": 2}), ("--max-freq", integer | {"default": 1000}), ("--soft-mask", on), ("--sampling", {"default": "minimizer"}))
    add("synt-dag", ("--go", number | {"default": -1.0}), ("--ge", number | {"default": -5.0}), ("--bgs", integer | {"default": 10_000}), ("--mms", number | {"default": 50.0}), ("--mdm", integer | {"default": 100_000}), ("--mas", number), ("--mna", integer | {"default": 6}))
    add("synt-merge", ("-d --divergence", number), ("--chain-gap", integer))
    add("synt-das", ("--ma", number | {"default": 1.0}), ("--mm", number | {"default": -0.2}), ("--gp", number | {"default": -0.01}), ("--sep", {"default": ""}))
    add("synt-ribbon", ("--width", number), ("--height", number | {"default": 300.0}), ("--no-label", on))
    add("synt-circle", ("--width", number), ("--track-width", number | {"default": 20.0}), ("--no-label", on))
    return p


def main(args: list[str] | None = None) -> int:
    parsed = parser().parse_args(args)
    run(SparkSession.builder.appName("seqloom").getOrCreate(), parsed)
    return 0


if __name__ == "__main__":
    sys.exit(main())
