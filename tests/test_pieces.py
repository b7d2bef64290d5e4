"""Long records read and sketched in pieces, by many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import minimizers
from seqloom.sources import text as io


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("split", "size", "overlap"), [("50", 7, 3), ("333", 100, 250), ("1m", 40, 0)])
def test_pieces_of_any_cut(spark, tmp_path, small_splits, split, size, overlap):
    rng = random.Random(size)
    want = []
    for f in ("b", "a"):
        body = "ignored\n" if f == "a" else ""
        for i in range(12):
            seq = "".join(rng.choice("ACGTé") for _ in range(rng.choice([0, 1, 6, 7, 8, 59, 60, 61, 400])))
            width = rng.choice([1, 7, 60, 1000])
            body += f">{f}{i} some text\n" + "".join(seq[k : k + width] + "\n" for k in range(0, len(seq), width)) + ("\n" if i == 5 else "")
            want.append((f, f"{f}{i}", seq))
        (tmp_path / f"{f}.fa").write_text(body)
    small_splits(split)
    names, pieces = io.read_fasta_pieces(spark, [str(tmp_path / "b.fa"), str(tmp_path / "a.fa")], overlap, size)
    assert [(r.seq_id, r.genome, r.name, r.length) for r in names.orderBy("seq_id").collect()] == [(i, g, n, len(s)) for i, (g, n, s) in enumerate(want, 1)]
    got = sorted((r.seq_id, r.name, r.offset, r.first, r.last, r.seq) for r in pieces.collect())
    cut = [(i, n, max(0, o - overlap), o, min(o + size, len(s)), s[max(0, o - overlap) : o + size + overlap]) for i, (_, n, s) in enumerate(want, 1) for o in range(0, len(s), size)]
    assert got == cut


@pytest.mark.parametrize("mode", ["sliding", "centre", "mod"])
def test_pieces_sketch_like_whole_records(spark, tmp_path, small_splits, mode):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT" * 30 + "acgt") for _ in range(n)) for n in (20, 3000, 45_000, 31)]
    (tmp_path / "x.fa").write_text("".join(f">s{i}\n" + "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + "\n" for i, s in enumerate(seqs)))
    small_splits("4k")
    k, w = 11, 21
    names, pieces = io.read_fasta_pieces(spark, str(tmp_path / "x.fa"), k + w - 2, 1000)
    whole = spark.createDataFrame([(i + 1, s) for i, s in enumerate(seqs)], "seq_id long, seq string")
    rows = lambda df: sorted(tuple(r) for r in df.select("seq_id", "pos", "hash", "strand").collect())
    got = rows(minimizers.sketch(pieces, k, w, mode=mode, soft_mask=True, hasher="xxhash", offset="offset"))
    assert got == rows(minimizers.sketch(whole, k, w, mode=mode, soft_mask=True, hasher="xxhash")) and len(got) > 1000
    with pytest.raises(ValueError, match="jumping"):
        minimizers.sketch(pieces, k, w, mode="jumping", offset="offset")


def test_a_large_record_is_the_work_of_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(6)
    n = 4_000_000
    seq = "".join(rng.choices("ACGT", k=n))
    with open(tmp_path / "x.fa", "w") as f:
        f.write(">long\n" + "\n".join(seq[k : k + 80] for k in range(0, n, 80)) + "\n")
    small_splits("256k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    k, w = 21, 51
    _, pieces = io.read_fasta_pieces(spark, str(tmp_path / "x.fa"), k + w - 2, 1 << 16)
    sizes = [r.n for r in pieces.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("seq")).alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < n * 0.75
    got = minimizers.sketch(pieces, k, w, hasher="xxhash", offset="offset").agg(F.count("*"), F.sum("pos"), F.sum(F.col("hash") % 1000)).first()
    whole = spark.createDataFrame([(1, seq)], "seq_id long, seq string")
    assert got == minimizers.sketch(whole, k, w, hasher="xxhash").agg(F.count("*"), F.sum("pos"), F.sum(F.col("hash") % 1000)).first()
