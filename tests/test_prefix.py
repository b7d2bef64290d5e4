"""Exact numbers and sums of rows that carry what no number needs."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import records
from seqloom.operators.prefix import number_rows, ranged, running_sum, with_parts
from seqloom.sources import text as io


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def payload(spark, n):
    return spark.range(n, numPartitions=7).select((F.col("id") * 7919 % n).alias("key"), F.repeat(F.lit("ACGT"), 30).alias("seq"), (F.col("id") % 13).alias("value"))


def test_numbers_of_many_records(spark, adaptive):
    n = 400_000
    got = number_rows(payload(spark, n), ["key"], "n")
    assert got.columns == ["key", "seq", "value", "n"]
    assert got.where("n <> key + 1 or length(seq) <> 120").isEmpty() and got.agg(F.count_distinct("n")).first()[0] == n


def test_sums_of_many_records(spark, adaptive):
    n = 400_000
    sums = running_sum(payload(spark, n).withColumn("value", F.when(F.col("key") % 5 == 0, None).otherwise(F.col("key"))), ["key"], "value", "s")
    # without the multiples of five, of which q have come
    want = "key * (key + 1) div 2 - 5 * ((key div 5) * (key div 5 + 1) div 2)"
    assert sums.where(f"s <> {want}").isEmpty() and sums.count() == n
    chunks = records.split_about(payload(spark, n).withColumnRenamed("key", "name"), 1000).groupBy("chunk").agg(F.count("*").alias("c"), F.min("name").alias("a"), F.max("name").alias("b"))
    assert chunks.count() == 48_000 and chunks.where("c not in (8, 9) or b - a <> c - 1").isEmpty()


def test_rows_of_one_key_are_parted(spark):
    df = spark.range(50_000, numPartitions=3).select(F.lit(1).alias("key"), "id", F.repeat(F.lit("x"), 50).alias("seq"))
    got = number_rows(df, ["key"], "n", 0)
    # equal keys follow the table's order
    assert got.where("n <> id").isEmpty()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert ranged(df, ["key"]).select("_range").distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.enabled", before)
    assert number_rows(df.limit(0), ["key"], "n").count() == 0


@pytest.mark.parametrize("split", ["3m", "997"])
def test_reads_of_many_splits(spark, tmp_path, adaptive, split):
    rng = random.Random(7)
    n = 150_000 if split == "3m" else 700
    made = []
    for f in range(2):
        with open(tmp_path / f"r{1 - f}.fq", "w") as out:
            for i in range(n):
                seq = "".join(rng.choices("ACGT", k=rng.randrange(4)))
                made.append((f, i, f"r{f}_{i}", seq, "".join(rng.choices("@+I", k=len(seq)))))
                out.write(f"@r{f}_{i} x\n{seq}\n+\n{made[-1][4]}\n")
            out.write("\n\n" if f else "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = io.read_fastq(spark, [str(tmp_path / "r1.fq"), str(tmp_path / "r0.fq")])
        assert sorted(tuple(r) for r in got.collect()) == made
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_reads_fail(spark, tmp_path):
    for body in ("@a\nAC\n+\nII\nGG\n@b\nGG\n+\nII\n", "@a\nAC\n+\n"):
        (tmp_path / "x.fq").write_text(body)
        with pytest.raises(Exception, match="not a FASTQ record"):
            io.read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_ids_in_file_and_record_order(spark, tmp_path):
    rng = random.Random(3)
    names = [[f"s{rng.random():.9f}" for _ in range(3000)] for _ in range(3)]
    for f, own in zip("bca", names, strict=True):
        (tmp_path / f"{f}.fa").write_text("".join(f">{n} of {f}\nACGT\n{'G' * (i % 9)}\n" for i, n in enumerate(own)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = io.numbered(io.read_fasta(spark, [str(tmp_path / f"{f}.fa") for f in "bca"])).orderBy("seq_id").collect()
        assert [(r.seq_id, r.name) for r in got] == list(enumerate((n for own in names for n in own), 1))
        assert all(r.display == f"{r.genome}.{r.name}" and r.description.endswith(f" of {r.genome}") and r.seq.startswith("ACGT") for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("rows", [1, 7])
def test_parts_of_a_key_in_many_ranges(spark, adaptive, rows):
    rng = random.Random(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    made = [("hot", i, rng.randrange(6), "x" * 40) for i in range(900)] + [(f"k{i % 40}", i, i, "y") for i in range(200)] + [(None, i, 0, None) for i in range(5)]
    made = [(k, i, i + e if i % 50 else i + 30, s) for k, i, e, s in made if not (k == "hot" and i % 97 > 80)]
    rng.shuffle(made)
    df = spark.createDataFrame(made, "key string, at long, end long, seq string").repartition(5)
    got = {(r.key, r.at): r._part for r in with_parts(df, ["key"], ["at"], ["at"], lambda before, reached: (F.col("at") - before["at"] > 3) & (F.col("at") > reached), rows, F.col("end")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ordered = sorted(made, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    want, start, reached, last = {}, 0, None, None
    for n, (k, at, end, _) in enumerate(ordered):
        if last is None or last[0] != k:
            start, reached = n, None
        elif at - last[1] > 3 and at > reached:
            start = n
        want[k, at] = start // rows
        reached, last = end if reached is None else max(reached, end), (k, at)
    assert got == want and len({p for (k, _), p in got.items() if k == "hot"}) > 1
