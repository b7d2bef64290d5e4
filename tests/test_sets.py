"""Distances of queries and of groups by filters and bits, against the plain join."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import distance
from seqloom.plans import tables


@pytest.mark.parametrize("bits", [64, 1 << 28])
def test_query_distances_are_those_of_the_join(spark, monkeypatch, bits):
    monkeypatch.setattr(distance, "FILTER_BITS", bits)
    rng = random.Random(6)
    pool = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    sets = spark.createDataFrame([(i, sorted(rng.sample(pool, rng.randrange(1, 60)))) for i in range(60)], "name long, hashes array<long>")
    rows = sets.select("name", F.explode("hashes").alias("hash"))
    asked = "name % 5 = 0"
    assert sorted(distance.query_distances(sets.where(asked), sets, 5).collect()) == sorted(distance.set_distances(rows.where(asked), 5, other=rows).collect())


def test_a_filter_keeps_what_queries_have_and_little_else(spark):
    sets = spark.range(50).select(F.col("id").alias("name"), F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.xxhash64("id", i)).alias("hashes"))
    kept = distance._maybe_shared(sets, sets.where("name < 2").select(F.explode("hashes").alias("hash")).distinct()).collect()
    assert {r.n for r in kept} == {200} and all(len(r.hashes) == 200 for r in kept if r.name < 2)
    assert sum(len(r.hashes) for r in kept if r.name >= 2) < 0.15 * 48 * 200


@pytest.mark.parametrize("n", [1, 20, 130])
def test_groups_as_bits_are_those_of_the_join(spark, n):
    rng = random.Random(7)
    rows = [(None if g == 3 else f"g{g}", rng.randrange(400) - 200) for g in range(n) for _ in range(rng.choice([1, 30, 90]))]
    df = spark.createDataFrame(rows, "name string, hash long")
    # a name without hashes is no group
    names = df.select("name").distinct().unionByName(spark.createDataFrame([("empty",)], "name string"))
    key = lambda rows: sorted(map(tuple, rows), key=str)
    want = key(distance.set_distances(df.distinct(), 5, zero=True, detail=True).collect())
    assert key(distance.group_distances(df, names, 5, detail=True).collect()) == want
    assert len(want) == len({g for g, _ in rows}) ** 2


def test_documents_of_one_id_are_one_set(spark, tmp_path):
    texts = [(1, "a b c d e f"), (1, "b c d e f g"), (2, "a b c d e"), (2, "a b c d e"), (3, "x")]
    for name, rows in (("twice", texts), ("once", texts[1:3])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert {r.name: len(r.hashes) for r in tables.document_sets(spark, f"{tmp_path}/twice").collect()} == {1: 3, 2: 1}
    once = tables.document_sets(spark, f"{tmp_path}/once")
    assert {r.name: len(r.hashes) for r in once.collect()} == {1: 2, 2: 1}
    # no shuffle
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()
