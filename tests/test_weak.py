"""Run lists, split posting lists, Bloom filters, drawings and rules by genome, in small cases."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from seqloom.functions.sequence import gap_penalty, saturating_subtract, token_score
from seqloom.operators import bloom, cluster, distance, intervals, layout, records
from seqloom.sources import text as io


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_runs_of_records_with_one_name(spark):
    df = spark.createDataFrame([("a", "ACgtNA"), ("a", "ttACGT"), ("b", None), ("c", "")], "name string, seq string")
    assert rows(records.runs(df), "name", "start", "end") == [("a", 1, 2), ("a", 3, 5)]


@pytest.mark.parametrize("postings", [1, 3, 1000])
def test_posting_lists_in_parts(spark, postings):
    rng = random.Random(postings)
    sets = {n: {0, *rng.sample(range(1, 40), rng.randrange(6))} for n in range(60)}
    df = spark.createDataFrame([(n, h) for n, s in sets.items() for h in s], "name int, hash long")
    got = rows(distance.shared_counts(df, postings=postings), "n1", "n2", "n_both")
    assert got == sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets)
    few = df.where("name < 5")
    assert rows(distance.shared_counts(few, other=df, postings=postings), "n1", "n2", "n_both") == [g for g in got if g[0] < 5]


def test_a_common_hash_is_many_tasks(spark):
    df = spark.range(3000, numPartitions=4).select(F.col("id").alias("name"), F.lit(7).cast("long").alias("hash"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        met = distance.shared_counts(df, postings=300)
        parts = met.select(F.spark_partition_id().alias("p"), "n1").groupBy("p").count().collect()
        assert sum(r["count"] for r in parts) == 9_000_000
        # a hundred pairs of parts, none with more than a few hundredths of all pairs
        assert len(parts) == 32 and max(r["count"] for r in parts) < 9_000_000 / 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_run_lists(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n "c1": "1-5, 9,12-14",\n "c2": "-", "c3": "-4--2"}\n')
    got = io.read_run_lists(spark, str(tmp_path / "m.json"))
    assert rows(got, "name", "start", "end") == [("c1", 1, 5), ("c1", 9, 9), ("c1", 12, 14), ("c3", -4, -2)]
    assert rows(io.run_list_lines(got), "name", "runs") == [("c1", "1-5,9,12-14"), ("c3", "-4--2")]
    (tmp_path / "bad.json").write_text('{"c1": "1-5,x"}')
    with pytest.raises(Exception, match="not a run"):
        io.read_run_lists(spark, str(tmp_path / "bad.json")).collect()


def test_interval_algebra_against_sets(spark):
    rng = random.Random(4)
    made = [[(s, a, a + rng.randrange(12)) for s in range(3) for a in rng.sample(range(150), 12)] for _ in range(2)]
    a, b = (spark.createDataFrame(m + m[:2], "seq_id int, start int, end int") for m in made)
    covered = [{(s, i) for s, x, y in m for i in range(x, y + 1)} for m in made]
    for got, want in ((intervals.intersection(a, b), covered[0] & covered[1]), (intervals.difference(a, b), covered[0] - covered[1]), (intervals.union(a), covered[0])):
        found = rows(got, "seq_id", "start", "end")
        assert {(s, i) for s, x, y in found for i in range(x, y + 1)} == want
        # no two touch
        assert all(p[0] != q[0] or q[1] > p[2] + 1 for p, q in zip(found, found[1:], strict=False))


def test_bloom_filters(spark):
    values = spark.range(2000, numPartitions=5).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("x"))
    one, two = (bloom.build(values.where(f"cast(substr(x, 2) as int) % 4 = {k}"), "x", 1000, 0.02) for k in (0, 1))
    both = bloom.merged(one, two)
    assert rows(both, "word", "bits") == rows(bloom.build(values.where("cast(substr(x, 2) as int) % 4 < 2"), "x", 1000, 0.02), "word", "bits")
    kept = {r.x for r in bloom.maybe_in(values.union(spark.createDataFrame([(None,)], "x string")), "x", both, 1000, 0.02).collect()}
    inside = {f"v{i}" for i in range(2000) if i % 4 < 2}
    assert inside <= kept
    # a filter as full as it was made for: two in a hundred of the others
    assert len(kept - inside) / 1000 < 0.04
    assert bloom.maybe_in(values, "x", bloom.build(values.limit(0), "x", 10, 0.1), 10, 0.1).count() == 0
    with pytest.raises(ValueError, match="too large"):
        bloom.maybe_in(values, "x", both, 10**10, 0.01)


def test_labels_and_self_comparison(spark):
    b = spark.createDataFrame([(0, 1, "A.c1", 0, 50, "+"), (0, 2, "A.c2", 10, 60, "-"), (1, 1, "A.c1", 0, 5, "+"), (1, 2, "A.c1", 5, 9, "+")], "block_id long, ord int, seq_name string, start long, end long, strand string")
    tracks = layout.ribbon_tracks(layout.inferred_sizes(b))
    assert rows(tracks, "track", "label", "chrom") == [(t, f"c{i}", f"A.c{i}") for t in (0, 1) for i in (1, 2)]
    assert {(r.y1, r.y2) for r in layout.ribbons(b, tracks).collect()} == {(135.0, 275.0)}
    assert ">c1</text>" in layout.circle_svg(b, layout.inferred_sizes(b)) and ">A.c1<" not in layout.ribbon_svg(b, layout.inferred_sizes(b))
    # two genomes: a block inside one is an arc below its track
    many = b.unionByName(spark.createDataFrame([(2, 1, "B.c1", 0, 5, "+"), (2, 2, "A.c1", 0, 5, "+")], b.schema))
    found = {r.block_id: r for r in layout.ribbons(many, layout.ribbon_tracks(layout.inferred_sizes(many))).collect()}
    assert found[0].y1 == found[0].y2 == 135.0 and found[0].cy1 == found[0].cy2 == 135.0 + min(120, max(20, 0.2 * abs(found[0].x1 - found[0].x3)))
    assert found[2].y1 > found[2].y2 and found[2].cy1 == found[2].cy2


def test_unsettled_clusters_say_so(spark):
    pairs = spark.createDataFrame([(f"n{i}", f"n{j}", 0.1 + 0.07 * ((i * j) % 11)) for i in range(8) for j in range(i)], "n1 string, n2 string, weight double")
    with pytest.warns(UserWarning, match="settled"):
        cluster.mcl(pairs, rounds=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        cluster.mcl(pairs, rounds=60)


@pytest.mark.parametrize(("mode", "want"), [("full", ["a\t0.000000\t0.500000", "b\t0.500000\t0.000000"]), ("strict", ["a          0.000000 0.500000", "b          0.500000 0.000000"]), ("lower", ["a", "b\t0.500000"])])
def test_phylip_forms(spark, mode, want):
    matrix = distance.pair_matrix(spark.createDataFrame([("a", "b", 0.5)], "n1 string, n2 string, value double"))
    assert [r.line for r in io.phylip_lines(matrix, mode).orderBy("row_no").collect()] == want


def test_small_functions(spark):
    df = spark.createDataFrame([(0, 5, "a", "a"), (3, 2, "a", "b")], "x int, y int, s string, t string")
    got = df.orderBy("x").select(saturating_subtract(F.col("x"), F.col("y")), gap_penalty(F.col("x"), -1.0, -5.0), token_score(F.col("s"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(0, 0.0, 1.0), (1, -16.0, -0.2)]
    sets = spark.createDataFrame([("a", "g", 1), ("b", "g", 1), ("b", "g", 2), ("c", "h", 1)], "name string, genome string, hash long")
    assert rows(distance.merged_sets(sets, "genome"), "name", "hash") == [("g", 1), ("g", 2), ("h", 1)]
    clusters = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", None)], "node string, cluster string")
    assert rows(cluster.representative_pairs(clusters), "representative", "node") == [("a", "a"), ("a", "b")]


def test_copies_and_files_by_name(spark, tmp_path):
    df = spark.createDataFrame([("c", "ACGT"), ("a", "acgt"), ("b", "AAC"), ("d", "GTT"), ("a", "TT")], "name string, seq string")
    assert rows(records.duplicates(df), "kept", "dropped") == []
    assert rows(records.duplicates(df, ignore_case=True), "kept", "dropped") == [("a", "c")]
    assert rows(records.duplicates(df, both_strands=True, ignore_case=True), "kept", "dropped") == [("a", "c"), ("b", "d")]
    records.split_by_name(df, str(tmp_path / "out"))
    assert rows(io.read_fasta(spark, str(tmp_path / "out" / "name=a")), "name", "seq") == [("a", "TT"), ("a", "acgt")]
