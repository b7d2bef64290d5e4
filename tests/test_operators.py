"""Small cases with known results."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.functions import hashing
from seqloom.functions.ranges import format_range, parse_range
from seqloom.functions.sequence import bloom_size, gap_units, odd_window, reverse_complement, translate_frame
from seqloom.operators import annotations, chain, cluster, distance, graph, intervals, layout, merge, minimizers, records, synteny
from seqloom.operators.align import align
from seqloom.sources import text as io

SKETCH = "hash long, seq_id int, pos int, strand boolean"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_soft_mask_and_canonical(spark):
    df = spark.createDataFrame([(1, "ACGTacgtACGT")], "seq_id int, seq string")
    assert rows(minimizers.sketch(df, 4, 1, soft_mask=True), "pos") == [(0,), (8,)]
    one = spark.createDataFrame([(1, "ACGT")], "seq_id int, seq string")
    assert minimizers.sketch(one, 4, 1).count() == 1
    with pytest.raises(ValueError, match="65535"):
        minimizers.sketch(one, 4, 70_000)


def plain_hash(hasher, kmer):
    if hasher == "md5":
        return int.from_bytes(hashlib.md5(kmer).digest()[:8]) >> 4
    if hasher in ("xxhash", "rapid"):
        return xxhash.xxh64_intdigest(kmer) >> 4
    if hasher == "murmur":
        return murmur3(kmer) >> 4
    digits = [kmer[i : i + 8] for i in range(0, len(kmer), 8)]
    mask, h = (1 << 64) - 1, 0
    if hasher == "fx":
        parts = [d for d in digits if len(d) == 8]
        rest = digits[-1] if len(digits[-1]) < 8 else b""
        parts += ([rest[:4], *(bytes([c]) for c in rest[4:])] if len(rest) >= 4 else [bytes([c]) for c in rest])
        for part in parts:
            h = (((h << 5 | h >> 59) & mask) ^ int.from_bytes(part, "little")) * 0x517CC1B727220A95 & mask
        return h >> 4
    for d in digits:
        h = (h * 31 + int.from_bytes(d.ljust(8, b"\0"))) % ((1 << 59) - 55)
    return h


def murmur3(key, seed=42):
    """MurmurHash3 for x64, 128 bits: the low word."""
    mask = (1 << 64) - 1
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    turn = lambda x, r: (x << r | x >> 64 - r) & mask
    h1 = h2 = seed
    whole = len(key) // 16 * 16
    for at in range(0, len(key), 16):
        k1, k2 = int.from_bytes(key[at : at + 8], "little"), int.from_bytes(key[at + 8 : at + 16], "little")
        k1, k2 = turn(k1 * c1 & mask, 31) * c2 & mask, turn(k2 * c2 & mask, 33) * c1 & mask
        h1 ^= k1
        if at == whole:
            h2 ^= k2
            break
        h1 = ((turn(h1, 27) + h2) * 5 + 0x52DCE729) & mask
        h2 = ((turn(h2 ^ k2, 31) + h1) * 5 + 0x38495AB5) & mask
    h1, h2 = h1 ^ len(key), h2 ^ len(key)
    h1 = h1 + h2 & mask
    h2 = h2 + h1 & mask
    out = 0
    for h in (h1, h2):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * m & mask
        out += h ^ h >> 33
    return out & mask


def test_published_hashes():
    rng = random.Random(5)
    for hasher in hashing.HASHERS:
        for size in (1, 3, 4, 7, 8, 9, 15, 16, 17, 24, 31, 32, 33, 47, 55, 56, 63, 64, 65, 120):
            data = bytes(rng.randrange(256) for _ in range(size + 9))
            words = hashing.kmer_words(hashing.words_of(np.frombuffer(data, np.uint8)), slice(0, 10), size)
            assert hashing.hash60_of(hasher, words, size).tolist() == [plain_hash(hasher, data[i : i + size]) for i in range(10)], (hasher, size)


@pytest.mark.parametrize("hasher", sorted(minimizers.HASHERS))
@pytest.mark.parametrize("both", [True, False])
def test_minimizers_against_plain_windows(spark, hasher, both):
    rng = random.Random(len(hasher))
    seqs = [None, "", *["".join(rng.choice("ACGTacgté" if n == 70 else "ACGTacgt") for _ in range(n)) for n in (3, 8, 9, 40, 70, 300)]]
    df = spark.createDataFrame([(i, q, 0) for i, q in enumerate(seqs)], "seq_id int, seq string, pos int")
    k, w, short = 7, 5, 3
    turned = str.maketrans("ACGTacgt", "TGCAtgca")

    def of(kmer):
        other = kmer.translate(turned)[::-1].encode()
        return plain_hash(hasher, min(kmer.encode(), other) if both else kmer.encode()), not both or kmer.encode() <= other

    want = {mode: set() for mode in minimizers.MODES}
    for i, q in enumerate(seqs):
        n = len(q or "") - k + 1
        h = [of(q[p : p + k])[0] for p in range(n)]
        t = short + (k - short) % w
        for p in range(n - w + 1):
            want["sliding"].add((i, min(range(p, p + w), key=lambda x: (h[x], x))))
            want["centre"].add((i, p + (w - 1) // 2))
            least = min(range(w + k - t), key=lambda x: (of(q[p + x : p + x + t])[0], x))
            want["mod"].add((i, p + least % w))
        at, last = 0, -1
        while at + w <= n:
            last = min(range(at, at + w), key=lambda x: (h[x], x))
            want["jumping"].add((i, last))
            at = last + 1
        if n >= w:
            want["jumping"].add((i, min(range(n - w, n), key=lambda x: (h[x], x))))
    for mode in minimizers.MODES:
        got = minimizers.sketch(df, k, w, mode=mode, both_strands=both, hasher=hasher, short=short).collect()
        assert {(r.seq_id, r.pos) for r in got} == want[mode] and len(got) == len(want[mode]), mode
        assert all((r.hash, r.strand) == of(seqs[r.seq_id][r.pos : r.pos + k]) for r in got)


def test_sliding_against_brute_force(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (3, 8, 9, 40, 90)]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id int, seq string")
    k, w = 4, 5
    hashed = {}
    for r in minimizers.hashed_kmers(df, k).collect():
        hashed.setdefault(r.seq_id, {})[r.pos] = r.hash
    want = {(s, min(range(i, i + w), key=lambda p: (h[p], p))) for s, h in hashed.items() for i in range(len(h) - w + 1)}
    assert set(rows(minimizers.sketch(df, k, w, both_strands=False), "seq_id", "pos")) == want
    got = rows(minimizers.sketch(df, k, w, mode="jumping", both_strands=False), "seq_id", "pos")
    assert got == sorted(((s, p) for s, h in hashed.items() for p in minimizers.jump_places(np.array([h[i] for i in range(len(h))]), w)), key=str)
    assert minimizers.jump_places(np.array([1, 2]), 3) == []


def test_graph_path_and_cycle(spark):
    places = [(10, 1, 100), (20, 1, 200), (30, 1, 300), (40, 1, 400), (10, 2, 100), (20, 2, 200), (30, 2, 300), (50, 2, 400)]
    sketch = spark.createDataFrame([(*p, True) for p in places], SKETCH)
    edges = graph.adjacency(sketch, 1000)
    assert edges.count() == 6
    kept = graph.prune(edges, 2)
    assert kept.count() == 4
    paths = graph.linear_paths(kept)
    assert rows(paths, "path", "ord", "node") == [(10, 0, 10), (10, 1, 20), (10, 2, 30)]
    assert rows(graph.path_blocks(kept, paths, sketch), "path", "seq_id", "start", "end", "count") == [(10, 1, 100, 300, 2), (10, 2, 100, 300, 2)]
    ring = graph.adjacency(spark.createDataFrame([(10, 1, 1, True), (20, 1, 2, True), (10, 1, 3, True)], SKETCH), 10)
    assert rows(graph.linear_paths(ring), "path", "ord", "node") == [(10, 0, 10), (10, 1, 20)]


def test_blocks_of_identical_sequences(spark):
    rng = random.Random(7)
    seq = "".join(rng.choice("ACGT") for _ in range(1610))
    df = spark.createDataFrame([(1, seq), (2, seq)], "seq_id int, seq string")
    found = synteny.find_blocks(df, synteny.BlockOptions(k=21, rounds=(1000, 100, 10), sampling="center"))
    assert rows(found.where("seq_id = 1"), "block_id", "start", "end", "count", "round") == [(0, 500, 1089, 589, 1001), (1, 50, 1539, 899, 101), (2, 5, 1584, 89, 11)]
    found = synteny.find_blocks(df, synteny.BlockOptions(k=21, rounds=(500, 10), chain_gap=500, sampling="center"))
    assert rows(found.where("seq_id = 2"), "start", "end", "count") == [(1340, 1584, 244), (250, 1339, 1089), (5, 249, 244)]
    assert synteny.find_blocks(df, synteny.BlockOptions(k=24, rounds=(50,), block_size=50)).select("seq_id").distinct().count() == 2
    assert synteny.parse_round("10k") == 10_000 and odd_window(1000) == 1001


def test_merge():
    b = lambda n, s, e, t="+": [("G1", s, e, t, n), ("G2", s, e, t, n)]
    assert merge.fold_blocks([b(10.0, 100, 200), b(10.0, 300, 400)], 150) == [b(20.0, 100, 400)]
    assert len(merge.fold_blocks([b(1.0, 100, 200), b(1.0, 300, 400)], 99)) == 2
    assert merge.can_merge(b(1, 300, 400, "-"), b(1, 100, 200, "-"), 150) and not merge.can_merge(b(1, 300, 400, "-"), b(1, 350, 500, "-"), 150)
    assert merge.gap_for_divergence(None) == 100_000 and merge.gap_for_divergence(0.5) == 10_000


def test_chain(spark):
    o = chain.ChainOptions(min_pairs=1)
    got = chain.find_chains(np.array([150, 350]), np.array([150, 350]), np.array([47.5, 45.0], np.float32), o)
    assert got == [([0, 1], 92.5)]
    pos = spark.createDataFrame([("a", "P1.chr1", 100, 200, 1), ("b", "P1.chr1", 300, 400, 2), ("x", "P2.chr1", 100, 200, 3), ("y", "P2.chr1", 300, 400, 4)], "acc string, mol string, start long, end long, line_no long")
    m = spark.createDataFrame([("a", "x", 0.95, 1), ("y", "b", 0.9, 2), ("a", "a", 1.0, 3), ("a", "gone", 1.0, 4)], "acc1 string, acc2 string, similarity double, line_no long")
    found = chain.anchors(m, pos, options=o)
    assert rows(found, "mol1", "mol2", "acc1", "acc2", "x", "y") == [("P1.chr1", "P2.chr1", "a", "x", 150, 150), ("P1.chr1", "P2.chr1", "b", "y", 350, 350)]
    assert rows(chain.chain_ranges(chain.chains(found, o), pos), "seq_name", "start", "end", "count", "score") == [("P1.chr1", 100, 400, 2, "92.5"), ("P2.chr1", 100, 400, 2, "92.5")]


def test_alignment():
    a, b, s = align(list("CATGT"), list("ACGCTG"))
    assert ("".join(a), "".join(b)) == ("CAT-G-T-", "-A-CGCTG") and s == pytest.approx(2.95, abs=1e-4)
    a, b, s = align(list("CATGT"), list("ACGCTG"), 2, -1, -1)
    assert ("".join(a), "".join(b), s) == ("-CA-TGT", "ACGCTG-", 3.0)


def test_clusters(spark):
    pairs = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.1), ("d", "e", 0.1), ("f", "f", 0.0), ("c", "d", 0.9)], "n1 string, n2 string, value double")
    assert rows(cluster.components(pairs.where("value < 0.5").select("n1", "n2")), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")]
    assert rows(cluster.dbscan(pairs, 0.5, 3), "node", "cluster", "core") == [("a", "b", False), ("b", "b", True), ("c", "b", False), ("d", None, False), ("e", None, False), ("f", None, False)]
    w = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "e", 1.0), ("d", "f", 1.0), ("e", "f", 1.0), ("c", "d", 0.2)], "n1 string, n2 string, weight double")
    assert rows(cluster.mcl(w), "node", "cluster") == [(x, "a") for x in "abc"] + [(x, "d") for x in "def"]
    assert len(set(r[1] for r in rows(cluster.k_medoids(pairs, 2), "node", "medoid"))) == 2


def test_set_distances(spark):
    sets = spark.createDataFrame([("a", h) for h in range(10)] + [("b", h) for h in range(5, 15)] + [("c", 99)], "name string, hash long")
    got = {(r.n1, r.n2): r for r in distance.set_distances(sets, 7, zero=True, detail=True).collect()}
    assert len(got) == 9 and (got["a", "b"].n_both, got["a", "b"].n_union, got["a", "b"].jaccard, got["a", "b"].containment) == (5, 15, 0.3333, 0.5)
    assert got["a", "b"].mash == round(-math.log(2 * (1 / 3) / (4 / 3)) / 7, 4) and got["a", "c"].mash == 1.0 and got["a", "a"].mash == 0.0
    assert distance.set_distances(sets, 7).count() == 5


def test_pcoa(spark):
    p = {"a": (0.0, 0.0), "b": (3.0, 0.0), "c": (0.0, 4.0), "d": (3.0, 4.0)}
    pairs = spark.createDataFrame([(x, y, math.dist(p[x], p[y])) for x in p for y in p if x < y], "n1 string, n2 string, value double")
    got = {}
    for r in distance.pcoa(pairs).collect():
        got.setdefault(r.name, {})[r.axis] = r.value
    for x in p:
        for y in p:
            assert math.dist(got[x].values(), got[y].values()) == pytest.approx(math.dist(p[x], p[y]))


def test_intervals(spark):
    i = spark.createDataFrame([(1, 1, 5), (1, 6, 9), (1, 20, 30), (1, 22, 25), (2, 1, 1)], "seq_id int, start long, end long")
    assert rows(intervals.union(i), "seq_id", "start", "end") == [(1, 1, 9), (1, 20, 30), (2, 1, 1)]
    p = spark.createDataFrame([(1, 5), (1, 10), (1, 30), (2, 2), (3, 1)], "seq_id int, pos long")
    assert rows(intervals.outside(p, i, bin_size=4), "seq_id", "pos") == [(1, 10), (2, 2), (3, 1)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "g1.x.fa").write_text(">s1 first\nACGT\nacgt\n>s2\nTT\n")
    got = io.read_fasta(spark, str(tmp_path / "g1.x.fa"))
    assert rows(got, "genome", "name", "seq") == [("g1", "s1", "ACGTacgt"), ("g1", "s2", "TT")]
    assert rows(io.numbered(got, "name"), "seq_id", "display") == [(1, "s1"), (2, "s2")]
    (tmp_path / "r.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n@@\n")
    assert rows(io.read_fastq(spark, str(tmp_path / "r.fq")), "name", "seq", "quality") == [("r1", "ACGT", "IIII"), ("r2", "GG", "@@")]
    (tmp_path / "test.gff").write_text("##gff\nchr1\t.\tgene\t1000\t2000\t.\t+\t.\tID=gene1;Name=GENE%2C1\nchr1\t.\tgene\t3000\t4000\t.\t-\t.\tID=prefix:gene2\nchr1\t.\tCDS\t1\t9\t.\t.\t0\tName=NP_414542.1;Parent=a,b\n")
    gff = io.read_gff(spark, str(tmp_path / "test.gff"))
    assert rows(annotations.feature_ranges(gff, key="Name"), "key") == [("GENE,1",), ("NA",)]
    assert rows(annotations.feature_ranges(gff), "key", "range") == [("gene1", "test.chr1(+):1000-2000"), ("prefix:gene2", "test.chr1(-):3000-4000")]
    assert rows(annotations.feature_ranges(gff, "cds", "Name", F.lit("Human"), simplify=True), "key", "range") == [("NP_414542", "Human.chr1(+):1-9")]
    assert rows(annotations.feature_ranges(gff, "cds", "Parent"), "key") == [("NA",)]
    (tmp_path / "b.tsv").write_text("# Block\n7\tG1(-):100-200\t10\n7\tG2(+):100-200\t10\n7x\tbad\t1\n7\tG1(-):1-2\t5\n8\tG1(+):300-400\tx\n")
    blocks = io.read_blocks(spark, str(tmp_path / "b.tsv"))
    assert rows(blocks, "block_id", "ord", "seq_name", "score") == [(1, 1, "G1", 10.0), (1, 2, "G2", 10.0), (1, 3, "G1", 5.0), (2, 1, "G1", 0.0)]
    assert rows(io.block_lines(blocks.where("block_id = 1 and ord < 3"), "score"), "line") == [("1\tG1(+):100-200\t10.0",), ("1\tG2(-):100-200\t10.0",)]
    (tmp_path / "p.tsv").write_text("a\tm.1(+):10-20\nb\tx\ty\n")
    assert rows(io.read_positions(spark, str(tmp_path / "p.tsv")), "acc", "mol", "start", "end") == [("a", "m.1", 10, 20)]
    (tmp_path / "m.tsv").write_text("#c\n\na\tb\t0.5\na\tc\tbad\na\tb\n")
    assert rows(io.read_matches(spark, str(tmp_path / "m.tsv")), "acc1", "acc2", "similarity") == [("a", "b", 0.5), ("a", "c", 0.0)]


def test_records(spark):
    df = spark.createDataFrame([("a", "ACGTN"), ("b", "NACGT"), ("c", "AAaa"), ("d", "TTTT")], "name string, seq string")
    assert rows(records.runs(df), "name", "start", "end") == [("a", 5, 5), ("b", 1, 1), ("c", 3, 4)]
    assert rows(records.dedup(df, both_strands=True, ignore_case=True), "name", "n_copies") == [("a", 2), ("c", 2)]
    regions = spark.createDataFrame([("a", 2, 3), ("a", 5, 9)], "name string, start long, end long")
    assert rows(records.mask(df.where("name = 'a'"), regions), "seq") == [("AcgTn",)]
    assert rows(records.mask(df.where("name = 'a'"), regions, hard=True), "seq") == [("ANNTN",)]
    asked = spark.createDataFrame([("a(-):1-4",), ("a(+):4-9",), ("zz",)], "range string")
    assert rows(records.extract_ranges(df, asked), "range", "seq") == [("a(+):4-9", "TN"), ("a(-):1-4", "ACGT")]
    assert rows(df.select(reverse_complement(F.lit("ACGTRYacg")).alias("r")).distinct(), "r") == [("cgtRYACGT",)]
    assert rows(df.select(translate_frame(F.lit("ATGTAAATGNCC"), 0).alias("p")).distinct(), "p") == [("M*MX",)]
    got = records.nx(df, percents=(50,)).first()
    assert (got["n50"], got["sum"], got["count"]) == (5, 18, 4)


def test_ranges_and_layout(spark):
    df = spark.createDataFrame([("a.b(-):3-9",), ("bad",)], "t string").select(parse_range(F.col("t")).alias("r"))
    assert rows(df.where("r is not null").select(format_range(F.col("r.name"), F.col("r.strand"), F.col("r.start"), F.col("r.end")).alias("t")), "t") == [("a.b(-):3-9",)]
    assert layout.nice_length(7300) == (5000, "5 kb") and layout.nice_length(1.2e6) == (1_000_000, "1 Mb") and bloom_size(1000, 0.01) == (9586, 7)
    b = spark.createDataFrame([(0, 1, "A.c1", 0, 50, "+"), (0, 2, "B.c1", 10, 60, "-"), (1, 1, "A.c1", 0, 5, "+")], "block_id long, ord int, seq_name string, start long, end long, strand string")
    sizes = layout.inferred_sizes(b)
    for svg in (layout.ribbon_svg(b, sizes), layout.circle_svg(b, sizes)):
        assert svg.startswith("<svg") and svg.count("fill-opacity") == 1 and svg.endswith("</svg>")


def test_gap_units(spark):
    got = spark.range(1).select(gap_units(F.lit(199), F.lit(10), 10_000).alias("a"), gap_units(F.lit(5000), F.lit(10), 10_000).alias("b")).first()
    assert tuple(got) == (0, 1)


def test_stream(spark, tmp_path):
    from seqloom.streaming.records import kmer_counts, stream_table

    spark.createDataFrame([(1, "AAAT"), (2, "AAA")], "seq_id int, seq string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream_table(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = kmer_counts(source, 3).writeStream.format("memory").queryName("kmers").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("kmers"), "kmer", "n") == [("AAA", 2), ("AAT", 1)]


def test_descriptions_and_block_ids(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a b>c d\nAC\nGT\n>e\nTT\n")
    assert rows(io.read_fasta(spark, str(tmp_path / "x.fa")), "name", "description", "seq") == [("a", "a b>c d", "ACGT"), ("e", "e", "TT")]
    (tmp_path / "b.tsv").write_text("# x\n0\tA.c(+):1-5\t2\nid\tA.c(+):1-5\t2\n0\tB.c(-):1-5\t2\n7\tA.c(+):7-9\t1\n")
    assert rows(io.read_blocks(spark, str(tmp_path / "b.tsv")), "block_id", "ord", "seq_name") == [(1, 1, "A.c"), (1, 2, "B.c"), (2, 1, "A.c")]
