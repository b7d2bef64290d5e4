"""Translated stretches and what they share with proteins, against plain loops."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from seqloom.functions.sequence import AMINO_ACIDS, BASES, COMPLEMENTS, CODON_ORDER
from seqloom.operators import prefilter, records

CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(CODON_ORDER) for j, b in enumerate(CODON_ORDER) for k, c in enumerate(CODON_ORDER)}
TURNED = str.maketrans(BASES, COMPLEMENTS)


def frames_plainly(name, seq, least):
    n = len(seq)
    for strand, s in (("+", seq), ("-", seq.translate(TURNED)[::-1])):
        s = s.replace("U", "T")
        for frame in range(3):
            b = frame + 1
            for p in "".join(CODONS.get(s[i : i + 3], "X") for i in range(frame, n - 2, 3)).split("*"):
                e = b + 3 * len(p) - 1
                if len(p) >= least:
                    yield (name, strand, frame, b, e, p) if strand == "+" else (name, strand, frame, n - e + 1, n - b + 1, p)
                b = e + 4


def shared_plainly(protein, known, k, w):
    hashes = [int(hashlib.md5(protein[i : i + k].encode()).hexdigest()[:15], 16) for i in range(len(protein) - k + 1)]
    return len({min(hashes[i : i + w]) for i in range(len(hashes) - w + 1)} & known)


@pytest.mark.parametrize("least", [0, 1, 4])
def test_six_frames_of_odd_records(spark, monkeypatch, least):
    monkeypatch.setattr(records, "FRAME_SLAB", 100)
    rng = random.Random(3)
    seqs = ["", "A", "AC", "TAA", "TTA", None, "é" * 7, "ACG\nTTT\r\nGGG", "A,C,GTAUUAUG", "acgTAGACGN"] + ["".join(rng.choices("ACGTUNaé", [9, 9, 9, 9, 4, 1, 1, 1], k=rng.randrange(90))) for _ in range(40)]
    df = spark.createDataFrame([(i % 30, s) for i, s in enumerate(seqs)], "name int, seq string")
    want = [r for i, s in enumerate(seqs) if s is not None for r in frames_plainly(i % 30, s, least)]
    assert sorted(tuple(r) for r in records.six_frames(df, least=least).collect()) == sorted(want)


@pytest.mark.parametrize(("shared", "k", "w"), [(1 << 20, 4, 2), (1 << 20, 3, 10), (1 << 20, 5, 2), (3, 4, 2)])
def test_records_of_one_name_keep_their_own_counts(spark, monkeypatch, shared, k, w):
    monkeypatch.setattr(prefilter, "SHARED_HASHES", shared)
    rng = random.Random(4)
    seqs = [("a" if i < 3 else f"n{i}", "".join(rng.choices("ACGT", k=rng.choice([5, 60, 300])))) for i in range(12)]
    # one record three times, under one name
    seqs += [("twin", seqs[5][1] + "ACGTTACCATT" * 9)] * 3
    rows = [r for n, s in seqs for r in frames_plainly(n, s, 8)]
    proteins = [(f"p{i}", r[5]) for i, r in enumerate(rows) if i % 5 == 0]
    known = set()
    for _, p in proteins:
        hashes = [int(hashlib.md5(p[i : i + k].encode()).hexdigest()[:15], 16) for i in range(len(p) - k + 1)]
        known |= {min(hashes[i : i + w]) for i in range(len(hashes) - w + 1)}
    want = sorted((*r[:5], n) for r in rows if (n := shared_plainly(r[5], known, k, w)))
    got = prefilter.prefilter(spark.createDataFrame(seqs, "name string, seq string"), spark.createDataFrame(proteins, "name string, seq string"), k, w, 8)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 10


def test_six_frames_of_a_long_record(spark):
    """Some seconds of work at most: a record is no list of codons."""
    df = spark.range(1).select(F.col("id").alias("name"), F.repeat(F.lit("ACGTTGCAAC"), 800_000).alias("seq"))
    began = time.time()
    got = records.six_frames(df, least=100).agg(F.count("*"), F.sum(F.length("protein"))).first()
    assert tuple(got) == (6, 15_999_996)
    assert time.time() - began < 60
