import math
import random

import duckdb
import numpy as np
import pytest

from seqloom.llm import hard_negatives as hn
from seqloom.llm.queries import op12_hard_negatives

SF = "/root/testdata/sf0.001"


def plain(rows, every=50, o=None):
    """Every anchor against every row."""
    o = o or hn.Mining()
    vectors = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in vectors:
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m == label) for j, m, w in vectors if j != i]
        for ps, j in sorted(((s, j) for s, j, same in scored if same), key=lambda x: (-x[0], x[1]))[: o.positives]:
            fits = sorted(((s, n) for s, n, same in scored if not same and o.least * ps <= 100 * s <= o.most * ps), key=lambda x: (-x[0], x[1]))
            out += [(i, j, k, n, ps, s) for k, (s, n) in enumerate(fits[: o.negatives], 1)]
    return sorted(out)


def got(spark, rows, every=50, o=None):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, rank int, v string").repartition(3)
    return sorted(tuple(r) for r in hn.mine(hn.relabelled(hn.integer_vectors(df)), every, o).collect())


def made(rng, n, dims, kinds):
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(kinds)]
    return [[c + rng.gauss(0, 0.1) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("seed, blocks, segments", [(1, 1024, 512), (2, 3, 5), (3, 1, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, blocks, segments):
    monkeypatch.setattr(hn, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(hn, "SEGMENT_ROWS", segments)
    monkeypatch.setattr(hn, "PIVOTS", 6)
    rng = random.Random(seed)
    rows = [(i - 20, rng.randrange(4), v) for i, v in enumerate(made(rng, 300, 5, 4))]
    # a vector that a third of all rows share, null and odd rows, zero and short vectors, repeated rows
    rows += [(1000 + i, rng.randrange(3), rows[7][2]) for i in range(120)]
    rows += [(50, None, [0.1] * 5), (100, 1, None), (150, 1, [0.1, None, 0, 0, 0]), (200, 1, [0.1, math.inf, 0, 0, 0]), (250, 1, [math.nan] * 5), (None, 1, [0.2] * 5), (2000, 2, [0.0] * 5), (2050, 2, []), (2100, 2, [0.5]), (2150, 3, [0.3, 0.3])]
    rows += [(2100, 2, [0.5]), (3000, 0, rows[3][2]), (3000, 0, rows[3][2])]
    rng.shuffle(rows)
    rows = [(i, m, None if v is None else [x if x is None else float(f"{x:.4f}") for x in v]) for i, m, v in rows]
    rows = [(i, m, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, m, v in rows]
    assert got(spark, rows) == plain(rows)


def test_other_numbers_and_no_rows(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, [float(round(x, 2)) for x in v]) for i, v in enumerate(made(rng, 60, 3, 2))]
    rows = [(i, m, [float(np.float32(x)) for x in v]) for i, m, v in rows]
    o = hn.Mining(positives=2, negatives=4, least=10, most=80)
    assert got(spark, rows, 5, o) == plain(rows, 5, o)
    assert got(spark, rows[1:5]) == [] and got(spark, [(0, 1, [0.5])]) == []
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hn.mine(hn.integer_vectors(empty)).count() == 0
    with pytest.raises(Exception, match="31 bits"):
        got(spark, [(0, 1, [1e30])])
    with pytest.raises(ValueError, match="2\\^53"):
        got(spark, [(0, 1, [1e6] * 3)])


def test_rounds_scan_less_than_everything(spark, monkeypatch):
    """Far clusters are never met, and what is met suffices."""
    monkeypatch.setattr(hn, "SEGMENT_ROWS", 8)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 1)
    met = []
    whole = hn._meetings
    monkeypatch.setattr(hn, "_meetings", lambda *a: met.append(whole(*a)) or met[-1])
    kept = hn.materialise
    seen = []
    monkeypatch.setattr(hn, "materialise", lambda df: (out := kept(df), seen.append(out.count()) if met and df is met[-1] else None)[0])
    rng = random.Random(4)
    rows = [(i, i % 3, [2.0 * math.cos(c) + rng.gauss(0, 0.01), 2.0 * math.sin(c) + rng.gauss(0, 0.01)]) for i in range(800) for c in [2 * math.pi * (i % 40) / 40]]
    rows = [(i, m, [float(np.float32(x)) for x in v]) for i, m, v in rows]
    o = hn.Mining(positives=3, negatives=3, least=90, most=100)
    assert got(spark, rows, 50, o) == plain(rows, 50, o)
    pairs = sum(seen)
    # two searches of 16 anchors over 100 segments or more
    assert 0 < pairs < 0.5 * 2 * 16 * 100


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = c.execute(hn.ORACLE)
    names = [d[0] for d in want.description]
    rows = sorted(tuple(r) for r in op12_hard_negatives(spark, SF).select(*names).collect())
    assert rows == sorted(want.fetchall()) and rows
