import random

import numpy as np

import corpus_pipeline
from seqloom.llm._store import materialise
from seqloom.llm.lsa import common_subsequence, words_of
from seqloom.llm.neardup import near_dedup
from seqloom.llm.secrets import Scanner
from seqloom.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.01"


def similarity(a, b):
    a, b = (set(shingle_hashes((t or "").encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(8)
    made = lambda n: [("w%d" % rng.randrange(5000)) for _ in range(n)]
    texts = [None, "", " ", "one two", "One TWO"]
    for _ in range(40):
        body = made(rng.choice([6, 80, 300, 900]))
        texts.append(" ".join(body))
        for share in (0.0, 0.01, 0.1):
            other = [rng.choice(made(1)) if rng.random() < share else w for w in body]
            texts.append(" ".join(other))
    df = spark.createDataFrame([(i, t, f"s{i}", "x") for i, t in enumerate(texts)] + [(7, texts[7], "s7", "x")], "doc_id long, text string, source string, name string")
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    border = set()
    for a in range(len(texts)):
        for b in range(a):
            s = similarity(texts[a], texts[b])
            if s >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
            if 0.65 < s < 0.92:
                border |= {a, b}
    got = near_dedup(df)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids))
    sure = {i for i in range(len(texts)) if find(i) not in {find(b) for b in border}}
    assert len(sure) > 100
    assert {i for i in ids if i in sure} == {i for i in sure if find(i) == i}
    assert near_dedup(df.limit(0)).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SF))
        kept.append((name, before, docs))
    for _, before, after in kept[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in kept[0][2].collect()}
    assert sum((i in good) == bool(q) for i, q in labels.items()) / len(labels) > 0.98
    # near copies: exact copies leave one, and what stays has no copy
    texts = [r.text for r in kept[1][2].collect()]
    assert len({t.lower() for t in texts}) == len(texts) and {t.lower() for t in texts} <= {r.text.lower() for r in kept[1][1].collect()}
    # decontamination against a scan of all words
    items = [words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept[2][2].collect()}
    for r in kept[2][1].collect():
        joined = b" %s " % b" ".join(words_of(r.text.encode()))
        assert (r.doc_id not in clean) == any(b" %s " % b" ".join(i) in joined for i in items), r.doc_id
    assert common_subsequence(items[0], items[0]) == len(items[0])
    before, after = ({r.doc_id: r for r in x.collect()} for x in kept[3][1:])
    scan = Scanner()
    assert before.keys() == after.keys()
    for i, r in before.items():
        assert (after[i].text == r.text) == (not scan.spans(r.text)) and after[i].n_chars == len(after[i].text)
    rows = kept[4][2].collect()
    assert {r.doc_id for r in rows} == after.keys() and all(r.round_trip for r in rows)
    assert np.isfinite([r.log_prob for r in rows]).all()
