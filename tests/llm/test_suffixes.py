import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from seqloom.llm.suffixes import ORACLE, adjacent_common_prefixes, remove_repeats, repeated_starts, two_stage_order


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_order_is_lexicographic():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 60)
        data = np.array([rng.choice([0, 1, 2, 200, 255][: rng.randint(1, 5)]) for _ in range(n)], np.uint8)
        wanted = np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
        order = two_stage_order(data, wanted, n + 1)
        raw = data.tobytes()
        assert order.tolist() == sorted(wanted.tolist(), key=lambda i: raw[i:])
        lcp = adjacent_common_prefixes(data, order, 5)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :][:5].ljust(5, b"\0"), raw[order[k] :][:5].ljust(5, b"\0")
            assert lcp[k] == next((i for i in range(5) if a[i] != b[i]), 5)


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.randint(1, 6)
        texts = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(length, 25))) for _ in range(rng.randint(1, 6))]
        texts = list(dict.fromkeys(texts))
        starts = [rng.randint(1, len(t) - length + 1) for t in texts]
        counts = [rng.choice([1, 1, 2]) for _ in texts]
        seen = Counter()
        for t, n, c in zip(texts, starts, counts, strict=True):
            for i in range(n):
                seen[t[i : i + length]] += c
        got = repeated_starts(texts, starts, counts, length)
        assert [h.tolist() for h in got] == [[seen[t[i : i + length]] > 1 for i in range(n)] for t, n in zip(texts, starts, strict=True)]


@pytest.mark.parametrize(("length", "gram", "bucket", "stretch"), [(40, 10, 500, 9), (40, 10, 2, 500), (40, 10, 1, 2), (400, 100, 500, 9), (400, 100, 1, 500), (12, 3, 3, 1)])
def test_against_brute_force(spark, length, gram, bucket, stretch):
    rng = random.Random(length + bucket)
    made = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))) for _ in range(n))
    common, texts = made(max(12, length // 3)), [None, "", "short", "ab" * 700, "xyz " * 300, "a" * 1500]
    for _ in range(30):
        t = made(rng.choice([5, 60, 200]))
        if rng.random() < 0.5:
            at = rng.randrange(len(t))
            t = t[:at] + common[rng.randrange(9) : len(common) - rng.randrange(9)] + t[at:]
        texts.append(t)
        if rng.random() < 0.3:
            texts.append(t)
        if rng.random() < 0.4:
            at = rng.randrange(len(t))
            texts.append(t[:at] + "#" + t[at:])
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(8, texts[8], 0), (None, texts[9], 0)]
    texts += [texts[8], texts[9]]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(3)
    got = remove_repeats(df, length=length, gram=gram, bucket_classes=bucket, stretch_classes=stretch).collect()
    want = sorted(((r[0] is None, r[0] or 0), *w) for r, w in zip(rows, brute(texts, length), strict=True))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{path}'")
    want = sorted(db.execute(ORACLE).fetchall())
    got = remove_repeats(spark.read.parquet(path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == want and any(r[2] for r in want)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_several_pieces(spark):
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     ", np.uint8)
    made = lambda n: letters[rng.integers(0, len(letters), n)].tobytes().decode()
    passage, long = made(700), made((1 << 20) + 300_000)
    border = (1 << 20) - 350
    texts = [long[:5000] + passage + long[5000:border] + passage[:650] + long[border:], made(900) + passage, long[1 << 20 :][:2000]]
    seen = Counter(hash(t[i : i + 400]) for t in texts for i in range(len(t) - 399))
    want = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = True
        want.append((len(t), int(gone.sum()), hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    got = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.kept_sha256) for r in got] == want and want[0][1] > 3000
