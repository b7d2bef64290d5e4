import hashlib
import random

import numpy as np
import pytest

from seqloom.llm.syncmers import K, S, anchors, edit_fingerprints, likeness, listed, matched_places, window_min


def made(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_closed_syncmers_by_definition():
    rng = random.Random(1)
    texts = [made(rng, n).encode() for n in (0, 1, 3, 12, 60, 400)] + [b"", b"ab" * 300]
    import seqloom.llm.syncmers as m

    for text, (places, hashes) in zip(texts, anchors(texts), strict=True):
        runs = {}
        for i in range(len(text) - S + 1):
            sub = text[i : i + S]
            v = 0
            for j, c in enumerate(sub):
                v = (v + int(m._byte_values()[c]) * pow(m._BASE, j, 1 << 64)) % (1 << 64)
            runs[i] = int(m._mix(np.array([v], np.uint64))[0])
        want = [i for i in range(len(text) - K + 1) if min(runs[j] for j in range(i, i + K - S + 1)) in (runs[i], runs[i + K - S])]
        assert places.tolist() == (want or ([0] if text else []))
        assert len(hashes) == len(places)


def test_context_free_and_matched():
    rng = random.Random(2)
    a, b, c = made(rng, 200).encode(), made(rng, 200).encode(), made(rng, 50).encode()
    (x,), (y,) = anchors([a + b]), anchors([c + b])
    shift = len(c) - len(a)
    got = matched_places(x, y)
    assert len(got) > 10 and all(q - p == shift for p, q in got)


def test_window_min():
    x = np.random.default_rng(0).integers(0, 99, 300)
    for w in (1, 2, 3, 7, 33, 300):
        assert window_min(x, w).tolist() == [x[i : i + w].min() for i in range(300 - w + 1)]


@pytest.mark.parametrize("n", [1, 2, 60])
def test_query_against_plain(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(10**6), made(rng, rng.choice([0, 1, 5, 50, 300]))) for _ in range(n)]
    if n > 10:
        rows += [(5, None), (7, ""), (rows[0][0], rows[0][1]), (rows[1][0], "another"), (10**7, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, bucket string").repartition(5)
    got = sorted(edit_fingerprints(df).collect(), key=lambda r: (r.doc_id, r.n_chars))
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    order = sorted(rows, key=lambda r: r[0])
    for i, (doc, text) in enumerate(order):
        if sum(r[0] == doc for r in rows) > 1 or sum(r[0] == order[(i + 1) % len(order)][0] for r in rows) > 1:
            continue
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + nxt[:cut]
        (r,) = by_id[doc]
        a, b, c = anchors([text.encode(), new.encode(), nxt.encode()])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (listed(a[1]), listed(b[1]))
        assert (r.near_edited, r.near_next) == (likeness(a[1], b[1]), likeness(a[1], c[1]))


def test_empty_table(spark):
    assert edit_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
