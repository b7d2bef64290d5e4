import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from seqloom.llm.simhash import fingerprint, hamming_links, shingle_hashes, simhash_components, trie_pairs


def brute(texts):
    import re

    prints = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    return prints


def test_fingerprint_matches_definition():
    texts = ["", " \t\n", "One", "one TWO", "a b c d e f é Ñ", "x " * 50, "Ä b c"]
    assert [fingerprint(shingle_hashes(t.encode(), 3)) for t in texts] == brute(texts)


def test_trie_pairs_against_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    keys = np.unique(np.concatenate([base, *(b ^ (np.uint64(1) << rng.integers(0, 64, 9, dtype=np.uint64)) for b in base)]))
    i, j = trie_pairs(keys, np.array([0]), np.array([len(keys)]), 0, 3)
    want = {(a, b) for a, b in combinations(range(len(keys)), 2) if bin(int(keys[a] ^ keys[b])).count("1") <= 3}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("rows", [3, 1024])
def test_components_against_brute_force(spark, rows):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(40)]
    texts = []
    for _ in range(25):
        body = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(body))
        for _ in range(3):
            body[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(body))
    texts += [None, "", "  ", texts[0], texts[0].upper()]
    data = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, fp string")
    prints = brute(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 3:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {i: (f"{prints[i]:016x}", find(i)) for i in range(len(texts))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(df).collect()}
    assert got == want
    import seqloom.llm.simhash as s

    d = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in sorted(set(prints))], "fp long")
    a = {tuple(sorted(r)) for r in hamming_links(d, subtrie_rows=rows).collect()}
    b = {tuple(sorted(r)) for r in hamming_links(d, blocks=8).collect()}
    for links in (a, b):
        for x, y in links:
            assert bin((x ^ y) & (2**64 - 1)).count("1") <= 64
    assert s.connected_components(spark.createDataFrame(list(a), "a long, b long")).count() == s.connected_components(spark.createDataFrame(list(b), "a long, b long")).count()


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
