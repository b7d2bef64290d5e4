import random
from itertools import combinations

import numpy as np

from seqloom.llm.lsa import LatentSpace, common_subsequence, drop_leaks, find_leaks, term_ids, windows, words_of


def test_common_subsequence():
    rng = random.Random(0)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(rng.randrange(12))] for _ in range(2))
        assert common_subsequence(a, b) == plain(a, b)


def made(rng, n):
    return " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(spark):
    rng = random.Random(7)
    items = [(i, made(rng, rng.randint(15, 55)).capitalize() + ". " + made(rng, 5) + ".") for i in range(20)] + [(90, None), (91, ""), (3, None)]
    docs, leaks = [], set()
    for i in range(300):
        text = made(rng, rng.choice([3, 40, 200, 900]))
        if i % 10 == 0:
            item, body = rng.choice(items[:20])
            words = body.split()
            if i % 20 == 0:  # a paraphrase: some words are others
                for k in range(len(words)):
                    if rng.random() < 0.12:
                        words[k] = made(rng, 1)
            text = f"{text} {' '.join(words)} {made(rng, 60)}"
            leaks.add((i, item))
        docs.append((i, text, "i"))
    docs += [(900, None, "i"), (901, "", "i"), (902, " \n!", "i"), (0, docs[0][1], "i")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), leaks


def test_leaks_planted(spark):
    docs, items, leaks = corpus(spark)
    for at_once in (20_000, 6):
        rows = find_leaks(docs, items, at_once=at_once).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == leaks and len(rows) == len(leaks) + 1
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns
    gone = {i for i, _ in leaks}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in gone)


def test_sketch_spans_the_leading_space(spark):
    docs, _, _ = corpus(spark)
    space = LatentSpace.fit(docs)
    rows = np.array([space.to_latent[term_ids(words_of((r.text or "").encode()))].sum(0) for r in docs.collect()])
    assert np.isfinite(rows).all() and np.linalg.matrix_rank(rows) > 50
    unit = rows[np.linalg.norm(rows, axis=1) > 0]
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    assert np.median([abs(unit[a] @ unit[b]) for a, b in combinations(range(60), 2)]) < 0.3


def test_empty(spark):
    docs, items, _ = corpus(spark)
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0
    assert drop_leaks(docs, items.limit(0)).count() == docs.count()
    assert drop_leaks(docs.limit(0), items).count() == 0


def test_short_items(spark):
    rng = random.Random(11)
    vocabulary = made(rng, 3000).split()
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    whole, edited, items, docs = set(), set(), [], []
    for i in range(400):
        n = rng.choice([3, 5, 6, 8, 10, 12, 15, 20, 23])
        words = text(n)
        items.append((i, " ".join(words)))
        if i % 2 and n >= 5:
            # a fifth of the words are others
            for k in rng.sample(range(n), n // 5):
                words[k] = rng.choice(vocabulary)
            edited.add((i, i))
        else:
            whole.add((i, i))
        docs.append((i, " ".join(text(rng.randrange(80)) + words + text(rng.randrange(80)))))
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert whole <= got
    assert len(edited & got) >= 0.97 * len(edited)
    # what else is found fills the rule by chance, with two of an item's three words
    words = [dict((i, words_of(t.encode())) for i, t in x) for x in (docs, items)]
    others = got - whole - edited
    assert all(common_subsequence(words[1][item], words[0][doc]) >= 0.6 * len(words[1][item]) for doc, item in others)
    assert {len(words[1][item]) for _, item in others} <= {3}


def test_long_texts_on_an_items_topic(spark):
    rng = random.Random(5)
    items = [(i, made(rng, rng.randint(20, 50)) + ". " + made(rng, 4) + ".") for i in range(36)]
    docs = [(1000 + i, made(rng, 300)) for i in range(200)]
    copies = set()
    for i, text in items:
        words = text.split()
        for times in (1, 2, 4, 8, 40):
            mixed = [w for _ in range(times) for w in rng.sample(words, len(words))]
            docs.append((2000 + 100 * i + times, " ".join(mixed)))
            # the same with the item itself in it, one word in ten another
            own = [made(rng, 1) if rng.random() < 0.1 else w for w in words]
            at = rng.randrange(len(mixed) + 1)
            docs.append((9000 + 100 * i + times, " ".join(mixed[:at] + own + mixed[at:])))
            copies.add((9000 + 100 * i + times, i))
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert copies <= got
    # of 180 texts with an item's words in any order
    assert len(got - copies) <= 2


def test_windows_hold_edited_copies():
    for n in (1, 3, 5, 8, 24, 55):
        for lo, hi in ((0, 4), (3, 3 + n), (10, 10 + 2 * n + 24), (0, 40 * n)):
            parts = list(windows(lo, hi, n))
            assert parts[0][0] == lo and parts[-1][1] == hi and all(a < b for a, b in parts)
            assert all(any(a <= x and min(x + n + n // 4, hi) <= b for a, b in parts) for x in range(lo, hi))
