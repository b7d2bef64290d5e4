import itertools
import math
import random

import numpy as np
import pytest
import sentencepiece

from seqloom.llm.pieces import BYTE_SCORE, MODEL, Lattices, decode_ids, encode_samples, sample_segmentations, vocabulary, words_of


def every(vocab, word):
    """All segmentations of a word with their scores."""
    if not word:
        return [((), 0.0)]
    out = []
    for j in range(1, len(word) + 1):
        if word[:j] in vocab:
            out += [((vocab[word[:j]][0], *rest), vocab[word[:j]][1] + s) for rest, s in every(vocab, word[j:])]
    return out


@pytest.fixture(scope="module")
def plain():
    v = vocabulary()
    return {v.pieces[i]: (i, float(v.score[i])) for i in np.flatnonzero(np.isfinite(v.score)).tolist()}


def test_probabilities_against_enumeration(plain):
    v = vocabulary()
    text = "the cat"
    found = sample_segmentations([text], np.array([5]), 400, Lattices(v))[0]
    words = [every(plain, w) for w in words_of(text)]
    all_ = {tuple(i for w in c for i in w[0]): sum(w[1] for w in c) for c in itertools.product(*words)}
    total = math.log(sum(math.exp(s) for s in all_.values()))
    got = {tuple(ids.tolist()): lp for ids, lp, _ in found}
    assert len(got) == len(found) == min(400, len(all_))
    for ids, lp in got.items():
        assert lp == pytest.approx(all_[ids] - total)
        assert v.decode(list(ids)) == text


def test_all_segmentations_come_out(plain):
    v = vocabulary()
    want = {s for s, _ in every(plain, "▁dog")}
    found = sample_segmentations(["dog"], np.array([1]), 1000, Lattices(v))[0]
    assert {tuple(x[0].tolist()) for x in found} == want and len(found) == len(want)
    assert found[-1][2] == 1.0


def test_sampling_law(plain):
    """The first sample follows the segmentation's probabilities, and the second those of what is left."""
    v = vocabulary()
    every_one = every(plain, "▁to")
    total = sum(math.exp(s) for _, s in every_one)
    p = {ids: math.exp(s) / total for ids, s in every_one}
    n = 20_000
    found = sample_segmentations(["to"] * n, np.arange(n), 2, Lattices(v))
    first, second = {}, {}
    for f in found:
        a, b = (tuple(x[0].tolist()) for x in f)
        first[a] = first.get(a, 0) + 1
        second[a, b] = second.get((a, b), 0) + 1
    for ids, q in p.items():
        assert first.get(ids, 0) / n == pytest.approx(q, abs=4 * math.sqrt(q * (1 - q) / n) + 1e-9)
        for other, r in p.items():
            if other != ids:
                w = q * r / (1 - q)
                assert second.get((ids, other), 0) / n == pytest.approx(w, abs=4 * math.sqrt(w * (1 - w) / n) + 1e-9)


def test_inclusion_scores_are_unbiased():
    v = vocabulary()
    n = 4000
    sums = [sum(math.exp(lp) / inc for _, lp, inc in f) for f in sample_segmentations(["cats run"] * n, np.arange(n), 3, Lattices(v))]
    assert np.mean(sums) == pytest.approx(1, abs=5 * np.std(sums) / math.sqrt(n))


def test_round_trip_and_seeds():
    v, rng = vocabulary(), random.Random(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "\n", "  a  b \n\n c", "漢字 ▁ \0  ", "\ue000\ue004 \U000f0000", "x" * 3000, "é" * 50] + ["".join(rng.choice("ab cé\n漢▁") for _ in range(rng.randrange(40))) for _ in range(200)]
    keys = np.arange(len(texts))
    a = sample_segmentations(texts, keys, 3, Lattices(v))
    b = [sample_segmentations([t], keys[i : i + 1], 3, Lattices(v))[0] for i, t in enumerate(texts)]
    for t, x, y in zip(texts, a, b, strict=True):
        assert [(i.tolist(), inc) for i, _, inc in x] == [(i.tolist(), inc) for i, _, inc in y]
        assert len({tuple(i.tolist()) for i, *_ in x}) == len(x) >= 1
        for ids, lp, inc in x:
            assert v.decode(ids.tolist()) == t and lp < 1e-9 and 0 <= inc <= 1
            if t and not set(t) & set("\0▁"):
                assert sp.decode(ids.tolist()) == t
    assert BYTE_SCORE < 0


def test_query_rows(spark):
    rows = [(1, "hello there world", 0), (1, "hello there world", 0), (2, None, 0), (3, "", 0), (4, "a\nb", 0), (None, "nulls", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = encode_samples(df, k=3)
    out = got.collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} == {1, 2, 3, 4, None}
    assert sorted(r.sample for r in out if r.doc_id == 1) == [0, 0, 1, 1, 2, 2]
    assert [(r.n_ids, r.inclusion) for r in out if r.doc_id in (2, 3)] == [(0, 1.0)] * 2
    assert {r.decoded for r in decode_ids(got).collect()} == {"hello there world", "", "a\nb", "nulls"}
    assert encode_samples(df.limit(0)).count() == 0


def test_words_that_recur_stay_known(monkeypatch):
    """A full memory forgets only the words that came once; samples do not depend on what it holds."""
    from seqloom.llm import pieces

    monkeypatch.setattr(pieces, "KEPT_NODES", 400)
    v, rng = vocabulary(), random.Random(8)
    lat, made = Lattices(v), []
    make = lat._make
    monkeypatch.setattr(lat, "_make", lambda new: (made.extend(new), make(new)))
    for i in range(30):
        text = "the same words\nagain 漢 " + " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(10))
        keys = np.array([i])
        (got,), (want,) = sample_segmentations([text], keys, 3, lat), sample_segmentations([text], keys, 3, Lattices(v))
        assert [(a.tolist(), b, c) for a, b, c in got] == [(a.tolist(), b, c) for a, b, c in want]
    assert lat.nodes < 1000 and made.count("▁same") == made.count("\n") == 1
    # where too many recur, all go
    for i in range(3):
        sample_segmentations(["".join(f" {k}word" for k in range(200))], np.array([i]), 1, lat)
    assert lat.nodes < 4000


def test_third_sample_follows_what_is_left(plain):
    """The edges of a node that are parted late still have their law."""
    v = vocabulary()
    every_one = every(plain, "▁to")
    total = sum(math.exp(s) for _, s in every_one)
    p = {ids: math.exp(s) / total for ids, s in every_one}
    n = 20_000
    third: dict = {}
    for f in sample_segmentations(["to"] * n, np.arange(n) + 10**6, 3, Lattices(v)):
        a = tuple(f[2][0].tolist())
        third[a] = third.get(a, 0) + 1
    for ids, q in p.items():
        want = sum(x * y / (1 - x) * q / (1 - x - y) for a, x in p.items() for b, y in p.items() if len({a, b, ids}) == 3)
        assert third.get(ids, 0) / n == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / n) + 1e-9)


def test_texts_cut_by_arrow():
    from seqloom.llm.pieces import _cut

    rng = random.Random(4)
    texts = ["", " ", "a", " a", "a ", "a  b", "\n", "\n\n", "a\n b\n", "\0 a", "\1", "a\1 b", "▁ ▁a", "漢字 é\nÉ"] + ["".join(rng.choice("ab \n漢") for _ in range(rng.randrange(30))) for _ in range(300)]
    for some in (texts, [], [""], ["a b"]):
        words, which, sizes = _cut(some)
        ends = np.cumsum(sizes)
        assert [[words[i] for i in which[e - n : e]] for n, e in zip(sizes, ends, strict=True)] == [words_of(t) for t in some]


def test_lattices_end_with_their_task(spark, monkeypatch):
    """Nothing of a task's words stays in the worker."""
    import gc
    import weakref

    import pyarrow as pa

    from seqloom.llm import pieces

    made, runs = [], []
    begin, mapped = Lattices.__init__, pieces.map_arrow
    monkeypatch.setattr(Lattices, "__init__", lambda self, vocab: (made.append(weakref.ref(self)), begin(self, vocab))[1])
    monkeypatch.setattr(pieces, "map_arrow", lambda df, fn, schema: (runs.append(fn), mapped(df, fn, schema))[1])
    encode_samples(spark.createDataFrame([(1, "some words")], "doc_id long, text string"))
    batch = pa.record_batch([pa.array([1]), pa.array(["some words"]), pa.array([7])], ["id", "text", "key"])
    for _ in range(2):
        assert sum(b.num_rows for b in runs[0](iter([batch, batch]))) == 4
        gc.collect()
        assert made and not any(ref() for ref in made)
    assert len(made) == 2


_MEMORY = """
import gc, random, re
import numpy as np
from seqloom.llm.pieces import Lattices, _SLAB, sample_segmentations, vocabulary

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng, v = random.Random(5), vocabulary()
words = lambda n: "".join(" " + "".join(rng.choices("etaoinshrdlu", k=8)) for _ in range(n // 9))
sample_segmentations([words(50000)], np.array([0]), 2, Lattices(v))
floor, most, lat = held(), 0, Lattices(v)
for i in range((5 << 20) // _SLAB):
    sample_segmentations([words(4096) for _ in range(_SLAB >> 12)], np.arange(_SLAB >> 12), 2, lat)
    most = max(most, held())
del lat
gc.collect()
print(most - floor, held() - floor)
"""


def test_memory_of_words_that_come_once():
    """Lattices of 5 MB of words that never come again are kept in part only, and what they took goes back to the system."""
    import os
    import subprocess
    import sys

    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    most, after = map(float, subprocess.run([sys.executable, "-c", _MEMORY], check=True, capture_output=True, text=True).stdout.split())
    assert most < 115 and after < 30, (most, after)
