import random

import numpy as np

from seqloom.llm.neardup import MAX_BITS, close_links, near_dedup, similar_links, sketch
from seqloom.llm.simhash import shingle_hashes

COLUMNS = "doc_id long, text string"


def kept(spark, pairs):
    """How many of the pairs (given to ``near_dedup`` all at once) keep both texts."""
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    return len(near_dedup(spark.createDataFrame(rows, COLUMNS)).collect()) - len(pairs)


def test_pairs_around_the_limit(spark):
    rng = random.Random(5)

    def pairs(changed):
        # sets of 900 shingles of which so many differ
        out = []
        for _ in range(40):
            body = [f"w{rng.randrange(10**9)}" for _ in range(904)]
            out.append((" ".join(body), " ".join(body[: 904 - changed] + [f"x{rng.randrange(10**9)}" for _ in range(changed)])))
        return out

    # 800 / 1000 = 0.8; 799 / 1001 is under it
    assert kept(spark, pairs(100)) == 0
    assert kept(spark, pairs(101)) == 40


def test_a_line_often_in_one_copy(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(40):
        body = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        other = [*body]
        other[200] = "changed"
        line = [f"l{rng.randrange(10**9)}" for _ in range(5)]
        pairs.append((" ".join(body + line * 300), " ".join(other + line * 2)))
    assert kept(spark, pairs) == 0


def test_pairs_come_from_fingerprint_tries(spark):
    bins, far = np.arange(1, 257, dtype=np.uint16).tobytes(), (1 << MAX_BITS + 1) - 1
    row = lambda name, fp, band: (name.encode(), fp, bins, [band])
    sets = spark.createDataFrame(
        # one bucket and equal minimum hashes each: a budget apart, one bit more, and opposite; then close ones without a bucket in common
        [row("a", 0, 1), row("b", far >> 1, 1), row("c", 0, 2), row("d", far, 2), row("e", 5, 3), row("f", ~5, 3), row("g", 7 << 50, 4), row("h", 7 << 49, 5)],
        "name binary, fp long, bins binary, bands array<long>",
    )
    linked = lambda rows: {frozenset((bytes(r.a), bytes(r.b))) for r in rows.collect()}
    assert linked(similar_links(sets, 0.68)) == {frozenset((b"a", b"b"))}
    groups = {n: {n} for n in b"abcdefgh"}
    for one, other in (map(ord, pair) for pair in linked(close_links(sets))):
        together = groups[one] | groups[other]
        groups |= dict.fromkeys(together, together)
    # 0, 0, 5 and the two numbers of three bits; b and d differ in one bit
    assert {frozenset(g) for g in groups.values()} == {frozenset(b"acegh"), frozenset(b"bd"), frozenset(b"f")}


def test_fingerprints_of_similar_sets_are_inside_the_budget():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    for n in [5, 10, 15, 40, 300]:
        for _ in range(300):
            shared, rest = [word() for _ in range(n + 4 - n // 5)], [word() for _ in range(n // 5)]
            one, other = (sketch(shingle_hashes(" ".join(w).encode(), 5)) for w in (shared, shared + rest))
            assert (one[1] ^ other[1]).bit_count() <= MAX_BITS
    # a line that is repeated weighs as much as any other
    line = " ".join(word() for _ in range(5))
    assert sketch(shingle_hashes(f"{line} {line} {line}".encode(), 5))[1] == sketch(shingle_hashes(" ".join([line] * 300).encode(), 5))[1]
