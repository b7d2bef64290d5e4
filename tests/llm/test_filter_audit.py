import random
import re
from itertools import permutations

import duckdb
import pytest

from seqloom.llm.filter_audit import ORACLE, audit
from seqloom.llm.queries import op11_filter_audit

SF = "/root/testdata/sf0.001"


def plain(docs, labels):
    """Every order applied to the rows themselves."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = {}
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        flags = dict(
            A=len(words) < 200, B=100 * len(set(words)) < 50 * len(words), C=100 * len(re.findall("[A-Z]", t)) > 3 * len(t), D=bool(re.search(r"[#$%&*|]", t)), E=i is not None and i > least[t]
        )
        own = [(q, x) for j, q, x in labels if j is not None and j == i]
        rows.setdefault(part or "", []).append((flags, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out, worth = [], {}
    for part, members in rows.items():
        for order in permutations("ABCDE"):
            alive = members
            gone = []
            for step, f in enumerate(order, 1):
                removed = [m for m in alive if m[0][f]]
                alive = [m for m in alive if not m[0][f]]
                unique = sum(m[0][f] and sum(m[0].values()) == 1 for m in members)
                out.append([part, "".join(order), step, len(alive), len(removed), sum(m[0][f] for m in gone), unique, sum(m[1] for m in removed), sum(m[2] for m in removed)])
                worth[part, f] = worth.get((part, f), 0) + len(removed)
                gone = gone + removed
    return sorted((*r, worth[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_orders(spark, seed):
    rng = random.Random(seed)
    pool = [None, "", " \t\n", "A", "a # b", "É" * 50 + "AB", "x " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), " ".join(f"w{i % 20}" for i in range(220)) + " $", "w x y " * 4000, "a\x0bb\x1cc"]
    docs = [(rng.choice([None, *range(90)]), rng.choice(pool), rng.choice([None, "", "en", "fr"])) for _ in range(300)] + [(7, "hot", "en")] * 50 + [(i, "hot", "fr") for i in range(100, 200)]
    labels = [(rng.choice([None, *range(200)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(150)]
    df = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id long, text string, lang string, n int, good boolean").repartition(5)
    found = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int, mask int")
    got = audit(df, found)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    assert {(r.removed, r.good_lost) for r in audit(one, labels).where("substr(filter_order, step, 1) = 'A'").collect()} == {(1, 0)}


def test_query_against_sql(spark):
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = c.execute(ORACLE)
    names = [d[0] for d in want.description]
    got = op11_filter_audit(spark, SF).select(*names)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want.fetchall()) and len(rows) == 600 * len({r[0] for r in rows})
