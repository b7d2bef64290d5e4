"""Each query against its SQL, as the driver compares them."""

import math

import duckdb
import pytest

from seqloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


TWINS = {
    "graph_transitive_reduction": "test_twins", "mmg_blocks": "test_blocks", "dag_chains": "test_twins", "das_align": "test_twins", "dist_seq_theta": "test_twins", "dist_hv": "test_twins", "pcoa_coords": "test_twins", "clust_mcl": "test_twins",
    "clust_km": "test_twins",
}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def plain(rows):
    fixed = [tuple(round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows]
    return sorted(fixed, key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        # these have plain twins in other files
        assert name in TWINS and got.count() > 0
        return
    want = db.execute(catalog.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert plain(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == plain(tuple(r[i] for i in order) for r in want.fetchall())
