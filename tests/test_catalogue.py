"""Every catalogue query gives the rows of its SQL twin; those without one hold their properties elsewhere."""

import duckdb
import pytest

from tarn.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLES:
        assert got.count() > 0
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    cur = c.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    key = lambda row: tuple(map(str, row))
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key) == want
