"""Each SQL twin gives the query's rows on the small tables."""

import duckdb
import pytest

from tarn.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "labels", "conversations"]


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_twin(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    cur = c.execute(registry.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    key = lambda row: tuple(map(str, row))
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key) == want
