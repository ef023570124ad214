"""Queries over whole tables, against plain Python."""

import duckdb

from tarn.plans import catalogue

SF = "/root/testdata/sf0.001"


def turns_of(sf):
    out = {}
    for conv, turn in duckdb.sql(f"select conv_id, turn from '{sf}/conversations.parquet'").fetchall():
        out.setdefault(conv, []).append(turn)
    return out


def test_closure_has_every_conversation(spark):
    want = []
    for conv, turns in turns_of(SF).items():
        above = {t: t - 1 for t in turns if t - 1 in turns}
        for t in turns:
            up = t
            while up in above:
                up = above[up]
                want.append((f"{conv}:{t}", f"{conv}:{up}"))
    got = sorted((r["a"], r["b"]) for r in catalogue.QUERIES["path_closure"](spark, SF).collect())
    assert got == sorted(want) and len({a.split(":")[0] for a, _ in got}) == len({a.split(":")[0] for a, _ in want}) > 1
