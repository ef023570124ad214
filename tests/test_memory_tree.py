import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.operators import memory_tree as tree


def second_cover(t, budget):
    """A second, recursive version of the rule."""

    def at(alpha):
        out = []

        def go(lo, n):
            if lo >= t:
                return
            if n > 1 and (lo + n > t or float(n) > alpha * float(t - lo)):
                go(lo, n // 2)
                go(lo + n // 2, n // 2)
            else:
                out.append((lo, lo + n))

        n = 1
        while n < t:
            n *= 2
        go(0, n)
        return out

    if t <= budget:
        return [(i, i + 1) for i in range(t)]
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2.0
        if len(at(mid)) > budget:
            lo = mid
        else:
            hi = mid
    out = at(hi)
    while len(out) < budget:
        big = [i for i, (a, b) in enumerate(out) if b - a > 1]
        if not big:
            break
        a, b = out.pop(big[-1])
        out[big[-1] : big[-1]] = [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60_000), st.sampled_from([1, 5, 96, 200]))
def test_cover_properties(t, budget):
    got = tree.cover(t, budget)
    assert got == second_cover(t, budget)
    at = 0
    for a, b in got:
        n = b - a
        assert a == at and n & (n - 1) == 0 and a % n == 0
        at = b
    assert at == t
    if budget >= 96:
        assert len(got) <= budget and (not got or got[-1][1] - got[-1][0] == 1)


def built(spark, blocks):
    return spark.createDataFrame(blocks, "lo long, hi long")


def test_pending_cases(spark):
    got = lambda t, b, n=None: [tuple(r) for r in tree.pending(spark, t, built(spark, b), n).orderBy(tree.F.col("hi") - tree.F.col("lo"), "lo").collect()]
    assert got(8, []) == [(0, 2), (2, 4), (4, 6), (6, 8), (0, 4), (4, 8), (0, 8)]
    assert got(5, []) == [(0, 2), (2, 4), (0, 4)]
    assert got(4, [(2, 4)]) == [(0, 2), (2, 4), (0, 4)]  # a hole keeps what is after it pending
    assert got(8, [(0, 2)], 2) == [(2, 4), (4, 6)]
    assert got(1, []) == []


def test_block_ids(spark):
    rows = spark.createDataFrame([("0-1",), ("#4-7",), ("5-6",), ("0-2",), ("3-3",), ("x",), ("0-15",)], "block string")
    assert sorted(tuple(r) for r in tree.parsed_blocks(rows).select("lo", "hi").collect()) == [(0, 2), (0, 16), (4, 8)]


def test_build_all_levels_and_check(spark):
    notes = spark.createDataFrame([(i, f"m{i}", f"2026-01-0{i + 1}", f"n{i}", [f"t{i}"], "w") for i in range(6)], "pos long, id string, ts string, text string, turns array<string>, model string")
    none = spark.createDataFrame([], "block string, text string")
    out = {r["block"]: r["text"] for r in tree.build_all(notes, none, 6, lambda x: tree.F.array_join(x, "+")).collect()}
    assert out == {"0-1": "n0+n1", "2-3": "n2+n3", "4-5": "n4+n5", "0-3": "n0+n1+n2+n3"}
    bad = spark.createDataFrame([("0-1", "ok"), ("5-6", "ok"), ("8-15", "two\nlines")], "block string, text string")
    turns = spark.createDataFrame([(f"t{i}",) for i in range(5)], "event_id string")
    found = {(r["failure"], r["ident"]) for r in tree.check(notes, bad, turns, 6).collect()}
    assert found == {("block text", "8-15"), ("block id", "5-6"), ("past the log", "8-15"), ("unknown turn", "t5")}


def test_merge_texts(spark):
    notes = spark.createDataFrame([(i, f"2026-01-01T{i}", f"n{i}") for i in range(4)], "pos long, ts string, text string")
    sums = spark.createDataFrame([("0-15", "a")], "block string, text string")
    assert tree.merge_body(2, 4, notes, sums) == "  #2 2026-01-01 n2\n  #3 2026-01-01 n3"
    with pytest.raises(ValueError, match="#16-31 is blank"):
        tree.merge_body(0, 32, notes, sums)
    assert tree.merge_prompt(0, 2, "B", 1).endswith("B\n\n(1 more to merge after this.)\n")


def test_log_rows_torn_and_bad(spark):
    good = spark.createDataFrame([(0, '{"a":1}'), (1, '{"a":2}'), (2, '{"a"')], "n long, value string")
    assert tree.log_rows(good).count() == 2
    bad = spark.createDataFrame([(0, '{"a"'), (1, '{"a":2}')], "n long, value string")
    with pytest.raises(Exception, match="bad line 0"):
        tree.log_rows(bad).collect()


def test_climbing_goes_by_size(spark):
    """A block of four and one of eight can end at the same place; a hole in the smaller one stops the climb, however the join leaves the rows."""
    blocks = {(n, lo) for n in (2, 4, 8, 16, 32) for lo in range(0, 128, n) if not (n == 4 and lo % 12 == 4 or n == 8 and lo % 24 == 8)}
    old, want = {b for b in blocks if b[0] == 2 and b[1] % 6 == 0}, set()
    for n, lo in old:
        while (n, lo) in blocks:
            want.add((n, lo))
            n, lo = n * 2, lo - lo % (n * 2)
    sums = spark.createDataFrame([(f"{lo}-{lo + n - 1}", "x", "old" if (n, lo) in old else tree.WORDING) for n, lo in blocks], "block string, text string, wording string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a merge join hands on what it has sorted
    try:
        got = [tuple(r) for r in tree.to_reword(sums, 128).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == [(lo, lo + n) for n, lo in sorted(want)]
