"""The report on a soul's files, the check of a whole memory, and what must be written again, on small cases."""

from pyspark.sql import functions as F

from tarn.operators import conversation, diagnostics, ingest
from tarn.operators import memory_tree as tree


def test_mirror_state(spark):
    cases = [
        (5, 5, 0, 10**9, "current"), (5, None, 10, None, "growing"), (5, None, 10, 10**6, "growing-long"), (5, None, 4000, 10**6, "missing"), (5, 4, 1800, 259200, "growing"), (5, 4, 1800, 259201, "growing-long"),
        (5, 4, 1801, 0, "stale"), (4, 5, 1801, 0, "stale"), (4, 5, 5, 0, "growing"),
    ]
    df = spark.createDataFrame(cases, "a long, b long, age long, lag long, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", ingest.mirror_state(F.col("a"), F.col("b"), F.col("age"), F.col("lag"))).collect())


FILES = "slug string, path string, size long, age long"


def folders(spark, files, current=(), mirror=()):
    rows = diagnostics.siblings(spark.createDataFrame(files, FILES), spark.createDataFrame([(p,) for p in current], "path string"), spark.createDataFrame(mirror, "path string, size long"), "My-repo")
    return {r["slug"]: r.asDict() for r in rows.collect()}


def test_siblings(spark):
    files = [
        ("old", "a.jsonl", 9, 1000), ("old", "b-c.jsonl", 5, 10), ("old", "sub/a.jsonl", 4, None), ("myrepo", "x.jsonl", 7, 10), ("far", "y.jsonl", 7, 10), ("My-repo", "a.jsonl", 1, 1), ("deep", "sub/a.jsonl", 4, 1),
    ]
    got = folders(spark, files, ["a.jsonl", "z"], [("2026-01-01-a.jsonl", 3), ("a.jsonl", 6), ("1-b-c.jsonl", 2), ("sub/2-a.jsonl", 4)])
    assert set(got) == {"old", "myrepo"}
    # a.jsonl is 3 behind, its larger copy counts; b-c.jsonl is live; a nested one needs its very path
    assert got["old"] == {"slug": "old", "proven": True, "sessions": 2, "transcripts": 3, "unmirrored": 2, "unmirrored_bytes": 7, "growing": 1, "in_both": 1, "example": "a.jsonl"}
    assert (got["myrepo"]["proven"], got["myrepo"]["unmirrored"], got["myrepo"]["growing"], got["myrepo"]["unmirrored_bytes"]) == (False, 1, 0, 7)
    assert folders(spark, []) == {}


def report(spark, files=None, mirrored=0, others=(), steps=(), orphans=0, store=None, old=()):
    o = "slug string, proven boolean, sessions long, transcripts long, unmirrored long, unmirrored_bytes long, growing long, in_both long, example string"
    f = None if files is None else spark.createDataFrame(files, "size long, mirror_size long, age long, behind_for long")
    s = None if store is None else spark.createDataFrame([store], "graphs long, turns long, latest string")
    r = diagnostics.soul_report(spark, list(old), f, spark.range(mirrored), spark.createDataFrame(list(others), o), spark.createDataFrame(list(steps), "conv_id string, kept boolean"), spark.range(orphans), s)
    return [tuple(x) for x in r.collect()]


def test_soul_report(spark):
    bare = report(spark)
    assert [(t, a) for t, a, _ in bare] == [("layout", False), ("mirror", True), ("folders", False), ("store", True)]
    assert ("mirror", False, "no session logs; 1 step logs") in report(spark, steps=[("c", True)])
    assert ("mirror", False, "no source folder; 3 transcripts are kept") in report(spark, mirrored=3, steps=[("c", True)])
    got = report(spark, [(5, 5, 0, 0), (9, 2, 5, 400_000), (9, 2, 5, 0)], others=[("p", True, 1, 2, 0, 0, 1, 0, None)], steps=[("c", True), ("d", False)], orphans=2, store=(1, 2, None), old=["x"])
    assert got == [
        ("layout", True, "folders of the older layout are left: x"), ("mirror", False, "3 transcripts: 1 current, 2 growing, 0 stale, 0 missing"),
        ("mirror age", True, "1 growing transcripts are behind for over 3 days, 4 at worst; 7 bytes are in one place only"), ("folders", False, "p (proven): all 2 transcripts are in the mirror, 1 being written"),
        ("step logs", True, "2 conversations: 1 kept, 1 never"), ("orphans", False, "2 conversations on this machine belong to no folder"), ("store", False, "1 graphs, 2 turns, the latest at none"),
    ]


def test_verify(spark):
    notes = spark.createDataFrame([(i, f"m{i}", "2026-01-01", f"n{i}", [f"t{i}"] if i else []) for i in range(4)], "pos long, id string, ts string, text string, turns array<string>")
    sums = spark.createDataFrame([("0-1", "#0-1 told", None), ("2-3", "fine", tree.WORDING), ("0-3", "fine", tree.WORDING)], "block string, text string, wording string")
    turns = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "event_id string")
    stored = turns.where("event_id <> 't3'").select(F.col("event_id").alias("turn"))
    bad = tree.verify(notes, sums, turns, 4, stored)
    assert sorted(tuple(r) for r in bad.collect()) == [("block text", "0-1"), ("no turn", "m0"), ("not in the store", "t3")]
    assert tree.verify_counts(notes, sums, bad, 4).first().asDict() == {"notes": 4, "turn_links": 3, "blocks": 3, "failures": 3, "wake_lines": 4}
    short = tree.verify(notes, sums.where("block <> '0-1'"), turns, 4, None, budget=2)
    assert sorted(tuple(map(str, r)) for r in short.collect()) == [("due", "0-1"), ("due", "2-3"), ("no store", "None"), ("no turn", "m0"), ("wake", "0-1")]
    assert [tuple(r) for r in tree.to_repair(sums, 4).collect()] == [(0, 2), (0, 4)] == [tuple(r) for r in tree.to_reword(sums, 4).collect()]
    assert tree.to_repair(sums.where("block <> '0-1'"), 4).count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([("[1] x", ""), ("[1] x", "#0 d note"), ("[1] x", None)], "s string, w string")
    empty, awake, on = (r["p"] for r in df.select(conversation.note_prompt(F.col("s"), "Ann", F.col("w")).alias("p")).collect())
    assert "Nothing is remembered yet." in empty and "#0 d note" in awake and "Ann's" in awake
    assert on.startswith("What comes next.\n\n[1] x\n\n") and "Ann" not in on
    assert tree.merge_prompt(0, 2, "B", 0, story=True).endswith(f"\n{tree.STORY}\n")


def test_tsv_manifest(spark, tmp_path):
    at = str(tmp_path / "m")
    rows = lambda p: sorted(tuple(r) for r in ingest.read_tsv_manifest(spark, at, p).collect())
    assert rows("1") == []
    ingest.write_tsv_manifest(spark.createDataFrame([("b", "2\t3"), ("a", "")], "key string, value string"), at, "1")
    assert rows("1") == [("a", ""), ("b", "2\t3")] and rows("2") == []
    (tmp_path / "f.tsv").write_text("a\tx\nno tab\na\ty\n#turn-projection\t5\n")
    assert [tuple(r) for r in ingest.read_tsv_manifest(spark, str(tmp_path / "f.tsv"), "5").collect()] == [("a", "y")]
