"""Passes over transcripts that grow, and the memory loop."""

import json
import os

from pyspark.sql import functions as F

from tarn import model as M
from tarn.functions import text as T
from tarn.operators import diagnostics, ingest, memory_tree
from tarn.plans.sparql import Store
from tarn.streaming import passes


def session(path, n, word="hi"):
    path.write_text("".join(json.dumps({"type": "user", "uuid": f"{path.stem}-{i}", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": f"{word} {i}"}}) + "\n" for i in range(n)))


def said(table):
    return sorted(r["x"] for r in Store(table.quads()).query("SELECT ?x { ?t :text ?x }").plain().collect())


def test_files_that_grow_or_are_rewritten_are_read_again(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    session(src / "a.jsonl", 2)
    session(src / "b.jsonl", 1, "yo")
    t, manifest = ingest.QuadTable(spark, str(tmp_path / "q"), 4), str(tmp_path / "manifest")
    t.create(spark.createDataFrame([], M.QUAD))
    run = lambda **o: passes.sync_pass(spark, str(src), t, manifest, **o)
    assert run() == {"unchanged": 0, "done": 2, "superseded": 0, "failed": 0, "turns": 3, "failures": []}
    assert run()["unchanged"] == 2 and said(t) == ["hi 0", "hi 1", "yo 0"]
    session(src / "a.jsonl", 3)
    got = run()
    assert (got["done"], got["unchanged"], got["turns"]) == (1, 1, 3) and said(t) == ["hi 0", "hi 1", "hi 2", "yo 0"]
    before = os.stat(src / "b.jsonl")
    session(src / "b.jsonl", 1, "no")  # same size and time
    os.utime(src / "b.jsonl", ns=(before.st_atime_ns, before.st_mtime_ns))
    assert run()["done"] == 0 and run(deep=True)["done"] == 1 and "no 0" in said(t) and "yo 0" not in said(t)


def test_step_logs_and_failures(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    step = lambda *rows: "\n".join(json.dumps({"step_index": i, "source": "MODEL", "content": c}) for i, c in rows)
    (src / "good.jsonl").write_text(step((0, "a"), (1, "b")))
    (src / "bad.jsonl").write_text(step((0, "a"), (0, "b")))
    t, manifest = ingest.QuadTable(spark, str(tmp_path / "q"), 4), str(tmp_path / "manifest")
    t.create(spark.createDataFrame([], M.QUAD))
    got = passes.sync_pass(spark, str(src), t, manifest, "steps")
    assert (got["done"], got["failed"], got["turns"]) == (1, 1, 2) and got["failures"][0].endswith("bad.jsonl: duplicate step_index 0 with differing rows")
    (src / "bad.jsonl").write_text(step((0, "a"), (1, "c")))
    assert passes.sync_pass(spark, str(src), t, manifest, "steps")["done"] == 1 and said(t) == ["a", "a", "b", "c"]


def test_exports_are_read_message_by_message(spark, tmp_path):
    made = [{"uuid": f"c{i}", "name": "n", "updated_at": f"2026-01-0{i + 1}", "chat_messages": [{"uuid": f"c{i}-{k}", "sender": "human" if k % 2 == 0 else "assistant", "text": "t" * 100 + str(k), "content": []} for k in range(3)]} for i in range(4)]
    for name, rows in (("e1", made[:3]), ("e2", made[2:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "conversations.json").write_text(json.dumps(rows, indent=1))
    t, manifest = ingest.QuadTable(spark, str(tmp_path / "q"), 4), str(tmp_path / "manifest")
    t.create(spark.createDataFrame([], M.QUAD))
    dirs = [str(tmp_path / "e1"), str(tmp_path / "e2")]
    assert passes.export_sync(spark, dirs[:1], t, manifest)["done"] == 3
    assert passes.export_sync(spark, dirs, t, manifest)["done"] == 1 and passes.export_sync(spark, dirs, t, manifest)["done"] == 0
    assert t.quads().where(F.col("p") == M.V("turnId")).count() == 12


def test_memory_pass_takes_whole_stretches_in_fair_shares(spark, tmp_path):
    at = lambda h, m=0: f"2026-01-01 {h:02d}:{m:02d}:00"
    rows = [("big", f"b{i}", at(11, i % 20), "x" * 1000) for i in range(40)] + [("old", "o1", at(1), "hi")] + [("few", "f1", at(11), "hi")] + [("young", "y1", at(11, 50), "hi")] + [("off", "q1", at(1), "hi")]
    turns = spark.createDataFrame(rows, "owner string, id string, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    state = spark.createDataFrame([(o, o != "off") for o in ("big", "old", "few", "young", "off")], "owner string, dirty boolean").withColumns({"paused_at": F.lit(None).cast("timestamp"), "failed_at": F.lit(None).cast("timestamp")})
    now, folder = F.lit(at(12)).cast("timestamp"), str(tmp_path / "memory")
    note = lambda df: df.select(F.concat(F.lit("m-"), "id").alias("id"), "owner")
    told = {r["owner"]: r["decision"] for r in passes.memory_pass(turns, state, folder, now, note, limit=30).collect()}
    assert told == {"big": "flush-size", "old": "flush-age", "few": "wait", "off": "not-due"}
    assert memory_tree.appended(spark, folder, "read", "id string").count() == 31 and memory_tree.appended(spark, folder, "notes", "id string, owner string").count() == 31
    told = {r["owner"]: r["turns"] for r in passes.memory_pass(turns, state, folder, F.lit(at(18)).cast("timestamp"), note, limit=30).collect()}
    assert told == {"big": 10, "few": 1, "young": 1, "off": 1} and memory_tree.appended(spark, folder, "read", "id string").count() == 43


def test_unread_turns_are_handed_on_once(spark, tmp_path):
    src, got = tmp_path / "in", []
    src.mkdir()
    take = lambda df: (got.extend(r["id"] for r in df.collect()), df.select("id"))[1]
    for k, ids in enumerate((["a", "b"], ["b", "c", "c"])):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"id": i}) for i in ids))
        stream = spark.readStream.schema("id string").json(str(src))
        passes.unread_state(stream, str(tmp_path / "m"), take).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == ["a", "b", "c"]


def test_progress_usage_and_senders(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    sums = spark.createDataFrame([("0-1", "x", "w", "", ""), ("2-3", "x", "w", "", "")], M.SUMMARY)
    row = diagnostics.progress(ids("a", "b"), ids("a", "b"), ids("m"), sums, 4).first()
    assert (row["turns"], row["turns_read"], row["blocks"], row["pending_blocks"], row["done"]) == (2, 2, 2, 1, False)
    use = diagnostics.usage(spark.createDataFrame([("s", "1", 5, 1), ("s", "2", 6, 2)], "owner string, at string, tokens_in long, tokens_out long")).first()
    assert (use["calls"], use["tokens_in"], use["tokens_out"], use["last"]) == (2, 11, 3, "2")
    cases = {"Bob here: x": "Bob", "here (bob) y": None, "All here (b-o-b)": "Bob", "Bob → Me: x": "Bob", "Me -> Bob": None, "Ann — Bob. x": "Bob", "Ann – me": None, "Zed here": None, "x\nBob here": None, "": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.typed_sender(F.col("t"), ["Bob", "BOB!", "me", "--"], "Me").alias("w"), T.relabel_human(F.col("t"), ["Bob"], "Me").alias("r"))
    for r in df.collect():
        assert r["w"] == cases[r["t"]], r["t"]
        assert r["r"] == (f"[message from another agent, Bob:]\n{r['t']}" if r["w"] else r["t"])
