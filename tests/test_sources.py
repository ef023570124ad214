import json

import pytest

from tarn.operators import conversation
from tarn.sources import export, lines, session_log, step_log


def put(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def by_id(df):
    return {r["event_id"]: r for r in df.collect()}


def test_session_blocks_spans_and_noise(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    put(tmp_path / "s1.jsonl", [{"type": "user", "uuid": "a", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "héllo"}}, {"type": "system", "uuid": "z"}, "", {"type": "user", "message": {"content": "no id"}}, '{"type":"user","uuid":"q","mess'])
    put(tmp_path / "sub/s2.jsonl", [
        {"type": "assistant", "uuid": "b", "parentUuid": "a", "message": {"role": "assistant", "model": "<synthetic>", "content": [
            {"type": "thinking", "thinking": "hm"}, {"type": "thinking", "thinking": "oh"}, {"type": "text", "text": "é1"}, {"type": "text", "text": ""},
            {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "cd /x && cd y; rg -c face", "description": "Count words"}}, {"type": "tool_use", "id": "c2", "name": "mcp__zed", "input": {"n": 3, "zz": " q  r"}},
            {"type": "tool_result", "tool_use_id": "c0", "content": [{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": "y\n\nz"}], "is_error": True}]}}])
    got = by_id(session_log.events(lines.read_lines(spark, str(tmp_path))))
    assert set(got) == {"a", "b"}
    assert [tuple(s) for s in got["a"]["text_provenance"]] == [(0, 6, "authored")]
    b = got["b"]
    assert b["text"] == "é1\nx\ny\n\nz" and [tuple(s) for s in b["text_provenance"]] == [(0, 3, "authored"), (4, 10, "tool_result")]
    assert b["thinking"] == "hm\n\noh" and b["model"] is None
    assert [tuple(a) for a in b["actions"]] == [("c1", "ran", "Count words (rg -c face)"), ("c2", "other", "mcp__zed q r")]
    assert [tuple(o) for o in b["outcomes"]] == [("c0", "x", 2, True)]


def test_prose_blocks_after(spark, tmp_path):
    put(tmp_path / "s.jsonl", [{"type": "user", "uuid": "u1", "message": {"role": "user", "content": "a"}}, {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "message": {"role": "assistant", "content": [{"type": "text", "text": "b"}, {"type": "text", "text": "c<system-reminder>x</system-reminder>"}]}}])
    src = lines.read_lines(spark, str(tmp_path))
    texts = lambda **k: [r["text"] for r in session_log.prose_blocks(src, **k).orderBy("seq").collect()]
    assert texts(strip=True) == ["a", "b", "c"] and texts(strip=True, after="u2") == ["c"] and texts(strip=True, after="nope") == ["a", "b", "c"]


STEPS = [
    {"step_index": 3, "source": "MODEL", "type": "PLANNER_RESPONSE", "status": "DONE", "content": "hi"}, {"step_index": 0, "source": "USER_EXPLICIT", "type": "USER_INPUT", "status": "DONE", "content": "The user changed setting `Model Selection` from A to B. No need to"},
    {"step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "tool_calls": [{"name": "run_command", "args": {"CommandLine": "ls"}}], "status": "RUNNING"}, "junk", {"step_index": 4, "source": "MODEL", "type": "RUN_COMMAND", "content": "cmd\nOutput:\nfoo\nbar", "status": "DONE"},
]


def test_steps(spark, tmp_path):
    put(tmp_path / "cv.jsonl", [*STEPS, STEPS[-1]])
    src = lines.read_lines(spark, str(tmp_path))
    got = step_log.events(src).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [0, 1, 3, 4] and [r["parent_id"] for r in got] == [None, "cv:0", None, "cv:3"]
    assert {r["model_setting"] for r in got} == {"B"} and [tuple(o) for o in got[3]["outcomes"]] == [("cv:1:0", "foo", 1, False)]
    q = step_log.quality(src).first()
    assert (q["malformed"], q["duplicates"], q["gaps"], q["statuses"]) == (1, 1, [2], {"DONE": 4, "RUNNING": 1})
    put(tmp_path / "cv.jsonl", [*STEPS, STEPS[0] | {"content": "other"}])
    with pytest.raises(Exception, match="duplicate step_index"):
        step_log.events(lines.read_lines(spark, str(tmp_path))).collect()


def test_call_links(spark, tmp_path):
    out = {"source": "MODEL", "type": "RUN_COMMAND"}
    call = lambda i, n: {"step_index": i, "type": "PLANNER_RESPONSE", "tool_calls": [{"name": f"t{k}", "args": {}} for k in range(n)]}
    put(tmp_path / "c.jsonl", [call(0, 1), out | {"step_index": 1}, call(2, 2), out | {"step_index": 3}, call(4, 1), {"step_index": 5, "type": "PLANNER_RESPONSE"}])
    got = [tuple(r) for r in step_log.call_links(lines.read_lines(spark, str(tmp_path))).orderBy("at_step", "name").select("at_step", "result_step").collect()]
    assert got == [(0, 1), (2, None), (2, None), (4, None)]


def test_export_newest(spark, tmp_path):
    msg = lambda i, t: {"uuid": f"m{i}", "sender": "human" if i % 2 == 0 else "assistant", "created_at": "", "content": [{"type": "text", "text": t}]}
    for name, rows in (("e1", [{"uuid": "c1", "updated_at": "2", "chat_messages": [msg(0, "a"), msg(1, "b")]}, {"uuid": "gone", "chat_messages": []}]), ("e2", [{"uuid": "c1", "updated_at": "2", "chat_messages": [msg(0, "a"), msg(1, "b"), msg(2, "c")]}])):
        (tmp_path / name).mkdir()
        put(tmp_path / name / "conversations.json", [json.dumps(rows)])
        put(tmp_path / name / "users.json", ["[]"])
    assert lines.is_export_dir(str(tmp_path / "e1")) and not lines.is_export_dir(str(tmp_path))
    newest = export.newest(export.read(spark, [str(tmp_path / "e1"), str(tmp_path / "e2")]))
    assert newest.count() == 2
    assert [(r["event_id"], r["role"], r["parent_id"]) for r in export.events(newest).orderBy("pos").collect()] == [("m0", "user", None), ("m1", "assistant", "m0"), ("m2", "user", "m1")]


def test_actions_join_turns(spark, tmp_path):
    say = lambda i, t: {"type": "assistant", "uuid": f"u{i}", "timestamp": f"t{i}", "message": {"role": "assistant", "content": [{"type": "text", "text": t}]}}
    act = lambda i, n, args: {"type": "assistant", "uuid": f"u{i}", "timestamp": f"t{i}", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": f"c{i}", "name": n, "input": args}]}}
    res = lambda i, of, t, bad=False: {"type": "user", "uuid": f"u{i}", "timestamp": f"t{i}", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": of, "content": t, "is_error": bad}]}}
    put(tmp_path / "s.jsonl", [
        {"type": "user", "uuid": "u0", "timestamp": "t0", "message": {"role": "user", "content": "do it<system-reminder>x</system-reminder>"}}, act(1, "Bash", {"command": "ls"}), res(2, "c1", ""), say(3, "done"), act(4, "Read", {"file_path": "/x"}), res(5, "c4", "big"), act(6, "Edit", {"file_path": "/b"}), res(7, "c6", "nope", True), act(8, "Grep", {"pattern": "p"})])
    e = session_log.events(lines.read_lines(spark, str(tmp_path)))
    turns = conversation.fold_actions(conversation.prose_turns(e))
    texts = [r["text"] for r in conversation.stream(turns).collect()]
    assert texts == ["do it", "[ran: ls → no output]\ndone\n[read: /x]\n[edited: /b → failed: nope]\n[searched: p]"]


def test_stretches_and_notes(spark):
    t = spark.createDataFrame([("s", i, n) for i, n in enumerate([10, 15, 8, 30, 1, 1])], "soul string, k int, n int")
    from pyspark.sql import functions as F

    got = {r["k"]: r["stretch"] for r in conversation.stretches(t, F.col("n"), "soul", ["k"], 24).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    stretch = spark.createDataFrame([(1, "a", "t2"), (2, "b", "t1"), (3, "b", "t3")], "idx int, id string, ts string")
    ans = spark.createDataFrame([(0, "x", [1, 2, 9]), (1, "y", [7]), (2, "z", [2, 3])], "n int, text string, cites array<int>")
    notes = {r["n"]: (r["ts"], r["turns"]) for r in conversation.accepted_notes(ans, stretch).collect()}
    assert notes == {0: ("t1", ["b", "a"]), 2: ("t1", ["b"])}
