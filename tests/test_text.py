import pytest
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators.writer import WHY
from tarn.operators import ingest, peers, readers


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (lambda x: T.one_line(x, 5), " a  b\n\tc d ef ", "a b c…"), (lambda x: T.one_line(x, 9), " a  b ", "a b"), (T.strip_cd, "  cd /a && cd b; ls cd x", "ls cd x"), (T.strip_cd, "cd /a", "cd /a"),
        (T.action_kind, "TaskOutput", "other"), (T.action_kind, "Task", "subagent"), (T.action_kind, "BashEdit", "ran"), (T.action_kind, "NotebookEdit", "edited"), (T.action_kind, "read_url_content", "read"), (T.action_kind, "WebFetch", "fetched"), (T.action_kind, "Glob", "listed"),
        (T.strip_reminders, "a<system-reminder>x</system-reminder>b<system-reminder>y", "ab"), (T.human_words, "  <bash-stdout>x", ""), (T.human_words, "<bash-input> ls </bash-input>z", "(ran in the shell) ls"), (T.human_words, "/compact", ""), (T.human_words, "/compact now", "/compact now"),
        (T.request_body, "x<USER_REQUEST>\n hi </USER_REQUEST>y", "hi"), (T.flat, "a 'b' \"c\"\\ `d` e", "abcde"), (T.name_key, "W4-r3Z!", "w4r3z"), (T.is_slug, "a-b2", True), (T.is_slug, "a--b", False),
        (T.mark_quote_backs, '"x" <- y\nz', '[the human quoting earlier words, then replying after <-:] "x" <- y\nz'), (T.relabel_pastes, 'a<pasted_content id="1">b</pasted_content>c', "a[pasted by the human — someone else's words, not the human's own:]b[end of paste]c"),
        (T.relabel_channels, 'x<channel source="a>b" from_cwd="/q/w/">hi</channel>', "x[message from another agent, w:]hi"), (T.relabel_channels, '<channel from_id="i7">y', "[message from another agent, i7:]y"), (T.relabel_channels, "<channel z>", "[message from another agent, unnamed:]"), (T.relabel_channels, "<channel open", "<channel open"),
        (T.announced_setting, "The user changed setting `Model Selection` from A to B to C. No need x The user changed setting `Model Selection` from C to None. No need", None), (T.announced_setting, "The user changed setting `Model Selection` from A to B to C. No need", "C"),
        (T.escaped, 'a"\\\n\t', 'a\\"\\\\\\n\\t'), (T.question_density, "why? how? when.", 2 / 3), (T.question_density, "?", 1.0), (T.question_density, "", 0.0), (T.code_ratio, "```x``` `y` z", 10 / 13), (T.word_count, " a b  c ", 3), (T.note_error, "x", None), (T.note_error, " ", WHY["empty"]), (T.note_error, '{"a": 1}', WHY["json"]), (T.note_error, "{a", None), (T.note_error, "No line written today", WHY["task"]),
        (T.note_error, "é" * 141, "282" + WHY["long"].format(limit=280)), (T.note_error, "a\nb", WHY["lines"]), (lambda x: T.clipped_bytes(x), "x" * 5000, 4007), (lambda x: T.clipped_bytes(x), "x" + "é" * 3000, 4006), (lambda x: T.clipped_bytes(x), "x" * 4000, 4000), (T.strip_wrappers, "a<Channel q>x</channel><command-name>b\nCaveat: z", "ab"),
        (lambda x: T.names_term(x, "goat"), "The GOAT.", True), (lambda x: T.names_term(x, "goat"), "goats", False), (peers.cat_path, 'x "$(cat "/t/m.txt")"', "/t/m.txt"), (lambda x: peers.body_of(x, "send to"), "q; send to bob hello you", "hello you"),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, f, value) == want


def test_clip_keeps_characters_whole(spark):
    for lead in ("", "x", "xx", "xxx"):
        for ch in ("é", "漢", "😀"):
            s = lead + ch * 3000
            raw = s.encode()
            head, tail = 3000, len(raw) - 1000
            while (raw[head] & 0xC0) == 0x80:
                head -= 1
            while (raw[tail] & 0xC0) == 0x80:
                tail += 1
            assert one(spark, T.clip, s) == raw[:head].decode() + " […] " + raw[tail:].decode()
    assert one(spark, T.clip, "short") == "short"


def test_sender_claim(spark):
    soul = "0a" * 20
    got = one(spark, T.sender_claim, f'\n<pasted_content id="3">\n--msg v=1 from=m4 soul={soul} user=ab-1 pane= x=2--\nhi')
    assert (got["from"], got["soul"], got["user"], got["pane"]) == ("m4", soul, "ab-1", None)
    assert one(spark, T.sender_claim, "--msg v=1 from=a oops--") is None and one(spark, T.sender_claim, "--msg v=2 from=a--") is None
    assert one(spark, T.sender_claim, "--msg v=1 soul=zz user=A--")["soul"] is None


def test_emojikeys(spark):
    text = "wrap up 🐐 [ME|🧠🎨8∠45]~[CONTENT|💻🧩9∠15]~[YOU|🎓🌱8∠35] done [me|a]\n~ [content| b ]~[ you |c] file.py:[12] [YOU|a]~[CONTENT|b]~[ME|c]~"
    e = spark.createDataFrame([("e1", "c", text, "user", None, [(0, 500, "authored")])], "event_id string, conv_id string, text string, role string, timestamp string, text_provenance array<struct<start:bigint,end:bigint,kind:string>>")
    got = readers.EmojiKeys().read(e).orderBy("start").collect()
    raw = text.encode()
    assert [raw[r["start"] : r["end"]].decode() for r in got] == [r["signal"]["raw"]["lex"] for r in got] and len(got) == 2
    assert (got[0]["signal"]["you"]["lex"], got[1]["signal"]["content"]["lex"], got[1]["source_kind"]) == ("🎓🌱8∠35", "b", "authored")


def test_cadence(spark):
    r = spark.createDataFrame([("c", 0, "user", "how do I run this?", "2026-01-01T00:00:00Z"), ("c", 1, "assistant", "use `x`.", None), ("c", 2, "assistant", "ok", "2026-01-01T00:00:10Z")], "conv_id string, seq long, voice string, text string, ts string")
    got = readers.Cadence().facts(r).orderBy("seq").collect()
    assert [(x["words"], x["question_density"], x["latency_s"], x["voice_switch"]) for x in got] == [(5, 1.0, None, False), (2, 0.0, None, True), (1, 0.0, 10.0, False)] and got[1]["code_ratio"] > 0


def test_senders(spark):
    body = "a message that is long enough to be told from others, and more"
    sends = spark.createDataFrame([("bob", 1000, 1, body.replace(" ", ""), False), ("me", 1001, 2, body.replace(" ", ""), False), ("bob", 1000, 3, "spawnthehelperwiththispromptnow", True)], "sender string, rts long, ord long, flat string, spawn boolean")
    turns = spark.createDataFrame([("whole", "me", 1006, body), ("emb", "me", 1006, "human words first " + body), ("lead", "me", 1006, body + " and yet more"), ("late", "me", 1000 + 5400, body), ("own", "bob", 1006, "x"), ("short", "me", 1006, "hi")], "id string, receiver string, ts long, text string")
    got = {r["id"]: (r["kind"], r["peer"]) for r in peers.senders(turns, sends).collect()}
    assert got == {"whole": ("whole", "bob"), "emb": ("embedded", "bob"), "lead": ("leading", "bob")}
    opened = spark.createDataFrame([("h", "bob", 1100, "spawn the helper with this prompt now"), ("n", "me", 1100, "spawn the helper with this prompt now")], "id string, me string, ts long, text string")
    assert [r["id"] for r in peers.spawned(opened, sends).collect()] == ["h"]


def test_heredocs(spark):
    got = one(spark, peers.heredocs, "cat > /a <<'EOF'\nl1\nl2\nEOF\necho; cat > \"b\" << X\nq\nX")
    assert [tuple(r) for r in got] == [("/a", "l1\nl2"), ("b", "q")]


def test_mirrors(spark):
    s = spark.createDataFrame([("new", 5), ("grown", 9), ("same", 3), ("shrunk", 1)], "path string, size long")
    m = spark.createDataFrame([("grown", 4), ("same", 3), ("shrunk", 2)], "path string, size long")
    assert {r["path"] for r in ingest.to_copy(s, m).collect()} == {"new", "grown"}
    old = spark.createDataFrame([("same", 3, "0")], "path string, size long, projection_version string")
    assert ingest.changed(s, old, "path", "size").count() == 4
    held = spark.createDataFrame([("t1", "f1")], "id string, file string")
    new = spark.createDataFrame([("t1", "f0"), ("t2", "f0"), ("t1", "f1")], "id string, file string")
    assert sorted(tuple(r) for r in ingest.owned_incremental(new, held, "id", "file").select("id", "file").collect()) == [("t1", "f1"), ("t2", "f0")]


def test_stream_ingest_is_repeatable(spark, tmp_path):
    import json

    from tarn import model as M
    from tarn.streaming import passes

    src = tmp_path / "in"
    src.mkdir()
    line = lambda i, t: json.dumps({"type": "user", "uuid": f"u{i}", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": t}})
    (src / "a.jsonl").write_text(line(1, "x") + "\n" + line(2, "y"))
    t = ingest.QuadTable(spark, str(tmp_path / "q"), 2)
    t.create(spark.createDataFrame([], M.QUAD))
    for k in (1, 2):
        passes.ingest_pass(spark, str(src), t, str(tmp_path / f"ck{k}")).awaitTermination()
        n = t.quads().count()
        assert n == 2 * 5
    (src / "b.jsonl").write_text(line(3, "z"))
    passes.ingest_pass(spark, str(src), t, str(tmp_path / "ck2")).awaitTermination()
    assert t.quads().select("g").distinct().count() == 2
