import pytest
from pyspark.sql import functions as F

from tarn import model as M
from tarn.operators import conversation, diagnostics, ingest, project
from tarn.plans import ontology
from tarn.plans.sparql import Store

TTL = f"""@prefix base: <{M.BASE}base/> . @prefix : <{M.BASE}graph/> . @prefix owl: <{M.OWL}> . @prefix rdfs: <{M.RDFS}> .
# a comment
:Turn a owl:Class ; rdfs:subClassOf base:Thing ; rdfs:comment "One turn, e.g. a reply. More." .
:role a owl:DatatypeProperty ; rdfs:domain :Turn ; rdfs:range [ owl:oneOf ( "a" "b" ) ] , owl:Thing ; .
:link owl:equivalentProperty base:link .
"""


def test_turtle_ontology_and_vocabulary(spark):
    o = ontology.ontology_of(TTL)
    assert o.class_names(M.BASE + "base/Thing") == [M.V("Turn")] and o.property_names(M.BASE + "base/link") == [M.V("link")]
    q = ontology.turtle_quads(spark, TTL, "http://o")
    assert q.where(F.col("p") == M.RDF + "first").count() == 2
    words = {r["name"]: r for r in ontology.vocabulary(q).collect()}
    assert words["Turn"]["said"] == "One turn, e.g. a reply." and words["role"]["domain"] == "Turn"


def test_names():
    assert M.Names(squad="a-b", user="c").root == f"{M.BASE}a-b/c/" and M.Names().root == M.BASE
    for bad in ({"squad": "a"}, {"squad": "A", "user": "b"}):
        with pytest.raises(ValueError):
            M.Names(**bad)


def test_attribution(spark):
    history = spark.createDataFrame([("/here", "c1"), ("/gone", "c2"), ("/gone", "c3"), ("/else", "c4"), ("/gone", "c4")], "workspace string, conv_id string")
    disk = spark.createDataFrame([(f"c{i}", i % 2 == 1, True) for i in range(1, 6)] + [("c6", False, False)], "conv_id string, has_full boolean, has_short boolean")
    mirrored = spark.createDataFrame([("c2",), ("c4",)], "conv_id string")
    existing = spark.createDataFrame([("/here",), ("/else",)], "workspace string")
    mine, rest = diagnostics.attributed(history, disk, mirrored, "/here", existing)
    assert sorted(tuple(r) for r in mine.collect()) == [("c1", "transcript_full", False, "workspace"), ("c2", "transcript", True, "mirror")]
    assert [r["conv_id"] for r in rest.collect()] == ["c5"]


def test_export_pass_and_import(spark, tmp_path):
    v = spark.createDataFrame([("e1", "c1", "1"), ("e2", "c1", "2"), ("e1", "c2", "1"), ("e1", "c3", "1")], "export string, uuid string, version_key string")
    m = spark.createDataFrame([("c1", "1"), ("c2", "1"), ("old", "9")], "uuid string, version_key string")
    todo, after = ingest.export_pass(v, m, spark.createDataFrame([("c3",)], "uuid string"))
    assert sorted(r["uuid"] for r in todo.collect()) == ["c1", "c3"]
    assert sorted(tuple(r) for r in after.collect()) == [("c1", "2"), ("c2", "1"), ("old", "9")]
    a = tmp_path / "a"
    a.mkdir()
    (a / "x.json").write_text("[]")
    assert ingest.import_export(str(a), str(tmp_path / "b")) == 2 and ingest.import_export(str(a), str(tmp_path / "b")) == 0
    (a / "x.json").write_text("{}")
    with pytest.raises(FileExistsError):
        ingest.import_export(str(a), str(tmp_path / "b"))


def test_label_peers_and_stretch_text(spark):
    body = "a message that is long enough to be told from others, and more"
    sends = spark.createDataFrame([("bob", 1767225600, 1, body.replace(" ", ""), False), ("me", 1767225600, 2, body.replace(" ", "") + "helper", True)], "sender string, rts long, ord long, flat string, spawn boolean")
    turns = spark.createDataFrame([("session", "c1", 0, "i0", "2026-01-01T00:00:05Z", "user", "hello"), ("session", "c1", 1, "i1", "2026-01-01T00:00:06Z", "user", body), ("session", "c1", 2, "i2", "2026-01-01T00:00:07Z", "assistant", "ok"), ("session", "c2", 0, "j0", "2026-01-01T00:00:05Z", "user", body + " helper")], "source string, conv_id string, pos long, id string, ts string, role string, text string")
    got = conversation.label_peers(turns, sends, "me").orderBy("pos").collect()
    assert [(r["id"], r["kind"], r["peer"]) for r in got] == [("i0", None, None), ("i1", "whole", "bob"), ("i2", None, None)]
    flat = spark.createDataFrame([("s", 0, 1, "t", "p", "user", "whole", "bob", "hi"), ("s", 0, 2, "t", "p", "user", None, None, "yo"), ("s", 0, 3, "t", "p", "assistant", None, None, "ok")], "soul string, stretch int, idx int, ts string, place string, role string, kind string, peer string, text string")
    assert conversation.stretch_text(flat, "soul", "Ann").first()["text"] == "[1] t · p\nbob (another agent, a message to you): hi\n\n[2] t · p\nAnn: yo\n\n[3] t · p\nyou: ok"


def test_recall(spark):
    notes = spark.createDataFrame([(i, f"m{i}", f"2026-0{i + 1}-01", "the Goat again" if i < 2 else "else", [f"t{i}"], "w") for i in range(4)], M.NOTE)
    sums = spark.createDataFrame([("0-1", "goat twice", "w", "", ""), ("0-3", "nothing", "w", "", "")], M.SUMMARY)
    e = spark.createDataFrame([("c", "t0", "user", "2026-01-01T00:00:00Z", "a GOAT!"), ("c", "t1", "user", "2026-01-02T00:00:00Z", "goats")], "conv_id string, event_id string, role string, timestamp string, text string")
    s = Store(project.memory(notes, sums).unionByName(project.turns(e)))
    r = diagnostics.recall(s, "goat")
    assert (r["said"], r["first"], r["months"], r["highest"]["b"], [n["i"] for n in r["latest"]]) == (1, "2026-01-01T00:00:00Z", {"2026-01": 1, "2026-02": 1}, "1", ["0", "1"])


def test_annotated_only(spark):
    e = spark.createDataFrame([("a",), ("b",)], "event_id string")
    assert ingest.annotated_only(e, spark.createDataFrame([("b",), ("b",)], "event_id string")).count() == 1


def test_finding_log(spark, tmp_path):
    import json

    from tarn.sources import finding_log, lines

    rows = [
        {"reader": "r", "event_type": "e/x", "ts": "2026-01-01T00:00:00Z", "anchor": {"seq": 4, "src_uuid": "", "turn_id": "t9", "start": 0, "end": 7}, "evidence": {"seqs": [3, 4]}, "signal": {"n": 3, "f": 0.5, "b": True, "s": "x y", "none": None, "confidence": 0.9, "version": 2}},
        {"reader": "r", "anchor": {}, "signal": "plain"}, {"reader": "render", "anchor": {}, "signal": {}},
    ]
    (tmp_path / "t1.found.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"reader": "r", "anch')
    got = finding_log.scan(lines.read_lines(spark, str(tmp_path)), ending=".found")
    assert got.count() == 2 and {r["conv_id"] for r in got.collect()} == {"t1"}
    q = finding_log.triples(got.unionByName(got)).collect()
    by = lambda p: sorted((r["o"] or r["tt"]["s"]).rsplit("/", 2)[-1] for r in q if r["p"].endswith(p))
    assert by("resolvedBy") == ["turn_id (src_uuid was empty)"] and by("graph/seq") == ["4"] and by("prov#used") == ["3", "4"]
    assert by("reifies") == ["t1", "t9"] and by("sig_n") == ["3"] and not by("sig_none") and by("confidence") == ["0.9", "0.9"] and by("detectorVersion") == ["2"]
    assert {r["dt"].rsplit("#")[-1] for r in q if "sig_" in r["p"]} == {"integer", "decimal", "boolean", "string"}
    want = __import__("hashlib").sha1(json.dumps(("t1", "r", "", {}, "plain"), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    assert any(r["s"].endswith("claim/" + want) for r in q)


def test_constants_reach_the_scan(spark, tmp_path):
    e = spark.createDataFrame([("c", f"t{i}", "user") for i in range(9)], "conv_id string, event_id string, role string")
    t = ingest.QuadTable(spark, str(tmp_path / "q"), 8)
    t.create(project.turns(e))
    s = Store(t.quads(), buckets=8)
    r = s.query("SELECT ?t { GRAPH <graph/NamedGraph/c> { ?t :role \"user\" } }")
    plan = r.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(gb" in plan and "EqualTo(g," in plan and "Exchange" not in plan
    assert r.df.count() == 9


def test_dates(spark):
    from tarn.functions import dates

    df = spark.createDataFrame([("2026-03-04T05:06:07.5Z", "2026-03-09", "2026-03-04"), ("nonsense-é-long", "2027-01-01", "2026-12-31"), ("", "", "")], "ts string, b string, a string")
    got = df.select(dates.local_date(F.col("ts")), dates.unix(F.col("ts")), dates.short(F.col("ts")), dates.span(F.col("a"), F.col("b"))).collect()
    assert tuple(got[0]) == ("2026-03-04", 1772600767, "2026-03-04 05:06", "2026-03-04..03-09")
    assert (got[1][0], got[1][1], got[1][3]) == ("nonsense-é", None, "2026-12-31..2027-01-01")
    assert got[2][3] == ""


def test_writer_asks_again():
    from tarn.operators import writer

    said = iter(["", "a\nb", '{"a": 1}', "#0-1 compressed", "fine"])
    got = writer.ask(lambda p: (next(said), 2, 1), "P", "0-1")
    assert got.line == "fine" and len(got.refused) == 4 and got.tokens_in == 10
    assert writer.ask(lambda p: ("the compression budget is used", 1, 1), "P").line is None
    assert writer.refusal("é" * 141).startswith("282 bytes") and writer.ask(writer.first_words(), "hello\nx").line == "hello"


def test_failed_conversations_are_named(spark, tmp_path):
    import json

    from tarn.sources import lines, step_log

    for name, rows in (("good", [{"step_index": 0, "source": "MODEL"}]), ("bad", [{"step_index": 0, "source": "MODEL"}, {"step_index": 0, "source": "SYSTEM"}])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    ok, failed = step_log.events_or_failed(lines.read_lines(spark, str(tmp_path)))
    assert [r["conv_id"] for r in ok.collect()] == ["good"] and [tuple(r) for r in failed.collect()] == [("bad", "duplicate step_index 0 with differing rows")]


def test_move_report_and_constructed_lines(spark):
    e = spark.createDataFrame([("c", "t0", "user", 'a "q"'), ("c", "t1", "user", "b")], "conv_id string, event_id string, role string, text string")
    q = project.turns(e)
    moved = project.readdressed(q, M.BASE, "https://new.example/")
    assert project.move_report(q, moved, M.BASE, "https://new.example/").first()["ok"] and not project.move_report(q, q, M.BASE, "x").first()["ok"]
    out = Store(q).query("CONSTRUCT { ?t :said ?x } WHERE { ?t :text ?x }").n_triples().collect()
    assert sorted(r["line"] for r in out)[0] == f'<{M.BASE}graph/Turn/t0> <{M.V("said")}> "a \\"q\\"" .'


def test_due(spark):
    from tarn.streaming.passes import due

    df = spark.sql("select * from values ('a', true, null, null), ('b', false, null, null), ('c', true, timestamp'2026-01-01 10:00:00', null), ('d', true, null, timestamp'2026-01-01 09:30:00'), ('e', true, timestamp'2026-01-01 09:00:00', null) as t(owner, dirty, paused_at, failed_at)")
    assert [r["owner"] for r in due(df, F.lit("2026-01-01 10:10:00").cast("timestamp")).orderBy("owner").collect()] == ["a", "e"]


def test_n_quads_of_any_length(spark):
    texts = ["x" * 10_000_000, '"\\' * 50_000, "a\\nb\n\\", "\\\\t\t\"", "", "\u0001 é"]
    q = spark.createDataFrame([("g", f"s{i}", "p", "lit", t, M.STRING, None, None) for i, t in enumerate(texts)] + [("g", "c", "p", "triple", None, None, None, ("a", "b", 'say "x" \\ \n'))], M.QUAD)
    back = project.parse_n_quads(project.n_triples(q, graphs=True))
    assert {r["s"]: r["o"] for r in back.where("o_kind = 'lit'").collect()} == {f"s{i}": t for i, t in enumerate(texts)}
    assert back.where("o_kind = 'triple'").first()["tt"]["o"] == 'say "x" \\ \n'


def test_channel_tags_of_any_length(spark):
    from tarn.functions import text as T

    texts = ["<channel " + "x" * 1_000_000, '<channel a="' + "y>" * 500_000 + '">hi</channel>', '<channel from_id="p1">a</channel>', "cd a && " * 50_000 + "ls"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.relabel_channels(F.col("t")).alias("c"), T.strip_cd(F.col("t")).alias("d"))
    got = df.collect()
    assert got[0]["c"] == texts[0] and got[1]["c"] == "[message from another agent, unnamed:]hi" and got[2]["c"].endswith("p1:]a") and got[3]["d"] == "ls"
