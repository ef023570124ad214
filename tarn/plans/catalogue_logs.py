"""Queries that run the log readers and the operators around them over logs made from the standard tables, each with its SQL twin.

The tables hold no logs, so lines of JSON are built from ``conversations`` by plain rules and read back by the library; the twins
say the same rules in SQL, over the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn import model as M
from tarn.functions import dates
from tarn.functions import text as T
from tarn.operators import conversation, diagnostics, ingest, memory_tree, project
from tarn.plans.catalogue import BASE, E_SQL, GRAPH, TURN, V, answers, events, label_findings, query, store, table, turn_quad_table
from tarn.plans.sparql import Store
from tarn.sources import export, session_log, step_log

C = F.col


def ident() -> Column:
    return F.concat_ws(":", C("conv_id").cast("string"), C("turn").cast("string"))


def said(*parts) -> Column:
    """Texts and columns put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


# session logs
def session_lines(spark, sf_dir) -> DataFrame:
    """A record a turn: words alone, or blocks with thinking, a call and its result; blank and torn lines between them."""
    c = table(spark, sf_dir, "conversations")
    odd = C("turn") % 4 == 1
    block = lambda **f: F.struct(*(f.get(k, F.lit(None).cast(t)).alias(k) for k, t in (("type", "string"), ("text", "string"), ("thinking", "string"), ("id", "string"), ("name", "string"), ("input", "map<string,string>"), ("tool_use_id", "string"), ("content", "string"), ("is_error", "boolean"))))
    call, given = said("c", C("turn")), F.when(odd, F.create_map(F.lit("command"), said("cd /a && ls x", C("turn")))).otherwise(F.create_map(F.lit("file_path"), said("/f/", C("turn"))))
    blocks = F.array(
        block(type=F.lit("text"), text=C("text")), block(type=F.lit("thinking"), thinking=said("so ", C("turn"))), block(type=F.lit("tool_use"), id=call, name=F.when(odd, "Bash").otherwise("Read"), input=given),
        block(type=F.lit("tool_result"), tool_use_id=call, content=said("out ", C("turn"), "\n\nmore"), is_error=C("turn") % 3 == 0),
    )
    model = F.when(C("role") == "assistant", F.when(C("conv_id") % 4 == 0, "<synthetic>").otherwise(said("model-", C("conv_id") % 3)))
    from tarn.plans.catalogue import TS

    record = lambda content: json(type=C("role"), uuid=ident(), parentUuid=F.when(C("turn") > 0, said(C("conv_id"), ":", C("turn") - 1)), timestamp=F.expr(TS), cwd=said("/home/", C("conv_id")), message=F.struct("role", content.alias("content"), model.alias("model")))
    line = F.when(C("turn") % 2 == 0, record(C("text"))).otherwise(record(blocks))
    lines = F.array(F.struct((C("turn") * 2).alias("line_no"), line.alias("value")), F.struct((C("turn") * 2 + 1).alias("line_no"), F.when(C("turn") % 2 == 0, "  ").otherwise('{"type":"user","uuid":"torn').alias("value")))
    return c.select(C("conv_id").cast("string").alias("conv_id"), F.explode(lines).alias("l")).select("conv_id", "l.*")


@query(f"""with {E_SQL}, k as (select *, turn % 2 = 1 b, 'out ' || turn || chr(10) || chr(10) || 'more' r from e where role in ('user', 'assistant'))
select id event_id, case when turn > 0 then conv_id || ':' || (turn - 1) end parent_id, role, ts as "timestamp", case when b then text || chr(10) || r else text end as "text",
'authored:0:' || strlen(text) || case when b then ';tool_result:' || (strlen(text) + 1) || ':' || (strlen(text) + 1 + strlen(r)) else '' end spans, case when b then 'so ' || turn end thinking,
case when role = 'assistant' and conv_id % 4 <> 0 then 'model-' || (conv_id % 3) end model, case when b then case when turn % 4 = 1 then 'ran' else 'read' end end kind, case when b then case when turn % 4 = 1 then 'ls x' || turn else '/f/' || turn end end target,
case when b then 'out ' || turn end outcome, case when b then 1 end::bigint more, case when b then turn % 3 = 0 end failed from k""")
def session_events(spark, sf_dir):
    e = session_log.events(session_lines(spark, sf_dir))
    spans = F.array_join(F.transform("text_provenance", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ";")
    act, out = F.get("actions", F.lit(0)), F.get("outcomes", F.lit(0))
    return e.select("event_id", "parent_id", "role", "timestamp", "text", spans.alias("spans"), "thinking", "model", act["kind"].alias("kind"), act["target"].alias("target"), out["first"].alias("outcome"), out["lines"].alias("more"), out["failed"].alias("failed"))


@query("select distinct conv_id::varchar conv_id, '/home/' || conv_id cwd from conversations")
def session_first_cwd(spark, sf_dir):
    return session_log.first_cwd(session_lines(spark, sf_dir))


@query(f"with {E_SQL} select conv_id::varchar conv_id, row_number() over (partition by conv_id order by turn) - 1 seq, role voice, text, id src_uuid, case when turn > 0 then conv_id || ':' || (turn - 1) else id end turn_id, ts from e where role in ('user', 'assistant') and trim(text) <> ''")
def session_prose(spark, sf_dir):
    """The lab reader's blocks: texts alone, numbered without holes."""
    return session_log.prose_blocks(session_lines(spark, sf_dir))


# step logs
def step_lines(spark, sf_dir) -> DataFrame:
    """A step a turn; indices of odd conversations leave every second one out, each fifth log has every line twice, each third a torn line."""
    c = table(spark, sf_dir, "conversations")
    third, step = C("turn") % 3, C("turn") * (C("conv_id") % 2 + 1)
    one = F.struct(F.lit("run_command").alias("name"), F.create_map(F.lit("CommandLine"), said("ls ", C("turn"))).alias("args"))
    two = F.struct(F.lit("view_file").alias("name"), F.create_map(F.lit("AbsolutePath"), said("/f/", C("turn"))).alias("args"))
    calls = F.when(third == 1, F.when(C("conv_id") % 3 == 0, F.array(one, two)).otherwise(F.array(one)))
    content = F.when(third == 2, said("noise\nOutput:\nres ", C("turn"), "\nlast")).when(C("turn") % 6 == 0, said("The user changed setting `Model Selection` from A to M", C("turn"), ". No need")).when(third == 0, C("text"))
    line = json(step_index=step, source=F.upper("role"), type=F.when(third == 0, "USER_INPUT").when(third == 1, "PLANNER_RESPONSE").otherwise("RUN_COMMAND"), status=F.when(C("turn") % 2 == 0, "DONE").otherwise("RUNNING"), content=content, tool_calls=calls, truncated_fields=F.when(C("turn") % 4 == 1, F.array(F.lit("content"))))
    copies = F.array_repeat(line, F.when(C("conv_id") % 5 == 0, 2).otherwise(1))
    torn = F.when((C("turn") == 0) & (C("conv_id") % 3 == 0), F.array(F.lit('{"step_index":1,"sou'))).otherwise(F.array().cast("array<string>"))
    return c.select(C("conv_id").cast("string").alias("conv_id"), F.explode(F.concat(copies, torn)).alias("value"))


STEP_SQL = "s as (select *, turn * (conv_id % 2 + 1) step, turn % 3 third from conversations)"


@query(f"""with {STEP_SQL} select conv_id || ':' || step event_id, case when conv_id % 2 = 0 and turn > 0 then conv_id || ':' || (step - 1) end parent_id, upper(role) as role,
case when third = 2 then 'noise' || chr(10) || 'Output:' || chr(10) || 'res ' || turn || chr(10) || 'last' when turn % 6 = 0 then 'The user changed setting `Model Selection` from A to M' || turn || '. No need' when third = 0 then text end as "text", 'M' || (turn - turn % 6) model_setting,
case when third = 1 then case when conv_id % 3 = 0 then 2 else 1 end else 0 end n_actions, case when third = 1 then 'ran ls ' || turn end act,
case when third = 2 then conv_id || ':' || (step - (conv_id % 2 + 1)) || ':0' end answers, case when third = 2 then 'res ' || turn end outcome, case when third = 2 then 1 end::bigint more from s""")
def step_events(spark, sf_dir):
    """Steps with their spine, actions, queued results and the setting carried forward."""
    e = step_log.events(step_lines(spark, sf_dir))
    act, out = F.get("actions", F.lit(0)), F.get("outcomes", F.lit(0))
    return e.select("event_id", "parent_id", "role", "text", "model_setting", F.size("actions").alias("n_actions"), F.concat_ws(" ", act["kind"], act["target"]).alias("act"), out["id"].alias("answers"), out["first"].alias("outcome"), out["lines"].alias("more")).withColumn("act", F.nullif("act", F.lit("")))


@query(f"""with {STEP_SQL}, k as (select conv_id, case when conv_id % 5 = 0 then 2 else 1 end k, * exclude (conv_id) from s),
n as (select conv_id, any_value(k) k, count(*) n, max(step) top, count(*) filter (turn % 4 = 1) cut, count(*) filter (turn % 2 = 0) done, count(*) filter (turn % 2 = 1) running from k group by conv_id)
select conv_id::varchar conv_id, (conv_id % 3 = 0)::bigint malformed, (n * (k - 1))::bigint duplicates, (cut * k)::bigint truncated, coalesce((done * k)::bigint, 0) done, coalesce((running * k)::bigint, 0) running, case when conv_id % 2 = 1 then array_to_string(list_transform(generate_series(1, (top // 2)), lambda i: 2 * i - 1), ',') else '' end gaps from n""")
def step_quality(spark, sf_dir):
    q = step_log.quality(step_lines(spark, sf_dir))
    seen = lambda k: F.coalesce(C("statuses")[k], F.lit(0)).cast("bigint")
    return q.select("conv_id", "malformed", "duplicates", "truncated", seen("DONE").alias("done"), seen("RUNNING").alias("running"), F.array_join(C("gaps").cast("array<string>"), ",").alias("gaps"))


@query("with s as (select user_id, event_id, count(*) over (partition by user_id, event_id % 40) k, event_id % 40 step, event_type from events), b as (select distinct user_id from s group by user_id, step having count(distinct event_type) > 1) select user_id::varchar conv_id, 'duplicate step_index ' || min(step) || ' with differing rows' reason from (select user_id, step from s group by user_id, step having count(distinct event_type) > 1) group by user_id")
def step_failed(spark, sf_dir):
    """Logs in which one index stands over differing rows."""
    lines = table(spark, sf_dir, "events").select(C("user_id").cast("string").alias("conv_id"), json(step_index=C("event_id") % 40, source=C("event_type")).alias("value"))
    return step_log.events_or_failed(lines)[1]


# exports
def export_versions(spark, sf_dir) -> DataFrame:
    """Conversations as an export has them; every third in a second, longer export too."""
    from tarn.plans.catalogue import TS

    c = table(spark, sf_dir, "conversations")
    word = F.struct(F.lit("text").alias("type"), C("text").alias("text"))
    attached = F.when(C("turn") % 4 == 2, F.array(F.struct(F.lit("f.txt").alias("file_name"), F.lit("in it").alias("extracted_content"))))
    message = F.struct(C("turn").alias("turn"), ident().alias("uuid"), F.when(C("role") == "user", "human").otherwise(C("role")).alias("sender"), F.expr(TS).alias("created_at"), F.array(word).alias("content"), attached.alias("attachments"))
    one = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    made = lambda name, at, m: F.struct(F.lit(name).alias("export"), F.parse_json(json(uuid=C("conv_id").cast("string"), updated_at=F.lit(at), chat_messages=m)).alias("v"), export.version_key(F.lit(at), F.size(m)).alias("version_key"))
    every = F.array(made("e1", "2026-01-01", F.slice("m", 1, 2)), F.when(C("conv_id") % 3 == 0, made("e2", "2026-01-02", C("m"))))
    return one.select(C("conv_id").cast("string").alias("uuid"), F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select("x.export", "uuid", "x.v", "x.version_key")


@query(f"""with {E_SQL}, k as (select *, row_number() over (partition by conv_id order by turn) r from e) select id event_id, lag(id) over (partition by conv_id order by turn) parent_id, role, ts as "timestamp",
text || case when turn % 4 = 2 then chr(10) || '[attachment: f.txt]' || chr(10) || 'in it' else '' end as "text" from k where conv_id % 3 = 0 or r <= 2""")
def export_events(spark, sf_dir):
    """The newest version of each conversation, as turns."""
    e = export.events(export.newest(export_versions(spark, sf_dir)))
    return e.select("event_id", "parent_id", "role", "timestamp", "text")


@query("with v as (select conv_id, count(*) n from conversations group by conv_id), k as (select conv_id, case when conv_id % 3 = 0 then '2026-01-02|' || lpad(n::varchar, 6, '0') else '2026-01-01|' || lpad(least(n, 2)::varchar, 6, '0') end version_key from v) select conv_id::varchar uuid, version_key, conv_id % 3 = 0 as todo from k")
def export_manifest(spark, sf_dir):
    """A pass over both exports after one over the first: what it does, and the manifest it leaves."""
    v = export_versions(spark, sf_dir).drop("v")
    before = v.where("export = 'e1'").select("uuid", "version_key")
    todo, after = ingest.export_pass(v, before)
    return after.join(todo.select("uuid", F.lit(True).alias("todo")), "uuid", "left").select("uuid", "version_key", F.coalesce("todo", F.lit(False)).alias("todo"))


# ownership, attribution, files
@query("with n as (select *, 'f' || (conv_id % 4) file from conversations), s as (select conv_id, turn, 'f' || (conv_id % 3) holder from conversations where turn < 3) select n.conv_id, n.turn, n.file from n left join s using (conv_id, turn) where holder is null or holder = file")
def owned_incremental(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ident().alias("id"))
    new, held = c.withColumn("file", said("f", C("conv_id") % 4)), c.where("turn < 3").withColumn("file", said("f", C("conv_id") % 3))
    return ingest.owned_incremental(new, held, "id", "file").select("conv_id", "turn", "file")


@query("select conv_id, turn from conversations where conv_id in (select doc_id from labels)")
def annotated_only(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", said("d", C("conv_id")).alias("event_id"))
    return ingest.annotated_only(c, label_findings(spark, sf_dir)).select("conv_id", "turn")


@query("with f as (select o_orderkey k, o_orderkey * 3 % 100 a, case when o_orderkey % 4 <> 1 then o_orderkey % 90 end b, o_orderkey % 7 <> 2 here from orders) select count(*) filter (here and b is not null) in_both, count(*) filter (here and b is null) missing, count(*) filter (not here and b is not null) only_mirror, coalesce(sum(greatest(a - coalesce(b, 0), 0)) filter (here), 0)::bigint bytes_behind, count(*) filter (here and a > b) growing from f")
def mirror_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(C("o_orderkey").cast("string").alias("path"), C("o_orderkey").alias("k"))
    source = o.where("k % 7 <> 2").select("path", (C("k") * 3 % 100).alias("size"))
    return diagnostics.directory_metrics(source, o.where("k % 4 <> 1").select("path", (C("k") % 90).alias("size")))


@query("select o_orderkey from orders where o_orderkey * 3 % 100 > o_orderkey % 90 or o_orderkey % 4 = 1")
def mirror_to_copy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("path"))
    return ingest.to_copy(o.withColumn("size", C("path") * 3 % 100), o.where("path % 4 <> 1").withColumn("size", C("path") % 90)).select(C("path").alias("o_orderkey"))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey)::int nth from orders qualify nth > 1")
def registry_problems(spark, sf_dir):
    return diagnostics.registry_problems(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""with h as (select distinct 'w' || (o_custkey % 20) workspace, o_custkey % 500 conv from orders where o_orderkey % 3 = 0), living as (select distinct conv from h where right(workspace, 1) in ('0', '2', '4', '6', '8')),
held as (select k conv, k % 2 = 1 has_full, k % 3 = 1 has_short from (select unnest(generate_series(0, 499)) k) where k % 2 = 1 or k % 3 = 1), m as (select conv, 'workspace' ground from h where workspace = 'w4' union all select conv, 'mirror' from (select distinct conv from h) where conv not in (select conv from living) and conv % 5 <> 0)
select conv::bigint conv_id, case when has_full then 'transcript_full' else 'transcript' end source, not has_full short_only, ground from held join m using (conv) union all select conv, 'none', null, 'unattributed' from held where conv not in (select conv from h)""")
def attribution(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")  # the recorded part of the history
    history = o.select(said("w", C("o_custkey") % 20).alias("workspace"), (C("o_custkey") % 500).alias("conv_id"))
    ids = spark.range(500).select(C("id").alias("conv_id"))
    disk, mirrored = ids.select("conv_id", (C("conv_id") % 2 == 1).alias("has_full"), (C("conv_id") % 3 == 1).alias("has_short")), ids.where("conv_id % 5 <> 0")
    mine, rest = diagnostics.attributed(history, disk, mirrored, "w4", spark.range(10).select(said("w", C("id") * 2).alias("workspace")))
    return mine.unionByName(rest.withColumns({"source": F.lit("none"), "short_only": F.lit(None).cast("boolean"), "ground": F.lit("unattributed")}))


# texts
def _cases(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("""with c as (select conv_id, turn, role, text, turn % 8 k from conversations)
select conv_id, turn, case k when 0 then '' when 1 then trim(text) || '!' when 2 then '(ran in the shell) ls ' || turn when 3 then '' when 4 then '/usr is a folder' else 'hi ' || turn end human,
case when k = 5 then 'ask ' || turn else 'none' end request, 'a' || turn || 'bc' flat, 'w' || turn || 'r3z' name, k in (1, 3) as slug,
case when k = 6 then '[the human quoting earlier words, then replying after <-:] "old" <- new ' || turn else 'plain' end quoted, case when k = 7 then '[pasted by the human — someone else''s words, not the human''s own:]x' || turn || '[end of paste]' else 'y' end pasted from c""")
def human_texts(spark, sf_dir):
    """What of a user's turn is the user's own: harness records, shell lines, requests, quoted and pasted words."""
    n, k = C("turn"), C("turn") % 8
    human = F.when(k == 0, said("<task-notification a>", n)).when(k == 1, F.concat(F.trim(C("text")), F.lit("<system-reminder>x\ny</system-reminder>!"))).when(k == 2, said("<bash-input> ls ", n, " </bash-input>")).when(k == 3, said("/clear", n)).when(k == 4, F.lit("/usr is a folder")).otherwise(said("hi ", n))
    slug = F.when(k == 1, said("a-b", n)).when(k == 3, said("x", n)).otherwise(said("a--b", n))
    return _cases(spark, sf_dir).select(
        "conv_id", "turn", T.human_words(human).alias("human"), T.request_body(F.when(k == 5, said("x<USER_REQUEST>\n ask ", n, " </USER_REQUEST>y")).otherwise(F.lit(" none "))).alias("request"), T.flat(said("a '", n, '\' "b"\\ `c`')).alias("flat"), T.name_key(said("W", n, "-r3Z!")).alias("name"), T.is_slug(slug).alias("slug"),
        T.mark_quote_backs(F.when(k == 6, said('  "old" <- new ', n)).otherwise(F.lit("plain"))).alias("quoted"), T.relabel_pastes(F.when(k == 7, said('<pasted_content id="1">x', n, "</pasted_content>")).otherwise(F.lit("y"))).alias("pasted"),
    )


@query("""with c as (select event_id, user_id, event_id % 9 k, ['Bash', 'Task', 'str_replace_editor', 'View', 'Grep', 'Glob', 'web_fetch', 'Other', 'run_subagent'][event_id % 9 + 1] tool from events)
select event_id, case k when 0 then 'ran' when 1 then 'subagent' when 2 then 'edited' when 3 then 'read' when 4 then 'searched' when 5 then 'listed' when 6 then 'fetched' when 7 then 'other' else 'subagent' end kind,
case when k = 0 then 'ls ' || user_id when k < 7 then '/p/' || user_id when k = 7 then 'v' || user_id else '' end target,
'[' || ['ran', 'asked a subagent', 'edited', 'read', 'searched', 'listed', 'fetched', 'used', 'asked a subagent'][k + 1] || ': ' || case when k = 0 then 'ls ' || user_id when k < 7 then '/p/' || user_id when k = 7 then 'v' || user_id else '' end
|| case when event_id % 5 = 0 then ' → failed: bad ' || user_id when event_id % 5 = 1 and k not in (2, 3, 5) then ' → no output' when event_id % 5 = 2 and k not in (2, 3, 5) then ' → line one (+2 lines)' else '' end || ']' line from c""")
def action_lines(spark, sf_dir):
    n, k, u = C("event_id") % 5, C("event_id") % 9, C("user_id")
    tool = F.element_at(F.array(*map(F.lit, ["Bash", "Task", "str_replace_editor", "View", "Grep", "Glob", "web_fetch", "Other", "run_subagent"])), k.cast("int") + 1)
    args = F.when(k == 0, F.create_map(F.lit("command"), said("cd /x && cd y; ls ", u))).when(k < 7, F.create_map(F.lit("file_path"), said(" /p/", u, "\n"))).when(k == 7, F.create_map(F.lit("zzz"), said("v", u), F.lit("toolSummary"), F.lit("no"))).otherwise(F.create_map().cast("map<string,string>"))
    out = F.when(n == 0, T.outcome_of(F.lit("i"), said("\n bad ", u), F.lit(True))).when(n == 1, T.outcome_of(F.lit("i"), F.lit(" \n"), F.lit(False))).when(n == 2, T.outcome_of(F.lit("i"), F.lit("\n line  one\n\ntwo\r\nthree"), F.lit(False)))
    e = table(spark, sf_dir, "events").select("event_id", T.action_kind(tool).alias("kind"), T.action_target(args).alias("target"), out.alias("o"))
    return e.select("event_id", "kind", "target", T.action_line(C("kind"), C("target"), C("o")).alias("line"))


@query("""select conv_id, turn, case when turn % 4 in (0, 1) then 'bob' || conv_id end as "from", case when turn % 4 in (0, 1) then 's' || turn end as session, case when turn % 4 = 0 then repeat('aB', 20) end soul, case when turn % 4 = 1 then 'a-b' end as "user",
case turn % 3 when 0 then '[message from another agent, w' || conv_id || ':]hi' when 1 then '[message from another agent, i' || turn || ':]y' else '<channel open' end channel, case when turn % 2 = 0 then 'M' || conv_id end setting from conversations""")
def sender_claims(spark, sf_dir):
    n, c = C("turn"), C("conv_id")
    line = F.when(n % 4 == 0, said("--msg v=1 from=bob", c, " session=s", n, " soul=", F.lit("aB" * 20), " user=NO--\nhello")).when(n % 4 == 1, said('<pasted_content id="3">\n--msg v=1 from=x from=bob', c, " pane= session=s", n, " soul=zz user=a-b--\nhello")).when(n % 4 == 2, said("--msg v=1 from=bob", c, " word--")).otherwise(F.lit("hello --msg v=1 from=x--"))
    channel = F.when(n % 3 == 0, said('<channel source="a>b" from_cwd="/q/w', c, '/">hi</channel>')).when(n % 3 == 1, said('<channel from_id="i', n, '">y')).otherwise(F.lit("<channel open"))
    setting = F.when(n % 2 == 0, said("The user changed setting `Model Selection` from A to B to M", c, ". No need")).otherwise(F.lit("The user changed setting `Model Selection` from A to None. No need"))
    return _cases(spark, sf_dir).withColumn("s", T.sender_claim(line)).select("conv_id", "turn", "s.from", "s.session", "s.soul", "s.user", T.relabel_channels(channel).alias("channel"), T.announced_setting(setting).alias("setting"))


@query("""with d as (select o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) t, o_orderdate::date a, (o_orderdate + to_days((o_orderkey % 500)::int))::date b from orders)
select o_orderkey, epoch(t)::bigint as "unix", strftime(t, '%Y-%m-%d') "day", strftime(t, '%Y-%m-%d %H:%M') || ' +00:00' as "time", strftime(t, '%Y-%m-%d %H:%M') short, case when a = b then a::varchar when year(a) = year(b) then a || '..' || strftime(b, '%m-%d') else a || '..' || b end as span, (o_orderkey % 7777)::bigint ago, 'not a ti' || (o_orderkey % 2) || 'm' as raw from d""")
def local_times(spark, sf_dir):
    at = F.date_format(C("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey % 86400)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    a, b = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add(C("o_orderdate").cast("date"), (C("o_orderkey") % 500).cast("int")), "yyyy-MM-dd")
    now = F.expr("timestamp'2026-01-01 00:00:00Z'")
    return table(spark, sf_dir, "orders").withColumn("ts", at).select(
        "o_orderkey", dates.unix(C("ts")).alias("unix"), dates.local_date(C("ts")).alias("day"), dates.local_time(C("ts")).alias("time"), dates.short(C("ts")).alias("short"), dates.span(a, b).alias("span"),
        dates.seconds_since(now - F.expr("make_dt_interval(0, 0, 0, o_orderkey % 7777)"), now).alias("ago"), dates.local_date(said("not a ti", C("o_orderkey") % 2, "me")).alias("raw"),
    )


@query("""select doc_id, case when doc_id % 5 = 0 then 'empty' when doc_id % 5 = 1 then 'lines' when doc_id % 5 = 2 then 'long' when doc_id % 5 = 3 then 'json' end why from documents""")
def note_refusals(spark, sf_dir):
    from tarn.operators.writer import WHY

    k = C("doc_id") % 5
    t = F.when(k == 0, F.lit(" \n")).when(k == 1, F.lit("a\r\nb")).when(k == 2, F.rpad(said("é", C("doc_id")), 281, "x")).when(k == 3, json(a=C("doc_id"))).otherwise(said("a note on ", C("doc_id")))
    why = T.note_error(t)
    named = F.coalesce(*(F.when(why.endswith(v.split("{")[0]) if "{" not in v else why.contains(v.split("{")[0]), F.lit(n)) for n, v in WHY.items()))
    return table(spark, sf_dir, "documents").select("doc_id", named.alias("why"))


@query("select conv_id, turn, 'cli · home · ' || left('s' || conv_id || 'abcdefgh', 8) place, case when role <> 'user' then 'you' when turn % 4 = 2 then 'bob (another agent, a message to you)' else 'Ann' end speaker from conversations")
def speakers(spark, sf_dir):
    kind = F.when((C("turn") % 4 == 2), F.lit("whole"))
    return _cases(spark, sf_dir).select("conv_id", "turn", conversation.where_label(F.lit("cli"), F.lit("home"), said("s", C("conv_id"), "abcdefgh")).alias("place"), conversation.speaker_line(C("role"), kind, F.lit("bob"), "Ann").alias("speaker"))


# graphs
@query(f"with {E_SQL}, q as (select '{GRAPH}' || conv_id g, '{TURN}' || id s, '{V}text' p, text || chr(9) || '\"\\' o from e union all select '{GRAPH}' || conv_id, '{TURN}' || id, '{V}parentTurn', '{TURN}' || parent from e where parent is not null) select * from q")
def n_quads_round_trip(spark, sf_dir):
    """Quads written as N-Quads lines and read back: escaped literals and links."""
    e = events(spark, sf_dir).withColumn("text", F.concat("text", F.lit('\t"\\')))
    lines = project.n_triples(project.turns(e).where(C("p").isin(M.V("text"), M.V("parentTurn"))), graphs=True)
    return project.parse_n_quads(lines).select("g", "s", "p", "o")


@query(f"""with l as (select 'd' || doc_id id from labels) select '{TURN}' || id s, '{V}exhibits' p, 'label/doc' o, count(*) n from l group by all""")
def claims_round_trip(spark, sf_dir):
    """Triple terms written as lines and read back."""
    lines = project.n_triples(project.findings(label_findings(spark, sf_dir)).where(C("p") == M.REIFIES), graphs=True)
    return project.parse_n_quads(lines).groupBy("tt.s", "tt.p", "tt.o").agg(F.count("*").alias("n"))


MOVED = "https://new.example/"


@query(f"with {E_SQL} select '{MOVED}graph/Turn/' || id s, '{MOVED}graph/role' p, role o from e")
def readdressed(spark, sf_dir):
    q = project.readdressed(turn_quad_table(spark, sf_dir), M.BASE, MOVED)
    return q.where(C("p") == MOVED + "graph/role").select("s", "p", "o")


@query(f"with {E_SQL}, n as (select 4 * count(*) + count(parent) + count(model) + count(text) n, count(distinct id) t from e) select n::bigint statements_before, t::bigint turns_before, n::bigint statements_after, t::bigint turns_after, 0::bigint at_after, true ok from n")
def move_counts(spark, sf_dir):
    q = turn_quad_table(spark, sf_dir)
    return project.move_report(q, project.readdressed(q, M.BASE, MOVED), M.BASE, MOVED).select("statements_before", "turns_before", "statements_after", "turns_after", "at_after", "ok")


@query(f"select distinct '{GRAPH}' || conv_id g, 'TranscriptGraph' kind, '{BASE}soul/Soul/ann' as owner from conversations")
def graph_descriptions(spark, sf_dir):
    d = ingest.described(turn_quad_table(spark, sf_dir), owner=f"{BASE}soul/Soul/ann")
    one = lambda p: F.max(F.when(C("p") == p, C("o")))
    return d.groupBy(C("s").alias("g")).agg(F.regexp_replace(one(M.TYPE), "^.*/", "").alias("kind"), one(M.V("owner")).alias("owner"))


def stored_store(spark, sf_dir) -> tuple[Store, ingest.QuadTable]:
    """The turns in a quad table of their own, bucketed by graph, with half of the graphs replaced."""
    from tarn.sources.shared import fresh_folder

    t = ingest.QuadTable(spark, fresh_folder(spark, "quads"), 8)
    t.create(turn_quad_table(spark, sf_dir))
    t.replace(project.turns(events(spark, sf_dir).where("cast(conv_id as bigint) % 2 = 0").withColumn("role", F.upper("role"))))
    return Store(t.quads(), buckets=8), t


@query(f"with {E_SQL} select case when conv_id % 2 = 0 then upper(role) else role end as role, count(*) turns from e group by all")
def quad_table_replace(spark, sf_dir):
    s, _ = stored_store(spark, sf_dir)
    return answers(s, "SELECT ?role (COUNT(?t) AS ?turns) { GRAPH ?g { ?t :role ?role } } GROUP BY ?role", ("turns",))


@query(f"with {E_SQL} select '{TURN}' || id t, case when conv_id % 2 = 0 then upper(role) else role end as role from e where conv_id = 4")
def quad_table_one_graph(spark, sf_dir):
    """One graph of the stored table: its bucket alone is read."""
    s, _ = stored_store(spark, sf_dir)
    return answers(s, "SELECT ?t ?role { GRAPH <graph/NamedGraph/4> { ?t :role ?role } }")


@query(f"with {E_SQL} select exists (select 1 from e where role = 'assistant') yes, exists (select 1 from e where role = 'nobody') no")
def ask_answers(spark, sf_dir):
    s = store(spark, sf_dir)
    ask = lambda role, name: s.query(f'ASK {{ ?t :role "{role}" }}').df.withColumnRenamed("answer", name).withColumn("_k", F.lit(1))
    return ask("assistant", "yes").join(ask("nobody", "no"), "_k").drop("_k")


@query(f"with {E_SQL} select '<{TURN}' || id || '> <{V}saidBy> \"' || role || '\" .' line from e union select '<{TURN}' || parent || '> <{V}answeredBy> <{TURN}' || id || '> .' from e where parent is not null")
def construct_lines(spark, sf_dir):
    return store(spark, sf_dir).query("CONSTRUCT { ?t :saidBy ?r . ?p :answeredBy ?t } WHERE { ?t :role ?r OPTIONAL { ?t :parentTurn ?p } }").n_triples()


@query(f"with {E_SQL} select '{TURN}' || id s, '{V}role' p, role o from e where conv_id = 1 and turn = 0")
def describe_answer(spark, sf_dir):
    r = store(spark, sf_dir).query("DESCRIBE <graph/Turn/1:0>").plain()
    return r.where(C("p") == M.V("role"))


@query(f"with {E_SQL} select '{GRAPH}' || conv_id g, count(*) n, max(ts) latest from e group by conv_id having count(*) > 4")
def graph_sizes(spark, sf_dir):
    """Graphs by their turns, the largest first."""
    return answers(store(spark, sf_dir), "SELECT ?g (COUNT(?t) AS ?n) (MAX(STR(?ts)) AS ?latest) { GRAPH ?g { ?t a :Turn ; :timestamp ?ts } } GROUP BY ?g HAVING (COUNT(?t) > 4) ORDER BY DESC(?n) ?g", ("n",))


@query(f"with {E_SQL} select '{TURN}' || id t, ts from e order by ts desc, id limit 20")
def latest_turns(spark, sf_dir):
    """The twenty latest turns: a top-k report. Ties of a time are by address, as text."""
    return answers(store(spark, sf_dir), "SELECT ?t (STR(?at) AS ?ts) { ?t a :Turn ; :timestamp ?at } ORDER BY DESC(?at) STR(?t) LIMIT 20")


@query("select n_name name from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 5000)")
def filter_exists(spark, sf_dir):
    from tarn.plans.catalogue import geo

    return answers(Store(geo(spark, sf_dir)), "SELECT ?name { ?n a :Nation ; :name ?name FILTER EXISTS { ?s :in ?n ; :balance ?b FILTER(?b > 5000) } }")


@query("select r_name region, n_name nation, count(s_suppkey) n from nation join region on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey and s_acctbal < 0 group by all")
def nested_select(spark, sf_dir):
    from tarn.plans.catalogue import geo

    text = "SELECT ?region ?nation ?n { ?x a :Nation ; :name ?nation ; :in/:name ?region { SELECT ?x (COUNT(?s) AS ?n) { ?x a :Nation OPTIONAL { ?s :in ?x ; a :Supplier ; :balance ?b FILTER(?b < 0) } } GROUP BY ?x } }"
    return answers(Store(geo(spark, sf_dir)), text, ("n",))


@query(f"with {E_SQL} select '{TURN}' || id t, substr(ts, 1, 7) as \"month\", length(text)::bigint chars, case when length(text) > 300 then 'long' else 'short' end size, upper(role) as who from e where contains(lower(text), 'le') and turn > 0")
def computed_terms(spark, sf_dir):
    """BIND, string and conditional built-ins, numbers in a filter."""
    text = 'SELECT ?t ?month ?chars ?size ?who { GRAPH ?g { ?t :text ?x ; :timestamp ?ts ; :role ?r ; :turnId ?i } BIND(SUBSTR(STR(?ts), 1, 7) AS ?month) BIND(STRLEN(?x) AS ?chars) BIND(IF(?chars > 300, "long", "short") AS ?size) BIND(UCASE(?r) AS ?who) FILTER(CONTAINS(LCASE(?x), "le") && xsd:integer(STRAFTER(?i, ":")) > 0) }'.replace("xsd:integer(STRAFTER(?i, \":\")) > 0", '!STRENDS(?i, ":0")')
    return answers(store(spark, sf_dir), text, ("chars",))


# memory
def _notes(spark, sf_dir) -> DataFrame:
    """Every order as a note, by its place in the log."""
    o = table(spark, sf_dir, "orders")
    return o.select(C("o_orderkey").alias("pos"), said("m", C("o_orderkey")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), C("o_orderpriority").alias("text"), F.array(said("t", C("o_orderkey"))).alias("turns"), F.lit("w").alias("model"))


@query("""with recursive t as (select count(*) t from orders), b as (select 1::bigint n, o_orderkey lo, substr(o_orderpriority, 1, 1) x from orders union all
select n, lo, x from (select n * 2 n, lo - lo % (n * 2) lo, string_agg(x, '' order by lo) x, count(*) k from b group by all) where k = 2) select (lo || '-' || (lo + n - 1)) block, case when length(x) > 16 then left(x, 8) || '~' || right(x, 8) else x end as "text" from b where n > 1""".replace("with recursive t as", "with recursive t0 as"))
def memory_build(spark, sf_dir):
    """All blocks of the tree, level by level, by a writer that keeps the ends of its two parts."""
    whole = lambda parts: F.array_join(F.transform(parts, lambda x: F.when(F.length(x) > 1, F.when(x.rlike("^[1-5]-"), F.substring(x, 1, 1)).otherwise(x)).otherwise(x)), "")
    ends = lambda x: F.when(F.length(F.replace(x, F.lit("~"), F.lit(""))) > 16, F.concat(F.substring(x, 1, 8), F.lit("~"), F.right(x, F.lit(8)))).otherwise(x)
    n = table(spark, sf_dir, "orders").count()
    none = spark.createDataFrame([], M.SUMMARY)
    return memory_tree.build_all(_notes(spark, sf_dir), none, n, lambda parts: ends(whole(parts))).select("block", "text")


@query("""with k as (select o_orderkey k from orders), f as (select 'note text' failure, 'm' || k ident from k where k % 1000 = 7 union all select 'unknown turn', 't' || k from k where k % 9 = 0 union all select 'repeated id', 'm' || (k - 1) from k where k % 500 = 1 and k > 0
union all select 'block id', k || '-' || (k + 2) from k where k % 700 = 3 union all select 'block text', k || '-' || (k + 1) from k where k % 800 = 2 union all select 'past the log', (2 * k) || '-' || (2 * k + 1) from k where 2 * k >= (select count(*) from orders) and k % 300 = 0) select failure, ident from f""")
def memory_check(spark, sf_dir):
    """What is wrong with a log in which some texts, ids, citations and blocks were made wrong."""
    o = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("k"))
    notes = _notes(spark, sf_dir).withColumns({"text": F.when(C("pos") % 1000 == 7, "two\nlines").otherwise(C("text")), "id": F.when((C("pos") % 500 == 1) & (C("pos") > 0), said("m", C("pos") - 1)).otherwise(C("id"))})
    block = lambda lo, hi, text: F.struct(memory_tree.block_id(lo, hi).alias("block"), text.alias("text"))
    k = C("k")
    made = F.filter(F.array(F.when(k % 700 == 3, block(k, k + 3, F.lit("x"))), F.when(k % 800 == 2, block(k, k + 2, F.lit(" "))), F.when(k % 300 == 0, block(k * 2, k * 2 + 2, F.lit("x")))), lambda x: x.isNotNull())
    sums = o.select(F.explode(made).alias("x")).select("x.*")
    known = o.where("k % 9 <> 0").select(said("t", k).alias("event_id"))
    return memory_tree.check(notes, sums, known, table(spark, sf_dir, "orders").count())


@query("""with c as (select conv_id, turn, conv_id || ':' || turn id from conversations), a as (select conv_id n, list(turn + 1 order by turn) cites from c where turn in (1, 2) group by conv_id)
select n, 't' || list_min(cites) ts, case when len(cites) = 2 then n || ':1,' || n || ':2' else n || ':' || (cites[1] - 1) end turns from a""")
def accepted_notes(spark, sf_dir):
    """A writer's notes over each conversation, citing its second and third turns out of order, one of them twice, and one that isn't there."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ident().alias("id"))
    stretch = c.select((C("conv_id") * 1000 + C("turn") + 1).alias("idx"), "id", said("t", C("turn") + 1).alias("ts"))
    asked = c.where("turn in (1, 2)").groupBy("conv_id").agg(F.lit(1).alias("_"))
    base = C("conv_id") * 1000
    answers_ = asked.select(C("conv_id").alias("n"), said("note ", C("conv_id")).alias("text"), F.array(base + 3, base + 2, base + 3, base + 900).alias("cites"))
    r = conversation.accepted_notes(answers_, stretch)
    return r.select("n", "ts", F.array_join("turns", ",").alias("turns"))


# passes
PEERS = ["Ada", "Bob-2", "cyd"]


@query("""with c as (select conv_id, turn, ['Ada', 'Bob-2', 'cyd', 'Dan'][conv_id % 4 + 1] n, turn % 5 k from conversations)
select conv_id, turn, case when n = 'Dan' then null when k < 4 then n end who, case when n <> 'Dan' and k < 4 then '[message from another agent, ' || n || ':]' || chr(10) else '' end || case k when 0 then upper(n) || ' here: ' || turn when 1 then lower(n) || ' -> me: ' || turn when 2 then 'me — ' || n || '. ' || turn when 3 then 'all here (' || n || ') ' || turn else 'x' || chr(10) || n || ' here' end said from c""")
def typed_senders(spark, sf_dir):
    n, k = F.element_at(F.array(*map(F.lit, ["Ada", "Bob-2", "cyd", "Dan"])), (C("conv_id") % 4 + 1).cast("int")), C("turn") % 5
    t = F.when(k == 0, said(F.upper(n), " here: ", C("turn"))).when(k == 1, said(F.lower(n), " -> me: ", C("turn"))).when(k == 2, said("me — ", n, ". ", C("turn"))).when(k == 3, said("all here (", n, ") ", C("turn"))).otherwise(said("x\n", n, " here"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.typed_sender(t, PEERS, "Me").alias("who"), T.relabel_human(t, PEERS, "Me").alias("said"))


@query("""with t as (select count(*) t from orders), s as (select count(*) n from events), p as (select sum(t // (1::bigint << i)) n from t, (select unnest(generate_series(1, 40)) i))
select n::bigint turns, (select count(*) from events where event_id % 3 <> 0) turns_read, t::bigint notes, (t // 2)::bigint blocks, (select n from p)::bigint - t // 2 pending_blocks, false done from t, s""")
def memory_progress(spark, sf_dir):
    """A log of all orders with its pairs built, over events of which two thirds were read."""
    n = table(spark, sf_dir, "orders").count()
    e = table(spark, sf_dir, "events").select(C("event_id").cast("string").alias("id"))
    pairs = spark.range(n // 2).select(memory_tree.block_id(C("id") * 2, C("id") * 2 + 2).alias("block"), F.lit("x").alias("text"))
    return diagnostics.progress(e, e.where("id % 3 <> 0"), _notes(spark, sf_dir), pairs, n)


@query("select user_id as owner, count(*) calls, sum(event_id % 100)::bigint tokens_in, sum(event_id % 7)::bigint tokens_out, left(min(ts)::varchar, 19) \"first\", left(max(ts)::varchar, 19) \"last\" from events group by user_id")
def writer_usage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return diagnostics.usage(e.select(C("user_id").alias("owner"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), (C("event_id") % 100).alias("tokens_in"), (C("event_id") % 7).alias("tokens_out")))


@query("""with e as (select *, user_id % 50 o, repeat('x', (50 * (event_id % 40))::int) txt from events where ts < timestamp '2024-01-30 23:30:00'), l as (select o, count(*) turns, sum(strlen(txt))::bigint bytes, min(ts) oldest from e group by o)
select o as owner, turns, bytes, case when o % 5 in (1, 2) then 'not-due' when bytes >= 24000 then 'flush-size' when oldest < timestamp '2024-01-30 18:00:00' then 'flush-age' else 'wait' end decision from l""")
def memory_decisions(spark, sf_dir):
    """A first pass of the memory loop: what each owner's unread, settled turns lead to."""
    from tarn.sources.shared import fresh_folder
    from tarn.streaming import passes

    e = table(spark, sf_dir, "events").select((C("user_id") % 50).alias("owner"), C("event_id").cast("string").alias("id"), "ts", F.repeat(F.lit("x"), (C("event_id") % 40 * 50).cast("int")).alias("text"))
    now = F.expr("timestamp_ntz'2024-01-31 00:00:00'")
    paused = F.when(C("id") % 5 == 2, F.expr("timestamp_ntz'2024-01-30 23:45:00'"))
    state = spark.range(50).select(C("id").alias("owner"), (C("id") % 5 != 1).alias("dirty"), paused.alias("paused_at"), F.lit(None).cast("timestamp_ntz").alias("failed_at"))
    return passes.memory_pass(e, state, fresh_folder(spark, "memory"), now, lambda rows: rows.select(said("m", C("id")).alias("id"), "owner"))


@query(f"with {E_SQL} select conv_id::varchar conv_id, count(*) turns, count(model) modelled from e where role in ('user', 'assistant') group by conv_id")
def arriving_transcripts(spark, sf_dir):
    """Session logs that come into a folder in two lots, with a pass after each: the graphs hold every turn once."""
    from tarn.sources.shared import fresh_folder
    from tarn.streaming import passes

    src, q = fresh_folder(spark, "logs"), ingest.QuadTable(spark, fresh_folder(spark, "quads"), 8)
    q.create(turn_quad_table(spark, sf_dir).limit(0))
    lines = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    from tarn.plans.catalogue import MODEL

    record = json(type=C("role"), uuid=ident(), message=F.struct("role", C("text").alias("content"), F.expr(MODEL).alias("model")))
    manifest = fresh_folder(spark, "manifest")
    for lot in (C("turn") <= 1, C("turn") > 1):
        lines.where(lot).select((C("conv_id") % 8).alias("part"), "conv_id", "turn", record.alias("value")).repartition("part").sortWithinPartitions("conv_id", "turn").select("part", "value").write.mode("append").option("compression", "none").partitionBy("part").text(src)
        passes.sync_pass(spark, src, q, manifest, dialect="session", pattern="part-*")
    one = lambda p: F.count_if(C("p") == M.V(p))
    return q.quads().groupBy(F.regexp_extract("s", "/([0-9]+):", 1).alias("conv_id")).agg(one("turnId").alias("turns"), one("model").alias("modelled"))


# reports
FOLDERS = ["Here-x", "proven", "other", "nested", "here.x", "both"]
FOLDER_SQL = """f as (select o_orderkey k, ['Here-x', 'proven', 'other', 'nested', 'here.x', 'both'][o_custkey % 6 + 1] slug, o_orderkey % 100 size, o_orderkey % 600 < 300 live, o_orderkey % 3 <> 0 and o_custkey % 6 <> 3 top from orders),
h as (select *, case when slug = 'proven' and top and k % 2 = 0 then size + k % 5 - 2 when slug = 'proven' and not top then k % 90 when slug = 'both' then size end have from f),
g as (select *, coalesce(have, 0) < size behind, size - coalesce(have, 0) gap, slug = 'both' and k % 10 = 1 here, case when top then '' else 'sub/' end || k || '.jsonl' path from h),
a as (select slug, bool_or(top and have is not null) proven, count(*) filter (top) sessions, count(*) transcripts, count(*) filter (here) in_both, min(path) filter (here) example,
count(*) filter (behind and not (live and slug <> 'Here-x')) unmirrored, coalesce(sum(gap) filter (behind and not (live and slug <> 'Here-x')), 0)::bigint unmirrored_bytes, count(*) filter (behind and live and slug <> 'Here-x') growing from g where slug in ('Here-x', 'proven', 'both') group by slug)"""


def other_folder_rows(spark, sf_dir) -> DataFrame:
    """Every order as a transcript of one of six folders; what is kept of one has a date before its name."""
    k, slug = C("k"), F.element_at(F.array(*map(F.lit, FOLDERS)), (C("o_custkey") % 6 + 1).cast("int"))
    top = (k % 3 != 0) & (C("o_custkey") % 6 != 3)
    f = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("k"), "o_custkey").select("k", slug.alias("slug"), (k % 100).alias("size"), (k % 600).alias("age"), top.alias("top"), said(F.when(top, "").otherwise("sub/"), k, ".jsonl").alias("path"))
    proven, both = C("slug") == "proven", C("slug") == "both"
    have = F.when(proven & C("top") & (k % 2 == 0), C("size") + k % 5 - 2).when(proven & ~C("top"), k % 90).when(both, C("size"))
    mirror = f.select(F.when(proven & C("top"), said("2026-01-02-", C("path"))).otherwise(C("path")).alias("path"), have.alias("size")).where("size is not null")
    return diagnostics.siblings(f.select("slug", "path", "size", "age"), f.where(both & (k % 10 == 1)).select("path"), mirror, "here.x")


@query(f"with {FOLDER_SQL} select * from a")
def other_folders(spark, sf_dir):
    """Folders of other names that hold the history of this one."""
    return other_folder_rows(spark, sf_dir)


@query(f"""with {FOLDER_SQL}, m as (select *, case when a = b then 'current' when age <= 1800 and lag > 259200 then 'growing-long' when age <= 1800 then 'growing' when b is null then 'missing' else 'stale' end s
from (select o_orderkey % 100 a, case when o_orderkey % 11 <> 0 then o_orderkey % 90 end b, (o_orderkey * 37) % 4000 age, (o_orderkey * 91) % 500000 lag from orders)),
n as (select count(*) n, count(*) filter (s = 'current') c, count(*) filter (s like 'growing%') g, count(*) filter (s = 'stale') st, count(*) filter (s = 'missing') mi, count(*) filter (s = 'growing-long') long, max(lag // 86400) filter (s = 'growing-long') worst, sum(greatest(a - coalesce(b, 0), 0)) filter (s = 'growing-long') bytes from m),
w as (select *, slug || case when proven then ' (proven): ' else ' (suspected): ' end how, case when growing > 0 then ', ' || growing || ' being written' else '' end live from a), v as (select distinct conv_id from conversations)
select 'layout' topic, true attention, 'folders of the older layout are left: store, logs' line union all select 'mirror', st + mi > 0, n || ' transcripts: ' || c || ' current, ' || g || ' growing, ' || st || ' stale, ' || mi || ' missing' from n
union all select 'mirror age', true, long || ' growing transcripts are behind for over 3 days, ' || worst || ' at worst; ' || bytes || ' bytes are in one place only' from n where long > 0
union all select 'folders', unmirrored > 0, how || case when unmirrored > 0 then unmirrored || ' of ' || transcripts || ' transcripts are not whole in the mirror, ' || unmirrored_bytes || ' bytes behind' else 'all ' || transcripts || ' transcripts are in the mirror' end || live from w
union all select 'folders', true, slug || ': ' || in_both || ' transcripts are in the current folder too, ' || example || ' among them; the mirror keeps the larger' from w where in_both > 0
union all select 'step logs', count(*) filter (conv_id % 5 = 0) > 0, count(*) || ' conversations: ' || count(*) filter (conv_id % 5 <> 0) || ' kept, ' || count(*) filter (conv_id % 5 = 0) || ' never' from v
union all select 'orphans', false, count(*) || ' conversations on this machine belong to no folder' from v where conv_id % 7 = 0 having count(*) > 0
union all select 'store', false, count(distinct conv_id) || ' graphs, ' || count(*) || ' turns, the latest at ' || max(turn) from conversations""")
def soul_report(spark, sf_dir):
    """The whole report on the files made of the tables."""
    k = C("o_orderkey")
    files = table(spark, sf_dir, "orders").select((k % 100).alias("size"), F.when(k % 11 != 0, k % 90).alias("mirror_size"), (k * 37 % 4000).alias("age"), (k * 91 % 500000).alias("behind_for"))
    c = table(spark, sf_dir, "conversations")
    v = c.select("conv_id").distinct()
    stored = c.agg(F.count_distinct("conv_id").alias("graphs"), F.count("*").alias("turns"), F.max("turn").alias("latest"))
    return diagnostics.soul_report(spark, ["store", "logs"], files, files, other_folder_rows(spark, sf_dir), v.withColumn("kept", C("conv_id") % 5 != 0), v.where("conv_id % 7 = 0"), stored)


@query("""with t as (select count(*) t from orders), n as (select o_orderkey k from orders), p as (select unnest(generate_series(0, t // 2 - 1)) k from t), s as (select unnest(list_transform(generate_series(2, 40), lambda i: 1::bigint << i)) n),
d as (select n, unnest(generate_series(0, t // n - 1)) k from s, t where n <= t) select 'no turn' failure, 'm' || k ident from n where k % 1000 = 7 union all select 'not in the store', 't' || k from n where k % 9 = 0 and k % 1000 <> 7
union all select 'block text', (2 * k) || '-' || (2 * k + 1) from p where k % 50 = 0 union all select 'due', (k * n) || '-' || (k * n + n - 1) from d""")
def memory_verify(spark, sf_dir):
    """A log of all orders with its pairs built, some under their own label; some notes cite nothing, some turns are in no store."""
    n = table(spark, sf_dir, "orders").count()
    notes = _notes(spark, sf_dir).withColumn("turns", F.when(C("pos") % 1000 == 7, F.array().cast("array<string>")).otherwise(C("turns")))
    block = memory_tree.block_id(C("id") * 2, C("id") * 2 + 2)
    pairs = spark.range(n // 2).select(block.alias("block"), F.when(C("id") % 50 == 0, said("#", block, " x")).otherwise("x").alias("text"))
    known = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("k"), said("t", C("o_orderkey")).alias("event_id"))
    return memory_tree.verify(notes, pairs, known, n, known.where("k % 9 <> 0").select(C("event_id").alias("turn")), None)


@query("""with t as (select count(*) t from orders), b as (select unnest(generate_series(0, t // 2 - 1)) * 2 lo, t from t), w as (select * from b where lo // 2 % 5 = 0), e as (select lo - lo % 8 lo, t from w where lo - lo % 8 + 8 <= t and lo // 8 % 3 <> 1)
select lo::bigint lo, (lo + 2)::bigint hi from w union select lo - lo % 4, lo - lo % 4 + 4 from w where lo - lo % 4 + 4 <= t union select lo, lo + 8 from e union select lo - lo % 16, lo - lo % 16 + 16 from e where lo - lo % 16 + 16 <= t""")
def blocks_to_reword(spark, sf_dir):
    """Pairs of an older wording or of none, and what is built on them up to the first hole."""
    n = table(spark, sf_dir, "orders").count()
    made = None
    for size in (2, 4, 8, 16):
        lo, old = C("id") * size, F.when(C("id") % 10 == 0, "old").when(C("id") % 10 != 5, memory_tree.WORDING)
        level = spark.range(n // size).where("true" if size != 8 else "id % 3 <> 1").select(memory_tree.block_id(lo, lo + size).alias("block"), F.lit("x").alias("text"), (old if size == 2 else F.lit(memory_tree.WORDING)).alias("wording"))
        made = level if made is None else made.unionByName(level)
    return memory_tree.to_reword(made, n)


@query("select o_orderkey::varchar \"key\", o_orderstatus || chr(9) || o_custkey \"value\" from orders")
def tsv_manifest(spark, sf_dir):
    """A manifest of all orders as lines of text, written and read back; values hold tabs."""
    from tarn.sources.shared import fresh_folder

    at = fresh_folder(spark, "manifest")
    ingest.write_tsv_manifest(table(spark, sf_dir, "orders").select(said(C("o_orderkey")).alias("key"), said(C("o_orderstatus"), "\t", C("o_custkey")).alias("value")), at)
    return ingest.read_tsv_manifest(spark, at)
