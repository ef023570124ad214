"""Named queries over the standard tables, each with its SQL twin.

The tables hold no times, tools or files of their own, so several queries derive them by plain rules (a time
from conv_id and turn, a second copy of every seventh conversation), the same in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn import model as M
from tarn.functions import text as T
from tarn.operators import conversation, diagnostics, ingest, memory_tree, peers, project, readers
from tarn.plans.ontology import Ontology
from tarn.plans.sparql import Store
from tarn.sources import export, step_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# conversations as events, in Spark and in SQL
TS = "date_format(timestampadd(SECOND, cast(conv_id * 600 + turn * 30 as int), timestamp_ntz'2026-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
TS_SQL = "strftime(timestamp '2026-01-01' + to_seconds(conv_id * 600 + turn * 30), '%Y-%m-%dT%H:%M:%SZ')"
MODEL = "case when role = 'assistant' then concat('model-', conv_id % 3) end"
BASE, V = M.BASE, M.V("")
TURN, GRAPH = f"{BASE}graph/Turn/", f"{BASE}graph/NamedGraph/"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = step_log.spine(c, "conv_id", "turn")
    ident = lambda x: F.concat_ws(":", F.col("conv_id").cast("string"), x.cast("string"))
    return e.select(
        F.lit("session").alias("source"), F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("pos"), ident(F.col("turn")).alias("event_id"),
        F.when(F.col("parent").isNotNull(), ident(F.col("parent"))).alias("parent_id"), "role", F.expr(TS).alias("timestamp"), "text", F.expr(MODEL).alias("model"), F.lit(None).cast("string").alias("model_setting"),
    )


E_SQL = f"e as (select conv_id, turn, conv_id || ':' || turn id, case when lag(turn) over w + 1 = turn then conv_id || ':' || (turn - 1) end parent, role, {TS_SQL} ts, text, {MODEL} model from conversations window w as (partition by conv_id order by turn))"
Q_SQL = E_SQL + ",\nq as (" + " union all ".join(
    f"select '{GRAPH}' || conv_id g, '{TURN}' || id s, '{p}' p, {o} o from e where {o} is not null"
    for p, o in [(M.TYPE, f"'{V}Turn'"), (V + "turnId", "id"), (V + "role", "role"), (V + "parentTurn", f"'{TURN}' || parent"), (V + "timestamp", "ts"), (V + "text", "text"), (V + "model", "model")]
) + ")"


def turn_quad_table(spark, sf_dir) -> DataFrame:
    return project.turns(events(spark, sf_dir))


def filed(q: DataFrame) -> Store:
    """A store over quads that are projected once, into a quad table of their own: patterns read its columns, not the projection."""
    from tarn.sources.shared import fresh_folder

    t = ingest.QuadTable(q.sparkSession, fresh_folder(q.sparkSession, "filed"), 4)
    t.create(q)
    return Store(t.quads(), buckets=4)


def store(spark, sf_dir, **options) -> Store:
    return Store(turn_quad_table(spark, sf_dir), **options)


# sources and order
@query("select conv_id, turn, case when lag(turn) over w + 1 = turn then lag(turn) over w end parent from conversations where turn % 5 <> 3 window w as (partition by conv_id order by turn)")
def turn_spine_gaps(spark, sf_dir):
    return step_log.spine(table(spark, sf_dir, "conversations").where("turn % 5 <> 3").select("conv_id", "turn"), "conv_id", "turn")


@query("with t as (select conv_id, turn from conversations where turn % 5 <> 3 and turn % 4 <> 1), r as (select conv_id, unnest(generate_series(min(turn), max(turn))) missing from t group by conv_id) select r.* from r anti join t on t.conv_id = r.conv_id and t.turn = r.missing")
def gap_list(spark, sf_dir):
    return step_log.gaps(table(spark, sf_dir, "conversations").where("turn % 5 <> 3 and turn % 4 <> 1"), "conv_id", "turn")


# a purchase leaves a hole after it, so that not every next event is the next step
STEPS = "select event_id, user_id, event_type, row_number() over w + coalesce(sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as step from events window w as (partition by user_id order by ts, event_id)"


@query(f"with s as ({STEPS}), n as (select *, lead(step) over w nx, lead(event_type) over w nt from s window w as (partition by user_id order by step)) select user_id, event_type as name, step::bigint at_step, case when nx = step + 1 and nt = 'view' then nx::bigint end result_step from n where event_type in ('click', 'signup')")
def call_result_links(spark, sf_dir):
    """Clicks and sign-ups as steps with one call each, views as steps with a tool's output; the log reader links them."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    holes = F.coalesce(F.sum((F.col("event_type") == "purchase").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = table(spark, sf_dir, "events").withColumn("step", F.row_number().over(w) + holes)
    calls = F.when(F.col("event_type").isin("click", "signup"), F.array(F.struct(F.col("event_type").alias("name"))))
    kind = F.when(F.col("event_type") == "view", "RUN_COMMAND").otherwise("OTHER")
    lines = e.select(F.col("user_id").cast("string").alias("conv_id"), F.to_json(F.struct(F.col("step").alias("step_index"), kind.alias("type"), calls.alias("tool_calls"))).alias("value"))
    return step_log.call_links(lines).select(F.col("conv_id").cast("bigint").alias("user_id"), "name", "at_step", "result_step")


@query("with k as (select o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '|' || lpad((o_orderkey % 50)::varchar, 6, '0') v from orders) select o_custkey, arg_min(o_orderkey, o_orderkey) o_orderkey, v version_key from k where (o_custkey, v) in (select (o_custkey, max(v)) from k group by o_custkey) group by o_custkey, v")
def version_pick(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", export.version_key(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 50).alias("version_key"))
    return export.newest(o, "o_custkey", "version_key", "o_orderkey")


# ingest
COPIES = "select *, 0 depth, 'a' path from conversations union all select *, 1, 'b' from conversations where conv_id % 7 = 0"


@query(f"with c as ({COPIES}) select conv_id, turn, depth, path from c qualify row_number() over (partition by conv_id, turn order by depth, path) = 1")
def ownership_dedupe(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    both = c.withColumns({"depth": F.lit(0), "path": F.lit("a")}).unionByName(c.where("conv_id % 7 = 0").withColumns({"depth": F.lit(1), "path": F.lit("b")}))
    return ingest.owned(both.withColumn("id", F.concat_ws(":", "conv_id", "turn")), "id", F.col("depth"), F.col("path")).select("conv_id", "turn", "depth", "path")


@query("select '2026-01-0' || (doc_id % 9 + 1) || '-d' || doc_id as name from documents where doc_id % 3 <> 0 or left(text, 40) = text or text is null and false")
def superseded_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    live = d.select(F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").alias("content"))
    cut = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 1, 40), F.when(F.length("text") > 40, "\u0001").otherwise(""))).otherwise(F.substring("text", 1, 40))
    dated = d.select(F.concat(F.lit("2026-01-0"), F.col("doc_id") % 9 + 1, F.lit("-d"), "doc_id").alias("name"), cut.alias("content"))
    return ingest.superseded(live.unionByName(dated)).select("name")


@query("with m as (select doc_id, sha256(case when doc_id % 5 = 0 then text || '!' else text end) h from documents where doc_id % 4 <> 1), c as (select doc_id, sha256(text) h from documents) select c.* from c anti join m using (doc_id, h)")
def manifest_delta(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    now = d.select("doc_id", F.sha2("text", 256).alias("h"))
    old = d.where("doc_id % 4 <> 1").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"), F.lit(ingest.PROJECTION).alias("projection_version"))
    return ingest.changed(now, old, "doc_id", "h")


MIRROR = "case when a = b then 'current' when age <= 1800 and lag > 259200 then 'growing-long' when age <= 1800 then 'growing' when b is null then 'missing' else 'stale' end"


@query(f"with f as (select o_orderkey, o_orderkey % 100 a, case when o_orderkey % 11 <> 0 then o_orderkey % 90 end b, (o_orderkey * 37) % 4000 age, case when o_orderkey % 13 <> 0 then (o_orderkey * 91) % 500000 end lag from orders) select o_orderkey, {MIRROR} state from f")
def mirror_classify(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, ingest.mirror_state(k % 100, F.when(k % 11 != 0, k % 90), (k * 37) % 4000, F.when(k % 13 != 0, (k * 91) % 500000)).alias("state"))


@query(f"with {Q_SQL} select g, count(*) n from (select distinct * from q) group by g")
def graph_replace_idempotent(spark, sf_dir):
    q = turn_quad_table(spark, sf_dir)
    again = ingest.replace_graphs(q, project.turns(events(spark, sf_dir).where("cast(conv_id as bigint) % 2 = 0")))
    return again.groupBy("g").agg(F.count("*").alias("n"))


# projection
@query(f"with {Q_SQL} select * from q")
def turn_quads(spark, sf_dir):
    return turn_quad_table(spark, sf_dir).select("g", "s", "p", "o")


def label_findings(spark, sf_dir) -> DataFrame:
    made = readers.signal(quality=readers.int_leg(F.col("quality")), toxic=readers.text_leg(F.col("toxic")))
    return table(spark, sf_dir, "labels").select(F.lit("labels").alias("reader"), F.lit("label/doc").alias("event_type"), F.lit(None).cast("string").alias("ts"), F.concat(F.lit("d"), "doc_id").alias("event_id"), F.lit(0).cast("long").alias("start"), (F.col("doc_id") % 300).alias("end"), F.lit("authored").alias("source_kind"), made.alias("signal"), F.lit("labels").alias("conv_id"))


LE = "list_aggregate(list_transform(generate_series(0, 7), lambda i: substr(lpad(printf('%x', {0}), 16, '0'), 15 - 2 * i, 2)), 'string_agg', '')"


def _hash_sql(start: str, end: str, ident: str, legs: str) -> str:
    h = lambda s: f"hex(encode({s}))"
    return f"substr(sha256(unhex({h(chr(39) + 'labels' + chr(39))} || '00' || {h(chr(39) + 'labels' + chr(39))} || '00' || {h(chr(39) + 'label/doc' + chr(39))} || '00' || {h(ident)} || '00' || {LE.format(start)} || {LE.format(end)} || '00' || {h(chr(39) + 'authored' + chr(39))} || {legs})), 1, 16)"


LEGS_SQL = "'00' || hex(encode('quality')) || '01' || '01' || hex(encode(quality::varchar)) || '00' || hex(encode('toxic')) || '01' || '00' || hex(encode(toxic::varchar))"
LABEL_SQL = f"l as (select doc_id, quality, toxic, 'd' || doc_id id, {_hash_sql('0', 'doc_id % 300', chr(39) + 'd' + chr(39) + ' || doc_id', LEGS_SQL)} h from labels)"


@query(f"with {LABEL_SQL} select id event_id, h hash, 'm' || substr(sha256(unhex(hex(encode(id)) || '00' || hex(encode(h)))), 1, 15) note from l")
def finding_hash(spark, sf_dir):
    a = label_findings(spark, sf_dir)
    h = project.finding_hash(F.col("conv_id"), {c: F.col(c) for c in ("reader", "event_type", "event_id", "start", "end", "source_kind", "signal")})
    return a.select("event_id", h.alias("hash")).withColumn("note", project.note_id(F.col("event_id"), F.col("hash")))


@query(f"""with {LABEL_SQL} select '{BASE}Annotation/' || h || '/body' s, '{V}sig_quality' p, quality::varchar o, '{M.INTEGER}' dt from l union all select '{BASE}Annotation/' || h || '/body', '{V}sig_toxic', toxic::varchar, '{M.STRING}' from l
union all select '{BASE}Annotation/' || h || '/selector', '{M.OA}end', (doc_id % 300)::varchar, '{M.INTEGER}' from l union all select '{BASE}Annotation/' || h, '{V}textOrigin', 'authored', '{M.STRING}' from l""")
def annotation_quads(spark, sf_dir):
    q = project.findings(label_findings(spark, sf_dir))
    return q.where(F.col("p").startswith(M.V("sig_")) | F.col("p").isin(M.OA + "end", M.V("textOrigin"))).select("s", "p", "o", "dt")


@query("select doc_id, regexp_matches(source || ':' || doc_id, '^[A-Za-z0-9_.:-]+$') valid, regexp_replace(source || ':' || lang || '/' || doc_id, '[^A-Za-z0-9_-]', '_', 'g') mangled from documents")
def id_validation(spark, sf_dir):
    ident = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", ident.rlike(M.ID_CHARS).alias("valid"), M.mangled(F.concat("source", F.lit(":"), "lang", F.lit("/"), F.col("doc_id").cast("string"))).alias("mangled"))


@query("""with p as (select conv_id, turn, text t, 'ré∠ ' || role q from conversations) select conv_id, turn, strlen(t)::bigint a_end, (strlen(t) + 1)::bigint b_start, (strlen(t) + 1 + strlen(q))::bigint b_end, t || chr(10) || q full_text, t own, q quoted from p""")
def authored_spans(spark, sf_dir):
    from tarn.sources import blocks

    pieces = F.array(blocks.piece("authored", F.col("text")), blocks.piece("tool_result", F.concat(F.lit("ré∠ "), "role"))).cast(blocks.PIECES)
    j = table(spark, sf_dir, "conversations").withColumn("j", blocks.joined(pieces))
    s = lambda i: F.get(F.col("j.spans"), F.lit(i))
    return j.select("conv_id", "turn", s(0)["end"].alias("a_end"), s(1)["start"].alias("b_start"), s(1)["end"].alias("b_end"), F.col("j.text").alias("full_text"), T.authored(F.col("j.text"), F.col("j.spans")).alias("own"), T.byte_slice(F.col("j.text"), s(1)["start"], s(1)["end"]).alias("quoted"))


# readers
@query("""select conv_id || ':' || turn event_id, strlen(text) + 1 as "start", strlen(text) + 1 + strlen('[ME|' || role || '∠1]~[content| c' || turn || ' ] ~ [You|é]') as "end", role || '∠1' me, 'c' || turn content, 'é' you from conversations where turn % 2 = 0""")
def emojikey_harvest(spark, sf_dir):
    key = F.concat(F.lit(" [ME|"), "role", F.lit("∠1]~[content| c"), F.col("pos").cast("string"), F.lit(" ] ~ [You|é]"))
    e = events(spark, sf_dir).withColumn("text", F.when(F.col("pos") % 2 == 0, F.concat("text", key, F.lit(" [ME|x]~[YOU|y]"))).otherwise(F.col("text"))).withColumn("text_provenance", F.array().cast(f"array<{M.SPAN}>"))
    a = readers.EmojiKeys().read(e)
    return a.select("event_id", "start", "end", *(F.col("signal")[k]["lex"].alias(k) for k in ("me", "content", "you")))


@query(f"""with c as (select conv_id, turn, role, case when turn % 2 = 0 then text || ' why? how?' else text || ' `code`' end t, case when turn % 4 <> 1 then conv_id * 600 + turn * 30 end as secs from conversations),
k as (select *, len(regexp_extract_all(t, '[^\\s]+')) words, length(t) chars, len(regexp_extract_all(t, '\\?')) qs, len(regexp_extract_all(t, '[.!?]+')) ends from c)
select conv_id, turn seq, words::bigint words, chars::bigint chars, round(least(1.0, qs / greatest(1, ends)::double), 2) question_density, (turn % 2 = 1) has_code,
(secs - last_value(secs ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))::double latency_s, coalesce(role <> lag(role) over (partition by conv_id order by turn), false) voice_switch from k""")
def cadence_turns(spark, sf_dir):
    e = events(spark, sf_dir)
    r = e.select("conv_id", F.col("pos").alias("seq"), F.col("role").alias("voice"), F.concat("text", F.when(F.col("pos") % 2 == 0, " why? how?").otherwise(" `code`")).alias("text"), F.when(F.col("pos") % 4 != 1, F.col("timestamp")).alias("ts"))
    f = readers.Cadence().facts(r)
    return f.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "words", "chars", F.round(T.question_density(F.col("text")), 2).alias("question_density"), (F.col("code_ratio") > 0).alias("has_code"), "latency_s", "voice_switch")


# asking
def answers(s: Store, text: str, ints: tuple = ()) -> DataFrame:
    r = s.query(text).plain()
    return r.select(*(F.col(c).cast("bigint").alias(c) if c in ints else F.col(c) for c in r.columns))


@query(f"with {LABEL_SQL} select '{TURN}' || id turn, 'label/doc' kind, quality::bigint q from l")
def claim_roundtrip(spark, sf_dir):
    s = filed(project.findings(label_findings(spark, sf_dir)))
    return answers(s, "SELECT ?turn ?kind ?q { GRAPH ?g { ?c rdf:reifies <<( ?turn :exhibits ?kind )>> ; prov:wasDerivedFrom ?a . ?a oa:hasBody ?b . ?b :sig_quality ?q } }", ("q",))


@query("with l as (select doc_id, quality from labels), n as (select doc_id, n_chars from documents) select 'd' || doc_id turn, quality::bigint a, n_chars::bigint b from l join n using (doc_id)")
def cross_reader_join(spark, sf_dir):
    sized = table(spark, sf_dir, "documents")
    other = sized.select(F.lit("sizes").alias("reader"), F.lit("size/doc").alias("event_type"), F.lit(None).cast("string").alias("ts"), F.concat(F.lit("d"), "doc_id").alias("event_id"), F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), F.lit("authored").alias("source_kind"), readers.signal(size=readers.int_leg(F.col("n_chars"))).alias("signal"), F.lit("labels").alias("conv_id"))
    s = filed(project.findings(label_findings(spark, sf_dir).unionByName(other)))
    r = answers(s, "SELECT ?t ?a ?b { GRAPH ?g { ?x prov:used ?t ; oa:hasBody ?p . ?p :sig_quality ?a . ?y prov:used ?t ; oa:hasBody ?r . ?r :sig_size ?b } }", ("a", "b"))
    return r.select(F.regexp_replace("t", "^.*/Turn/", "").alias("turn"), "a", "b")


@query(f"with {LABEL_SQL} select 'd' || doc_id turn, (doc_id % 300)::bigint n from l where doc_id % 300 > 37")
def numeric_leg_filter(spark, sf_dir):
    s = filed(project.findings(label_findings(spark, sf_dir)))
    r = answers(s, "SELECT ?t ?n { GRAPH ?g { ?a prov:used ?t ; oa:hasTarget ?x . ?x oa:hasSelector ?y . ?y oa:end ?n } FILTER(?n > 37) }", ("n",))
    return r.select(F.regexp_replace("t", "^.*/Turn/", "").alias("turn"), "n")


@query(f"with {Q_SQL} select count(*) quads, count(distinct g) graphs, count(distinct s) subjects, count(distinct case when starts_with(s, '{TURN}') then s end) turns, count(distinct case when p = '{V}timestamp' then s end) dated, min(case when p = '{V}timestamp' then o end) earliest, max(case when p = '{V}timestamp' then o end) latest, 0::bigint claims from q")
def store_stats(spark, sf_dir):
    return diagnostics.store_stats(turn_quad_table(spark, sf_dir), TURN)


@query(f"with {Q_SQL} select p, count(*) n from q group by p order by n desc, p limit 20")
def top_predicates(spark, sf_dir):
    return diagnostics.top_predicates(turn_quad_table(spark, sf_dir))


@query(f"with {E_SQL}, c as (select id, role, 'a' g from e union all select id, role, 'b' from e where conv_id % 7 = 0) select count(distinct id) in_union, count(*) in_named from c")
def union_vs_named_count(spark, sf_dir):
    q = turn_quad_table(spark, sf_dir)
    both = q.unionByName(q.where(F.regexp_extract("g", r"(\d+)$", 1).cast("long") % 7 == 0).withColumn("g", F.concat("g", F.lit("-copy"))))
    s = Store(both)
    one = answers(s, "SELECT (COUNT(?t) AS ?in_union) { ?t :role ?r }", ("in_union",))
    two = answers(s, "SELECT (COUNT(?t) AS ?in_named) { GRAPH ?g { ?t :role ?r } }", ("in_named",))
    return one.withColumn("_k", F.lit(1)).join(two.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("select role, count(*) turns from conversations group by role")
def role_counts(spark, sf_dir):
    return answers(store(spark, sf_dir), "SELECT ?role (COUNT(?t) AS ?turns) { GRAPH ?g { ?t a :Turn ; :role ?role } } GROUP BY ?role", ("turns",))


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) n from orders group by all")
def month_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), 1, 7).alias("month")).agg(F.count("*").alias("n"))


@query("select lang, count(*) n, min(doc_id) first_doc, max(doc_id) last_doc from documents where contains(lower(text), 'the') and regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') group by lang")
def recall_term(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.names_term(F.col("text"), "the")).groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query(f"with {E_SQL} select '{TURN}' || id t, role, model from e")
def optional_body(spark, sf_dir):
    return answers(store(spark, sf_dir), "SELECT ?t ?role ?model { GRAPH ?g { ?t :role ?role OPTIONAL { ?t :model ?model } } }")


@query(f"with {E_SQL} select '{TURN}' || id t from e where parent is null")
def not_exists_dangling(spark, sf_dir):
    return answers(store(spark, sf_dir), "SELECT ?t { GRAPH ?g { ?t :turnId ?i FILTER NOT EXISTS { ?t :parentTurn ?p } } }")


@query(f"with {E_SQL} select '{TURN}' || id t, role from e where id in ('1:0', '2:1', '5:2', '9:9')")
def values_semi(spark, sf_dir):
    return answers(store(spark, sf_dir), 'SELECT ?t ?role { VALUES ?i { "1:0" "2:1" "5:2" "9:9" } GRAPH ?g { ?t :turnId ?i ; :role ?role } }')


@query(f"with {E_SQL}, u as (select model m, ts from e where model is not null union all select role, ts from e) select m, count(*) n, min(ts) first_ts, max(ts) last_ts from u group by m")
def union_model_timeline(spark, sf_dir):
    return answers(store(spark, sf_dir), "SELECT ?m (COUNT(?t) AS ?n) (MIN(STR(?ts)) AS ?first_ts) (MAX(STR(?ts)) AS ?last_ts) { GRAPH ?g { ?t :timestamp ?ts { ?t :model ?m } UNION { ?t :role ?m } } } GROUP BY ?m", ("n",))


def geo(spark, sf_dir) -> DataFrame:
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    node = lambda kind, c: F.concat(F.lit(f"{BASE}graph/{kind}/"), F.col(c).cast("string"))
    g = F.lit(GRAPH + "geo")
    iri, lit = project.iri, project.lit
    cls = lambda x: iri(F.lit(M.V(x)))
    return (
        project.quads(r, g, [(node("Region", "r_regionkey"), M.TYPE, cls("Region")), (node("Region", "r_regionkey"), M.V("name"), lit(F.col("r_name")))])
        .unionByName(project.quads(n, g, [(node("Nation", "n_nationkey"), M.TYPE, cls("Nation")), (node("Nation", "n_nationkey"), M.V("name"), lit(F.col("n_name"))), (node("Nation", "n_nationkey"), M.V("in"), iri(node("Region", "n_regionkey")))]))
        .unionByName(project.quads(s, g, [(node("Supplier", "s_suppkey"), M.TYPE, cls("Supplier")), (node("Supplier", "s_suppkey"), M.V("in"), iri(node("Nation", "s_nationkey"))), (node("Supplier", "s_suppkey"), M.V("balance"), lit(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), M.DECIMAL))]))
    )


@query("select n_name name from nation where n_regionkey <> 1 union all select r_name from region")
def minus_shared_only(spark, sf_dir):
    return answers(Store(geo(spark, sf_dir)), "SELECT ?name { GRAPH ?g { ?x :name ?name MINUS { ?x :in <graph/Region/1> } MINUS { ?other a :Region } } }")


@query(f"select conv_id || ':' || a.turn a, conv_id || ':' || b.turn b from conversations a join conversations b using (conv_id) where b.turn < a.turn")
def path_closure(spark, sf_dir):
    """Every turn with all turns before it, of all conversations."""
    r = answers(store(spark, sf_dir), "SELECT ?a ?b { ?a :parentTurn+ ?b }")
    cut = lambda c: F.regexp_replace(c, "^.*/Turn/", "").alias(c)
    return r.select(cut("a"), cut("b"))


GEO_AXIOMS = [(M.V("Nation"), M.RDFS + "subClassOf", BASE + "base/Place"), (M.V("Region"), M.RDFS + "subClassOf", BASE + "base/Place"), (M.V("in"), M.OWL + "equivalentProperty", BASE + "base/within")]


@query("select 'Nation/' || n_nationkey x from nation union all select 'Region/' || r_regionkey from region")
def class_closure(spark, sf_dir):
    r = answers(Store(geo(spark, sf_dir), Ontology(GEO_AXIOMS)), "SELECT ?x { ?x a base:Place }")
    return r.select(F.regexp_replace("x", "^.*/graph/", "").alias("x"))


@query("select r_name region, count(*) suppliers, round(sum(s_acctbal::decimal(18,2)), 2)::double balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_acctbal > 0 group by r_name having count(*) > 1")
def path_sequence_totals(spark, sf_dir):
    r = answers(Store(geo(spark, sf_dir), Ontology(GEO_AXIOMS)), "SELECT ?region (COUNT(?s) AS ?suppliers) (SUM(?b) AS ?balance) { ?s a :Supplier ; :balance ?b ; base:within/base:within ?r . ?r :name ?region FILTER(?b > 0) } GROUP BY ?region HAVING (COUNT(?s) > 1)", ("suppliers",))
    return r.withColumn("balance", F.round(F.col("balance").cast("double"), 2))


# joins in time
def sent(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("at", F.expr("bigint(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"))
    body = F.concat(F.lit("message number "), (F.col("event_id") % 40).cast("string"), F.lit(" of the long kind that peers send"))
    turns = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("receiver"), F.col("at").alias("ts"), F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("first my own words, then "), body)).otherwise(body).alias("text"))
    sends = e.where("event_id % 2 = 1").select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("sender"), F.col("at").alias("rts"), F.col("event_id").alias("ord"), T.flat(F.concat(F.lit("message number "), ((F.col("event_id") + 1) % 40).cast("string"), F.lit(" of the long kind that peers send"))).alias("flat"), (F.col("event_type") == "click").alias("spawn"))
    return turns, sends


SENT_SQL = """e as (select *, datediff('second', timestamp '1970-01-01', date_trunc('second', ts)) as secs from events),
t as (select event_id id, 'u' || (user_id % 50) receiver, secs ts, replace(case when event_id % 6 = 0 then 'first my own words, then ' else '' end || 'message number ' || (event_id % 40) || ' of the long kind that peers send', ' ', '') a from e where event_id % 2 = 0),
s as (select 'u' || (user_id % 50) sender, secs rts, event_id ord, replace('message number ' || ((event_id + 1) % 40) || ' of the long kind that peers send', ' ', '') flat, event_type = 'click' spawn from e where event_id % 2 = 1)"""


@query(f"""with {SENT_SQL}, h as (select id, sender, rts, ord, case when contains(flat, left(a, 120)) then 1 when contains(a, left(flat, 120)) then 2 end tier, case when contains(flat, left(a, 120)) then case when contains(flat, a) then 'whole' else 'leading' end when instr(a, left(flat, 120)) > 1 then 'embedded' else case when contains(flat, a) then 'whole' else 'leading' end end kind from t join s on rts between ts - 1800 and ts + 60 and sender <> receiver and not spawn)
select id, kind, sender peer from h where tier is not null qualify row_number() over (partition by id order by tier, rts desc, ord desc) = 1""")
def peer_interval_match(spark, sf_dir):
    turns, sends = sent(spark, sf_dir)
    return peers.senders(turns, sends)


@query(f"with {SENT_SQL} select distinct id from t join s on rts between ts - 600 and ts + 60 and sender = receiver and spawn and contains(flat, left(a, 120))")
def spawn_detect(spark, sf_dir):
    turns, sends = sent(spark, sf_dir)
    return peers.spawned(turns.withColumnRenamed("receiver", "me"), sends)


@query("""with w as (select user_id, ts rts, event_id ord, value from events where event_type = 'purchase'), r as (select event_id, user_id, ts from events where event_type = 'view')
select event_id, user_id, (select value from w where w.user_id = r.user_id and w.rts <= r.ts order by rts desc, ord desc limit 1) as value from r""")
def asof_write(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("ord"), "value")
    return peers.as_of(left, right, "user_id", "value").select("event_id", "user_id", "value")


# ordered logs
@query(f"""with {E_SQL}, c as (select 0 src, * from e union all select 1, * from e where conv_id % 7 = 0), f as (select id, ts from c where trim(text) <> '' qualify row_number() over (partition by id order by src) = 1)
select id, ts, row_number() over (order by ts, id) n from f""")
def stream_order(spark, sf_dir):
    e = events(spark, sf_dir).withColumnsRenamed({"event_id": "id", "timestamp": "ts"})
    both = e.unionByName(e.where("cast(conv_id as bigint) % 7 = 0").withColumn("source", F.lit("steps")))
    # a rank over the whole order: range-partitioned counts, then ranks inside, so that no task holds all rows
    return ranked(conversation.stream(both).select("id", "ts"), ["ts", "id"])


def ranked(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Adds a dense place from 1 in the order, by hours of the sort key: counts before each hour, then places inside it."""
    hour = df.withColumn("_h", F.substring(order[0], 1, 13))
    counts = hour.groupBy("_h").agg(F.count("*").alias("_k"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_k").over(W.orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    inside = F.row_number().over(W.partitionBy("_h").orderBy(*order))
    return hour.join(before, "_h").withColumn(name, inside + F.col("_before")).drop("_h", "_before")


#: Bytes of a clipped text: 3,000 from its start and 1,000 from its end, less what would cut a character, and the mark between them.
_CONT = "(substr(hex(encode(text)), 2 * ({}) - 1, 2) between '80' and 'BF')"
_HEAD = f"case when not {_CONT.format(3001)} then 3000 when not {_CONT.format(3000)} then 2999 when not {_CONT.format(2999)} then 2998 else 2997 end"
_TAIL = "case " + " ".join(f"when not {_CONT.format(f'strlen(text) - 1000 + {k + 1}')} then {1000 - k}" for k in range(3)) + " else 997 end"
CLIP_SQL = f"case when strlen(text) <= 4000 then strlen(text) else {_HEAD} + strlen(' […] ') + {_TAIL} end"


@query(f"""with recursive d as (select lang, doc_id, {CLIP_SQL} n, row_number() over (partition by lang order by doc_id) r from documents where text is not null),
s as (select lang, doc_id, r, n full_size, 0 stretch from d where r = 1 union all select d.lang, d.doc_id, d.r, case when s.full_size + d.n > 24000 then d.n else s.full_size + d.n end, case when s.full_size + d.n > 24000 then s.stretch + 1 else s.stretch end from s join d on d.lang = s.lang and d.r = s.r + 1)
select lang, doc_id, stretch from s""")
def stretches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("lang", "doc_id", T.clipped_bytes(F.col("text")).alias("n"))
    return conversation.stretches(d, F.col("n"), "lang", ["doc_id"]).select("lang", "doc_id", "stretch")


@query("""with t as (select conv_id, turn, role, case when role = 'assistant' and turn % 4 = 1 then '[ran: x' || turn || ']' else text end text from conversations), m as (select *, role = 'assistant' and starts_with(text, '[ran:') act from t),
w as (select *, last_value(case when not act then role end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) br, last_value(case when not act then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) bp,
first_value(case when not act then role end ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following) ar, first_value(case when not act then turn end ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following) ap from m),
g as (select *, case when br = 'assistant' then bp when ar = 'assistant' then ap end goal from w)
select x.conv_id, x.turn, coalesce((select string_agg(text, chr(10) order by turn) from g where g.conv_id = x.conv_id and act and goal = x.turn and g.turn < x.turn) || chr(10), '') || x.text || coalesce(chr(10) || (select string_agg(text, chr(10) order by turn) from g where g.conv_id = x.conv_id and act and goal = x.turn and g.turn > x.turn), '') as text from g x where not act""")
def fold_actions(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.concat(F.lit("[ran: x"), "turn", F.lit("]"))).otherwise(F.col("text")).alias("text"))
    return conversation.fold_actions(t, "conv_id", "turn").select("conv_id", "turn", "text")


# memory: orders as a log of notes, by place
def log_size(spark, sf_dir) -> int:
    return table(spark, sf_dir, "orders").count()


def built_blocks(spark, sf_dir) -> DataFrame:
    """Blocks built so far: all of size 2 but one in fifty from the hundredth on, and all of size 4 below 400."""
    k = spark.range(log_size(spark, sf_dir)).select(F.col("id").alias("k"))
    two = k.where("k * 2 + 2 <= %d and not (k >= 100 and k %% 50 = 7)" % log_size(spark, sf_dir)).select((F.col("k") * 2).alias("lo"), (F.col("k") * 2 + 2).alias("hi"))
    four = k.where("k * 4 + 4 <= 400").select((F.col("k") * 4).alias("lo"), (F.col("k") * 4 + 4).alias("hi"))
    return two.unionByName(four)


BUILT_SQL = "t as (select count(*) t from orders), k as (select unnest(generate_series(0, t)) k, t from t), built as (select 2 size, k from k where k * 2 + 2 <= t and not (k >= 100 and k % 50 = 7) union all select 4, k from k where k * 4 + 4 <= 400)"


@query(f"""with {BUILT_SQL}, have as (select size, count(*) filter (r = k) have from (select *, row_number() over (partition by size order by k) - 1 r from built) group by size),
sizes as (select unnest(list_transform(generate_series(1, 40), lambda i: 1::bigint << i)) size) select (k * size)::bigint lo, ((k + 1) * size)::bigint hi from (select size, unnest(generate_series(coalesce(have, 0), t // size - 1)) k from sizes left join have using (size), t where size <= t)""")
def pending_blocks(spark, sf_dir):
    return memory_tree.pending(spark, log_size(spark, sf_dir), built_blocks(spark, sf_dir))


@query("""with recursive t as (select count(*) t, (1::bigint << ceil(log2(count(*)))::int) root from orders), c as (select 0::bigint lo, root hi, t from t union all
select unnest([lo, (lo + hi) // 2]), unnest([(lo + hi) // 2, hi]), t from c where lo < t and hi - lo > 1 and (hi > t or (hi - lo)::double > 0.25::double * (t - lo)::double))
select lo, hi from c where lo < t and not (hi - lo > 1 and (hi > t or (hi - lo)::double > 0.25::double * (t - lo)::double))""")
def wake_cover(spark, sf_dir):
    return spark.createDataFrame(memory_tree.split_cover(log_size(spark, sf_dir), 0.25), "lo bigint, hi bigint")


@query()
def wake_cover_budget(spark, sf_dir):
    """The full halving of alpha under a budget; tested by its properties."""
    return memory_tree.cover_frame(spark, log_size(spark, sf_dir), 96)


@query("with t as (select count(*) t from orders), b as (select k * 8 lo, k * 8 + 8 hi, t from (select unnest(generate_series(0, t // 8)) k, t from t)), h as (select lo, hi, 0 half, lo a, (lo + hi) // 2 b from b union all select lo, hi, 1, (lo + hi) // 2, least(hi, t) from b) select * from h where a < b")
def block_zoom(spark, sf_dir):
    t = log_size(spark, sf_dir)
    return memory_tree.zoom(spark.range(t // 8 + 1).select((F.col("id") * 8).alias("lo"), (F.col("id") * 8 + 8).alias("hi")), t)


@query("with t as (select count(*) t from orders), b as (select k * 2 lo, k * 2 + 2 hi, t from (select unnest(generate_series(0, t // 2 - 1)) k, t from t)), n as (select unnest(list_transform(generate_series(2, 40), lambda i: 1::bigint << i)) n) select lo::bigint lo, hi::bigint hi, (lo - lo % n)::bigint up_lo, (lo - lo % n + n)::bigint up_hi from b, n where lo - lo % n + n <= t")
def merge_ancestors(spark, sf_dir):
    t = log_size(spark, sf_dir)
    return memory_tree.ancestors(spark.range(t // 2).select((F.col("id") * 2).alias("lo"), (F.col("id") * 2 + 2).alias("hi")), t)


NOTE_SQL = "n as (select o_orderkey pos, 'm' || o_orderkey id, strftime(o_orderdate, '%Y-%m-%d') ts from orders), b as (select (k * 2) || '-' || (k * 2 + 1) block, k * 2 lo, k * 2 + 2 hi from (select unnest(generate_series(0, (select count(*) from orders) // 2 - 1)) k))"


@query(f"""with {NOTE_SQL} select '{BASE}graph/Memory/' || id s, '{V}logStart' p, pos::varchar o from n union all select '{BASE}graph/Memory/' || block, '{V}logEnd', (hi - 1)::varchar from b union all select '{BASE}graph/Memory/' || block, '{V}memoryLevel', '1' from b
union all select '{BASE}graph/Memory/' || block, '{V}relatedToId', '{BASE}graph/Memory/' || n.id from b join n on n.pos in (lo, lo + 1) union all select '{BASE}graph/Memory/' || block, '{V}windowEnd', n.ts from b join n on n.pos = hi - 1""")
def memory_quads(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    notes = o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("m"), "o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.col("o_orderpriority").alias("text"), F.array(F.concat(F.lit("t"), "o_orderkey")).alias("turns"), F.lit("w").alias("model"))
    k = spark.range(log_size(spark, sf_dir) // 2)
    blocks = k.select(memory_tree.block_id(F.col("id") * 2, F.col("id") * 2 + 2).alias("block"), F.lit("both").alias("text"), F.lit("w").alias("model"))
    q = project.memory(notes, blocks)
    block = F.col("s").rlike(r"/\d+-\d+$")
    name = lambda p: F.col("p") == M.V(p)
    return q.where((~block & name("logStart")) | (block & (name("logEnd") | name("memoryLevel") | name("relatedToId") | name("windowEnd")))).select("s", "p", "o")


@query("select o_orderdate::date::varchar as block, arg_max(o_orderkey, o_orderkey) o_orderkey, arg_max(o_orderpriority, o_orderkey) o_orderpriority from orders group by all")
def dedupe_last_summary(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("block"), "o_orderkey", "o_orderpriority")
    return memory_tree.current(s.withColumn("at", F.col("o_orderkey")), "at").drop("at")


# continuous passes
UNREAD = "event_id % 3 <> 0"


@query(f"with u as (select user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ts, strlen(props) n from events where {UNREAD}) select user_id, count(*) turns, sum(n)::bigint bytes, min(ts) oldest from u where ts < '2026-01-01' group by user_id")
def unread_backlog(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("props").alias("text"))
    u = conversation.unread(e, e.where("id % 3 = 0"), "2026-01-01")
    return u.groupBy("user_id").agg(F.count("*").alias("turns"), F.sum(T.clipped_bytes(F.col("text"))).cast("bigint").alias("bytes"), F.min("ts").alias("oldest"))


@query("with u as (select user_id, sum(strlen(props)) * 40 b, min(ts) oldest, max(ts) newest from events group by user_id) select user_id, case when b >= 24000 then 'flush-size' when oldest < newest - interval 6 hour then 'flush-age' else 'wait' end decision from u")
def settle_flush(spark, sf_dir):
    from tarn.streaming.passes import flush_decision

    u = table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum(F.octet_length("props")) * 40).alias("b"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    return u.select("user_id", flush_decision(F.col("b"), F.col("oldest"), F.col("newest")).alias("decision"))


GATE = """with g as (select n_nationkey k, case when n_nationkey % 2 = 0 then 'POST' else 'GET' end method, ['/api/health', '/api/sync', '/api/org/st/import', '/api/org/st/query', 'api/stores/'][(n_nationkey % 5) + 1] path, n_nationkey % 4 <> 0 known, n_nationkey % 3 = 0 service, case when n_nationkey % 6 = 0 then ['read'] else ['read', 'write'] end scopes, n_nationkey % 7 = 1 is_owner, n_nationkey % 8 <> 5 has_owner, n_nationkey % 5 = 2 and n_nationkey % 2 = 0 same_soul from nation),
n as (select *, case when method = 'GET' and path in ('/api/health', 'api/stores/') then 'nothing' when method = 'POST' and path = '/api/sync' then 'owner' when method = 'POST' and path like '%/import' then 'write' else 'read' end needs from g)
select k, needs, (case needs when 'nothing' then 200 when 'read' then case when not known then 401 when service and not list_contains(scopes, 'read') then 403 else 200 end when 'write' then case when not known then 401 when service and not list_contains(scopes, 'write') then 403 when is_owner or same_soul then 200 else 403 end else case when not known then 401 when has_owner and is_owner and not service then 200 else 403 end end)::int status from n"""


@query(GATE)
def gate_table(spark, sf_dir):
    k = F.col("n_nationkey")
    paths = F.array(*map(F.lit, ["/api/health", "/api/sync", "/api/org/st/import", "/api/org/st/query", "api/stores/"]))
    needs = diagnostics.route_needs(F.when(k % 2 == 0, "POST").otherwise("GET"), F.element_at(paths, (k % 5).cast("int") + 1))
    scopes = F.when(k % 6 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("write")))
    status = diagnostics.gate(F.col("needs"), k % 4 != 0, k % 3 == 0, scopes, k % 7 == 1, k % 8 != 5, (k % 5 == 2) & (k % 2 == 0), F.lit(True), F.lit(True))
    return table(spark, sf_dir, "nation").withColumn("needs", needs).select(k.alias("k"), "needs", status.cast("int").alias("status"))


# texts
@query(r"""with t as (select doc_id, regexp_replace(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), '^ | $', '', 'g') f from documents) select doc_id, case when length(f) <= 80 then f else left(f, 80) || '…' end one_line, length(f)::bigint n from t""")
def text_normalise(spark, sf_dir):
    noted = F.concat(F.lit("<system-reminder>a\nb</system-reminder>"), "text", F.lit("\n<system-reminder>open"))
    clean = T.strip_reminders(noted)
    return table(spark, sf_dir, "documents").select("doc_id", T.one_line(clean, 80).alias("one_line"), F.length(F.regexp_replace(T.trimmed(clean), T.WHITE, " ")).cast("bigint").alias("n"))


@query(r"""select doc_id, '"' || replace(replace(replace(replace(replace(text || chr(9) || '"\', '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' as lit from documents""")
def n_triples_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"'), T.escaped(F.concat("text", F.lit('\t"\\'))), F.lit('"')).alias("lit"))


@query("""with s as (select user_id, event_id, ts, case when ts - lag(ts) over w > interval 30 minute or lag(ts) over w is null then 1 else 0 end fresh from events window w as (partition by user_id order by ts, event_id))
select user_id, n, count(*) events, min(event_id) first_event from (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint n from s) group by all""")
def user_sessions(spark, sf_dir):
    """An extra: sessions by a gap of half an hour. The graph engine itself computes no windows of time."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr("timestampdiff(MICROSECOND, _before, ts) > 1800000000 or _before is null")
    s = table(spark, sf_dir, "events").withColumn("_before", F.lag("ts").over(w)).withColumn("n", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "n").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


from tarn.plans import catalogue_logs  # noqa: E402, F401  its queries register themselves here
