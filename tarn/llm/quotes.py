"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of ``>`` before its text. Runs of lines of one level are passages; those of
level 1 and more are quotes, the rest is the message's own body. A quote is linked to the first earlier message
of its conversation that has it, after folding case and white space, as a whole body, a paragraph or a line; a quote
that isn't found whole is linked through its longest paragraph or line that is. A message replies to the latest source of
its outermost quotes. Threads follow replies to their first message; conversations ordered by (conv_id,
thread_turn, turn) have replies after what they answer, and bodies hold no quotes.

Levels and runs take time in proportion to a text, however deep or long its quotes. Empty tables give no rows; columns
of other names are kept. Null texts are empty. Rows with a null conv_id or turn are linked with nothing. Repeated rows get a row each and
count as one message. Sources come before their quotes, so replies have no cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common

PREFIX = r"^(?:\x20{0,3}>)++\x20?"  # possessive: Java then loops, where a plain repeated group recurses for each >
PARAGRAPH = r"\n[\x20\x09]*\n"
#: The line that mail programs put before a quote.
ATTRIBUTION = r"(^|\n)On [^\n]{1,200} wrote:\s*$"
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
RUNS = "array<struct<lvl:int,t:string>>"


def passages(text: Column) -> Column:
    """Runs of lines of one quote level, in order: array of (lvl, t)."""
    level = lambda x: F.regexp_count(F.regexp_extract(x, PREFIX, 0), F.lit(">")).cast("int")

    def runs(lvl: Column, body: Column) -> Column:
        opens = F.filter(F.transform(lvl, lambda x, i: F.when((i == 0) | (x != F.get(lvl, i - 1)), i)), lambda i: i.isNotNull())
        until = lambda starts, k: F.coalesce(F.get(starts, k + 1), F.size(lvl))
        one = lambda starts: F.transform(starts, lambda i, k: F.struct(F.get(lvl, i).alias("lvl"), F.array_join(F.slice(body, i + 1, until(starts, k) - i), "\n").alias("t")))
        return common.let(opens, one).cast(RUNS)

    parted = lambda lines: common.let(F.transform(lines, level), lambda lvl: common.let(F.transform(lines, lambda x: F.regexp_replace(x, PREFIX, "")), lambda body: runs(lvl, body)))
    quoting = common.let(F.split(text, r"\r?\n"), parted)
    return F.when(text.rlike(r"(?m)" + PREFIX), quoting).otherwise(F.array(F.struct(F.lit(0).alias("lvl"), text.alias("t"))).cast(RUNS))


def folded(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), r"[\x20\x09-\x0D]+", " "))


def digest(t: Column) -> Column:
    return F.conv(F.substring(F.md5(folded(t)), 1, 15), 16, 10).cast("long")


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``body``, ``quotes`` (lvl, t), n_quotes and max_level."""
    runs = messages.withColumn("_runs", passages(common.text_of("text")))
    quotes = F.filter("_runs", lambda x: (x["lvl"] > 0) & (folded(x["t"]) != ""))
    own = F.transform(F.filter("_runs", lambda x: x["lvl"] == 0), lambda x: x["t"])
    out = runs.withColumn("quotes", quotes)
    plain = F.array_join(F.transform(own, lambda t: F.regexp_replace(t, ATTRIBUTION, "")), "\n")
    body = F.when(F.size("quotes") > 0, F.regexp_replace(plain, EDGES, "")).otherwise(F.array_join(own, "\n"))
    return out.withColumns({"body": body, "n_quotes": F.size("quotes").cast("long"), "max_level": F.coalesce(F.array_max(F.transform("quotes", lambda x: x["lvl"])), F.lit(0))}).drop("_runs")


def _units(t: Column) -> Column:
    """Digests of a body: whole, its paragraphs and its lines."""
    parts = F.concat(F.array(t), F.split(t, PARAGRAPH), F.split(t, "\n"))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: folded(x) != ""), digest))


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n_linked, parent_turn) of the messages that quote. ``messages`` is a written table of parsed rows."""
    asks = messages.where((F.col("n_quotes") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    each = asks.select("conv_id", "turn", F.posexplode("quotes").alias("q", "x")).select("conv_id", "turn", "q", F.col("x.lvl").alias("lvl"), F.col("x.t").alias("t"))
    unit = lambda x, whole: F.struct(digest(x).alias("h"), F.lit(whole).alias("whole"), F.length(folded(x)).alias("n"))
    lines = F.transform(F.filter(F.concat(F.split("t", PARAGRAPH), F.split("t", "\n")), lambda x: folded(x) != ""), lambda x: unit(x, 0))
    tried = common.stored(each.select("conv_id", "turn", "q", "lvl", F.explode(F.concat(F.array(unit(F.col("t"), 1)), lines)).alias("u")).select("conv_id", "turn", "q", "lvl", "u.*").distinct(), "quoted")
    places = messages.join(tried.select("conv_id").distinct(), "conv_id", "left_semi").where(F.col("turn").isNotNull())
    origin = places.select("conv_id", "turn", F.explode(_units(F.col("body"))).alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("src"))
    found = tried.join(common.stored(origin, "origins"), ["conv_id", "h"]).where("src < turn")
    best = found.groupBy("conv_id", "turn", "q").agg(F.min("lvl").alias("lvl"), F.max(F.struct("whole", "n", F.negative("src").alias("s"))).alias("b")).select("conv_id", "turn", "q", "lvl", F.negative("b.s").alias("src"))
    # the latest source among the quotes of the least level
    top = best.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(F.struct(F.negative("lvl").alias("l"), "src")).alias("b"))
    return top.select("conv_id", "turn", "n_linked", F.col("b.src").alias("parent_turn"))


def threads(links: DataFrame) -> DataFrame:
    """Adds thread_turn and depth by following replies, twice as far each round."""
    at = common.stored(links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        joined = at.join(above, ["conv_id", "up"], "left")
        at = common.stored(joined.select("conv_id", "turn", F.coalesce("top", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("top").isNotNull().alias("moved")), "replies")
        if at.where("moved").isEmpty():
            return links.join(at.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth"), ["conv_id", "turn"])
        at = at.drop("moved")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message with its body, quote counts, parent_turn, thread_turn and depth."""
    keep = [c for c in messages.columns if c not in ("text", "quotes", "body", "n_quotes", "max_level")]
    rows = common.stored(parsed(messages).select(*keep, "body", "quotes", "n_quotes", "max_level"), "parsed")
    plain = rows.drop("quotes").withColumns({"n_linked": F.lit(0).cast("long"), "parent_turn": F.lit(None).cast("long"), "thread_turn": F.col("turn").cast("long"), "depth": F.lit(0).cast("long")})
    quoting = rows.where("n_quotes > 0")
    if quoting.isEmpty():
        return plain
    tree = common.stored(threads(common.stored(linked(rows), "links")), "threads")
    joined = quoting.drop("quotes").join(tree, ["conv_id", "turn"], "left")
    joined = joined.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)), "thread_turn": F.coalesce("thread_turn", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    return plain.where("n_quotes = 0").unionByName(joined)


def op8_quotes(spark, sf_dir: str) -> DataFrame:
    """Every message; body_sha256 stands for the body without quotes."""
    return conversations(common.table(spark, sf_dir, "conversations")).withColumn("body_sha256", F.sha2("body", 256)).drop("body")


#: Text that both languages read: two of three messages quote one or two earlier ones.
QUOTED = f"""select conv_id, turn, role, case
  when turn % 3 = 1 and a is not null then concat('On Monday, they wrote:', chr(10), '> ', replace(a, chr(10), concat(chr(10), '> ')), chr(10), chr(10), text)
  when turn % 3 = 2 and b is not null then concat('> > ', replace(b, chr(10), concat(chr(10), '> > ')), chr(10), '> ', translate(replace(a, chr(10), concat(chr(10), '> ')), '{common.LOWER}', '{common.UPPER}'), chr(10), text, chr(10), '>  a line nobody wrote ', turn)
  else text end as text
  from (select *, lag(text) over (partition by conv_id order by turn, role, text) a, lag(text, 2) over (partition by conv_id order by turn, role, text) b from {{conversations}} t) q"""


def quoted_replies(spark, sf_dir: str) -> DataFrame:
    """The operator over conversations that quote, made from the table, which holds no quotes of its own."""
    made = spark.sql(QUOTED, conversations=common.table(spark, sf_dir, "conversations"))
    return conversations(made).withColumn("body_sha256", F.sha2("body", 256)).drop("body")


_F = "trim(regexp_replace(lower({}), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
_PLAIN = PREFIX.replace("++", "+")
_H = "('0x' || substr(md5(" + _F + "), 1, 15))::bigint"
OP8_SQL = rf"""
with recursive m as (select row_number() over () rid, conv_id, turn, role, coalesce(text, '') t from conversations),
l as (select rid, i, x, regexp_extract(x, '{_PLAIN}') p from (select rid, unnest(s) x, unnest(generate_series(1, len(s))) i from (select rid, string_split_regex(t, '\r?\n') s from m))),
v as (select rid, i, length(p) - length(replace(p, '>', '')) lvl, regexp_replace(x, '{_PLAIN}', '') t from l),
b as (select *, case when lvl is distinct from lag(lvl) over (partition by rid order by i) then 1 else 0 end edge from v),
c as (select *, sum(edge) over (partition by rid order by i) r from b),
runs as (select rid, r, lvl, string_agg(t, chr(10) order by i) t from c group by rid, r, lvl),
qt as (select rid, row_number() over (partition by rid order by r) - 1 q, lvl, t from runs where lvl > 0 and {_F.format("t")} <> ''),
nq as (select rid, count(*) n_quotes, max(lvl) max_level from qt group by rid),
own as (select rid, r, t from runs where lvl = 0),
body as (select m.rid, case when n_quotes > 0 then regexp_replace(coalesce(string_agg(regexp_replace(own.t, '(^|\n)On [^\n]{{1,200}} wrote:\s*$', ''), chr(10) order by r), ''), '{EDGES}', '', 'g') else coalesce(string_agg(own.t, chr(10) order by r), '') end body from m left join own using (rid) left join nq using (rid) group by m.rid, n_quotes),
msg as (select m.rid, conv_id, turn, role, body, coalesce(n_quotes, 0) n_quotes, coalesce(max_level, 0) max_level from m join body using (rid) left join nq using (rid)),
part as (select rid, body t from msg union all select rid, unnest(string_split_regex(body, '\n[\x20\x09]*\n')) from msg union all select rid, unnest(string_split(body, chr(10))) from msg),
origin as (select conv_id, {_H.format("t")} h, min(turn) src from part join msg using (rid) where {_F.format("t")} <> '' group by all),
tried as (select rid, q, lvl, {_H.format("t")} h, 1 whole, length({_F.format("t")}) n from qt union select rid, q, lvl, {_H.format("t")}, 0, length({_F.format("t")}) from (select rid, q, lvl, unnest(string_split(t, chr(10)) || string_split_regex(t, '\n[\x20\x09]*\n')) t from qt) where {_F.format("t")} <> ''),
found as (select distinct conv_id, turn, q, lvl, whole, n, src from tried join msg using (rid) join origin using (conv_id, h) where src < turn),
best as (select conv_id, turn, q, min(lvl) lvl, first(src order by whole desc, n desc, src) src from found group by all),
top as (select conv_id, turn, count(*) n_linked, first(src order by lvl, src desc) parent_turn from best group by all),
up as (select conv_id, turn, parent_turn as above, 1 as depth from top union all select up.conv_id, up.turn, top.parent_turn, depth + 1 from up join top on top.conv_id = up.conv_id and top.turn = up.above),
thread as (select conv_id, turn, min(above) thread_turn, max(depth) depth from up group by all)
select conv_id, turn, role, n_quotes::bigint n_quotes, max_level::int max_level, coalesce(n_linked, 0)::bigint n_linked, parent_turn, coalesce(thread_turn, turn)::bigint thread_turn, coalesce(depth, 0)::bigint depth, sha256(body) body_sha256
from msg left join top using (conv_id, turn) left join thread using (conv_id, turn)"""
QUOTED_SQL = OP8_SQL.replace("from conversations)", "from (" + QUOTED.format(conversations="conversations") + "))", 1)
