"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every text, hashed, and counted by distinct owners and by distinct repositories (of an owner) over
the whole corpus. A value that EXAMPLE_OWNERS owners or more, or EXAMPLE_REPOS repositories or more, have is a widely copied
example. One that a single owner has in fewer repositories, and that mixes letters and digits, is live-looking. What is left
(two owners, or one owner's words and numbers) is neither: its base spans are told, it isn't replaced. Live values get a span
of their own kind, ``live``. Null texts count as empty, null repositories and owners as one of their own. Repeated rows each get
a row; an empty table gives none; other columns may have any names. Places and replacements take time in proportion to a
text, however many spans it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common

# The three kinds in their order, with the pattern, the group that is the secret, and its least length.
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is long enough starts where the leftmost match starts, so the least length can stand in the pattern itself.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS, ASSIGN_LEAST = ["assign", "access", "hex", "live"], 12
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 3
REPLACEMENT = "[secret]"

#: Start and end in code points, the value, and its end in bytes.
SPAN = "array<struct<s:int,kind:int,e:int,v:string,b:int>>"


def running(xs: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """All prefix sums of an array under ``join``: each round joins every element with the one twice as far before it, so n elements take log2(n) rounds."""
    rounds = F.when(F.size(xs) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs).cast("double"))).cast("int") - 1))

    def step(acc: Column, k: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), k)
        return F.zip_with(acc, F.concat(F.array_repeat(zero, far), F.slice(acc, 1, F.size(acc) - far)), join)

    return F.aggregate(rounds, xs, step)


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Matches of one pattern with their places: the text parted by the pattern gives the gaps between them, running sums the ends."""
    plus = lambda a, b: a + b

    def located(found: Column) -> Column:
        gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), group) if group else found
        ends = lambda size: F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: size(g) + size(m))

        def spans(e: Column, b: Column, v: Column) -> Column:
            one = lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("s"), F.lit(kind).alias("kind"), F.get(e, i).alias("e"), F.get(v, i).alias("v"), F.get(b, i).alias("b"))
            return F.filter(F.transform(found, one), lambda x: F.length(x["v"]) >= least).cast(SPAN)

        return common.let(running(ends(F.length), plus, F.lit(0)), lambda e: common.let(running(ends(F.octet_length), plus, F.lit(0)), lambda b: common.let(values, lambda v: spans(e, b, v))))

    return common.let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(located(m)))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_spans``: the base spans, by start and then kind."""
    t = common.text_of(text)
    access = F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, 1, 0, 18)).otherwise(F.array().cast(SPAN))
    return docs.withColumn("_spans", F.array_sort(F.concat(_spans(t, ASSIGN, 0, 2, ASSIGN_LEAST), access, _spans(t, HEX, 2, 0, 16))))


def ownership(found: DataFrame, repo: str, owner: str) -> DataFrame:
    """(h, n_repos, n_owners) of every candidate hash over the corpus: distinct (owner, repository) pairs, and distinct owners. Distinct triples first, so that a value in a third of all rows shrinks before the shuffle."""
    each = found.select(F.explode("_spans").alias("x"), F.coalesce(F.col(owner), F.lit("")).alias("o"), F.coalesce(F.col(repo), F.lit("")).alias("r")).select(F.sha2("x.v", 256).alias("h"), "o", "r").distinct()
    return each.groupBy("h", "o").agg(F.count("*").alias("k")).groupBy("h").agg(F.sum("k").alias("n_repos"), F.count("*").alias("n_owners"))


def is_example(repos: Column, owners: Column) -> Column:
    return (owners >= EXAMPLE_OWNERS) | (repos >= EXAMPLE_REPOS)


def is_live(value: Column, repos: Column, owners: Column) -> Column:
    return (owners == 1) & ~is_example(repos, owners) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


LIVE = "array<struct<s:int,e:int,bs:int,be:int>>"


def classified(found: DataFrame, repo: str, owner: str) -> DataFrame:
    """Adds to rows with ``_spans``: ``_live`` (the distinct values that look live: s, e in code points, bs, be in bytes), n_live, n_example, and the most repositories and owners of a value in the text."""
    found = common.stored(found.withColumn("_rid", F.monotonically_increasing_id()), "candidates")
    freq = common.stored(ownership(found, repo, owner), "ownership")
    one = found.select("_rid", F.explode("_spans").alias("x")).select("_rid", "x", F.sha2("x.v", 256).alias("h")).join(freq, "h")
    place = F.struct((F.col("x.e") - F.length("x.v")).alias("s"), F.col("x.e").alias("e"), (F.col("x.b") - F.octet_length("x.v")).alias("bs"), F.col("x.b").alias("be"))
    verdict = one.select("_rid", "n_repos", "n_owners", F.when(is_live(F.col("x.v"), F.col("n_repos"), F.col("n_owners")), place).alias("p"), is_example(F.col("n_repos"), F.col("n_owners")).cast("long").alias("ex"))
    marks = verdict.groupBy("_rid").agg(F.array_sort(F.collect_set("p")).cast(LIVE).alias("_live"), F.sum("ex").alias("n_example"), F.max("n_repos").alias("max_repos"), F.max("n_owners").alias("max_owners"))
    zero = F.lit(0).cast("long")
    out = found.join(marks, "_rid", "left").drop("_rid").withColumn("_live", F.coalesce("_live", F.array().cast(LIVE)))
    return out.withColumns({c: F.coalesce(c, zero) for c in ("n_example", "max_repos", "max_owners")} | {"n_live": F.size("_live").cast("long")})


def redact(text: Column, live: Column) -> Column:
    """The text with its live values replaced. Values that overlap or lie inside another are replaced together."""
    bounds = "array<struct<a:int,z:int>>"

    def groups(xs: Column, reach: Column) -> Column:
        """Byte ranges to replace: a value opens a new one if it starts at or after the end of all before it."""
        opens = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x["bs"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
        return common.let(opens, lambda o: F.transform(o, lambda i, k: F.struct(F.get(xs, i)["bs"].alias("a"), F.get(reach, F.coalesce(F.get(o, k + 1), F.size(xs)) - 1).alias("z"))).cast(bounds))

    def woven(raw: Column, gs: Column) -> Column:
        cut = lambda a, z: F.substring(raw, a + 1, z - a).cast("string")
        before = F.transform(gs, lambda g, k: cut(F.when(k == 0, F.lit(0)).otherwise(F.get(gs, k - 1)["z"]), g["a"]))
        return F.concat(F.array_join(F.transform(before, lambda p: F.concat(p, F.lit(REPLACEMENT))), ""), cut(F.element_at(gs, -1)["z"], F.octet_length(raw)))

    most = lambda xs: running(F.transform(xs, lambda x: x["be"]), lambda a, b: F.greatest(a, b), F.lit(0))
    ranges = common.let(F.array_sort(live), lambda xs: common.let(most(xs), lambda reach: groups(xs, reach)))
    return common.let(text.cast("binary"), lambda raw: common.let(ranges, lambda gs: woven(raw, gs)))


#: The tables name no owner: a source is taken for the owner, its part in one language for the repository.
def _places(docs: DataFrame) -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return docs.withColumns({"_owner": named("source"), "_repo": F.concat_ws("/", named("source"), named("lang"))})


def pipeline_stage(docs: DataFrame) -> DataFrame:
    """All rows of ``docs``, live-looking secrets replaced in ``text`` (and ``n_chars`` made to fit). Only rows with a candidate are written and joined."""
    seen = candidates(_places(common.wrapped(docs, "text", *(c for c in ("source", "lang") if c in docs.columns))))
    hit = classified(seen.where(F.size("_spans") > 0), "_repo", "_owner")
    fixed = F.when(F.col("n_live") > 0, redact(F.col("text"), F.col("_live"))).otherwise(F.col("text"))
    size = {"n_chars": F.length(fixed).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return common.unwrapped(hit, docs.columns, text=fixed, **size).unionByName(common.unwrapped(seen.where(F.size("_spans") == 0), docs.columns))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    docs = _places(common.table(spark, sf_dir, "documents"))
    found = candidates(docs).select("doc_id", "_repo", "_owner", "_spans")
    out = classified(found, "_repo", "_owner")
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.transform("_spans", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    live = F.transform("_live", lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("kind"), x["e"].alias("e")))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.array_sort(F.concat(base, live))).alias("spans"), "n_live", "n_example", "max_repos", "max_owners")


def _sql_kind(kind: int, pattern: str, value: str, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""select rid, {kind} kind, s, s + length(m[i]) e, {value} v from (
  select rid, m, g2, unnest(generate_series(1, len(m))) i, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) s from (
    select rid, regexp_extract_all(t, '{pattern}') m, {"regexp_extract_all(t, '" + pattern + "', 2)" if not kind else "[]::varchar[]"} g2, string_split_regex(t, '{pattern}') p from d)) where length({value}) >= {least}"""


OP4_SQL = f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, coalesce(source, '') o, coalesce(source, '') || '/' || coalesce(lang, '') r from documents),
c as ({_sql_kind(0, ASSIGN, "g2[i]", ASSIGN_LEAST)} union all {_sql_kind(1, ACCESS, "m[i]", 18)} union all {_sql_kind(2, HEX, "m[i]", 16)}),
f as (select v, count(distinct o) n_owners, count(distinct {{'o': o, 'r': r}}) n_repos from c join d using (rid) group by v),
x as (select c.*, n_owners, n_repos, n_owners >= {EXAMPLE_OWNERS} or n_repos >= {EXAMPLE_REPOS} ex, n_owners = 1 and n_repos < {EXAMPLE_REPOS} and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') live from c join f using (v)),
l as (select distinct rid, 3 kind, e - length(v) s, e from x where live),
n as (select rid, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e as w, s, kind from (select rid, kind, s, e from c union all select rid, kind, s, e from l)),
a as (select rid, string_agg(w, ',' order by s, kind) spans, string_agg(w, ',' order by s, kind) filter (kind < 3) base, count(*) filter (kind = 3) n_live, count(*) filter (kind = 0) a0, count(*) filter (kind = 1) a1, count(*) filter (kind = 2) a2 from n group by rid),
e as (select rid, count(*) filter (ex) n_example, max(n_repos) max_repos, max(n_owners) max_owners from x group by rid)
select doc_id, coalesce(a0, 0)::bigint n_assign, coalesce(a1, 0)::bigint n_access, coalesce(a2, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0)::bigint n_live, coalesce(n_example, 0)::bigint n_example, coalesce(max_repos, 0)::bigint max_repos, coalesce(max_owners, 0)::bigint max_owners
from d left join a using (rid) left join e using (rid)"""
