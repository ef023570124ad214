"""Counts over a store, the access table, registry problems and findings about a soul's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn import model as M


def store_stats(q: DataFrame, prefix: str) -> DataFrame:
    """One row: quads, graphs, subjects, turns below ``prefix``, dated subjects with the earliest and latest time, claims."""
    dated = F.col("dt") == M.DATETIME
    return q.agg(
        F.count("*").alias("quads"), F.count_distinct("g").alias("graphs"), F.count_distinct("s").alias("subjects"), F.count_distinct(F.when(F.col("s").startswith(prefix), F.col("s"))).alias("turns"),
        F.count_distinct(F.when(dated, F.col("s"))).alias("dated"), F.min(F.when(dated, F.col("o"))).alias("earliest"), F.max(F.when(dated, F.col("o"))).alias("latest"), F.count_if(F.col("p") == M.REIFIES).alias("claims"),
    )


def top_predicates(q: DataFrame, k: int = 20) -> DataFrame:
    return q.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(k)


OPEN, READ, WRITE, OWNER = "nothing", "read", "write", "owner"


def route_needs(method: Column, path: Column, prefix: str = "api") -> Column:
    """What a route needs: nothing for health and the list of stores, the machine's owner to sync all or stop, a store's writer to sync or fill it, else a reader."""
    p = F.regexp_replace(path, "^/+|/+$", "")
    get, post = method == "GET", method == "POST"
    return (
        F.when(get & p.isin(f"{prefix}/health", f"{prefix}/stores"), OPEN)
        .when(post & p.isin(f"{prefix}/sync", f"{prefix}/shutdown"), OWNER)
        .when(post & p.rlike(f"^{prefix}/[^/]+/[^/]+/(sync|import)$"), WRITE)
        .otherwise(READ)
    )


def gate(needs: Column, known: Column, service: Column, scopes: Column, is_owner: Column, has_owner: Column, same_soul: Column, soul_known: Column, strict_reads: Column) -> Column:
    """200, or the status a caller is refused with. Only a service, which acts under a grant, is held to a scope; a store that isn't served is let through for its handler to say so."""
    lacks = lambda word: service & ~F.array_contains(scopes, word)
    reading = F.when(~known, F.when(strict_reads, 401).otherwise(200)).when(lacks(READ), 403).otherwise(200)
    writing = F.when(~known, 401).when(lacks(WRITE), 403).when(~soul_known | is_owner | same_soul, 200).otherwise(403)
    owning = F.when(~known, 401).when(has_owner & is_owner & ~service, 200).otherwise(403)
    return F.when(needs == OPEN, 200).when(needs == READ, reading).when(needs == WRITE, writing).otherwise(owning)


def registry_problems(entries: DataFrame, key: str, order: str) -> DataFrame:
    """Entries after the first of their key."""
    return entries.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(order))).where("nth > 1")


def directory_metrics(source: DataFrame, mirror: DataFrame) -> DataFrame:
    """One row over the full join of (path, size): files in both, only here or there, bytes behind, growing."""
    j = source.select("path", F.col("size").alias("a")).join(mirror.select("path", F.col("size").alias("b")), "path", "full")
    return j.agg(F.count_if(F.expr("a is not null and b is not null")).alias("in_both"), F.count_if(F.expr("b is null")).alias("missing"), F.count_if(F.expr("a is null")).alias("only_mirror"), F.coalesce(F.sum(F.greatest(F.col("a") - F.coalesce("b", F.lit(0)), F.lit(0))), F.lit(0)).alias("bytes_behind"), F.count_if(F.expr("a > b")).alias("growing"))


def recall(store, term: str) -> dict:
    """What a memory and its transcripts say of a term: how often it was said, first and last; notes by month; the highest merge; the last five notes."""
    import re

    text = term.lower().replace("\\", "\\\\").replace('"', '\\"')
    word = "(^|[^A-Za-z0-9_])" + re.escape(term) + "($|[^A-Za-z0-9_])"
    word = word.replace("\\", "\\\\").replace('"', '\\"')
    hit = f'FILTER(CONTAINS(LCASE(?x), "{text}") && REGEX(?x, "{word}", "i"))'
    memory = f"<{M.NAMES.root}graph/NamedGraph/memory>"
    rows = lambda q: [r.asDict() for r in store.query(q).plain().collect()]
    said = rows(f"SELECT (COUNT(DISTINCT ?u) AS ?n) (MIN(STR(?ts)) AS ?first) (MAX(STR(?ts)) AS ?last) {{ GRAPH ?g {{ ?u a :Turn ; :text ?x ; :timestamp ?ts {hit} }} }}")[0]
    top = rows(f"SELECT ?a ?b ?x {{ GRAPH {memory} {{ ?m :memoryLevel ?l ; :logStart ?a ; :logEnd ?b ; :memoryText ?x FILTER(?l > 0) {hit} }} }} ORDER BY DESC(?l) ?a LIMIT 1")
    noted = f"GRAPH {memory} {{ ?m :memoryLevel 0 ; :logStart ?i ; :windowStart ?ts ; :memoryText ?x {hit} }}"
    months = rows(f"SELECT ?month (COUNT(?m) AS ?n) {{ {noted} BIND(SUBSTR(STR(?ts), 1, 7) AS ?month) }} GROUP BY ?month ORDER BY ?month")
    last = rows(f"SELECT ?i ?ts ?x {{ {noted} }} ORDER BY DESC(?i) LIMIT 5")
    return {"said": int(said["n"]), "first": said["first"], "last": said["last"], "months": {r["month"]: int(r["n"]) for r in months}, "highest": top[0] if top else None, "latest": last[::-1]}


def attributed(history: DataFrame, on_disk: DataFrame, mirrored: DataFrame, here: str, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mine, unattributed) of the conversations on disk (conv_id, has_full, has_short).

    Mine are those that the history (workspace, conv_id) records under this folder, and those that the mirror holds while every folder
    they are recorded under is gone. What the history never names is reported, not dropped. The full transcript is preferred; ``short_only`` marks the rest."""
    held = on_disk.where("has_full or has_short").withColumns({"source": F.when(F.col("has_full"), "transcript_full").otherwise("transcript"), "short_only": ~F.col("has_full")})
    named = history.where("workspace is not null and conv_id is not null").distinct()
    living = named.join(existing.select("workspace").distinct(), "workspace", "left_semi").select("conv_id").distinct()
    by_folder = named.where((F.col("workspace") == here)).join(existing.select("workspace").distinct(), "workspace", "left_semi").select("conv_id").distinct().withColumn("ground", F.lit("workspace"))
    proven = named.select("conv_id").distinct().join(living, "conv_id", "left_anti").join(mirrored.select("conv_id").distinct(), "conv_id", "left_semi").withColumn("ground", F.lit("mirror"))
    mine = held.join(by_folder.unionByName(proven), "conv_id").select("conv_id", "source", "short_only", "ground")
    return mine, held.join(named.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id")


def pass_counts(files: DataFrame, events: DataFrame | None = None) -> dict:
    """What a pass did, from one row a file (path, state, reason): how many were unchanged, done, superseded or failed, the failures by name (FAILURES at most), and the turns read."""
    seen = files.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "done", "superseded", "failed"))).first().asDict()
    named = [f"{r['path']}: {r['reason']}" for r in files.where("state = 'failed'").orderBy("path").limit(FAILURES).collect()]
    return seen | {"turns": events.count() if events is not None else 0, "failures": named}


#: Failures that a report names; the count tells of all.
FAILURES = 1000


def progress(turns: DataFrame, read: DataFrame, notes: DataFrame, summaries: DataFrame, t: int) -> DataFrame:
    """One row on a memory: turns, turns_read, notes, blocks, pending_blocks and whether it is done. ``t`` is the log's length."""
    from tarn.operators import memory_tree as tree

    spark = turns.sparkSession
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
    blocks = tree.parsed_blocks(summaries)
    parts = [one(turns.select("id").distinct(), "turns"), one(read.select("id").distinct(), "turns_read"), one(notes, "notes"), one(blocks.select("lo", "hi").distinct(), "blocks"), one(tree.pending(spark, t, blocks), "pending_blocks")]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(p, "_k")
    return row.drop("_k").withColumn("done", (F.col("turns") > 0) & (F.col("turns_read") >= F.col("turns")) & (F.col("pending_blocks") == 0))


def usage(calls: DataFrame) -> DataFrame:
    """(owner, calls, tokens_in, tokens_out, first, last) from a row for each call of a writer (owner, at, tokens_in, tokens_out)."""
    return calls.groupBy("owner").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.min("at").alias("first"), F.max("at").alias("last"))


#: A transcript of a proven folder that was written this lately is copied by the next pass, and so isn't behind.
SIBLING_SECONDS = 300


def slug_core(slug: Column) -> Column:
    """Letters and digits alone, in lower case: what cosmetic renames leave alike."""
    return F.lower(F.regexp_replace(slug, "[^A-Za-z0-9]", ""))


def siblings(files: DataFrame, current: DataFrame, mirror: DataFrame, here: str) -> DataFrame:
    """One row for each other folder that holds, or seems to hold, the history of ``here``.

    ``files`` (slug, path, size, age) are the transcripts of the other folders, ``current`` (path) those of this one, ``mirror`` (path, size)
    what is kept; a path without a slash lies at the top. A folder is proven if the mirror has one of its top transcripts, a date before its
    name allowed; else it must share the core of its name. Folders without a top transcript are none. One aggregation by folder."""
    top = ~F.col("path").contains("/")
    # every end of a kept name that follows a dash, and the name itself, so that dates before it meet by an equi-join
    words = F.split("path", "-")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), "-"))
    named = mirror.where(top).select("size", F.explode(ends).alias("path")).groupBy("path").agg(F.max("size").alias("_dated"))
    exact = mirror.groupBy("path").agg(F.max("size").alias("_exact"))
    f = files.join(exact, "path", "left").join(named, "path", "left").join(current.select("path", F.lit(1).alias("_here")).distinct(), "path", "left")
    f = f.withColumns({"_top": top, "_have": F.coalesce(F.greatest("_exact", F.when(top, F.col("_dated"))), F.lit(0))})
    behind, live = F.col("_have") < F.col("size"), F.coalesce(F.col("age") < SIBLING_SECONDS, F.lit(False))
    gap, both = F.col("size") - F.col("_have"), F.col("_here").isNotNull()
    g = f.groupBy("slug").agg(
        F.bool_or(F.col("_top") & F.col("_dated").isNotNull()).alias("proven"), F.count_if("_top").alias("sessions"), F.count("*").alias("transcripts"), F.count_if(behind & live).alias("_live"), F.count_if(behind & ~live).alias("_old"),
        F.coalesce(F.sum(F.when(behind & live, gap)), F.lit(0)).alias("_live_bytes"), F.coalesce(F.sum(F.when(behind & ~live, gap)), F.lit(0)).alias("_old_bytes"), F.count_if(both).alias("in_both"), F.min(F.when(both, F.col("path"))).alias("example"),
    )
    kept = g.where((F.col("slug") != here) & (F.col("sessions") > 0) & (F.col("proven") | (slug_core(F.col("slug")) == slug_core(F.lit(here)))))
    unless = lambda c: F.when(F.col("proven"), F.lit(0)).otherwise(F.col(c))
    return kept.select("slug", "proven", "sessions", "transcripts", (F.col("_old") + unless("_live")).alias("unmirrored"), (F.col("_old_bytes") + unless("_live_bytes")).alias("unmirrored_bytes"), F.when(F.col("proven"), F.col("_live")).otherwise(0).alias("growing"), "in_both", "example")


def _line(df: DataFrame, topic: str, attention: Column, *parts: str | Column) -> DataFrame:
    said = F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("none")) for p in parts))
    return df.select(F.lit(topic).alias("topic"), attention.alias("attention"), said.alias("line"))


def soul_report(
    spark: SparkSession, old_places: list[str], files: DataFrame | None, mirrored: DataFrame, others: DataFrame, step_logs: DataFrame, orphans: DataFrame, store: DataFrame | None
) -> DataFrame:
    """(topic, attention, line): everything that is to be said of a soul's files, reading only.

    ``old_places`` are folders of an older layout that are still there; ``files`` (size, mirror_size, age, behind_for) the transcripts of its folder, None
    where it has none; ``mirrored`` a row for each kept transcript; ``others`` of ``siblings``; ``step_logs`` (conv_id, kept) its conversations of that dialect;
    ``orphans`` conversations of no folder, which are no one soul's fault; ``store`` one row (graphs, turns, latest), None where there is no store.
    Every part is one aggregation, so the report is as small as the number of folders."""
    from tarn.operators.ingest import LAG_SECONDS, mirror_state

    c, yes, no = F.col, F.lit(True), F.lit(False)
    one = spark.range(1)
    parts = [_line(one, "layout", yes, f"folders of the older layout are left: {', '.join(old_places)}") if old_places else _line(one, "layout", no, "as it should be")]
    steps = step_logs.agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    if files is None:
        each = lambda df, n: df.select(F.lit(n).alias("x"))
        both = each(mirrored, 0).unionByName(each(step_logs, 1)).agg(F.count_if(c("x") == 0).alias("n"), F.count_if(c("x") == 1).alias("m"))
        parts.append(_line(both.where("n > 0"), "mirror", no, "no source folder; ", c("n"), " transcripts are kept"))
        parts.append(_line(both.where("n = 0 and m > 0"), "mirror", no, "no session logs; ", c("m"), " step logs"))
        parts.append(_line(both.where("n = 0 and m = 0"), "mirror", yes, "no source folder and no mirror: nothing was ever kept"))
    else:
        f = files.withColumn("_s", mirror_state(c("size"), c("mirror_size"), c("age"), c("behind_for")))
        long = c("_s") == "growing-long"
        gap = F.greatest(c("size") - F.coalesce("mirror_size", F.lit(0)), F.lit(0))
        m = f.agg(F.count("*").alias("n"), *(F.count_if(c("_s").startswith(s)).alias(s) for s in ("current", "growing", "stale", "missing")), F.count_if(long).alias("long"), F.max(F.when(long, F.floor(c("behind_for") / 86400))).alias("worst"), F.sum(F.when(long, gap)).alias("bytes"))
        parts.append(_line(m, "mirror", c("stale") + c("missing") > 0, c("n"), " transcripts: ", c("current"), " current, ", c("growing"), " growing, ", c("stale"), " stale, ", c("missing"), " missing"))
        parts.append(_line(m.where("long > 0"), "mirror age", yes, c("long"), f" growing transcripts are behind for over {LAG_SECONDS // 86400} days, ", c("worst"), " at worst; ", c("bytes"), " bytes are in one place only"))
    how = F.when(c("proven"), " (proven): ").otherwise(" (suspected): ")
    live = F.when(c("growing") > 0, F.concat(F.lit(", "), c("growing").cast("string"), F.lit(" being written"))).otherwise("")
    parts.append(_line(others.where("unmirrored > 0"), "folders", yes, c("slug"), how, c("unmirrored"), " of ", c("transcripts"), " transcripts are not whole in the mirror, ", c("unmirrored_bytes"), " bytes behind", live))
    parts.append(_line(others.where("unmirrored = 0"), "folders", no, c("slug"), how, "all ", c("transcripts"), " transcripts are in the mirror", live))
    parts.append(_line(others.where("in_both > 0"), "folders", yes, c("slug"), ": ", c("in_both"), " transcripts are in the current folder too, ", c("example"), " among them; the mirror keeps the larger"))
    parts.append(_line(others.agg(F.count("*").alias("n")).where("n = 0"), "folders", no, "no other folder holds this history"))
    parts.append(_line(steps.where("n > 0"), "step logs", c("n") > c("kept"), c("n"), " conversations: ", c("kept"), " kept, ", c("n") - c("kept"), " never"))
    parts.append(_line(orphans.agg(F.count("*").alias("n")).where("n > 0"), "orphans", no, c("n"), " conversations on this machine belong to no folder"))
    parts.append(_line(one, "store", yes, "no store: nothing was ingested") if store is None else _line(store, "store", no, c("graphs"), " graphs, ", c("turns"), " turns, the latest at ", c("latest")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
