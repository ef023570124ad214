"""The binary tree of memories over an ordered log: blocks, covers, what is pending, and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Block = tuple[int, int]


def split_cover(t: int, alpha: float) -> list[Block]:
    """Aligned power-of-two blocks that tile 0 to t, each whole if it is at most alpha times as long as it is old."""

    def tile(lo: int, hi: int) -> list[Block]:
        if lo >= t:
            return []
        if hi - lo > 1 and (hi > t or float(hi - lo) > alpha * float(t - lo)):
            mid = (lo + hi) // 2
            return tile(lo, mid) + tile(mid, hi)
        return [(lo, hi)]

    return tile(0, 1 << (t - 1).bit_length()) if t else []


def cover(t: int, budget: int) -> list[Block]:
    """At most ``budget`` blocks, finest at the end: sixty halvings of alpha, then the last block that can be is split while there is room."""
    if t <= budget:
        return [(i, i + 1) for i in range(t)]
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2.0
        low, high = (mid, high) if len(split_cover(t, mid)) > budget else (low, mid)
    out = split_cover(t, high)
    while len(out) < budget and any(b - a > 1 for a, b in out):
        k = max(i for i, (a, b) in enumerate(out) if b - a > 1)
        a, b = out[k]
        out[k : k + 1] = [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def cover_frame(spark: SparkSession, t: int, budget: int) -> DataFrame:
    return spark.createDataFrame(cover(t, budget) or [(0, 0)], "lo bigint, hi bigint").where("hi > lo")


def block_id(lo: Column, hi: Column) -> Column:
    return F.concat(lo.cast("string"), F.lit("-"), (hi - 1).cast("string"))


def parsed_blocks(summaries: DataFrame, block: str = "block") -> DataFrame:
    """Adds lo and hi; what isn't an aligned block of a power of two, at least two long, goes."""
    text = F.regexp_extract(block, r"^#*(\d+)-(\d+)$", 0)
    lo = F.expr(f"try_cast(regexp_extract({block}, '^#*([0-9]+)-([0-9]+)$', 1) as bigint)")
    hi = F.expr(f"try_cast(regexp_extract({block}, '^#*([0-9]+)-([0-9]+)$', 2) as bigint)") + 1
    out = summaries.where(text != "").withColumns({"lo": lo, "hi": hi})
    n = F.col("hi") - F.col("lo")
    return out.where((n >= 2) & (F.bit_count(n) == 1) & (F.col("lo") % n == 0))


def log_rows(lines: DataFrame) -> DataFrame:
    """(n, v) of a JSON log's lines (n, value). A torn last line is left out; any other bad line is an error."""
    v = F.try_parse_json("value")
    last = lines.agg(F.max("n")).first()[0]
    bad = F.raise_error(F.concat(F.lit("bad line "), F.col("n").cast("string")))
    rows = lines.where("trim(value) <> ''").withColumn("v", v)
    return rows.where(F.col("v").isNotNull() | (F.col("n") != last)).select("n", F.when(F.col("v").isNotNull(), F.col("v")).otherwise(bad).alias("v"))


def current(summaries: DataFrame, order: str) -> DataFrame:
    """The last summary of each block."""
    return summaries.groupBy("block").agg(*(F.max_by(c, order).alias(c) for c in summaries.columns if c != "block"))


def levels(t: int) -> list[int]:
    return [1 << k for k in range(1, t.bit_length()) if 1 << k <= t]


def have(built: DataFrame) -> DataFrame:
    """(size, have): how many blocks of a size are built without a hole from the start. ``built`` has lo and hi.

    That is the least place that follows a built one, or the start, and isn't built: an anti-join and a minimum, so no size is one task's."""
    b = built.select((F.col("hi") - F.col("lo")).alias("size"), F.col("lo")).select("size", (F.col("lo") / F.col("size")).cast("long").alias("k")).distinct()
    after = b.select("size", (F.col("k") + 1).alias("k")).unionByName(b.select("size").distinct().withColumn("k", F.lit(0).cast("long")))
    return after.join(b, ["size", "k"], "left_anti").groupBy("size").agg(F.min("k").alias("have"))


def pending(spark: SparkSession, t: int, built: DataFrame, limit: int | None = None) -> DataFrame:
    """(lo, hi) of the blocks to build, smallest first and left to right. A hole makes what was built after it pending again."""
    done = {r["size"]: r["have"] for r in have(built).collect()}  # a number for each of at most log2(t) sizes
    out = spark.range(0).select(F.col("id").alias("lo"), F.col("id").alias("hi"))
    for n in levels(t):
        if (first := done.get(n, 0)) < t // n:
            out = out.unionByName(spark.range(first, t // n).select((F.col("id") * n).alias("lo"), ((F.col("id") + 1) * n).alias("hi")))
    return out if limit is None else out.orderBy(F.col("hi") - F.col("lo"), "lo").limit(limit)


def ancestors(blocks: DataFrame, t: int, built: DataFrame | None = None) -> DataFrame:
    """(lo, hi, up_lo, up_hi): the larger blocks that hold each block, inside the log. With ``built``, climbing stops below the first that isn't there."""
    size = F.col("hi") - F.col("lo")
    ups = blocks.select("lo", "hi", F.explode(F.array(*map(F.lit, levels(t))).cast("array<bigint>")).alias("n")).where(F.col("n") > size)
    ups = ups.select("lo", "hi", (F.col("lo") - F.col("lo") % F.col("n")).alias("up_lo"), (F.col("lo") - F.col("lo") % F.col("n") + F.col("n")).alias("up_hi")).where(F.col("up_hi") <= t)
    if built is None:
        return ups
    known = ups.join(built.select(F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.lit(1).alias("ok")), ["up_lo", "up_hi"], "left")
    # by size, not by end: larger and smaller blocks may end at one place
    w = W.partitionBy("lo", "hi").orderBy(F.col("up_hi") - F.col("up_lo")).rowsBetween(W.unboundedPreceding, 0)
    return known.withColumn("holes", F.count_if(F.col("ok").isNull()).over(w)).where("holes = 0").select("lo", "hi", "up_lo", "up_hi")


def zoom(blocks: DataFrame, t: int) -> DataFrame:
    """(lo, hi, half, a, b): a block's two halves, cut off at the end of the log."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    parts = F.array(F.struct(F.lit(0).alias("half"), F.col("lo").alias("a"), mid.alias("b")), F.struct(F.lit(1).alias("half"), mid.alias("a"), F.least(F.col("hi"), F.lit(t)).cast("long").alias("b")))
    return blocks.where("hi - lo > 1").select("lo", "hi", F.explode(parts).alias("h")).select("lo", "hi", "h.half", "h.a", "h.b").where("a < b")


def wake(spark: SparkSession, notes: DataFrame, summaries: DataFrame, t: int, budget: int = 96) -> DataFrame:
    """(lo, hi, line) of the cover: notes with their date, blocks with their text, blocks not built yet as pending."""
    blocks = cover_frame(spark, t, budget)
    note = notes.select(F.col("pos").alias("lo"), F.concat_ws(" ", F.concat(F.lit("#"), F.col("pos").cast("string")), F.substring("ts", 1, 10), "text").alias("note"))
    built = parsed_blocks(summaries).select("lo", "hi", F.concat_ws(" ", F.concat(F.lit("#"), F.col("block")), "text").alias("built"))
    missing = F.concat(F.lit("#"), block_id(F.col("lo"), F.col("hi")), F.lit(" (pending)"))
    return blocks.join(note, "lo", "left").join(built, ["lo", "hi"], "left").select("lo", "hi", F.when(F.col("hi") - F.col("lo") == 1, F.col("note")).otherwise(F.coalesce("built", missing)).alias("line"))


RAW_NOTES = 16


def merge_body(lo: int, hi: int, notes: DataFrame, summaries: DataFrame) -> str:
    """What a merge is shown: up to RAW_NOTES notes, else its halves' lines; a missing half is an error."""
    if hi - lo <= RAW_NOTES:
        rows = notes.where((F.col("pos") >= lo) & (F.col("pos") < hi)).orderBy("pos").select("pos", F.substring("ts", 1, 10).alias("d"), "text").collect()
        return "\n".join(f"  #{r['pos']} {r['d']} {r['text']}" for r in rows)
    mid, out = (lo + hi) // 2, []
    for a, b in ((lo, mid), (mid, hi)):
        got = summaries.where(F.col("block") == f"{a}-{b - 1}").select("text").first()
        if got is None:
            raise ValueError(f"The summary of #{a}-{b - 1} is blank.")
        out.append(f"  #{a}-{b - 1} {got['text']}")
    return "\n".join(out)


#: The wording that merges are asked for in; what another has written is written again.
WORDING = "story-1"
STORY = "Tell it as a short story of your own: who did what, why, and what came of it. Names stay names; what didn't last goes."


def merge_prompt(lo: int, hi: int, body: str, left: int, story: bool = False) -> str:
    """What a writer is asked for one merge, with how many are left after it; with ``story``, how to tell it (WORDING)."""
    rest = "" if not left else f"\n({left} more to merge after this.)"
    told = f"\n{STORY}\n" if story else ""
    return f"Merge notes #{lo} to #{hi - 1} into a single line, {280} bytes at most.\nWhat matters later stays; add nothing.\n\n{body}\n{rest}\n{told}"


def build_all(notes: DataFrame, summaries: DataFrame, t: int, writer) -> DataFrame:
    """Every pending block, level by level: ``writer(texts: Column) -> Column`` turns a block's parts into its line. log2(t) steps,
    however many blocks; each level is written to the shared folder, so that the next one's plan begins there."""
    from tarn.sources.shared import fresh_folder

    spark, out = notes.sparkSession, []
    given = parsed_blocks(summaries).select("lo", "hi", "text")
    parts = notes.select(F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi"), "text")
    for n in levels(t):
        known = given.where(F.col("hi") - F.col("lo") == n)
        pairs = parts.select((F.col("lo") - F.col("lo") % n).alias("up"), "lo", "text").groupBy("up").agg(F.sort_array(F.collect_list(F.struct("lo", "text"))).alias("x")).where((F.size("x") == 2) & (F.col("up") + n <= t))
        made = pairs.select(F.col("up").alias("lo"), (F.col("up") + n).alias("hi"), writer(F.transform("x", lambda x: x["text"])).alias("text"))
        at = fresh_folder(spark, f"blocks-{n}")
        known.unionByName(made.join(known.select("lo", "hi"), ["lo", "hi"], "left_anti")).write.parquet(at)
        parts = spark.read.schema("lo bigint, hi bigint, text string").parquet(at)
        out.append(parts)
    done = given.limit(0) if not out else out[0]
    for level in out[1:]:
        done = done.unionByName(level)
    return done.select(block_id(F.col("lo"), F.col("hi")).alias("block"), "text", "lo", "hi")


def check(notes: DataFrame, summaries: DataFrame, turns: DataFrame, t: int) -> DataFrame:
    """(failure, ident): what is wrong with a memory: bad texts, blocks past the log, unknown cited turns, repeated ids."""
    from tarn.functions.text import note_error

    fail = lambda df, name, ident: df.select(F.lit(name).alias("failure"), ident.cast("string").alias("ident"))
    blocks = parsed_blocks(summaries)
    bad_id = summaries.join(blocks.select("block").distinct(), "block", "left_anti")
    cited = notes.select("id", F.explode("turns").alias("turn")).join(turns.select(F.col("event_id").alias("turn")).distinct(), "turn", "left_anti")
    out = fail(notes.where(note_error(F.col("text")).isNotNull()), "note text", F.col("id"))
    for part in (fail(summaries.where(note_error(F.col("text"), F.col("block")).isNotNull()), "block text", F.col("block")), fail(bad_id, "block id", F.col("block")), fail(blocks.where(F.col("hi") > t), "past the log", F.col("block")), fail(cited, "unknown turn", F.col("turn")), fail(notes.groupBy("id").count().where("count > 1"), "repeated id", F.col("id"))):
        out = out.unionByName(part)
    return out


def verify(notes: DataFrame, summaries: DataFrame, turns: DataFrame, t: int, stored: DataFrame | None, budget: int | None = 96) -> DataFrame:
    """(failure, ident): what ``check`` finds, and notes that cite no turn, blocks that are due, lines of the wake without a merge (none asked for
    where ``budget`` is None), and cited turns (turn) that the store lacks; a missing store is a failure by itself."""
    fail = lambda df, name, ident: df.select(F.lit(name).alias("failure"), ident.cast("string").alias("ident"))
    spark, blocks = notes.sparkSession, parsed_blocks(summaries)
    label = block_id(F.col("lo"), F.col("hi"))
    out = check(notes, summaries, turns, t).unionByName(fail(notes.where(F.coalesce(F.size("turns"), F.lit(0)) <= 0), "no turn", F.col("id"))).unionByName(fail(pending(spark, t, blocks), "due", label))
    if budget is not None:
        out = out.unionByName(fail(cover_frame(spark, t, budget).where("hi - lo > 1").join(blocks.select("lo", "hi"), ["lo", "hi"], "left_anti"), "wake", label))
    if stored is None:
        return out.unionByName(fail(spark.range(1), "no store", F.lit(None)))
    cited = notes.select(F.explode("turns").alias("turn")).distinct()
    return out.unionByName(fail(cited.join(stored.select("turn").distinct(), "turn", "left_anti"), "not in the store", F.col("turn")))


def verify_counts(notes: DataFrame, summaries: DataFrame, failures: DataFrame, t: int, budget: int = 96) -> DataFrame:
    """One row: notes, blocks, turn_links, wake_lines and failures."""
    each = lambda df, what, links: df.select(F.lit(what).alias("what"), links.cast("long").alias("links"))
    rows = each(notes, "notes", F.greatest(F.coalesce(F.size("turns"), F.lit(0)), F.lit(0))).unionByName(each(summaries, "blocks", F.lit(0))).unionByName(each(failures, "failures", F.lit(0)))
    counts = [F.count_if(F.col("what") == what).alias(what) for what in ("notes", "blocks", "failures")]
    return rows.agg(*counts, F.coalesce(F.sum("links"), F.lit(0)).alias("turn_links"), F.lit(len(cover(t, budget))).cast("long").alias("wake_lines"))


def _with_ancestors(bad: DataFrame, built: DataFrame, t: int) -> DataFrame:
    ups = ancestors(bad, t, built).select(F.col("up_lo").alias("lo"), F.col("up_hi").alias("hi"))
    return bad.select("lo", "hi").unionByName(ups).distinct().orderBy(F.col("hi") - F.col("lo"), "lo")


def to_repair(summaries: DataFrame, t: int) -> DataFrame:
    """(lo, hi) of the blocks whose text is refused and of every block built on them without a hole, in the order they must be written again."""
    from tarn.functions.text import note_error

    built = parsed_blocks(summaries)
    return _with_ancestors(built.where(note_error(F.col("text"), F.col("block")).isNotNull()), built.select("lo", "hi").distinct(), t)


def to_reword(summaries: DataFrame, t: int, wording: str = WORDING) -> DataFrame:
    """(lo, hi) of the blocks that another wording, or none that is known, has written, and of those built on them; smallest first."""
    built = parsed_blocks(summaries)
    return _with_ancestors(built.where(~F.col("wording").eqNullSafe(wording)), built.select("lo", "hi").distinct(), t)


def append_rows(notes: DataFrame, read: DataFrame, folder: str, dropped: DataFrame | None = None) -> None:
    """Append a stretch's results: its notes, then what was refused, then the ids of its turns as read.

    In that order: a run that ends between them reads the stretch again, which repeats notes that their ids tell apart, and loses none."""
    notes.write.mode("append").parquet(f"{folder}/notes")
    if dropped is not None:
        dropped.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/dropped")
    read.select("id").distinct().write.mode("append").parquet(f"{folder}/read")


def appended(spark: SparkSession, folder: str, what: str, schema: str, key: str = "id") -> DataFrame:
    """What ``append_rows`` wrote (notes, read or dropped), each key once; empty where nothing was."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{what}").dropDuplicates([key])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
