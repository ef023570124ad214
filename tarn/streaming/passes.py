"""Passes as Structured Streaming: each micro-batch goes through the batch operators unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators.ingest import QuadTable
from tarn.operators.project import turns
from tarn.sources.session_log import events

SETTLE_MINUTES, FLUSH_BYTES, FLUSH_HOURS, CALLS_A_PASS = 30, 24_000, 6, 60


def flush_decision(size: Column, oldest: Column, now: Column) -> Column:
    """Enough bytes, or something old enough; else wait."""
    old = oldest < now - F.expr(f"interval {FLUSH_HOURS} hours")
    return F.when(size >= FLUSH_BYTES, "flush-size").when(old, "flush-age").otherwise("wait")


def settled(turns: DataFrame, now: Column) -> DataFrame:
    """Turns old enough to be read: ts is a timestamp."""
    return turns.where(F.col("ts") < now - F.expr(f"interval {SETTLE_MINUTES} minutes"))


def fair_share(rows: DataFrame, owner: str, order: str, limit: int = CALLS_A_PASS) -> DataFrame:
    """At most ``limit`` rows of each owner in a pass; the rest wait for the next."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(owner).orderBy(order))).where(F.col("_n") <= limit).drop("_n")


PAUSE_MINUTES, RETRY_MINUTES = 30, 60


def due(state: DataFrame, now: Column) -> DataFrame:
    """Owners (owner, dirty, paused_at, failed_at) that a pass may take: changed, and no pause or failure is too recent."""
    old = lambda c, n: F.col(c).isNull() | (F.col(c) <= now - F.expr(f"interval {n} minutes"))
    return state.where(F.col("dirty") & old("paused_at", PAUSE_MINUTES) & old("failed_at", RETRY_MINUTES))


def file_lines(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """New files of a folder as lines. Files that are rewritten in place aren't seen here: re-scan those by their hash."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).option("wholetext", "true").text(folder)
    file = F.col("_metadata.file_path")
    return raw.select(file.alias("file"), F.regexp_extract(file, r"([^/]*?)(\.[^./]*)?$", 1).alias("conv_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))


def dialect_events(dialect: str, lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(events, failed conversations) of the lines of a dialect: ``session`` or ``steps``."""
    from tarn.sources import step_log

    if dialect == "session":
        return events(lines), None
    if dialect == "steps":
        return step_log.events_or_failed(lines)
    raise ValueError(f"no line dialect: {dialect}")


def ingest_pass(spark: SparkSession, folder: str, table: QuadTable, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None, trigger: dict | None = None, dialect: str = "session"):
    """Projects new transcripts into the quad table. A graph is replaced whole, so a batch that runs twice changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        e = dialect_events(dialect, batch)[0].persist()
        if not e.isEmpty():
            table.replace(turns(e))
            if on_batch:
                on_batch(e)
        e.unpersist()

    return file_lines(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Files whose paths the driver holds at once; a pass takes as many rounds as it needs.
FILES_A_ROUND = 5_000


def sync_pass(spark: SparkSession, folder: str, table: QuadTable, manifest: str, dialect: str = "session", deep: bool = False, on_events: Callable[[DataFrame], None] | None = None, pattern: str = "*.jsonl") -> dict:
    """One pass over a folder of transcripts that grow or are rewritten: what the manifest doesn't know is read again whole, its graphs are replaced, and then it is noted.

    Unchanged files cost a listing. A pass that ends early leaves its files to do; a repeated one changes nothing. Conversations that
    can't be read are told and stay to do. Returns the counts of ``diagnostics.pass_counts``."""
    from tarn.operators import diagnostics, ingest
    from tarn.sources.lines import read_lines
    from tarn.sources.shared import fresh_folder

    at = fresh_folder(spark, "scan")
    ingest.rescanned(spark, folder, ingest.read_manifest(spark, manifest), pattern, deep).write.parquet(at)
    scan = spark.read.parquet(at)
    rounds = max(1, -(-scan.where("state = 'todo'").count() // FILES_A_ROUND))
    told, failed_files = 0, []
    for k in range(rounds):
        part = scan.where((F.col("state") == "todo") & (F.pmod(F.xxhash64("path"), F.lit(rounds)) == k))
        paths = [r["path"] for r in part.select("path").collect()]
        if not paths:
            continue
        lines = read_lines(spark, paths)
        read, failed = dialect_events(dialect, lines)
        read = read.persist()
        told += read.count()
        table.replace(turns(read))
        if on_events:
            on_events(read)
        read.unpersist()
        if failed is not None:
            files = lines.select("file", "conv_id").distinct().join(failed, "conv_id")
            failed_files += [(r["file"], r["reason"]) for r in files.collect()]
        bad = spark.createDataFrame([(f,) for f, _ in failed_files], "path string")
        ingest.note_manifest(part.join(bad, "path", "left_anti"), manifest)
    bad = spark.createDataFrame(failed_files, "path string, reason string")
    states = scan.join(bad, "path", "left").select("path", F.when(F.col("reason").isNotNull(), "failed").when(F.col("state") == "todo", "done").otherwise("unchanged").alias("state"), "reason")
    return diagnostics.pass_counts(states) | {"turns": told}


def export_sync(spark: SparkSession, dirs: list[str], table: QuadTable, manifest: str) -> dict:
    """One pass over export folders: conversations whose newest version the manifest lacks are projected and noted."""
    from tarn.operators import ingest
    from tarn.sources import export

    try:
        known = spark.read.schema("uuid string, version_key string, at timestamp").parquet(manifest).groupBy("uuid").agg(F.max_by("version_key", "at").alias("version_key"))
        known.schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "uuid string, version_key string")
    todo = ingest.export_pass(export.read(spark, dirs), known)[0].persist()
    n = todo.count()
    if n:
        table.replace(turns(export.events(todo)))
        todo.select("uuid", "version_key", F.current_timestamp().alias("at")).write.mode("append").parquet(manifest)
    todo.unpersist()
    return {"exports": len(dirs), "done": n}


def memory_pass(turns_now: DataFrame, state: DataFrame, folder: str, now: Column, on_rows: Callable[[DataFrame], DataFrame], limit: int = CALLS_A_PASS) -> DataFrame:
    """One pass of the memory loop over turns (owner, id, ts as timestamp, text) and owners (owner, dirty, paused_at, failed_at).

    Unread turns that have settled count; an owner is due if it is dirty and neither paused nor failed of late, and has a whole
    stretch or one old enough. The due owners' rows, a fair share of each, go to ``on_rows``, which returns the notes; notes are
    appended, then the rows' ids as read. Returns (owner, turns, bytes, decision) of every owner with unread turns. Late turns are read late, never dropped."""
    from tarn.operators import memory_tree
    from tarn.sources.shared import fresh_folder

    spark = turns_now.sparkSession
    read = memory_tree.appended(spark, folder, "read", "id string")
    waiting = settled(turns_now.join(read, "id", "left_anti"), now)
    at = fresh_folder(spark, "waiting")
    waiting.write.parquet(at)
    waiting = spark.read.schema(waiting.schema).parquet(at)
    from tarn.functions.text import clipped_bytes

    load = waiting.groupBy("owner").agg(F.count("*").alias("turns"), F.sum(clipped_bytes(F.col("text"))).cast("bigint").alias("bytes"), F.min("ts").alias("oldest"))
    ready = due(state, now).select("owner").withColumn("_due", F.lit(True))
    told = load.join(ready, "owner", "left").select("owner", "turns", "bytes", F.when(F.col("_due").isNull(), "not-due").otherwise(flush_decision(F.col("bytes"), F.col("oldest"), now)).alias("decision"))
    rows = fair_share(waiting.join(told.where("decision like 'flush%'").select("owner"), "owner", "left_semi"), "owner", "ts", limit)
    at = fresh_folder(spark, "taken")
    rows.write.parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    if not rows.isEmpty():
        memory_tree.append_rows(on_rows(rows), rows, folder)
    return told


def unread_state(stream: DataFrame, folder: str, on_rows: Callable[[DataFrame], DataFrame]):
    """Batch by batch, the turns (id, ...) that were not read yet go to ``on_rows``, whose notes are appended before the ids. No watermark: late turns are read late, never dropped."""
    from tarn.operators import memory_tree

    def each(batch: DataFrame, _: int) -> None:
        known = memory_tree.appended(batch.sparkSession, folder, "read", "id string")
        fresh = batch.dropDuplicates(["id"]).join(known, "id", "left_anti").persist()
        if not fresh.isEmpty():
            memory_tree.append_rows(on_rows(fresh), fresh, folder)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(each)
