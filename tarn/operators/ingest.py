"""Mirrors, manifests, ownership and graph replacement: everything that makes a repeated pass change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn import model as M

LIVE_SECONDS, LAG_SECONDS = 30 * 60, 3 * 24 * 3600
PROJECTION = "1"


def to_copy(source: DataFrame, mirror: DataFrame) -> DataFrame:
    """Source files (path, size) that the mirror lacks or has shorter. A shorter source never shrinks its mirror."""
    m = mirror.select("path", F.col("size").alias("_size"))
    return source.join(m, "path", "left").where("_size is null or size > _size").drop("_size")


def mirror_state(source_size: Column, mirror_size: Column, source_age: Column, behind_for: Column) -> Column:
    """Current where sizes are equal. Else a source written within LIVE_SECONDS is growing, and growing-long once its mirror has been behind for more
    than LAG_SECONDS; any other is missing without a mirror and stale with one. ``behind_for`` is the mirror's age, or how long the source
    has had none; null is not long."""
    live, long = source_age <= LIVE_SECONDS, F.coalesce(behind_for > LAG_SECONDS, F.lit(False))
    return F.when(source_size == mirror_size, "current").when(live & long, "growing-long").when(live, "growing").when(mirror_size.isNull(), "missing").otherwise("stale")


def changed(current: DataFrame, manifest: DataFrame, key: str, version: str, projection: str = PROJECTION) -> DataFrame:
    """Rows whose (key, version) the manifest lacks. A manifest of another projection counts as empty, so all is done again."""
    known = manifest.where(F.col("projection_version") == projection).select(key, version)
    return current.join(known, [key, version], "left_anti")


MANIFEST = "path string, length bigint, modified timestamp, hash string, projection_version string, at timestamp"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each file; empty where nothing was written yet."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(path)
        rows.schema  # noqa: B018  a path that isn't there shows here
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], MANIFEST)
    return rows.groupBy("path").agg(*(F.max_by(c, "at").alias(c) for c in ("length", "modified", "hash", "projection_version", "at")))


def note_manifest(files: DataFrame, path: str, projection: str = PROJECTION) -> None:
    """Append files (path, length, modified, hash) that are done; the last row of a path counts."""
    files.select("path", "length", "modified", "hash", F.lit(projection).alias("projection_version"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


#: Fixed value: the key of the line that tells which projection a text manifest was written under.
PROJECTION_KEY = "#turn-projection"


def write_tsv_manifest(rows: DataFrame, path: str, projection: str = PROJECTION) -> None:
    """(key, value) as sorted lines with a tab between, and a line that tells the projection. A folder of text files, replaced as a whole."""
    mark = rows.sparkSession.createDataFrame([(PROJECTION_KEY, projection)], "key string, value string")
    lines = rows.select("key", "value").unionByName(mark).select(F.concat_ws("\t", "key", "value").alias("line"))
    lines.orderBy("line").write.mode("overwrite").option("compression", "none").text(path)


def read_tsv_manifest(spark: SparkSession, path: str, projection: str = PROJECTION) -> DataFrame:
    """(key, value) of a file or folder of such lines. The value is all after the first tab; lines without one go; of equal keys the largest value counts.
    Nothing, if there is no such path or it was written under another projection: all is then read again."""
    none = spark.createDataFrame([], "key string, value string")
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return none
    cut = F.split("value", "\t", 2)
    rows = lines.where(F.col("value").contains("\t")).select(F.get(cut, F.lit(0)).alias("key"), F.get(cut, F.lit(1)).alias("value"))
    if rows.where((F.col("key") == PROJECTION_KEY) & (F.col("value") == projection)).isEmpty():
        return none
    return rows.where(F.col("key") != PROJECTION_KEY).groupBy("key").agg(F.max("value").alias("value"))


def rescanned(spark: SparkSession, folder: str, manifest: DataFrame, pattern: str = "*.jsonl", deep: bool = False, projection: str = PROJECTION) -> DataFrame:
    """(path, length, modified, hash, state) of every file below a folder: ``unchanged``, or ``todo`` for a new, grown or rewritten one.

    Bytes are read and hashed only where length or time differ from the manifest's, or everywhere with ``deep``: that finds a
    rewrite in place of the same size and time too."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    known = manifest.where(F.col("projection_version") == projection).select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"), F.col("hash").alias("_h"))
    listed = raw.select("path", "length", F.col("modificationTime").alias("modified")).join(known, "path", "left")
    same = (F.col("length") == F.col("_l")) & (F.col("modified") == F.col("_m"))
    quiet = listed.where(F.coalesce(same & F.lit(not deep), F.lit(False))).select("path", "length", "modified", F.col("_h").alias("hash"), F.lit("unchanged").alias("state"))
    moved = listed.where(~F.coalesce(same & F.lit(not deep), F.lit(False))).select("path", "_h")
    hashed = raw.join(moved, "path").select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), "_h")
    return quiet.unionByName(hashed.withColumn("state", F.when(F.col("hash").eqNullSafe(F.col("_h")), "unchanged").otherwise("todo")).drop("_h"))


def owned(rows: DataFrame, ident: str, *order: Column) -> DataFrame:
    """One row for each id: the first by file depth, time and path. Later copies of a turn drop it."""
    w = W.partitionBy(ident).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def owned_incremental(new: DataFrame, stored: DataFrame, ident: str, holder: str) -> DataFrame:
    """Rows of new files whose turn no other file owns yet: an earlier owner stays the owner."""
    taken = stored.select(ident, F.col(holder).alias("_holder")).distinct()
    return new.join(taken, ident, "left").where(F.col("_holder").isNull() | (F.col("_holder") == F.col(holder))).drop("_holder")


def superseded(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Dated copies ``YYYY-MM-DD-x`` whose bytes begin the file ``x``: they are left out."""
    dated = files.withColumn("_of", F.regexp_extract(name, r"^\d{4}-\d{2}-\d{2}-(.+)$", 1)).where("_of <> ''")
    live = files.select(F.col(name).alias("_of"), F.col(content).alias("_all"))
    return dated.join(live, "_of").where(F.col("_all").startswith(F.col(content))).drop("_of", "_all")


def replace_graphs(current: DataFrame, new: DataFrame) -> DataFrame:
    """The quads after each graph of ``new`` takes the place of its old self. Sets: repeating it changes nothing."""
    graphs = new.select("g").distinct()
    return current.join(graphs, "g", "left_anti").unionByName(new).dropDuplicates(M.QUAD_COLUMNS)


def annotated_only(events: DataFrame, annotations: DataFrame) -> DataFrame:
    """The events that a finding is about."""
    return events.join(annotations.select("event_id").distinct(), "event_id", "left_semi")


def export_pass(versions: DataFrame, manifest: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(to do, manifest after): conversations (export, uuid, version_key) whose newest version isn't in the manifest (uuid, version_key); those that failed stay to do."""
    from tarn.sources.export import newest

    todo = newest(versions).join(manifest.select("uuid", "version_key"), ["uuid", "version_key"], "left_anti")
    done = todo.select("uuid", "version_key")
    if failed is not None:
        done = done.join(failed.select("uuid").distinct(), "uuid", "left_anti")
    kept = manifest.select("uuid", "version_key").join(done.select("uuid"), "uuid", "left_anti")
    return todo, kept.unionByName(done)


def import_export(source: str, target: str) -> int:
    """Copies an export folder's files byte by byte, each by a temporary name and a rename; the same name with other bytes is refused. Returns the bytes copied."""
    import filecmp
    import os
    import shutil
    from pathlib import Path

    total = 0
    Path(target).mkdir(parents=True, exist_ok=True)
    for f in sorted(p for p in Path(source).iterdir() if p.is_file()):
        to = Path(target) / f.name
        if to.exists():
            if not filecmp.cmp(f, to, shallow=False):
                raise FileExistsError(f"{to} is there with other bytes")
            continue
        part = to.with_name(f".{to.name}.part")
        shutil.copyfile(f, part)
        os.replace(part, to)
        total += to.stat().st_size
    return total


def described(graphs: DataFrame, kind: str = "TranscriptGraph", owner: str | None = None) -> DataFrame:
    """What the unnamed graph says of each graph: its class, that it is private, and its owner if known."""
    from tarn.operators.project import iri, lit, quads

    g = F.col("g")
    parts = [(g, M.TYPE, iri(F.lit(M.V(kind)))), (g, M.V("visibility"), lit(F.lit("private"))), (g, M.V("owner"), iri(F.lit(owner).cast("string")))]
    return quads(graphs.select("g").distinct(), F.lit(None).cast("string"), parts)


class QuadTable:
    """Quads in Parquet, partitioned by a bucket of the graph and sorted by (p, s). Replacing a graph rewrites its bucket only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, parts: int = 8):
        self.spark, self.path, self.buckets, self.parts = spark, path, buckets, parts

    def _placed(self, q: DataFrame) -> DataFrame:
        return q.select(*M.QUAD_COLUMNS, F.coalesce(M.graph_bucket(F.col("g"), self.buckets), F.lit(-1)).alias("gb"))

    def _dealt(self, q: DataFrame) -> DataFrame:
        """By bucket and a few parts of its subjects, so that one large graph isn't one task; sorted for row-group statistics."""
        return q.repartition("gb", F.pmod(F.xxhash64("s"), F.lit(self.parts))).sortWithinPartitions("gb", "p", "s")

    def create(self, q: DataFrame) -> None:
        self._dealt(self._placed(q)).write.mode("overwrite").partitionBy("gb").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{M.QUAD}, gb int").parquet(self.path)

    def _rewrite(self, graphs: DataFrame, new: DataFrame) -> None:
        touched = [r["gb"] for r in graphs.select(F.coalesce(M.graph_bucket(F.col("g"), self.buckets), F.lit(-1)).alias("gb")).distinct().collect()]  # at most `buckets` numbers
        old = self.read().where(F.col("gb").isin(touched)).join(graphs.select("g").distinct(), "g", "left_anti").select(*M.QUAD_COLUMNS)
        # a bucket that would be left empty keeps a row that no reader sees as a statement: it has no subject
        rest = self.spark.createDataFrame([(b,) for b in touched], "gb int").select(*(F.lit(None).cast(t).alias(c) for c, t in zip(M.QUAD_COLUMNS, ["string"] * 7 + ["struct<s:string,p:string,o:string>"], strict=True)), "gb")
        rows = self._placed(old.where("s is not null").unionByName(new).dropDuplicates(M.QUAD_COLUMNS)).unionByName(rest)
        self._dealt(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gb").parquet(self.path)

    def replace(self, new: DataFrame) -> None:
        new = new.persist()
        self._rewrite(new.select("g"), new)
        new.unpersist()

    def drop(self, graphs: list[str]) -> None:
        g = self.spark.createDataFrame([(x,) for x in graphs], "g string")
        self._rewrite(g, self.read().limit(0).select(*M.QUAD_COLUMNS))

    def quads(self) -> DataFrame:
        return self.read().where("s is not null")
