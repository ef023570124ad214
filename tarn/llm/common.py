"""What the corpus operators share: the shared folder, written tables, word splitting, in-row bindings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space and the five controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch. Texts may be long, so batches are short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a new one of our own, in local mode only: on a cluster executors don't share the driver's disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tarn-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths that ``stored`` wrote, in their order.
_written: list[str] = []


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: a short lineage that outlives executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    _written.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``stored`` that nothing will read again."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            _delete(df.sparkSession, name.rsplit("/", 1)[0])


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stored`` of what ``make`` gives; the tables that it wrote on the way go once that is written."""
    before = len(_written)
    out = stored(make(), name)
    for path in _written[before:-1]:
        _delete(spark, path)
    del _written[before:-1]
    return out


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row (a plain reference inside a lambda would be computed for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def array_literal(values: list[float], kind: str = "double") -> Column:
    """A bounded array of numbers as one constant, parsed once when the plan is made."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast(f"array<{kind}>")


def wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside the whole row in ``_row``, so that other columns can't clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *names)


def unwrapped(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The rows of ``wrapped``, with some columns replaced."""
    return df.select(*((replaced[c] if c in replaced else F.col("_row")[c]).alias(c) for c in columns))
