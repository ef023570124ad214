"""Text lines of files with their place, and recursive listings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """(file, conv_id, line_no, value): every line of the files, numbered in each file; conv_id is the file's name without its ending."""
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    placed = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    numbered = placed.withColumn("line_no", F.row_number().over(W.partitionBy("file").orderBy("_block", "_row")).cast("long") - 1)
    return numbered.select("file", F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1).alias("conv_id"), "line_no", "value")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Adds the variant ``v``; blank and malformed lines, a torn last one among them, have none and are dropped by scans."""
    return lines.withColumn("v", F.try_parse_json(F.when(F.trim("value") != "", F.col("value"))))


def files(root: str, suffix: str = ".jsonl") -> list[str]:
    """All files below a folder, nested ones too, sorted."""
    return sorted(str(p) for p in Path(root).rglob(f"*{suffix}"))


def is_export_dir(path: str) -> bool:
    """An export folder has both of its files."""
    return all((Path(path) / name).is_file() for name in ("conversations.json", "users.json"))
