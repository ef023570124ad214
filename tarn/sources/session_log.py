"""Dialect A: session logs, one JSON record a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources import blocks as B
from tarn.sources.lines import parsed_lines

KEPT = ["user", "assistant"]


def events(lines: DataFrame) -> DataFrame:
    """Records of type user or assistant that have a uuid; other, blank and malformed lines go. Two records with one uuid both stay."""
    v = F.col("v")
    kept = parsed_lines(lines).where(B.field(v, "$.type").isin(KEPT) & B.field(v, "$.uuid").isNotNull()).withColumn("m", B.message_text(v))
    return kept.select(
        F.lit("session").alias("source"), "conv_id", F.col("line_no").alias("pos"), B.field(v, "$.uuid").alias("event_id"), B.field(v, "$.parentUuid").alias("parent_id"),
        F.coalesce(B.field(v, "$.message.role"), B.field(v, "$.type")).alias("role"), B.field(v, "$.timestamp").alias("timestamp"), "m.text", F.col("m.spans").alias("text_provenance"),
        B.thinking(v).alias("thinking"), B.reported_model(v).alias("model"), F.lit(None).cast("string").alias("model_setting"), B.actions(v).alias("actions"), B.outcomes(v).alias("outcomes"),
    )


def first_cwd(lines: DataFrame) -> DataFrame:
    """(conv_id, cwd): the first working folder that a file names."""
    found = lines.select("conv_id", "line_no", F.regexp_extract("value", r'"cwd":"([^"]*)"', 1).alias("cwd")).where("cwd <> ''")
    return found.groupBy("conv_id").agg(F.min_by("cwd", "line_no").alias("cwd"))


def prose_blocks(lines: DataFrame, strip: bool = False, after: str | None = None) -> DataFrame:
    """The lab reader: a record for each text block, numbered without holes in each file.

    ``after`` skips through the first block of that record; one that isn't there skips nothing."""
    from pyspark.sql import Window as W

    from tarn.functions.text import strip_wrappers

    v = F.col("v")
    kept = parsed_lines(lines).where(B.field(v, "$.type").isin(KEPT)).select("conv_id", "line_no", v)
    whole = F.when(B.field(v, "$.message.content").isNotNull(), F.array(B.field(v, "$.message.content")))
    texts = F.coalesce(whole, F.transform(F.filter(B.listed(v, "$.message.content"), lambda b: B.is_type(b, "text")), lambda b: B.field(b, "$.text")))
    rows = kept.select("conv_id", "line_no", B.field(v, "$.uuid").alias("src_uuid"), B.field(v, "$.parentUuid").alias("_parent"), B.field(v, "$.message.role").alias("voice"), B.field(v, "$.timestamp").alias("ts"), F.posexplode(texts).alias("block", "text"))
    rows = rows.withColumn("turn_id", F.coalesce("_parent", "src_uuid")).drop("_parent")
    rows = rows.withColumn("text", strip_wrappers(F.col("text"))) if strip else rows
    rows = rows.where("trim(text) <> ''")
    order = W.partitionBy("conv_id").orderBy("line_no", "block")
    rows = rows.withColumn("seq", F.row_number().over(order).cast("long") - 1)
    if after is not None:
        cut = F.min(F.when(F.col("src_uuid") == after, F.col("seq"))).over(W.partitionBy("conv_id"))
        rows = rows.withColumn("_cut", cut).where("_cut is null or seq > _cut").drop("_cut")
    return rows.select("conv_id", "seq", "voice", "text", "src_uuid", "turn_id", "ts")
