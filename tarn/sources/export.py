"""Dialect C: conversation exports, whole JSON documents. The newest version of each conversation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.model import ACTION, OUTCOME
from tarn.sources import blocks as B


CONVERSATION = "uuid string, name string, created_at string, updated_at string, chat_messages array<variant>"


def read(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """(export, uuid, v, version_key) of every conversation in the export folders.

    A file is parsed message by message under CONVERSATION, not as one value, so only a single message is bounded (128 MiB)."""
    parts = [spark.read.schema(CONVERSATION).option("multiLine", True).json(f"{d.rstrip('/')}/conversations.json").withColumn("export", F.lit(d.rstrip("/").rsplit("/", 1)[-1])) for d in dirs]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    own = F.to_variant_object(F.struct("uuid", "name", "created_at", "updated_at", "chat_messages"))
    return every.select("export", "uuid", own.alias("v"), version_key(F.col("updated_at"), F.coalesce(F.size("chat_messages"), F.lit(0))).alias("version_key"))


def version_key(updated_at: Column, messages: Column) -> Column:
    return F.concat(F.coalesce(updated_at, F.lit("")), F.lit("|"), F.lpad(messages.cast("string"), 6, "0"))


def newest(versions: DataFrame, key: str = "uuid", version: str = "version_key", tie: str = "export") -> DataFrame:
    """The row with the largest version of each key; of equals the first by ``tie``. What is gone upstream stays."""
    w = W.partitionBy(key).orderBy(F.desc(version), F.asc(tie))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def events(conversations: DataFrame) -> DataFrame:
    """Messages in their order; each one's parent is the one before."""
    m, w = F.col("m"), W.partitionBy("conv_id").orderBy("pos")
    rows = conversations.select(F.col("uuid").alias("conv_id"), F.posexplode(B.listed(F.col("v"), "$.chat_messages")).alias("pos", "m"))
    blocks = F.transform(B.listed(m, "$.content"), lambda b: F.when(B.is_type(b, "text") | B.is_type(b, "voice_note"), B.piece("authored", B.field(b, "$.text"))).when(B.is_type(b, "tool_result"), B.piece("tool_result", B.result_text(b))))
    blocks = F.filter(blocks, lambda x: F.coalesce(x["t"] != "", F.lit(False))).cast(B.PIECES)
    flat = F.when(F.size(B.listed(m, "$.content")) > 0, blocks).otherwise(F.array(B.piece("authored", B.field(m, "$.text"))).cast(B.PIECES))
    attached = F.transform(B.listed(m, "$.attachments"), lambda a: B.piece("tool_result", F.concat(F.lit("[attachment: "), F.coalesce(B.field(a, "$.file_name"), F.lit("")), F.lit("]\n"), F.coalesce(B.field(a, "$.extracted_content"), F.lit("")))))
    rows = rows.withColumns({"t": B.joined(F.concat(flat, attached.cast(B.PIECES))), "event_id": B.field(m, "$.uuid")})
    sender = B.field(m, "$.sender")
    return rows.select(
        F.lit("export").alias("source"), "conv_id", F.col("pos").cast("long").alias("pos"), "event_id", F.lag("event_id").over(w).alias("parent_id"), F.when(sender == "human", "user").otherwise(sender).alias("role"),
        F.nullif(B.field(m, "$.created_at"), F.lit("")).alias("timestamp"), "t.text", F.col("t.spans").alias("text_provenance"), B.thinking(m, "$.content").alias("thinking"), F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("model_setting"), F.array().cast(f"array<{ACTION}>").alias("actions"), F.array().cast(f"array<{OUTCOME}>").alias("outcomes"),
    )
