"""Readers: they look at events and record findings with byte spans."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn import model as M
from tarn.functions import text as T


class Reader(Protocol):
    """Records in, findings out."""

    name: str

    def read(self, events: DataFrame) -> DataFrame: ...


def text_leg(v: Column) -> Column:
    return F.struct(F.lit(M.TEXT_TAG).cast("tinyint").alias("tag"), v.cast("string").alias("lex"))


def int_leg(v: Column) -> Column:
    return F.struct(F.lit(M.INT_TAG).cast("tinyint").alias("tag"), v.cast("string").alias("lex"))


def decimal_leg(v: Column) -> Column:
    return F.struct(F.lit(M.DECIMAL_TAG).cast("tinyint").alias("tag"), v.cast("string").alias("lex"))


def signal(**legs: Column) -> Column:
    """A signal map; null values are left out."""
    every = F.map_from_arrays(F.array(*map(F.lit, sorted(legs))), F.array(*(legs[k] for k in sorted(legs))))
    return F.map_filter(every, lambda k, v: v["lex"].isNotNull())


# ASCII white space around labels and tildes; labels in either case; a payload has no closing bracket
_WS = r"[ \t\n\r]*"
_SEGMENT = lambda label: rf"\[{_WS}{label}{_WS}\|([^\]]*)\]"
KEY = "(?i)" + rf"{_WS}~{_WS}".join(_SEGMENT(x) for x in ("ME", "CONTENT", "YOU"))


class EmojiKeys:
    """Inline keys ``[ME|..]~[CONTENT|..]~[YOU|..]``, not overlapping, with their places in bytes."""

    name = "emojikey"

    def read(self, events: DataFrame) -> DataFrame:
        text = F.col("text")
        gaps, found = F.split(text, KEY, -1), F.regexp_extract_all(text, F.lit(KEY), 0)
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,raw:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            s = a["at"] + F.octet_length(x["g"])
            e = s + F.octet_length(x["m"])
            return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["m"].alias("raw")))).alias("out"))

        keys = F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")), start, step)["out"]
        rows = events.where(text.contains("~")).select("*", F.explode(keys).alias("k")).select("*", "k.start", "k.end", "k.raw")
        leg = lambda i: text_leg(T.trimmed(F.regexp_extract("raw", "(?s)" + KEY, i)))
        made = signal(raw=text_leg(F.col("raw")), me=leg(1), content=leg(2), you=leg(3), voice=text_leg(F.col("role")))
        return rows.select(F.lit(self.name).alias("reader"), F.lit("emojikey/harvest").alias("event_type"), F.col("timestamp").alias("ts"), "event_id", "start", "end", T.source_kind_at(F.col("text_provenance"), F.col("start")).alias("source_kind"), made.alias("signal"), "conv_id")


class Cadence:
    """Structure and rhythm of each record: words, questions, code, and time and voice against the record before."""

    name = "cadence"

    def facts(self, records: DataFrame, key: str = "conv_id") -> DataFrame:
        """Adds the facts to (key, seq, voice, text, ts). Latency counts from the last known time; an unknown one stays null."""
        w = W.partitionBy(key).orderBy("seq")
        at = F.try_to_timestamp(F.col("ts")).cast("double")
        r = records.withColumn("_at", at)
        known = F.last("_at", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
        before = F.lag("voice").over(w)
        return r.withColumns(
            {
                "words": T.word_count(F.col("text")), "chars": F.length("text").cast("long"), "question_density": F.bround(T.question_density(F.col("text")), 4), "code_ratio": F.bround(T.code_ratio(F.col("text")), 4),
                "latency_s": F.col("_at") - known, "voice_switch": F.coalesce(F.col("voice") != before, F.lit(False)), "prev_seq": F.lag("seq").over(w),
            }
        ).drop("_at")

    def read(self, events: DataFrame) -> DataFrame:
        r = self.facts(events.select("conv_id", "event_id", F.col("pos").alias("seq"), F.col("role").alias("voice"), F.coalesce("text", F.lit("")).alias("text"), F.col("timestamp").alias("ts")))
        made = signal(voice=text_leg(F.col("voice")), words=int_leg(F.col("words")), chars=int_leg(F.col("chars")), question_density=decimal_leg(F.col("question_density")), code_ratio=decimal_leg(F.col("code_ratio")), latency_s=decimal_leg(F.col("latency_s")), voice_switch=text_leg(F.col("voice_switch")))
        return r.select(F.lit(self.name).alias("reader"), F.lit("rhythm/turn").alias("event_type"), "ts", "event_id", F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"), F.lit(None).cast("string").alias("source_kind"), made.alias("signal"), "conv_id")
