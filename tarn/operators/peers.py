"""Joins in time: who sent what, which file a message came from, and values as of a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T

BEFORE, AFTER, SPAWN_BEFORE = 30 * 60, 60, 10 * 60
KEY, LEAST = 120, 20


def interval_join(left: DataFrame, right: DataFrame, before: int, after: int, on: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Pairs with right.ts from left.ts - before to left.ts + after, both ends included. Columns of ``right`` other than ``on`` must differ from ``left``'s; its time is ``rts``.

    Times go to buckets as wide as the interval, and a left row visits the two or three buckets its interval meets: an equi-join, whatever the interval."""
    width = width or before + after
    low, high = F.floor((F.col("ts") - before) / width), F.floor((F.col("ts") + after) / width)
    l = left.withColumn("_bucket", F.explode(F.sequence(low, high)))
    r = right.withColumn("_bucket", F.floor(F.col("rts") / width))
    return l.join(r, ["_bucket", *(on or [])]).where(F.col("rts").between(F.col("ts") - before, F.col("ts") + after)).drop("_bucket")


def senders(turns: DataFrame, sends: DataFrame) -> DataFrame:
    """(id, kind, peer) of the turns (id, receiver, ts, text) that a peer's send (sender, rts, ord, flat, spawn) explains: whole, leading or embedded.

    The latest send that holds the turn's opening wins; only if there is none, the latest one that the turn holds. Equal times go to the later row."""
    t = turns.withColumn("all", T.flat(F.col("text"))).withColumn("key", F.substring("all", 1, KEY)).where(F.length("key") >= LEAST)
    near = interval_join(t, sends.where("not spawn"), BEFORE, AFTER).where("sender <> receiver").withColumn("head", F.substring("flat", 1, KEY))
    first = F.col("flat").contains(F.col("key"))
    at = F.when(F.length("head") >= 2 * LEAST, F.expr("locate(head, `all`)"))
    kind = F.when(F.col("flat").contains(F.col("all")), "whole")
    hits = near.withColumns({"tier": F.when(first, 1).when(at > 0, 2), "kind": F.when(first, F.coalesce(kind, F.lit("leading"))).when(at > 1, "embedded").otherwise(F.coalesce(kind, F.lit("leading")))}).where("tier is not null")
    best = hits.groupBy("id").agg(F.max(F.struct(-F.col("tier"), "rts", "ord", "kind", "sender")).alias("b"))
    return best.select("id", "b.kind", F.col("b.sender").alias("peer"))


def spawned(openings: DataFrame, sends: DataFrame) -> DataFrame:
    """Ids of the first inputs (id, me, ts, text) that their own sender opened a helper with just before."""
    t = openings.withColumn("key", F.substring(T.flat(F.col("text")), 1, KEY)).where(F.length("key") >= LEAST)
    own = sends.where("spawn").withColumnRenamed("sender", "me")
    return interval_join(t, own, SPAWN_BEFORE, AFTER, on=["me"]).where(F.col("flat").contains(F.col("key"))).select("id").distinct()


def as_of(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` (key, ts) with the value of the last row of ``right`` (key, rts, ord, value) at or before ts; equal times take the later row; none is null.

    One sort by time carries values forward, so no pairs are made."""
    from pyspark.sql import Window as W

    l = left.withColumns({"_side": F.lit(1), "_t": F.col("ts"), "_o": F.lit(None).cast("long"), "_v": F.lit(None).cast(right.schema[value].dataType)})
    r = right.select(F.col(key), F.col("rts").alias("_t"), F.col("ord").cast("long").alias("_o"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = W.partitionBy(key).orderBy("_t", "_side", F.asc_nulls_first("_o")).rowsBetween(W.unboundedPreceding, 0)
    boxed = F.when(F.col("_side") == 0, F.struct(F.col("_v").alias("v")))
    out = l.unionByName(r, allowMissingColumns=True).withColumn("_last", F.last(boxed, ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, F.col("_last.v").alias(value))


HEREDOC = r"""cat > (\S+)[^\n]*<<-?\s*['"]?([A-Za-z_][\w]*)['"]?[^\n]*\n([\s\S]*?)(?:\n\2|$)"""


def heredocs(cmd: Column) -> Column:
    """(path, body) of the files a shell command writes inline."""
    each = F.regexp_extract_all(cmd, F.lit(HEREDOC), 0)
    part = lambda x, k: F.regexp_extract(x, HEREDOC, k)
    return F.transform(each, lambda x: F.struct(F.regexp_replace(part(x, 1), "^['\"]+|['\"]+$", "").alias("path"), part(x, 3).alias("body")))


def cat_path(cmd: Column) -> Column:
    """The file that a command sends with ``$(cat file)``."""
    return F.nullif(F.regexp_replace(T.trimmed(F.regexp_extract(cmd, r"\$\(cat ([^)]*)\)", 1)), "^['\"]+|['\"]+$", ""), F.lit(""))


def body_of(cmd: Column, call: str) -> Column:
    """What follows the target of a sending command; the whole command if it doesn't send."""
    import re

    return F.when(cmd.contains(call), F.regexp_replace(cmd, rf"(?s)^.*?{re.escape(call)}\s*\S*\s*", "")).otherwise(cmd)
