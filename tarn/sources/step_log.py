"""Dialect B: step logs. A step's index is its key and its order; file order means nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.model import ACTION, OUTCOME, SPAN
from tarn.sources import blocks as B
from tarn.sources.lines import parsed_lines

# Steps whose content is a tool's output; one more answers a call without being quoted.
TOOL_OUTPUT = ["RUN_COMMAND", "VIEW_FILE", "LIST_DIRECTORY", "GREP_SEARCH", "CODE_ACTION", "SEARCH_WEB", "GENERIC", "ERROR_MESSAGE"]
ANSWERS = [*TOOL_OUTPUT, "READ_URL_CONTENT"]


def rows(lines: DataFrame) -> DataFrame:
    """(conv_id, step, v, canon) of the usable lines. canon is the record with sorted keys, so equal records compare equal."""
    v = F.col("v")
    return parsed_lines(lines).select("conv_id", v, F.try_variant_get(v, "$.step_index", "bigint").alias("step")).where("step >= 0").withColumn("canon", F.to_json("v"))


def unique_steps(lines: DataFrame) -> DataFrame:
    """One row a step. Equal copies collapse; different rows under one index are an error."""
    got = rows(lines).groupBy("conv_id", "step").agg(F.min("canon").alias("canon"), F.max("canon").alias("_other"))
    clash = F.raise_error(F.concat(F.lit("conversation "), F.col("conv_id"), F.lit(": duplicate step_index "), F.col("step").cast("string"), F.lit(" with differing rows")))
    return got.select("conv_id", "step", F.when(F.col("canon") == F.col("_other"), F.col("canon")).otherwise(clash).alias("canon")).withColumn("v", F.parse_json("canon")).drop("canon")


def clashes(lines: DataFrame) -> DataFrame:
    """(conv_id, step) under which different rows stand."""
    return rows(lines).groupBy("conv_id", "step").agg(F.count_distinct("canon").alias("n")).where("n > 1").select("conv_id", "step")


def events_or_failed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, failed): one bad conversation never stops the rest; it is named with the reason."""
    bad = clashes(lines)
    failed = bad.groupBy("conv_id").agg(F.min("step").alias("step")).select("conv_id", F.concat(F.lit("duplicate step_index "), F.col("step").cast("string"), F.lit(" with differing rows")).alias("reason"))
    return events(lines.join(bad.select("conv_id").distinct(), "conv_id", "left_anti")), failed


def quality(lines: DataFrame) -> DataFrame:
    """(conv_id, malformed, duplicates, truncated, statuses, gaps). Statuses and truncations are counted before copies collapse; a row without an index counts as malformed only."""
    v = F.col("v")
    every = parsed_lines(lines).where("trim(value) <> ''").withColumn("step", F.try_variant_get(v, "$.step_index", "bigint"))
    every = every.withColumns({"ok": F.coalesce(F.col("step") >= 0, F.lit(False)), "canon": F.to_json("v"), "status": B.field(v, "$.status"), "cut": F.try_variant_get(v, "$.truncated_fields", "variant").isNotNull()})
    counts = every.groupBy("conv_id").agg(F.count_if(~F.col("ok")).alias("malformed"), F.count_if(F.col("ok") & F.col("cut")).alias("truncated"), F.count_if("ok").alias("_rows"), F.collect_set(F.when(F.col("ok"), F.col("step"))).alias("_steps"))
    seen = every.where("ok").select("conv_id", "step", "canon").distinct().groupBy("conv_id").agg(F.count("*").alias("_kept"))
    states = every.where("ok and status is not null").groupBy("conv_id", "status").count().groupBy("conv_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "count")))).alias("statuses"))
    gaps = F.when(F.size("_steps") > 0, F.array_sort(F.array_except(F.sequence(F.array_min("_steps"), F.array_max("_steps")), F.col("_steps")))).otherwise(F.array().cast("array<bigint>"))
    out = counts.join(seen, "conv_id", "left").join(states, "conv_id", "left")
    return out.select("conv_id", "malformed", (F.col("_rows") - F.coalesce("_kept", F.lit(0))).alias("duplicates"), "truncated", "statuses", gaps.alias("gaps"))


def gaps(steps: DataFrame, key: str = "conv_id", step: str = "step") -> DataFrame:
    """(key, missing): every index between the least and the largest that isn't there, from adjacent differences, so no list of steps is gathered."""
    w = W.partitionBy(key).orderBy(step)
    holes = steps.select(key, step).distinct().withColumn("_next", F.lead(step).over(w)).where(F.col("_next") > F.col(step) + 1)
    return holes.select(key, F.explode(F.sequence(F.col(step) + 1, F.col("_next") - 1)).alias("missing"))


def spine(steps: DataFrame, key: str = "conv_id", step: str = "step") -> DataFrame:
    """Adds ``parent``: the step just before, if its index is adjacent."""
    before = F.lag(step).over(W.partitionBy(key).orderBy(step))
    return steps.withColumn("parent", F.when(before + 1 == F.col(step), before))


def events(lines: DataFrame) -> DataFrame:
    steps = spine(unique_steps(lines))
    v, w = F.col("v"), W.partitionBy("conv_id").orderBy("step")
    ident = lambda step: F.concat(F.col("conv_id"), F.lit(":"), step.cast("string"))
    calls = F.try_variant_get(v, "$.tool_calls", "array<variant>")
    text = F.nullif(B.field(v, "$.content"), F.lit(""))
    s = steps.withColumns({"type": F.coalesce(B.field(v, "$.type"), F.lit("")), "calls": calls, "text": text})
    # calls wait in the order made until the next step with calls; answers take them in that order
    s = s.withColumns({"plan": F.sum(F.col("calls").isNotNull().cast("int")).over(w), "answers": F.col("calls").isNull() & F.col("type").isin(ANSWERS)})
    s = s.withColumn("nth", F.sum(F.col("answers").cast("int")).over(W.partitionBy("conv_id", "plan").orderBy("step")))
    named = F.filter(F.transform("calls", lambda c, k: F.struct(k.alias("k"), c.alias("c"))), lambda x: B.field(x["c"], "$.name").isNotNull())
    acts = F.transform(named, lambda x: B.action(F.concat(ident(F.col("step")), F.lit(":"), x["k"].cast("string")), B.field(x["c"], "$.name"), B.arguments(x["c"], "$.args")))
    s = s.withColumn("actions", F.coalesce(acts.cast(f"array<{ACTION}>"), F.array().cast(f"array<{ACTION}>")))
    queue = F.last(F.when(F.col("calls").isNotNull(), F.transform("actions", lambda a: a["id"])), ignorenulls=True).over(w)
    s = s.withColumn("call_id", F.when(F.col("answers"), F.get(queue, F.col("nth").cast("int") - 1)))
    bad = (F.col("type") == "ERROR_MESSAGE") | F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.error", "variant")) != "VOID", F.lit(False))
    done = F.when(F.col("call_id").isNotNull(), F.array(T.outcome_of(F.col("call_id"), output_of(F.coalesce(B.field(v, "$.content"), F.lit(""))), bad)))
    kind = F.when(F.col("type").isin(TOOL_OUTPUT), "tool_result").otherwise("authored")
    span = F.when(F.col("text").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"), kind.alias("kind")))).otherwise(F.array())
    setting = F.last(F.when(F.col("type") == "USER_INPUT", T.announced_setting(F.col("text"))), ignorenulls=True).over(w)
    return s.select(
        F.lit("steps").alias("source"), "conv_id", F.col("step").alias("pos"), ident(F.col("step")).alias("event_id"), ident(F.col("parent")).alias("parent_id"),
        F.coalesce(B.field(v, "$.source"), F.lit("")).alias("role"), B.field(v, "$.created_at").alias("timestamp"), "text", span.cast(f"array<{SPAN}>").alias("text_provenance"),
        F.nullif(B.field(v, "$.thinking"), F.lit("")).alias("thinking"), F.lit(None).cast("string").alias("model"), setting.alias("model_setting"), "actions",
        F.coalesce(done.cast(f"array<{OUTCOME}>"), F.array().cast(f"array<{OUTCOME}>")).alias("outcomes"),
    )


def output_of(content):
    """A tool's own output: after the ``Output:`` line, else after the first blank line, else all."""
    return F.when(content.contains("Output:"), F.regexp_replace(content, r"(?s)^.*?Output:", "")).when(content.contains("\n\n"), F.regexp_replace(content, r"(?s)^.*?\n\n", "")).otherwise(content)


def call_links(lines: DataFrame) -> DataFrame:
    """(conv_id, name, at_step, result_step): a result only where a step made exactly one call and the next index is there and is a tool's output."""
    v, w = F.col("v"), W.partitionBy("conv_id").orderBy("step")
    s = rows(lines).groupBy("conv_id", "step").agg(F.max("canon").alias("c")).withColumn("v", F.parse_json("c"))
    s = s.select("conv_id", "step", B.listed(v, "$.tool_calls").alias("calls"), F.coalesce(B.field(v, "$.type"), F.lit("")).alias("type"))
    s = s.withColumns({"n": F.lead("step").over(w), "nt": F.lead("type").over(w)})
    clear = (F.size("calls") == 1) & (F.col("n") == F.col("step") + 1) & F.col("nt").isin(TOOL_OUTPUT)
    return s.select("conv_id", F.explode("calls").alias("c"), F.col("step").alias("at_step"), F.when(clear, F.col("n")).alias("result_step")).select("conv_id", F.coalesce(B.field(F.col("c"), "$.name"), F.lit("")).alias("name"), "at_step", "result_step")
