"""Message content as blocks: texts with byte spans, thinking, tool calls and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.model import ACTION, OUTCOME, SPAN

PIECES = "array<struct<kind:string,t:string>>"


def field(v: Column, path: str, kind: str = "string") -> Column:
    """A value of exactly this kind, else null. Numbers and arrays aren't taken for strings."""
    got = F.try_variant_get(v, path, kind)
    if kind != "string":
        return got
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", got)


def listed(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def is_type(b: Column, name: str) -> Column:
    return F.coalesce(field(b, "$.type") == name, F.lit(False))


def result_text(block: Column, path: str = "$.content") -> Column:
    """A tool result's text: a string, or its text blocks by line; images give nothing."""
    parts = F.filter(F.transform(F.filter(listed(block, path), lambda x: is_type(x, "text")), lambda x: field(x, "$.text")), lambda t: t.isNotNull())
    return F.coalesce(field(block, path), F.when(F.size(parts) > 0, F.array_join(parts, "\n")))


def joined(pieces: Column) -> Column:
    """(text, spans) of non-empty pieces, joined by line ends that belong to no span. Spans are in bytes."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.octet_length(x["t"])
        span = F.struct(a["at"].alias("start"), end.alias("end"), x["kind"].alias("kind"))
        return F.struct((end + 1).alias("at"), F.concat(a["spans"], F.array(span)).cast(f"array<{SPAN}>").alias("spans"))

    own = F.filter(pieces, lambda x: F.coalesce(x["t"] != "", F.lit(False)))
    text = F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda x: x["t"]), "\n"))
    return F.struct(text.alias("text"), F.aggregate(own, start, step)["spans"].alias("spans"))


def piece(kind: str, t: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), t.alias("t"))


def message_text(v: Column, content: str = "$.message.content") -> Column:
    whole = F.when(field(v, content).isNotNull(), F.array(piece("authored", field(v, content))).cast(PIECES))
    blocks = F.transform(listed(v, content), lambda b: F.when(is_type(b, "text"), piece("authored", field(b, "$.text"))).when(is_type(b, "tool_result"), piece("tool_result", result_text(b))))
    return joined(F.coalesce(whole, F.filter(blocks, lambda x: x.isNotNull()).cast(PIECES)))


def thinking(v: Column, content: str = "$.message.content") -> Column:
    parts = F.filter(F.transform(F.filter(listed(v, content), lambda b: is_type(b, "thinking")), lambda b: field(b, "$.thinking")), lambda t: F.coalesce(t != "", F.lit(False)))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))


def reported_model(v: Column) -> Column:
    m = field(v, "$.message.model")
    return F.when((m != "") & (m != "<synthetic>"), m)


def arguments(v: Column, path: str) -> Column:
    """The string-valued arguments of a call."""
    every = F.coalesce(F.try_variant_get(v, path, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.transform_values(F.map_filter(every, lambda k, x: F.schema_of_variant(x) == "STRING"), lambda k, x: F.try_variant_get(x, "$", "string"))


def action(ident: Column, name: Column, args: Column) -> Column:
    kind, target = T.action_kind(name), T.action_target(args)
    other = F.trim(F.concat(name, F.lit(" "), target))
    return F.struct(ident.alias("id"), kind.alias("kind"), F.when(kind == "other", other).otherwise(target).alias("target"))


def actions(v: Column, content: str = "$.message.content") -> Column:
    calls = F.filter(listed(v, content), lambda b: is_type(b, "tool_use") & field(b, "$.name").isNotNull())
    return F.transform(calls, lambda b: action(F.coalesce(field(b, "$.id"), F.lit("")), field(b, "$.name"), arguments(b, "$.input"))).cast(f"array<{ACTION}>")


def outcomes(v: Column, content: str = "$.message.content") -> Column:
    done = F.filter(listed(v, content), lambda b: is_type(b, "tool_result") & field(b, "$.tool_use_id").isNotNull())
    failed = lambda b: F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False))
    return F.transform(done, lambda b: T.outcome_of(field(b, "$.tool_use_id"), F.coalesce(result_text(b), F.lit("")), failed(b))).cast(f"array<{OUTCOME}>")
