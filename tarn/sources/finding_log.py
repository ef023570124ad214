"""Logs of findings that lab readers write: a JSON envelope (reader, event_type, ts, anchor, evidence, signal) a line."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn import model as M
from tarn.operators.project import iri, lit, quads, triple_term
from tarn.sources import blocks as B
from tarn.sources.lines import parsed_lines

VALUES = "map<string,variant>"


def scan(lines: DataFrame, reader: str | None = None, ending: str = "") -> DataFrame:
    """(conv_id, line_no, reader, event_type, ts, anchor, seqs, signal, value). Rows of the reader ``render`` are views and go; torn lines too. ``ending`` is what a log's name has after its transcript's."""
    v = F.col("v")
    rows = parsed_lines(lines).where(B.field(v, "$.reader").isNotNull()).withColumn("reader", B.field(v, "$.reader")).where("reader <> 'render'")
    rows = rows if reader is None else rows.where(F.col("reader") == reader)
    empty = F.create_map().cast(VALUES)
    one, many = F.try_variant_get(v, "$.evidence.seq", "bigint"), F.try_variant_get(v, "$.evidence.seqs", "array<bigint>")
    seqs = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<bigint>"))
    return rows.select(
        (F.when(F.col("conv_id").endswith(ending), F.substring("conv_id", F.lit(1), F.length("conv_id") - len(ending))).otherwise(F.col("conv_id")) if ending else F.col("conv_id")).alias("conv_id"), "line_no", "reader", B.field(v, "$.event_type").alias("event_type"), F.nullif(B.field(v, "$.ts"), F.lit("")).alias("ts"),
        F.coalesce(F.try_variant_get(v, "$.anchor", VALUES), empty).alias("anchor"), seqs.alias("seqs"), F.try_variant_get(v, "$.signal", "variant").alias("signal"), "value",
    )


@F.pandas_udf("string")
def canonical_hash(transcript: pd.Series, value: pd.Series) -> pd.Series:
    """16 hex digits of the SHA-1 over the row's identity as JSON with sorted keys; key order in the log doesn't matter."""

    def one(t: str, line: str) -> str:
        o = json.loads(line)
        parts = (t, o["reader"], o.get("event_type", ""), o.get("anchor", {}), o.get("signal"))
        return hashlib.sha1(json.dumps(parts, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]

    return pd.Series([one(t, x) for t, x in zip(transcript, value, strict=True)])


def _said(x: Column) -> Column:
    """A value's text, null for JSON null."""
    return F.when(F.schema_of_variant(x) != "VOID", F.try_variant_get(x, "$", "string"))


def subject(transcript: Column, anchor: Column) -> tuple[Column, Column]:
    """(address, note): what a finding is about: its record, else its turn, else its place, else the transcript. A note says which identity was there but empty."""
    value = lambda k: F.nullif(F.trim(_said(anchor[k])), F.lit(""))
    hollow = F.filter(F.array(*(F.when(F.map_contains_key(anchor, k) & value(k).isNull(), F.lit(k)) for k in ("src_uuid", "turn_id"))), lambda x: x.isNotNull())
    because = F.when(F.size(hollow) > 0, F.concat(F.lit(" ("), F.array_join(hollow, " and "), F.lit(" was empty)")))
    at = lambda kind, x: F.concat(transcript, F.lit(f"/{kind}/"), x)
    placed = F.map_contains_key(anchor, F.lit("seq"))
    address = F.when(value("src_uuid").isNotNull(), at("event", value("src_uuid"))).when(value("turn_id").isNotNull(), at("event", value("turn_id"))).when(placed, at("seq", _said(anchor["seq"]))).otherwise(transcript)
    found = F.when(value("src_uuid").isNotNull(), F.lit(None)).when(value("turn_id").isNotNull(), "turn_id").when(placed, "seq").otherwise("transcript")
    return address, F.concat(found, because)


def triples(rows: DataFrame) -> DataFrame:
    """Quads of the findings, each triple once in its transcript's graph. Null legs give nothing; confidence and version go to the claim too."""
    c = F.col
    r = rows.withColumn("_h", canonical_hash(c("conv_id"), c("value"))).drop("value")
    node = lambda kind, end="": F.concat(F.lit(f"{M.NAMES.base}{kind}/"), c("_h"), F.lit(end))
    ann, target, selector, body, claim = node("ann"), node("ann", "/target"), node("ann", "/selector"), node("ann", "/body"), node("claim")
    detector, transcript = F.concat(F.lit(f"{M.NAMES.base}detector/"), c("reader")), F.concat(F.lit(f"{M.NAMES.base}transcript/"), c("conv_id"))
    place = lambda k: F.try_variant_get(c("anchor")[k], "$", "bigint").cast("string")
    spanned = place("start").isNotNull() & place("end").isNotNull()
    about, note = subject(transcript, c("anchor"))
    kind = F.nullif(c("event_type"), F.lit(""))
    legs = F.coalesce(F.try_variant_get(c("signal"), "$", VALUES), F.create_map().cast(VALUES))
    decimal = lambda x: F.try_variant_get(x, "$", "double").cast("string")
    fixed = [
        (detector, M.TYPE, iri(F.lit(M.PROV + "SoftwareAgent"))), (detector, M.V("readerName"), lit(c("reader"))), (ann, M.TYPE, iri(F.lit(M.OA + "Annotation"))), (ann, M.PROV + "wasAttributedTo", iri(detector)),
        (ann, M.V("eventType"), lit(kind)), (ann, M.PROV + "generatedAtTime", lit(c("ts"), M.DATETIME)), (ann, M.OA + "hasTarget", iri(target)), (target, M.OA + "hasSource", iri(transcript)),
        (target, M.OA + "hasSelector", iri(F.when(spanned, selector))), (selector, M.TYPE, iri(F.when(spanned, F.lit(M.OA + "TextPositionSelector")))), (selector, M.OA + "start", lit(F.when(spanned, place("start")), M.INTEGER)), (selector, M.OA + "end", lit(F.when(spanned, place("end")), M.INTEGER)),
        (target, M.V("seq"), lit(place("seq"), M.INTEGER)), (target, M.V("srcUuid"), lit(F.nullif(_said(c("anchor")["src_uuid"]), F.lit("")))), (target, M.V("turnId"), lit(F.nullif(_said(c("anchor")["turn_id"]), F.lit("")))), (ann, M.OA + "hasBody", iri(body)),
        (claim, M.REIFIES, triple_term(about, F.lit(M.V("exhibits")), F.coalesce(kind, F.lit("signal")))), (claim, M.PROV + "wasDerivedFrom", iri(ann)), (claim, M.V("resolvedBy"), lit(note)), (claim, M.V("detector"), lit(c("reader"))), (claim, M.V("detectionType"), lit(kind)),
        (claim, M.V("confidence"), lit(decimal(legs["confidence"]), M.DECIMAL)), (claim, M.V("detectorVersion"), lit(_said(legs["version"]))),
    ]
    g = F.concat(F.lit(f"{M.NAMES.root}graph/NamedGraph/"), M.mangled(c("conv_id")))
    used = quads(r.select("conv_id", "_h", F.explode("seqs").alias("n")), g, [(ann, M.PROV + "used", iri(F.concat(transcript, F.lit("/seq/"), c("n").cast("string"))))])
    each = r.select(g.alias("g"), body.alias("s"), F.explode(legs).alias("k", "x")).where(F.schema_of_variant("x") != "VOID")
    shape = F.schema_of_variant("x")
    dt = F.when(shape == "BOOLEAN", M.BOOLEAN).when(shape == "BIGINT", M.INTEGER).when(shape.startswith("DECIMAL") | (shape == "DOUBLE"), M.DECIMAL).otherwise(M.STRING)
    signals = each.select("g", "s", F.concat(F.lit(M.V("sig_")), F.regexp_replace("k", r"(?U)[^\p{Alnum}]", "_")).alias("p"), F.lit("lit").alias("o_kind"), _said(c("x")).alias("o"), dt.alias("dt"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("struct<s:string,p:string,o:string>").alias("tt"))
    return quads(r, g, fixed).unionByName(used).unionByName(signals).dropDuplicates(M.QUAD_COLUMNS)


def append(rows: DataFrame, path: str) -> None:
    """Adds findings (JSON lines in ``value``) to a log folder in one write."""
    rows.select("value").write.mode("append").text(path)
