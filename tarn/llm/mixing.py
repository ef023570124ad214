"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked until their sums match a target share for every
value of each of the three. A document's probability is the budget times its cell's fitted weight over the
cell's tokens; above 1 its whole part gives repeats, and the rest is drawn by a hash of doc_id, so a run can be
repeated. Fitting works on the table of cells, never on documents: on the driver for at most DRIVER_CELLS cells, by
joins with the sums of each dimension beyond that; both give the same weights. What is left of each margin's error after
ROUNDS rounds is told (``margin_errors``).

Where a table has no ``topic``, a text's topic is the topic term that it has most of. A term is a stem, the first STEM characters
of a longer word; topic terms are the TERMS stems, of all texts, that the most documents have, of those that at most a share
TERM_SHARE of documents has.

Null dimensions, and those that a table lacks, are a value of their own (empty text), as is the topic of a text without a
topic term; null texts have no tokens. Cells without tokens keep weight 0 and their documents have probability 0. Repeated
rows share their draw; long texts are read whole; an empty table gives no rows; other columns of any name don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm import common

DIMS = ("source", "lang", "topic")
#: Target shares: in proportion to tokens to this power (1: as they are, 0: all alike).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.0}
ROUNDS, BUDGET, SEED = 15, 0.5, "mix-1"
TERMS, TERM_SHARE, STEM = 16, 0.1, 4
SPACE, INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
DRIVER_CELLS = 50_000


def topic_terms(docs: DataFrame, terms: int = TERMS, share: float = TERM_SHARE) -> list[str]:
    """The stems that the most documents have, of those that at most ``share`` of them has, over every text; ties in the order of the stems. The driver gets ``terms`` stems."""
    stems = F.regexp_extract_all(common.text_of("text"), F.lit(f"(?:^|{SPACE})({INK}{{{STEM}}}){INK}"), 1)
    each = docs.select(F.explode(F.array_distinct(stems)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in each.where(F.col("n") <= F.lit(share) * docs.count()).orderBy(F.desc("n"), "w").limit(terms).collect()]


def topic_of(text: Column, terms: list[str]) -> Column:
    """The term that most words of the text start with, the first of equals; empty without any."""
    if not terms:
        return F.lit("")
    known = F.array(*map(F.lit, terms))

    def most(hits: Column) -> Column:
        counts = F.transform(known, lambda t: F.size(F.filter(hits, lambda h: h == t)))
        return F.when(F.size(hits) == 0, F.lit("")).otherwise(common.let(counts, lambda c: F.element_at(known, F.array_position(c, F.array_max(c)).cast("int"))))

    return common.let(F.regexp_extract_all(text, F.lit(f"(?:^|{SPACE})({'|'.join(map(re.escape, terms))})(?={INK})"), 1), most)


def described(docs: DataFrame) -> DataFrame:
    """Adds the dimensions without nulls (``_source``...) and ``n_tokens``."""
    t, terms = common.text_of("text"), [] if "topic" in docs.columns else topic_terms(docs)
    dims = {f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("")) if d in docs.columns else topic_of(t, terms) if d == "topic" else F.lit("") for d in DIMS}
    return docs.withColumns(dims | {"n_tokens": F.regexp_count(t, F.lit(f"{INK}+")).cast("long")})


def fitted(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Adds ``weight``, of sum 1, to the written cells of (dimensions, tokens)."""
    filled = cells.where("tokens > 0")
    return _fitted_here(filled, powers, rounds) if filled.limit(driver_cells + 1).count() <= driver_cells else _fitted_there(filled, powers, rounds)


def _fitted_here(cells: DataFrame, powers: dict[str, float], rounds: int) -> DataFrame:
    import numpy as np

    got = cells.orderBy(*(f"_{d}" for d in powers)).toPandas()
    tokens = got["tokens"].to_numpy(float)
    weight, steps = tokens.copy(), []
    for d in powers:
        _, code = np.unique(got[f"_{d}"].to_numpy(str), return_inverse=True)
        target = np.bincount(code, tokens) ** powers[d]
        steps.append((code, target / target.sum()))
    for _ in range(rounds):
        for code, share in steps:
            weight *= (share / np.bincount(code, weight))[code]
    rows = got.assign(weight=weight)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", weight double"
    return cells.sparkSession.createDataFrame(rows, schema)


def _fitted_there(cells: DataFrame, powers: dict[str, float], rounds: int) -> DataFrame:
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in powers:  # a value's share is its power over the sum of the powers of all values
        by_value = common.stored(cells.groupBy(f"_{d}").agg(F.pow(F.sum("tokens").cast("double"), F.lit(powers[d])).alias("m")), "margin")
        whole = by_value.agg(F.coalesce(F.sum("m"), F.lit(1.0))).first()[0]
        out = out.join(by_value.select(f"_{d}", (F.col("m") / F.lit(whole)).alias(f"_m{d}")), f"_{d}")
    last = None
    for _ in range(rounds):
        for d in powers:
            sums = out.groupBy(f"_{d}").agg(F.sum("weight").alias("_t"))
            out = out.join(sums, f"_{d}").withColumn("weight", F.col("weight") * F.col(f"_m{d}") / F.col("_t")).drop("_t")
        out = common.stored(out, "fitting")
        if last is not None:
            common.discard(last)
        last = out
    return out.select(*cells.columns, "weight")


def margin_errors(fit: DataFrame, powers: dict[str, float] = POWERS) -> dict[str, float]:
    """What is left of each margin's error in fitted cells: the largest difference, over its values, between the share of the weights and the target share."""
    out = {}
    for d in powers:
        by_value = fit.groupBy(f"_{d}").agg(F.pow(F.sum("tokens").cast("double"), F.lit(powers[d])).alias("m"), F.sum("weight").alias("w"))
        whole = by_value.agg(F.sum("m").alias("m"), F.sum("w").alias("w")).first()
        worst = by_value.agg(F.max(F.abs(F.col("w") / F.lit(whole["w"]) - F.col("m") / F.lit(whole["m"])))).first()[0] if whole["m"] else 0.0
        out[d] = worst or 0.0
    return out


def probabilities(described_docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] = POWERS) -> DataFrame:
    """(dimensions, weight, prob, margin_error) of each cell: prob times tokens, over all cells, is the budget share of all tokens; margin_error is the largest of ``margin_errors``."""
    keys = [f"_{d}" for d in DIMS]
    cells = common.stored(described_docs.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "cells")
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    prob = F.round(F.lit(budget * total) * F.col("weight") / F.col("tokens"), 6)
    fit = common.stored(fitted(cells, powers), "fitted")
    worst = round(max(margin_errors(fit, powers).values()), 6)
    return common.stored(fit.select(*keys, F.round("weight", 9).alias("weight"), prob.alias("prob"), F.lit(worst).alias("margin_error")), "mix")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 by the md5 of doc_id and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(prob: Column, doc_id: Column) -> Column:
    return (F.floor(prob) + F.when(draw(doc_id) < prob - F.floor(prob), 1).otherwise(0)).cast("int")


def pipeline_stage(docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] = POWERS) -> DataFrame:
    """Documents drawn once at most, with probability min(1, prob)."""
    own = common.stored(described(common.wrapped(docs, "doc_id", "text", *(d for d in DIMS if d in docs.columns))).drop("text"), "described")
    mix = probabilities(own, budget, powers)
    kept = own.join(mix, [f"_{d}" for d in DIMS]).where(draw(F.col("doc_id")) < F.col("prob"))
    return common.unwrapped(kept, docs.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    own = common.stored(described(common.table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", *(f"_{d}" for d in DIMS)), "described")
    out = own.join(probabilities(own), [f"_{d}" for d in DIMS], "left")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("doc_id", *(F.col(f"_{d}").alias(d) for d in DIMS), "n_tokens", none("weight").alias("cell_weight"), none("prob").alias("prob"), copies(none("prob"), F.col("doc_id")).alias("copies"), none("margin_error").alias("margin_error"))


def _sql() -> str:
    part = ", ".join(DIMS)
    steps, last = [], "r0"
    for k in range(ROUNDS):
        for d in DIMS:
            steps.append(f"r{k}{d} as (select * replace (weight * m{d} / t{d} / sum(weight) over (partition by {d}) as weight) from {last})")
            last = f"r{k}{d}"
    errors = " union all ".join(f"select max(abs(s / (select sum(weight) from {last}) - m / t)) x from (select sum(weight) s, any_value(m{d}) m, any_value(t{d}) t from {last} group by {d})" for d in DIMS)
    return f"""
with d as (select row_number() over () rid, doc_id, coalesce(source, '') source, coalesce(lang, '') lang, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
x as (select rid, left(w, {STEM}) w from (select rid, unnest(ws) w from d) where length(w) > {STEM}),
terms as (select w, row_number() over (order by n desc, w) place from (select w, count(distinct rid) n from x group by w) where n <= {TERM_SHARE}::double * (select count(*) from d) order by n desc, w limit {TERMS}),
topics as (select rid, first(w order by k desc, place) topic from (select rid, w, place, count(*) k from x join terms using (w) group by all) group by rid),
o as (select doc_id, source, lang, coalesce(topic, '') topic, len(ws)::bigint n_tokens from d left join topics using (rid)),
cells as (select {part}, sum(n_tokens)::bigint tokens from o group by all having sum(n_tokens) > 0),
{", ".join(f"p{d} as (select {d}, pow(sum(tokens)::double, {POWERS[d]}::double) m{d} from cells group by {d})" for d in DIMS)},
r0 as (select cells.*, tokens::double weight, {", ".join(f"m{d}, (select sum(m{d}) from p{d}) t{d}" for d in DIMS)} from cells {" ".join(f"join p{d} using ({d})" for d in DIMS)}),
{", ".join(steps)},
err as (select round(max(x), 6) margin_error from ({errors})),
w as (select {part}, round(weight, 9) cell_weight, round({BUDGET}::double * (select sum(n_tokens) from o)::double * weight / tokens, 6) prob, (select margin_error from err) margin_error from {last}),
f as (select o.*, coalesce(cell_weight, 0) cell_weight, coalesce(prob, 0) prob, coalesce(margin_error, 0) margin_error, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{SEED}'), 1, 8))::bigint / 4294967296.0::double u from o left join w using ({part}))
select doc_id, {part}, n_tokens, cell_weight, prob, (floor(prob) + case when u < prob - floor(prob) then 1 else 0 end)::int copies, margin_error from f"""


OP1_SQL = _sql()
