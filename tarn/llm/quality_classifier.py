"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Features are the hashed one- and two-word n-grams of a text, as shares of its n-grams. A document's score is
the sparse dot product of its features with the weights, computed in its own row; the weights are an array of
BUCKETS numbers, however large the corpus. Training uses at most SAMPLE labelled documents of each class, those
with the least hash of doc_id; the driver gets each one's counts of buckets, so no more than BUCKETS numbers however long the text.
Null and empty texts score the bias alone. Without labels every score is 0.5. Of repeated labels the larger quality counts, of
repeated rows of a labelled doc_id the text with the greatest features; every row is scored. An empty table gives no rows. A column
``score`` of the table is replaced by the operator's (the pipeline's stage keeps the table's own).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common

BUCKETS, SAMPLE, EPOCHS, SCALE = 1 << 15, 1500, 4, 24.0
ALPHA, BETA, L1, L2 = 0.4, 1.0, 0.002, 0.002
#: Tokens: runs of letters and digits, runs of other characters that aren't white space.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _pair(a: Column, b: Column) -> Column:
    """Bucket of a two-word n-gram. All repetitions of a word share one, as most words of a repetitive text are met once only."""
    return F.when(a == b, _bucket(F.lit("="), F.lit("="))).otherwise(_bucket(a, b))


def feature_ids(text: Column) -> Column:
    """Bucket of each n-gram occurrence, as an array."""

    def of(t: Column) -> Column:
        ones = F.transform(t, lambda w: _bucket(w))
        twos = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), _pair)
        return F.concat(ones, twos)

    return common.let(tokens(text), of)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal over (buckets, counts, label), in the given order; returns weights and bias."""
    z, n, zb, nb = np.zeros(buckets), np.zeros(buckets), 0.0, 0.0
    prepared = [(idx, count * (SCALE / max(1, count.sum())), y) for idx, count, y in examples]

    def weight(zz, nn):
        return -np.sign(zz) * np.maximum(np.abs(zz) - L1, 0) / ((BETA + np.sqrt(nn)) / ALPHA + L2)

    for _ in range(epochs):
        for idx, x, y in prepared:
            w, b = weight(z[idx], n[idx]), -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA
            z[idx] += g - sigma * w
            n[idx] += g * g
            gb = p - y
            sb = (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA
            zb, nb = zb + gb - sb * b, nb + gb * gb
    return weight(z, n), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA + L2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Labelled documents outside the held-out fold, at most SAMPLE of each class, gathered to the driver as feature ids."""
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(*order).limit(SAMPLE).collect()]
    if not picked:
        return []
    small = spark.createDataFrame([(r["doc_id"], int(r["quality"])) for r in picked], "doc_id long, _y int")  # at most 2 * SAMPLE rows
    rows = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").select("doc_id", "_y", feature_ids(common.text_of("text")).alias("ids")).groupBy("doc_id").agg(F.first("_y").alias("y"), F.max("ids").alias("ids"))
    counted = rows.select("doc_id", "y", F.explode_outer("ids").alias("b")).groupBy("doc_id", "y", "b").agg(F.count("b").alias("n"))
    whole = counted.groupBy("doc_id", "y").agg(F.array_sort(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "n")))).alias("f"))
    got = whole.select("y", "f.b", "f.n", F.xxhash64("doc_id").alias("o"), "doc_id").toArrow().sort_by([("o", "ascending"), ("doc_id", "ascending")])
    return [(b.values.to_numpy(), n.values.to_numpy(), y) for b, n, y in zip(got["b"], got["n"], got["y"].to_pylist(), strict=True)]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``."""
    weights, bias = train(training_sample(docs, labels))
    array = common.array_literal(np.round(weights, 6).tolist())

    def dot(t: Column, w: Column) -> Column:
        """Sum over the n-gram occurrences, without an array of them."""
        one = lambda h: F.element_at(w, h + 1)
        start = F.struct(F.lit(0.0).alias("s"), F.lit("").alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct((a["s"] + one(_bucket(x)) + F.when(a["n"] > 0, one(_pair(a["last"], x))).otherwise(0.0)).alias("s"), x.alias("last"), (a["n"] + 1).alias("n"))
        return F.aggregate(t, start, step, lambda a: a["s"] * SCALE / F.greatest(2 * a["n"] - 1, F.lit(1)))

    total = common.let(array, lambda w: dot(tokens(common.text_of("text")), w))
    return docs.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(total + F.lit(round(bias, 6))))))


def pipeline_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score 0.5 or more."""
    return common.unwrapped(scored(common.wrapped(docs, "doc_id", "text"), labels).where("score >= 0.5"), docs.columns)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    out = scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
