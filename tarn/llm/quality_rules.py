"""Quality rules, in DataFrame functions only: plain counts of each text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over BUCKETS hashed one- and two-word n-grams: a trusted target (every text that
``labels`` marks as good) and the raw corpus (every text). A document's score is the mean over its n-grams of log p_target - log p_raw, and it is kept if its
base rules hold and the score is at least THRESHOLD. Null texts have no words, and texts without words score 0. Repeated
rows get a row each and count each; repeated labels count once; an empty table gives no rows; other columns of any name don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common

BUCKETS, SMOOTH, THRESHOLD = 1 << 16, 1.0, -0.1
UNIT = 10_000  # weights are whole numbers of 1/UNIT, so that sums don't depend on their order
SYMBOLS = "#*$%&|<>"
MIX_A, MIX_B = 1_000_003, 31


def n_repeat_words(ws: Column) -> Column:
    """Words in three-word windows that the text has twice or more. Windows whose hash repeats are spelt out and compared."""
    return common.let(ws, _repeat_words)


def _twins(placed: Column) -> Column:
    """Places i of the sorted (w, i) whose w a neighbour has too."""

    def of(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["w"] == F.get(s, k)["w"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    return common.let(F.sort_array(placed), of)


def _repeat_words(ws: Column) -> Column:
    n = F.size(ws)
    at = lambda i: F.element_at(ws, i)
    few = 32  # repeated hashes that are looked up one by one; more are found by sorting all windows
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    placed = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("w"), (i + 1).alias("i")))
    spelt = lambda places: F.transform(places, lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("w"), i.alias("i")))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = lambda places: F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    twice = lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(x == F.get(s, k + 1), F.lit(False))))
    holds = lambda h, d: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i + 1)), lambda i: i.isNotNull())
    places = lambda h: common.let(common.let(F.sort_array(h), twice), lambda d: F.when(F.size(d) <= few, holds(h, d)).otherwise(_twins(placed(h))))
    found = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(_twins(spelt(places(h)))))
    return F.when(n < 4, F.lit(0)).otherwise(common.let(hashes, found))


def base_rules(text: Column, ws: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": n_repeat_words(ws).cast("long"),
    }


def word_hash(word: Column) -> Column:
    """The word's bucket: the first seven hex digits of its md5, as a number, by BUCKETS."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int") % BUCKETS


def ngram_buckets(hashes: Column) -> Column:
    """Bucket of each one- and two-word n-gram, from the hashes of the words in the order of the text."""

    def of(h: Column) -> Column:
        m = F.greatest(F.size(h) - 1, F.lit(0))
        return F.concat(h, F.zip_with(F.slice(h, 1, m), F.slice(h, 2, m), lambda a, b: ((a * F.lit(MIX_A).cast("long") + b * F.lit(MIX_B).cast("long") + 7) % BUCKETS).cast("int")))

    return common.let(hashes, of)


def target_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def log_ratios(read: DataFrame, labels: DataFrame) -> list[int]:
    """The weight of each bucket, from (doc_id, _h). Counts cover every text; the driver gets one row a bucket."""
    half = BUCKETS // 2  # buckets go through the join as two bytes each; a join of the same kind at every size
    short = read.select("doc_id", F.transform("_h", lambda x: (x - half).cast("smallint")).alias("_s"))
    flagged = short.join(target_ids(labels).withColumn("_good", F.lit(1)).hint("merge"), "doc_id", "left")
    grams = flagged.select("_good", F.explode(ngram_buckets(F.transform("_s", lambda x: x.cast("int") + half))).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    full = read.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")).toPandas().sort_values("b")
    import numpy as np

    share = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS))
    return np.round((share(full["good"].to_numpy()) - share(full["raw"].to_numpy())) * UNIT).astype(int).tolist()


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id with the base counts, base_failed, llr and kept, a row for each row of ``docs``. The texts are read once: the counts and the hashes of the words are written."""
    text = common.text_of("text")
    words = docs.select("doc_id", text.alias("_t"), common.words(text).alias("_ws"))
    read = common.stored(words.select("doc_id", *(c.alias(k) for k, c in base_rules(F.col("_t"), F.col("_ws")).items()), F.transform("_ws", word_hash).alias("_h")), "hashed", "snappy")
    weights = common.array_literal(log_ratios(read, labels), "int")

    def mean(g: Column, w: Column) -> Column:
        total = F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.element_at(w, b + 1))
        return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(total.cast("double") / (F.lit(float(UNIT)) * F.size(g)))

    llr = common.let(weights, lambda w: common.let(ngram_buckets(F.col("_h")), lambda g: mean(g, w)))
    out = read.withColumn("llr", llr).drop("_h")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))


OP2 = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).select(OP2)


OP2_SQL = f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
x as (select rid, i, w[i] word, case when i + 2 <= len(w) then w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end tri from (select rid, w, unnest(generate_series(1, len(w))) i from d)),
rep as (select rid, i from (select rid, i, tri, count(*) over (partition by rid, tri) k from x) where tri is not null and k > 1),
cov as (select rid, count(distinct p) n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) p from rep) group by rid),
lines as (select rid, unnest(string_split(t, chr(10))) l from d),
dup as (select rid, count(*) - count(distinct l) n_dup_lines from lines where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by rid),
h as (select rid, i, ('0x' || substr(md5(word), 1, 7))::bigint % {BUCKETS} h from x),
g as (select rid, h b from h union all select rid, (h * {MIX_A} + n * {MIX_B} + 7) % {BUCKETS} from (select rid, h, lead(h) over (partition by rid order by i) n from h) where n is not null),
good as (select distinct doc_id from labels where quality = 1 and doc_id is not null),
c as (select b, count(*) raw, count(*) filter (doc_id in (select doc_id from good)) good from g join d using (rid) group by b),
w as (select b, round(((ln((coalesce(good, 0) + {SMOOTH}) / (sum(good) over () + {SMOOTH * BUCKETS}))) - ln((raw + {SMOOTH}) / (sum(raw) over () + {SMOOTH * BUCKETS}))) * {UNIT})::bigint w from c),
s as (select rid, sum(w)::double / ({UNIT}.0::double * count(*)) llr from g join w using (b) group by rid),
o as (select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(llr, 0.0)::double llr from d left join cov using (rid) left join dup using (rid) left join s using (rid))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and llr >= {THRESHOLD} kept from o"""
