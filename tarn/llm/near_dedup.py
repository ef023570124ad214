"""Near-duplicate documents by circulant MinHash, bands, and exact Jaccard on the full shingle sets.

Signature: a first permutation of the 64-bit ring scatters a shingle, a second one, shifted by k, gives
coordinate k; both are bijective mixers, so two permutations serve all coordinates. Documents with equal sets
are one node from the start. BANDS bands of ROWS coordinates miss a pair at the threshold with a chance under
1e-9 at 0.85 and under 1e-7 at 0.8.

Buckets may be large, so their pairs are never listed. Each bucket compares its members with one member p (a
star), the one whose buckets are fullest over all bands: among edited copies that is the least edited. That gives each member's sizes a = |x - p| and r = |p - x|. Two members x, y that are not yet in one
component can be linked only if a(x) + a(y) + |r(x) - r(y)| is small enough, or if they share a shingle that p
lacks. Only such pairs are confirmed, so a family of copies around p costs a row for each copy, not for each pair.
No candidate is capped or dropped.

Texts without words, and nulls, are linked with nothing. Rows of one doc_id are rows like any others. A class
without any doc_id has component_id null and its rows are kept. An empty table gives no rows; other columns of any name
don't matter to the classes and are kept by the pipeline's stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm import common, graph

BANDS, ROWS = 32, 4
CHUNK = 256
#: The largest filter of ids has 2 to this many bits (2 MB).
FILTER_BITS = 24
#: Members of a star, or sharers of a shingle, that one task compares others with.
HALL = 1024
SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint64)
# Odd multipliers of well-known 64-bit mixers.
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
FIRST, SECOND, THIRD, FOURTH, FIFTH = (np.uint64(m) for m in MIX)


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation."""
    x = x ^ (x >> np.uint64(33))
    x *= FIRST
    x ^= x >> np.uint64(33)
    x *= SECOND
    return x ^ (x >> np.uint64(33))


def second_in_place(x: np.ndarray, spare: np.ndarray) -> None:
    """The second permutation."""
    np.right_shift(x, np.uint64(30), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, FOURTH, out=x)
    np.right_shift(x, np.uint64(27), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, FIFTH, out=x)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter; none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: exactly A-Z, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = scatter((out ^ h[j : len(h) - k + 1 + j]) + THIRD)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    first, low = scatter(shingles), np.full(len(SHIFTS), np.iinfo(np.uint64).max)
    for a in range(0, len(first), CHUNK):
        block = first[a : a + CHUNK, None] + SHIFTS
        second_in_place(block, np.empty_like(block))
        np.minimum(low, block.min(axis=0), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = scatter((out ^ sig.reshape(BANDS, ROWS)[:, j]) + THIRD)
    return out.view(np.int64)


def signatures(docs: DataFrame, k: int, tag: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, key, bands), and ``tag`` if one is given. key names the set; it and bands are null for an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        last: dict[bytes, list] = {}
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                own = shingle_set(text, k)
                if not len(own):
                    rows.append((0, None, None))
                    continue
                key = xxhash.xxh3_128_digest(own.tobytes())
                if key not in last:  # copies often stand together
                    if len(last) > 2000:
                        last.clear()
                    last[key] = band_keys(signature(own))
                rows.append((len(own), key, last[key]))
            out = pd.DataFrame(rows, columns=["n_shingles", "key", "bands"])
            yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), out], axis=1)

    common.short_batches(docs.sparkSession)
    given = [] if tag is None else [tag.alias("tag")]
    kinds = "doc_id long, " + "tag string, " * len(given) + "n_shingles long, key binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *given, "text").mapInPandas(run, kinds)


def _bit(ident: Column, log2: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(1 << log2))


def maybe_in(ids: DataFrame, column: str) -> Column:
    """A filter that all the ids of a written table pass, and few others: it spares a shuffle of the texts.

    It has eight bits or more for each id, up to FILTER_BITS in all; beyond that more texts pass, and exact joins follow in any case."""
    log2 = min(FILTER_BITS, max(12, int(8 * ids.count()).bit_length()))
    bit = _bit(F.col(column), log2)
    rows = ids.select((bit / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    words = [0] * (1 << log2 - 6)
    for r in rows:
        words[r["w"]] = r["b"]
    bit = _bit(F.col(column).cast("long"), log2)
    return F.getbit(F.element_at(F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>"), (bit / 64).cast("int") + 1), (bit % 64).cast("int")) == 1


def _sets(docs: DataFrame, k: int, holders: DataFrame) -> DataFrame:
    """The written holders (id, key, doc_id, ...) with their shingle sets ``s``, once each: the sets go through one shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            own = [shingle_set(t, k) for t in pdf["text"]]
            yield pd.DataFrame({"key": [xxhash.xxh3_128_digest(s.tobytes()) for s in own], "s": [s.view(np.int64) for s in own]})

    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(maybe_in(holders, "doc_id") | F.col("doc_id").isNull())
    made = near.select("text").mapInPandas(run, "key binary, s array<long>")
    made = common.stored(made, "sets-all")
    sets = common.stored(made.join(holders.drop("doc_id"), "key").dropDuplicates(["key"]).drop("key"), "sets")
    common.discard(made)
    return sets


def _linked(inter: Column, nx: Column, ny: Column, percent: int) -> Column:
    return inter * 100 >= (nx + ny - inter) * percent


def _sized(pairs: DataFrame, sets: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with the sets of both ends as ``sl`` and ``sr``."""
    one = pairs.join(sets.select(F.col("id").alias(left), F.col("s").alias("sl")), left)
    return one.join(sets.select(F.col("id").alias(right), F.col("s").alias("sr")), right)


def _neighbours(left: DataFrame, right: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Join on the keys, on neighbouring sizes (linked sets have sizes within percent/100 of each other) and on a hall.

    Every left row visits the three size classes that its own may be linked with, in all halls of its group; a right row is in one."""
    size = lambda n: F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(100 / percent) + 1e-9)).cast("int")
    spread = left.withColumn("sz", F.explode(F.sequence(size("n1") - 1, size("n1") + 1))).withColumn("hall", F.explode(F.sequence(F.lit(0), F.col("halls1") - 1)))
    dealt = right.withColumn("sz", size("n2")).withColumn("hall", F.pmod(F.xxhash64("x2"), F.col("halls2")).cast("int"))
    return spread.join(dealt, [*keys, "sz", "hall"])


def links(docs: DataFrame, k: int, percent: int, nodes: DataFrame) -> DataFrame:
    """Components (node, comp) of the ids that have a link. ``nodes`` is a written table (id, key, doc_id, bands) of the distinct sets."""
    banded = nodes.select("id", F.explode("bands").alias("band"))
    full = common.stored(banded.groupBy("band").agg(F.count("*").alias("k")).where("k > 1"), "buckets")
    crowded = common.stored(banded.join(full, "band"), "crowded")
    weight = common.stored(crowded.groupBy("id").agg(F.sum("k").alias("w")), "weights")
    least = common.stored(crowded.join(weight, "id").groupBy("band").agg(F.max_by("id", "w").alias("p")), "pivots")
    stars = common.stored(crowded.join(least, "band").where("id <> p").select("p", F.col("id").alias("x")).distinct(), "stars")
    common.discard(full, crowded, weight, least)
    # each node's centres (one a band at most), and whether it is one
    ends = F.array(F.struct(F.col("x").alias("id"), F.col("p").alias("of")), F.struct(F.col("p").alias("id"), F.lit(None).cast("long").alias("of")))
    at = stars.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.collect_set("e.of").alias("centres"), F.max(F.col("e.of").isNull()).alias("pivot"))
    sets = _sets(docs, k, common.stored(at.join(nodes.select("id", "key", "doc_id"), "id"), "holders"))
    seen = sets.select(F.explode("centres").alias("p"), F.col("id").alias("x"), F.col("s").alias("sl")).join(sets.where("pivot").select(F.col("id").alias("p"), F.col("s").alias("sr")), "p")
    seen = seen.select("p", "x", F.size("sl").alias("n"), F.size("sr").alias("np"), F.array_except("sl", "sr").alias("extra"))
    seen = seen.withColumn("a", F.size("extra")).withColumn("r", F.col("np") - F.col("n") + F.col("a")).withColumn("near", _linked(F.col("n") - F.col("a"), F.col("n"), F.col("np"), percent))
    seen = common.stored(seen, "compared")
    first = common.stored(graph.components(seen.where("near").select(F.col("p").alias("u"), F.col("x").alias("v"))), "components")
    # members of stars that hold more than one component
    name = lambda c, out: first.select(F.col("node").alias(c), F.col("comp").alias(out))
    member = seen.join(name("x", "cx"), "x", "left").join(name("p", "cp"), "p", "left").withColumn("cx", F.coalesce("cx", "x")).withColumn("cp", F.coalesce("cp", "p")).withColumn("out", F.col("cx") != F.col("cp"))
    member = common.stored(member, "members")
    # how many halls the members of a star with some outside are dealt over, so that no task compares more than about HALL of them with others
    tally = common.stored(member.groupBy("p").agg((F.count("*") / HALL + 1).cast("int").alias("halls"), F.max("out").alias("any")).where("any").select("p", "halls"), "tally")
    if tally.isEmpty():
        return first
    mixed = common.stored(member.join(tally, "p"), "mixed")
    slim = [F.col(c) for c in ("p", "x", "n", "a", "r", "cx", "out")]
    side = lambda df, t: df.select(*(F.col(c).alias(c if c in ("p", "e") else f"{c}{t}") for c in df.columns))
    unmet = F.expr("cx1 <> cx2 and (not out2 or x1 < x2)")
    gap = lambda shared: (F.col("a1") + F.col("a2") + F.abs(F.col("r1") - F.col("r2")) - 2 * shared) * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent)
    few = mixed.where(F.col("a") * percent <= F.col("n") * (100 - percent)).select(*slim, "halls")  # more extras than that need shared ones
    bare = _neighbours(side(few.where("out"), "1"), side(few, "2"), ["p"], percent).where(unmet & gap(F.lit(0))).select("x1", "x2")
    # shared extras, rarest first: from a pair's first one on, no more than ``rest`` can be shared
    held = mixed.select(*slim, F.explode("extra").alias("e"))
    twice = held.groupBy("p", "e").agg(F.count("*").alias("k"), F.min("cx").alias("lo"), F.max("cx").alias("hi"), F.max("out").alias("any")).where("k > 1 and lo <> hi and any").select("p", "e", "k")
    order = W.partitionBy("p", "x").orderBy(F.desc("k"), "e")
    held = common.stored(held.join(twice, ["p", "e"]).withColumn("rest", F.row_number().over(order)).withColumn("halls", (F.col("k") / HALL + 1).cast("int")).drop("k"), "shared")
    met = _neighbours(side(held.where("out"), "1"), side(held, "2"), ["p", "e"], percent).where(unmet & gap(F.least("rest1", "rest2"))).select("p", "x1", "x2", "n1", "n2", "a1", "a2", "r1", "r2").distinct()
    extra = lambda t: side(mixed.select("p", "x", "extra"), t)
    met = met.join(extra("1"), ["p", "x1"]).join(extra("2"), ["p", "x2"]).withColumn("o", F.size(F.array_intersect("extra1", "extra2")))
    more = common.stored(bare.union(met.where(gap(F.col("o"))).select("x1", "x2")).distinct(), "more-pairs")
    sure = _sized(more, sets, "x1", "x2").withColumn("i", F.size(F.array_intersect("sl", "sr"))).where(_linked(F.col("i"), F.size("sl"), F.size("sr"), percent)).select(F.col("x1").alias("u"), F.col("x2").alias("v"))
    return graph.components(seen.where("near").select(F.col("p").alias("u"), F.col("x").alias("v")).union(sure))


def _labelled(docs: DataFrame, k: int, percent: int, tag: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, comp, component_id), and ``tag`` of each row if one is asked for; comp names the class, null for rows without words."""
    signed = common.stored(signatures(docs, k, tag), "signatures")
    nodes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = common.stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # short names for the sets, fixed by the written table
    comps = links(docs, k, percent, nodes)
    named = nodes.select("id", "key", "doc_id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", F.col("doc_id").alias("d"), F.coalesce("comp", "id").alias("comp"))
    named = common.stored(named, "named")
    least = named.groupBy("comp").agg(F.min("d").alias("component_id"))
    label = common.stored(named.join(least, "comp").select("key", "comp", "component_id"), "labels")
    return signed.select("doc_id", "n_shingles", "key", *(["tag"] if tag is not None else [])).join(label, "key", "left")


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    ident = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = _labelled(docs, k, percent).select("doc_id", "n_shingles", ident.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def pipeline_stage(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class: that with the least doc_id, of equal ids the least digest of the text; null ids come last. Rows
    without words stay. A row is known by its doc_id and text, so rows that share a doc_id are judged apart, and of rows
    that repeat both one stays."""
    tag = F.md5(common.text_of("text"))
    rows = _labelled(docs, k, percent, tag).select("doc_id", "tag", "comp")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    winners = rows.where("comp is not null").groupBy("comp").agg(F.min(place).alias("w")).select(F.col("w.doc_id").alias("wid"), F.col("w.tag").alias("wtag"), F.lit(True).alias("wins"))
    seen = rows.groupBy("doc_id", "tag").agg(F.count("*").alias("k"), F.max(F.col("comp").isNull()).alias("bare"))
    judged = seen.join(winners, (F.col("tag") == F.col("wtag")) & F.col("doc_id").eqNullSafe(F.col("wid")), "left").withColumn("gone", F.col("wins").isNull() & ~F.col("bare"))
    flagged = common.stored(judged.where("gone or k > 1").select(F.col("doc_id").alias("fid"), F.col("tag").alias("ftag"), "gone"), "flagged")
    doubt = F.coalesce(maybe_in(flagged.select(F.col("fid").alias("doc_id")), "doc_id"), F.lit(True))
    clear = docs.where(~doubt)
    rest = docs.where(doubt).withColumn("_tag", tag)
    left = rest.join(flagged.where("gone"), (F.col("_tag") == F.col("ftag")) & F.col("doc_id").cast("long").eqNullSafe(F.col("fid")), "left_anti")
    return clear.unionByName(left.dropDuplicates(["doc_id", "_tag"]).select(*docs.columns))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"), 3, 85)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = f"""
with recursive d as (select row_number() over () rid, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct rid, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end g from (select *, unnest(generate_series(1, greatest(len(w) - 2, 1))) i from d where len(w) > 0)),
n as (select rid, count(*) n from s group by rid),
p as (select a.rid x, b.rid y, count(*) i from s a join s b using (g) where a.rid < b.rid group by all),
l as (select x, y from p join n a on a.rid = x join n b on b.rid = y where 100 * i >= 85 * (a.n + b.n - i)),
e as (select x, y from l union all select y, x from l),
r as (select rid a, rid b from d union select r.a, e.y from r join e on e.x = r.b),
c as (select a rid, min(doc_id) component_id from r join d on d.rid = r.b group by a)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, coalesce(doc_id = component_id, component_id is null) kept from d join c using (rid) left join n using (rid)"""
