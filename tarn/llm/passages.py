"""Substring deduplication with automata of repeated phrases.

1. Anchors: in each window of WINDOW words the ANCHOR-word phrase with the least hash. Equal windows have equal
   anchors, so a window can recur only where an anchor does. Exact copies of a whole text are settled by a digest.
2. Recurring passages: windows whose anchor is in two documents or more are hashed and grouped by (anchor, hash).
   Those in two documents or more are cut, joined where they touch, from their first document (the owner).
3. Automata: the anchors of the passages, as sequences of word numbers, go into Aho-Corasick automata. A shard
   holds at most about SHARD_WORDS words of passages; an anchor's shard comes from the first document that has it, so
   a document visits the few shards of its own recurring anchors. Shards that many documents visit are salted.
4. Documents stream through their shards' automata. The windows around a hit are looked up among the windows of the
   shard's passages, each of which has one owner, and confirmed on the words; those of an earlier owner are covered.

Null texts have no words. A null doc_id comes before and after nothing: its words stay and remove no other's.
Rows that share a doc_id don't remove each other's words, whatever their texts; each owns the windows that it has. Repeated rows
get a row each; an empty table gives none; other columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common
from tarn.llm.near_dedup import THIRD, maybe_in, scatter

WINDOW, ANCHOR = 50, 16
SHARD_WORDS, SALT_WORDS = 50_000, 1_000_000
EMPTY = hashlib.sha256(b"").hexdigest()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: exactly the six ASCII spaces


def numbers(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """Hash of each run of ``window`` words, put together from runs of powers of two."""
    n, span, level, out = len(h) - window + 1, 1, h, None
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, left = np.full(n, window, np.uint64), 0, window
    while left:
        if left & 1:
            out = scatter((out ^ level[at : at + n]) + THIRD)
            at += span
        left >>= 1
        if left:
            level = scatter((level[: len(level) - span] ^ scatter(level[span:])) + THIRD)
            span *= 2
    return out


def anchors(h: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word run, place of the anchor of each window): the leftmost least."""
    grams = window_hashes(h, k)
    if len(h) < window:
        return grams, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)
    return grams, np.arange(len(view)) + view.argmin(axis=1)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, anchors): key is the digest of the words joined by one space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ws = split(text)
                grams, at = anchors(numbers(ws)) if len(ws) >= WINDOW else (None, None)
                rows.append((digest(ws), len(ws), np.unique(grams[at]).view(np.int64) if at is not None else None))
            out = pd.DataFrame(rows, columns=["key", "n_words", "anchors"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out.astype({"doc_id": pdf["doc_id"].dtype})

    return docs.mapInPandas(run, "doc_id long, key string, n_words long, anchors array<long>")



def recurring_windows(held: DataFrame) -> DataFrame:
    """(anchor, wh, doc_id) of the distinct windows of (doc_id, text, heads) whose anchor recurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, heads in zip(pdf["doc_id"], pdf["text"], pdf["heads"], strict=True):
                h = numbers(split(text))
                grams, at = anchors(h)
                known = np.array([x["anchor"] for x in heads], np.int64).view(np.uint64)
                pos = np.flatnonzero(np.isin(grams[at], known))
                wh, first = np.unique(window_hashes(h, WINDOW)[pos], return_index=True)
                rows.append((doc, grams[at][pos[first]].view(np.int64), wh.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "anchor", "wh"])

    wide = held.select("doc_id", "text", "heads").mapInPandas(run, "doc_id long, anchor array<long>, wh array<long>")
    return wide.select("doc_id", F.explode(F.arrays_zip("anchor", "wh")).alias("w")).select("w.anchor", "w.wh", "doc_id")


def cut_passages(owners: DataFrame) -> DataFrame:
    """From (doc_id, text, heads, starts), starts being the hashes of the windows that a row of this doc_id owns: a row for each
    passage of the row's own text and each head: (owner, first, n, words, head, anchor places)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, heads, own in zip(pdf["doc_id"], pdf["text"], pdf["heads"], pdf["starts"], strict=True):
                ws = split(text)
                h = numbers(ws)
                grams, at = anchors(h)
                head = {np.int64(x["anchor"]).astype(np.uint64): x["m"] for x in heads}
                wh, first_of = np.unique(window_hashes(h, WINDOW), return_index=True)
                starts = np.sort(first_of[np.isin(wh, np.asarray(own, np.int64).view(np.uint64))])
                for run_ in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else ():
                    first, end = int(run_[0]), int(run_[-1]) + WINDOW
                    by_head = defaultdict(list)
                    for q in np.unique(at[run_]):
                        by_head[head[grams[q]]].append(int(q) - first)
                    body = b" ".join(ws[first:end]).decode("utf-8", "surrogatepass")
                    rows += [(doc, first, end - first, body, m, places) for m, places in by_head.items()]
            yield pd.DataFrame(rows, columns=["owner", "first", "n", "body", "head", "places"])

    return owners.select("doc_id", "text", "heads", "starts").mapInPandas(run, "owner long, first int, n int, body string, head long, places array<int>")


class Shard:
    """One automaton over the anchors of some passages, with the places of the passages' windows."""

    def __init__(self):
        self.passages: list[tuple[int, list[bytes]]] = []
        self.keys: set[tuple] = set()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.automaton = None

    def add(self, owner: int, body: str, places) -> None:
        ws = split(body)
        h = numbers(ws)
        small = (h & np.uint64(0xFFFFFFF)).tolist()
        self.keys.update(tuple(small[q : q + ANCHOR]) for q in places)
        wh = window_hashes(h, WINDOW)
        self.parts.append((wh, np.full(len(wh), len(self.passages)), np.arange(len(wh))))
        self.passages.append((int(owner), ws))

    def compile(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key in self.keys:
            self.automaton.add_word(key, 1)
        if self.keys:
            self.automaton.make_automaton()
            wh, which, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(wh, kind="stable")
            self.wh, self.which, self.place = wh[order], which[order], place[order]
            self.owners = np.array([o for o, _ in self.passages])
        self.parts = []

    def covered(self, doc: int, ws: list[bytes]) -> np.ndarray:
        """Which words lie in a window that a passage of an earlier owner has too."""
        mask = np.zeros(len(ws), bool)
        if not self.keys or len(ws) < WINDOW:
            return mask
        h = numbers(ws)
        hits = [end - ANCHOR + 1 for end, _ in self.automaton.iter(tuple((h & np.uint64(0xFFFFFFF)).tolist()))]
        if not hits:
            return mask
        near = np.zeros(len(ws) + 1, np.int32)  # windows that hold a hit
        np.add.at(near, np.maximum(0, np.array(hits) - (WINDOW - ANCHOR)), 1)
        np.add.at(near, np.array(hits) + 1, -1)
        at = np.flatnonzero(np.cumsum(near)[: len(ws) - WINDOW + 1])
        wh = window_hashes(h, WINDOW)[at]
        found = np.minimum(np.searchsorted(self.wh, wh), len(self.wh) - 1)
        good = (self.wh[found] == wh) & (self.owners[self.which[found]] < doc)
        at, which, shift = at[good], self.which[found[good]], at[good] - self.place[found[good]]
        if not len(at):
            return mask
        runs = np.flatnonzero((np.diff(at) != 1) | (np.diff(which) != 0) | (np.diff(shift) != 0)) + 1
        for a, b in zip([0, *runs.tolist()], [*runs.tolist(), len(at)], strict=True):
            s, e, d = int(at[a]), int(at[b - 1]) + WINDOW, int(shift[a])
            if ws[s:e] == self.passages[int(which[a])][1][s - d : e - d]:
                mask[s:e] = True
        return mask


def located(rows: DataFrame) -> DataFrame:
    """Stream (shard, salt, kind, ...) rows, sorted so that a group's passages (kind 0) come before its documents (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, shard = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.shard, r.salt) != group:
                    group, shard = (r.shard, r.salt), Shard()
                if r.kind == 0:
                    shard.add(r.doc_id, r.text, r.places)
                    continue
                if shard.automaton is None:
                    shard.compile()
                ws = split(r.text)
                mask = shard.covered(int(r.doc_id), ws)
                if r.n_shards == 1:
                    n = int(mask.sum())
                    out.append((r.doc_id, r.kh, n, digest([w for w, m in zip(ws, mask.tolist(), strict=True) if not m]) if n else None, None))
                else:
                    out.append((r.doc_id, r.kh, None, None, np.flatnonzero(mask).astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "kh", "n_removed", "sha", "places"]).astype({"n_removed": "Int64"})

    return rows.mapInPandas(run, "doc_id long, kh long, n_removed long, sha string, places array<int>")


def finished(rows: DataFrame) -> DataFrame:
    """(doc_id, kh, n_removed, sha) from (doc_id, kh, text, places)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, key, text, places in zip(pdf["doc_id"], pdf["kh"], pdf["text"], pdf["places"], strict=True):
                gone, ws = set(np.asarray(places).tolist()), split(text)
                out.append((doc, key, len(gone), digest([w for i, w in enumerate(ws) if i not in gone])))
            yield pd.DataFrame(out, columns=["doc_id", "kh", "n_removed", "sha"])

    return rows.mapInPandas(run, "doc_id long, kh long, n_removed long, sha string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``."""
    spark = docs.sparkSession
    common.short_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_docs = common.stored(described(docs), "described")
    firsts = common.stored(all_docs.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").select("key", "rep"), "copies")
    marked = common.stored(all_docs.join(firsts, "key", "left").select("doc_id", "key", F.xxhash64("key").alias("kh"), "n_words", "anchors", (F.col("rep").isNotNull() & (F.col("doc_id") > F.col("rep"))).alias("copy")), "marked")
    own = marked.where("not copy and doc_id is not null and n_words >= %d" % WINDOW).select("doc_id", "kh", F.explode("anchors").alias("anchor"))
    recurring = common.stored(own.groupBy("anchor").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("last")).where("m < last").select("anchor", "m"), "recurring")
    heads = own.join(recurring, "anchor").groupBy("doc_id", "kh").agg(F.collect_set(F.struct("anchor", "m")).alias("heads"))
    heads = common.stored(heads, "heads")
    held = docs.where(maybe_in(heads, "doc_id")).withColumn("kh", F.xxhash64(F.sha2(F.array_join(common.words(common.text_of("text")), " "), 256))).join(heads, ["doc_id", "kh"]).dropDuplicates(["doc_id", "kh"])
    held = common.stored(held, "held")
    # windows in two documents or more, by their first document
    first = recurring_windows(held).groupBy("anchor", "wh").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id < last")
    starts = common.stored(first.groupBy("doc_id").agg(F.collect_list("wh").alias("starts")), "starts")
    passages = common.stored(cut_passages(held.where(maybe_in(starts, "doc_id")).join(starts, "doc_id")), "passages")
    total = passages.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shard = lambda m: F.pmod(F.xxhash64(m), F.lit(total // SHARD_WORDS + 1)).cast("int")
    foreign = F.array_distinct(F.transform(F.filter("heads", lambda x: x["m"] < F.col("doc_id")), lambda x: shard(x["m"])))
    visits = held.withColumn("shards", foreign).where(F.size("shards") > 0)
    load = visits.join(marked.select("doc_id", "kh", "n_words"), ["doc_id", "kh"]).select(F.explode("shards").alias("shard"), "n_words").groupBy("shard").agg((F.sum("n_words") / SALT_WORDS + 1).cast("int").alias("salts"))
    load = common.stored(load, "load")
    stops = visits.select("doc_id", "kh", "text", F.size("shards").alias("n_shards"), F.explode("shards").alias("shard")).join(load, "shard")
    doc_rows = stops.select("shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "kh", "text", "n_shards", F.lit(None).cast("array<int>").alias("places"))
    phrase = passages.withColumn("shard", shard(F.col("head"))).groupBy("shard", "owner", "first", "body").agg(F.flatten(F.collect_list("places")).alias("places")).join(load, "shard")
    phrase_rows = phrase.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("owner").alias("doc_id"), F.lit(0).cast("long").alias("kh"), F.col("body").alias("text"), F.lit(0).alias("n_shards"), "places")
    rows = phrase_rows.unionByName(doc_rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    hits = common.stored(located(rows), "hits")
    parts = hits.where("places is not null").groupBy("doc_id", "kh").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")).where(F.size("places") > 0)
    parts = common.stored(parts, "parts")
    many = finished(held.select("doc_id", "kh", "text").where(maybe_in(parts, "doc_id")).join(parts, ["doc_id", "kh"]))
    removed = hits.where("n_removed > 0").select("doc_id", "kh", "n_removed", "sha").unionByName(many)
    out = marked.join(removed, ["doc_id", "kh"], "left")
    gone = F.col("copy") & (F.col("n_words") >= WINDOW)
    return out.select("doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("sha", "key")).alias("kept_sha256"))


def op5_passages(spark, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents"))


OP5_SQL = f"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
x as (select rid, doc_id, i, w[i] word, case when i + {WINDOW - 1} <= len(w) then sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) end win from (select *, unnest(generate_series(1, len(w))) i from d)),
f as (select win, min(doc_id) first_doc from x where win is not null and doc_id is not null group by win),
g as (select rid, i, word, coalesce(first_doc < doc_id, false)::int hit from x left join f using (win)),
c as (select rid, i, word, max(hit) over (partition by rid order by i rows between {WINDOW - 1} preceding and current row) gone from g),
a as (select rid, sum(gone) n_removed, string_agg(word, ' ' order by i) filter (gone = 0) kept from c group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join a using (rid)"""
