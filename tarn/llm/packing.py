"""Best-fit packing planned over the histogram of lengths.

Documents are never gathered: the driver sees only the counts of at most ``capacity`` lengths, packs those
best fit first from the longest length down, and gives a table of slot ranges (length, ranks, first
sequence, offset). A piece takes the slot of its rank within its length.

Null and empty texts are one piece with the end id alone. Ties of a length take slots in the order of their ranks; repeated rows are
packed each; long texts are encoded whole; an empty table gives no pieces; other columns of any name don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm import common

CAPACITY, END_ID, TOKENIZER = 1024, 2, "byte_bpe_50k.json"
#: Texts at the start of each task that ``tokenizers`` encodes too: a difference is an error.
COMPARED = 16
#: A block of white space this long sends a text to ``tokenizers``: the faster engine's pattern runs out of stack at about a million.
BLANK = 10_000


@cache
def engines(name: str = TOKENIZER):
    """The tokenizer of the file, and a faster engine over the vocabulary and pattern of that file (the ids of byte-level BPE are its merge ranks)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True  # their strings in a text are ordinary text
    # the printable stand-ins that byte-level BPE has for bytes: itself if printable, else the next free code from 256
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in own)}
    vocabulary = reference.get_vocab(with_added_tokens=False)
    ranks = {bytes(stands[c] for c in t): i for t, i in vocabulary.items() if all(c in stands for c in t)}
    specials = {t.content for t in reference.get_added_tokens_decoder().values()}
    ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in specials}
    return reference, tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def blank(text: str) -> bool:
    """Whether a block of BLANK characters, counted from the start, is all white space: true of every text with a run of twice that."""
    return any(text[k : k + BLANK].isspace() for k in range(0, len(text) - BLANK + 1, BLANK))


class Encoder:
    """Token ids of texts, as the ``tokenizers`` library gives them; it encodes itself what the faster engine can't."""

    def __init__(self, name: str = TOKENIZER):
        self.tokenizer, self.fast = engines(name)
        self.compared = 0

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if blank(text):
            return self.exact(text)
        try:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # of its pattern, as for white space beyond its stack
            return self.exact(text)
        if self.compared < COMPARED:
            self.compared += 1
            if not np.array_equal(ids, self.exact(text)):
                raise ValueError("the fast engine's ids differ from the tokenizer's")
        return ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones at the end, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of each text (null: empty, so only the end id), each with its rank among those of its length in the same task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, ranks, part = Encoder(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for doc, own_ids in zip(pdf["doc_id"], (encode(t or "") for t in pdf["text"]), strict=True):
                ids = np.append(own_ids, np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + n]
                    row = (doc, k, start, n, zlib.crc32(own.tobytes()), part, ranks[n])
                    ranks[n] += 1
                    rows.append((*row, own.astype(np.int32).tolist()) if keep_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * keep_ids
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": pdf["doc_id"].dtype})

    common.short_batches(docs.sparkSession)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, from the longest length: (length, first rank, end rank, first sequence, items a sequence, offset).

    Sequences with the same room left are one group, a range of numbers; a length splits at most two groups for
    each one it uses, so the plan has a few rows for each length and doesn't grow with the documents."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)
    out, fresh = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, per = capacity, capacity // length
                first, n = fresh, -(-left // per)
                fresh += n
            per = room // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, rank + full * per, first, per, capacity - room))
                put(room - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if left and n:  # fewer than would fill one more
                out.append((length, rank, rank + left, first, left, capacity - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return out


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each stored piece (length, part, rank) its sequence and offset. ``parts`` must be a written table."""
    spark = parts.sparkSession
    counts = common.stored(parts.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "part", before.alias("_before")).hint("merge")  # a row for each length of each task grows with the documents: no broadcast
    ranked = parts.join(bases, ["length", "part"]).withColumn("_rank", F.col("rank") + F.col("_before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan(histogram, capacity) or [(0, 0, 0, 0, 1, 0)], "length long, _from long, _to long, _first long, _per long, _base long")
    fits = (F.col("s.length") == F.col("p.length")) & (F.col("p._rank") >= F.col("s._from")) & (F.col("p._rank") < F.col("s._to"))
    j = F.col("p._rank") - F.col("s._from")
    kept = [F.col(f"p.{c}") for c in parts.columns if c not in ("part", "rank")]
    return ranked.alias("p").join(F.broadcast(slots.alias("s")), fits).select(*kept, (F.col("s._first") + F.floor(j / F.col("s._per"))).cast("long").alias("sequence_id"), (F.col("s._base") + j % F.col("s._per") * F.col("p.length")).cast("long").alias("offset"))


def pack(docs: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with sequence_id and offset. Columns of ``docs`` other than doc_id and text don't matter; repeated rows are packed each; no rows give none."""
    return place(common.stored(pieces(docs, **options), "pieces"), options.get("capacity", CAPACITY))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
