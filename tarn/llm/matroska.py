"""Media columns: a Matroska muxer for 8-bit PCM, and a parser of any EBML file into a packet table.

The parser reads variable-length element ids and sizes (the unknown size too), clusters, simple blocks
and block groups, all four lacings and cues; it gives a row for each packet with its track, timestamp
and byte range in the file. A damaged file gives the packets before the damage and ``complete`` False.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, TRACKS, CLUSTER, CUES, INFO, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}

RATE = 8000  # samples a second: 8 bytes a millisecond
PAD, FRAME_BYTES, BLOCK_FRAMES, CLUSTER_BLOCKS = 64, 512, 8, 8


class Damaged(ValueError):
    pass


def size_bytes(n: int, width: int = 0) -> bytes:
    """An element size; the value with all bits set is kept for the unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and the bytes after the block header: none for one frame, fixed for equal ones, else EBML."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 2, head + b"".join(frames)
    coded = size_bytes(sizes[0])
    for before, now in zip(sizes, sizes[1:-1], strict=False):
        d = now - before
        width = next(w for w in range(1, 9) if -(1 << 7 * w - 1) < d < 1 << 7 * w - 1)
        coded += size_bytes(d + (1 << 7 * width - 1) - 1, width)
    return 3, head + coded + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """Mono 8-bit PCM in laced clusters with a cue for each. The same bytes give the same file."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    parts = [info, element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))]
    at, cues, per_block = sum(map(len, parts)), [], FRAME_BYTES * BLOCK_FRAMES
    for start in range(0, len(payload), per_block * CLUSTER_BLOCKS):
        time = start * 1000 // RATE
        blocks = [uint(CLUSTER_TIMESTAMP, time)]
        for b in range(start, min(len(payload), start + per_block * CLUSTER_BLOCKS), per_block):
            flag, body = lace([payload[f : f + FRAME_BYTES] for f in range(b, min(len(payload), b + per_block), FRAME_BYTES)])
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - time, 0x80 | flag << 1) + body))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def read_vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int | None, int]:
    """A variable-length number and the place after it; None for the unknown size."""
    if at >= end or not data[at]:
        raise Damaged(f"no vint at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"vint cut at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body). An unknown size runs to the next element of the same or a higher level."""
    while at < end:
        begin = at
        ident, at = read_vint(data, at, end, True)
        size, at = read_vint(data, at, end, False)
        if size is None:
            stop = end if ident == SEGMENT else at
            while ident != SEGMENT and stop < end:
                inner, x = read_vint(data, stop, end, True)
                if inner in (CLUSTER, CUES, TRACKS, INFO):
                    break
                n, x = read_vint(data, x, end, False)
                stop = x + (n or 0)
        else:
            stop = at + size
        if stop > end:
            if ident in MASTERS:  # what is there of it can be read
                yield ident, begin, at, end
            raise Damaged(f"element at {begin} is cut")
        yield ident, begin, at, stop
        at = stop


def frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames in a block, and where the first begins."""
    if not lacing:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise Damaged("fixed lacing doesn't divide")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == 1:
            total = 0
            while True:
                total, at = total + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(total)
        else:
            width = 9 - data[at].bit_length()
            raw, at = read_vint(data, at, end, False)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            sizes.append(raw if not k else sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged("lacing is longer than its block")
    return sizes, at


def parse(data: bytes) -> dict:
    """``packets``: (cluster, block, frame, track, timestamp_ms, keyframe, lacing, offset, length); ``tracks``, ``cues``, ``complete``."""
    out: dict = {"packets": [], "tracks": {}, "cues": [], "clusters": [], "complete": True}
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    scale, base = 1_000_000, 0

    def block(at: int, end: int, simple: bool, key: bool) -> None:
        track, at = read_vint(data, at, end, False)
        if at + 3 > end:
            raise Damaged("block header is cut")
        rel, flags = struct.unpack(">hB", data[at : at + 3])
        lacing = flags >> 1 & 3
        sizes, at = frame_sizes(data, at + 3, end, lacing)
        stamp = (clock[0] + rel) * scale // 1_000_000
        for k, n in enumerate(sizes):
            out["packets"].append((len(out["clusters"]) - 1, clock[1], k, track, stamp, bool(flags & 0x80) if simple else key, lacing, at, n))
            at += n
        clock[1] += 1

    clock = [0, 0]
    try:
        for top, _, a, b in elements(data, 0, len(data)):
            if top != SEGMENT:
                continue
            base = a
            for ident, begin, x, y in elements(data, a, b):
                if ident == INFO:
                    for i, _, p, q in elements(data, x, y):
                        scale = whole(p, q) if i == TIMESTAMP_SCALE else scale
                elif ident == TRACKS:
                    for i, _, p, q in elements(data, x, y):
                        if i == TRACK_ENTRY:
                            own = {j: data[r:s] for j, _, r, s in elements(data, p, q)}
                            out["tracks"][int.from_bytes(own.get(TRACK_NUMBER, b""), "big")] = own.get(CODEC_ID, b"").decode("latin-1")
                elif ident == CLUSTER:
                    out["clusters"].append(begin - base)
                    clock[:] = 0, 0
                    for i, _, p, q in elements(data, x, y):
                        if i == CLUSTER_TIMESTAMP:
                            clock[0] = whole(p, q)
                        elif i == SIMPLE_BLOCK:
                            block(p, q, True, False)
                        elif i == BLOCK_GROUP:
                            own = [(j, r, s) for j, _, r, s in elements(data, p, q)]
                            for j, r, s in own:
                                if j == BLOCK:
                                    block(r, s, False, all(k != REFERENCE_BLOCK for k, _, _ in own))
                elif ident == CUES:
                    for i, _, p, q in elements(data, x, y):
                        own = {j: (r, s) for j, _, r, s in elements(data, p, q)} if i == CUE_POINT else {}
                        if CUE_TIME in own and CUE_TRACK_POSITIONS in own:
                            place = {j: whole(r, s) for j, _, r, s in elements(data, *own[CUE_TRACK_POSITIONS])}
                            out["cues"].append((whole(*own[CUE_TIME]) * scale // 1_000_000, place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER_POSITION, 0)))
    except (Damaged, IndexError):
        out["complete"] = False
    return out


def encode_column(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, n_bytes, media): each payload (null: empty) padded with bytes 0 to a positive multiple of 64 and muxed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, media = [], []
            for raw in pdf["_payload"]:
                raw = b"" if raw is None else bytes(raw)
                sizes.append(len(raw))
                media.append(mux(raw + bytes((-len(raw) % PAD) or (0 if raw else PAD))))
            yield pd.DataFrame({key: pdf[key], "n_bytes": sizes, "media": media})

    common.short_batches(df.sparkSession)
    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, payload.alias("_payload")).mapInPandas(run, f"`{key}` {kind}, n_bytes long, media binary")


PACKETS = "cluster int, block int, frame int, track long, timestamp_ms long, keyframe boolean, lacing int, offset long, length long, complete boolean"


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """A row for each packet of each file. A null or unreadable file gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PACKETS.split(", ")]
        for pdf in batches:
            for k, data in zip(pdf[key], pdf[media], strict=True):
                got = parse(bytes(data or b""))
                part = pd.DataFrame([(*p, got["complete"]) for p in got["packets"]], columns=names)
                part.insert(0, key, pd.Series([k] * len(part), dtype=pdf[key].dtype))
                yield part

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, media).mapInPandas(run, f"`{key}` {kind}, {PACKETS}")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_clusters long, n_cues long, complete boolean"


def features(df: DataFrame, key: str) -> DataFrame:
    """From (key, n_bytes, media): the payload put together from the packets' byte ranges, its digests, and a feature text.

    feature: packets, clusters, cues, last timestamp, sum of samples, changes across the middle level. ``complete`` is false for a
    file that ends before its elements do: its payload is what could be read."""

    def one(data: bytes) -> tuple:
        import numpy as np

        got = parse(data)
        payload = b"".join(data[p[7] : p[7] + p[8]] for p in got["packets"])
        wave = np.frombuffer(payload, np.uint8)
        high = wave >= 128
        feature = f"p{len(got['packets'])};c{len(got['clusters'])};q{len(got['cues'])};t{got['packets'][-1][4] if got['packets'] else 0};s{int(wave.sum(dtype=np.int64))};z{int((high[1:] != high[:-1]).sum())}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(got["packets"]), len(got["clusters"]), len(got["cues"]), got["complete"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for pdf in batches:
            rows = pd.DataFrame([one(bytes(m or b"")) for m in pdf["media"]], columns=names, index=pdf.index)
            yield pd.concat([pdf[[key, "n_bytes"]], rows], axis=1)

    common.short_batches(df.sparkSession)
    kind = df.select(key).schema[0].dataType.simpleString()
    return df.mapInPandas(run, f"`{key}` {kind}, n_bytes long, {FEATURES}")


def op10_matroska(spark, sf_dir: str) -> DataFrame:
    """Every whole text as a stored Matroska column, read back into packets. Null and empty texts: one padded block."""
    docs = common.table(spark, sf_dir, "documents")
    media = common.stored(encode_column(docs, "doc_id", F.encode(common.text_of("text"), "UTF-8")), "media")
    return features(media, "doc_id")
