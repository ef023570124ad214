"""WARC archives, index first.

Writing gives an index row for each record (file, offset, length, URL, digest) and reading starts from that
index: the selected rows are sorted by place, neighbouring byte ranges are joined into one read, and the
records are cut from what was read. Files are gzip members, one a record, in the shared folder; they are
reached with pyarrow's file systems, so any store that those know will do. A task that runs again writes the
same rows to a new file, and only files named in the written index count.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common

DEDUP_BYTES = 1000
#: Reads are joined over gaps of up to GAP bytes, up to READ_BYTES.
GAP, READ_BYTES, LEVEL = 1 << 16, 1 << 23, 3
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, file string, offset long, length long, url string, digest string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def header_safe(text: str) -> str:
    """Header values hold no line ends; all else stays."""
    return "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in text)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has no body; it names the payload's size and digest and the response it refers to."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_safe(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    raw = "\r\n".join([*head, f"Content-Length: {len(payload)}"]).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    return gzip.compress(raw, LEVEL, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length doesn't match")
    return fields, rest[:n]


def with_payload(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and size; null html is an empty payload."""
    payload = F.encode(common.text_of("html"), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), common.text_of("url").alias("url"), payload.alias("payload")).select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds refers_to: of equal payloads of DEDUP_BYTES or more, the page with the largest id is kept whole and the others refer to it. Rows that share this largest id are all kept whole."""
    own = with_payload(pages)
    slim = own.where(F.col("n") >= DEDUP_BYTES).groupBy("digest", "n").agg(F.max("page_id").alias("_last"), F.count("*").alias("_k")).where("_k > 1").drop("_k")
    slim = common.stored(slim, "repeated")  # a table, so that Spark can split a frequent payload's side of the join
    refers = F.when((F.col("page_id") != F.col("_last")) | F.col("page_id").isNull(), F.col("_last"))
    return own.join(slim, ["digest", "n"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a file for each task into ``folder``; returns the index, already written beside the files."""
    spark = pages.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        try:
            for pdf in batches:
                rows = []
                for page, url, payload, digest, refers in zip(*(pdf[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                    out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(raw := record(page, url, bytes(payload), digest, refers))
                    rows.append((page, f"{folder}/{name}", at, len(raw), url, digest))
                    at += len(raw)
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")]).astype({"page_id": "Int64"})
        finally:
            if out:
                out.close()

    common.short_batches(spark)
    return common.stored(with_revisits(pages).mapInPandas(run, INDEX), "warc-index")


def spans(rows: pd.DataFrame) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted index rows as (file, start, end, places of the rows) reads."""
    file, start, end, own = None, 0, 0, []
    for k, (f, a, n) in enumerate(zip(rows["file"], rows["offset"], rows["length"], strict=True)):
        if own and (f != file or a - end > GAP or a + n - start > READ_BYTES):
            yield file, start, end, own
            own = []
        if not own:
            file, start, end = f, a, a
        end = max(end, a + n)
        own.append(k)
    if own:
        yield file, start, end, own


def read(index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of the selected index rows. Reads are sorted by place; each payload is checked against its digest."""
    spark = index.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for file, start, end, own in spans(pdf):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as f:
                    data = f.read_at(end - start, start)
                for k in own:
                    a = int(pdf["offset"].iat[k]) - start
                    head, body = parse_record(zlib.decompress(data[a : a + int(pdf["length"].iat[k])], 31))
                    digest, ident = head["warc-payload-digest"].removeprefix("sha1:"), lambda s: int(s[10:-1]) if s and s[10:-1] else None
                    if head["warc-type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{file}: a payload differs from its digest")
                    rows.append((ident(head["warc-record-id"]), int(head["x-payload-length"]), digest, head["warc-type"], ident(head.get("warc-refers-to", "")), head["warc-target-uri"], body if keep_payload else None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    common.short_batches(spark)
    return index.repartitionByRange(F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset").select(*(x.split()[0] for x in INDEX.split(", "))).mapInPandas(run, RECORD)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """A record for each page, written and read back through the index."""
    index = write(common.table(spark, sf_dir, "pages"), common.fresh_path(spark, "warc"))
    return read(index, keep_payload=False).drop("payload", "url")


OP7_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d from pages),
g as (select *, case when n >= {DEDUP_BYTES} then max(page_id) over (partition by d, n) end last from p)
select page_id, n::bigint payload_bytes, d payload_digest,
  case when last is not null and page_id is distinct from last then 'revisit' else 'response' end record_type,
  case when last is not null and page_id is distinct from last then last end refers_to
from g"""
