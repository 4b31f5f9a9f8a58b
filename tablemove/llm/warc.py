"""WARC archives: write pages as (segmented, chunked, de-duplicated) records; read and reassemble them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import join_small, materialise, small_batches

#: Bytes of a record's block beyond which it is cut into segments, bytes of a transfer chunk, and records of an archive file at most.
SEGMENT, CHUNK, FILE_RECORDS = 16_384, 4_096, 10_000
#: What ends a record. Spark's text writer puts it behind every row.
_END = "\r\n\r\n"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = (
    "record_id string, warc_type string, url string, page_id string, payload_digest string, refers_to string, "
    "segment int, origin string, total_length long, content_type string, block binary, problem string"
)


def payload_digest(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: every five hex digits are four base32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over. Raises ValueError where it breaks off."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = data[end + 2 : end + 2 + size]
        if len(part) < size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk breaks off")
        out.append(part)
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, dechunked if its head says so."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("no end of the HTTP head")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower():
            return dechunked(body)
    return body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _clean(value: object) -> str | None:
    return None if value is None else " ".join(str(value).split())


def records(serial: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int) -> list[bytes]:
    """The records of one page: a revisit, or a response in as many segments as it takes. Segments end between code points."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{serial}>"
    fields = [("WARC-Record-ID", name), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _clean(url)), ("WARC-Page-ID", page_id)]
    about = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([("WARC-Type", "revisit"), *fields, *about, ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], _HEAD)]
    block = _HEAD + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), *fields, *about], block)]
    cuts = [0]
    while cuts[-1] < len(block):
        end = min(len(block), cuts[-1] + segment)
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end -= 1
        cuts.append(end)
    out = [_record([("WARC-Type", "response"), *fields, *about, ("WARC-Segment-Number", 1)], block[: cuts[1]])]
    for k, (a, b) in enumerate(zip(cuts[1:], cuts[2:]), 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), *fields[1:], ("WARC-Segment-Origin-ID", name)]
        total = [("WARC-Segment-Total-Length", len(block))] if b == len(block) else []
        out.append(_record([*own, ("WARC-Segment-Number", k), *total], block[a:b]))
    return out


def write_archives(
    spark: SparkSession, pages: DataFrame, path: str, *, least_bytes: int = 0, segment: int = SEGMENT, id_col: str = "page_id", url: str = "url", page: str = "html"
) -> None:
    """Write a record per page (its payload the html in UTF-8; null: empty) as gzipped WARC files in folder ``path``.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the
    largest id is a response and the others are revisits of it; smaller ones are all responses, and so are pages whose id is
    null or equals the largest (repeated rows). Equal means equal in SHA-1 and length.
    Digests are counted map-side. Only revisits are looked up by page; the html itself is not shuffled unless
    there are more revisits than a broadcast may hold. Spark's text writer commits the files,
    in whatever store ``path`` names: what lost executors have left over is never read.
    """
    small_batches(spark)
    data = F.coalesce(F.col(page).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), data.alias("data"))
    rows = rows.withColumn("digest", payload_digest(F.col("data"))).withColumn("size", F.octet_length("data"))
    light = rows.where(F.col("id").isNotNull() & (F.col("size") >= least_bytes)).select("id", "digest", "size")
    light = materialise(spark, light, "warc-digests")
    last = light.groupBy("digest", "size").agg(F.max("id").alias("to"), F.min("id").alias("from")).where("to <> from")
    last = materialise(spark, last.drop("from"), "warc-copies")
    revisits = light.join(last, ["digest", "size"]).where("id <> to").select("id", "digest", "to").distinct()
    revisits = materialise(spark, revisits, "warc-revisits")
    rows = join_small(rows, revisits, ["id", "digest"]).withColumn("serial", F.monotonically_increasing_id())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            made: list[bytes] = []
            gone = zip(f["id"].isna(), f["to"].isna())
            for (no_id, no_to), serial, page_id, where, payload, digest, to in zip(gone, f["serial"], f["id"], f["url"], f["data"], f["digest"], f["to"]):
                made += records(serial, None if no_id else int(page_id), where, payload, digest, None if no_to else int(to), segment)
            yield pd.DataFrame({"record": made})

    text = rows.select("serial", "id", "url", "data", "digest", "to").mapInPandas(write, "record binary")
    text = text.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """Records of one archive file (gzipped as a whole or by record, or plain) as rows of ``RECORD``.

    A file that breaks off, or does not start a record where one is due, ends with a row that has a ``problem``.
    """
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                yield (*[None] * 11, f"no record starts with {line[:40]!r}")
                return
            head: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            size = int(head.get("content-length", "0"))
            block = stream.read(size)
            digest = head.get("warc-payload-digest")
            yield (
                head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-page-id"),
                digest.partition(":")[2] if digest else None, head.get("warc-refers-to"),
                int(head["warc-segment-number"]) if "warc-segment-number" in head else None, head.get("warc-segment-origin-id"),
                int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, head.get("content-type"),
                block, None if len(block) == size else "the block breaks off",
            )
    except (OSError, EOFError, ValueError) as e:
        yield (*[None] * 11, f"{type(e).__name__}: {e}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path`` (see ``RECORD``); a file is parsed as a stream, a few MB at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("content")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for frame in batches:
            for content in frame["content"]:
                held, size = [], 0
                for row in parse(content):
                    held.append(row)
                    size += len(row[10] or b"")
                    if size > 4_000_000 or len(held) >= 500:
                        yield _frame(held, names)
                        held, size = [], 0
                if held:
                    yield _frame(held, names)

    return files.mapInPandas(of, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"segment": "Int32", "total_length": "Int64"})


def reassembled(segments: list[tuple[int, bytes, int | None]]) -> tuple[bytes, str | None]:
    """The whole block of (number, bytes, total length) segments in any order, and what is wrong with it, if anything is."""
    by = {}
    for number, block, _ in segments:
        if by.setdefault(number, block) != block:
            return b"", f"segment {number} is there twice with different bytes"
    total = {t for _, _, t in segments if t is not None}
    whole = b"".join(by[k] for k in sorted(by))
    if sorted(by) != list(range(1, len(by) + 1)):
        return whole, "a segment is missing"
    if len(total) != 1:
        return whole, "the last segment is missing" if not total else "total lengths differ"
    return whole, None if len(whole) == total.pop() else "the total length differs"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``url``, ``record_type``, ``payload``, ``payload_digest``, ``refers_to``, ``problem`` of every response and revisit in ``path``.

    Segments are grouped by their origin (a record's size bounds a group; whole
    records are never shuffled), ordered by number and checked against the total length; then transfer framing is
    decoded and the payload's digest compared with the record's. A record that fails a
    check has a ``problem`` and a null payload, and so has a file that breaks off. A revisit has no payload of its own. Records of
    other types are passed over. Empty folders give no rows.
    """
    small_batches(spark)
    found = read_records(spark, path)
    one = found.where("segment is null and (problem is not null or warc_type in ('response', 'revisit'))")
    parts = found.where("segment is not null and problem is null").withColumn("origin", F.coalesce("origin", "record_id"))
    names = ["record_id", "warc_type", "url", "page_id", "payload_digest", "refers_to", "block", "problem"]

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(n), bytes(b), None if pd.isna(t) else int(t)) for n, b, t in zip(frame["segment"], frame["block"], frame["total_length"])]
        block, problem = reassembled(rows)
        first = frame.sort_values("segment", kind="stable").iloc[:1][names].copy()
        first["block"], first["problem"] = [block], [problem]
        return first

    joined = parts.groupBy("origin").applyInPandas(join, found.select(*names).schema)
    broken = found.where("segment is not null and problem is not null").select(*names)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out, problems = [], []
            for kind, block, digest, problem in zip(f["warc_type"], f["block"], f["payload_digest"], f["problem"]):
                payload = None
                if kind == "response" and not problem:
                    try:
                        payload = http_payload(bytes(block))
                        if digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            payload, problem = None, "the payload digest differs"
                    except ValueError as e:
                        problem = str(e)
                out.append(payload)
                problems.append(problem)
            yield f.assign(payload=out, problem=problems)[["page_id", "url", "warc_type", "payload", "payload_digest", "refers_to", "problem"]]

    decoded = one.select(*names).unionByName(joined).unionByName(broken).mapInPandas(
        decode, "page_id string, url string, warc_type string, payload binary, payload_digest string, refers_to string, problem string"
    )
    return decoded.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.col("warc_type").alias("record_type"), "payload", "payload_digest",
        F.regexp_extract("refers_to", r"^<urn:page:(\d+)", 1).try_cast("long").alias("refers_to"), "problem",
    )


def resolve(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``pages`` as :func:`read_pages` gives them, without payloads: ``payload_bytes`` and ``payload_digest``, for revisits those of the response that they refer to.

    Every record keeps its row. One with a ``problem`` has no ``payload_bytes``, and no more than its headers say; a
    revisit of it has no ``payload_bytes`` either. Other columns are not handed on.
    """
    light = pages.select(
        "page_id", "url", F.octet_length("payload").cast("long").alias("own"),
        F.coalesce(payload_digest(F.col("payload")), "payload_digest").alias("payload_digest"), "record_type", "refers_to", "problem",
    )
    light = materialise(spark, light, "warc-read")
    sound = light.where("record_type = 'response' AND problem IS NULL")
    by = sound.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("own").alias("_bytes")).distinct()
    rows = light.join(by, ["refers_to", "payload_digest"], "left")
    return rows.select("page_id", "url", F.coalesce("own", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "problem")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
h AS (SELECT page_id, octet_length(data)::BIGINT AS payload_bytes, sha1(data) AS hex FROM p),
b AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last,
    list_aggregate(list_transform(range(0, 8), lambda k: list_aggregate(list_transform([32768, 1024, 32, 1],
      lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (1 + 5 * k)::INTEGER, 5))::BIGINT // d) % 32 + 1)::INTEGER, 1)),
      'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
