"""WARC archives of landed source pages: writing, reading back and reassembling segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.store import saved

# Names and marks of the archive format.
VERSION = b"WARC/1.1\r\n"
MARK = b"WARC/1."  # what all versions that can be read begin with
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT_BYTES = 16 << 10   # a longer block continues in further records
CHUNK_BYTES = 4 << 10      # payloads are framed in chunks of at most this size
REVISIT_BYTES = 1_000      # equal payloads from this size on are written once
CAPTURED_AT = "2026-06-01T00:00:00Z"

_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("record_id", "origin_id", "record_type", "refers_to")]) \
    .add("segment", "integer").add("total_bytes", "long").add("digest", "string").add("block", "binary")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing.

    A chunk also ends inside every archive mark that the payload holds, so that no framed
    block contains a mark and records can be found by it.
    """
    cuts, at = {0, len(payload)}, payload.find(VERSION)
    cuts.update(range(size, len(payload), size))
    while at >= 0:
        cuts.add(at + 4)
        at = payload.find(VERSION, at + 1)
    edges = sorted(cuts)
    out = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """Payload of chunked framing; chunk extensions and trailers are skipped, a cut-off frame is an error."""
    out, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked framing ends early")
        size, at = int(framed[at:line].split(b";")[0], 16), line + 2
        if not size:
            return b"".join(out)
        if len(framed) < at + size + 2:
            raise ValueError("chunked framing ends early")
        out.append(framed[at: at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + lines.encode() + b"\r\n" + block


def _urn(page_id, row: int | None = None) -> str:
    """Record id of a page; the rows of a repeated or missing page id are told apart by a row number."""
    return f"<urn:page:{page_id}>" if row is None else f"<urn:page:{'' if page_id is None else page_id}:row:{row}>"


def _page_records(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    own = [("WARC-Record-ID", record_id), ("WARC-Date", CAPTURED_AT),
           ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *own, ("WARC-Refers-To", refers_to),
                       ("WARC-Profile", REVISIT_PROFILE)], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts, at = [], 0
    while at < len(block):
        parts.append(block[at: at + segment_bytes])
        at += segment_bytes
    first = [("WARC-Type", "response"), *own]
    if len(parts) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}:{n}>"), ("WARC-Date", CAPTURED_AT),
                       ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(n)), *last], part)


def write_archives(pages: DataFrame, path: str, page: str = "page_id", url: str = "source_url", payload: str = "html",
                   segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one record per page below ``path``, as compressed archives in Spark's own task files.

    Of pages with equal payloads of ``REVISIT_BYTES`` or more, the one with the largest id is a
    response and the others revisit it.  The choice is a partial maximum per digest, so a payload
    that a third of all pages share costs each task one row.  NULL payloads are empty.  Other
    columns are ignored.  Payloads stay where they lie.

    Page ids may repeat or be NULL: every row is a record of its own, with a row number in its id.
    Rows that repeat the largest id are all responses; revisits refer to one of them.  A NULL id is
    smaller than any other, and of NULL ids alone one row is the response.  Only such rows are
    copied, once, so that their numbers stay.
    """
    own = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.encode(F.coalesce(payload, F.lit("")), "utf-8").alias("body"))
    own = own.withColumn("digest", F.sha1("body"))
    several = saved(own.groupBy("page").agg(F.count("*").alias("rows")).where("page IS NOT NULL AND rows > 1").select("page"), "several")
    n_several = several.count()
    if n_several <= 1_000_000:
        several = F.broadcast(several)
    # A left anti join keeps NULL ids; they go with the repeated ones.
    odd = own.where("page IS NULL")
    if n_several:
        odd = odd.unionByName(own.join(several, "page", "left_semi").select(*own.columns))
    odd = saved(odd.withColumn("row", F.monotonically_increasing_id()), "odd-pages")
    once = own.where("page IS NOT NULL")
    if n_several:
        once = once.join(several, "page", "left_anti").select(*own.columns)
    own = once.withColumn("row", F.lit(None).cast("long")).unionByName(odd)

    large = F.length("body") >= REVISIT_BYTES
    newest = own.where(large).groupBy("digest").agg(F.max(F.struct("page", "row")).alias("response"), F.count("*").alias("pages")) \
        .where("pages > 1").select("digest", "response")
    # Only digests that repeat are joined; payloads are not shuffled while these fit a broadcast.
    if newest.count() <= 1_000_000:
        newest = F.broadcast(newest)
    same = F.when(F.col("response.page").isNull(), F.col("response.row") == F.col("row")).otherwise(
        F.col("response.page").eqNullSafe(F.col("page")))
    rows = own.join(newest, "digest", "left").withColumn(
        "refers_to", F.when(large & F.col("response").isNotNull() & ~same, F.col("response")))

    def write(batches):
        for batch in batches:
            out = []
            for page_id, row, link, body, digest, back in zip(
                    *(batch.column(c).to_pylist() for c in ("page", "row", "url", "body", "digest", "refers_to")), strict=True):
                target = None if back is None else _urn(back["page"], back["row"])
                out.extend(_page_records(_urn(page_id, row), link, body, digest, target, segment_bytes))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.select("page", "row", "url", "body", "digest", "refers_to").mapInArrow(write, "record binary")
    # The text sink writes the bytes as they are and ends each record with the format's end mark.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _parse(fragment: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = fragment.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
    return {k.strip().lower(): v.strip() for k, _, v in fields}, rest


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``: ids, type, segment, declared lengths and block.

    Files of versions 1.0 and 1.1 are read by Spark and cut at the version mark; anything else raises an error.
    Where a block of a foreign archive holds the mark itself, it is shorter than its declared
    length and is joined with what follows.
    """

    def read(batches):
        held = b""
        for batch in batches:
            out = []
            for fragment in batch.column("value").to_pylist():
                held = held + MARK + fragment if held else fragment
                if not held.strip():
                    held = b""
                    continue
                if held[:3] not in (b"0\r\n", b"1\r\n"):
                    raise ValueError("not an archive of version 1.0 or 1.1")
                head, rest = _parse(held[3:])
                size = int(head.get("content-length", "0"))
                if len(rest) < size:
                    continue
                out.append((head.get("warc-record-id"), head.get("warc-segment-origin-id", head.get("warc-record-id")),
                            head.get("warc-type"), head.get("warc-refers-to"), int(head.get("warc-segment-number", "0")),
                            int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None,
                            head.get("warc-payload-digest"), rest[:size]))
                held = b""
            cols = list(zip(*out, strict=True)) or [[]] * len(_RECORD)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _RECORD.names)
        if held.strip():
            raise ValueError("archive ends inside a record")

    lines = spark.read.option("lineSep", MARK.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(read, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records with their payload: ``record_id, record_type, refers_to, digest, payload``.

    Continuations are grouped by the id of their origin and put in the order of their segment
    numbers; a missing segment, a wrong total length, bad framing or a payload that does not have
    its digest is an error that names the record.  Records that came whole are not shuffled.
    """
    whole = records.where("segment = 0").select(
        "record_id", "record_type", "refers_to", "digest", F.lit(None).cast("long").alias("total_bytes"),
        F.array("block").alias("blocks"), F.lit(1).alias("last"))
    joined = records.where("segment > 0").groupBy("origin_id").agg(
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
        F.max("refers_to").alias("refers_to"), F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("digest"),
        F.max("total_bytes").alias("total_bytes"), F.max("segment").alias("last"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    joined = joined.select(F.col("origin_id").alias("record_id"), "record_type", "refers_to", "digest", "total_bytes",
                           F.transform("parts", lambda p: p["block"]).alias("blocks"), "last")

    def decode(batches):
        names = ("record_id", "record_type", "refers_to", "digest", "total_bytes", "blocks", "last")
        for batch in batches:
            payloads = []
            for record, kind, _, digest, total, blocks, last in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                block = b"".join(blocks)
                if len(blocks) != last or (total is not None and total != len(block)) or (last > 1 and total is None):
                    raise ValueError(f"segments of {record} are not complete")
                head, _, body = block.partition(b"\r\n\r\n")
                if kind == "revisit":
                    payloads.append(None)
                    continue
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if digest and digest.removeprefix("sha1:") != hashlib.sha1(payload).hexdigest():
                    raise ValueError(f"payload of {record} does not have its digest")
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(payloads, pa.binary())],
                                             [*names[:4], "payload"])

    return whole.unionByName(joined).mapInArrow(
        decode, "record_id string, record_type string, refers_to string, digest string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Adds ``payload_bytes`` to every record; a revisit has the size of the response it refers to.

    Archives are read once: ids and sizes are written, then sizes are joined for revisits only.
    """
    sized = saved(records.select("record_id", "record_type", "refers_to", "digest",
                                 F.length("payload").cast("long").alias("payload_bytes")), "records")
    revisit = sized.where("record_type = 'revisit'").drop("payload_bytes")
    target = sized.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_bytes")
    return sized.where("record_type != 'revisit'").unionByName(revisit.join(target, "refers_to", "left"))
