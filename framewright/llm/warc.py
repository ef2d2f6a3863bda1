"""WARC archives: writing, reading, and revisit resolution by payload digest.

Archives are rows (archive, content) with whole gzip members of one record each, so that Spark's own
writers and readers move them through any store; `export_files` writes them out as .warc.gz files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import saved

#: Bytes after which a task begins its next archive.
ARCHIVE_BYTES = 8 << 20
#: Payloads shorter than this are never written as revisits.
LEAST_BYTES = 1000
#: Fixed value of the WARC standard for revisits of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records carry this date: the tables have none.
DATE = "2024-01-01T00:00:00Z"
#: Up to so many revisits their keys are broadcast to the payloads; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Types of records that hold a payload.
PAYLOADS = ("response", "resource", "revisit")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_record string"
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string())


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes, length: int | None = None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, whose length is that of the full payload (`length`, if no payload is given), and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _one_line(url: str | None) -> str:
    return " ".join((url or "").split())


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, each inflated on its own, from slices so that no rest is copied again and again."""
    view, at = memoryview(content), 0
    while at < len(view):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            piece = view[at : at + 65536]
            if not piece:
                raise ValueError("the archive ends within a record")
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block as long as the header says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def write_archives(records: DataFrame) -> DataFrame:
    """(archive, content) from rows (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload); revisits need no payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{number:06d}.warc.gz"], "content": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, kind, refers_to, length, digest, payload = (c[k].as_py() for c in batch.columns)
                held.append(record(page_id, url, kind, refers_to, digest, payload or b"", length))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    number, held, size = number + 1, [], 0
        if held:
            yield archive()

    return records.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload").mapInArrow(run, "archive string, content binary")


def hex_digest(field: str | None) -> str | None:
    """A payload digest field as bare lower-case hex: base 32 is decoded, a name before a colon goes."""
    value = (field or "").rpartition(":")[2].strip()
    if len(value) == 32 and set(value.upper()) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        return base64.b32decode(value.upper()).hex()
    return value.lower() or None


def _row(h: dict[str, str], block: bytes) -> tuple:
    """A record's header fields and block as the columns of RECORD."""
    kind, payload = h["warc-type"], None
    if kind != "revisit":
        payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
    length, digest = (None, hex_digest(h.get("warc-payload-digest"))) if payload is None else (len(payload), hashlib.sha1(payload).hexdigest())
    page, target = (int(h[k]) if k in h else None for k in ("x-page-id", "x-refers-to-page"))
    return page, h.get("warc-target-uri"), kind, target, length, digest, payload, h.get("warc-record-id"), h.get("warc-refers-to")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records with payloads of archives (archive, content), as RECORD rows; other types (warcinfo, request and so on) are passed over.

    payload_bytes and payload_digest are computed from the payload; a revisit has none, so its digest is the header's and its bytes
    are null until it is resolved. Archives of other writers have no page ids, so those are null there.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for data in members(content.as_buffer()):
                    h, block = parse(data)
                    if h.get("warc-type") not in PAYLOADS:
                        continue
                    rows.append(_row(h, block))
                    size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)

    return archives.select("content").mapInArrow(run, RECORD)


def with_types(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """record_type and refers_to for headers (page_id, payload_digest, payload_bytes, ...).

    Of equal payloads of at least `least_bytes`, every record
    with the largest id is the response (rows that repeat it too, and all if every id is null), the
    others revisit it; shorter payloads are all responses. Headers are gathered by digest, pre-aggregated in each task; the join back is an equi-join
    that can split a digest with many rows.
    """
    key = [F.col("payload_digest"), F.col("payload_bytes")]
    originals = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy(*key).agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    revisit: Column = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return (
        headers.join(originals, ["payload_digest", "payload_bytes"], "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("original")))
        .drop("original", "copies")
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) of pages; a null html is an empty payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    return pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})


def settled(records: DataFrame) -> DataFrame:
    """Records of a crawl with record_type and refers_to: responses with their payload, revisits without.

    Only headers (id, URL, digest, bytes) are shuffled by digest, and they are all that a revisit's record needs. Payloads stay where they
    are read: those of revisits are left out there by id and digest. The revisits' ids and digests are
    broadcast where a count shows that they are few; else that is a join by id and digest.
    """
    headers = saved(records.drop("payload"), "crawled")
    revisits = saved(with_types(headers).filter("record_type = 'revisit'"), "revisits")
    gone = revisits.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    if revisits.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    responses = records.join(gone, same, "left_anti").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    return responses.select(names).unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")).select(names))


def resolve(records: DataFrame) -> DataFrame:
    """Fill each revisit's payload_bytes and refers_to from the response that it refers to: the record that it names, else one of
    the same digest, of several that with the largest id. Where there is none, both stay as they are (bytes null)."""
    revisit = F.col("record_type").eqNullSafe("revisit")
    revisits, others = records.filter(revisit), records.filter(~revisit)

    def filled(open_: DataFrame, key: str, target: str) -> DataFrame:
        # only records that are wanted are gathered; responses refer to nothing, and null keys would all meet in one task
        wanted = open_.select(F.col(key).alias(target)).filter(F.col(target).isNotNull()).distinct()
        found = others.join(wanted, target, "left_semi").groupBy(F.col(target).alias(key)).agg(F.max("payload_bytes").alias("full"), F.max("page_id").alias("page"))
        out = open_.filter(F.col(key).isNotNull()).join(found, key, "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "full")).withColumn("refers_to", F.coalesce("refers_to", "page"))
        return out.select(records.columns).unionByName(open_.filter(F.col(key).isNull()))

    named = saved(filled(revisits, "refers_to_record", "record_id"), "named")
    digested = filled(named.filter("payload_bytes IS NULL"), "payload_digest", "payload_digest")
    return others.unionByName(named.filter("payload_bytes IS NOT NULL")).unionByName(digested)


def deduplicate(pages: DataFrame) -> DataFrame:
    """Archives of the pages in which copies are revisits, written to the shared folder."""
    return saved(write_archives(settled(crawl_records(pages))), "archives")


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from its archives.

    Null html is an empty payload and a response; a page whose id is null keeps a null id; rows that
    repeat stay; columns other than page_id, url and html don't matter; no pages, no rows.
    """
    heads = saved(read_archives(deduplicate(pages)).drop("payload", "url"), "headers")
    return resolve(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export_files(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file below `folder`, which all machines must share."""

    def write(rows) -> None:
        for row in rows:
            with open(f"{folder}/{row.archive}", "wb") as out:
                out.write(row.content)

    archives.foreachPartition(write)
