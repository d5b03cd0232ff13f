"""Operator 13, WARC archives: written as whole-file gzip streams, normalised to one member a record, read by index.

Many tools write an archive as one gzip stream, of which no record can be read without inflating all
before it. ``normalised`` inflates each stream once, in pieces, rewrites every record as a gzip member of
its own, and writes a sidecar of offsets beside the archive. ``read_records`` then takes any records by
(archive, offset, length), spread over tasks by bytes and not by file.

Equal payloads are stored once: each later reader gets the record of the largest page id as ``response``
and the others as ``revisit``, which hold the headers of the HTTP response without its payload. Which
record is which is found from the log of the writing pass, digests and ordinals alone; pages are never
shuffled. Tasks name their files anew at each attempt, and only files that a finished task has logged are
read, so a lost executor costs a task. Files lie in the shared folder, reached by ``pyarrow.fs``.

Defined results: null html is an empty payload, and empty payloads are equal like others (``min_bytes``
leaves short ones alone); a null page id is the smallest, and its record has no id field; of rows with
equal id and payload any one is the response; a null url leaves out the target; characters of a url that
a header can't hold are percent-encoded; very long pages are written and rewritten in pieces; columns
beside the three aren't read; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import met, scratch, settled, table, written

#: An archive ends with the record that brings it to so many bytes, or so many records.
ARCHIVE_BYTES = 128 << 20
ARCHIVE_RECORDS = 50_000
PIECE = 1 << 20
#: Bytes of archives that a reading task gets.
READ_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOG = "archive string, nth long, page_id string, record_id string, uri string, payload_digest string, payload_bytes long"
INDEX = "archive string, nth long, offset long, length long, record_type string, record_id string, uri string, payload_digest string"
RECORD = "page_id string, record_id string, uri string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def digest_of(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in ddl.split(", ")]
    return pa.record_batch({c: pa.array([r[c] for r in rows], kinds[kind]) for c, kind in fields})


def _header(fields: dict[str, str | int | None]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None), "\r\n"]).encode()


class _Writer:
    """A file of gzip members: one for the whole file, or one a record."""

    def __init__(self, folder: str, level: int, whole: bool) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        store, at = _opened(self.path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        self.file, self.level, self.whole = store.open_output_stream(at, compression=None), level, whole
        self.raw = self.size = self.records = 0
        self.deflate = self._member()

    def _member(self):
        return zlib.compressobj(self.level, zlib.DEFLATED, 31)

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        self.file.write(data)

    def record(self, pieces: Iterator[bytes]) -> tuple[int, int]:
        """Offset and length of the member; of no use in a whole-file stream."""
        began = self.size
        for piece in pieces:
            self.raw += len(piece)
            self._put(self.deflate.compress(piece))
        self.records += 1
        if not self.whole:
            self._put(self.deflate.flush())
            self.deflate = self._member()
        return began, self.size - began

    def close(self) -> None:
        if self.whole:
            self._put(self.deflate.flush())
        self.file.close()


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url)


def _response(page_id: str | None, url: str | None, payload: bytes, record_id: str, date: str) -> tuple[list[bytes], str]:
    digest = digest_of(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "Page-ID": page_id}
    return [_header(fields | {"Content-Type": "application/http; msgtype=response", "Content-Length": len(http) + len(payload)}), http, payload, b"\r\n\r\n"], digest


def _page_writer(folder: str, date: str, most_bytes: int, most_records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            log = []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if out and (out.raw >= most_bytes or out.records >= most_records):
                    out.close()
                    out = None
                out = out or _Writer(folder, 1, True)
                uri, payload = _uri(url), html or b""
                record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{out.path}#{out.records}')}>"
                pieces, digest = _response(page_id, uri, payload, record_id, date)
                log.append({"archive": out.path, "nth": out.records, "page_id": page_id, "record_id": record_id, "uri": uri, "payload_digest": digest, "payload_bytes": len(payload)})
                out.record(iter(pieces))
            yield _batch(log, LOG)
        if out:
            out.close()

    return run


def write_pages(pages: DataFrame, folder: str, date: str = DATE, most_bytes: int = ARCHIVE_BYTES, most_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Write a response record per row of (page_id, url, html), each archive one gzip stream; return the log of what was written."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    return written(rows.mapInArrow(_page_writer(folder, date, most_bytes, most_records), LOG), "warc-log")


def revisits(log: DataFrame, min_bytes: int = 0, order: str = "bigint") -> DataFrame:
    """(archive, nth, to_page, to_record, to_uri): the records of a log that repeat another's payload, and that record.

    order: the type of page ids, by which the largest is found.
    """
    top = F.max(F.struct(F.col("page_id").cast(order).alias("id"), "archive", "nth", "page_id", "record_id", "uri"))
    groups = log.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), top.alias("top")).where("n > 1")
    found = met(log, written(groups, "warc-groups"), "payload_digest", row_bytes=512)
    return found.where("archive <> top.archive OR nth <> top.nth").select("archive", "nth", F.col("top.page_id").alias("to_page"), F.col("top.record_id").alias("to_record"), F.col("top.uri").alias("to_uri"))


class Inflated:
    """A gzip file of one member or many, read on in pieces."""

    def __init__(self, file) -> None:
        self.file, self.inflate, self.held, self.rest = file, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        data = self.rest or self.file.read(PIECE)
        if not data:
            if self.inflate.eof:
                return False
            last = self.inflate.decompress(b"", PIECE)  # output that the last piece had no room for
            if not last:
                raise ValueError("the gzip stream is cut off")
            self.held += last
            return True
        self.rest = b""
        if self.inflate.eof:
            data = data.lstrip(b"\0")  # some tools pad members
            self.inflate = zlib.decompressobj(31) if data else self.inflate
        if data:
            self.held += self.inflate.decompress(data, PIECE)
            self.rest = self.inflate.unconsumed_tail or self.inflate.unused_data
        return True

    def until(self, end: bytes) -> bytes | None:
        """What lies before and with ``end``; None at the end of the file."""
        looked = 0
        while (at := self.held.find(end, max(0, looked - len(end)))) < 0:
            looked = len(self.held)
            if not self._more():
                if self.held.strip():
                    raise ValueError("a record is cut off")
                return None
        return self._take(at + len(end))

    def _take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            if not self.held and not self._more():
                raise ValueError("a record is cut off")
            piece = self._take(min(n, len(self.held)))
            n -= len(piece)
            if piece:
                yield piece


def _fields(header: bytes) -> dict[str, str]:
    """The fields of a header, by lower-cased name; a folded line goes on its field."""
    lines = re.sub(r"\r?\n[ \t]+", " ", header.decode("utf-8", "replace")).splitlines()
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def records(stream: Inflated) -> Iterator[tuple[bytes, dict[str, str]]]:
    """Header and fields of each record; its block must be taken from the stream before the next."""
    while (header := stream.until(b"\r\n\r\n")) is not None:
        header = header.lstrip(b"\r\n")
        if header:
            if not header.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {header[:20]!r}")
            yield header, _fields(header)


def _revisit(fields: dict[str, str], stream: Inflated, to: dict) -> list[bytes]:
    """The revisit record of a response: its HTTP headers and no payload."""
    http = stream.until(b"\r\n\r\n")
    for _ in stream.pieces(int(fields["content-length"]) - len(http)):
        pass
    return [
        _header({
            "WARC-Type": "revisit", "WARC-Record-ID": fields["warc-record-id"], "WARC-Date": fields["warc-date"], "WARC-Target-URI": fields.get("warc-target-uri"),
            "WARC-Payload-Digest": fields.get("warc-payload-digest"), "WARC-Profile": REVISIT, "WARC-Refers-To": to["to_record"], "WARC-Refers-To-Target-URI": to["to_uri"],
            "Page-ID": fields.get("page-id"), "Refers-To-Page-ID": to["to_page"], "Content-Type": fields.get("content-type"), "Content-Length": len(http),
        }),
        http, b"\r\n\r\n",
    ]


def normalise(archive: str, repeats: dict[int, dict], folder: str, level: int = 6) -> Iterator[dict]:
    """Rewrite one archive and write its sidecar, a line of JSON a record; yield the index rows."""
    store, at = _opened(archive)
    out = _Writer(folder, level, False)
    side = store.open_output_stream(_opened(out.path)[1].removesuffix(".warc.gz") + ".index.jsonl", compression=None)
    with store.open_input_stream(at, compression=None) as file:
        stream = Inflated(file)
        for nth, (header, fields) in enumerate(records(stream)):
            if nth in repeats:
                kind, pieces = "revisit", iter(_revisit(fields, stream, repeats[nth]))
            else:
                kind, pieces = fields.get("warc-type"), _rewritten(header, fields, stream)
            offset, length = out.record(pieces)
            row = {"archive": out.path, "nth": nth, "offset": offset, "length": length, "record_type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
            side.write(json.dumps(row | {"archive": out.path.rpartition("/")[2]}).encode() + b"\n")
            yield row
    out.close()
    side.close()


def _rewritten(header: bytes, fields: dict[str, str], stream: Inflated) -> Iterator[bytes]:
    yield header
    yield from stream.pieces(int(fields["content-length"]))
    yield b"\r\n\r\n"


def _normaliser(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, repeats in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for row in normalise(archive, {r["nth"]: r for r in repeats or ()}, folder):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows, INDEX)
                        rows = []
                yield _batch(rows, INDEX)

    return run


def normalised(archives: DataFrame, folder: str, repeats: DataFrame | None = None) -> DataFrame:
    """Rewrite the archives (archive), whole-file streams or not, with one member a record; return the offset index.

    repeats: what ``revisits`` found. A task has one archive; its records are bounded, and so are its repeats.
    """
    spark, plan = archives.sparkSession, archives.select("archive").distinct()
    if repeats is None:
        plan = plan.withColumn("repeats", F.lit(None).cast("array<struct<nth:bigint,to_page:string,to_record:string,to_uri:string>>"))
    else:
        plan = plan.join(repeats.groupBy("archive").agg(F.collect_list(F.struct("nth", "to_page", "to_record", "to_uri")).alias("repeats")), "archive", "left")
    plan = written(plan, "warc-plan")
    tasks = max(1, plan.count())
    return written(plan.repartition(min(tasks, 50 * int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_normaliser(folder), INDEX), "warc-index")


def read_member(data: bytes, keep: bool = True) -> dict:
    """A record from its own gzip member; the payload's digest is checked."""
    raw = zlib.decompress(data, 31)
    header, _, block = raw.partition(b"\r\n\r\n")
    fields = _fields(header)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    if kind == "revisit":
        size, digest, payload = int(_fields(http).get("content-length", 0)), stated, None
    else:
        size, digest = len(payload), digest_of(hashlib.sha1(payload).digest())
        if stated and digest != stated:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} isn't that of its digest")
    return {"page_id": fields.get("page-id"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("refers-to-page-id"), "payload": payload if keep else None}


def _member_reader(keep: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != path:
                    store, at = _opened(archive)
                    path, file = archive, store.open_input_file(at)
                rows.append(read_member(file.read_at(length, offset), keep))
                held += length
                if held > PIECE * 8:
                    yield _batch(rows, RECORD)
                    rows, held = [], 0
            yield _batch(rows, RECORD)

    return run


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of an index (archive, offset, length, and others), in tasks of about equal bytes."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = index.select("archive", "offset", "length").repartitionByRange(total // READ_BYTES + 1, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_member_reader(payloads), RECORD)


def archived(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, then normalise them with revisits; return the offset index."""
    log = write_pages(pages, f"{folder}/whole")
    return normalised(log, f"{folder}/members", revisits(log, min_bytes, dict(pages.dtypes)["page_id"]))


@settled
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = read_records(archived(pages, scratch(spark, "warc")), payloads=False)
    kind = dict(pages.dtypes)["page_id"]
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substring(sha1(t), 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN top END AS refers_to
FROM p"""
