"""WARC archives: writing, a normaliser for monolithic gzip files, and reading by the offset index.

An archive that was compressed as one gzip stream can't be read from the middle. The normaliser inflates such a file
once, front to back, writes each record as a gzip member of its own, and beside it an index with a line for each record:
offset, length, record id. Readers then fetch any record alone.

Pages with equal payloads of at least MIN_REVISIT bytes are stored once, as the response with the largest page id; the
others are revisit records that name it. Null html is an empty payload; empty and short payloads are always responses;
a null page id is written as an empty id and read back as null. Repeated rows are records like any other: of rows that
share both page id and payload, all are responses. Other columns are not read. An empty table gives no archive and no rows.
An archive that is cut off or damaged is an error, wherever the cut is.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, new_folder, opened, put_file

MIN_REVISIT = 1000
LEVEL = 3
#: Bytes of payload for each archive, about.
ARCHIVE_BYTES = 256 << 20
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response)."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("long", F.octet_length("payload") >= MIN_REVISIT)
    # Short payloads have keys of their own, which meet nothing and go to many tasks.
    rows = rows.withColumn("key", F.when(F.col("long"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest"))))
    first = rows.where("long").groupBy("key").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(first, "key", "left").select("page_id", "url", "payload", "digest", F.when(F.col("first_id") != F.col("page_id"), F.col("first_id")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    name = "" if page_id is None else page_id
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Each task writes its records as one gzip stream; a row for each archive that was kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, path, size, made = None, "", 0, []

        def close() -> None:
            nonlocal stream
            if stream is not None:
                out.write(stream.flush())
                out.close()
                made.append(path)
                stream = None

        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                if stream is None:
                    path, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    filesystem, name = opened(path)
                    filesystem.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = filesystem.open_output_stream(name, compression=None)
                    stream = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                record = _record(*[c[k].as_py() for c in columns])
                out.write(stream.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["path"])

    return kept(rows.mapInArrow(run, "path string"), "archives")


def _records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an inflated stream into records, by the length each one states."""
    held = bytearray()
    chunks = iter(chunks)

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while need(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not need(looked + 1):
                raise ValueError("an archive ends within a record's header")
        total = end + 8 + int(_fields(held[:end])["content-length"])
        if not need(total):
            raise ValueError("an archive ends within a record")
        yield bytes(held[:total])
        del held[:total]


def _fields(head: bytes) -> dict[str, str]:
    lines = bytes(head).decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def _inflated(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or many members. One that ends before its last member does is an error."""
    stream, begun = zlib.decompressobj(31), False
    while data := source.read(size):
        while data:
            begun = True
            yield stream.decompress(data)
            data = stream.unused_data
            if stream.eof:
                stream, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("an archive ends within its gzip stream")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each archive with a gzip member for each record and a sidecar index: path, index_path, records."""

    def one(path: str) -> tuple[str, str, int]:
        filesystem, name = opened(path)
        target = path.removesuffix(".warc.gz") + ".members.warc.gz"
        lines: list[str] = []

        def write(out) -> None:
            lines.clear()
            offset = 0
            with filesystem.open_input_stream(name, compression=None) as source:
                for record in _records(_inflated(source)):
                    member = gzip.compress(record, LEVEL, mtime=0)
                    out.write(member)
                    lines.append(f"{offset} {len(member)} {_fields(record[: record.find(b'\r\n\r\n')])['warc-record-id']}\n")
                    offset += len(member)

        put_file(target, write)
        put_file(f"{target}.idx", lambda out: out.write("".join(lines).encode()))
        return target, f"{target}.idx", len(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(p.as_py()) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], names=["path", "index_path", "records"])

    return kept(archives.repartition(archives.count() or 1).mapInArrow(run, "path string, index_path string, records bigint"), "members")


def _parsed(member: bytes) -> tuple:
    record = gzip.decompress(member)
    end = record.find(b"\r\n\r\n")
    fields = _fields(record[:end])
    block = record[end + 4 : end + 4 + int(fields["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    size, digest, kind = int(_fields(head)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to", "")), fields["warc-target-uri"]


def read_members(members: DataFrame) -> DataFrame:
    """A row for each record, fetched by the index and checked against its digest."""

    def rows(path: str, index: str) -> Iterator[tuple]:
        filesystem, name = opened(path)
        with filesystem.open_input_stream(opened(index)[1]) as source:
            lines = source.read().decode().splitlines()
        with filesystem.open_input_file(name) as source:
            for line in lines:
                offset, length, _ = line.split(" ", 2)
                yield _parsed(source.read_at(int(length), int(offset)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := list(rows(path, index)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return members.select("path", "index_path").repartition(members.count() or 1).mapInArrow(run, RECORDS)


def archive(pages: DataFrame, label: str = "warc") -> DataFrame:
    """Write pages as archives, normalise them: path, index_path, records of each."""
    return normalise(write_monolithic(with_revisits(pages), new_folder(pages.sparkSession, label)))
