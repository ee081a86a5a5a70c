"""WARC archives: write, normalise whole-file gzip into one member per record, read back by offset."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialized, new_folder, ranges
from corpusmill.llm.files import new_file, opened, opened_at

READ = 1 << 20


@dataclass(frozen=True)
class WarcParams:
    """Payloads of ``revisit_from`` bytes or more are stored once; ``archive_bytes`` closes an archive."""

    revisit_from: int = 0
    archive_bytes: int = 32 << 20
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


def _id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(value: str | None) -> int | None:
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text and text != "none" else None


def record(page, url, payload: bytes, digest: str, refers_to, params: WarcParams) -> bytes:
    """One WARC record; a revisit (``refers_to`` set) holds the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {params.date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_id(refers_to)}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def _marked(pages: DataFrame, params: WarcParams, key: str, url: str, html: str) -> DataFrame:
    """Pages with the digest and, for later copies of a payload, the page that holds it."""
    chosen = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    digest = F.sha1("payload")
    first = (
        chosen.where(F.octet_length("payload") >= params.revisit_from)
        .groupBy(digest.alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").select("_digest", "_first")
    )
    joined = chosen.withColumn("digest", digest).join(first, F.col("digest") == F.col("_digest"), "left")
    later = (F.col("page_id") != F.col("_first")) & (F.octet_length("payload") >= params.revisit_from)
    return joined.select("page_id", "url", "payload", "digest", F.when(later, F.col("_first")).alias("refers_to"))


def write_monolithic(
    pages: DataFrame, params: WarcParams = WarcParams(), folder: str | None = None, key: str = "page_id",
    url: str = "url", html: str = "html",
) -> DataFrame:
    """Archives in which one gzip member holds all records; one row per archive: path, records."""
    folder = folder or new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = out = uri = squeeze = None
        records, size, done = 0, 0, []

        def close():
            nonlocal context, records, size
            out.write(squeeze.flush())
            context.__exit__(None, None, None)
            done.append((uri, records))
            context, records, size = None, 0, 0

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, first = (batch.column(k)[row].as_py() for k in range(5))
                if context is None:
                    context = new_file(folder, "crawl", ".warc.gz")
                    out, uri = context.__enter__()
                    squeeze = zlib.compressobj(params.level, zlib.DEFLATED, 31)
                whole = record(page, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), first, params)
                out.write(squeeze.compress(whole))
                records, size = records + 1, size + len(whole)
                if size >= params.archive_bytes:
                    close()
        if context is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            ["path", "records"],
        )

    listed = new_folder(pages.sparkSession, "archives")
    _marked(pages, params, key, url, html).mapInArrow(run, "path string, records long").write.parquet(listed)
    return pages.sparkSession.read.parquet(listed)


class _Inflated:
    """Inflates a gzip stream of one or more members once, front to back."""

    def __init__(self, source):
        self.source, self.inflate, self.buffer, self.ended = source, zlib.decompressobj(31), bytearray(), False

    def more(self) -> bool:
        if self.ended:
            return False
        data = self.source.read(READ)
        if not data:
            if not self.inflate.eof:
                raise ValueError("the gzip stream ends inside a member")
            self.ended = True
            return False
        while data:
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(data)
            data = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with ``mark``; None at the end of the stream."""
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                if self.buffer:
                    raise ValueError("the stream ends inside a record head")
                return None
        return self._cut(at + len(mark))

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in parts, never all in memory."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the stream ends inside a record")
            part = self._cut(min(n, len(self.buffer)))
            n -= len(part)
            yield part

    def _cut(self, n: int) -> bytes:
        part = bytes(self.buffer[:n])
        del self.buffer[:n]
        return part


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def normalised(archives: DataFrame, params: WarcParams = WarcParams(), folder: str | None = None) -> DataFrame:
    """Rewrite each archive with one gzip member per record, and a sidecar ``.idx`` beside it.

    The input is inflated once as a stream, in memory of one read block, as it
    cannot be entered in the middle.  Each index line has offset, length, type
    and record id, so a reader can fetch any record alone.  One row per archive:
    path, index_path, records.  Damaged or cut streams are an error that names the file.
    """
    spark = archives.sparkSession
    folder = folder or new_folder(spark, "warc-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    made, index, count = rewrite(path)
                except (ValueError, zlib.error) as error:
                    raise ValueError(f"{path}: {error}") from error
                if count != expected:
                    raise ValueError(f"{path}: {count} records, not {expected}")
                yield pa.RecordBatch.from_pylist([{"path": made, "index_path": index, "records": count}])

    def rewrite(path: str) -> tuple[str, str, int]:
        lines, offset = [], 0
        with opened(path) as source, new_file(folder, "crawl", ".warc.gz") as (out, made):
            stream = _Inflated(source)
            while (head := stream.until(b"\r\n\r\n")) is not None:
                fields = _fields(head)
                squeeze, length = zlib.compressobj(params.level, zlib.DEFLATED, 31), 0
                body = stream.exactly(int(fields["content-length"]) + 4)
                for data in (squeeze.compress(head), *map(squeeze.compress, body), squeeze.flush()):
                    out.write(data)
                    length += len(data)
                lines.append(f"{offset} {length} {fields['warc-type']} {fields['warc-record-id']}\n")
                offset += length
        with new_file(folder, made.rsplit("/", 1)[1], ".idx") as (out, index):
            out.write("".join(lines).encode())
        return made, index, len(lines)

    listed = new_folder(spark, "archives")
    # A row is a whole archive: without a number adaptive execution would put them all in one task.
    archives.select("path", "records").repartition(ranges(spark), "path").mapInArrow(
        run, "path string, index_path string, records long"
    ).write.parquet(listed)
    return spark.read.parquet(listed)


def read_members(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of normalised archives, fetched by the offsets of the sidecar index.

    A response's digest and length are computed from its payload and compared
    with its head; a revisit's come from its head, as its payload stands in the
    record that it refers to.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [f.split()[0] for f in schema.split(", ")] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(index) as source:
                    lines = [line.split(" ", 2) for line in source.read().decode().splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lines), pa.string()), *[pa.array([int(x[i]) for x in lines], pa.int64()) for i in (0, 1)]],
                    ["path", "offset", "length"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, source, context, at = [], 0, None, None, (None, 0)
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (path, offset):  # seek to the member; the next one often follows
                    if context:
                        context.__exit__(None, None, None)
                    context = opened_at(path, offset)
                    source = context.__enter__()
                rows.append(row := one(source.read(length)))
                held, at = held + len(row[6]), (path, offset + length)
                if len(rows) >= 4096 or held > 8 << 20:
                    yield made(rows)
                    rows, held = [], 0
        if context:
            context.__exit__(None, None, None)
        if rows:
            yield made(rows)

    def one(member: bytes) -> tuple:
        head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
        fields = _fields(head)
        http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        length = int(_fields(http)["content-length"])
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if (found, len(payload)) != (digest, length):
                raise ValueError(f"{fields['warc-record-id']}: payload and head disagree")
        return (
            _page(fields["warc-record-id"]), fields.get("warc-target-uri"), length, digest, kind,
            _page(fields.get("warc-refers-to")), payload,
        )

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names
        )

    n = ranges(archives.sparkSession)
    members = materialized(
        archives.select("path", "index_path").repartition(n, "path").mapInArrow(
            listed, "path string, offset long, length long"
        ),
        "members",
    )
    # An archive of any size is shared out by its offsets; a task reads members that mostly follow each other.
    dealt = members.repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, schema + ", payload binary" * payloads)


def archived_pages(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write the pages as archives, normalise them, and read the normalised ones back.

    Of equal payloads of ``revisit_from`` bytes or more the smallest page_id is
    the response and the others revisit it; rows that share the smallest id are
    all responses.  Null html is an empty payload, a null url gives no target, a
    null page_id is a page without id.  An empty table gives no archive and no
    rows.
    """
    return read_members(normalised(write_monolithic(pages, params), params))
