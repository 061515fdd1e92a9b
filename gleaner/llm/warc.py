"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Every record is a gzip member of its own. The reader takes an archive as a stream of blocks, inflates it step by step, frames
each record by its Content-Length and checks its digests, so its memory is one record's.

Archives are written by the executors into a folder that all of them reach, through pyarrow's file systems. A task names its
files after its attempt; which files count is said by the manifest, a table that Spark commits, so what a lost executor left
behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import maybe_broadcast, spread_lookup
from gleaner.session import Workspace

#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT = 1000
#: An archive is closed after this many uncompressed bytes.
ARCHIVE_BYTES = 128 << 20
BLOCK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records bigint, payload_bytes bigint"
RECORD = (
    "archive string, position bigint, record_type string, page_id bigint, url string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary, error string"
)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(text: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit has the HTTP head, which tells the payload's length, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_one_line(url)}"]),
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write_task(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, out, size, count, payloads = [], None, 0, 0, 0
        name = ""
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, size, count, payloads = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, 0
                payload = html.as_py() or b""
                record = record_bytes(page.as_py(), url.as_py(), payload, refers.as_py())
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(packer.compress(record) + packer.flush())
                size, count, payloads = size + len(record), count + 1, payloads + len(payload)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", count, payloads))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, payloads))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "payload_bytes"])

    return write


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``html`` in bytes and ``refers_to``, the page_id that a revisit refers to, else null.

    Of equal payloads of at least 1000 bytes the one with the largest page_id is stored, repeated rows of it each; null ids
    are stored too. Only ids and digests are shuffled, unless there are more revisits than may be broadcast.
    """
    work = Workspace(pages.sparkSession, "revisits")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    long = rows.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", F.sha2("html", 256).alias("digest"))
    long = work.write(long.where("page_id is not null"), "digests")
    groups = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    groups = work.write(groups, "groups")
    links = spread_lookup(long, groups, "digest", "n", long.count()).where("page_id < refers_to")
    links = work.write(links.select(F.col("page_id").alias("id"), "digest", "refers_to").distinct(), "links")
    # The digest is compared again, as two rows of one page_id may differ.
    links = maybe_broadcast(links)
    own = F.sha2("html", 256)
    return rows.join(links, (F.col("page_id") == F.col("id")) & (own == F.col("digest")), "left").drop("id", "digest")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html, refers_to) as archives below ``folder``; the manifest, one row per archive."""
    manifest = pages.select("page_id", "url", "html", "refers_to").mapInArrow(_write_task(f"{folder}/archives"), MANIFEST)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(blocks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(start, inflated bytes) of each gzip member of a stream. Raises ValueError where the stream ends within one."""
    packed, inflated, start, seen, unpacker = b"", [], 0, 0, zlib.decompressobj(31)
    begun = False
    for block in blocks:
        packed = block
        while packed:
            begun = True
            inflated.append(unpacker.decompress(packed))
            rest = unpacker.unused_data
            seen += len(packed) - len(rest)
            packed = rest
            if unpacker.eof:
                yield start, b"".join(inflated)
                inflated, start, unpacker, begun = [], seen, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends within a record")


def parse_record(data: bytes) -> dict:
    """The fields of one record. Raises ValueError when its framing or a digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no record head")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[int(length) :] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the member")
    block = rest[: int(length)]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _digest(block):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
    if kind == "response" and digest and digest != _digest(payload):
        raise ValueError("payload digest differs")
    told = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    return {
        "record_type": kind,
        "page_id": number("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None,
        "payload_bytes": len(payload) if kind == "response" else int(told or 0),
        "refers_to": number("warc-refers-to"),
        "payload": payload if kind == "response" else None,
        "error": None,
    }


def _read_task(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)

    def blocks(archive: str) -> Iterator[bytes]:
        store, path = fs.FileSystem.from_uri(archive)
        with store.open_input_stream(path, compression=None) as stream:
            while block := stream.read(BLOCK):
                yield block

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                try:
                    for position, data in members(blocks(archive)):
                        try:
                            row = parse_record(data)
                        except ValueError as error:
                            row = {"error": str(error)}
                        row |= {"archive": archive, "position": position} | ({} if with_payload else {"payload": None})
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 500
                        if held > BLOCK:
                            yield batch_of(rows)
                            rows, held = [], 0
                except (ValueError, zlib.error) as error:  # the rest of a broken archive can't be framed
                    rows.append({"archive": archive, "error": f"unreadable: {error}"})
                yield batch_of(rows)

    return read


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives that ``manifest`` lists, each archive read by one task from start to end.

    A record whose framing or digest is wrong, and the rest of an archive that can't be inflated, is one row with ``error``
    and without the other fields. An empty manifest gives no rows.
    """
    archives = max(1, manifest.count())
    return manifest.select("archive").repartition(archives).mapInArrow(_read_task(with_payload), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read the records back, without payloads.

    A null html is the empty payload, a null url is left out, other columns are not read. An empty table gives no archive
    and no rows.
    """
    folder = Workspace(pages.sparkSession, "warc").path
    return read_archives(write_archives(with_revisits(pages), folder), with_payload=False)
