"""WARC archives: writing them, and the normaliser for monolithic gzip files.

An archive compressed as one gzip stream can only be read from its start. The normaliser inflates such a file once, writes
every record as a gzip member of its own and an index of the members next to the archive, so that any record can then be
read by its offset. Both run as one task per file with a bounded window of bytes in memory; files are written under a
name of the attempt and renamed when complete, so that a task may run twice or be lost at any time.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from newsgauge.llm.ordering import scalar
from newsgauge.session import scratch_path, staged

_CHUNK = 1 << 20
#: Bytes of an archive that a task reads back.
_READ_BYTES = 4 << 20
_GZIP = 16 + zlib.MAX_WBITS
RESPONSE, REVISIT = "response", "revisit"
#: Column, type, WARC header of what an index row tells about a record.
_HEADERS = (("record_id", "WARC-Record-ID"), ("record_type", "WARC-Type"), ("target_uri", "WARC-Target-URI"),
            ("payload_digest", "WARC-Payload-Digest"), ("refers_to", "WARC-Refers-To"), ("payload_bytes", "X-Payload-Length"))
_INDEX = ("archive string, offset bigint, length bigint, " + ", ".join(f"{name} string" for name, _ in _HEADERS))


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """For a path as Spark has it: a URI of a store that pyarrow knows, or a plain path on a disk all machines share."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return pyarrow.fs.LocalFileSystem(), path


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(" " if c in "\r\n" else c for c in value)


def render(headers: dict[str, str], payload: bytes) -> bytes:
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """The headers of a record, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def plan_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """(key, uri, payload, payload_bytes, payload_digest, record_type, refers_to) for every row.

    The payload is the text in UTF-8, empty for null. Of records with equal payloads of at least ``least`` bytes the one
    with the largest key is the response and the others revisit it; rows that repeat that key are responses too, and so is
    every row where no row with that payload has a key. A row without key revisits like any other. Only payloads
    that occur more than once are joined back, one row for each; what of them is hot is split by the adaptive join.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(uri).cast("string").alias("uri"),
                        F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    long = F.col("payload_bytes") >= least
    copied = (rows.where(long).groupBy("payload_digest").agg(F.max("key").alias("first"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    joined = rows.join(copied, "payload_digest", "left")
    again = F.coalesce(long & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("key", "uri", "payload", "payload_bytes", "payload_digest",
                         F.when(again, REVISIT).otherwise(RESPONSE).alias("record_type"),
                         F.when(again, F.col("first")).alias("refers_to"))


def _record_id(key: int | None) -> str:
    return "" if key is None else f"<urn:page:{key}>"


def write_archives(records: DataFrame, folder: str, level: int = 3, most_bytes: int = 64 << 20) -> DataFrame:
    """Writes the rows of :func:`plan_records` as WARC files, each one gzip stream of some ``most_bytes`` of records at most;
    returns their paths, staged. A revisit has no payload; its headers hold the digest and length of the full one."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        done, out, packer, held = [], None, None, 0

        def close() -> None:
            out.write(packer.flush())
            out.close()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None or held >= most_bytes:
                    if out is not None:
                        close()
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"  # only files of the attempt that counts are listed
                    done.append(name)
                    out, packer, held = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, _GZIP), 0
                payload = b"" if row["record_type"] == REVISIT else row["payload"].encode()
                headers = {"WARC-Type": row["record_type"], "WARC-Record-ID": _record_id(row["key"]), "WARC-Target-URI": row["uri"] or "",
                           "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "X-Payload-Length": str(row["payload_bytes"])}
                if row["record_type"] == REVISIT:
                    headers["WARC-Refers-To"] = _record_id(row["refers_to"])
                text = render(headers, payload)
                held += len(text)
                out.write(packer.compress(text))
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in done], pa.string())], names=["archive"])

    return staged(records.mapInArrow(write, "archive string"))


def _inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, a bounded part at a time."""
    unpack = zlib.decompressobj(_GZIP)
    while data := source.read(_CHUNK):
        while data:
            yield unpack.decompress(data, 4 * _CHUNK)
            if unpack.eof:
                data, unpack = unpack.unused_data.lstrip(b"\0"), zlib.decompressobj(_GZIP)
            else:
                data = unpack.unconsumed_tail
    rest = unpack.flush()
    if rest:
        yield rest


class _Stream:
    """Reads on in inflated bytes."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, bytearray()

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held += part
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the stream."""
        looked = 0
        while (at := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:at + len(mark)])
        del self.held[:at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.held[:n])
            del self.held[:n]
            n -= len(part)
            if part:
                yield part


def _normalise_file(archive: str, folder: str, level: int, at_once: int = 10_000) -> Iterator[list[tuple]]:
    """Rewrites one archive; gives its index rows, some at a time."""
    source_fs, source = _filesystem(archive)
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    name = os.path.basename(source)
    attempt = f"{root}/.{name}.{uuid.uuid4().hex}"
    rows, at = [], 0
    with source_fs.open_input_stream(source, compression=None) as file, fs.open_output_stream(attempt, compression=None) as out, \
            fs.open_output_stream(f"{attempt}.idx", compression=None) as index:
        stream = _Stream(_inflated(file))
        while (head := stream.until(b"\r\n\r\n")) is not None:
            head = head.lstrip(b"\r\n")
            headers = parse_head(head[:-4])
            packer, start = zlib.compressobj(level, zlib.DEFLATED, _GZIP), at
            at += out.write(packer.compress(head))
            for part in stream.take(int(headers.get("content-length", 0))):
                at += out.write(packer.compress(part))
            at += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            row = (f"{folder}/{name}", start, at - start, *(headers.get(h.lower()) for _, h in _HEADERS))
            index.write(json.dumps(row[1:]).encode() + b"\n")
            rows.append(row)
            if len(rows) == at_once:
                yield rows
                rows = []
            for _ in stream.take(4):  # the blank lines after a record
                pass
    fs.move(attempt, f"{root}/{name}")
    fs.move(f"{attempt}.idx", f"{root}/{name}.idx")
    if rows:
        yield rows


def normalise(archives: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Rewrites every file in the column ``archive`` with a gzip member per record into ``folder``, with an index file
    ``<name>.idx`` (a JSON list of offset, length and headers per line) beside it; returns the index of all, staged.

    A file is one task, as a gzip stream can't be entered in the middle; file names must differ. A broken file is an error.
    """
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for rows in _normalise_file(archive, folder, level):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in _INDEX.split(", ")])

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64()}
        for batch in rewrite(batches):
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(kinds[f.split()[1]]) for i, f in enumerate(_INDEX.split(", "))],
                                             names=[f.split()[0] for f in _INDEX.split(", ")])

    files = max(1, scalar(archives.agg(F.count("*")))[0])
    # By range and with a number: every file is a partition, and adaptive execution leaves them apart, small as the rows are.
    return staged(archives.repartitionByRange(files, "archive").mapInArrow(typed, _INDEX))


def read_records(index: DataFrame) -> DataFrame:
    """The columns of ``index`` and the payload bytes of each record, read by offset: any subset of an index may be given,
    in any order and split into any number of tasks."""
    names = [f.split()[0] for f in _INDEX.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, payloads = batch.slice(low, 256), []
                for archive, offset, length in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if archive != path:
                        if file is not None:
                            file.close()
                        fs, inner = _filesystem(archive)
                        path, file = archive, fs.open_input_file(inner)
                    file.seek(offset)
                    record = zlib.decompress(file.read(length), _GZIP)
                    head, _, rest = record.partition(b"\r\n\r\n")
                    payloads.append(rest[:int(parse_head(head).get("content-length", 0))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary())], names=[*names, "payload"])
        if file is not None:
            file.close()

    return index.select(*names).mapInArrow(read, _INDEX + ", payload binary")


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes ``pages`` as monolithic archives, normalises these, and reads every record back by its offset.

    Returns per page: page_id, payload_bytes and payload_digest (of the full payload: of a response counted from the bytes read
    back, of a revisit as its headers tell), record_type, refers_to, url, archive, offset and length. The files stay in
    ``folder`` (a new one under the shared folder, if not given).
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = normalise(write_archives(plan_records(pages, **columns), f"{folder}/monolithic"), f"{folder}/members")
    # Tasks are sized by what they read, not by the rows of the index.
    tasks = max(1, -(-(scalar(index.agg(F.sum("length")))[0] or 0) // _READ_BYTES))
    records = read_records(index.repartition(tasks, "archive", F.floor(F.col("offset") / _READ_BYTES)))
    whole = F.col("record_type") == RESPONSE
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    page = lambda c: F.when(F.length(number(c)) > 0, number(c).cast("bigint"))
    return records.select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes").cast("bigint")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.substring("payload_digest", 6, 40)).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"), "archive", "offset", "length")
