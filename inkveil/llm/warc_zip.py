"""WARC in ZIP packages: write pages as archives, and read records by range without extraction.

A package is a ZIP file with stored members: archive/data.warc.gz, one gzip member for each record, and indexes/index.cdxj,
one line for each record with its offset and length. The reader parses the end record, the ZIP64 locator and directory, and
the central directory, finds the stored members, and then reads index and records by ranges of bytes.

Tasks write packages of bounded size under new names in a folder that all executors share; the manifest, a table, lists
those of the tasks that succeeded, so a repeated task leaves at worst a file that nothing names. Reading goes in two steps:
the indexes give ranges of consecutive records, and these are dealt out anew, so a large package is read by many tasks.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import new_path, write_table

#: Bytes of compressed records after which a task begins another package.
PACKAGE_BYTES = 32 << 20

#: Bytes of records that one range holds, unless a single record is larger.
RANGE_BYTES = 4 << 20

#: Payloads from this size on become revisits of an equal one.
LEAST_REVISIT_BYTES = 0

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_MANIFEST = "package string, records long, bytes long"
_RANGES = "package string, start long, offsets array<long>, lengths array<long>"
_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class BadPackage(ValueError):
    """A ZIP or WARC structure that isn't as it should be."""


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][\w+.-]*:/", uri) else f"file://{uri}")


# writing


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record without it if refers_to is given; not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_package(uri: str, records: list[tuple[str, bytes]]) -> None:
    """Write compressed records, each with its page's name, as one package. The file gets its name once it is whole."""
    lines, at = [], 0
    for page, data in records:
        lines.append(json.dumps({"page": page, "offset": at, "length": len(data), "filename": RECORDS}))
        at += len(data)
    fs, path = _open_fs(uri)
    with fs.open_output_stream(f"{path}.part") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True) as member:
            for _, data in records:
                member.write(data)
        z.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in lines))
    fs.move(f"{path}.part", path)


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as packages; the manifest (package, records, bytes) is a table.

    The payload is html in UTF-8, empty for null. Of equal payloads of at least least_revisit_bytes the one of the smallest
    page_id is a response, the others revisit it; smaller payloads are all responses. Rows that repeat page_id and payload
    are all records of the same kind. Rows with a null page_id are responses if no equal payload has an id, else revisits. A
    null url leaves out the target. folder: a new one in the shared folder by default. An empty table writes no package.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    fs, path = _open_fs(folder)
    fs.create_dir(path, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    # the only groups that matter have several rows; counted before the shuffle, a common payload is a few rows
    groups = rows.filter(F.length("payload") >= least_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = write_table(groups.filter("n > 1 and first is not null").select("sha1", "first"), "equal-payloads")
    rows = rows.join(groups, "sha1", "left").select("page_id", "url", "payload", "sha1", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, size = [], [], 0

        def close() -> None:
            name = f"{folder}/{uuid.uuid4().hex}.wacz"
            write_package(name, held)
            done.append((name, len(held), size))

        for batch in batches:
            for page, url, data, sha1, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                held.append((_name(page), gzip.compress(record(page, url, data, digest, first), 4, mtime=0)))
                size += len(held[-1][1])
                if size >= PACKAGE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["package", "records", "bytes"])

    return write_table(rows.mapInArrow(run, _MANIFEST), "warc-manifest")


# reading


@dataclass
class Member:
    """An entry of a ZIP's central directory; start: of its data, once located."""

    name: str
    method: int
    size: int
    header: int
    start: int = -1


def _range(file: pa.NativeFile, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise BadPackage(f"{size} bytes wanted at {start}, {len(data)} there")
    return data


def members(file: pa.NativeFile) -> dict[str, Member]:
    """The central directory by name. Reads the file's last bytes, then the directory, and no member."""
    end = file.size()
    tail_at = max(0, end - 22 - 0xFFFF)
    tail = _range(file, tail_at, end - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) - at < 22:
        raise BadPackage("no end of a central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        where = tail_at + at - 20
        mark, _, big, _ = struct.unpack("<IIQI", _range(file, where, 20)) if where >= 0 else (0, 0, 0, 0)
        if mark != 0x07064B50:
            raise BadPackage("no ZIP64 locator")
        data = _range(file, big, 56)
        if data[:4] != b"PK\x06\x06":
            raise BadPackage("no ZIP64 end record")
        count, size, start = struct.unpack_from("<QQQ", data, 32)
    data, out, at = _range(file, start, size), {}, 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise BadPackage("the central directory is cut")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        # ZIP64 values stand in this order, each only if its 32-bit field is full
        values = iter(_zip64(extra))
        full, packed, header = (next(values, None) if x == 0xFFFFFFFF else x for x in (full, packed, header))
        if None in (full, packed, header):
            raise BadPackage(f"{name}: a ZIP64 value is missing")
        out[name] = Member(name, method, packed, header)
        at += 46 + n_name + n_extra + n_note
    return out


def _zip64(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return [x for (x,) in struct.iter_unpack("<Q", extra[at + 4 : at + 4 + n // 8 * 8])]
        at += 4 + n
    return []


def locate(file: pa.NativeFile, member: Member) -> Member:
    """Find where a stored member's data begins, by its local header. Others than stored ones can't be read by range."""
    if member.method:
        raise BadPackage(f"{member.name} is compressed, not stored")
    head = _range(file, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise BadPackage(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    member.start = member.header + 30 + n_name + n_extra
    return member


def parse_record(data: bytes) -> dict:
    """The fields of a WARC record and its payload (None for a revisit); checks lengths and a response's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadPackage("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, cut, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    if len(block) != int(fields["content-length"]) or not cut or not size:
        raise BadPackage("a record is cut")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != int(size[1]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise BadPackage("a payload doesn't have its digest")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": int(size[1]),
        "payload_digest": digest, "refers_to": _page(fields["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
    }


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+|null)>", name)
    if not found:
        raise BadPackage(f"no page in {name}")
    return None if found[1] == "null" else int(found[1])


def record_ranges(packages: DataFrame) -> DataFrame:
    """For packages (package): ranges of consecutive records, with their offsets and lengths in the package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _open_fs(uri)
                with fs.open_input_file(path) as file:
                    found = members(file)
                    if RECORDS not in found or INDEX not in found:
                        raise BadPackage(f"{uri} has no records or no index")
                    base = locate(file, found[RECORDS]).start
                    index = locate(file, found[INDEX])
                    lines = [json.loads(x) for x in _range(file, index.start, index.size).splitlines() if x.strip()]
                groups, size = [], 0
                for x in lines:
                    if not groups or size + x["length"] > RANGE_BYTES or groups[-1][1][-1] + groups[-1][2][-1] != base + x["offset"]:
                        groups.append((base + x["offset"], [], []))
                        size = 0
                    groups[-1][1].append(base + x["offset"])
                    groups[-1][2].append(x["length"])
                    size += x["length"]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(groups), pa.string()), *(pa.array([g[k] for g in groups], t) for k, t in enumerate(kinds))], ["package", "start", "offsets", "lengths"]
                )

    return packages.select("package").mapInArrow(run, _RANGES)


def read_archives(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of packages (package): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    payload is null for revisits, and for all if payloads is false; then records are checked as well, but not returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for x in batch.to_pylist():
                fs, path = _open_fs(x["package"])
                with fs.open_input_file(path) as file:
                    data = memoryview(_range(file, x["start"], x["offsets"][-1] + x["lengths"][-1] - x["start"]))
                rows = []
                for at, n in zip(x["offsets"], x["lengths"], strict=True):
                    try:
                        rows.append(parse_record(gzip.decompress(data[at - x["start"] :][:n])))
                    except (OSError, EOFError, zlib.error, binascii.Error) as e:
                        raise BadPackage(f"{x['package']}, record at {at}: {e}") from e
                    if not payloads:
                        rows[-1]["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, schema)

    spark = packages.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return record_ranges(packages).repartition(parts).mapInArrow(run, _RECORDS)


def through_archives(pages: DataFrame, folder: str | None = None, least_revisit_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write pages as packages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write_archives(pages, folder, least_revisit_bytes)
    out = read_archives(manifest, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
