"""WARC records in ZIP packages, read in place.

``write`` puts web pages into packages: ZIP files whose members are stored, not deflated. A package holds WARC files
(each record a gzip member of its own), an index with a line for each record, and a description. ``members`` reads a
package's directory from its end (end record, ZIP64 locator and end record, central directory) and finds where each
stored member's bytes lie; ``index`` range-reads the index members; ``records`` range-reads single records at the
offsets found there. Nothing is unpacked to disk, and no file is read as a whole.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the smallest id is a response and the
others revisit it. A null page is an empty payload. Rows that share the smallest id are all responses; rows with a null id
revisit a page that has one, and are responses among themselves. Ids may be of any type that has an order. Other columns
are not read. Empty tables give no records.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common
from .components import HOT_SHARE

REVISIT_BYTES = 100
#: Bytes of records after which a package's WARC file is ended, and the records of one.
MEMBER_BYTES = 64 << 20
#: Bytes of records that one task reads, roughly.
READ_BYTES = 64 << 20
INDEX, ARCHIVE = "indexes/", "archive/"
#: How records name pages; ids stand percent-encoded after it.
PAGE, NO_PAGE = "urn:page:", "urn:no-page"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Member(NamedTuple):
    name: str
    offset: int
    size: int


def _open(uri: str):
    """A file system that understands ``uri``, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# ---- reading -------------------------------------------------------------------------------------------------


def members(file, size: int) -> list[Member]:
    """Stored members of a ZIP file: ``file`` has seek and read, ``size`` is its length."""

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    # the end record has 22 bytes and a comment of up to 65535
    tail_at = max(0, size - 22 - 65535)
    tail = at(tail_at, size - tail_at)
    k = len(tail)
    while True:
        k = tail.rfind(b"PK\x05\x06", 0, k)
        if k < 0:
            raise ValueError("no end of a ZIP directory")
        if len(tail) - k >= 22 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail):
            break
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = at(tail_at + k - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            end = at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, found, p = at(start, length), [], 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, p + 20)
        offset = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + name_n : p + 46 + name_n + extra_n], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                # the 64-bit field holds those values only that don't fit, in this order
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                offset = values.pop(0) if offset == 0xFFFFFFFF else offset
            q += 4 + n
        p += 46 + name_n + extra_n + comment_n
        if method == zipfile.ZIP_STORED and not name.endswith("/"):
            header = at(offset, 30)
            if header[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header for {name}")
            found.append(Member(name, offset + 30 + sum(struct.unpack_from("<HH", header, 26)), packed))
    return found


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record (gzip member)."""
    data = zlib.decompress(record, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = lambda raw: {k.lower(): v for k, _, v in (line.partition(": ") for line in raw.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = block[: int(warc["content-length"])]
    if not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def index(packages: DataFrame) -> DataFrame:
    """(package, offset, length) of each record, from the packages' own index members; ``packages`` has a column package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = _open(uri)
                with files.open_input_file(path) as file:
                    where = {m.name: m for m in members(file, file.size())}
                    for m in where.values():
                        if not m.name.startswith(INDEX):
                            continue
                        for lines in _lines(file, m):
                            rows = [json.loads(x.split(b" ", 2)[2]) for x in lines]
                            starts = [where[r["filename"]].offset + int(r["offset"]) for r in rows]
                            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows)), pa.array(starts, pa.int64()), pa.array([int(r["length"]) for r in rows], pa.int64())], ["package", "offset", "length"])

    return packages.select("package").mapInArrow(run, "package string, offset long, length long")


def _lines(file, member: Member, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text member's lines, some at a time."""
    rest, at = b"", 0
    while at < member.size:
        file.seek(member.offset + at)
        data = file.read(min(block, member.size - at))
        at += len(data)
        *lines, rest = (rest + data).split(b"\n")
        if lines:
            yield lines
    if rest:
        yield [rest]


def records(places: DataFrame, kind: str = "bigint") -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload for each (package, offset, length).

    A revisit has no payload of its own; digest and length are those that it states for the page it revisits, and
    ``unfounded`` compares them with that page's. ``kind`` is the type of page ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, None
        for batch in batches:
            for k in range(0, len(batch), 200):
                rows = []
                for uri, offset, length in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns)):
                    if uri != opened:
                        files, path = _open(uri)
                        file, opened = files.open_input_file(path), uri
                    file.seek(offset)
                    warc, http, payload = parse(file.read(length))
                    what, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
                    if what == "response":
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {warc['warc-record-id']} doesn't have its digest")
                        size = len(payload)
                    else:
                        size = int(http["content-length"])
                    rows.append((_page(warc["warc-record-id"]), warc["warc-target-uri"], what, digest, size, _page(warc.get("warc-refers-to")), payload if what == "response" else None))
                types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

    found = places.select("package", "offset", "length").mapInArrow(run, "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def unfounded(found: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes) of revisits which no response with that id, digest and length answers.

    Revisits are brought down to the pages that they name before they are joined, so a page that very many revisit is
    one row.
    """
    stated = ["payload_digest", "payload_bytes"]
    named = found.where("record_type = 'revisit'").select("refers_to", *stated).distinct()
    there = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *stated)
    return named.join(there, ["refers_to", *stated], "left_anti")


def _named(page) -> str:
    return f"<{NO_PAGE}>" if page is None else f"<{PAGE}{quote(str(page), safe='')}>"


def _page(urn: str | None) -> str | None:
    """The page that a record's id names."""
    urn = (urn or "").strip("<>")
    return unquote(urn.removeprefix(PAGE)) if urn.startswith(PAGE) else None


# ---- writing -------------------------------------------------------------------------------------------------


def record(page, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _named(page),
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(),
        **({} if refers_to is None else {"WARC-Refers-To": _named(refers_to), "WARC-Profile": PROFILE}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


class Package:
    """Writes one ZIP package to a stream that need not seek."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.name, self.size, self.count, self.index = None, "", 0, 0, []

    def add(self, page, url, payload: bytes, refers_to) -> None:
        data = record(page, url, payload, refers_to)
        if self.member is None or self.size + len(data) > MEMBER_BYTES and self.size:
            self._end()
            self.name, self.size = f"{ARCHIVE}data-{self.count:05d}.warc.gz", 0
            self.count += 1
            self.member = self.zip.open(zipfile.ZipInfo(self.name), "w", force_zip64=True)
        self.member.write(data)
        entry = {"filename": self.name, "offset": str(self.size), "length": str(len(data))}
        self.index.append(f"{' '.join((url or '-').split()).replace(' ', '%20') or '-'} 19700101000000 {json.dumps(entry)}\n")
        self.size += len(data)

    def _end(self) -> None:
        if self.member is not None:
            self.member.close()
        # an index for each WARC file, so that what waits in memory stays small
        if self.index:
            with self.zip.open(zipfile.ZipInfo(f"{INDEX}index-{self.count - 1:05d}.cdxj"), "w", force_zip64=True) as out:
                for line in sorted(self.index):
                    out.write(line.encode())
        self.member, self.index = None, []

    def close(self) -> None:
        self._end()
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "files": self.count}))
        self.zip.close()


def marked(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (bytes), refers_to: pages with the page that each revisits.

    Payloads that very many pages have are looked up where the pages lie, and so few that they can be broadcast; pages
    with short payloads stay as they are. Only the rest go through a shuffle, by digests of which none is frequent.
    """
    payload = F.encode(common.text_or_empty(F.col("html")), "UTF-8")
    rows = pages.select(F.col("page_id").cast(_kind(pages)).alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.col("digest")))
    digests = common.stored(rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "digests")
    heavy = max(100, (digests.agg(F.sum("n")).head()[0] or 0) // HOT_SHARE)
    first = digests.where("n > 1 and first is not null")
    hot, cold = (first.where(c).select("digest", "first") for c in (F.col("n") >= heavy, F.col("n") < heavy))
    # a digest without a first page may be frequent too
    known = F.broadcast(digests.where(F.col("n") >= heavy).select("digest"))
    here = rows.where("digest is null").withColumn("first", F.lit(None).cast(_kind(pages)))
    here = here.unionByName(rows.join(known, "digest", "left_semi").join(F.broadcast(hot), "digest", "left"))
    rest = rows.where("digest is not null").join(known, "digest", "left_anti")
    every = here.unionByName(rest.repartition("digest").join(cold, "digest", "left"))
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return every.select("page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def _kind(pages: DataFrame) -> str:
    """The type of page ids: long for integers, else the table's own."""
    kind = pages.schema["page_id"].dataType
    return "bigint" if isinstance(kind, IntegralType) else kind.simpleString()


def write(pages: DataFrame, path: str) -> DataFrame:
    """Writes one package for each partition of ``marked(pages)`` under ``path``; (package, records) of each.

    A task writes under its attempt's name and renames at the end, so that a repeated or doubled task leaves whole files.
    """
    files, base = _open(path)
    files.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, package, count = TaskContext.get(), None, 0
        name = f"{path}/part-{context.partitionId():06d}.wacz"
        files, final = _open(name)
        draft = f"{final}.{context.taskAttemptId()}"
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(4))):
                if package is None:
                    stream = files.open_output_stream(draft)
                    package = Package(stream)
                package.add(*(x.as_py() for x in row))
                count += 1
        if package is not None:
            package.close()
            stream.close()
            files.move(draft, final)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["package", "records"])

    return common.stored(marked(pages).mapInArrow(run, "package string, records long"), "packages")


def read(packages: DataFrame, kind: str = "bigint") -> DataFrame:
    """All records of the packages; the places of records are dealt out evenly before they are read."""
    places = common.stored(index(packages), "places")
    size = places.agg(F.sum("length")).head()[0] or 0
    # by the bytes that will be read, not by those of the places
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    return records(places.repartitionByRange(tasks, "package", "offset").sortWithinPartitions("package", "offset"), kind)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages in the shared folder and returns what is read back, without the payloads.

    A revisit whose digest or length isn't that of the page it names is an error.
    """
    packages = write(pages, common.fresh_dir(spark, "warc"))
    found = read(packages, _kind(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    found = common.stored(found, "records")
    if wrong := unfounded(found).head():
        raise ValueError(f"no response of page {wrong['refers_to']} has the payload that its revisits state")
    return found
