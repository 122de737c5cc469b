"""WARC records in ZIP packages: a writer, and a reader that parses central and ZIP64 directories and range-reads records.

A package stores (method 0) the members archive/data.warc.gz, one gzip member a record, and indexes/index.cdxj, one line a record
with its offset and length. The reader needs only read_at(offset, size): it reads the tail, the central directory, the local headers
of the two members, the index, and then each record's own bytes. Nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, pick, text_of

# Fixed values of the ZIP format: signatures of the local header, central entry, ends of the directory.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ReadAt = Callable[[int, int], bytes]


def pack_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; zip64 writes the 64-bit fields and directory even where they are not needed."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at, n = name.encode(), zlib.crc32(data), len(out), len(data)
        big = zip64 or n > 0xFFFFFFFE or at > 0xFFFFFFFE
        local_extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        size = 0xFFFFFFFF if big else n
        out += struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 33, crc, size, size, len(raw), len(local_extra)) + raw + local_extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        central += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + raw + extra
    start, count = len(out), len(members)
    out += central
    if zip64 or start > 0xFFFFFFFE or count > 0xFFFE:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, len(central), start)
        out += struct.pack("<IIQI", LOCATOR64, 0, end, 1)
        return bytes(out + struct.pack("<IHHHHIIH", END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    return bytes(out + struct.pack("<IHHHHIIH", END, 0, 0, count, count, len(central), start, 0))


def zip_members(read_at: ReadAt, size: int) -> dict[str, tuple[int, int, int]]:
    """Name -> (method, offset of the data, stored size) of each member, by the central directory."""
    tail = read_at(max(0, size - 65557), min(size, 65557))
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        sign, _, end64, _ = struct.unpack_from("<IIQI", tail, at - 20)
        if sign != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        sign, _, _, _, _, _, _, count, length, start = struct.unpack("<IQHHIIQQQQ", read_at(end64, 56))
        if sign != END64:
            raise ValueError("no ZIP64 end of a central directory")
    directory, at, out = read_at(start, length), 0, {}
    for _ in range(count):
        sign, _, _, _, method, _, _, _, stored, plain, n, x, c, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if sign != CENTRAL:
            raise ValueError("a broken central entry")
        name, extra = directory[at + 46 : at + 46 + n].decode(), directory[at + 46 + n : at + 46 + n + x]
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<HH", extra)
            if kind == 1:  # only the fields that are all ones stand here, in this order
                fields = list(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                if plain == 0xFFFFFFFF:
                    fields.pop(0)
                if stored == 0xFFFFFFFF:
                    stored = fields.pop(0)
                if offset == 0xFFFFFFFF:
                    offset = fields.pop(0)
            extra = extra[4 + k :]
        header = read_at(offset, 30)
        if struct.unpack_from("<I", header)[0] != LOCAL:
            raise ValueError("a broken local header")
        n2, x2 = struct.unpack_from("<HH", header, 26)
        out[name] = (method, offset + 30 + n2 + x2, stored)
        at += 46 + n + x + c
    return out


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read_package(read_at: ReadAt, size: int) -> Iterator[tuple[dict, dict[str, str], bytes]]:
    """(index entry, header fields, block) of each record of a package, each read by its own range."""
    members = zip_members(read_at, size)
    indexes = [n for n in members if n.startswith("indexes/")]
    for name in sorted(indexes):
        method, at, n = members[name]
        text = read_at(at, n)
        if method == 8:
            text = zlib.decompress(text, -15)
        for line in text.decode().splitlines():
            entry = json.loads(line[line.index("{") :])
            method, base, stored = members[f"archive/{entry['filename']}"]
            if method != 0:
                raise ValueError("the archive member is not stored")
            offset, length = int(entry["offset"]), int(entry["length"])
            if offset + length > stored:
                raise ValueError("an index entry beyond its member")
            yield entry, *parse_record(read_at(base + offset, length))


def make_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def package() -> pa.RecordBatch:
            # the 64-bit form throughout: packages of any size have the one layout
            blob = pack_zip([(DATA, bytes(data)), (INDEX, "".join(index).encode())], zip64=True)
            out = pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([len(index)], pa.int32())], names=["package", "records"])
            data.clear()
            index.clear()
            return out

        for batch in batches:
            ids, urls, first, html = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                page, url, keeper = ids[i].as_py(), urls[i].as_py(), first[i].as_py()
                revisit = keeper is not None
                payload = html.slice(i, 1).cast(pa.large_binary())[0].as_py()
                digest = digest_of(payload)
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{json.dumps(page)}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
                if url is not None:
                    fields.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
                if revisit:
                    fields += [("WARC-Refers-To", f"<urn:page:{keeper}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                record = make_record(fields, b"" if revisit else payload)
                index.append(f'page {json.dumps(page)} {{"filename":"data.warc.gz","offset":"{len(data)}","length":"{len(record)}","digest":"sha1:{digest}"}}\n')
                data.extend(record)
                if len(data) >= max_bytes:
                    yield package()
        if index:
            yield package()

    return run


def write_packages(pages: DataFrame, least_bytes: int = 0, max_bytes: int = 1 << 20) -> DataFrame:
    """One row per package (package binary, records int) holding a WARC record for each page.

    Of pages with equal payloads of at least least_bytes bytes the one with the smallest page_id is a response and the rest revisit it;
    smaller payloads are all responses. Null ids come after all others; rows that repeat the smallest id are responses all. A null html
    is the empty payload. Packages close at max_bytes, so memory is that of one package and one page.
    """
    source = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    keyed = source.withColumn("digest", F.sha2("html", 256)).withColumn("big", F.octet_length("html") >= least_bytes)
    # narrow and aggregated before its shuffle; the wide side goes through one join, which the engine may split where a digest is hot
    heads = keyed.where("big").groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = keyed.join(heads, (F.col("digest") == F.col("d")) & F.col("big"), "left")
    keeper = F.when(F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    return map_batches(joined.select("page_id", "url", keeper.alias("keeper"), "html"), _writer(max_bytes), "package binary, records int")


def read_records(packages: DataFrame) -> DataFrame:
    """One row per record of each package, read back by ranges: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response are computed from the block that was read; a revisit has none and carries both in its header.
    A null package has no records; a broken one fails the job, since its records cannot be told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                buf = value.as_buffer()
                if buf is None:
                    continue
                view = memoryview(buf)
                rows = []
                for _, fields, block in read_package(lambda at, n, view=view: bytes(view[at : at + n]), len(view)):
                    page = json.loads(fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">"))
                    if fields["warc-type"] == "revisit":
                        keeper = json.loads(fields["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">"))
                        rows.append((page, int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), "revisit", keeper))
                    else:
                        rows.append((page, len(block), digest_of(block), "response", None))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return map_batches(packages.select("package"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the packages to the shared folder and reads every record back; repeated rows and an empty table give what they hold."""
    return read_records(materialize(write_packages(pages, least_bytes), "warc"))
