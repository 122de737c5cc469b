"""TIFF media columns: a writer for byte payloads, and a reader that walks image directories.

The reader handles classic and big TIFF in both byte orders, strips and tiles, chunky and planar samples of
1, 2, 4, 8, 16, 32 or 64 bits, compressions none, PackBits, LZW and deflate, and the horizontal and floating-point predictors.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pick, text_of

# Fixed values of the TIFF 6.0 specification: tags, compressions, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
FILL_ORDER, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 266, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}

PAGE_WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 16384, 1024
PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """Runs of three bytes and more as counts, what lies between as it stands."""
    out, last = bytearray(), 0

    def literal(stop: int) -> None:
        for i in range(last, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        out.append(257 - (m.end() - m.start()))
        out.append(data[m.start()])
        last = m.end()
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Variable codes of 9 to 12 bits, most significant bit first, 256 clears and 257 ends; a width grows one code early."""
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, out, width, last = list(single), [], 9, None
    buffer = bits = 0
    for byte in data:
        buffer = (buffer << 8 | byte) & 0xFFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = buffer >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            words, width, last = list(single), 9, None
            continue
        if last is None:
            entry = words[code]
        else:
            if code > len(words):
                raise ValueError("LZW code beyond the table")
            entry = words[code] if code < len(words) else last + last[:1]
            words.append(last + entry[:1])
            if len(words) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, buffer, bits, out = {bytes((i,)): i for i in range(256)}, 256, 9, bytearray()
    width, size, word = 9, 258, b""

    def put(code: int) -> None:
        nonlocal buffer, bits
        buffer = buffer << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(buffer >> bits & 255)
            buffer &= (1 << bits) - 1

    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = size
        size += 1
        word = data[i : i + 1]
        if size >= 1 << width:
            width += 1
        if size == 4094:
            put(256)
            codes, size, width = {bytes((j,)): j for j in range(256)}, 258, 9
    if word:
        put(codes[word])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(buffer << (8 - bits) & 255)
    return bytes(out)


def _decompress(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression} is not supported")


def _compress(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](data)


def _directories(buf: memoryview) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and the tags of each directory; a directory that comes round again ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(buf[:2]))
    if order is None:
        raise ValueError("not a TIFF")
    big = struct.unpack_from(f"{order}H", buf, 2)[0] == 43
    word, entry, count = ("Q", 20, "Q") if big else ("I", 12, "H")
    at, seen = struct.unpack_from(order + word, buf, 8 if big else 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + count, buf, at)
        at += struct.calcsize(count)
        tags = {}
        for _ in range(n):
            tag, kind, items = struct.unpack_from(f"{order}HH{word}", buf, at)
            size = TYPE_SIZE.get(kind, 1) * items
            inline = at + (12 if big else 8)
            where = inline if size <= struct.calcsize(word) else struct.unpack_from(order + word, buf, inline)[0]
            if kind in TYPE_CODE:
                tags[tag] = struct.unpack_from(f"{order}{items}{TYPE_CODE[kind]}", buf, where)
            at += entry
        yield order, tags
        (at,) = struct.unpack_from(order + word, buf, at)


def _samples(raw: bytes, rows: int, width: int, bits: int, fill_order: int) -> bytes:
    """A byte for each sample of fewer bits; rows start at a byte, the first sample in the high bits (the low ones with fill order 2)."""
    step = -(-width * bits // 8)
    packed = np.frombuffer(raw, "u1", rows * step).reshape(rows, step)
    flat = np.unpackbits(packed, axis=1, bitorder="little" if fill_order == 2 else "big")[:, : width * bits].reshape(rows, width, bits)
    return (flat * (1 << np.arange(bits)[::-1]).astype("u1")).sum(axis=2, dtype="u1").tobytes()


def _undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows, columns, samples as stored; floating differences are of bytes, the high ones first."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("=")).astype(block.dtype)
    if predictor == 3:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        planes = block.view("u1").reshape(rows, -1, samples)
        planes = np.cumsum(planes, axis=1, dtype="u1").reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}").reshape(block.shape).astype(f"{order}u{size}")
    return block


def decode_pages(data: bytes) -> Iterator[dict]:
    """One dictionary for each page, with the pixel bytes in row order (samples side by side, in the file's byte order; a byte each if they
    have fewer bits)."""
    buf = memoryview(data)
    for page, (order, tags) in enumerate(_directories(buf)):
        one = lambda tag, default=None, tags=tags: tags.get(tag, (default,))[0]
        width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
        compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        if bits not in (1, 2, 4, 8, 16, 32, 64):
            raise ValueError(f"{bits} bits a sample are not supported")
        tiled = TILE_OFFSETS in tags
        across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
        offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
        planes, in_block = (samples, 1) if planar == 2 else (1, samples)
        kind = np.dtype(f"{order}u{max(1, bits // 8)}")
        image = np.zeros((height, width, samples), kind)
        grid_x, grid_y = -(-width // across), -(-height // down)
        for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
            plane, cell = divmod(k, grid_x * grid_y)
            if plane >= planes:
                break
            y, x = cell // grid_x * down, cell % grid_x * across
            rows = down if tiled else min(down, height - y)
            raw = _decompress(bytes(buf[offset : offset + size]), compression)
            if bits < 8:
                raw = _samples(raw, rows, across * in_block, bits, one(FILL_ORDER, 1))
            block = np.frombuffer(raw, kind, rows * across * in_block).reshape(rows, across, in_block)
            block = _undo_predictor(block, predictor, order)[: height - y, : width - x]
            image[y : y + block.shape[0], x : x + block.shape[1], plane : plane + in_block] = block
        yield {"page": page, "width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": image.tobytes()}


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0, strip_rows: int = STRIP_ROWS) -> bytes:
    """A little-endian TIFF of grey 8-bit pages (2-d arrays); tile > 0 stores square tiles of that side (a multiple of 16)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in pages:
        height, width = image.shape
        blocks = []
        if tile:
            full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), "u1")
            full[:height, :width] = image
            cells = [full[y : y + tile, x : x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
        else:
            cells = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        for cell in cells:
            if predictor == 2:
                cell = np.diff(cell, axis=1, prepend=np.zeros((cell.shape[0], 1), "u1")).astype("u1")
            blocks.append(_compress(np.ascontiguousarray(cell).tobytes(), compression))
        offsets = []
        for block in blocks:
            offsets.append(len(out))
            out += block + b"\0" * (len(block) % 2)
        fields = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        sizes = [len(b) for b in blocks]
        fields += [(TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILE_OFFSETS, offsets), (TILE_BYTES, sizes)] if tile else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [strip_rows]), (STRIP_BYTES, sizes)]
        entries = []
        for tag, values in sorted(fields):
            value = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                entries.append(struct.pack("<HHII", tag, 4, len(values), len(out)))
                out += value
            else:
                entries.append(struct.pack("<HHI", tag, 4, 1) + value)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(df: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per page of each TIFF: the id, PAGE_SCHEMA's columns.

    A null or unreadable file gives one row with its error and null pixels; an empty table gives no rows; ids are carried as they are, repeated or null.
    """
    source = pick(df, id_column, media_column)
    id_type = source.schema[0].dataType.simpleString()
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ident = batch.column(0).slice(i, 1)
                try:
                    for row in decode_pages(batch.column(1)[i].as_py() or b""):
                        yield _page_batch(ident, [row], names)
                except Exception as e:  # a broken file is a row of its own
                    yield _page_batch(ident, [{"error": f"{type(e).__name__}: {e}"}], names)

    return map_batches(source, run, f"`{id_column}` {id_type}, {PAGE_SCHEMA}")


PAGE_ARROW = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]


def _page_batch(ident: pa.Array, rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ident] + [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, PAGE_ARROW, strict=True)], names=["id", *names])


#: Of eight payloads, how many are stored in which form; half of each in tiles.
FORMS = (LZW, PACKBITS, PACKBITS, PACKBITS, DEFLATE, DEFLATE, DEFLATE, DEFLATE)
TILE = 64


def store_payload(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as a TIFF of 64 samples a row.

    Its checksum alone chooses the compression, and strips or tiles: payloads of all sizes meet all decoders, and equal ones the same.
    """
    rows, digest = np.frombuffer(payload, "u1").reshape(-1, PAGE_WIDTH), zlib.crc32(payload)
    how = FORMS[digest % 8]
    return encode([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], how, 1 if how == PACKBITS else 2, TILE * (digest >> 3 & 1))


def tiff_media(docs: DataFrame) -> DataFrame:
    """Stores every whole text as a TIFF, reads it back page by page and computes features from the samples read.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. A null text is the
    empty one, whose payload is 64 zero bytes. Each row is one result: repeated rows, ties and null ids give rows of their own, an empty
    table none. Memory is that of one text and its file, a page at a time. Other columns are ignored, whatever their names.
    """
    source = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    schema = f"doc_id {source.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1).cast(pa.large_binary()):
                text = value.as_py()
                payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
                media = store_payload(payload)
                digest, size, tail, histogram, gradient, pages = hashlib.sha256(), 0, b"", np.zeros(256, "i8"), 0, 0
                for page in decode_pages(media):
                    pixels = page["pixels"]
                    digest.update(pixels)
                    size += len(pixels)
                    tail = pixels[-64:]
                    image = np.frombuffer(pixels, "u1").reshape(page["height"], page["width"])
                    histogram += np.bincount(image.ravel(), minlength=256)
                    gradient += int(np.abs(np.diff(image.astype("i2"), axis=1)).sum())
                    pages += 1
                total = int((histogram * np.arange(256)).sum())
                bins = ".".join(str(int(x) * 1000 // size) for x in histogram.reshape(16, 16).sum(axis=1))
                feature = f"pages={pages};rows={size // PAGE_WIDTH};mean={total * 1000 // size};gradient={gradient * 1000 // size};levels={int((histogram > 0).sum())};bins={bins}"
                rows.append((len(text), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(source, run, schema)
