"""TIFF media columns: encode sample planes, walk image directories and decode one row per page.

``tiff_pages`` reads a binary column and yields one row per image directory: strips or tiles,
uncompressed, PackBits, LZW or deflate, horizontal predictor undone, either byte order, chunky or
planar samples of 8, 16 or 32 bits. ``texts_to_tiff`` stores texts losslessly as 8-bit samples.

Defined results: a null or empty media value gives no page; a broken file gives the pages before the
fault and one row whose ``error`` says what is wrong (never an exception); repeated rows give repeated
pages; an empty table gives an empty result; every other column is carried along, unless its name
clashes with an output column, which then wins.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sozgar.llm.common import bound_batches, slices, text_bytes

# Fixed values of the TIFF 6.0 format: tags, compression schemes, field sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS = 256, 257, 258, 259, 262, 273
SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SCHEMES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
SCHEME_NAMES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
INTEGER_KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
LZW_CLEAR, LZW_END = 256, 257

PAGE_FIELDS = [
    ("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()),
    ("compression", pa.string()), ("predictor", pa.int32()), ("layout", pa.string()), ("pixels", pa.binary()), ("error", pa.string()),
]
PAGE_DDL = "page int, width long, height long, samples int, bits int, compression string, predictor int, layout string, pixels binary, error string"


# --- compression schemes -------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    """Runs of two or more equal bytes become a count and the byte; the rest is copied in literals."""
    out, i, n = bytearray(), 0, len(data)
    start = 0
    while i < n:
        j = i + 1
        while j < n and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i > 2 or (j - i == 2 and start == i):
            while start < i:
                part = data[start : min(i, start + 128)]
                out.append(len(part) - 1)
                out += part
                start += len(part)
            out.append(257 - (j - i))
            out.append(data[i])
            start = j
        i = j
    while start < n:
        part = data[start : start + 128]
        out.append(len(part) - 1)
        out += part
        start += len(part)
    return bytes(out)


def packbits_decode(data: bytes, expected: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < expected:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            if i >= n:
                raise ValueError("PackBits run without a byte")
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, codes grow one entry early, as readers of the format expect."""
    out, acc, held, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    table = {bytes([b]): b for b in range(256)}
    put(LZW_CLEAR)
    size, seen = 258, b""
    for b in data:
        longer = seen + bytes([b])
        if longer in table:
            seen = longer
            continue
        put(table[seen])
        table[longer] = size
        size += 1
        seen = bytes([b])
        if size == 4094:
            put(table[seen])
            put(LZW_CLEAR)
            table = {bytes([c]): c for c in range(256)}
            size, seen, width = 258, b"", 9
        elif size > (1 << width) - 1 and width < 12:
            width += 1
    if seen:
        put(table[seen])
        size += 1
        if size > (1 << width) - 1 and width < 12:
            width += 1
    put(LZW_END)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def lzw_decode(data: bytes, expected: int) -> bytes:
    first = [bytes([b]) for b in range(256)] + [b"", b""]
    table, out, last = list(first), bytearray(), b""
    acc = held = at = 0
    width, n = 9, len(data)
    while len(out) < expected:
        while held < width:
            if at >= n:
                return bytes(out)
            acc, held, at = acc << 8 | data[at], held + 8, at + 1
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError(f"LZW code {code} is not in the table")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def compress(data: bytes, scheme: str, level: int = 1) -> bytes:
    if scheme == "none":
        return data
    if scheme == "deflate":
        return zlib.compress(data, level)
    return packbits_encode(data) if scheme == "packbits" else lzw_encode(data)


def decompress(data: bytes, scheme: str, expected: int) -> bytes:
    if scheme == "none":
        return data[:expected]
    if scheme == "deflate":
        try:
            return zlib.decompressobj().decompress(data, expected) if expected else b""
        except zlib.error as e:
            raise ValueError(f"deflate: {e}") from None
    return packbits_decode(data, expected) if scheme == "packbits" else lzw_decode(data, expected)


# --- encoding ------------------------------------------------------------------------------------


def encode_tiff(pages: list[np.ndarray], scheme: str = "deflate", predictor: int = 2, rows_per_strip: int = 256, tile: int = 0, order: str = "<", level: int = 1) -> bytes:
    """A TIFF file with one image directory for each array (height, width) or (height, width, samples) of unsigned integers."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in pages:
        a = image[:, :, None] if image.ndim == 2 else image
        height, width, samples = a.shape
        bits = a.dtype.itemsize * 8
        blocks = [(y, x) for y in range(0, height, tile) for x in range(0, width, tile)] if tile else [(y, 0) for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for y, x in blocks:
            part = a[y : y + (tile or rows_per_strip), x : x + (tile or width)]
            if tile and part.shape[:2] != (tile, tile):
                part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            data = compress(part.astype(part.dtype.newbyteorder(order)).tobytes(), scheme, level)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
            if len(out) % 2:
                out.append(0)
        fields = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [SCHEMES[scheme]]), (PHOTOMETRIC, 3, [1]),
            *([] if tile else [(STRIP_OFFSETS, 4, offsets)]), (SAMPLES, 3, [samples]), *([] if tile else [(ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
            *([(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else []),
        ]
        entries = []
        for tag, kind, values in fields:
            body = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- decoding ------------------------------------------------------------------------------------


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and fields of each image directory, in the order of the chain; a loop in the chain is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        if at + 2 > len(data):
            raise ValueError("a directory lies beyond the file")
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise ValueError("a directory is cut off")
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = FIELD_BYTES.get(kind, 0) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if where + size > len(data):
                raise ValueError(f"the values of tag {tag} lie beyond the file")
            if kind in INTEGER_KINDS:
                fields[tag] = list(struct.unpack_from(f"{order}{count}{INTEGER_KINDS[kind]}", data, where))
        yield order, fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode_page(data: bytes, order: str, fields: dict[int, list[int]]) -> tuple[np.ndarray, dict]:
    """The samples (height, width, samples) of a directory and what describes them."""
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    scheme, predictor, planar = SCHEME_NAMES.get(one(COMPRESSION, 1)), one(PREDICTOR, 1), one(PLANAR, 1)
    if scheme is None or bits not in (8, 16, 32) or predictor not in (1, 2) or any(b != bits for b in fields.get(BITS, [])):
        raise ValueError(f"compression {one(COMPRESSION, 1)}, {fields.get(BITS)} bits, predictor {predictor} not supported")
    tiled = TILE_OFFSETS in fields
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = fields.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), fields.get(TILE_COUNTS if tiled else STRIP_COUNTS, [])
    if height and width and (bw <= 0 or bh <= 0):
        raise ValueError("blocks without a size")
    across, down = (-(-width // bw), -(-height // bh)) if height and width else (0, 0)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("too few strips or tiles")
    kind = np.dtype(f"u{bits // 8}")
    if len(data) * 1100 + 4096 < height * width * samples * kind.itemsize:
        raise ValueError("more samples than the file can hold")
    image = np.empty((height, width, samples), kind)
    for k in range(across * down * planes):
        plane, block = divmod(k, across * down)
        y, x = block // across * bh, block % across * bw
        rows = bh if tiled else min(bh, height - y)
        need = rows * bw * depth * kind.itemsize
        if offsets[k] + counts[k] > len(data):
            raise ValueError("a block lies beyond the file")
        raw = decompress(data[offsets[k] : offsets[k] + counts[k]], scheme, need)
        if len(raw) != need:
            raise ValueError(f"a block holds {len(raw)} bytes instead of {need}")
        part = np.frombuffer(raw, kind.newbyteorder(order)).astype(kind).reshape(rows, bw, depth)
        if predictor == 2:
            part = np.add.accumulate(part, axis=1, dtype=kind)
        part = part[: height - y, : width - x]
        image[y : y + part.shape[0], x : x + part.shape[1], plane : plane + depth] = part
    return image, {"width": width, "height": height, "samples": samples, "bits": bits, "compression": scheme, "predictor": predictor, "layout": "tiles" if tiled else "strips"}


def pages_of(data: bytes | None) -> Iterator[dict]:
    """One record for each page; a fault ends the file with a record that has ``error``."""
    if not data:
        return
    page = 0
    try:
        for order, fields in directories(data):
            image, about = decode_page(data, order, fields)
            yield {"page": page, **about, "pixels": image.tobytes(), "error": None}
            page += 1
    except ValueError as e:
        yield {"page": page, "error": str(e)}


# --- DataFrame operators -------------------------------------------------------------------------


def texts_to_tiff(df: DataFrame, text: str, media: str = "media", width: int = 64, rows_per_page: int = 4096, scheme: str = "deflate", predictor: int = 2, tile: int = 0) -> DataFrame:
    """Adds ``media``: the UTF-8 bytes of ``text`` (null: empty), with zero bytes up to a positive multiple of ``width``, as 8-bit samples."""

    bound_batches(df.sparkSession)

    def encode(batches):
        for batch in slices(batches, text):
            files = []
            for raw in text_bytes(batch.column(text)):
                rows = max(1, -(-len(raw) // width))
                samples = np.frombuffer(raw.ljust(rows * width, b"\0"), np.uint8).reshape(rows, width)
                files.append(encode_tiff([samples[y : y + rows_per_page] for y in range(0, rows, rows_per_page)], scheme, predictor, tile=tile))
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != media]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(files, pa.binary())], [*(n for n, _ in kept), media])

    schema = df.drop(media).withColumn(media, F.lit(None).cast("binary")).schema
    return df.drop(media).mapInArrow(encode, schema)


def page_rows(media: str, others: list[str]):
    """The batch function of ``tiff_pages``: page rows of each media value in turn, with the columns ``others``."""
    names = [n for n, _ in PAGE_FIELDS]

    def decode(batches):
        for batch in slices(batches, media):
            found = [(i, p) for i, x in enumerate(batch.column(media).to_pylist()) for p in pages_of(x)]
            at = pa.array([i for i, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in others), *(pa.array([p.get(n) for _, p in found], t) for n, t in PAGE_FIELDS)], [*others, *names])

    return decode


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of ``media`` with the other columns of its row; pages of a row follow each other."""
    others = [c for c in df.columns if c not in [n for n, _ in PAGE_FIELDS] and c != media]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in others)
    return df.select(*others, media).mapInArrow(page_rows(media, others), f"{head}, {PAGE_DDL}" if head else PAGE_DDL)


def page_digest(df: DataFrame, keys: list[str], media: str = "media") -> DataFrame:
    """Walks the pages of each media value and folds them back into the payload: ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``feature``.

    The page rows of ``tiff_pages`` are folded as they stream by in the same worker (page 0 opens a row), so
    pixels are neither shuffled nor sent back to the JVM.
    """
    decode = page_rows(media, keys)

    def fold(batches):
        held = None

        def close():
            payload, counts, shape = held["hash"], held["counts"], held["shape"]
            n = int(counts.sum())
            p = counts[counts > 0] / max(n, 1)
            mean = float((counts * np.arange(256)).sum()) / max(n, 1)
            feature = f"pages={held['pages']};width={shape[0]};height={shape[1]};mean={mean:.6f};levels={int((counts > 0).sum())};zeros={int(counts[0])};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.6f}"
            return [*held["keys"], n, payload.hexdigest(), zlib.crc32(held["tail"]), feature, held["error"]]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in decode(batches):
            done = []
            kinds = [batch.schema.field(k).type for k in keys] + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            rows = batch.to_pylist()
            for row in rows:
                if row["page"] == 0:
                    if held:
                        done.append(close())
                    held = {"keys": [row[k] for k in keys], "hash": hashlib.sha256(), "counts": np.zeros(256, np.int64), "tail": b"", "pages": 0, "shape": (row["width"], 0), "error": None}
                if row["error"]:
                    held["error"] = row["error"]
                    continue
                pixels = row["pixels"]
                held["hash"].update(pixels)
                held["counts"] += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                held["tail"] = (held["tail"] + pixels)[-64:]
                held["pages"] += 1
                held["shape"] = (row["width"], held["shape"][1] + row["height"])
            if done:
                yield table(done)
        if held:
            yield table([close()])

    added = ["payload_bytes long", "payload_sha256 string", "tail_crc32 long", "feature string", "error string"]
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    names = [*keys, *(a.split()[0] for a in added)]
    return df.select(*keys, media).mapInArrow(fold, ", ".join(head + added))


def media_facts(media: Column) -> list[Column]:
    return [F.length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256")]
