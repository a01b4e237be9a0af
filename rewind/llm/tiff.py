"""TIFF columns: write payloads as grey pages, walk image directories, one row per page.

The reader takes classic TIFF of either byte order: it follows the chain of image file
directories, reads strips or tiles that are stored plain or packed by PackBits, LZW or
deflate, undoes horizontal differencing and cuts padded tiles. 8-bit samples, one or more
interleaved per pixel. A page that can't be read, is larger than `MAX_PAGE` or claims more than its data
can hold gives a row with a null in `samples` and the reason in `error`, before anything of that size is allocated; a file that isn't TIFF
gives one such row; the pages before a broken directory are kept. A null or empty binary gives no row.

The writer stores a payload losslessly: rows of 64 samples, pages of at most 1024 rows;
packing, predictor and strips or tiles follow from the payload's checksum, so equal payloads
give equal files and a corpus exercises every path.

Nulls in texts count as empty; a very long text takes many pages; repeated rows each give
their pages; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, id_and_text, text_blocks

WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 1024, 64
#: Digests that leave a worker at once, at least.
ROWS_OUT = 256
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of a page at most, and how many a byte of any packing can stand for at most (LZW: 12 bits for the longest entry).
MAX_PAGE, MAX_RATIO = 1 << 30, 2800
#: Tags of the TIFF 6.0 specification (fixed values).
T_WIDTH, T_HEIGHT, T_BITS, T_COMPRESSION, T_PHOTOMETRIC, T_STRIP_OFFSETS, T_SAMPLES, T_ROWS_PER_STRIP, T_STRIP_COUNTS, T_PLANAR, T_PREDICTOR, T_TILE_WIDTH, T_TILE_HEIGHT, T_TILE_OFFSETS, T_TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
#: Bytes and struct codes of the field types.
FIELD = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as (1 - length, byte); the rest as literals of up to 128."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], edges))
    lengths = np.diff(np.concatenate((starts, [len(a)])))
    out, literal = bytearray(), 0

    def flush(upto: int) -> None:
        nonlocal literal
        while literal < upto:
            k = min(128, upto - literal)
            out.append(k - 1)
            out.extend(data[literal : literal + k])
            literal += k

    for k in np.flatnonzero(lengths >= 3):
        at, n = int(starts[k]), int(lengths[k])
        flush(at)
        while n > 1:
            run = min(128, n)
            out.append((1 - run) & 255)
            out.append(data[at])
            at, n = at + run, n - run
        literal = at
    flush(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, wider one code early."""
    table = {bytes([k]): k for k in range(256)}
    acc, bits, width, out, following = 256, 9, 9, bytearray(), 258
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        acc, bits = acc << width | table[word], bits + width
        table[longer] = following
        following += 1
        word = data[k : k + 1]
        if following == 4094:
            acc, bits = acc << 12 | 256, bits + 12
            table = {bytes([b]): b for b in range(256)}
            width, following = 9, 258
        elif following >= 1 << width:
            width += 1
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1
    if word:
        acc, bits = acc << width | table[word], bits + width
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    roots = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, acc, bits, last = list(roots), [], 9, 0, 0, None
    done = 0
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            table, width, last = list(roots), 9, None
            continue
        if code == 257:
            break
        if last is None:
            piece = table[code]
        elif code < len(table):
            piece = table[code]
            table.append(last + piece[:1])
        elif code == len(table):
            piece = last + last[:1]
            table.append(piece)
        else:
            raise ValueError("bad LZW code")
        out.append(piece)
        done += len(piece)
        last = piece
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        if done >= size:
            break
    return b"".join(out)


def write_tiff(payload: bytes) -> bytes:
    """A little-endian TIFF whose pages hold the payload (a positive multiple of WIDTH bytes) in order."""
    mark = zlib.crc32(payload)
    kind = mark % 16
    compression = LZW if kind == 0 else PACKBITS if kind < 6 else PLAIN if kind == 6 else DEFLATE
    predictor = 2 if compression in (LZW, DEFLATE) and mark >> 4 & 1 else 1
    tiled = bool(mark >> 5 & 1)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    for top in range(0, len(samples), PAGE_ROWS):
        page = samples[top : top + PAGE_ROWS]
        offsets, counts = [], []
        for row in range(0, len(page), STRIP_ROWS):
            part = page[row : row + STRIP_ROWS]
            if tiled and len(part) < STRIP_ROWS:
                part = np.vstack([part, np.zeros((STRIP_ROWS - len(part), WIDTH), np.uint8)])
            if predictor == 2:
                part = np.hstack([part[:, :1], np.diff(part, axis=1)])
            raw = part.tobytes()
            packed = {LZW: lzw_encode, PACKBITS: pack_bits, PLAIN: bytes, DEFLATE: lambda b: zlib.compress(b, 1)}[compression](raw)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        fields = {T_WIDTH: (3, [WIDTH]), T_HEIGHT: (4, [len(page)]), T_BITS: (3, [8]), T_COMPRESSION: (3, [compression]), T_PHOTOMETRIC: (3, [1]), T_SAMPLES: (3, [1]), T_PREDICTOR: (3, [predictor])}
        if tiled:
            fields |= {T_TILE_WIDTH: (4, [WIDTH]), T_TILE_HEIGHT: (4, [STRIP_ROWS]), T_TILE_OFFSETS: (4, offsets), T_TILE_COUNTS: (4, counts)}
        else:
            fields |= {T_ROWS_PER_STRIP: (4, [STRIP_ROWS]), T_STRIP_OFFSETS: (4, offsets), T_STRIP_COUNTS: (4, counts)}
        places = {}
        for tag, (field, values) in fields.items():
            if len(values) * FIELD[field][0] > 4:
                places[tag] = len(out)
                out += struct.pack(f"<{len(values)}{FIELD[field][1]}", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, (field, values) in sorted(fields.items()):
            out += struct.pack("<HHI", tag, field, len(values))
            out += struct.pack("<I", places[tag]) if tag in places else struct.pack(f"<{len(values)}{FIELD[field][1]}", *values).ljust(4, b"\0")
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    fields: dict[int, tuple] = {}
    for k in range(n):
        place = at + 2 + 12 * k
        tag, field, count = struct.unpack_from(f"{order}HHI", data, place)
        if field not in FIELD:
            continue
        width, code = FIELD[field]
        start = place + 8 if width * count <= 4 else struct.unpack_from(f"{order}I", data, place + 8)[0]
        if start + width * count > len(data):
            raise ValueError(f"values of tag {tag} lie outside the file")
        fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, start)
    return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, fields: dict[int, tuple]) -> np.ndarray:
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, channels, compression, predictor = one(T_WIDTH, 0), one(T_HEIGHT, 0), one(T_SAMPLES, 1), one(T_COMPRESSION, 1), one(T_PREDICTOR, 1)
    if set(fields.get(T_BITS, (1,))) != {8} or one(T_PLANAR, 1) != 1 and channels > 1:
        raise ValueError("only interleaved 8-bit samples")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    tiled = T_TILE_OFFSETS in fields
    if tiled:
        wide, high = fields[T_TILE_WIDTH][0], fields[T_TILE_HEIGHT][0]
        offsets, counts = fields[T_TILE_OFFSETS], fields[T_TILE_COUNTS]
    else:
        wide, high = width, min(one(T_ROWS_PER_STRIP, height), height)
        offsets, counts = fields[T_STRIP_OFFSETS], fields[T_STRIP_COUNTS]
    if min(width, height, channels) < 1:
        raise ValueError("an image without pixels")
    if min(wide, high) < 1:
        raise ValueError("strips or tiles without pixels")
    across = -(-width // wide)
    if min(len(offsets), len(counts)) < across * -(-height // high):
        raise ValueError("missing strips or tiles")
    size, held = height * width * channels, sum(min(n, len(data)) for n in counts)
    if size > MAX_PAGE or wide * high * channels > MAX_PAGE or size > MAX_RATIO * held:
        raise ValueError("larger than its data can be")
    image = np.empty((height, width, channels), np.uint8)
    for k in range(across * -(-height // high)):
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        size = rows * wide * channels
        raw = data[offsets[k] : offsets[k] + counts[k]]
        if compression == PACKBITS:
            raw = unpack_bits(raw, size)
        elif compression == LZW:
            raw = lzw_decode(raw, size)
        elif compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompressobj().decompress(raw, size)
        elif compression != PLAIN:
            raise ValueError(f"compression {compression}")
        if len(raw) < size:
            raise ValueError("short strip or tile")
        part = np.frombuffer(raw, np.uint8, size).reshape(rows, wide, channels)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        image[y : y + rows, x : x + wide] = part[: height - y, : width - x]
    return image


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes | None, str | None]]:
    """(page, width, height, samples per pixel, samples, error) of each image directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        yield 0, 0, 0, 0, None, "not a TIFF file"
        return
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen, page = set(), 0
    while at and at not in seen:
        seen.add(at)
        try:
            fields, at = _directory(data, order, at)
            image = _page(data, fields)
            yield page, image.shape[1], image.shape[0], image.shape[2], image.tobytes(), None
        except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
            yield page, 0, 0, 0, None, str(e)[:200]
            if isinstance(e, struct.error):
                return
        page += 1


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, media of an id_and_text table."""
    for ids, texts in text_blocks(batches):
        raw = [t.encode("utf-8") for t in texts]
        media = [write_tiff(b.ljust(max(1, -(-len(b) // WIDTH)) * WIDTH, b"\0")) for b in raw]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of the files in the last column, each with the other columns."""
    for batch in batches:
        others = batch.schema.names[:-1]
        for k in range(batch.num_rows):
            data = batch.column(len(others))[k].as_py()
            found = list(read_pages(data)) if data else []
            if found:
                own = [pa.array(batch.column(j)[k : k + 1].to_pylist() * len(found), batch.schema.field(j).type) for j in range(len(others))]
                p, w, h, c, s, e = zip(*found, strict=True)
                ints = [pa.array(x, pa.int32()) for x in (p, [len(found)] * len(found), w, h, c)]
                yield pa.RecordBatch.from_arrays([*own, *ints, pa.array(s, pa.binary()), pa.array(e, pa.string())], [*others, "page", "n_pages", "width", "height", "channels", "samples", "error"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of _stored with the length and digest of each file before it."""
    for batch in batches:
        media = batch.column(2).to_pylist()
        marks = [pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *marks, batch.column(2)], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "media"])


#: What _digested gives.
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per file of pages that come in order, about ROWS_OUT at a time."""
    parts: list[bytes] = []
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for r in batch.to_pylist():
            if r["page"] == 0:
                parts = []
            if r["error"]:
                raise ValueError(f"page {r['page']} of {r['doc_id']}: {r['error']}")
            parts.append(r["samples"])
            if r["page"] + 1 == r["n_pages"]:
                payload = b"".join(parts)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                share = counts[counts > 0] / len(payload)
                feature = f"pages={r['n_pages']};width={r['width']};mean={np.dot(counts, np.arange(256)) / len(payload):.4f};entropy={-float((share * np.log2(share)).sum()) + 0.0:.4f};values={len(share)}"
                out.append((r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), r["media_bytes"], r["media_sha256"], feature))
        if len(out) >= ROWS_OUT:
            yield flush()
            out.clear()
    if out:
        yield flush()


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, padded with zeros to a positive multiple of 64, as TIFF."""
    return arrow_map(id_and_text(docs, id_col, text_col), _stored, "doc_id long, n_bytes long, media binary")


def tiff_pages(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """One row per page, in the order of the files: the other columns and page, n_pages, width, height, channels, samples, error."""
    others = [c for c in media.columns if c != media_col]
    schema = ", ".join([f"`{c}` {media.schema[c].dataType.simpleString()}" for c in others] + ["page int, n_pages int, width int, height int, channels int, samples binary, error string"])
    return arrow_map(media.select(*others, media_col), _paged, schema)


def page_digests(pages: DataFrame) -> DataFrame:
    """Per file of tiff_pages over store_texts: what its samples say, from rows as they come (no shuffle)."""
    return arrow_map(pages, _digested, DIGESTS)


def media_round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back page by page, digest the pages.

    The same steps as page_digests over tiff_pages over store_texts, in one worker for each task:
    three in a row hold three workers' memory, and every file and page crosses to the JVM and back.
    """
    return arrow_map(id_and_text(docs, id_col, text_col), lambda batches: _digested(_paged(_marked(_stored(batches)))), DIGESTS)
