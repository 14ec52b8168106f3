"""TIFF media columns: image directories to one row per page.

``walk`` follows the directories of a file (either byte order), decodes strips or tiles (none,
PackBits, LZW, deflate), undoes horizontal differencing, and gives each page's samples. ``write_tiff``
stores bytes losslessly as 8-bit grey pages; consecutive pages take turns through all codings, in
strips and in tiles, with and without differencing, whatever the payload's size. Both are plain
functions of one file's bytes; Spark spreads the files (``pages``: a row per page).

``round_trip`` stores every text in small pages, reads them back through ``pages`` and folds each
file's page rows, which lie one behind the other, so nothing is shuffled and no file is held whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed values of the TIFF 6.0 format: tags, field types (code: struct letter), compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Page layout of ``write_tiff``: pages may be lower than PAGE_ROWS; tiles are as wide as a page and up to TILE rows long
#: (a multiple of 16), the last one of a page padded.
PAGE_WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 4096, 512, 64
#: Layout of the stored texts: pages of up to 4 KB, four at least, so that every text meets each coding and layout.
TEXT_PAGES = {"width": 16, "page_rows": 256, "strip_rows": 128, "tile": 128, "least_pages": 4}
#: Turns of ``write_tiff``: (coding, tiled, predictor). Any four in a row hold every coding, layout and predictor.
TURNS = tuple(((LZW, PACKBITS, DEFLATE)[k % 3], k % 2 == 1, 1 + k // 2 % 2) for k in range(12))
#: A stored page may claim this many bytes at most (a damaged header claims anything); larger ones give an error row.
MAX_PAGE = 1 << 28


class BadTiff(ValueError):
    """The bytes are not a TIFF file that these functions can decode."""


# ---------------------------------------------------------------- compressions


def packbits_encode(data: bytes) -> bytes:
    """Literal packets of up to 128 bytes, runs of three or more as repeat packets."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    cuts = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(a)]]))
    out, done = [], 0

    def literal(lo: int, hi: int) -> None:
        for i in range(lo, hi, 128):
            part = data[i : min(i + 128, hi)]
            out.append(bytes([len(part) - 1]) + part)

    for s, n in zip(starts[sizes >= 3].tolist(), sizes[sizes >= 3].tolist()):
        literal(done, s)
        for i in range(0, n, 128):
            k = min(128, n - i)
            out.append(bytes([257 - k if k > 1 else 0, data[s]]))
        done = s + n
    literal(done, len(data))
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, held = [], 0, 0
    while i < len(data) and held < size:
        n = data[i]
        if n < 128:
            part = data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            part = data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            part, i = b"", i + 1
        out.append(part)
        held += len(part)
    return b"".join(out)[:size]


#: Width of the k-th code behind a clear code, and the bits before it: the reader's table grows by one entry a code.
_WIDTHS = 9 + sum((257 + np.maximum(1, np.arange(1 << 13)) >= limit).astype(np.int64) for limit in (511, 1023, 2047))
_BEFORE = np.cumsum(_WIDTHS) - _WIDTHS


_SINGLE = [chr(k) for k in range(256)] + ["", ""]
_BIT = np.arange(11, -1, -1)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    codes, clears = [256], [0]  # the clear code comes first, and again where the table is full
    put, table, n, prefix = codes.append, {}, 258, -1
    find = table.get
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        longer = find(key)
        if longer is not None:
            prefix = longer
            continue
        put(prefix)
        table[key], prefix, n = n, byte, n + 1
        if n >= 4095:
            clears.append(len(codes))
            put(256)
            table.clear()
            n = 258
    if prefix >= 0:
        put(prefix)
    put(257)
    # a code's width follows from the number of codes since the last clear code; that one still has the old width
    at = np.arange(len(codes))
    since = at - np.array(clears)[np.searchsorted(clears, at, "left") - 1] - 1
    width = _WIDTHS[np.maximum(since, 0)]
    bits = (np.array(codes)[:, None] >> _BIT) & 1
    return np.packbits(bits[_BIT < width[:, None]].astype(np.uint8)).tobytes()


def _codes(data: np.ndarray, bit: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes from ``bit`` on, ``known`` codes behind a clear code, and the bit behind each. ``data`` ends in 3 spare bytes."""
    known = min(known, 1 << 12)
    most = known + (1 if not bit else (8 * len(data) - bit) // 9 + 1)  # the first code is a clear code: alone
    at = bit + _BEFORE[known:most] - _BEFORE[known]
    width = _WIDTHS[known:most]
    n = int(np.searchsorted(at + width, 8 * (len(data) - 3), "right"))
    at, width = at[:n], width[:n]
    b = at >> 3
    word = data[b].astype(np.int64) << 16 | data[b + 1].astype(np.int64) << 8 | data[b + 2]
    return (word >> (24 - (at & 7) - width)) & ((1 << width) - 1), at + width


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out, held, bit, known, last = [], 0, 0, 0, None
    table: list[str] = []
    while held < size:
        codes, behind = _codes(raw, bit, known)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else len(codes)
        first, walk_ = len(out), iter(codes[:n].tolist())
        if last is None and n:
            code = next(walk_)
            if code >= len(table):
                raise BadTiff("LZW data begins without a clear code")
            last = table[code]
            out.append(last)
        top, put, grow = len(table), out.append, table.append
        for code in walk_:
            if code < top:
                entry = table[code]
            elif code == top:
                entry = last + last[0]
            else:
                raise BadTiff("LZW code out of range")
            grow(last + entry[0])
            top += 1
            put(entry)
            last = entry
        held += sum(map(len, out[first:]))
        if n == len(codes):
            if not n:
                break  # the data end here
            bit, known = int(behind[-1]), known + n
        elif codes[n] == 257:
            break
        else:
            bit, known, last, table = int(behind[n]), 0, None, _SINGLE.copy()
    return "".join(out).encode("latin-1")[:size]


def decompress(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how == PACKBITS:
        return packbits_decode(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from e
    raise BadTiff(f"compression {how} is not supported")


def compress(data: bytes, how: int) -> bytes:
    if how == PACKBITS:
        return packbits_encode(data)
    if how == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1) if how == DEFLATE else data


# ---------------------------------------------------------------- reading


@dataclass
class Page:
    """One directory: geometry and samples (rows x width x samples)."""

    number: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    layout: str
    pixels: np.ndarray


def walk(data: bytes) -> Iterator[tuple[int | None, Page | str]]:
    """(number, page) of every directory in order; (number, reason) of one that cannot be decoded, and
    the walk goes on to the next. A file whose chain of directories is broken ends with (None, reason)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        yield None, "no TIFF header"
        return
    at, seen, number = struct.unpack(order + "I", data[4:8])[0], set(), 0
    while at:
        if at in seen or at + 2 > len(data):
            yield None, "a directory lies outside the file or repeats"
            return
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            if at + 2 + 12 * n + 4 > len(data):
                yield None, "a directory is cut short"
                return
            here, at = at, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
            yield number, _page(data, order, _directory(data, here, order, n), number)
        except (BadTiff, struct.error) as e:
            yield number, str(e)
        number += 1
    if not number:
        yield None, "no directory"


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page of a file, in directory order. Raises BadTiff on damaged or unsupported input."""
    for _, page in walk(data):
        if isinstance(page, str):
            raise BadTiff(page)
        yield page


def _directory(data: bytes, at: int, order: str, n: int) -> dict[int, tuple]:
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        letter = TYPES.get(kind)
        if letter is None:
            continue
        form = f"{order}{count}s" if letter == "s" else order + letter * count if count < 1 << 24 else None
        if form is None:
            raise BadTiff("a field is too long")
        size, where = struct.calcsize(form), at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + size > len(data):
            raise BadTiff("a field lies outside the file")
        tags[tag] = struct.unpack_from(form, data, where)
    return tags


def _page(data: bytes, order: str, tags: dict[int, tuple], number: int) -> Page:
    def one(tag: int, default=None):
        if tag in tags and tags[tag]:
            return tags[tag][0]
        if default is None:
            raise BadTiff(f"tag {tag} is missing")
        return default

    width, height, bits, samples = one(WIDTH), one(LENGTH), one(BITS, 1), one(SAMPLES, 1)
    how, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise BadTiff(f"{bits} bits a sample are not supported")
    if one(PLANAR, 1) != 1 and samples > 1:
        raise BadTiff("separate planes are not supported")
    if predictor not in (1, 2):
        raise BadTiff(f"predictor {predictor} is not supported")
    unit = bits // 8
    if not width or not height or width * height * samples * unit > MAX_PAGE:
        raise BadTiff("page size out of range")
    kind = np.dtype(np.uint8) if unit == 1 else np.dtype(order + "u2")
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags.get(TILE_OFFSETS, ()), tags.get(TILE_COUNTS, ())) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ()))
    if not w or not h or w * h * samples * unit > MAX_PAGE:
        raise BadTiff("strip or tile size out of range")
    across = -(-width // w)
    if len(offsets) != len(counts) or len(offsets) != across * -(-height // h):
        raise BadTiff("the number of strips or tiles is wrong")
    pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (o, c) in enumerate(zip(offsets, counts)):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        if o + c > len(data):
            raise BadTiff("a strip or tile lies outside the file")
        raw = decompress(data[o : o + c], how, rows * w * samples * unit)
        if len(raw) < rows * w * samples * unit:
            raise BadTiff("a strip or tile is cut short")
        part = np.frombuffer(raw, kind).reshape(rows, w, samples).astype(pixels.dtype)
        if predictor == 2:
            part = np.cumsum(part, 1, dtype=pixels.dtype)
        pixels[y : y + rows, x : x + w] = part[: height - y, : width - x]
    return Page(number, width, height, bits, samples, how, predictor, "tiles" if tiled else "strips", pixels)


# ---------------------------------------------------------------- writing


def write_tiff(payload: bytes, width: int = PAGE_WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, tile: int = TILE, least_pages: int = 1) -> bytes:
    """A file of 8-bit grey pages ``width`` samples wide; ``payload`` must be a positive multiple of the width.

    The rows are dealt evenly over pages of up to ``page_rows`` rows, ``least_pages`` at least as far as
    there are rows. Pages go through TURNS from one that the payload's crc32 names. Equal payloads give equal files.
    """
    if not payload or len(payload) % width or tile % 16 or width % 16:
        raise ValueError("the payload must be a positive multiple of the width; width and tile length multiples of 16")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    n_pages = max(-(-len(rows) // page_rows), min(least_pages, len(rows)))
    turn, at = zlib.crc32(payload), 8
    out = [struct.pack("<2sHI", b"II", 42, at)]
    for k in range(n_pages):
        part = rows[k * len(rows) // n_pages : (k + 1) * len(rows) // n_pages]
        page = _write_page(part, at, *TURNS[(turn + k) % len(TURNS)], strip_rows, tile, k + 1 == n_pages)
        out.append(page)
        at += len(page)
    return b"".join(out)


def _write_page(rows: np.ndarray, at: int, how: int, tiled: bool, predictor: int, strip_rows: int, tile: int, last: bool) -> bytes:
    """Directory, arrays and data of one page that begins at offset ``at`` of the file."""
    width, tile, parts = rows.shape[1], min(tile, -(-len(rows) // 16) * 16), []
    step = tile if tiled else strip_rows
    for y in range(0, len(rows), step):
        part = rows[y : y + step]
        if tiled and len(part) < tile:
            part = np.concatenate([part, np.zeros((tile - len(part), width), np.uint8)])
        if predictor == 2:
            left, part = part, part.copy()
            part[:, 1:] -= left[:, :-1]
        parts.append(compress(part.tobytes(), how))
    n = len(parts)
    fields = {WIDTH: (4, width), LENGTH: (4, len(rows)), BITS: (3, 8), COMPRESSION: (3, how), PHOTOMETRIC: (3, 1), SAMPLES: (3, 1), PREDICTOR: (3, predictor)}
    fields |= {TILE_WIDTH: (4, width), TILE_LENGTH: (4, tile)} if tiled else {ROWS_PER_STRIP: (4, strip_rows)}
    offsets_tag, counts_tag = (TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)
    arrays = at + 2 + 12 * (len(fields) + 2) + 4
    first = arrays + (8 * n if n > 1 else 0)
    padded = [p + b"\0" * (len(p) % 2) for p in parts]
    starts = list(accumulate((len(p) for p in padded[:-1]), initial=first))
    entries = {tag: struct.pack("<HHI", tag, kind, 1) + struct.pack("<I", value) for tag, (kind, value) in fields.items()}
    entries[offsets_tag] = struct.pack("<HHII", offsets_tag, 4, n, starts[0] if n == 1 else arrays)
    entries[counts_tag] = struct.pack("<HHII", counts_tag, 4, n, len(parts[0]) if n == 1 else arrays + 4 * n)
    link = 0 if last else starts[-1] + len(padded[-1])
    head = [struct.pack("<H", len(entries)), *(entries[tag] for tag in sorted(entries)), struct.pack("<I", link)]
    if n > 1:
        head.append(struct.pack(f"<{2 * n}I", *starts, *map(len, parts)))
    return b"".join([*head, *padded])


# ---------------------------------------------------------------- Spark


PAGES_SCHEMA = "file_id long, page int, width int, height int, bits int, samples int, compression int, predictor int, layout string, pixels binary, error string"
#: Bytes of samples that a task gathers before it hands rows on.
GATHER = 4 << 20


def pages(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of every file. ``files``: file_id, content (binary); columns named in ``carry`` come along.

    pixels: samples row by row (16-bit ones little-endian). A page that is damaged or of an unsupported
    kind gives a row with its number and error, and the pages behind it follow; a file that is null,
    empty or whose chain of directories breaks ends with a row that has error and no page. Nothing is
    dropped silently. A file's rows follow each other in the order of its pages.
    """
    schema = StructType([*StructType.fromDDL(PAGES_SCHEMA), *(files.schema[c] for c in carry)])

    def run(batches):
        for batch in batches:
            rows, owner, size = [], [], 0
            for i, (file_id, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                for number, p in walk(content.as_py() or b""):
                    if isinstance(p, str):
                        rows.append((file_id, number, *[None] * 8, p))
                    else:
                        rows.append((file_id, number, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.layout, p.pixels.astype(p.pixels.dtype.newbyteorder("<"), copy=False).tobytes(), None))
                        size += p.pixels.nbytes
                    owner.append(i)
                    if size >= GATHER:
                        yield _rows(rows, batch, owner)
                        rows, owner, size = [], [], 0
            if rows:
                yield _rows(rows, batch, owner)

    def _rows(rows: list[tuple], batch: pa.RecordBatch, owner: list[int]) -> pa.RecordBatch:
        made = _columns(rows, PAGES_SCHEMA)
        extra = batch.take(pa.array(owner, pa.int64()))
        return pa.RecordBatch.from_arrays([*made, *extra.columns[2:]], schema.names)

    return files.select(F.col("file_id").cast("long"), F.col("content").cast("binary"), *carry).mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _columns(rows: list[tuple], schema: str) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], _ARROW[field.split()[1]]) for i, field in enumerate(schema.split(", "))]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text (null: empty) with bytes 0 up to a positive multiple of 64; its own length."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % PAGE_WIDTH or (0 if raw else PAGE_WIDTH)), len(raw)


STORED_SCHEMA = "file_id long, content binary, n_bytes long, media_bytes long, media_sha256 string"


def stored(docs: DataFrame) -> DataFrame:
    """file_id (the doc_id), content (the text as a TIFF file), n_bytes of the text, media_bytes and media_sha256 of the file."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, text in zip(batch.column(0)[lo : lo + 256].to_pylist(), batch.column(1)[lo : lo + 256]):
                    payload, n = payload_of(text.as_py())
                    media = write_tiff(payload, **TEXT_PAGES)
                    rows.append((doc_id, media, n, len(media), sha256(media).hexdigest()))
                yield pa.RecordBatch.from_arrays(_columns(rows, STORED_SCHEMA), [x.split()[0] for x in STORED_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED_SCHEMA)


class Fold:
    """What ``round_trip`` keeps of the pages of one file read so far."""

    def __init__(self, file_id: int | None, carried: tuple):
        self.file_id, self.carried = file_id, carried
        self.digest, self.size, self.tail, self.pages, self.rows, self.kinds = sha256(), 0, b"", 0, 0, {}
        self.total, self.share = 0, np.zeros(8, np.int64)

    def add(self, height: int, kind: tuple, pixels: bytes) -> None:
        self.digest.update(pixels)
        flat = np.frombuffer(pixels, np.uint8)
        self.size, self.tail, self.pages, self.rows = self.size + len(pixels), (self.tail + pixels)[-64:], self.pages + 1, self.rows + height
        self.kinds[kind] = self.kinds.get(kind, 0) + 1
        self.total += int(flat.sum(dtype=np.int64))
        self.share += np.bincount(flat >> 5, minlength=8)

    def row(self) -> tuple:
        n_bytes, media_bytes, media_sha = self.carried
        # pages, rows, mean and spread of the samples: shares of the eight ranges of 32 values
        feature = f"p{self.pages}h{self.rows}m{self.total * 100 // self.size}-" + "".join(f"{x * 255 // self.size:02x}" for x in self.share.tolist())
        kinds = ",".join(f"{NAMES[how]}-{layout}-{predictor}:{n}" for (how, layout, predictor), n in sorted(self.kinds.items()))
        return self.file_id, n_bytes, self.size, self.digest.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha, feature, self.pages, kinds


NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}
ROUND_TRIP_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int, kinds string"
_CARRY = ("n_bytes", "media_bytes", "media_sha256")


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text as TIFF, read the stored bytes back page by page, and describe what was read.

    One row per row of ``docs``, repeated rows and null ids too; a null text is empty, an empty text
    64 bytes 0. kinds: the codings, layouts and predictors that were read, with their page counts.
    """

    def run(batches):
        names = [x.split()[0] for x in ROUND_TRIP_SCHEMA.split(", ")]
        now, done = None, []
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            plain = zip(*(c[x].to_pylist() for x in ("file_id", "page", "height", "compression", "layout", "predictor", "error", *_CARRY)), c["pixels"])
            for file_id, page, height, how, layout, predictor, error, *carried, pixels in plain:
                if error:
                    raise BadTiff(f"a stored text did not come back: {error}")
                if page == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Fold(file_id, tuple(carried))
                now.add(height, (how, layout, predictor), pixels.as_py())
            if done:
                yield pa.RecordBatch.from_arrays(_columns(done, ROUND_TRIP_SCHEMA), names)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays(_columns([now.row()], ROUND_TRIP_SCHEMA), names)

    return pages(stored(docs), _CARRY).mapInArrow(run, ROUND_TRIP_SCHEMA)
