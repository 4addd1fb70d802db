"""TIFF as a media column: bytes to files, and files to one row per page.

The reader walks the chain of image directories, decodes the strips or tiles of
each page (none, PackBits, LZW, deflate), undoes horizontal differencing and
yields the page's samples.  It reads both byte orders.  The writer makes files
the reader and others can read; payloads are cut into pages of bounded height.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

# Tags, codes of compression, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FILL_ORDER, PLANAR = 266, 284
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

ROW_BYTES = 64
PAGE_ROWS = 1024
STRIP_ROWS = 256
#: Samples of a page, at most: a damaged header asks for no more memory than this.
PAGE_SAMPLES = 1 << 30


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as runs, all else as literals."""
    out, at = bytearray(), 0

    def literal(begin: int, end: int) -> None:
        for i in range(begin, end, 128):
            piece = data[i : min(i + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in re.finditer(rb"(.)\1{2,127}", data, re.S):
        literal(at, m.start())
        out += bytes((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literal(at, len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, wider one code early; 256 clears, 257 ends."""
    fresh = {bytes((i,)): i for i in range(256)}
    known, codes, widths, width, following, prefix = dict(fresh), [256], [9], 9, 258, b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in known:
            prefix = longer
            continue
        codes.append(known[prefix])
        widths.append(width)
        known[longer] = following
        following += 1
        if following == 4094:
            codes.append(256)
            widths.append(width)
            known, width, following = dict(fresh), 9, 258
        elif following == 1 << width:
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        codes.append(known[prefix])
        widths.append(width)
        if following + 1 == 1 << width and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    return _bits(np.array(codes), np.array(widths))


def _bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    shifts = np.arange(11, -1, -1)
    grid = (codes[:, None] >> shifts) & 1
    return np.packbits(grid[shifts[None, :] < widths[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    known, width, out, before, held, bits, at, made = list(fresh), 9, [], None, 0, 0, 0, 0
    while made < size:
        while bits < width and at < len(data):
            held, bits, at = (held << 8) | data[at], bits + 8, at + 1
        if bits < width:
            break
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            known, width, before = list(fresh), 9, None
            continue
        if code == 257:
            break
        if before is None:
            word = known[code]
        else:
            word = known[code] if code < len(known) else before + before[:1]
            known.append(before + word[:1])
            if len(known) + 1 >= (1 << width) and width < 12:
                width += 1
        out.append(word)
        made += len(word)
        before = word
    return b"".join(out)[:size]


def _encode(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
    raw = block.tobytes()
    if compression == PACKBITS:
        return b"".join(packbits_encode(raw[i : i + block.shape[1]]) for i in range(0, len(raw), block.shape[1]))
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6)}[compression](raw)


def write_tiff(pages: list[tuple[np.ndarray, int, int, bool]]) -> bytes:
    """Pages of (rows x columns of 8-bit grey samples, compression, predictor, tiled) as one little-endian file."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for samples, compression, predictor, tiled in pages:
        height, width = samples.shape
        step = 64 if tiled else STRIP_ROWS
        places, counts = [], []
        for top in range(0, height, step):
            block = samples[top : top + step]
            if tiled:
                grid = np.zeros((64, 64 * -(-width // 64)), np.uint8)
                grid[: len(block), :width] = block
                blocks = [grid[:, x : x + 64] for x in range(0, grid.shape[1], 64)]
            else:
                blocks = [block]
            for b in blocks:
                coded = _encode(b, compression, predictor)
                places.append(len(out))
                counts.append(len(coded))
                out += coded + b"\0" * (len(coded) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [64]), (TILE_HEIGHT, 4, [64]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, counts)] if tiled else [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [step]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed
                packed = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_tiff(data: bytes):
    """Yields one dict per image directory: page, width, height, compression, predictor, tiled, samples (bytes, row by row).

    Data that isn't TIFF, is cut off or damaged, and pages of another kind than
    8-bit samples in one plane, raise ValueError, after the pages before;
    strips that hold less than they should are filled with zeros; a chain that
    comes back to a directory it has seen ends there.
    """
    try:
        yield from _directories(data)
    except (struct.error, KeyError, IndexError, zlib.error, OverflowError, ZeroDivisionError) as e:
        raise ValueError(f"damaged TIFF file: {type(e).__name__} {e}") from e


def _directories(data: bytes):
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    place, page, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while place and place not in seen:
        seen.add(place)
        tags = {}
        (count,) = struct.unpack_from(order + "H", data, place)
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, place + 2 + 12 * i)
            where = place + 10 + 12 * i
            if n * FIELD_BYTES.get(kind, 1) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{order}{n}{'_BxHI'[kind]}", data, where)
        (place,) = struct.unpack_from(order + "I", data, place + 2 + 12 * count)
        one = lambda tag, default: tags.get(tag, (default,))[0]  # noqa: E731, B023
        width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        compression, predictor, tiled = one(COMPRESSION, NONE), one(PREDICTOR, 1), TILE_OFFSETS in tags
        if any(b != 8 for b in tags.get(BITS, (1,))):
            raise ValueError("only samples of 8 bits are read")
        if one(PLANAR, 1) != 1 or one(FILL_ORDER, 1) != 1:
            raise ValueError("only samples in one plane, high bits first, are read")
        if width * height * samples > PAGE_SAMPLES:
            raise ValueError("the page is too large")
        across, down = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        image = np.zeros((height, width * samples), np.uint8)
        columns = -(-width // across) if width else 0
        for i, (begin, n) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS])):
            top, left = i // columns * down, i % columns * across
            rows = down if tiled else min(down, height - top)
            size = rows * across * samples
            raw = data[begin : begin + n]
            if compression == LZW:
                raw = lzw_decode(raw, size)
            elif compression in (DEFLATE, OLD_DEFLATE):
                raw = zlib.decompress(raw)
            elif compression == PACKBITS:
                raw = packbits_decode(raw, size)
            elif compression != NONE:
                raise ValueError(f"compression {compression} isn't read")
            block = np.frombuffer(raw[:size].ljust(size, b"\0"), np.uint8).reshape(rows, across, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            block = block.reshape(rows, across * samples)[: height - top, : (width - left) * samples]
            image[top : top + len(block), left * samples : left * samples + block.shape[1]] = block
        yield {"page": page, "width": width, "height": height, "compression": compression, "predictor": predictor, "tiled": tiled, "samples": image.tobytes()}
        page += 1


def payload_of(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return text.ljust(max(ROW_BYTES, -(-len(text) // ROW_BYTES) * ROW_BYTES), b"\0")


def tiff_of(payload: bytes) -> bytes:
    """A payload of whole rows as pages of at most PAGE_ROWS rows.

    A checksum of the payload picks how it is stored, so equal payloads give
    equal files: one in sixteen as LZW strips, one in eight as PackBits tiles,
    the others deflated with the predictor, in strips or tiles.
    """
    pick = zlib.crc32(payload) % 16
    compression, predictor, tiled = (LZW, 1, False) if pick == 0 else (PACKBITS, 1, True) if pick in (1, 2) else (DEFLATE, 2, pick % 2 == 0)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    return write_tiff([(rows[i : i + PAGE_ROWS], compression, predictor, tiled) for i in range(0, len(rows), PAGE_ROWS)])


def store(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a TIFF file; null text counts as empty."""

    def make(batches):
        for pdf in sliced(batches):
            raw = [t.encode() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(t) for t in raw], "media": [tiff_of(payload_of(t)) for t in raw]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(make, "doc_id long, n_bytes long, media binary")


_PAGE = "page int, width int, height int, compression int, predictor int, tiled boolean, samples binary, error string"


def pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of each file: the other columns of media, doc_id, page (from 0), width, height, compression, predictor, tiled, samples, error.

    Null media have no pages.  A file that can't be read, from its beginning or
    from some page on, ends in a row that has no samples but says why in error;
    rows of a file follow one another in their order.  Columns of media with
    the names of the added ones give way.
    """
    added = [c.split(" ")[0] for c in _PAGE.split(", ")]
    kept = [c for c in media.columns if c not in (id_col, media_col, "doc_id", *added)]
    source = media.filter(F.col(media_col).isNotNull()).select(F.col(id_col).alias("doc_id"), *[F.col(f"`{c}`") for c in kept], F.col(media_col).alias("__media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__media") + ", " + _PAGE

    def rows_of(data: bytes):
        page = 0
        try:
            for p in read_tiff(data):
                page = p["page"] + 1
                yield [p[c] for c in added[:-1]] + [None]
        except ValueError as e:
            yield [page] + [None] * 6 + [str(e)]
        else:
            if not page:
                yield [0] + [None] * 6 + ["no page"]

    def read(batches):
        for pdf in sliced(batches, 100):
            own = [c for c in pdf.columns if c != "__media"]
            at, rows = [], []
            for i, data in enumerate(pdf["__media"]):
                for row in rows_of(bytes(data)):
                    at.append(i)
                    rows.append(row)
            found = pd.DataFrame(rows, columns=added).astype({c: "Int32" for c in added[:5]} | {"tiled": "boolean"})
            yield pd.concat([pdf[own].iloc[at].reset_index(drop=True), found], axis=1)

    return source.mapInPandas(read, schema)


def features(image: np.ndarray) -> str:
    """Mean and spread of the samples, their entropy in bits, and a 16-bit hash of the sums of a 4 x 4 grid."""
    share = np.bincount(image.ravel(), minlength=256) / image.size
    bits = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    blocks = image.reshape(len(image), 4, -1).sum(axis=2)
    grid = np.add.reduceat(blocks, np.minimum(np.arange(4) * len(image) // 4, len(image) - 1), axis=0)
    code = int("".join("1" if x > grid.mean() else "0" for x in grid.ravel()), 2)
    return f"mean={image.mean():.3f};std={image.std():.3f};entropy={bits + 0.0:.3f};hash={code:04x}"


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to what the stored bytes hold once read back page by page: sizes, checksums, features.

    The pages of a file stay in the task that holds the file, in their order, so
    they are put together as they come and rows that repeat an id don't meet.  A
    file that can't be read raises.
    """
    sized = media.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")

    def digest(batches):
        whole, parts = None, []

        def row():
            payload = b"".join(parts)
            return (*whole[:2], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW_BYTES:]), *whole[2:], features(np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)))

        framed = lambda rows: pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"doc_id": "Int64"})
        for pdf in batches:
            rows = []
            for i, n, size, sha, page, samples, error in zip(*[pdf[c] for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "samples", "error")]):
                if error is not None:
                    raise ValueError(error)
                if page == 0:
                    if whole:
                        rows.append(row())
                    whole, parts = (None if pd.isna(i) else int(i), n, size, sha), []
                parts.append(bytes(samples))
            yield framed(rows)
        if whole:
            yield framed([row()])

    return pages(sized).mapInPandas(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
