"""Media columns: payloads kept in baseline JPEG files and read back as DC-only luminance thumbnails.

Each payload byte is the DC level of one 8 x 8 block, so a decoder sees flat blocks of exactly that sample
value and nothing is lost.  A frame is 24 blocks wide; every row of blocks is a restart interval.  Intervals
are independent bit streams, so numpy decodes them side by side, one symbol of each at a time; the intervals
of many files with the same tables are decoded together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

COLUMNS = 24
UNIT = COLUMNS * COLUMNS
FRAME_ROWS = 8184  # blocks; the format's heights end at 65535 pixels
DC_LENGTHS, DC_SYMBOLS = (0, 0, 6, 3), tuple(range(9))  # codes of 3 and 4 bits for 9 size classes
AC_LENGTHS, AC_SYMBOLS = (1,), (0,)  # only the end of a block occurs


def canonical_codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a Huffman table given as the count of codes of each length."""
    out, code, at = [], 0, 0
    for bits, count in enumerate(lengths, 1):
        for _ in range(count):
            out.append((symbols[at], code, bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16 bits ahead: symbol * 32 + bits of the code; 0 if none fits."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, code, bits in canonical_codes(lengths, symbols):
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = symbol * 32 + bits
    return out


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a whole block for each DC difference, at index difference + 255."""
    dc = {s: (c, b) for s, c, b in canonical_codes(DC_LENGTHS, DC_SYMBOLS)}
    (_, eob, eob_bits), = canonical_codes(AC_LENGTHS, AC_SYMBOLS)
    code, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << size) - 1
        c, b = dc[size]
        code[d + 255] = ((c << size | extra) << eob_bits) | eob
        bits[d + 255] = b + size + eob_bits
    return code, bits


CODE, CODE_BITS = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    huffman = b"".join(bytes([kind]) + bytes([*lengths, *[0] * (16 - len(lengths))]) + bytes(symbols) for kind, lengths, symbols in ((0x00, DC_LENGTHS, DC_SYMBOLS), (0x10, AC_LENGTHS, AC_SYMBOLS)))
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, COLUMNS * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, huffman)
        + _segment(0xDD, struct.pack(">H", COLUMNS))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with 255 to a positive multiple of 576, and the count of unfilled bytes."""
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % UNIT or (UNIT if not raw else 0)), len(raw)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """One stored form each: the JPEG files of its frames, one after another."""
    lanes = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, COLUMNS).astype(np.int32) - 128
    diff = lanes.copy()
    diff[:, 1:] -= lanes[:, :-1]
    diff += 255
    code, bits = CODE[diff], CODE_BITS[diff]
    offset = np.cumsum(bits, axis=1) - bits
    total = offset[:, -1] + bits[:, -1]
    size = (total + 7) >> 3
    width = int(size.max()) + 2
    out = np.zeros((len(lanes), width + 2), np.uint8)
    flat, base = out.reshape(-1), np.arange(len(lanes)) * (width + 2)
    for k in range(COLUMNS):
        o = offset[:, k]
        word = code[:, k] << (24 - bits[:, k] - (o & 7))
        at = base + (o >> 3)
        flat[at] |= (word >> 16).astype(np.uint8)
        flat[at + 1] |= ((word >> 8) & 255).astype(np.uint8)
        flat[at + 2] |= (word & 255).astype(np.uint8)
    flat[base + size - 1] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)
    per = np.array([len(p) // COLUMNS for p in payloads])
    row = np.arange(len(lanes)) - np.repeat(np.cumsum(per) - per, per)
    in_frame = row % FRAME_ROWS
    last = (in_frame == FRAME_ROWS - 1) | (row == np.repeat(per, per) - 1)
    flat[base + size] = 0xFF  # the marker that ends the interval
    flat[base + size + 1] = np.where(last, 0xD9, 0xD0 + in_frame % 8)
    column = np.arange(width + 2)[None, :]
    used = column < (size + 2)[:, None]
    stuffed = (out == 0xFF) & (column < size[:, None])
    count = (used.astype(np.int64) + stuffed)[used]
    stream = np.zeros(int(count.sum()), np.uint8)
    stream[np.cumsum(count) - count] = out[used]
    ends = np.cumsum((used.sum(axis=1) + stuffed.sum(axis=1)))
    blobs, at, lane, body = [], 0, 0, stream.tobytes()
    for n in per.tolist():
        parts = []
        for a in range(0, n, FRAME_ROWS):
            rows = min(FRAME_ROWS, n - a)
            end = int(ends[lane + rows - 1])
            parts += [_header(rows), body[at:end]]
            at, lane = end, lane + rows
        blobs.append(b"".join(parts))
    return blobs


@dataclass
class Frame:
    """What the markers of one JPEG file say; ``scan`` is its entropy-coded bytes with their last marker."""

    width: int
    height: int
    blocks: tuple[tuple[int, bytes, bytes], ...]  # of each MCU: component, DC table, AC table
    sampling: tuple[int, int]
    grid: tuple[int, int]  # MCU columns and rows
    interval: int
    step: int  # of the luminance DC quantiser
    scan: bytes


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """Reads the markers of the baseline JPEG file at a place, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at += 2
    quant: dict[int, int] = {}
    tables: dict[int, bytes] = {}
    interval, size, parts = 0, (0, 0), {}
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            _, h, w, n = struct.unpack_from(">BHHB", body)
            size = (w, h)
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only baseline JPEG is read")
        elif marker == 0xDA:
            order = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            break
    end = at
    while True:
        end = data.index(b"\xff", end)
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 2
            continue
        break
    h, v, q = parts[order[0][0]]
    if len(order) == 1:
        h = v = 1
    blocks = tuple((i, tables[t >> 4], tables[0x10 | t & 15]) for i, (c, t) in enumerate(order) for _ in range(1 if len(order) == 1 else parts[c][0] * parts[c][1]))
    top = (max(p[0] for p in parts.values()), max(p[1] for p in parts.values())) if len(order) > 1 else (1, 1)
    grid = (-(-size[0] // (8 * top[0])), -(-size[1] // (8 * top[1])))
    frame = Frame(*size, blocks, (h, v), grid, interval, quant[q], data[at:end] + b"\xff\xd9")
    return frame, data.index(b"\xff\xd9", end) + 2


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _table(spec: bytes) -> np.ndarray:
    if spec not in _LOOKUPS:
        _LOOKUPS[spec] = _lookup(tuple(spec[:16]), tuple(spec[16:]))
    return _LOOKUPS[spec]


def _lanes(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The unstuffed bytes of every restart interval and where each begins, with room to look ahead."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    after = np.concatenate((raw[1:], [0]))
    mark = (raw == 0xFF) & (after != 0)
    drop = mark.copy()
    drop[1:] |= (raw[:-1] == 0xFF)  # the second byte of a marker, or a stuffed zero
    keep = ~drop
    kept_before = np.cumsum(keep) - keep
    starts = np.concatenate(([0], kept_before[np.flatnonzero(mark)]))[:-1]
    return np.concatenate((raw[keep], np.zeros(8, np.uint8))), starts


def decode_many(frames: list[Frame]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each frame: one sample (0 to 255) for each 8 x 8 block."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, f in enumerate(frames):
        groups[(f.blocks, f.interval or f.grid[0] * f.grid[1])].append(i)
    out: list[np.ndarray | None] = [None] * len(frames)
    for (blocks, interval), members in groups.items():
        data, starts = _lanes([frames[i].scan for i in members])
        mcus = np.array([frames[i].grid[0] * frames[i].grid[1] for i in members])
        per = -(-mcus // interval)
        of_lane = np.concatenate([np.minimum(interval, m - interval * np.arange(n)) for m, n in zip(mcus.tolist(), per.tolist())])
        luma = sum(b[0] == 0 for b in blocks)
        levels = np.zeros((len(starts), interval * luma), np.int32)
        bit = starts.astype(np.int64) * 8
        last = np.zeros((len({b[0] for b in blocks}), len(starts)), np.int32)

        def peek(at: np.ndarray, data: np.ndarray = data) -> np.ndarray:
            """The 32 bits at a place."""
            b = at >> 3
            w = (data[b].astype(np.int64) << 32) | (data[b + 1].astype(np.int64) << 24) | (data[b + 2].astype(np.int64) << 16) | (data[b + 3].astype(np.int64) << 8) | data[b + 4]
            return (w >> (8 - (at & 7))) & 0xFFFFFFFF

        for k in range(interval):
            live = np.flatnonzero(of_lane > k) if of_lane.min() <= k else slice(None)
            seen = 0
            for part, dc, ac in blocks:
                at = bit[live]
                ahead = peek(at)
                got = _table(dc)[ahead >> 16]
                size, used = got >> 5, got & 31
                if not used.all():
                    raise ValueError("a code that no table has")
                extra = (ahead >> (32 - used - size)) & ((1 << size) - 1)
                d = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
                last[part, live] += d.astype(np.int32)
                if part == 0:
                    levels[live, k * luma + seen] = last[part, live]
                    seen += 1
                at = at + used + size
                # the other coefficients are stepped over
                index, todo = np.ones(len(at), np.int64), np.arange(len(at))
                while len(todo):
                    got = _table(ac)[peek(at[todo]) >> 16]
                    symbol, used = got >> 5, got & 31
                    if not used.all():
                        raise ValueError("a code that no table has")
                    at[todo] += used + (symbol & 15)
                    index[todo] += (symbol >> 4) + 1
                    todo = todo[(symbol != 0) & (index[todo] < 64)]
                bit[live] = at
        lane = 0
        for i, n, m in zip(members, per.tolist(), mcus.tolist()):
            f = frames[i]
            h, v = f.sampling
            cells = levels[lane : lane + n].reshape(-1, luma)[:m].reshape(f.grid[1], f.grid[0], v, h)
            lane += n
            image = cells.transpose(0, 2, 1, 3).reshape(f.grid[1] * v, f.grid[0] * h)
            out[i] = np.clip(128 + np.floor_divide(image * f.step + 4, 8), 0, 255).astype(np.uint8)
    return out


def thumbnail_hashes(image: np.ndarray) -> tuple[str, str]:
    """64-bit average hash and 64-bit difference hash of a thumbnail at 8 x 8 and 8 x 9 cells, as hex."""
    def shrink(rows: int, columns: int) -> np.ndarray:
        total = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
        total[1:, 1:] = image.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
        r = np.arange(rows + 1) * image.shape[0] // rows
        c = np.arange(columns + 1) * image.shape[1] // columns
        area = np.maximum(np.diff(r)[:, None] * np.diff(c)[None, :], 1)
        corner = total[np.ix_(r, c)]
        return (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]) / area

    a, d = shrink(8, 8), shrink(8, 9)
    return np.packbits(a > a.mean()).tobytes().hex(), np.packbits(d[:, 1:] > d[:, :-1]).tobytes().hex()


COLUMNS_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = 2_000_000) -> DataFrame:
    """Stores each whole text as JPEG, reads it back and describes it; null text counts as empty (576 fill bytes).

    All values but doc_id depend on the text alone.  ``batch_bytes`` bounds the payloads worked on at once
    (one longer text makes a batch of its own).
    """

    def describe(ids: list[int], sizes: list[int], payloads: list[bytes]) -> pa.RecordBatch:
        blobs = encode_many(payloads)
        frames, owner = [], []
        for i, blob in enumerate(blobs):
            at = 0
            while at < len(blob):
                frame, at = parse(blob, at)
                frames.append(frame)
                owner.append(i)
        images: list[list[np.ndarray]] = [[] for _ in blobs]
        for i, image in zip(owner, decode_many(frames)):
            images[i].append(image)
        rows = []
        for doc, n, blob, parts in zip(ids, sizes, blobs, images):
            image = np.concatenate(parts)
            back = image.tobytes()
            mean, step = thumbnail_hashes(image)
            feature = f"{image.shape[1] * 8}x{image.shape[0] * 8};frames={len(parts)};ahash={mean};dhash={step}"
            rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in COLUMNS_OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, payloads, held = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                payload, n = padded(text.as_py())
                if held and held + len(payload) > batch_bytes:
                    yield describe(ids, sizes, payloads)
                    ids, sizes, payloads, held = [], [], [], 0
                ids.append(doc)
                sizes.append(n)
                payloads.append(payload)
                held += len(payload)
            if ids:
                yield describe(ids, sizes, payloads)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, COLUMNS_OUT)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as JPEG, read back and described."""
    return media_columns(table(spark, sf_dir, "documents"))
