"""A baseline JPEG column: writing bytes as quantised coefficients, reading any baseline JPEG in numpy.

Payload bytes are stored without loss as the coefficients themselves: 64 bytes
make one 8x8 block, byte minus 128 (the format's level shift) is a coefficient
in zigzag order, and the quantiser steps are 8 for the mean of a block and 1
for the rest, so that the DC-only thumbnail has the first byte of each block as
its pixel. A comment marker holds the payload's length.

The reader knows nothing of that: it parses markers, Huffman-decodes the
baseline scans, one or several, of images with one to four components, sampling
factors and restart intervals, all restart intervals of a batch of images in
step, and returns coefficients, from which thumbnails are made.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, pieces_of, table, text_or_empty

#: Blocks between restart markers.
RESTART = 8
#: Bytes of text that are coded together.
BATCH = 1 << 20
#: Code lengths of the commonest AC symbols of text (no run, size 5, 4, 7, 6, 3); all others get 13 bits, all DC sizes 4.
AC_SHORT = {5: 1, 4: 2, 7: 3, 6: 4, 3: 5}
U = np.uint64


class JpegError(ValueError):
    """The bytes aren't a baseline JPEG that can be read."""


def _codes(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A DHT table's body, and code and length by symbol: canonical codes for symbols with these lengths."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    code = np.zeros(256, dtype=U)
    size = np.zeros(256, dtype=np.int64)
    now, last = 0, 0
    for s in symbols:
        now <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = now, last
        now += 1
    return bytes(counts) + bytes(symbols), code, size


_AC_SYMBOLS = [0x00, 0xF0, *((run << 4) | s for run in range(16) for s in range(1, 11))]
_DC_BODY, _DC_CODE, _DC_SIZE = _codes(dict.fromkeys(range(12), 4))
_AC_BODY, _AC_CODE, _AC_SIZE = _codes({s: 13 for s in _AC_SYMBOLS} | AC_SHORT)
#: Bits of the magnitudes 0 to 2047.
_BITS = np.array([x.bit_length() for x in range(2048)], dtype=np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = _segment(0xDB, bytes([0, 8]) + bytes([1] * 63)) + _segment(0xC4, b"\x00" + _DC_BODY) + _segment(0xC4, b"\x10" + _AC_BODY) + _segment(0xDD, struct.pack(">H", RESTART))
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a size symbol: v, or for negative v its ones' complement."""
    return np.where(v >= 0, v, v + (1 << size) - 1).astype(U)


def _grid(blocks: int) -> tuple[int, int]:
    """Blocks across and down for so many blocks, about square."""
    across = max(1, int(np.ceil(np.sqrt(blocks))))
    return across, -(-blocks // across)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One grayscale baseline JPEG for each payload, whose length is a positive multiple of 64."""
    if not payloads:
        return []
    shapes = [_grid(len(p) // 64) for p in payloads]
    full = [w * h for w, h in shapes]
    raw = b"".join(p.ljust(64 * n, b"\x80") for p, n in zip(payloads, full, strict=True))
    coef = (np.frombuffer(raw, dtype=np.uint8).astype(np.int64) - 128).reshape(-1, 64)
    n = len(coef)
    starts = np.cumsum([0, *full[:-1]])
    place = np.arange(n) - np.repeat(starts, full)
    fresh = place % RESTART == 0  # prediction starts anew
    dc = coef[:, 0].copy()
    dc[1:] -= np.where(fresh[1:], 0, coef[:-1, 0])
    size = _BITS[np.abs(dc)]
    # symbols: DC, AC with runs, end of block, in order of block and place
    rows, cols = np.nonzero(coef[:, 1:])
    cols += 1
    v = coef[rows, cols]
    before = np.where(np.r_[True, rows[1:] != rows[:-1]], 0, np.r_[0, cols[:-1]]) if len(rows) else cols
    gap = cols - before - 1
    ac_size = _BITS[np.abs(v)]
    symbol = ((gap & 15) << 4) | ac_size
    long_rows, long_at, long_n = rows[gap > 15], cols[gap > 15], gap[gap > 15] >> 4
    last = np.zeros(n, dtype=np.int64)
    np.maximum.at(last, rows, cols)
    ends = np.flatnonzero(last < 63)
    key = np.concatenate([np.arange(n) * 130, rows * 130 + 2 * cols + 1, np.repeat(long_rows * 130 + 2 * long_at, long_n), ends * 130 + 129])
    bits = np.concatenate([(_DC_CODE[size] << size.astype(U)) | _extra(dc, size), (_AC_CODE[symbol] << ac_size.astype(U)) | _extra(v, ac_size), np.full(long_n.sum(), _AC_CODE[0xF0]), np.full(len(ends), _AC_CODE[0])])
    width = np.concatenate([_DC_SIZE[size] + size, _AC_SIZE[symbol] + ac_size, np.full(long_n.sum(), _AC_SIZE[0xF0]), np.full(len(ends), _AC_SIZE[0])])
    order = np.argsort(key, kind="stable")
    key, bits, width = key[order], bits[order], width[order]
    # ones fill each restart interval up to a byte
    interval = np.cumsum(fresh) - 1
    of = interval[key // 130]
    total = np.bincount(of, weights=width).astype(np.int64)
    spare = -total % 8
    close = np.flatnonzero(np.r_[of[1:] != of[:-1], True])
    width = np.insert(width, close + 1, spare)
    bits = np.insert(bits, close + 1, ((1 << spare) - 1).astype(U))
    at = np.cumsum(width) - width
    # pack into words of 64 bits: in each, bits of different symbols don't meet, so that sums join them
    word, room = at >> 6, 64 - (at & 63) - width
    inside = np.where(room >= 0, bits << np.maximum(room, 0).astype(U), bits >> np.maximum(-room, 0).astype(U))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros(int(word[-1]) + 2, dtype=U)
    out[word[first]] = np.add.reduceat(inside, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] += bits[over] << (64 + room[over]).astype(U)
    size_of = (total + spare) >> 3
    data = out.astype(">u8").view(np.uint8)[: int(size_of.sum())]
    # a zero byte after each 0xFF, a restart marker after each interval but an image's last
    ff = data == 0xFF
    end = np.cumsum(size_of) - 1
    image = np.repeat(np.arange(len(payloads)), [-(-x // RESTART) for x in full])
    marked = np.r_[image[1:] == image[:-1], False]
    more = ff.astype(np.int64)
    more[end[marked]] += 2
    where = np.arange(len(data)) + np.cumsum(more) - more
    made = np.zeros(len(data) + int(more.sum()), dtype=np.uint8)
    made[where] = data
    number = np.arange(len(image)) - np.repeat(np.flatnonzero(np.r_[True, ~marked[:-1]]), np.bincount(image))
    marker = where[end[marked]] + 1 + ff[end[marked]]
    made[marker] = 0xFF
    made[marker + 1] = 0xD0 + number[marked] % 8
    stops = (where[end] + 1 + ff[end])[~marked]
    scans, files, begin = made.tobytes(), [], 0
    for p, (across, down), stop in zip(payloads, shapes, stops.tolist(), strict=True):
        frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + bytes([1, 0x11, 0]))
        files.append(b"".join([b"\xff\xd8", _segment(0xFE, b"payload " + str(len(p)).encode()), _TABLES, frame, _SCAN, scans[begin:stop], b"\xff\xd9"]))
        begin = stop
    return files


@dataclass
class Scan:
    """One scan: where its data lie, its restart interval, MCUs across and down, and by component its number in the frame, sampling and tables."""

    start: int
    stop: int
    restart: int
    across: int
    down: int
    members: list[tuple[int, int, int, bytes, bytes]]


@dataclass
class Parsed:
    """What an image's markers say."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    #: By component of the frame: horizontal and vertical sampling, quantiser.
    parts: list[tuple[int, int, int]] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)


#: A marker that ends a scan's data: none of a stuffed byte, a restart marker or a fill byte.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(data: bytes) -> Parsed:
    """The markers of a baseline JPEG, up to the scan in which its last component comes."""
    try:
        return _parsed(data)
    except (struct.error, IndexError, KeyError, ValueError) as e:
        raise e if isinstance(e, JpegError) else JpegError(f"a short or broken segment: {e!r}") from e


def _parsed(data: bytes) -> Parsed:
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    out, at, restart, tables = Parsed(), 2, 0, {}
    number: dict[int, int] = {}
    seen: set[int] = set()
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise JpegError(f"no marker at {at}")
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                if len(steps) < 64:
                    raise JpegError("a short quantiser")
                out.quant[body[0] & 15] = steps
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                k = 17 + sum(body[1:17])
                if len(body) < k or sum(c << (16 - i) for i, c in enumerate(body[1:17], 1)) > 1 << 16:
                    raise JpegError("a broken code table")
                tables[body[0]] = body[1:k]
                body = body[k:]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xC0:
            bits, out.height, out.width, count = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not out.height or not out.width or not 1 <= count <= 4:
                raise JpegError("not an 8-bit frame of 1 to 4 components with width and height")
            out.parts = []
            for i in range(count):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                if not 1 <= hv >> 4 <= 4 or not 1 <= hv & 15 <= 4:
                    raise JpegError("a sampling factor out of range")
                number[c] = i
                out.parts.append((hv >> 4, hv & 15, q) if count > 1 else (1, 1, q))
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise JpegError(f"not baseline: frame {marker:#x}")
        elif marker == 0xDA:
            stop = _MARKER.search(data, at)
            scan = _scan(out, [(number[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])], tables, restart, at, stop.start() if stop else len(data))
            if seen.intersection(m[0] for m in scan.members) or not scan.members:
                raise JpegError("a component comes twice, or none")
            out.scans.append(scan)
            seen.update(m[0] for m in scan.members)
            if len(seen) == len(out.parts):
                return out
            at = scan.stop
        elif marker == 0xD9:
            raise JpegError("a component has no scan")


def _scan(p: Parsed, own: list[tuple[int, int]], tables: dict[int, bytes], restart: int, start: int, stop: int) -> Scan:
    wide, high = max(x[0] for x in p.parts), max(x[1] for x in p.parts)
    if len(own) == 1:  # one component: its own blocks, none beyond the image
        i, t = own[0]
        h, v, _ = p.parts[i]
        across, down = -(-(-(-p.width * h // wide)) // 8), -(-(-(-p.height * v // high)) // 8)
        members = [(i, 1, 1, tables[t >> 4], tables[16 | (t & 15)])]
    else:
        across, down = -(-p.width // (8 * wide)), -(-p.height // (8 * high))
        members = [(i, *p.parts[i][:2], tables[t >> 4], tables[16 | (t & 15)]) for i, t in own]
    if across * down * sum(h * v for _, h, v, *_ in members) * 2 > 8 * (stop - start):
        raise JpegError("fewer than two bits a block")
    return Scan(start, stop, restart, across, down, members)


@functools.lru_cache(maxsize=64)
def _lookup(body: bytes) -> np.ndarray:
    """For 16 bits ahead: symbol and, times 256, code length; 0 where no code begins so."""
    out = np.zeros(1 << 16, dtype=np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = body[at] | n << 8
            code += 1
            at += 1
        code <<= 1
    return out


def decode(files: list[bytes]) -> list[tuple[Parsed, list[np.ndarray]]]:
    """Markers and, by component, quantised coefficients (blocks down, blocks across, 64 in zigzag order) of each file."""
    parsed = [parse(f) for f in files]
    plans: dict[tuple, list[tuple[int, Scan]]] = {}
    for i, p in enumerate(parsed):
        for scan in p.scans:
            plans.setdefault(tuple(m[1:] for m in scan.members), []).append((i, scan))
    out = [(p, [np.empty((0, 0, 64), np.int16)] * len(p.parts)) for p in parsed]
    for layout, own in plans.items():
        for (i, scan), blocks in zip(own, _scans([files[i] for i, _ in own], [scan for _, scan in own], layout), strict=True):
            for m, x in zip(scan.members, blocks, strict=True):
                out[i][1][m[0]] = x
    return out


def decode_each(files: list[bytes]) -> list[tuple[Parsed, list[np.ndarray]] | JpegError]:
    """decode(), with an error in the place of each file that can't be read."""
    try:
        return decode(files)
    except JpegError as e:
        if len(files) == 1:
            return [e]
        half = len(files) // 2
        return decode_each(files[:half]) + decode_each(files[half:])


def _scans(files: list[bytes], parsed: list[Scan], layout: tuple) -> list[list[np.ndarray]]:
    """Decodes scans with the same sampling and tables; each restart interval is a lane, and all lanes step together."""
    unit = [(c, k) for c, (h, v, *_) in enumerate(layout) for k in range(h * v)]  # blocks of an MCU, by component
    data = np.frombuffer(b"".join(f[p.start : p.stop] + b"\xff\xd9" for f, p in zip(files, parsed, strict=True)), dtype=np.uint8)
    base = np.cumsum([0, *(p.stop - p.start + 2 for p in parsed)])
    after = np.r_[data[1:], np.uint8(0)]
    ff = data == 0xFF
    stuffed = ff & (after == 0)
    restart = ff & (after >= 0xD0) & (after <= 0xD7)
    stop = np.flatnonzero(ff & (after == 0xD9))
    drop = np.r_[False, (stuffed | restart)[:-1]] | restart
    ends = stop[np.searchsorted(stop, base[:-1])]  # an image's scan ends with its first end-of-image marker
    clean = data[~drop]
    moved = np.cumsum(~drop) - ~drop
    marks = np.flatnonzero(restart)
    begins, lane_image, counts = [], [], []
    mcus = [p.across * p.down for p in parsed]
    mark_from, mark_to = np.searchsorted(marks, base[:-1]), np.searchsorted(marks, ends)
    for i, p in enumerate(parsed):
        own = np.r_[base[i], marks[mark_from[i] : mark_to[i]] + 2]
        step = p.restart or mcus[i]
        need = -(-mcus[i] // step)
        if len(own) < need:
            raise JpegError("restart markers are missing")
        begins.append(moved[own[:need]])
        lane_image.append(np.full(need, i))
        counts.append(np.minimum(step, mcus[i] - step * np.arange(need)))
    begin, count = np.concatenate(begins), np.concatenate(counts)
    lanes = len(begin)
    blocks = count * len(unit)
    offset = np.cumsum(blocks) - blocks
    coef = np.zeros((int(blocks.sum()), 64), dtype=np.int16)
    flat = coef.reshape(-1)
    padded = np.r_[clean, np.full(16, 0xFF, np.uint8)].astype(U)
    window = np.zeros(len(clean) + 8, dtype=U)  # 64 bits from each byte on
    for k in range(8):
        window |= padded[k : k + len(window)] << U(56 - 8 * k)
    lookups = np.concatenate([np.concatenate([_lookup(dc), _lookup(ac)]) for _, _, dc, ac in layout])
    table_of = np.array([c for c, _ in unit], dtype=np.int64) << 17
    pos = begin * 8
    block = offset.copy()
    final = offset + blocks
    k = np.zeros(lanes, dtype=np.int64)
    pred = np.zeros((lanes, len(layout)), dtype=np.int64)
    comp_of = np.array([c for c, _ in unit], dtype=np.int64)
    place = np.zeros(lanes, dtype=np.int64)  # block within the MCU
    lane = np.flatnonzero(block < final)
    pos, block, k, place, final = pos[lane], block[lane], k[lane], place[lane], final[lane]
    limit = 8 * len(clean)
    while len(lane):
        bits = window[np.minimum(pos >> 3, len(window) - 1)] << (pos & 7).astype(U)
        found = lookups[table_of[place] + ((k > 0).astype(np.int64) << 16) + (bits >> U(48)).astype(np.int64)]
        length, symbol = found >> 8, found & 255
        if not length.all() or (pos > limit).any():
            raise JpegError("a code that is in no table")
        size = symbol & 15
        run = symbol >> 4
        raw = ((bits << length.astype(U)) >> (63 - size).astype(U) >> U(1)).astype(np.int64)
        value = np.where(raw < (1 << size) >> 1, raw - (1 << size) + 1, raw)
        pos += length + size
        dc = k == 0
        if dc.any():
            d = np.flatnonzero(dc)
            c = comp_of[place[d]]
            pred[lane[d], c] += value[d]
            value[d] = pred[lane[d], c]
            run = np.where(dc, 0, run)
        end = ~dc & (symbol == 0)
        at = k + run
        put = dc | (size > 0)
        if (at[put] > 63).any():
            raise JpegError("a run goes past its block")
        flat[block[put] * 64 + at[put]] = value[put]
        k = np.where(end, 64, at + 1)
        full = k >= 64
        if full.any():
            k[full] = 0
            block[full] += 1
            place[full] += 1
            place[place == len(unit)] = 0
            live = block < final
            if not live.all():
                lane, pos, block, k, place, final = (x[live] for x in (lane, pos, block, k, place, final))
    out, row = [], 0
    for p, n in zip(parsed, mcus, strict=True):
        own = coef[row : row + n * len(unit)].reshape(n, len(unit), 64)
        row += n * len(unit)
        parts, col = [], 0
        for h, v, *_ in layout:
            mine = own[:, col : col + h * v].reshape(p.down, p.across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(p.down * v, p.across * h, 64)
            parts.append(mine)
            col += h * v
        out.append(parts)
    return out


def thumbnail(p: Parsed, blocks: list[np.ndarray]) -> np.ndarray:
    """The luminance of each 8x8 block from its DC coefficient alone, as bytes."""
    h, v, q = p.parts[0]
    if q not in p.quant:
        raise JpegError("no quantiser")
    mean = blocks[0][:, :, 0].astype(np.int64) * int(p.quant[q][0])
    across, down = -(-p.width * h // (8 * max(x[0] for x in p.parts))), -(-p.height * v // (8 * max(x[1] for x in p.parts)))
    return np.clip((mean + 4 >> 3) + 128, 0, 255).astype(np.uint8)[:down, :across]


def difference_hash(thumb: np.ndarray) -> str:
    """64 bits: on an 8x9 grid of nearest pixels, whether each is darker than its right neighbour."""
    rows = np.arange(8) * thumb.shape[0] // 8
    cols = np.arange(9) * thumb.shape[1] // 9
    grid = thumb[rows][:, cols]
    return np.packbits(grid[:, :-1] < grid[:, 1:]).tobytes().hex()


def payload(p: Parsed, blocks: list[np.ndarray]) -> bytes | None:
    """The payload that encode() stored, or None in other images."""
    said = re.fullmatch(rb"payload ([0-9]{1,10})", p.comment)
    if not said or int(said[1]) > blocks[0].size:
        return None
    n = int(said[1])
    return (blocks[0].reshape(-1)[:n] + 128).astype(np.uint8).tobytes()


def pad(text: str, unit: int = 64) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a baseline JPEG that holds the row's text without loss.

    Null text counts as empty and is stored as 64 zero bytes. Every row gives a
    row, repeated rows and null doc_ids too; an empty table gives none. A very long
    text is one image of up to 65,535 by 65,535 pixels, coded at once: some
    hundred bytes of memory for each of its own. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces_of(whole, budget=BATCH)):
            raw = [pad(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(encode(raw), pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = "width int, height int, thumb_width int, thumb_height int, thumbnail binary, thumb_hash string, payload binary, error string"


def read(media: DataFrame) -> DataFrame:
    """The columns of media (one of them `media`, baseline JPEGs) and dimensions, DC-only thumbnail, its hash, the payload if there is one, and error.

    Null media gives nulls; bytes that can't be read as a baseline JPEG give
    nulls and say why in error, and stop nothing else. Repeated rows stay; an
    empty table gives no rows. Columns of media named like a new one are replaced.
    """
    names = [x.split()[0] for x in READ.split(", ")]
    own = [c for c in media.columns if c not in names]
    kept = media.select(*[named(c).alias(f"c{i}") for i, c in enumerate(own)])
    at = own.index("media")

    def one(found: tuple[Parsed, list[np.ndarray]] | JpegError) -> tuple:
        try:
            if isinstance(found, JpegError):
                raise found
            p, blocks = found
            thumb = thumbnail(p, blocks)
        except JpegError as e:
            return (*[None] * (len(names) - 1), str(e))
        mark = f"{difference_hash(thumb)}-{zlib.crc32(thumb.tobytes()):08x}"
        return p.width, p.height, thumb.shape[1], thumb.shape[0], thumb.tobytes(), mark, payload(p, blocks), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces_of(whole, f"c{at}", budget=BATCH)):
            files = batch.column(at).to_pylist()
            real = iter([one(x) for x in decode_each([f for f in files if f is not None])])
            rows = [(None,) * len(names) if f is None else next(real) for f in files]
            kinds = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.binary(), pa.string()]
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([*batch.columns, *new], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields] + [READ])).toDF(*own, *names)


def op2_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(store(table(spark, sf_dir, "documents")))
    size = F.octet_length("payload")
    return seen.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), F.concat_ws("x", "thumb_width", "thumb_height"), "thumb_hash").alias("feature"),
    )
