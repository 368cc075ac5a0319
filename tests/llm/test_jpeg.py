import hashlib
import random
import zlib

import numpy as np
import pytest

from emberline.llm import jpeg
from tests.llm.helpers import corpus, docs


def payloads():
    rng = random.Random(4)
    made = [bytes(64), b"\x80" * 64, b"\xff" * 640, bytes(range(256)) * 3, b"a" * 64 * 97, bytes(64 * 9) + b"\x81" + b"\x80" * 63]
    made += [bytes(rng.choices([0x80] * 40 + list(range(256)), k=64 * rng.randrange(1, 60))) for _ in range(30)]
    return made + [rng.randbytes(64 * n) for n in (1, 2, 8, 63, 64, 65, 500)]


def test_round_trip():
    own = payloads()
    files = jpeg.encode(own)
    back = jpeg.decode(files)
    for p, f, (head, blocks) in zip(own, files, back, strict=True):
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        assert jpeg.payload(head, blocks) == p
        thumb = jpeg.thumbnail(head, blocks).reshape(-1)[: len(p) // 64]
        assert thumb.tolist() == list(p[::64])
    assert jpeg.encode(own[3:4]) == files[3:4]


def plain_decode(f):
    """A bit-by-bit reading of a one-component file."""
    head = jpeg.parse(f)
    (scan,) = head.scans
    _, _, _, dc, ac = scan.members[0]

    def codes(body):
        out, code, at = {}, 0, 16
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                out[n, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        return out

    tables, data, at = (codes(dc), codes(ac)), f, scan.start
    out, pred, bits, have = [], 0, 0, 0

    def bit():
        nonlocal at, bits, have
        if not have:
            bits, have = data[at], 8
            at += 2 if data[at] == 0xFF else 1
        have -= 1
        return bits >> have & 1

    def symbol(t):
        n = code = 0
        while (n, code) not in t:
            code, n = code << 1 | bit(), n + 1
            assert n < 17
        return t[n, code]

    def extra(s):
        v = 0
        for _ in range(s):
            v = v << 1 | bit()
        return v if not s or v >> (s - 1) else v - (1 << s) + 1

    for m in range(scan.across * scan.down):
        if scan.restart and m and m % scan.restart == 0:
            have, pred = 0, 0
            assert data[at] == 0xFF and data[at + 1] == 0xD0 + (m // scan.restart - 1) % 8
            at += 2
        block = [0] * 64
        pred += extra(symbol(tables[0]))
        block[0], k = pred, 1
        while k < 64:
            s = symbol(tables[1])
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                block[k] = extra(s & 15)
            k += 1
        out.append(block)
    return out


def test_against_a_bitwise_reader():
    for p in payloads()[:20]:
        f = jpeg.encode([p])[0]
        (_, blocks), = jpeg.decode([f])
        assert blocks[0].reshape(-1, 64).tolist() == plain_decode(f)


def colour_file():
    """Two MCUs of a 4:2:0 image without restart markers: per MCU four luminance blocks and one of each chrominance, DC only."""
    dc_body, code, size = jpeg._codes(dict.fromkeys(range(12), 4))
    ac_body, ac_code, ac_size = jpeg._codes({0: 1, 1: 2})
    bits, pred, want = "", [0, 0, 0], [[], [], []]
    rng = random.Random(1)
    for _ in range(2):
        for c in (0, 0, 0, 0, 1, 2):
            v = rng.randrange(-100, 100)
            d, pred[c] = v - pred[c], v
            want[c].append(v)
            n = abs(d).bit_length()
            bits += format(int(code[n]), "04b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + format(int(ac_code[0]), f"0{ac_size[0]}b")
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    s = jpeg._segment
    frame = s(0xC0, bytes([8, 0, 16, 0, 30, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    return b"".join([b"\xff\xd8", s(0xE0, b"JFIF\0"), s(0xDB, bytes([0] + [16] * 64 + [1] + [17] * 64)), frame, s(0xC4, b"\0" + dc_body + b"\x10" + ac_body), s(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])), scan, b"\xff\xd9"]), want


def test_subsampled_colour():
    f, want = colour_file()
    head, blocks = jpeg.decode([f, *jpeg.encode([b"a" * 64])])[0]
    assert (head.width, head.height) == (30, 16)
    y = blocks[0][:, :, 0]
    assert [y[0, 0], y[0, 1], y[1, 0], y[1, 1], y[0, 2], y[0, 3], y[1, 2], y[1, 3]] == want[0]
    assert blocks[1][0, :, 0].tolist() == want[1] and blocks[2][0, :, 0].tolist() == want[2]
    assert jpeg.thumbnail(head, blocks).shape == (2, 4)


def test_several_scans():
    """Each component of a 30x16 image in a scan of its own: blocks of the component alone, none of an MCU's padding."""
    dc_body, code, size = jpeg._codes(dict.fromkeys(range(12), 4))
    ac_body, ac_code, ac_size = jpeg._codes({0: 1, 1: 2})
    rng = random.Random(2)
    s = jpeg._segment
    frame = s(0xC0, bytes([8, 0, 16, 0, 30, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    f = [b"\xff\xd8", s(0xDB, bytes([0] + [16] * 64 + [1] + [17] * 64)), frame, s(0xC4, b"\0" + dc_body + b"\x10" + ac_body)]
    want = []
    for c, blocks in ((1, 8), (3, 2), (2, 2)):
        bits, pred, own = "", 0, []
        for _ in range(blocks):
            v = rng.randrange(-100, 100)
            d, pred = v - pred, v
            own.append(v)
            n = abs(d).bit_length()
            bits += format(int(code[n]), "04b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + format(int(ac_code[0]), f"0{ac_size[0]}b")
        bits += "1" * (-len(bits) % 8)
        want.append(own)
        f += [s(0xDA, bytes([1, c, 0, 0, 63, 0])), int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")]
    (head, blocks), = jpeg.decode([b"".join([*f, b"\xff\xd9"])])
    assert [x[:, :, 0].reshape(-1).tolist() for x in blocks] == [want[0], want[2], want[1]]
    assert blocks[0].shape == (2, 4, 64) and jpeg.thumbnail(head, blocks).shape == (2, 4)
    with pytest.raises(jpeg.JpegError):
        jpeg.decode([b"".join([*f[:-2], b"\xff\xd9"])])


def test_bad_images_stop_nothing(spark):
    rng = random.Random(3)
    good = jpeg.encode([rng.randbytes(6400), b"a" * 640])
    colour = colour_file()[0]
    files = [*good, colour, None, b"", b"GIF89a", b"\xff\xd8\xff\xc0\x00\x05\x08\x00", good[0][:700], colour[:40]]
    for f in (good[0], colour):
        for _ in range(150):  # bytes changed or cut out anywhere
            x, i = bytearray(f), rng.randrange(len(f))
            x[i : i + rng.randrange(3)] = rng.randbytes(rng.randrange(3))
            files.append(bytes(x))
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id int, media binary")
    got = {r.id: r for r in jpeg.read(rows).collect()}
    assert len(got) == len(files) and got[0].payload and got[1].payload and got[2].width == 30
    assert got[3].error is None and got[3].width is None
    assert all(got[i].error and got[i].thumbnail is None for i in range(4, 9))
    assert all((r.error is None) != (r.width is None) for i, r in got.items() if i != 3)


@pytest.mark.parametrize("bad", [b"", b"\xff\xd8", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00", b"GIF89a" + bytes(20)])
def test_other_bytes_raise(bad):
    with pytest.raises(jpeg.JpegError):
        jpeg.decode([bad])


def test_whole_table(spark, sf):
    want = {}
    for d, t in corpus(sf).items():
        raw = jpeg.pad(t or "")
        assert len(raw) % 64 == 0 and raw
        want[d] = (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    rows = jpeg.op2_baseline_jpeg(spark, sf).collect()
    assert {r.doc_id: tuple(r[1:5]) for r in rows} == want and len(rows) == len(want)
    one = rows[0]
    f = jpeg.encode([jpeg.pad(corpus(sf)[one.doc_id])])[0]
    assert (one.media_bytes, one.media_sha256) == (len(f), hashlib.sha256(f).hexdigest())


def test_odd_rows(spark):
    df = docs(spark, [(1, None), (1, ""), (None, "x" * 400_000), (3, "é" * 32)]).withColumnRenamed("lang", "width")
    stored = jpeg.store(df)
    rows = sorted((r.doc_id or 0, r.n_bytes, len(r.payload), r.width) for r in jpeg.read(stored).collect())
    assert [r[:3] for r in rows] == [(0, 400_000, 400_000), (1, 0, 64), (1, 0, 64), (3, 64, 64)]
    assert jpeg.read(spark.createDataFrame([(None,)], "media binary")).collect()[0].thumb_hash is None
    assert jpeg.read(jpeg.store(docs(spark, []))).count() == 0
