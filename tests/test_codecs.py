"""Codecs against planted pixels: the files are made here, by writers of their own."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.operators import render
from grainline.sources import exif, fonts, images, jpeg, tiff, webp


def picture(h=37, w=53, seed=1):
    y, x = np.mgrid[:h, :w]
    a = np.stack([x * 4 % 256, y * 6 % 256, (x + y) * 3 % 256], -1)
    a[5:12, 7:30] = (200, 30, 90)
    a[20:] += np.random.default_rng(seed).integers(0, 3, a[20:].shape)
    return np.clip(a, 0, 255).astype(np.uint8)


# JPEG ---------------------------------------------------------------------------------------------------------


def test_jpeg_files_decode(spark, tmp_path):
    y, x = np.mgrid[:203, :317]
    smooth = np.stack([127 + 100 * np.sin(x / 30), 127 + 100 * np.cos(y / 25), 127 + 90 * np.sin((x + y) / 40)], -1).astype(np.uint8)
    known = {"smooth": smooth, "dot": np.full((1, 1, 3), 200, np.uint8), "flat": np.full((40, 41, 3), 77, np.uint8), "noise": np.random.default_rng(0).integers(0, 256, (30, 30, 3)).astype(np.uint8)}
    for name, a in known.items():
        for q in (75, 88, 92, 100):
            (tmp_path / f"{name}-{q}.jpg").write_bytes(jpeg.encode(a, q))
    got = images.decode(spark, str(tmp_path)).collect()
    assert len(got) == 16 and not [r for r in got if r["error"]]
    for r in got:
        name, q = r["path"].rsplit("/", 1)[1][:-4].split("-")
        a = known[name]
        back = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
        assert back.shape == a.shape
        error = np.abs(back.astype(int) - a).mean()
        assert error <= {"smooth": {"75": 1.6, "88": 1.2, "92": 1.0, "100": 0.6}, "noise": {"75": 40, "88": 20, "92": 12, "100": 1}}.get(name, {}).get(q, 1)
    sizes = [len(jpeg.encode(smooth, q)) for q in (30, 75, 92, 100)]
    assert sizes == sorted(sizes) and sizes[-1] < smooth.size


def test_jpeg_bands_and_bounds(monkeypatch):
    a = picture(64, 200)
    whole = jpeg.encode(a, 90)
    monkeypatch.setattr(jpeg, "BAND", 25)  # a row of blocks at a time
    assert jpeg.encode(a, 90) == whole
    for shape in ((0, 3, 3), (3, 0, 3), (1, 70_000, 3)):
        with pytest.raises(ValueError):
            jpeg.encode(np.zeros(shape, np.uint8))
    bits = jpeg.code_lengths(np.array([2**k for k in range(30)]))
    assert bits.max() == 16 and sum(2.0**-b for b in bits) < 1  # one code of all ones is left
    assert jpeg.zigzag()[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(jpeg.zigzag()) == list(range(64))


def test_jpeg_columns(spark):
    a = picture()
    d = spark.createDataFrame([(1, 53, 37, bytearray(a.tobytes())), (2, 0, 0, None)], "image_id long, width int, height int, data binary")
    rows = d.select("image_id", images.data_uri(images.encode_jpeg("width", "height", "data", 88)).alias("uri")).orderBy("image_id").collect()
    import base64

    assert rows[0]["uri"].startswith("data:image/jpeg;base64,") and base64.b64decode(rows[0]["uri"].split(",")[1]) == jpeg.encode(a, 88) and rows[1]["uri"] == ""
    small = render.encoded(d, edge=20, quality=75).orderBy("image_id").collect()
    assert struct.unpack(">HH", small[0]["jpeg"][small[0]["jpeg"].index(b"\xff\xc0") + 5 :][:4]) == (14, 20) and small[1]["jpeg"] is None


# TIFF ---------------------------------------------------------------------------------------------------------


def ifd(order, entries, at):
    """A directory at ``at``: (tag, kind, values); and what its large values take after it."""
    letters = {1: "B", 2: "s", 3: "H", 4: "I", 5: "I", 10: "i", 7: "B"}
    body, extra = struct.pack(order + "H", len(entries)), b""
    rest = at + 2 + 12 * len(entries) + 4
    for tag, kind, values in sorted(entries):
        raw = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{letters[kind]}", *values)
        n = len(raw) if kind in (2, 7, 1) else len(values) // (2 if kind in (5, 10) else 1)
        if len(raw) > 4:
            body += struct.pack(order + "HHII", tag, kind, n, rest + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            body += struct.pack(order + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
    return body + struct.pack(order + "I", 0) + extra


def tiff_file(order, entries, parts, offsets, sizes):
    """A file of one directory; parts follow the header."""
    at, places, body = 8, [], b""
    for p in parts:
        places.append(at + len(body))
        body += p + b"\0" * (len(p) % 2)
    entries = [*entries, (offsets, 4, places), (sizes, 4, [len(p) for p in parts])]
    where = at + len(body)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, where) + body + ifd(order, entries, where)


def pack_lzw(data):
    out, bits, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)

    words, width, w = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in words:
            w += c
            continue
        put(words[w], width)
        words[w + c] = len(words) + 2
        if len(words) + 2 == (1 << width):
            width += 1
        if len(words) + 2 >= 4094:
            put(256, width)
            words, width = {bytes([i]): i for i in range(256)}, 9
        w = c
    if w:
        put(words[w], width)
        if len(words) + 3 >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def pack_bits(data):
    out = bytearray()
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        if len(set(part)) == 1:
            out += bytes([257 - len(part) & 255, part[0]]) if len(part) > 1 else bytes([0, part[0]])
        else:
            out += bytes([len(part) - 1]) + part
    return bytes(out)


PACKERS = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}


def make_tiff(a, order="<", compression=1, predictor=1, tile=None, planar=1, strip=10, bits=8, photometric=2, palette=None):
    """a: height x width x samples."""
    h, w, n = a.shape
    planes = [a] if planar == 1 else [a[..., i : i + 1] for i in range(n)]
    parts = []
    for p in planes:
        if tile:
            cut = [np.pad(p, [(0, -h % tile), (0, -w % tile), (0, 0)])[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            cut = [p[y : y + strip] for y in range(0, h, strip)]
        for c in cut:
            c = c.astype(np.int64)
            if predictor == 2:
                c[:, 1:] = c[:, 1:] - c[:, :-1] & (1 << bits) - 1
            flat = c.reshape(len(c), -1)
            if bits == 16:
                raw = flat.astype(order + "u2").tobytes()
            elif bits == 8:
                raw = flat.astype(np.uint8).tobytes()
            else:
                raw = np.packbits((flat[..., None] >> np.arange(bits - 1, -1, -1) & 1).reshape(len(c), -1).astype(np.uint8), axis=1).tobytes()
            parts.append(PACKERS[compression](raw))
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * n), (259, 3, [compression]), (262, 3, [photometric]), (277, 3, [n]), (284, 3, [planar]), (317, 3, [predictor])]
    if palette is not None:
        entries.append((320, 3, palette))
    entries += [(322, 3, [tile]), (323, 3, [tile])] if tile else [(278, 4, [strip])]
    return tiff_file(order, entries, parts, *((324, 325) if tile else (273, 279)))


@pytest.mark.parametrize("compression", PACKERS)
@pytest.mark.parametrize("more", [{}, {"predictor": 2}, {"tile": 16, "order": ">"}, {"planar": 2, "predictor": 2}])
def test_tiff_pixels(compression, more):
    a = picture(90, 80)
    assert (tiff.decode(make_tiff(a, compression=compression, **more)) == a).all()


def test_tiff_kinds():
    a, g = picture(), picture()[..., :1]
    deep = a.astype(np.uint16) * 257
    for order in "<>":
        assert (tiff.decode(make_tiff(deep, order, bits=16, predictor=2)) == a).all()
    assert (tiff.decode(make_tiff(np.concatenate([a, g], 2), compression=8)) == a).all()  # alpha falls away
    assert (tiff.decode(make_tiff(g, photometric=1)) == np.repeat(g, 3, 2)).all() and (tiff.decode(make_tiff(g, photometric=0)) == 255 - np.repeat(g, 3, 2)).all()
    one = (g > 100).astype(np.uint8)
    assert (tiff.decode(make_tiff(one, bits=1, photometric=1)) == 255 * np.repeat(one, 3, 2)).all()
    colours = [(i * 4099) % 65536 for i in range(48)]
    got = tiff.decode(make_tiff(g // 16, bits=4, photometric=3, palette=colours))
    assert (got == np.rint(np.reshape(colours, (3, 16)).T[g[..., 0] // 16] / 257)).all()
    for bad in (make_tiff(a)[:2000] + make_tiff(a)[-100:], make_tiff(a, compression=8)[:-300], b"II*\0", b"nothing at all", make_tiff(a).replace(struct.pack("<HHII", 259, 3, 1, 1), struct.pack("<HHII", 259, 3, 1, 7))):
        with pytest.raises(ValueError):
            images.decode_bytes(bad, False)


# camera files -------------------------------------------------------------------------------------------------


def pack_lossless(m, components=2, predictor=1):
    """A lossless JPEG stream of a mosaic, its columns dealt to components; codes of five bits for every size."""
    h, w = m.shape
    bits, held, out = 0, 0, bytearray()
    before = [1 << 15] * components

    def put(x, n):
        nonlocal bits, held
        bits, held = bits << n | x, held + n
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
            if out[-1] == 255:
                out.append(0)

    v = m.astype(int).tolist()
    for y in range(h):
        for x in range(w):
            if x < components:
                p = v[y - 1][x] if y else before[0]
            elif not y or predictor == 1:
                p = v[y][x - components]
            else:
                a, b, c = v[y][x - components], v[y - 1][x], v[y - 1][x - components]
                p = [0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1][predictor]
            d = (v[y][x] - p + 32768) % 65536 - 32768
            n = abs(d).bit_length() if d != -32768 else 16
            put(n, 5)
            if n and n < 16:
                put(d if d > 0 else d + (1 << n) - 1, n)
    if held:
        put((1 << 8 - held) - 1, 8 - held)
    part = lambda k, b: bytes([255, k]) + struct.pack(">H", len(b) + 2) + b
    table = bytes([0]) + bytes([0, 0, 0, 0, 17] + [0] * 11) + bytes(range(17))
    frame = struct.pack(">BHHB", 16, h, w // components, components) + b"".join(bytes([i, 0x11, 0]) for i in range(components))
    scan = bytes([components]) + b"".join(bytes([i, 0]) for i in range(components)) + bytes([predictor, 0, 0])
    return b"\xff\xd8" + part(0xC4, table) + part(0xC3, frame) + part(0xDA, scan) + bytes(out) + b"\xff\xd9"


def make_dng(m, bits=16, order="<", lossless=None, tile=None, extra=()):
    h, w = m.shape
    cut = [m] if not tile else [np.pad(m, [(0, -h % tile), (0, -w % tile)])[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
    parts = []
    for c in cut:
        if lossless:
            parts.append(pack_lossless(c, *lossless))
        elif bits == 16:
            parts.append(c.astype(order + "u2").tobytes())
        else:
            parts.append(np.packbits((c.astype(int)[..., None] >> np.arange(bits - 1, -1, -1) & 1).reshape(len(c), -1).astype(np.uint8), axis=1).tobytes())
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits]), (259, 3, [7 if lossless else 1]), (262, 3, [32803]), (277, 3, [1]), (33421, 3, [2, 2]), (33422, 1, bytes([0, 1, 1, 2])), *extra]
    entries += [(322, 4, [tile]), (323, 4, [tile])] if tile else [(278, 4, [h])]
    return tiff_file(order, entries, parts, *((324, 325) if tile else (273, 279)))


@pytest.mark.parametrize("bits", [8, 10, 12, 14, 16])
@pytest.mark.parametrize("order", "<>")
def test_camera_mosaics_of_every_packing(bits, order):
    m = np.random.default_rng(bits).integers(0, 1 << bits, (22, 26))
    for tile in (None, 16):
        assert (tiff.mosaic(make_dng(m, bits, order, tile=tile))[0] == m).all()


@pytest.mark.parametrize("predictor", range(1, 8))
def test_camera_mosaics_of_lossless_jpeg(predictor):
    m = np.random.default_rng(predictor).integers(0, 1 << 16, (20, 24))
    m[3, 5] = m[2, 5] ^ 0x8000
    for components in (1, 2):
        assert (tiff.mosaic(make_dng(m, lossless=(components, predictor)))[0] == m).all()
    assert (tiff.mosaic(make_dng(m, lossless=(2, predictor), tile=16))[0] == m).all()


def test_camera_files_develop(spark, tmp_path):
    """A flat scene keeps its colour through black and white levels, balance, demosaic and gamma."""
    linear, black, white, neutral = np.array([0.2, 0.4, 0.1]), 256, 4000, np.array([0.5, 1.0, 0.625])
    m = np.empty((20, 30))
    for (y, x), c in {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 2}.items():
        m[y::2, x::2] = black + (white - black) * linear[c] * neutral[c]
    extra = [(50714, 4, [black]), (50717, 4, [white]), (50728, 5, [5, 10, 10, 10, 625, 1000])]
    raw = make_dng(np.rint(m).astype(int), 12, extra=extra)
    a = tiff.develop(raw)
    want = 255 * (1.055 * linear ** (1 / 2.4) - 0.055)
    assert a.shape == (20, 30, 3) and np.abs(a - want).max() <= 1
    # a matrix from XYZ to sRGB itself changes nothing
    xyz = np.linalg.inv(np.linalg.inv(np.array(tiff.RGB_OF_XYZ)))
    numbers = [int(v) for x in (xyz * 10_000).round().ravel() for v in (x, 10_000)]
    assert np.abs(tiff.develop(make_dng(np.rint(m).astype(int), 12, extra=[*extra, (50721, 10, numbers)])) - want).max() <= 2
    for name, body in {"a.dng": raw, "b.NEF": raw, "cut.dng": raw[:300], "c.cr2": make_dng(np.rint(m).astype(int), 12).replace(struct.pack("<HHII", 259, 3, 1, 1), struct.pack("<HHII", 259, 3, 1, 34713)), "d.tif": make_tiff(picture()), "e.webp": b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0"}.items():
        (tmp_path / name).write_bytes(body)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.decode(spark, str(tmp_path)).collect()}
    assert {n: r["error"] is None for n, r in rows.items()} == {"a.dng": True, "b.NEF": True, "cut.dng": False, "c.cr2": False, "d.tif": True, "e.webp": False}
    assert bytes(rows["d.tif"]["data"]) == picture().tobytes() and (rows["a.dng"]["width"], rows["a.dng"]["height"]) == (30, 20)
    assert all(r["data"] is None and r["width"] == 0 for r in rows.values() if r["error"])


# WebP ---------------------------------------------------------------------------------------------------------


class Writer:
    def __init__(self):
        self.bits, self.n = 0, 0

    def put(self, x, n):
        self.bits |= x << self.n
        self.n += n

    def code(self, lengths):
        """A prefix code whose symbols all have one length but for what is left out: written by code lengths of their own."""
        self.put(0, 1)
        # lengths of the code of lengths: two literals and the runs, two bits each
        used = {0: 2, max(lengths): 2, 17: 2, 18: 2}
        self.put(19 - 4, 4)
        for s in webp.LENGTH_ORDER:
            self.put(used.get(s, 0), 3)
        self.put(0, 1)
        order = sorted(used)
        for n in lengths:
            self.put(int(f"{order.index(n):02b}"[::-1], 2), 2)

    def symbol(self, lengths, s):
        at = sorted(i for i, n in enumerate(lengths) if n).index(s)
        self.put(int(f"{at:0{max(lengths)}b}"[::-1], 2), max(lengths))

    def one(self, s):
        """A code of a lone symbol."""
        self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(s, 8)


FULL = [8] * 256


def put_pixels(w, argb, main, cache=0, groups=None, refs=()):
    """Literals of all pixels (rows of four), but for ``refs``: place -> (length, back) or the cache's index."""
    w.put(1 if cache else 0, 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(1 if groups else 0, 1)
        if groups:
            step, choice = groups
            w.put(step - 2, 3)
            put_pixels(w, [(0, 0, c, 0) for c in choice], False)
    # where more symbols are needed, they take the codes of greens that no pixel has
    extra = bool(refs) or cache
    green = [8] * 256 + [0] * (24 + ((1 << cache) if cache else 0))
    if extra:
        for s in UNUSED:
            green[s] = 0
        for k in range(len(UNUSED)):
            green[256 + MORE[k]] = 8
    for _ in range(max(groups[1]) + 1 if groups else 1):
        w.code(green)
        for _ in range(3):
            w.code(FULL)
        w.one(0) if not refs else w.code(FARS)
    i, held = 0, dict(refs)
    while i < len(argb):
        if i in held and isinstance(held[i], tuple):
            length, back = held[i]
            w.symbol(green, 256 + length - 1)  # lengths up to four are prefixes of their own
            w.symbol(FARS, back)
            i += length
        elif i in held:
            w.symbol(green, 280 + held[i])
            i += 1
        else:
            a, r, g, b = (int(x) for x in argb[i])
            w.symbol(green, g), w.symbol(FULL, r), w.symbol(FULL, b), w.symbol(FULL, a)
            i += 1


#: Greens that the test images leave out, the lengths (1 to 4) and cache places that take their codes, and distances 1 to 4.
UNUSED = (1, 3, 5, 7, 9, 11, 13, 15)
MORE = (0, 1, 2, 3, 24, 25, 26, 27)
FARS = [2] * 4 + [0] * 36


def webp_file(w, width, height):
    head = Writer()
    head.put(width - 1, 14), head.put(height - 1, 14), head.put(0, 1), head.put(0, 3)
    bits, n = head.bits | w.bits << head.n, head.n + w.n
    body = b"\x2f" + bits.to_bytes(-(-n // 8), "little")
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def argb(a):
    return np.concatenate([np.full((*a.shape[:2], 1), 255, int), a.astype(int)], 2)


def test_webp_literals_and_groups():
    a = picture(19, 23)
    w = Writer()
    w.put(0, 1)
    put_pixels(w, argb(a).reshape(-1, 4), True)
    assert (webp.decode(webp_file(w, 23, 19)) == a).all()
    w = Writer()
    w.put(0, 1)
    put_pixels(w, argb(a).reshape(-1, 4), True, groups=(3, [i % 2 for i in range(9)]))
    assert (webp.decode(webp_file(w, 23, 19)) == a).all()
    with pytest.raises(ValueError):
        webp.decode(webp_file(w, 23, 19)[:200])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF" + b"\0" * 40)


def test_webp_backward_references_and_cache():
    a = picture(12, 16) // 16 * 16
    flat = argb(a).reshape(-1, 4)
    # distances: the short codes are above, left, left of above, right of above
    flat[40:43], flat[60], flat[65:69], flat[101:103] = flat[24:27], flat[59], flat[48:52], flat[86:88]
    w = Writer()
    w.put(0, 1)
    put_pixels(w, flat, True, cache=2, refs={40: (3, 0), 60: (1, 1), 65: (4, 2), 101: (2, 3)})
    assert (webp.decode(webp_file(w, 16, 12)) == flat[:, 1:].reshape(12, 16, 3)).all()
    # a run of one colour from its place in the cache
    flat[91:101] = flat[90]
    key = (webp.HASH * int(sum(int(x) << 24 - 8 * i for i, x in enumerate(flat[90]))) & 0xFFFFFFFF) >> 30
    w = Writer()
    w.put(0, 1)
    put_pixels(w, flat, True, cache=2, refs={40: (3, 0), **dict.fromkeys(range(91, 101), key)})
    assert (webp.decode(webp_file(w, 16, 12)) == flat[:, 1:].reshape(12, 16, 3)).all()


def forward_predict(p, modes, step):
    """Residuals of pixels, the prediction written out once more."""
    h, w = p.shape[:2]
    flat, out = p.reshape(-1, 4), np.zeros((h * w, 4), int)
    for i in range(h * w):
        y, x = divmod(i, w)
        if i == 0:
            q = np.array([255, 0, 0, 0])
        elif y == 0:
            q = flat[i - 1]
        elif x == 0:
            q = flat[i - w]
        else:
            L, T, TL, TR = flat[i - 1], flat[i - w], flat[i - w - 1], flat[i - w + 1]
            m = modes[y >> step][x >> step]
            select = L if np.abs(T - TL).sum() < np.abs(L - TL).sum() else T
            half = (L + T) // 2
            q = [np.array([255, 0, 0, 0]), L, T, TR, TL, ((L + TR) // 2 + T) // 2, (L + TL) // 2, (L + T) // 2, (TL + T) // 2, (T + TR) // 2, ((L + TL) // 2 + (T + TR) // 2) // 2, select, np.clip(L + T - TL, 0, 255), np.clip(half + np.trunc((half - TL) / 2).astype(int), 0, 255)][m]
        out[i] = flat[i] - q & 255
    return out


def test_webp_transforms():
    a = picture(21, 18)
    p, step = argb(a), 2
    rows, across = 6, 5
    modes = np.arange(rows * across).reshape(rows, across) % 14
    # colour, then green, then prediction, undone in the opposite order
    rng = np.random.default_rng(3)
    e = rng.integers(0, 256, (rows, across, 4))
    sign = lambda x: (x + 128 & 255) - 128
    q = p.copy()
    q[..., 1], q[..., 3] = p[..., 1] - p[..., 2] & 255, p[..., 3] - p[..., 2] & 255
    wide = np.repeat(np.repeat(e, 4, 0), 4, 1)[:21, :18]
    g, r = sign(q[..., 2]), sign(q[..., 1])
    c = q.copy()
    c[..., 1] = q[..., 1] - (sign(wide[..., 3]) * g >> 5) & 255
    c[..., 3] = q[..., 3] - (sign(wide[..., 2]) * g >> 5) - (sign(wide[..., 1]) * r >> 5) & 255
    w = Writer()
    w.put(1, 1), w.put(2, 2)
    w.put(1, 1), w.put(1, 2), w.put(step - 2, 3)
    put_pixels(w, e.reshape(-1, 4), False)
    w.put(1, 1), w.put(0, 2), w.put(step - 2, 3)
    put_pixels(w, [(255, 0, m, 0) for m in modes.ravel()], False)
    w.put(0, 1)
    put_pixels(w, forward_predict(c, modes, step), True)
    assert (webp.decode(webp_file(w, 18, 21)) == a).all()


@pytest.mark.parametrize("n,bits", [(2, 1), (4, 2), (11, 4), (40, 8)])
def test_webp_palettes(n, bits):
    rng = np.random.default_rng(n)
    colours = rng.integers(0, 256, (n, 4))
    index = rng.integers(0, n, (9, 13))
    per = 8 // bits
    packed = np.zeros((9, -(-13 // per)), int)
    for x in range(13):
        packed[:, x // per] |= index[:, x] << bits * (x % per)
    w = Writer()
    w.put(1, 1), w.put(3, 2), w.put(n - 1, 8)
    put_pixels(w, np.diff(colours, axis=0, prepend=np.zeros((1, 4), int)) & 255, False)
    w.put(0, 1)
    put_pixels(w, [(255, 0, v, 0) for v in packed.ravel()], True)
    assert (webp.decode(webp_file(w, 13, 9)) == colours[index][..., 1:]).all()


# EXIF ---------------------------------------------------------------------------------------------------------


def exif_block(order="<"):
    sub_at = 200
    first = ifd(order, [(0x0110, 2, b'Cam "X"\0'), (0x8769, 4, [sub_at])], 8)
    sub = ifd(order, [(0x829A, 5, [10, 1250]), (0x829D, 5, [28, 10]), (0x8827, 3, [400]), (0x9003, 2, b"2024:01:15 14:30:01\0"), (0x9291, 2, b"25\0"), (0x920A, 5, [50, 1]), (0xA434, 2, b"Lens\0")], sub_at)
    return ((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + first).ljust(sub_at, b"\0") + sub


def box(name, body):
    return struct.pack(">I4s", len(body) + 8, name) + body


def heif(block, method=0, version=1):
    infe = box(b"infe", bytes([2, 0, 0, 0]) + struct.pack(">HH4s", 7, 0, b"Exif") + b"\0")
    other = box(b"infe", bytes([2, 0, 0, 0]) + struct.pack(">HH4s", 1, 0, b"hvc1") + b"\0")
    iinf = box(b"iinf", bytes(4) + struct.pack(">H", 2) + other + infe)
    item = struct.pack(">I", 6) + exif.MARK + block
    cut = len(item) // 2

    def loc(at):
        out = bytes([version, 0, 0, 0, 0x44, 0x00]) + struct.pack(">H", 2)
        for number, parts in ((1, [(0, 1)]), (7, [(at, cut), (at + cut, len(item) - cut)])):
            out += struct.pack(">H", number) + (struct.pack(">H", method if number == 7 else 0) if version else b"") + struct.pack(">HH", 0, len(parts))
            out += b"".join(struct.pack(">II", *p) for p in parts)
        return box(b"iloc", out)

    head = box(b"ftyp", b"heic" + bytes(4) + b"mif1")
    if method:
        return head + box(b"meta", bytes(4) + iinf + loc(0) + box(b"idat", item))
    size = len(head) + len(box(b"meta", bytes(4) + iinf + loc(0)))
    return head + box(b"meta", bytes(4) + iinf + loc(size + 8)) + box(b"mdat", item)


def canon():
    whole = exif_block()
    sub = (b"II*\0" + struct.pack("<I", 8) + ifd("<", [(0x829A, 5, [10, 1250]), (0x829D, 5, [28, 10]), (0x8827, 3, [400]), (0x9003, 2, b"2024:01:15 14:30:01\0"), (0x9291, 2, b"25\0"), (0x920A, 5, [50, 1]), (0xA434, 2, b"Lens\0")], 8))
    first = b"II*\0" + struct.pack("<I", 8) + ifd("<", [(0x0110, 2, b'Cam "X"\0')], 8)
    assert len(whole) > len(sub)
    return box(b"ftyp", b"crx " + bytes(4)) + box(b"moov", box(b"uuid", exif.CANON + box(b"CMT1", first) + box(b"CMT2", sub)))


def containers():
    b = exif_block()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return {
        "a.jpg": b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(b) + 8) + exif.MARK + b + b"\xff\xda", "b.tif": b, "b2.nef": exif_block(">"),
        "c.png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"eXIf", b), "d.webp": b"RIFF" + struct.pack("<I", 4 + 12 + 8 + len(b)) + b"WEBP" + b"VP8X" + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(b)) + b,
        "e.dng": heif(b), "f.dng": heif(b, 1), "g.dng": heif(b, 0, 0), "h.cr3": canon(),
    }


def test_exif_in_every_container(spark, tmp_path):
    import datetime as dt

    for name, body in containers().items():
        (tmp_path / name).write_bytes(body)
        (tmp_path / f"bad-{name}").write_bytes(body[: len(body) // 3])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.with_exif(images.scan(spark, str(tmp_path))).collect()}
    for name in containers():
        r = rows[name]
        assert r["taken"] == dt.datetime(2024, 1, 15, 14, 30, 1, 250_000), name
        e = r["exif"]
        assert [e[k] for k in ("model", "lens", "iso", "aperture", "shutter", "focal", "error")] == ['"Cam \\"X\\""', '"Lens"', "400", "f/2.8", "1/125 s", "50 mm", None]
        assert rows[f"bad-{name}"]["taken"] is None and rows[f"bad-{name}"]["exif"]["error"], name


def test_exif_strings():
    t = {0x829A: ((3, 10),), 0x829D: ((4, 1),), 0x0110: (b"A\xe9\\\0B\0",), 0x9003: (b"\xff\0",), 0x8827: (100, 200), 0x920A: ((1, 0),)}
    assert exif.settings(t) == ['"A\\xe9\\\\", "B"', None, "100, 200", "f/4", "1/3.3333333333333335 s", None]
    assert exif.settings({0x829A: ((5, 2),)})[4] == "2.5 s" and exif.settings({0x829A: ((2, 1),)})[4] == "2 s"
    assert exif.text(t, 0x0110) is None and exif.text(t, 0x9003) is None and exif.text({1: (b" a \0b\0",)}, 1) == "a" and exif.text({1: (5,)}, 1) is None


# fonts --------------------------------------------------------------------------------------------------------


def make_font(places=True):
    """A font of 1000 units, ascent 800: A is a square of 100 to 500, B its copy moved up 100 and a hole, C a round of off-curve
    points only, space is empty."""

    def simple(contours):
        ends, points = [], []
        for c in contours:
            points += c
            ends.append(len(points) - 1)
        flags = bytes(1 if on else 0 for _, _, on in points)
        xs, ys = ([b - a for a, b in zip([0, *v], v)] for v in ([p[0] for p in points], [p[1] for p in points]))
        body = struct.pack(">hhhhh", len(contours), 0, 0, 0, 0) + struct.pack(f">{len(ends)}H", *ends) + b"\0\0" + flags
        return body + struct.pack(f">{len(xs)}h", *xs) + struct.pack(f">{len(ys)}h", *ys)

    square = lambda a, b, turn=1: [(a, a, True), (a, b, True), (b, b, True), (b, a, True)][::turn]
    r, k = 300, 300 * math.tan(math.pi / 8)
    ring = [(round(400 + x), round(400 + y), False) for x, y in ((r, k), (k, r), (-k, r), (-r, k), (-r, -k), (-k, -r), (k, -r), (r, -k))]
    composite = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHbb", 0x0002, 1, 0, 100)
    glyphs = [b"", simple([square(100, 500), ]), composite, simple([ring]), simple([square(100, 500), square(200, 400, -1)])]
    glyphs = [g + b"\0" * (-len(g) % 4) for g in glyphs]
    at = np.cumsum([0, *map(len, glyphs)]).tolist()
    loca = struct.pack(f">{len(at)}I", *at) if places else struct.pack(f">{len(at)}H", *[a // 2 for a in at])
    runs = [(ord("A"), ord("D"), 1), (0x1F600, 0x1F600, 3)]
    long = struct.pack(">HHIII", 12, 0, 16 + 12 * 2, 0, 2) + b"".join(struct.pack(">III", *x) for x in runs)
    ends, starts, shifts = [ord("D"), 0xFFFF], [ord("A"), 0xFFFF], [1 - ord("A") & 0xFFFF, 1]
    short = struct.pack(">7H", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">2H", *ends) + b"\0\0" + struct.pack(">2H", *starts) + struct.pack(">2H", *shifts) + struct.pack(">2H", 0, 0)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 10 if places else 1, 12) + (long if places else short)
    tables = {
        b"cmap": cmap, b"glyf": b"".join(glyphs), b"head": bytes(50) + struct.pack(">hh", int(places), 0), b"hhea": bytes(4) + struct.pack(">hh", 800, -200) + bytes(26) + struct.pack(">H", 2),
        b"hmtx": struct.pack(">HhHh", 250, 0, 600, 0) + bytes(6), b"loca": loca, b"maxp": struct.pack(">IH", 0x10000, 5),
    }
    head, body, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for name, t in tables.items():
        head += name + struct.pack(">III", 0, at + len(body), len(t))
        body += t + b"\0" * (-len(t) % 4)
    return head + body


@pytest.mark.parametrize("places", [True, False])
def test_fonts_and_coverage(places):
    f = fonts.Font(make_font(places))
    assert f.map(ord("A")) == 1 and f.map(ord("z")) == 0 and f.advance(0) == 250 and f.advance(3) == 600
    w, h, mask, left, top = fonts.text_mask(f, "A", 50)  # a unit is a twentieth of a pixel
    assert (w, h, left, top) == (30, 20, 5, 15) and mask.shape == (20, 20) and (mask == 1).all()
    assert fonts.text_mask(f, "B", 50)[4] == 10 and fonts.text_mask(f, "AB", 50)[:2] == (60, 20)
    assert fonts.text_mask(f, "C", 100)[2].sum() == pytest.approx(math.pi * 30**2, rel=0.02)
    hole = fonts.text_mask(f, "D", 50)[2]
    assert hole.sum() == pytest.approx(400 - 100) and hole[10, 10] == 0 and hole[1, 1] == 1
    assert fonts.text_mask(f, "A", 33)[2].sum() == pytest.approx((400 * 0.033) ** 2)  # edges inside pixels
    assert fonts.text_mask(f, " ", 50)[2].size == 0
    with pytest.raises(ValueError):
        fonts.Font(b"nothing")


def test_slanted_coverage_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(50):
        p = [tuple(x) for x in rng.uniform(0, 12, (3, 2))]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2
        mask = fonts.coverage([p], 12, 12)
        assert mask.sum() == pytest.approx(area, abs=1e-9)
        y, x = (np.mgrid[: 12 * 40, : 12 * 40] + 0.5) / 40
        side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0 for a, b in zip(p, p[1:] + p[:1])]
        inside = (side[0] == side[1]) & (side[1] == side[2])
        assert np.abs(inside.reshape(12, 40, 12, 40).mean((1, 3)) - mask).max() < 0.03


def test_text_watermark():
    f = fonts.Font(make_font())
    a = np.full((200, 300, 3), 100, np.uint8)
    mark = {"kind": "text", "text": " A ", "position": "topLeft", "opacity": 50, "size": 100}
    out = render.watermark(a, mark, font=f)  # a tenth of the height: 20 px, a unit is a fiftieth; margin 6
    assert (out[6 + 6 : 6 + 14, 6 + 2 : 6 + 10] == 178).all() and (out != 100).sum() == 64 * 3
    tiny = render.watermark(np.full((40, 60, 3), 0, np.uint8), mark | {"size": 0, "opacity": 100}, font=f)  # nine pixels at least
    assert tiny.astype(int).sum() / 3 / 255 == pytest.approx((400 * 0.009) ** 2, rel=0.02)
    assert render.watermark(a, mark | {"text": " "}, font=f) is a
    low = render.watermark(a, mark | {"position": "nowhere"}, font=f)  # bottom right: 12 px wide, 8 tall, the outline hangs from the ascent
    assert (np.argwhere(low[..., 0] != 100).min(0) == (200 - 8 - 6 + 6, 300 - 12 - 6 + 2)).all()
    edge = render.watermark(a[:10, :8], mark | {"size": 100, "position": "center"}, font=f)
    assert edge.shape == (10, 8, 3)
    with pytest.raises(ValueError, match="font"):
        render.watermark(a, mark)
