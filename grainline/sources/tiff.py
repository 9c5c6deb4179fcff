"""TIFF files: directories of tags, and pixels of strips or tiles; camera files that keep their mosaic in TIFF directories.

Pixels: 1 to 16 bits of gray, palette or RGB (alpha falls away), uncompressed, PackBits, LZW or deflate, with the
horizontal predictor. Camera files: a colour-filter mosaic of 8 to 16 bits, packed or lossless JPEG, in strips or tiles;
black and white levels, as-shot white balance, the camera's colour matrix, and a bilinear demosaic of our own.
Everything else raises ValueError, which makes the file an error row.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: struct letters of tag types by number.
KINDS = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, PALETTE, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SUBS, FORMAT = 317, 320, 322, 323, 324, 325, 330, 339
MOSAIC, LINEAR = 32803, 34892
PATTERN_SIZE, PATTERN, BLACK_SIZE, BLACK, WHITE, MATRIX, NEUTRAL, AREA = 33421, 33422, 50713, 50714, 50717, 50721, 50728, 50829
#: A damaged directory may claim any size; no photo has more pixels than this.
MOST_PIXELS = 1 << 30


def order_of(raw: bytes) -> str:
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] not in (42, 85, 0x4F52, 0x5352):
        raise ValueError("not a TIFF file")
    return order


def directory(raw: bytes, at: int, order: str, pairs: bool = False) -> tuple[dict[int, tuple], int]:
    """The tags of a directory, rationals as floats (or ``pairs``) and text as bytes, and where the next one is."""
    (n,) = struct.unpack_from(order + "H", raw, at)
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        letters = KINDS.get(kind)
        if letters is None:
            continue
        size = struct.calcsize("=" + letters) * count
        where = at + 10 + 12 * i
        if size > 4:
            (where,) = struct.unpack_from(order + "I", raw, where)
        if where + size > len(raw):
            raise ValueError(f"tag {tag} lies beyond the end of the file")
        if kind == 2:
            tags[tag] = (bytes(raw[where : where + count]),)
            continue
        v = struct.unpack_from(order + letters * count if len(letters) > 1 else f"{order}{count}{letters}", raw, where)
        both = zip(v[::2], v[1::2])
        tags[tag] = v if len(letters) == 1 else tuple(both) if pairs else tuple(a / b if b else 0.0 for a, b in both)
    at += 2 + 12 * n
    return tags, struct.unpack_from(order + "I", raw, at)[0] if at + 4 <= len(raw) else 0


def directories(raw: bytes) -> list[dict[int, tuple]]:
    """All directories, those of SubIFDs after their own; a chain that returns to itself ends."""
    order = order_of(raw)
    todo, seen, out = [struct.unpack_from(order + "I", raw, 4)[0]], set(), []
    while todo:
        at = todo.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        tags, after = directory(raw, at, order)
        out.append(tags)
        todo = [*tags.get(SUBS, ()), after, *todo]
    return out


def unpack_bits(body: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(body):
        n = body[i]
        if n < 128:
            out += body[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += body[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(body: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest first; one code early they grow."""
    bits, held, width, i = 0, 0, 9, 0
    words = [bytes([x]) for x in range(256)] + [b"", b""]
    out, last = bytearray(), None
    while True:
        while held < width:
            if i >= len(body):
                return bytes(out)
            bits, held, i = bits << 8 | body[i], held + 8, i + 1
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            del words[258:]
            width, last = 9, None
            continue
        if code < len(words):
            word = words[code]
        elif last is not None and code == len(words):
            word = last + last[:1]
        else:
            raise ValueError("damaged LZW data")
        if last is not None:
            words.append(last + word[:1])
        out += word
        last = word
        width = min(12, max(9, (len(words) + 1).bit_length()))


def inflate(body: bytes, compression: int) -> bytes:
    if compression == 1:
        return body
    if compression == 5:
        return unpack_lzw(body)
    if compression in (8, 32946):
        try:
            return zlib.decompress(body)
        except zlib.error as e:
            raise ValueError(str(e)) from None
    if compression == 32773:
        return unpack_bits(body)
    raise ValueError(f"TIFF compression {compression}")


def samples(body: bytes, rows: int, per_row: int, bits: int, order: str) -> np.ndarray:
    """rows x per_row numbers of so many bits, highest bit first; every row begins with a byte of its own."""
    stride = -(-per_row * bits // 8)
    if len(body) < stride * rows:
        raise ValueError("image data ends early")
    a = np.frombuffer(body, np.uint8, stride * rows).reshape(rows, stride)
    if bits == 8:
        return a
    if bits == 16:
        return a.view(order + "u2").astype(np.uint16)
    x = np.unpackbits(a, axis=1)[:, : per_row * bits].reshape(rows, per_row, bits).astype(np.uint16)
    return (x << np.arange(bits - 1, -1, -1, dtype=np.uint16)).sum(2, dtype=np.uint16)


def _parts(t: dict) -> list[tuple[int, int, int, int, int, int]]:
    """(plane, top, left, height, width, number) of a directory's strips or tiles."""
    w, h = t[WIDTH][0], t[HEIGHT][0]
    planes = t.get(SAMPLES, (1,))[0] if t.get(PLANAR, (1,))[0] == 2 else 1
    if not 0 < w * h <= MOST_PIXELS:
        raise ValueError(f"a TIFF image of {w} x {h} pixels")
    out = []
    if TILES in t:
        tw, th = t[TILE_WIDTH][0], t[TILE_HEIGHT][0]
        for p in range(planes):
            out += [(p, y, x, th, tw, len(out) + i) for i, (y, x) in enumerate((y, x) for y in range(0, h, th) for x in range(0, w, tw))]
        return out
    tall = min(t.get(STRIP_ROWS, (h,))[0], h)
    for p in range(planes):
        out += [(p, y, 0, min(tall, h - y), w, len(out) + i) for i, y in enumerate(range(0, h, tall))]
    return out


def _bodies(raw: bytes, t: dict):
    at, sizes = (t[TILES], t[TILE_BYTES]) if TILES in t else (t[STRIPS], t[STRIP_BYTES])
    for part in _parts(t):
        a, n = at[part[-1]], sizes[part[-1]]
        if a + n > len(raw):
            raise ValueError("image data ends early")
        yield part, raw[a : a + n]


def decode(raw: bytes) -> np.ndarray:
    """The first image as height x width x 3 bytes."""
    order, t = order_of(raw), directories(raw)[0]
    bits, n, kind = t.get(BITS, (1,)), t.get(SAMPLES, (1,))[0], t[PHOTOMETRIC][0]
    if len(set(bits)) > 1 or bits[0] not in (1, 2, 4, 8, 16) or t.get(FORMAT, (1,))[0] != 1 or kind > 3 or kind == 2 and (n < 3 or bits[0] < 8):
        raise ValueError(f"TIFF of photometric {kind}, {n} samples, bits {bits}")
    bits, split = bits[0], t.get(PLANAR, (1,))[0] == 2
    w, h, each = t[WIDTH][0], t[HEIGHT][0], 1 if split else n
    out = np.zeros((h, w, n), np.uint16 if bits == 16 else np.uint8)
    for (plane, y, x, ph, pw, _), body in _bodies(raw, t):
        a = samples(inflate(body, t.get(COMPRESSION, (1,))[0]), ph, pw * each, bits, order).reshape(ph, pw, each)
        if t.get(PREDICTOR, (1,))[0] == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        a = a[: h - y, : w - x]
        out[y : y + a.shape[0], x : x + a.shape[1], plane : plane + each] = a
    if kind == 3:
        table = np.array(t[PALETTE]).reshape(3, -1).T
        return np.rint(table[out[..., 0]] / 257).astype(np.uint8)
    out = out[..., :3] if kind == 2 else np.repeat(out[..., :1], 3, 2)
    most = (1 << bits) - 1
    out = out if bits == 8 else np.rint(out * (255.0 / most)).astype(np.uint8)
    return 255 - out if kind == 0 else out


# camera files -------------------------------------------------------------------------------------------------


def lossless_jpeg(raw: bytes) -> np.ndarray:
    """A lossless JPEG stream (all components in one scan) as rows x (columns * components), by its predictor."""
    at, codes, frame, scan = 2, {}, None, None
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    while scan is None:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("damaged JPEG stream")
        mark, n = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xC3:
            frame = body
        elif mark == 0xC4:
            while body:
                counts, symbols = body[1:17], body[17 : 17 + sum(body[1:17])]
                table, code, k = [(0, 0)] * 65_536, 0, 0
                for length in range(1, 17):
                    for _ in range(counts[length - 1]):
                        a = code << 16 - length
                        table[a : a + (1 << 16 - length)] = [(length, symbols[k])] * (1 << 16 - length)
                        code, k = code + 1, k + 1
                    code <<= 1
                codes[body[0]] = table
                body = body[17 + len(symbols) :]
        elif mark == 0xDA:
            scan = body
        elif mark in (0xC0, 0xC1, 0xC2, 0xDD):
            raise ValueError("JPEG stream of another kind")
    if frame is None or len(scan) < 4:
        raise ValueError("damaged JPEG stream")
    depth, h, w, n = struct.unpack(">BHHB", frame[:6])
    tables = [codes[scan[2 + 2 * i] >> 4] for i in range(n)]
    predictor, shift = scan[1 + 2 * n], scan[3 + 2 * n] & 15
    data = raw[at:].split(b"\xff\xd9")[0].replace(b"\xff\0", b"\xff") + b"\0" * 8
    out, bits, held, i, end = np.zeros((h, w * n), np.int64), 0, 0, 0, len(data)
    start, above = 1 << depth - shift - 1, [0] * (w * n)
    for y in range(h):
        row = [0] * (w * n)
        for x in range(w * n):
            while held < 40 and i < end:
                bits, held, i = (bits & (1 << held) - 1) << 8 | data[i], held + 8, i + 1
            length, size = tables[x % n][bits >> held - 16 & 65_535] if held >= 16 else (0, 0)
            if not length:
                raise ValueError("JPEG stream ends early")
            held -= length
            if size == 16:
                diff = 32_768
            elif size:
                held -= size
                diff = bits >> held & (1 << size) - 1
                if not diff >> size - 1:
                    diff -= (1 << size) - 1
            else:
                diff = 0
            if x < n:
                p = above[x] if y else start
            elif not y or predictor == 1:
                p = row[x - n]
            else:
                a, b, c = row[x - n], above[x], above[x - n]
                p = (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor]
            row[x] = p + diff & 65_535
        out[y], above = row, row
    return out << shift


def mosaic(raw: bytes) -> tuple[np.ndarray, dict, dict]:
    """The mosaic of the largest directory that holds one, its tags, and those of the first directory."""
    order, found = order_of(raw), directories(raw)
    own = [t for t in found if t.get(PHOTOMETRIC, (0,))[0] in (MOSAIC, LINEAR) and WIDTH in t and HEIGHT in t]
    if not own:
        raise ValueError("no camera mosaic that can be read")
    t = max(own, key=lambda t: t[WIDTH][0] * t[HEIGHT][0])
    kind, bits, n = t.get(COMPRESSION, (1,))[0], t.get(BITS, (16,))[0], t.get(SAMPLES, (1,))[0]
    if kind not in (1, 7) or not 8 <= bits <= 16:
        raise ValueError(f"camera file of compression {kind}, {bits} bits")
    w, h = t[WIDTH][0], t[HEIGHT][0]
    out = np.zeros((h, w * n), np.int64)
    for (_, y, x, ph, pw, _), body in _bodies(raw, t):
        a = samples(body, ph, pw * n, bits, order) if kind == 1 else lossless_jpeg(body)
        if a.size < ph * pw * n:
            raise ValueError(f"{a.size} samples, expected {ph * pw * n}")
        a = a.reshape(-1)[: ph * pw * n].reshape(ph, pw * n)[: h - y, : (w - x) * n]
        out[y : y + a.shape[0], x * n : x * n + a.shape[1]] = a
    return out.reshape(h, w, n) if n > 1 else out, t, found[0]


def demosaic(m: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """Bilinear: a missing colour is the mean of its known values in the 3 by 3 neighbourhood, by distance."""
    h, w = m.shape
    at = np.tile(pattern, (-(-h // pattern.shape[0]), -(-w // pattern.shape[1])))[:h, :w]
    out = np.empty((h, w, 3), np.float32)
    for c in range(3):
        known = (at == c).astype(np.float32)
        v, k = np.pad(m * known, 1), np.pad(known, 1)
        total, weight = np.zeros((h, w), np.float32), np.zeros((h, w), np.float32)
        for dy in range(3):
            for dx in range(3):
                share = (2 - abs(dy - 1)) * (2 - abs(dx - 1)) / 4
                total += share * v[dy : dy + h, dx : dx + w]
                weight += share * k[dy : dy + h, dx : dx + w]
        out[..., c] = np.where(known > 0, m, total / np.maximum(weight, 1e-6))
    return out


#: sRGB from XYZ of the standard's white.
RGB_OF_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def develop(raw: bytes) -> np.ndarray:
    """A camera file as height x width x 3 bytes of sRGB."""
    m, t, first = mosaic(raw)
    white = np.array(t.get(WHITE, ((1 << t.get(BITS, (16,))[0]) - 1,)), float)
    ph, pw = t.get(BLACK_SIZE, (1, 1))
    black = np.resize(np.array(t.get(BLACK, (0,)), float), (ph, pw))
    if m.ndim == 2:
        h, w = m.shape
        low = np.tile(black, (-(-h // ph), -(-w // pw)))[:h, :w]
        pattern = np.array(t.get(PATTERN, (0, 1, 1, 2))).reshape(t.get(PATTERN_SIZE, (2, 2)))
        if pattern.max() > 2:
            raise ValueError("a mosaic of other colours than red, green and blue")
        v = demosaic(np.clip((m - low) / (white[0] - low), 0, 1).astype(np.float32), pattern)
    elif m.shape[2] == 3:
        v = np.clip((m - black.ravel()[0]) / (white[0] - black.ravel()[0]), 0, 1)
    else:
        raise ValueError(f"camera file of {m.shape[2]} samples")
    if AREA in t:
        top, left, bottom, right = (int(x) for x in t[AREA])
        v = v[top:bottom, left:right]
    neutral = np.array(first.get(NEUTRAL, t.get(NEUTRAL, (1.0, 1.0, 1.0))), float)
    if len(neutral) != 3 or (neutral <= 0).any():
        raise ValueError("no white balance of three colours")
    v = np.minimum(v / neutral * neutral.max(), 1.0)
    matrix = first.get(MATRIX, t.get(MATRIX))
    if matrix is not None and len(matrix) == 9:
        # camera from XYZ, scaled so that balanced white is white, then turned round
        camera = np.reshape(matrix, (3, 3)) @ np.linalg.inv(RGB_OF_XYZ)
        camera /= camera.sum(1, keepdims=True)
        v = np.clip(v @ np.linalg.inv(camera).T, 0, 1)
    v = np.where(v <= 0.0031308, 12.92 * v, 1.055 * np.maximum(v, 1e-9) ** (1 / 2.4) - 0.055)
    return np.floor(np.clip(v, 0, 1) * 255 + 0.5).astype(np.uint8)
