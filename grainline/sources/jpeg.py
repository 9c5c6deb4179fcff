"""Baseline JPEG files from RGB bytes, a band of rows at a time.

Full colour resolution; the Huffman codes are the best ones for the image's own symbols, counted in a first pass
over the bands, so no code tables are kept. A band's coefficients, symbols and bits are numpy arrays; what is held of
the whole image is its pixels, the file and at most ``HELD`` symbols.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

# fixed values: quantisation steps of the standard's annex for quality 50, by rows
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
#: Of colour: the top left corner; all others are 99.
CHROMA_STEPS = ((17, 18, 24, 47), (18, 21, 26, 66), (24, 26, 56, 99), (47, 66, 99, 99))
QUALITY = 75
#: Blocks of a component that are coded together.
BAND = 1000
SIXTEEN_ZEROS = 0xF0
#: Symbols of an image that are kept from the first pass for the second, of five bytes each; what is beyond them is coded twice.
HELD = 4_000_000


def steps(quality: int) -> np.ndarray:
    """The two tables (luma, colour) of a quality from 1 to 100, 8 by 8 each."""
    colour = np.full((8, 8), 99)
    colour[:4, :4] = CHROMA_STEPS
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.stack([np.reshape(LUMA_STEPS, (8, 8)), colour]) * scale + 50) // 100, 1, 255)


@functools.cache
def zigzag() -> np.ndarray:
    """Places of an 8 by 8 block along its diagonals, by turns up and down."""
    at = [(y + x, y if (y + x) % 2 else x, y, x) for y in range(8) for x in range(8)]
    return np.array([y * 8 + x for _, _, y, x in sorted(at)])


@functools.cache
def cosines() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


def code_lengths(counts: np.ndarray, most: int = 16) -> np.ndarray:
    """Bits of the best prefix code with at most ``most`` bits a symbol, and none that is all ones: package and merge."""
    used = np.flatnonzero(counts)
    # one more symbol, the rarest, takes the code of all ones
    leaves = sorted([(int(counts[s]), (int(s),)) for s in used] + [(0, (-1,))])
    merged: list = []
    for _ in range(most):
        row = sorted(leaves + merged)
        merged = [(row[i][0] + row[i + 1][0], row[i][1] + row[i + 1][1]) for i in range(0, len(row) - 1, 2)]
    bits = np.zeros(len(counts), int)
    for _, symbols in row[: 2 * len(leaves) - 2]:
        for s in symbols:
            if s >= 0:
                bits[s] += 1
    return bits


def codes(bits: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, shorter ones first, equal lengths by symbol."""
    out, code, last = np.zeros(len(bits), np.int64), 0, 0
    for s in sorted(np.flatnonzero(bits), key=lambda s: (bits[s], s)):
        code <<= int(bits[s]) - last
        out[s], last = code, int(bits[s])
        code += 1
    return out


def _coefficients(rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(block, component, 65) in zigzag order, the last coefficient twice, of a band of pixel rows, a multiple of eight in both ways."""
    h, w = rows.shape[:2]
    r, g, b = np.ascontiguousarray(rows.transpose(2, 0, 1)).astype(np.float32)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    d = cosines().astype(np.float32)
    steps = np.tile(tables.astype(float), (1, 1, w // 8)).reshape(2, -1)
    out = np.empty((h // 8, w // 8, 3, 8), "V16")  # a row of a block, eight numbers of 16 bits, is moved as one
    for i, plane in enumerate((y - 128, (b - y) / 1.772, (r - y) / 1.402)):
        # first down the columns of a row of blocks, then along the rows of each block
        f = (d @ plane.reshape(h // 8, 8, w)).reshape(-1, 8) @ d.T
        f = f.reshape(h // 8, 8 * w) / steps[min(i, 1)]
        out[:, :, i] = np.rint(f, out=f).astype(np.int16).view("V16").reshape(h // 8, 8, w // 8).swapaxes(1, 2)
    return out.view(np.int16).reshape(-1, 3, 64).take(np.append(zigzag(), 63), -1)


@functools.cache
def sizes() -> np.ndarray:
    """Bits of a value's magnitude, by the value as 16 bits without sign."""
    return np.frexp(np.abs(np.arange(1 << 16, dtype=np.uint16).view(np.int16).astype(float)))[1].astype(np.uint8)


@functools.cache
def _places() -> tuple[np.ndarray, np.ndarray]:
    """(256 times the table, whether a run of zeros counts) of the 65 places of three components: table 0 and 1 are DC, 2 and 3 AC,
    of luma and colour; the last place is the end of the block."""
    k, colour = np.arange(195) % 65, np.arange(195) >= 65
    return ((k > 0) * 512 + colour * 256).astype(np.uint16), (k > 0) & (k < 64)


def _symbols(c: np.ndarray, before: np.ndarray):
    """(table and symbol, extra bits, their number) of a band in order; ``before``: the last DC of each component, moved on."""
    dc = np.diff(c[..., 0], axis=0, prepend=before[None])
    before[:] = c[-1, :, 0]
    there = c != 0
    there[..., 0] = True
    there[..., 64] = ~there[..., 63]  # the block ends early
    c[..., 0] = dc
    at = np.flatnonzero(there)
    value, (tables, counts), place = c.ravel()[at], _places(), at % 195
    run = np.where(counts[place], np.diff(at, prepend=0) - 1, 0)
    size = sizes()[value.view(np.uint16)]
    symbol = tables[place] + (run % 16 * 16 + size).astype(np.uint16)
    extra = np.where(value < 0, value + (1 << size.astype(np.int32)) - 1, value).astype(np.uint16)
    far = np.flatnonzero(run > 15)
    if len(far):
        zeros = np.repeat(far, run[far] // 16)
        symbol = np.insert(symbol, zeros, (symbol[zeros] & 0x300) + SIXTEEN_ZEROS)
        extra, size = np.insert(extra, zeros, 0), np.insert(size, zeros, 0)
    return symbol, extra, size


def _bands(a: np.ndarray):
    """Bands of pixel rows, edges repeated to whole blocks."""
    h, w = a.shape[:2]
    tall = max(1, BAND // -(-w // 8)) * 8
    for y in range(0, h, tall):
        part = a[y : y + tall]
        yield np.pad(part, [(0, -len(part) % 8), (0, -w % 8), (0, 0)], mode="edge") if len(part) % 8 or w % 8 else part


def encode(a: np.ndarray, quality: int = QUALITY) -> bytes:
    """A JPEG file of height x width x 3 bytes."""
    h, w = a.shape[:2]
    if not h or not w or max(h, w) > 65_535:
        raise ValueError(f"no JPEG file of {w} x {h} pixels")
    tables, held, room = steps(quality), [], HELD
    counts, before = np.zeros(1024, np.int64), np.zeros(3, np.int16)
    for rows in _bands(a):
        coded = _symbols(_coefficients(rows, tables), last := before.copy())
        counts += np.bincount(coded[0], minlength=1024)
        room -= len(coded[0])
        held.append(coded if room >= 0 else before)
        before = last
    bits = np.concatenate([code_lengths(counts[t * 256 : t * 256 + 256]) for t in range(4)])
    code = np.concatenate([codes(bits[t * 256 : t * 256 + 256]) for t in range(4)])
    out, word, left = [], 0, 0
    for rows, known in zip(_bands(a), held):
        symbol, extra, size = known if isinstance(known, tuple) else _symbols(_coefficients(rows, tables), known)
        # code and extra bits of a symbol are one number of at most 27 bits, which lies in two words of 32
        value, long = code[symbol] << size | extra, bits[symbol] + size
        end = left + np.cumsum(long)
        at, total = end - long, int(end[-1])
        spread = value << (63 - at % 32 - long)
        first, words = at // 32, total // 32 + 2
        body = np.bincount(first, spread >> 31, words) + np.bincount(first + 1, spread << 1 & 0xFFFFFFFF, words)
        body[0] += word
        word, left = int(body[total // 32]), total % 32
        out.append(body[: total // 32].astype(">u4").tobytes())
    if left:
        out.append((word | 0xFFFFFFFF >> left).to_bytes(4, "big")[: -(-left // 8)])
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    head = b"\xff\xd8" + part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for i in range(2):
        head += part(0xDB, bytes([i]) + tables[i].ravel()[zigzag()].astype(np.uint8).tobytes())
    head += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for t, name in enumerate((0x00, 0x01, 0x10, 0x11)):
        own = bits[t * 256 : t * 256 + 256]
        used = sorted(np.flatnonzero(own), key=lambda s: (own[s], s))
        head += part(0xC4, bytes([name]) + np.bincount(own[used], minlength=17)[1:17].astype(np.uint8).tobytes() + bytes(used))
    head += part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    return head + b"".join(out).replace(b"\xff", b"\xff\0") + b"\xff\xd9"
