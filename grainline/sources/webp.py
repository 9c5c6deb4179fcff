"""Lossless WebP files: prefix codes, backward references, colour cache and the four transforms.

Lossy and animated files raise ValueError, which makes the file an error row. Pixels are held as (alpha, red, green, blue).
"""

from __future__ import annotations

import functools
import struct

import numpy as np

# fixed values
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
LENGTHS, DISTANCES = 24, 40
MOST_PIXELS = 1 << 30


def chunks(raw: bytes):
    """(name, body) of a RIFF file."""
    if raw[:4] != b"RIFF" or len(raw) < 12:
        raise ValueError("not a RIFF file")
    at = 12
    while at + 8 <= len(raw):
        (n,) = struct.unpack_from("<I", raw, at + 4)
        yield raw[at : at + 4], raw[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


@functools.cache
def neighbours() -> list[tuple[int, int]]:
    """Steps back (left, up) by their short codes: nearest first, steeper ones before flat ones, left before right."""
    steps = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(steps, key=lambda s: (s[0] ** 2 + s[1] ** 2, abs(s[0]), -s[0]))


class Bits:
    """Numbers from bytes, lowest bit first."""

    def __init__(self, body: bytes):
        self.body, self.at, self.bits, self.held = body, 0, 0, 0

    def fill(self) -> None:
        more = self.body[self.at : self.at + 8]
        self.bits |= int.from_bytes(more, "little") << self.held
        self.at, self.held = self.at + len(more), self.held + 8 * len(more)

    def read(self, n: int) -> int:
        if self.held < n:
            self.fill()
            if self.held < n:
                raise ValueError("image data ends early")
        x = self.bits & (1 << n) - 1
        self.bits >>= n
        self.held -= n
        return x

    def symbol(self, table: tuple[int, list]) -> int:
        most, entries = table
        if self.held < most:
            self.fill()
        length, x = entries[self.bits & (1 << most) - 1]
        if length > self.held:
            raise ValueError("image data ends early")
        self.bits >>= length
        self.held -= length
        return x


def table_of(lengths: list[int]) -> tuple[int, list]:
    """(bits looked at, (length, symbol) by them) of a canonical code; a lone symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if not used:
        raise ValueError("empty prefix code")
    if len(used) == 1:
        return 0, [(0, used[0])]
    most = max(lengths)
    entries: list = [None] * (1 << most)
    code, last = 0, 0
    for s in sorted(used, key=lambda s: (lengths[s], s)):
        n = lengths[s]
        code <<= n - last
        if code >> n:
            raise ValueError("damaged prefix code")
        back = int(f"{code:0{n}b}"[::-1], 2)
        for k in range(back, 1 << most, 1 << n):
            entries[k] = (n, s)
        code, last = code + 1, n
    if None in entries:
        raise ValueError("damaged prefix code")
    return most, entries


def prefix_code(b: Bits, size: int) -> tuple[int, list]:
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        symbols = [b.read(8 if wide else 1)] + ([b.read(8)] if two else [])
        if two:
            return (1, [(1, min(symbols)), (1, max(symbols))]) if symbols[0] != symbols[1] else (0, [(0, symbols[0])])
        return 0, [(0, symbols[0])]
    own = [0] * len(LENGTH_ORDER)
    for i in range(4 + b.read(4)):
        own[LENGTH_ORDER[i]] = b.read(3)
    table, left = table_of(own), size
    if b.read(1):
        left = 2 + b.read(2 + 2 * b.read(3))
    lengths: list[int] = []
    before = 8
    while len(lengths) < size and left > 0:
        left -= 1
        s = b.symbol(table)
        if s < 16:
            lengths.append(s)
            before = s or before
        elif s == 16:
            lengths += [before] * (3 + b.read(2))
        else:
            lengths += [0] * (3 + b.read(3) if s == 17 else 11 + b.read(7))
    if len(lengths) > size:
        raise ValueError("damaged prefix code")
    return table_of(lengths + [0] * (size - len(lengths)))


def _value(b: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + b.read(extra) + 1


def pixels(b: Bits, w: int, h: int, main: bool) -> list[int]:
    """An image's numbers, alpha highest; the main image may have several groups of codes, chosen by a smaller image."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("damaged colour cache")
    cache, groups, step, choice, across = [0] * (1 << cache_bits), 1, 0, None, 0
    if main and b.read(1):
        step = b.read(3) + 2
        across = (w + (1 << step) - 1) >> step
        choice = [x >> 8 & 0xFFFF for x in pixels(b, across, (h + (1 << step) - 1) >> step, False)]
        groups = max(choice) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[prefix_code(b, n) for n in sizes] for _ in range(groups)]
    out: list[int] = []
    todo, green, red, blue, alpha, far = w * h, *codes[0]
    while len(out) < todo:
        n = len(out)
        if choice is not None:
            green, red, blue, alpha, far = codes[choice[(n // w >> step) * across + (n % w >> step)]]
        s = b.symbol(green)
        if s < 256:
            r = b.symbol(red)
            out.append(s << 8 | r << 16 | b.symbol(blue) | b.symbol(alpha) << 24)
        elif s < 256 + LENGTHS:
            length, back = _value(b, s - 256), _value(b, b.symbol(far))
            if back > 120:
                back -= 120
            else:
                x, y = neighbours()[back - 1]
                back = max(1, x + y * w)
            if back > n or n + length > todo:
                raise ValueError("backward reference beyond the image")
            for i in range(n - back, n - back + length):
                out.append(out[i])
        else:
            out.append(cache[s - 256 - LENGTHS])
        if cache_bits:
            for x in out[n:]:
                cache[(HASH * x & 0xFFFFFFFF) >> 32 - cache_bits] = x
    return out


def _channels(x: list[int], h: int, w: int) -> np.ndarray:
    return np.array(x, ">u4").view(np.uint8).reshape(h, w, 4).astype(np.int64)


def _predicted(mode: int, l, t, tl, tr):  # noqa: E741
    if mode == 11:
        to_left = sum(abs(a - c) for a, c in zip(t, tl))
        return l if to_left < sum(abs(a - c) for a, c in zip(l, tl)) else t
    if mode == 12:
        return [min(255, max(0, a + c - d)) for a, c, d in zip(l, t, tl)]
    if mode == 13:
        return [min(255, max(0, m + int((m - d) / 2))) for m, d in zip([a + c >> 1 for a, c in zip(l, t)], tl)]
    mean = lambda a, c: [x + y >> 1 for x, y in zip(a, c)]
    return (
        (255, 0, 0, 0), l, t, tr, tl, lambda: mean(mean(l, tr), t), lambda: mean(l, tl), lambda: mean(l, t), lambda: mean(tl, t), lambda: mean(t, tr),
        lambda: mean(mean(l, tl), mean(t, tr)),
    )[mode if mode < 11 else 0]


def unpredict(a: np.ndarray, modes: np.ndarray, step: int) -> np.ndarray:
    """Residuals to pixels: the first from black, the top row from the left, the left column from above, others by their block's mode."""
    h, w = a.shape[:2]
    flat = a.reshape(-1, 4).tolist()
    for i in range(h * w):
        y, x = divmod(i, w)
        if not y:
            p = flat[i - 1] if x else (255, 0, 0, 0)
        elif not x:
            p = flat[i - w]
        else:
            # right of the last column stands the first pixel of this row
            p = _predicted(int(modes[y >> step, x >> step]) & 15, flat[i - 1], flat[i - w], flat[i - w - 1], flat[i - w + 1])
            p = p() if callable(p) else p
        flat[i] = [u + v & 255 for u, v in zip(flat[i], p)]
    return np.array(flat, np.int64).reshape(h, w, 4)


def _signed(a: np.ndarray) -> np.ndarray:
    return (a + 128 & 255) - 128


def decode(raw: bytes) -> np.ndarray:
    """A file as height x width x 3 bytes; transparency falls away."""
    body = dict(chunks(raw)).get(b"VP8L")
    if body is None or body[:1] != b"\x2f":
        raise ValueError("no lossless WebP image")
    b = Bits(body[1:])
    w, h = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3) or w * h > MOST_PIXELS:
        raise ValueError("WebP of another version")
    wide, done, undo = w, set(), []
    while b.read(1):
        kind = b.read(2)
        if kind in done:
            raise ValueError("a transform comes twice")
        done.add(kind)
        if kind < 2:
            step = b.read(3) + 2
            size = (h + (1 << step) - 1) >> step, (wide + (1 << step) - 1) >> step
            undo.append((kind, step, _channels(pixels(b, size[1], size[0], False), *size), wide))
        elif kind == 2:
            undo.append((kind, 0, None, wide))
        else:
            n = b.read(8) + 1
            colours = np.cumsum(_channels(pixels(b, n, 1, False), 1, n)[0], axis=0) & 255
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, packed, colours, wide))
            wide = (wide + (1 << packed) - 1) >> packed
    a = _channels(pixels(b, wide, h, True), h, wide)
    for kind, step, side, across in reversed(undo):
        if kind == 0:
            a = unpredict(a, side[..., 2], step)
        elif kind == 1:
            e = np.repeat(np.repeat(_signed(side), 1 << step, 0), 1 << step, 1)[: a.shape[0], : a.shape[1]]
            green = _signed(a[..., 2])
            a[..., 1] = a[..., 1] + (e[..., 3] * green >> 5) & 255
            a[..., 3] = a[..., 3] + (e[..., 2] * green >> 5) + (e[..., 1] * _signed(a[..., 1]) >> 5) & 255
        elif kind == 2:
            a[..., 1], a[..., 3] = a[..., 1] + a[..., 2] & 255, a[..., 3] + a[..., 2] & 255
        else:
            bits = 8 >> step
            x = np.arange(across)
            index = a[:, x >> step, 2] >> bits * (x & (1 << step) - 1) & (1 << bits) - 1
            table = np.zeros((256, 4), np.int64)
            table[: len(side)] = side
            a = table[index]
    return a[..., 1:].astype(np.uint8)
