"""Text as a coverage mask, from the outlines of a TrueType font.

A font is bytes of a file that the caller names: nothing is bundled. Glyphs are simple or composite outlines of quadratic
curves; kerning, hinting and shaping are left out. Coverage is exact for the flattened outline: every edge adds the area
that it cuts from the pixels of each row it crosses, and running sums along the row give the inside.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

#: Straight pieces of a curve.
PIECES = 8


class Font:
    def __init__(self, raw: bytes):
        try:
            n = struct.unpack_from(">H", raw, 4)[0]
            self.tables = {raw[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">II", raw, 20 + 16 * i) for i in range(n)}
            self.raw = raw
            head, hhea = self.tables[b"head"][0], self.tables[b"hhea"][0]
            self.wide_places = struct.unpack_from(">h", raw, head + 50)[0]
            self.ascent, self.descent = struct.unpack_from(">hh", raw, hhea + 4)
            self.advances = struct.unpack_from(">H", raw, hhea + 34)[0]
            self.glyphs = struct.unpack_from(">H", raw, self.tables[b"maxp"][0] + 4)[0]
            self.map = self._map()
        except (struct.error, KeyError, IndexError) as e:
            raise ValueError(f"not a TrueType font: {e}") from None
        if self.ascent <= self.descent or not self.advances:
            raise ValueError("a font without height")

    def _map(self):
        """A function from code points to glyphs, by the widest of the font's Unicode tables."""
        raw, at = self.raw, self.tables[b"cmap"][0]
        found = {}
        for i in range(struct.unpack_from(">H", raw, at + 2)[0]):
            platform, _, offset = struct.unpack_from(">HHI", raw, at + 4 + 8 * i)
            kind = struct.unpack_from(">H", raw, at + offset)[0]
            if platform in (0, 3) and kind in (4, 12):
                found[kind] = at + offset
        if 12 in found:
            n = struct.unpack_from(">I", raw, found[12] + 12)[0]
            runs = [struct.unpack_from(">III", raw, found[12] + 16 + 12 * i) for i in range(n)]
            return lambda c: next((g + c - a for a, b, g in runs if a <= c <= b), 0)
        if 4 not in found:
            raise ValueError("a font without a Unicode table")
        at = found[4]
        n = struct.unpack_from(">H", raw, at + 6)[0] // 2
        ends, starts, shifts, places = (struct.unpack_from(f">{n}H", raw, at + 14 + 2 * n * k + 2 * (k > 0)) for k in range(4))

        def glyph(c: int) -> int:
            for i in range(n):
                if starts[i] <= c <= ends[i]:
                    if not places[i]:
                        return c + shifts[i] & 0xFFFF
                    where = at + 16 + 6 * n + 2 * i + places[i] + 2 * (c - starts[i])
                    g = struct.unpack_from(">H", raw, where)[0]
                    return g + shifts[i] & 0xFFFF if g else 0
            return 0

        return glyph

    def advance(self, glyph: int) -> int:
        return struct.unpack_from(">H", self.raw, self.tables[b"hmtx"][0] + 4 * min(glyph, self.advances - 1))[0]

    @functools.lru_cache(4096)  # noqa: B019 - fonts are few and live as long as their worker
    def contours(self, glyph: int, depth: int = 0) -> list[list[tuple[float, float, bool]]]:
        """Closed contours of points (x, y, on the curve) in font units."""
        raw, loca, base = self.raw, self.tables[b"loca"][0], self.tables[b"glyf"][0]
        if glyph >= self.glyphs or depth > 8:
            return []
        a, b = struct.unpack_from(">II", raw, loca + 4 * glyph) if self.wide_places else (2 * x for x in struct.unpack_from(">HH", raw, loca + 2 * glyph))
        if a == b:
            return []
        at = base + a
        n = struct.unpack_from(">h", raw, at)[0]
        at += 10
        if n < 0:
            out, more = [], True
            while more:
                flags, part = struct.unpack_from(">HH", raw, at)
                dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", raw, at + 4) if flags & 2 else (0, 0)
                at += 8 if flags & 1 else 6
                k = 1 if flags & 8 else 2 if flags & 0x40 else 4 if flags & 0x80 else 0
                m = [x / 16384 for x in struct.unpack_from(f">{k}h", raw, at)]
                at += 2 * k
                xx, xy, yx, yy = (1, 0, 0, 1) if not k else (m[0], 0, 0, m[0]) if k == 1 else (m[0], 0, 0, m[1]) if k == 2 else m
                out += [[(xx * x + yx * y + dx, xy * x + yy * y + dy, on) for x, y, on in c] for c in self.contours(part, depth + 1)]
                more = flags & 0x20
            return out
        ends = struct.unpack_from(f">{n}H", raw, at)
        at += 2 * n
        at += 2 + struct.unpack_from(">H", raw, at)[0]
        total, flags = (ends[-1] + 1 if ends else 0), []
        while len(flags) < total:
            f = raw[at]
            at += 1
            flags.append(f)
            if f & 8:
                flags += [f] * raw[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, values = 0, []
            for f in flags[:total]:
                if f & short:
                    v += raw[at] if f & same else -raw[at]
                    at += 1
                elif not f & same:
                    v += struct.unpack_from(">h", raw, at)[0]
                    at += 2
                values.append(v)
            axes.append(values)
        points = [(float(x), float(y), bool(f & 1)) for x, y, f in zip(*axes, flags)]
        return [points[i:j] for i, j in zip((0, *(e + 1 for e in ends)), (e + 1 for e in ends)) if j > i]


def flattened(contour: list[tuple[float, float, bool]]) -> list[tuple[float, float]]:
    """A closed contour as points; two off-curve points have an on-curve one half-way."""
    n = len(contour)
    full: list[tuple[float, float, bool]] = []
    for i, (x, y, on) in enumerate(contour):
        px, py, before = contour[i - 1]
        if not on and not before:
            full.append(((x + px) / 2, (y + py) / 2, True))
        full.append((x, y, on))
    if n == 1:
        return [(x, y) for x, y, _ in full]
    start = next((i for i, p in enumerate(full) if p[2]), 0)
    full = full[start:] + full[: start + 1]
    out, i = [full[0][:2]], 1
    while i < len(full):
        x, y, on = full[i]
        if on:
            out.append((x, y))
            i += 1
            continue
        (ax, ay), (bx, by) = out[-1], full[i + 1][:2]
        for k in range(1, PIECES + 1):
            t = k / PIECES
            out.append(((1 - t) ** 2 * ax + 2 * t * (1 - t) * x + t * t * bx, (1 - t) ** 2 * ay + 2 * t * (1 - t) * y + t * t * by))
        i += 2
    return out


def coverage(polygons: list[list[tuple[float, float]]], width: int, height: int) -> np.ndarray:
    """Share of each pixel inside closed polygons (non-zero winding where they do not overlap), 0 to 1."""
    acc = np.zeros((height, width + 2))
    for points in polygons:
        for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]):
            if y0 == y1:
                continue
            way = 1.0 if y0 < y1 else -1.0
            if y0 > y1:
                x0, y0, x1, y1 = x1, y1, x0, y0
            slope = (x1 - x0) / (y1 - y0)
            for row in range(max(0, int(np.floor(y0))), min(height, int(np.ceil(y1)))):
                top, low = max(y0, row), min(y1, row + 1)
                a, b = (min(max(x0 + slope * (y - y0), 0.0), float(width)) for y in (top, low))
                a, b = min(a, b), max(a, b)
                tall, first, last = way * (low - top), int(a), int(b)
                if first == last:  # within one pixel: what lies right of the edge's middle
                    share = first + 1 - (a + b) / 2
                    acc[row, first] += tall * share
                    acc[row, first + 1] += tall * (1 - share)
                    continue
                # what lies right of the edge grows evenly from a to b; its integral up to each pixel's end, differenced
                at = np.arange(first, last + 3)
                whole = (np.clip(at, a, b) - a) ** 2 / 2 / (b - a) + np.maximum(at - b, 0.0)
                acc[row, first : last + 2] += tall * np.diff(np.diff(whole), prepend=0.0)
    return np.clip(np.abs(np.cumsum(acc, axis=1))[:, :width], 0.0, 1.0)


def text_mask(font: Font, text: str, px: float) -> tuple[int, int, np.ndarray, int, int]:
    """(width, height, mask, left, top) of a line of text: its size (advances; the tallest glyph), and coverage with
    its place relative to the line's top left corner. ``px`` is the height from descent to ascent."""
    k = px / (font.ascent - font.descent)
    pen, tall, polygons = 0.0, 0, []
    for c in text:
        glyph = font.map(ord(c))
        own = [[(pen + x * k, (font.ascent - y) * k) for x, y in flattened(points)] for points in font.contours(glyph)]
        ys = [y for points in own for _, y in points]
        if ys:
            tall = max(tall, int(np.ceil(max(ys)) - np.floor(min(ys))))
        polygons += own
        pen += font.advance(glyph) * k
    every = [p for points in polygons for p in points]
    if not every:
        return int(pen), tall, np.zeros((0, 0)), 0, 0
    left, top = (int(np.floor(min(p[i] for p in every))) for i in (0, 1))
    right, low = (int(np.ceil(max(p[i] for p in every))) for i in (0, 1))
    moved = [[(x - left, y - top) for x, y in points] for points in polygons]
    return int(pen), tall, coverage(moved, max(1, right - left), max(1, low - top)), left, top
