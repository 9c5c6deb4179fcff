"""Spatial filters on packed images (image_id, width, height, data: RGB bytes by rows), as Arrow batches of numpy work.

Definitions of our own where none is given: edges are repeated, Gaussians reach three deviations, and the
perceptual hash is the 8 by 8 low block of a DCT-II of a 32 by 32 area-averaged gray image against its median.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import BLUR_LONG_EDGE, PACKED, POISSON_SWEEPS, STRAIGHTEN_DEGREES


def pack(px: DataFrame) -> DataFrame:
    """Pixel rows to packed images: for small ones, as an image's pixels meet in one array. Photos stay packed
    from ``images.decode`` on."""
    rows = F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    d = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), rows.alias("p"))
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    text = F.array_join(F.transform("p", lambda s: F.concat(byte(s["r"]), byte(s["g"]), byte(s["b"]))), "")
    return d.select("image_id", "width", "height", F.unhex(text).alias("data"))


#: Bytes of pixels that leave a task at once: what is made of a batch of images may be many times as large.
BATCH_BYTES = 16 << 20


def tables(rows):
    """Packed rows as tables that end where ``BATCH_BYTES`` are reached."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3] or b"")
        if size >= BATCH_BYTES:
            yield table(held)
            held, size = [], 0
    if held:
        yield table(held)


def explode(images: DataFrame) -> DataFrame:
    """Packed images to pixel rows."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for r in b.itertuples():
                a = array(r)
                if a is None:
                    continue
                y, x = np.mgrid[: r.height, : r.width]
                yield pd.DataFrame({"image_id": r.image_id, "y": y.ravel(), "x": x.ravel(), "r": a[..., 0].ravel(), "g": a[..., 1].ravel(), "b": a[..., 2].ravel()})

    return images.mapInPandas(run, "image_id long, y int, x int, r int, g int, b int")


def array(r) -> np.ndarray | None:
    """The pixels of a packed row; none where the file could not be decoded."""
    return None if r.data is None or not r.width or not r.height else np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), 3)


def row(r, a: np.ndarray | None) -> tuple:
    """A packed row of new pixels, or the row as it is."""
    return (r.image_id, r.width, r.height, r.data) if a is None else (r.image_id, a.shape[1], a.shape[0], np.ascontiguousarray(a, np.uint8).tobytes())


def table(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["image_id", "width", "height", "data"])


def each(images: DataFrame, fn) -> DataFrame:
    """Applies fn (height x width x 3 bytes to the same) to every image; rows without pixels stay as they are."""

    def run(batches):
        for b in batches:
            yield from tables(row(r, None if a is None else fn(a)) for r, a in ((r, array(r)) for r in b.itertuples()))

    return images.select("image_id", "width", "height", "data").mapInPandas(run, PACKED)


def bytes_of(a: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(a, 0, 255) + 0.5).astype(np.uint8)


def gray(a: np.ndarray) -> np.ndarray:
    return np.rint(a @ np.array([2126.0, 7152.0, 722.0]) / 10000.0)


def laplacian_score(g: np.ndarray) -> float:
    if not g.size:
        return 0.0
    p = np.pad(g.astype(float), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def grid_blur(g: np.ndarray) -> np.ndarray:
    """``laplacian_score`` of many gray images of one size (height, width, images), from whole sums."""
    p = np.pad(g.astype(np.int64), ((1, 1), (1, 1), (0, 0)), mode="edge")
    lap = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).reshape(-1, g.shape[2])
    n = len(lap)
    return (n * (lap * lap).sum(0) - lap.sum(0) ** 2) / n**2


def _kernel(kind: str):
    """(weight by distance, reach) of a resampling."""
    return {"lanczos": (lambda x: np.sinc(x) * np.sinc(x / 3), 3.0), "triangle": (lambda x: np.maximum(0, 1 - np.abs(x)), 1.0), "area": (lambda x: np.ones_like(x), 0.5001)}[kind]


def _weights(n_in: int, n_out: int, radius: float, f, out: tuple[int, int] | None = None, source: tuple[int, int] | None = None) -> np.ndarray:
    """Shares of the places of ``source`` in each place of ``out`` (from and to; all of them by default)."""
    (a, b), (c, d) = out or (0, n_out), source or (0, n_in)
    scale = max(1.0, n_in / n_out)
    at = (np.arange(a, b) + 0.5) * n_in / n_out - 0.5
    far = np.arange(c, d)[None, :] - at[:, None]
    w = f(far / scale) * (np.abs(far) < radius * scale)
    return w / w.sum(1, keepdims=True)


def reach(n_in: int, n_out: int, a: int, b: int, kind: str) -> tuple[int, int]:
    """The places that the places a to b of a resampling are made of."""
    wide = _kernel(kind)[1] * max(1.0, n_in / n_out)
    low, high = ((x + 0.5) * n_in / n_out - 0.5 for x in (a, b - 1))
    return max(0, math.floor(low - wide)), min(n_in, math.ceil(high + wide) + 1)


#: Values of a resampling that are worked on at once.
PART = 1 << 17


@functools.lru_cache(maxsize=64)
def _taps(n_in: int, n_out: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of what each of ``n_out`` places is made of, the first tap of all, then the second; places without a weight
    are ``n_in``. The weights of an area are 1."""
    f, radius = _kernel(kind)
    scale = max(1.0, n_in / n_out)
    at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    i = np.floor(at - radius * scale).astype(int) + np.arange(int(2 * radius * scale) + 3)[:, None]
    far = i - at
    near = (np.abs(far) < radius * scale) & (i >= 0) & (i < n_in)
    first = near.argmax(0)  # those of a place follow each other
    k = first + np.arange(near.sum(0).max())[:, None]
    k = np.minimum(k, len(i) - 1), np.arange(n_out)
    return np.where(near[k], i[k], n_in), np.where(near[k], f(far[k] / scale), 0.0)


def _resized(a: np.ndarray, width: int, height: int, kind: str):
    """(first row, rows, sums of weights) of a resampling as sums of weights times values, some rows at a time, with the channels side by
    side. A place is made of its few neighbours only; areas of bytes are whole sums."""
    (i, v), (j, u) = _taps(a.shape[0], height, kind), _taps(a.shape[1], width, kind)
    rows, cols, channels = v.sum(0), u.sum(0), a.shape[2]
    own = float
    if kind == "area" and a.dtype == np.uint8:
        own = np.uint16 if rows.max() * cols.max() * 255 < 1 << 16 else np.uint64
    pixel = np.dtype((np.void, np.dtype(own).itemsize * channels))  # moved as one
    many = max(1, PART // (max(width, a.shape[1]) * channels))
    u, cols = np.repeat(u, channels, 1), np.repeat(cols, channels)
    for y in range(0, height, many):
        at, w = i[:, y : y + many], v[:, y : y + many, None]
        # the rows that these are made of, and one of zeros below them; a column of zeros on the right
        top, end = at.min(), at[at < len(a)].max() + 1
        part = np.zeros((end - top + 1, (a.shape[1] + 1) * channels), own)
        part[:-1, :-channels] = a[top:end].reshape(end - top, -1)
        down = _mixed((part.take(k, 0) for k in np.minimum(at, end) - top), None if own is not float else w)
        across = (down.view(pixel).take(k, 1).view(own) for k in j)
        yield y, _mixed(across, None if own is not float else u), rows[y : y + many, None] * cols


def _mixed(taps, weights: np.ndarray | None) -> np.ndarray:
    """The sum of taps, each with its weights if there are any."""
    out = None
    for k, tap in enumerate(taps):
        if weights is not None:
            tap *= weights[k]
        out = tap if out is None else np.add(out, tap, out=out)
    return out


def resize(a: np.ndarray, width: int, height: int, kind: str = "lanczos") -> np.ndarray:
    """Separable resampling: lanczos (three lobes), triangle or area."""
    out = np.empty((height, width, a.shape[2]))
    for y, sums, weights in _resized(a, width, height, kind):
        out[y : y + len(sums)] = (sums / weights).reshape(-1, *out.shape[1:])
    return out


def fit(a: np.ndarray, edge: int, kind: str = "area") -> np.ndarray:
    """Shrunk so that the long edge is ``edge``; smaller images stay."""
    h, w = a.shape[:2]
    if max(h, w) <= edge:
        return a
    k = edge / max(h, w)
    out = np.empty((max(1, round(h * k)), max(1, round(w * k)), a.shape[2]), np.uint8)
    for y, sums, weights in _resized(a, out.shape[1], out.shape[0], kind):
        if sums.dtype == np.uint16:  # 24 bits tell their quotients from halves
            small = (sums.astype(np.float32) / weights.astype(np.float32) + np.float32(0.5)).astype(np.uint8)
        else:
            small = bytes_of(sums / weights)
        out[y : y + len(small)] = small.reshape(-1, *out.shape[1:])
    return out


def normalised_blur(a: np.ndarray) -> float:
    return laplacian_score(gray(fit(a, BLUR_LONG_EDGE, "lanczos")))


def region(a: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray | None:
    """A box clamped to the frame, one pixel at least; none of an empty image."""
    height, width = a.shape[:2]
    if not width or not height:
        return None
    x, y = min(max(0, x), width - 1), min(max(0, y), height - 1)
    return a[y : y + max(1, min(h, height - y)), x : x + max(1, min(w, width - x))]


def region_blur(a: np.ndarray, x: int, y: int, w: int, h: int) -> float:
    """Blur score of a box after its long edge is shrunk to the common size; an empty image has 0."""
    part = region(a, x, y, w, h)
    return 0.0 if part is None else normalised_blur(part)


def resized_blur(a: np.ndarray, edge: int = BLUR_LONG_EDGE) -> tuple[float, float]:
    """(score as it is, score with the long edge resized to ``edge``, up or down): a probe of the scale's effect."""
    h, w = a.shape[:2]
    k = edge / max(h, w)
    return laplacian_score(gray(a)), laplacian_score(gray(bytes_of(resize(a, max(1, round(w * k)), max(1, round(h * k)), "lanczos"))))


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = a.astype(float)
    for axis in (0, 1):
        p = np.pad(out, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="edge")
        out = sum(w * np.take(p, range(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
    return out


def denoise(a: np.ndarray, strength: float) -> np.ndarray:
    s = min(1.0, max(0.0, strength / 100))
    if s == 0:
        return a
    r = 2 if s >= 0.6 else 1
    p = np.pad(a, [(r, r), (r, r), (0, 0)], mode="edge")
    stack = [p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)]
    return bytes_of(a + (np.median(np.stack(stack), 0) - a) * s)


def unsharp(a: np.ndarray, k: float, sigma: float) -> np.ndarray:
    return bytes_of(a + (a - gaussian(a, sigma)) * k)


def sharpen(a: np.ndarray, strength: float) -> np.ndarray:
    s = min(1.0, max(0.0, strength / 100))
    return unsharp(a, 0.9 * s, 1.2) if s > 0 else a


def wide_blur(a: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 6:
        return gaussian(a, sigma)
    k, (h, w) = min(8.0, max(1.0, sigma / 4)), a.shape[:2]
    small = resize(a, max(1, int(w / k)), max(1, int(h / k)), "triangle")
    return resize(gaussian(small, sigma / k), w, h, "triangle")


def clarity_sigma(height: int, width: int) -> float:
    return min(60.0, max(4.0, min(height, width) / 60))


def clarity(a: np.ndarray, amount: float) -> np.ndarray:
    s = min(1.0, max(-1.0, amount / 100))
    return a if s == 0 else raised(a, wide_blur(a, clarity_sigma(*a.shape[:2])), s)


def raised(a: np.ndarray, blurred: np.ndarray, s: float) -> np.ndarray:
    return bytes_of(a + (a - blurred) * 0.6 * s)


def inscribed(w: float, h: float, angle: float) -> tuple[float, float]:
    """Sides of the largest upright rectangle inside a turned frame (``scalar.inscribed`` for numbers)."""
    if w <= 0 or h <= 0:
        return 0.0, 0.0
    s, c, short = abs(math.sin(angle)), abs(math.cos(angle)), min(w, h)
    if short <= 2.0 * s * c * max(w, h) or abs(s - c) < 1e-10:  # only two of its corners touch the frame
        across, along = 0.5 * short / max(s, 1e-6), 0.5 * short / max(c, 1e-6)
        return (across, along) if w >= h else (along, across)
    d = c * c - s * s
    return (w * c - h * s) / d, (h * c - w * s) / d


def turn_of(slider: float) -> float:
    """The angle of a slider, up to ten degrees; none below a hundredth of one."""
    angle = math.radians(STRAIGHTEN_DEGREES * min(1.0, max(-1.0, slider / 100)))
    return angle if abs(math.degrees(angle)) >= 0.01 else 0.0


def upright(height: int, width: int, angle: float) -> tuple[int, int, int, int]:
    """Top, left, height and width of what a turned frame keeps."""
    w, h = (max(1, min(int(v * 0.985), m)) for v, m in zip(inscribed(width, height, angle), (width, height)))
    return (height - h) // 2, (width - w) // 2, h, w


def turned_from(y, x, height: int, width: int, angle: float):
    """(row, column) of the frame that the places (y, x) of the turned frame come from."""
    s, c = math.sin(angle), math.cos(angle)
    dx, dy = x - (width - 1) / 2, y - (height - 1) / 2
    return -s * dx + c * dy + (height - 1) / 2, c * dx + s * dy + (width - 1) / 2


def turned(part: np.ndarray, y, x, height: int, width: int, angle: float, top: int = 0, left: int = 0) -> np.ndarray:
    """Bytes of the places (y, x) of the turned frame, by bilinear mixing out of a part of the frame that begins at (top, left)."""
    sy, sx = turned_from(y, x, height, width, angle)
    inside = (sx >= 0) & (sy >= 0) & (sx <= width - 1) & (sy <= height - 1)
    x0, y0 = np.clip(np.floor(sx).astype(int), 0, width - 1), np.clip(np.floor(sy).astype(int), 0, height - 1)
    x1, y1 = np.minimum(x0 + 1, width - 1), np.minimum(y0 + 1, height - 1)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    a = lambda j, i: part[np.clip(j - top, 0, part.shape[0] - 1), np.clip(i - left, 0, part.shape[1] - 1)].astype(float)
    out = (a(y0, x0) * (1 - fx) + a(y0, x1) * fx) * (1 - fy) + (a(y1, x0) * (1 - fx) + a(y1, x1) * fx) * fy
    out[~inside] = 0
    return bytes_of(out)


def straighten(a: np.ndarray, slider: float) -> np.ndarray:
    """Turned about its centre by up to ten degrees and cut to what has no border, some rows at a time."""
    angle, (h, w) = turn_of(slider), a.shape[:2]
    if not angle:
        return a
    top, left, ch, cw = upright(h, w, angle)
    rows = max(1, 500_000 // cw)
    parts = [turned(a, *np.mgrid[y : min(y + rows, top + ch), left : left + cw], h, w, angle) for y in range(top, top + ch, rows)]
    return np.concatenate(parts)


def heal(a: np.ndarray, stamps: list[tuple[float, float, float]]) -> np.ndarray:
    """Spots (x, y, r in widths) one after the other: the disc is refilled from the nearby place whose ring
    matches best, with that place's gradients and this one's rim."""
    out, (h, w) = a.astype(float).copy(), a.shape[:2]
    for fx, fy, fr in stamps:
        r = int(min(max(2.0, math.floor(fr * w + 0.5)), min(w, h) / 3))
        cx, cy = math.floor(fx * w + 0.5), math.floor(fy * w + 0.5)
        if r < 1 or cx - r - 1 < 0 or cy - r - 1 < 0 or cx + r + 1 >= w or cy + r + 1 >= h:
            continue
        big = int(1.5 * r)
        dy, dx = np.mgrid[-big : big + 1, -big : big + 1]
        ring = (dx * dx + dy * dy >= r * r) & (dx * dx + dy * dy <= big * big)
        ry, rx = dy[ring], dx[ring]
        # the ring may leave the frame, where it is not compared
        here = (cx + rx >= 0) & (cy + ry >= 0) & (cx + rx < w) & (cy + ry < h)
        ry, rx = ry[here], rx[here]
        if not len(rx):
            continue
        best = None
        for far in (3.0, 5.0, 8.0):
            for k in range(12):
                sx, sy = cx + int(far * r * math.cos(k * math.tau / 12)), cy + int(far * r * math.sin(k * math.tau / 12))
                if sx - big >= 0 and sy - big >= 0 and sx + big < w and sy + big < h and sx - r >= 1 and sy - r >= 1 and sx + r + 1 < w and sy + r + 1 < h:
                    cost = float(((out[cy + ry, cx + rx] - out[sy + ry, sx + rx]) ** 2).mean())
                    if best is None or cost < best[0]:
                        best = cost, sx, sy
        if best is None:
            continue
        _, sx, sy = best
        box = (slice(cy - r - 1, cy + r + 2), slice(cx - r - 1, cx + r + 2))
        s, t = out[sy - r - 1 : sy + r + 2, sx - r - 1 : sx + r + 2], out[box].copy()
        lap = 4 * s[1:-1, 1:-1] - s[:-2, 1:-1] - s[2:, 1:-1] - s[1:-1, :-2] - s[1:-1, 2:]
        # a sweep uses the values it has just set, above and to the left: cells of an anti-diagonal go together
        yy, xx = np.nonzero(np.add.outer(np.arange(-r, r + 1) ** 2, np.arange(-r, r + 1) ** 2) <= r * r)
        lines = [(yy[m] + 1, xx[m] + 1, lap[yy[m], xx[m]]) for m in (yy + xx == d for d in np.unique(yy + xx))]
        for _ in range(POISSON_SWEEPS):
            for y, x, own in lines:
                t[y, x] = (t[y - 1, x] + t[y + 1, x] + t[y, x - 1] + t[y, x + 1] + own) / 4
        out[box] = t
        out = np.clip(np.floor(out + 0.5), 0, 255)
    return out.astype(np.uint8)


def perceptual_hash(a: np.ndarray) -> int:
    g = resize(gray(a)[..., None], 32, 32, "area")[..., 0]
    n = np.arange(32)
    dct = np.cos(np.pi / 32 * (n[None, :] + 0.5) * n[:8, None])
    low = (dct @ g @ dct.T).ravel()
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">i8")[0])


def hashes(images: DataFrame) -> DataFrame:
    """(image_id, phash, blur) of packed images, each read once."""

    def run(batches):
        import pandas as pd

        for b in batches:
            a = [array(r) for r in b.itertuples()]
            hashes = pd.array([None if x is None else perceptual_hash(x) for x in a], dtype="Int64")
            yield pd.DataFrame({"image_id": b.image_id, "phash": hashes, "blur": [None if x is None else normalised_blur(x) for x in a]})

    return images.select("image_id", "width", "height", "data").mapInPandas(run, "image_id long, phash long, blur double")
