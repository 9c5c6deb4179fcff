"""The whole edit of packed images: geometry, colour, filters, retouch and crop in their order, previews and watermarks.

Photos of many megapixels stay packed: an Arrow batch of images goes through numpy, one image at a time. The
point-wise steps give what ``pixels.render`` gives on pixel relations. A row without pixels (an undecodable
file) passes through as it is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..types import CROP, EXPOSURE_TARGET, PACKED, PREVIEW, REVIEW, SLIDERS, THUMBNAIL
from . import kernels

LUMA = np.array([0.299, 0.587, 0.114])


def _unit(v: float) -> float:
    return min(1.0, max(0.0, v / 100.0))


def _signed(v: float) -> float:
    return min(1.0, max(-1.0, v / 100.0))


def _smooth(a: float, b: float, x):
    t = np.clip((x - a) / (b - a), 0.0, 1.0) if a != b else (x >= a) * 1.0
    return t * t * (3.0 - 2.0 * t)


def luma_counts(luma: np.ndarray) -> np.ndarray:
    return np.bincount((np.clip(luma, 0, 1) * 255.0).astype(int).ravel(), minlength=256)


def _percentile(counts: np.ndarray, share: float) -> float:
    """First of 256 bins whose running count reaches the truncated share."""
    at = np.flatnonzero(np.cumsum(counts) >= int(share * counts.sum()))
    return (int(at[0]) if len(at) else 255) / 255.0


def hue(degrees: float) -> np.ndarray:
    """The saturated colour of a hue."""
    return np.array([min(1.0, max(0.0, abs((degrees / 60.0 + k) % 6.0 - 3.0) - 1.0)) for k in (0.0, 4.0, 2.0)])


def means(a: np.ndarray) -> np.ndarray:
    """Mean of each channel, 0 to 1, from whole sums."""
    return a.sum((0, 1), dtype=np.int64) / (255.0 * max(1, a.shape[0] * a.shape[1]))


def exposed(v: np.ndarray, p: dict, mean: np.ndarray) -> np.ndarray:
    """Pixels (0 to 1) after the balance of colours and the exposure, which know of the image its channels' means: one factor a channel."""
    g = lambda n: float(p.get(n) or 0.0)
    factor, k = np.ones(3), _unit(g("auto_white_balance"))
    if k > 0 and (mean > 0).all():
        factor = factor * (1.0 + k * (np.clip(mean.mean() / mean, 0.5, 2.0) - 1.0))
    warm, tint = _signed(g("temperature")), _signed(g("tint"))
    factor = factor * np.array([1.0 + 0.3 * warm, 1.0 - 0.2 * tint, 1.0 - 0.3 * warm])
    k, bright = _unit(g("auto_exposure")), float((factor * mean) @ LUMA)
    if k > 0 and bright > 0:
        factor = factor * (1.0 + k * (min(3.0, max(0.33, EXPOSURE_TARGET / bright)) - 1.0))
    return v * (factor * 2.0 ** (2.0 * _signed(g("exposure"))))


def toned(v: np.ndarray, p: dict, counts: np.ndarray | None, top: int, left: int, height: int, width: int) -> np.ndarray:
    """Bytes of exposed pixels after all other point-wise steps; counts: the whole image's ``luma_counts`` then, where
    contrast is automatic; top and left: the part's place in the image of that height and width."""
    g = lambda n: float(p.get(n) or 0.0)
    k = _unit(g("auto_contrast"))
    if k > 0:
        lo, hi = _percentile(counts, 0.01), _percentile(counts, 0.99)
        if hi > lo:
            v = v + ((v - lo) / (hi - lo) - v) * k
    luma = (v @ LUMA)[..., None]
    v = (v - 0.5) * (1.0 + _signed(g("contrast"))) + 0.5
    v = v * (1.0 + _signed(g("highlights")) * 0.4 * _smooth(0.5, 1.0, luma)) * (1.0 + _signed(g("shadows")) * 0.5 * _smooth(0.5, 0.0, luma))
    v = v + _signed(g("whites")) * 0.22 * _smooth(0.72, 1.0, luma) + _signed(g("blacks")) * 0.22 * _smooth(0.28, 0.0, luma)
    luma = np.clip(v @ LUMA, 0.0, 1.0)[..., None]
    v = v + (1.0 - luma) * _unit(g("shadow_sat")) * 0.5 * (hue(g("shadow_hue")) - 0.5) + luma * _unit(g("highlight_sat")) * 0.5 * (hue(g("highlight_hue")) - 0.5)
    luma, spread = (v @ LUMA)[..., None], np.clip(v.max(2) - v.min(2), 0.0, 1.0)[..., None]
    v = luma + (v - luma) * (1.0 + _signed(g("vibrance")) * (1.0 - spread))
    v = luma + (v - luma) * (1.0 + _signed(g("saturation")))
    amount = _signed(g("vignette_amount"))
    if amount:
        h, w = v.shape[:2]
        y, x = np.mgrid[top : top + h, left : left + w]
        far = np.hypot(x - width / 2.0, y - height / 2.0) / max(1.0, float(np.hypot(width / 2.0, height / 2.0)))
        v = v * (1.0 + amount * 0.8 * _smooth(_unit(g("vignette_midpoint")), 1.0, far))[..., None]
    return kernels.bytes_of(np.clip(v, 0.0, 1.0) * 255.0)


def colour(a: np.ndarray, p: dict) -> np.ndarray:
    """All colour steps of bytes: noise reduction first, then the point-wise steps, then clarity and sharpening."""
    g = lambda n: float(p.get(n) or 0.0)
    a = kernels.denoise(a, g("noise_reduction"))
    v = exposed(a / 255.0, p, means(a))
    out = toned(v, p, luma_counts(v @ LUMA) if _unit(g("auto_contrast")) > 0 else None, 0, 0, *a.shape[:2])
    return kernels.sharpen(kernels.clarity(out, g("clarity")), g("sharpening"))


def crop_box(p: dict, height: int, width: int) -> tuple[int, int, int, int]:
    """Top, left, bottom and right of the crop: places truncated, sizes rounded, one pixel at least; a full frame or none is the image."""
    x, y, w, h = (float(p.get(n) or 0.0) for n in CROP)
    if not (w > 0.001 and h > 0.001 and (x > 0.001 or y > 0.001 or w < 0.999 or h < 0.999)):
        return 0, 0, height, width
    x0, y0 = min(width - 1, int(min(1.0, max(0.0, x)) * width)), min(height - 1, int(min(1.0, max(0.0, y)) * height))
    return y0, x0, min(height, y0 + max(1, int(h * height + 0.5))), min(width, x0 + max(1, int(w * width + 0.5)))


def cropped(a: np.ndarray, p: dict) -> np.ndarray:
    top, left, bottom, right = crop_box(p, *a.shape[:2])
    return a[top:bottom, left:right]


def full(a: np.ndarray, p: dict, heals=(), crop: bool = True) -> np.ndarray:
    """Straighten, colour, heal (strokes of stamps, in order), crop."""
    out = colour(kernels.straighten(a, float(p.get("straighten") or 0.0)), p)
    some = lambda x: () if x is None else x  # noqa: E731 - lists may come as arrays, which have no truth
    stamps = [(s["x"], s["y"], s["r"]) for stroke in some(heals) for s in some(stroke["stamps"])]
    out = kernels.heal(out, stamps) if stamps else out
    return cropped(out, p) if crop else out


def _params(row) -> dict:
    p = getattr(row, "params", None)
    p = p.asDict() if hasattr(p, "asDict") else p
    return {n: p[n] for n in SLIDERS + CROP if n in p} if p is not None else {}


def render_full(images: DataFrame, edge: int | None = None, crop: bool = True) -> DataFrame:
    """images (PACKED, with params and heals) after the whole edit; null params or heals are none. ``edge`` shrinks first."""

    def edited(r):
        a = kernels.array(r)
        if a is not None:
            a = full(kernels.fit(a, edge) if edge else a, _params(r), r.heals if r.heals is not None else (), crop)
        return kernels.row(r, a)

    def run(batches):
        for b in batches:
            yield from kernels.tables(map(edited, b.itertuples()))

    return images.select("image_id", "width", "height", "data", "params", "heals").mapInPandas(run, PACKED)


def auto_edit(images: DataFrame) -> DataFrame:
    """The edit without retouch: straighten, colour, crop."""
    from pyspark.sql import functions as F

    return render_full(images.withColumn("heals", F.lit(None).cast("array<struct<stamps:array<struct<x:float,y:float,r:float>>>>")))


def preview(images: DataFrame, crop_preview: bool = False, edge: int = PREVIEW, id: str = "image_id long") -> DataFrame:
    """image_id, before and after (JPEG files, null without pixels) of images with params and heals at preview size:
    before has the geometry only, so that both show the same frame; while a crop is drawn both stay uncropped."""
    from ..sources import jpeg

    def run(batches):
        import pandas as pd

        for b in batches:
            for r in b.itertuples():
                a = kernels.array(r)
                if a is None:
                    yield pd.DataFrame({"image_id": [r.image_id], "before": [None], "after": [None]})
                    continue
                p, small = _params(r), kernels.fit(a, edge)
                before = kernels.straighten(small, float(p.get("straighten") or 0.0))
                before = before if crop_preview else cropped(before, p)
                after = full(small, p, r.heals if r.heals is not None else (), not crop_preview)
                yield pd.DataFrame({"image_id": [r.image_id], "before": [jpeg.encode(before)], "after": [jpeg.encode(after)]})

    return images.select("image_id", "width", "height", "data", "params", "heals").mapInPandas(run, f"{id}, before binary, after binary")


def sized(images: DataFrame, edge: int) -> DataFrame:
    """Images with a long edge of at most ``edge``; smaller ones stay."""
    return kernels.each(images, lambda a: kernels.fit(a, edge))


def thumbnails(images: DataFrame) -> DataFrame:
    return sized(images, THUMBNAIL)


def review(images: DataFrame) -> DataFrame:
    return sized(images, REVIEW)


def encoded(images: DataFrame, edge: int | None = None, quality: int = 75) -> DataFrame:
    """image_id and jpeg (null without pixels) of images, shrunk to ``edge`` first: 320 for thumbnails, 1400 and quality 88 for review."""
    return encodings(images, {"jpeg": (edge, quality)})


def encodings(images: DataFrame, sizes: dict[str, tuple[int | None, int]], before=None) -> DataFrame:
    """image_id and a JPEG file (null without pixels) for each name of ``sizes`` (edge, quality) of images, to which ``before``
    (pixels to pixels) is applied first. Images are looked at once, one at a time, and only their files leave the task."""
    from ..sources import jpeg

    def run(batches):
        import pandas as pd

        for b in batches:
            for r in b.itertuples():
                a = kernels.array(r)
                a = a if a is None or before is None else before(a)
                files = {n: [None if a is None else jpeg.encode(kernels.fit(a, edge) if edge else a, quality)] for n, (edge, quality) in sizes.items()}
                yield pd.DataFrame({"image_id": [r.image_id]} | files)

    return images.select("image_id", "width", "height", "data").mapInPandas(run, "image_id long" + "".join(f", `{n}` binary" for n in sizes))


def place(where: str, w: int, h: int, ew: int, eh: int, margin: int) -> tuple[int, int]:
    """Top left corner of a watermark; unknown places are bottomRight."""
    x = margin if where in ("topLeft", "bottomLeft") else int((w - ew) / 2) if where == "center" else w - ew - margin
    y = margin if where in ("topLeft", "topRight") else int((h - eh) / 2) if where == "center" else h - eh - margin
    return x, y


def stamp_image(a: np.ndarray, mark: np.ndarray, where: str, opacity: float, size: float) -> np.ndarray:
    """Blends an RGBA overlay in, scaled to a tenth to half of the width; what leaves the frame falls away."""
    h, w = a.shape[:2]
    tw = int(max(1.0, w * (0.1 + _unit(size) * 0.4)))
    th = int(max(1.0, mark.shape[0] * (tw / max(1, mark.shape[1]))))
    mark = kernels.bytes_of(kernels.resize(mark, tw, th, "triangle"))
    x, y = place(where, w, h, tw, th, int(max(6.0, w * 0.02)))
    x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + tw), min(h, y + th)
    out = a.copy()
    if x0 < x1 and y0 < y1:
        part = mark[y0 - y : y1 - y, x0 - x : x1 - x].astype(float)
        k = part[..., 3:] / 255.0 * _unit(opacity)
        out[y0:y1, x0:x1] = kernels.bytes_of(out[y0:y1, x0:x1] * (1.0 - k) + part[..., :3] * k)
    return out


def stamp_text(a: np.ndarray, text: str, font, where: str, opacity: float, size: float) -> np.ndarray:
    """Blends white text in, two to ten hundredths of the height tall and nine pixels at least; what leaves the frame falls away."""
    from ..sources import fonts

    h, w = a.shape[:2]
    tw, th, mask, left, top = fonts.text_mask(font, text, max(9.0, h * (0.02 + _unit(size) * 0.08)))
    x, y = place(where, w, h, tw, th, int(max(6.0, h * 0.02)))
    x, y, out = x + left, y + top, a.copy()
    x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + mask.shape[1]), min(h, y + mask.shape[0])
    if x0 < x1 and y0 < y1:
        k = np.rint(mask[y0 - y : y1 - y, x0 - x : x1 - x] * 255.0)[..., None] / 255.0 * _unit(opacity)
        out[y0:y1, x0:x1] = kernels.bytes_of(out[y0:y1, x0:x1] * (1.0 - k) + 255.0 * k)
    return out


def watermark(a: np.ndarray, mark: dict | None, overlay: np.ndarray | None = None, font=None) -> np.ndarray:
    """Dispatch by kind: an image or a text is blended; blank text, a missing image and unknown kinds leave the pixels.
    Text needs a ``fonts.Font``."""
    if not mark or mark.get("kind") not in ("text", "image"):
        return a
    where, opacity, size = mark.get("position", ""), mark.get("opacity", 100.0), mark.get("size", 50.0)
    if mark["kind"] == "image":
        return a if overlay is None else stamp_image(a, overlay, where, opacity, size)
    text = (mark.get("text") or "").strip()
    if text and font is None:
        raise ValueError("no font found for the text watermark")
    return stamp_text(a, text, font, where, opacity, size) if text else a
