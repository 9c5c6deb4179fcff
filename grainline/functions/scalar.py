"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import CROP, IMAGE_EXTENSIONS, LEFT_EYE, RAW_EXTENSIONS, RIGHT_EYE, SLIDERS


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo).cast("double") if not isinstance(lo, Column) else lo, F.least(F.lit(hi).cast("double") if not isinstance(hi, Column) else hi, x))


def strength(s: Column) -> Column:
    return clamp(s / 100.0, 0.0, 1.0)


def bipolar(s: Column) -> Column:
    return clamp(s / 100.0, -1.0, 1.0)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def smoothstep(e0: float | Column, e1: float | Column, x: Column) -> Column:
    t = clamp((x - e0) / (F.lit(e1) - F.lit(e0)), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def to_byte(v: Column) -> Column:
    """0..1 to 0..255, rounding half away from zero."""
    return F.round(clamp(v, 0.0, 1.0) * 255.0).cast("int")


def hue_rgb(hue: Column) -> tuple[Column, Column, Column]:
    """The saturated colour of a hue in degrees."""
    h = F.pmod(hue, F.lit(360.0)) / 60.0
    x = 1.0 - F.abs(F.pmod(h, F.lit(2.0)) - 1.0)
    k = F.floor(h)

    def pick(*six):
        c = F.lit(six[5])
        for i in range(4, -1, -1):
            c = F.when(k == i, six[i]).otherwise(c)
        return c

    one, no = F.lit(1.0), F.lit(0.0)
    return pick(one, x, no, no, x, one), pick(x, one, one, x, no, no), pick(no, no, x, one, one, x)


def inscribed(w: Column, h: Column, angle: Column) -> tuple[Column, Column]:
    """Sides of the largest upright rectangle inside a w by h frame turned by an angle in radians."""
    s, c = F.abs(F.sin(angle)), F.abs(F.cos(angle))
    long, short = F.greatest(w, h), F.least(w, h)
    thin = (short <= 2.0 * s * c * long) | (F.abs(s - c) < 1e-10)
    by_s, by_c = 0.5 * short / F.greatest(s, F.lit(1e-6)), 0.5 * short / F.greatest(c, F.lit(1e-6))
    d = c * c - s * s
    none = (w <= 0) | (h <= 0)
    wide = w >= h
    out_w = F.when(thin, F.when(wide, by_s).otherwise(by_c)).otherwise((w * c - h * s) / d)
    out_h = F.when(thin, F.when(wide, by_c).otherwise(by_s)).otherwise((h * c - w * s) / d)
    return F.when(none, 0.0).otherwise(out_w), F.when(none, 0.0).otherwise(out_h)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def eye_aspect(p: Column) -> Column:
    """Of six eye points; an eye without width has 0."""
    q = [F.get(p, F.lit(i)) for i in range(6)]
    wide = distance(q[0], q[3])
    return F.when(wide <= 0, 0.0).otherwise((distance(q[1], q[5]) + distance(q[2], q[4])) / (2.0 * wide))


def eyes(landmarks: Column, threshold: float) -> Column:
    """left_ear, right_ear, both_closed, any_closed; null for too few landmarks (fewer than 388)."""
    need = max(LEFT_EYE + RIGHT_EYE) + 1

    def ear(at):
        return eye_aspect(F.array(*[F.get(landmarks, F.lit(i)) for i in at]))

    left, right = ear(LEFT_EYE), ear(RIGHT_EYE)
    lo, ro = left <= threshold, right <= threshold
    return F.when(
        F.size(landmarks) >= need,
        F.struct(left.alias("left_ear"), right.alias("right_ear"), (lo & ro).alias("both_closed"), (lo | ro).alias("any_closed")),
    )


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x, y, w, h)."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union <= 0, 0.0).otherwise(w * h / union)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def extension(path: Column) -> Column:
    """Lower-case extension of the last path segment, null where there is none."""
    e = F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1)
    return F.when(e != "", F.lower(e))


def is_supported(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*IMAGE_EXTENSIONS), F.lit(False))


def is_raw(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*RAW_EXTENSIONS), F.lit(False))


def is_one_of(path: Column, kinds: tuple[str, ...]) -> Column:
    """Whether a path's ending is in a list: what a dialog offers (``DIALOG_EXTENSIONS``), what probes of a folder
    (``STANDARD_EXTENSIONS``) or of faces (``FACE_PROBE_EXTENSIONS``) take."""
    return F.coalesce(extension(path).isin(*kinds), F.lit(False))


def is_scale_sample(path: Column) -> Column:
    """The probe of scales takes face crops: png in small letters only."""
    return F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1) == "png"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def crop_active(p: Column) -> Column:
    x, y, w, h = (p[n] for n in CROP)
    return (w > 0.001) & (h > 0.001) & ((x > 0.001) | (y > 0.001) | (w < 0.999) | (h < 0.999))


def is_noop(p: Column) -> Column:
    quiet = F.lit(True)
    for n in SLIDERS:
        quiet = quiet & (F.abs(p[n]) < 0.01)
    return quiet & ~crop_active(p)


def retouch_empty(heals: Column) -> Column:
    return F.forall(heals, lambda s: F.size(s["stamps"]) == 0)


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def folder_base(path: Column) -> Column:
    """Last non-empty path segment, else Untitled."""
    parts = F.filter(F.split(path, r"[\\/]"), lambda s: s != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("Untitled"))
