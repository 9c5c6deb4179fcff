"""Edits of large photos a tile at a time.

A photo is rows of tiles of 512 by 512 pixels. A step makes new tiles, each from a box of the old ones that it names: itself and
a margin for filters, a turned box for straightening, a scaled one for resampling. Old tiles meet the new ones that need them
by an equi-join on the tile's place, and each new tile is made in a group of the few that its box touches, so no
task holds a photo. What a step knows of the whole photo (channel means, brightness counts) comes from aggregates over
tiles, in whole numbers. Results are those of the whole photo's edit (``render``). Retouch is not among the steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import CROP, PACKED, SLIDERS
from . import kernels, render
from .groups import written

TILE = 512
ROWS = "image_id long, ty int, tx int, height int, width int, data binary"
NEW = "image_id long, oy int, ox int, top int, left int, bottom int, right int, oh int, ow int"
#: Parameters by place; two more are the size of a photo whose tiles are those of a shrunk one.
NAMES = (*SLIDERS, *CROP, "fh", "fw")


def split(images: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles (image_id, ty, tx, height and width of the photo, data) of packed photos; those without pixels have none."""

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                a = kernels.array(r)
                if a is None:
                    continue
                h, w = a.shape[:2]
                for y in range(0, h, size):
                    for x in range(0, w, size):
                        yield pd.DataFrame([(r.image_id, y // size, x // size, h, w, np.ascontiguousarray(a[y : y + size, x : x + size]).tobytes())], columns=["image_id", "ty", "tx", "height", "width", "data"])

    return images.select("image_id", "width", "height", "data").mapInPandas(run, ROWS)


def joined(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """Packed photos of their tiles, for photos that fit into a task."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        h, w = int(t.height.iloc[0]), int(t.width.iloc[0])
        out = np.empty((h, w, 3), np.uint8)
        for ty, tx, data in zip(t.ty, t.tx, t.data):
            y, x = ty * size, tx * size
            th, tw = min(size, h - y), min(size, w - x)
            out[y : y + th, x : x + tw] = np.frombuffer(data, np.uint8).reshape(th, tw, 3)
        return pd.DataFrame([(t.image_id.iloc[0], w, h, out.tobytes())], columns=["image_id", "width", "height", "data"])

    return tiles.groupBy("image_id").applyInPandas(run, PACKED)


def step(tiles: DataFrame, params: DataFrame, shape: Callable, box: Callable, make: Callable, size: int = TILE, kind: str = "u1", out: str = "u1", own: DataFrame | None = None) -> DataFrame:
    """New tiles. For a photo of height h and width w with params p, ``shape(h, w, p)`` is the new height and width, ``box(y0, x0,
    y1, x1, h, w, p)`` what is needed of the old photo for such a part of the new one, and ``make(part, top, left, y0, x0, y1, x1,
    h, w, p, mine)`` makes it. ``kind`` and ``out`` are the numbers of old and new tiles; ``mine`` is the tile of ``own``, tiles of the
    new shape, at the same place."""
    photos = tiles.select("image_id", "height", "width").distinct().join(params, "image_id")

    def plan(batches):
        for b in batches:
            for r in b.itertuples():
                p = dict(zip(NAMES, r.p))
                oh, ow = shape(r.height, r.width, p)
                rows = []
                for y in range(0, oh, size):
                    for x in range(0, ow, size):
                        rows.append((r.image_id, y // size, x // size, *box(y, x, min(y + size, oh), min(x + size, ow), r.height, r.width, p), oh, ow))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in NEW.split(", ")])

    new = photos.select("image_id", "height", "width", "p").mapInPandas(plan, NEW)
    along = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor((F.col(b) - 1) / size).cast("int")))
    need = new.withColumn("ty", along("top", "bottom")).withColumn("tx", along("left", "right"))
    met = need.join(tiles, ["image_id", "ty", "tx"]).join(params, "image_id").withColumn("mine", F.lit(False))
    paired = own is not None
    if paired:
        names = met.columns
        mine = new.withColumns({"ty": F.col("oy"), "tx": F.col("ox")}).join(own.select("image_id", "ty", "tx", F.lit(0).alias("height"), F.lit(0).alias("width"), "data"), ["image_id", "ty", "tx"])
        met = met.unionByName(mine.join(params, "image_id").withColumn("mine", F.lit(True)).select(*names))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        old = t[~t.mine]
        r = old.iloc[0]
        h, w, p = int(r.height), int(r.width), dict(zip(NAMES, r.p))
        top, left, bottom, right = (int(r[c]) for c in ("top", "left", "bottom", "right"))
        part = np.zeros((bottom - top, right - left, 3), kind)
        for ty, tx, data in zip(old.ty, old.tx, old.data):
            y, x = ty * size, tx * size
            a = np.frombuffer(data, kind).reshape(min(size, h - y), min(size, w - x), 3)
            y0, x0, y1, x1 = max(y, top), max(x, left), min(y + a.shape[0], bottom), min(x + a.shape[1], right)
            part[y0 - top : y1 - top, x0 - left : x1 - left] = a[y0 - y : y1 - y, x0 - x : x1 - x]
        oh, ow, y0, x0 = int(r.oh), int(r.ow), int(r.oy) * size, int(r.ox) * size
        y1, x1 = min(y0 + size, oh), min(x0 + size, ow)
        mine = None if not paired else np.frombuffer(t[t.mine].data.iloc[0], np.uint8).reshape(y1 - y0, x1 - x0, 3)
        a = make(part, top, left, y0, x0, y1, x1, h, w, p, mine)
        return pd.DataFrame([(r.image_id, int(r.oy), int(r.ox), oh, ow, np.ascontiguousarray(a, out).tobytes())], columns=["image_id", "ty", "tx", "height", "width", "data"])

    return met.groupBy("image_id", "oy", "ox").applyInPandas(run, ROWS)


def filtered(tiles: DataFrame, params: DataFrame, fn: Callable, margin: Callable, size: int = TILE, kind: str = "u1") -> DataFrame:
    """Tiles after a filter fn(part, h, w, p) that looks ``margin(h, w, p)`` pixels around."""

    def box(y0, x0, y1, x1, h, w, p):
        m = margin(h, w, p)
        return max(0, y0 - m), max(0, x0 - m), min(h, y1 + m), min(w, x1 + m)

    def make(part, top, left, y0, x0, y1, x1, h, w, p, _):
        return fn(part, h, w, p)[y0 - top : y1 - top, x0 - left : x1 - left]

    return step(tiles, params, lambda h, w, p: (h, w), box, make, size, kind, kind)


def straightened(tiles: DataFrame, params: DataFrame, size: int = TILE) -> DataFrame:
    angle = lambda p: kernels.turn_of(float(p["straighten"]))

    def shape(h, w, p):
        return kernels.upright(h, w, angle(p))[2:] if angle(p) else (h, w)

    def box(y0, x0, y1, x1, h, w, p):
        if not angle(p):
            return y0, x0, y1, x1
        top, left = kernels.upright(h, w, angle(p))[:2]
        corners = [kernels.turned_from(y + top, x + left, h, w, angle(p)) for y in (y0, y1 - 1) for x in (x0, x1 - 1)]
        low = [max(0, min(int(np.floor(min(c[i] for c in corners))), n - 1)) for i, n in ((0, h), (1, w))]
        high = [max(1, min(int(np.floor(max(c[i] for c in corners))) + 2, n)) for i, n in ((0, h), (1, w))]
        return *low, *high

    def make(part, at, by, y0, x0, y1, x1, h, w, p, _):
        if not angle(p):
            return part
        top, left = kernels.upright(h, w, angle(p))[:2]
        return kernels.turned(part, *np.mgrid[y0 + top : y1 + top, x0 + left : x1 + left], h, w, angle(p), at, by)

    return step(tiles, params, shape, box, make, size)


def pointwise(tiles: DataFrame, params: DataFrame, size: int = TILE) -> DataFrame:
    """Balance, exposure, tone, colour and vignette, by the photo's means and counts from aggregates over its tiles."""

    def measure(batches):
        for b in batches:
            for r in b.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(-1, 3)
                yield pd.DataFrame([(r.image_id, *a.sum(0, dtype=np.int64).tolist(), len(a))], columns=["image_id", "r", "g", "b", "n"])

    sums = tiles.select("image_id", "data").mapInPandas(measure, "image_id long, r long, g long, b long, n long")
    mean = [(F.sum(c) / (255.0 * F.sum("n"))) for c in "rgb"]
    known = params.join(sums.groupBy("image_id").agg(F.array(*mean).alias("mean")), "image_id")
    d = written(tiles.join(known, "image_id"))

    def pixels(r):
        h, w, y, x = int(r.height), int(r.width), int(r.ty) * size, int(r.tx) * size
        p = dict(zip(NAMES, r.p))
        v = render.exposed(np.frombuffer(r.data, np.uint8).reshape(min(size, h - y), min(size, w - x), 3) / 255.0, p, np.array(r.mean))
        return v, p, y, x, h, w

    def count(batches):
        for b in batches:
            for r in b.itertuples():
                n = render.luma_counts(pixels(r)[0] @ render.LUMA)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"image_id": r.image_id, "bin": at, "n": n[at]})

    # 256 rows a photo at most
    bins = d.where(F.col("p")[NAMES.index("auto_contrast")] > 0).mapInPandas(count, "image_id long, bin int, n long").groupBy("image_id", "bin").agg(F.sum("n").alias("n"))
    bins = bins.groupBy("image_id").agg(F.collect_list(F.struct("bin", "n")).alias("counts"))

    def make(batches):
        for b in batches:
            for r in b.itertuples():
                v, p, y, x, h, w = pixels(r)
                counts = np.zeros(256, np.int64)
                for c in r.counts if r.counts is not None else ():
                    counts[c["bin"]] = c["n"]
                a = render.toned(v, p, counts, y, x, h, w)
                yield pd.DataFrame([(r.image_id, r.ty, r.tx, h, w, a.tobytes())], columns=["image_id", "ty", "tx", "height", "width", "data"])

    return d.join(bins, "image_id", "left").mapInPandas(make, ROWS)


def clarity(tiles: DataFrame, params: DataFrame, size: int = TILE) -> DataFrame:
    """Local contrast over a wide blur: a shrunk photo is blurred and brought back, in tiles all along. Photos with a narrow
    blur and those with a wide one take their own ways."""
    amount = lambda p: min(1.0, max(-1.0, p["clarity"] / 100))
    wide = F.least(F.col("height"), F.col("width")) / 60 > 6
    near, far = tiles.where(~wide), tiles.where(wide)

    def narrow(part, h, w, p):
        return part if amount(p) == 0 else kernels.raised(part, kernels.gaussian(part, kernels.clarity_sigma(h, w)), amount(p))

    near = filtered(near, params, narrow, lambda h, w, p: int(np.ceil(3 * kernels.clarity_sigma(h, w))), size)

    def scale(h, w):
        return min(8.0, max(1.0, kernels.clarity_sigma(h, w) / 4))

    def small(h, w):
        return max(1, int(h / scale(h, w))), max(1, int(w / scale(h, w)))

    def resampled(part, top, left, y0, x0, y1, x1, old, new):
        f, r = kernels._kernel("triangle")
        v = kernels._weights(old[0], new[0], r, f, (y0, y1), (top, top + part.shape[0]))
        u = kernels._weights(old[1], new[1], r, f, (x0, x1), (left, left + part.shape[1]))
        return np.tensordot(u, np.tensordot(v, part.astype(float), (1, 0)), (1, 1)).swapaxes(0, 1)

    def reach(y0, x0, y1, x1, old, new):
        (top, bottom), (left, right) = (kernels.reach(o, n, a, b, "triangle") for o, n, a, b in ((old[0], new[0], y0, y1), (old[1], new[1], x0, x1)))
        return top, left, bottom, right

    # the size of the photo goes with the shrunk one, which cannot tell it
    full = written(far.select("image_id", F.col("height").alias("fh"), F.col("width").alias("fw")).distinct())
    shrunk = step(
        far, params, lambda h, w, p: small(h, w), lambda y0, x0, y1, x1, h, w, p: reach(y0, x0, y1, x1, (h, w), small(h, w)),
        lambda part, top, left, y0, x0, y1, x1, h, w, p, _: resampled(part, top, left, y0, x0, y1, x1, (h, w), small(h, w)), size, "u1", "f8",
    )
    known = params.join(full, "image_id").select("image_id", F.concat("p", F.array(F.col("fh").cast("double"), F.col("fw").cast("double"))).alias("p"))
    size_of = lambda p: (int(p["fh"]), int(p["fw"]))
    sigma = lambda p: kernels.clarity_sigma(*size_of(p)) / scale(*size_of(p))
    soft = filtered(shrunk, known, lambda part, h, w, p: kernels.gaussian(part, sigma(p)), lambda h, w, p: int(np.ceil(3 * sigma(p))), size, "f8")
    raised = step(
        soft, known, lambda h, w, p: size_of(p), lambda y0, x0, y1, x1, h, w, p: reach(y0, x0, y1, x1, (h, w), size_of(p)),
        lambda part, top, left, y0, x0, y1, x1, h, w, p, mine: mine if amount(p) == 0 else kernels.raised(mine, resampled(part, top, left, y0, x0, y1, x1, (h, w), size_of(p)), amount(p)),
        size, "f8", "u1", far,
    )
    return near.unionByName(raised)


def edited(tiles: DataFrame, params: DataFrame, crop: bool = True, size: int = TILE) -> DataFrame:
    """Tiles of the whole edit but for retouch: straighten, noise reduction, colour, clarity, sharpening and crop. params: image_id and
    params, a struct with fields of ``SLIDERS`` and ``CROP``, null for none."""
    p = F.array(*[F.coalesce(F.col(f"params.{n}").cast("double"), F.lit(0.0)) for n in SLIDERS + CROP])
    params = written(params.select("image_id", p.alias("p")))
    t = written(tiles)
    t = written(straightened(t, params, size))
    t = filtered(t, params, lambda a, h, w, p: kernels.denoise(a, p["noise_reduction"]), lambda h, w, p: 2 if p["noise_reduction"] > 0 else 0, size)
    t = written(pointwise(written(t), params, size))
    t = written(clarity(t, params, size))
    t = filtered(t, params, lambda a, h, w, p: kernels.sharpen(a, p["sharpening"]), lambda h, w, p: 4 if p["sharpening"] > 0 else 0, size)
    if not crop:
        return t

    def box(y0, x0, y1, x1, h, w, p):
        top, left, _, _ = render.crop_box(p, h, w)
        return y0 + top, x0 + left, y1 + top, x1 + left

    def shape(h, w, p):
        top, left, bottom, right = render.crop_box(p, h, w)
        return bottom - top, right - left

    return step(written(t), params, shape, box, lambda part, *_: part, size)
