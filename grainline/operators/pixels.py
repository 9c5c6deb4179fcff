"""Pixel relations (image_id, y, x, r, g, b): sharpness, statistics and edits as expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bipolar, clamp, hue_rgb, luma, smoothstep, strength, to_byte
from ..types import BLUR_THRESHOLD, EXPOSURE_TARGET

RGB = ("r", "g", "b")


def _each(fn):
    return {c: fn(F.col(c)) for c in RGB}


def to_unit(px: DataFrame) -> DataFrame:
    return px.withColumns(_each(lambda v: v / 255.0))


def to_bytes(px: DataFrame) -> DataFrame:
    return px.withColumns(_each(to_byte))


def lum():
    return luma(F.col("r"), F.col("g"), F.col("b"))


def laplacian(gray: DataFrame) -> DataFrame:
    """Adds lap to (image_id, y, x, l): four neighbours, edges repeated."""
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    d = gray.withColumns({"_w": F.coalesce(F.lag("l").over(row), "l"), "_e": F.coalesce(F.lead("l").over(row), "l")})
    d = d.withColumns({"_n": F.coalesce(F.lag("l").over(col), "l"), "_s": F.coalesce(F.lead("l").over(col), "l")})
    return d.withColumn("lap", F.col("_w") + F.col("_e") + F.col("_n") + F.col("_s") - 4 * F.col("l")).drop("_w", "_e", "_n", "_s")


def blur(gray: DataFrame, threshold: float = BLUR_THRESHOLD) -> DataFrame:
    """score (population variance of the Laplacian) and is_blurry of each image."""
    score = F.coalesce(F.var_pop("lap"), F.lit(0.0))
    return laplacian(gray).groupBy("image_id").agg(score.alias("score")).withColumn("is_blurry", F.col("score") < threshold)


def region(gray: DataFrame, x: int, y: int, w: int, h: int, width: int, height: int) -> DataFrame:
    """The pixels of a box clamped to the frame, one pixel at least."""
    x, y = min(x, width - 1), min(y, height - 1)
    w, h = max(1, min(w, width - x)), max(1, min(h, height - y))
    return gray.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


def stats(px: DataFrame) -> DataFrame:
    dark = (F.col("r") < 3) & (F.col("g") < 3) & (F.col("b") < 3)
    return px.groupBy("image_id").agg(
        F.avg("r").alias("mean_r"), F.avg("g").alias("mean_g"), F.avg("b").alias("mean_b"), F.avg(lum() / 255.0).alias("mean_luma"),
        F.min(F.least(*RGB)).alias("min_byte"), F.max(F.greatest(*RGB)).alias("max_byte"), (100.0 * F.avg(dark.cast("double"))).alias("blank_percent"),
    )


def valid(px: DataFrame) -> DataFrame:
    s = stats(px)
    ok = (F.col("max_byte") - F.col("min_byte") > 25) & (F.col("mean_luma") > 0.02) & (F.col("mean_luma") < 0.98)
    return s.select("image_id", ok.alias("valid"))


def luma_histogram(unit: DataFrame) -> DataFrame:
    return unit.groupBy("image_id", F.floor(clamp(lum(), 0.0, 1.0) * 255.0).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def percentile_bin(hist: DataFrame, percent: float) -> DataFrame:
    """First bin whose running count reaches the truncated share of all; a share of 0 gives bin 0."""
    w = Window.partitionBy("image_id")
    d = hist.withColumn("total", F.sum("n").over(w)).withColumn("cum", F.sum("n").over(w.orderBy("bin")))
    goal = F.floor(F.lit(percent) * F.col("total"))
    first = F.when(F.max(goal) <= 0, 0).otherwise(F.coalesce(F.min(F.when(F.col("cum") >= goal, F.col("bin"))), F.lit(255)))
    return d.groupBy("image_id").agg(first.cast("int").alias("bin"))


def rgb_histogram(px: DataFrame) -> DataFrame:
    """64 bins a channel, scaled by the largest of the image."""
    long = px.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in RGB])).alias("s"))
    h = long.groupBy("image_id", "s.channel", F.shiftright(F.col("s.v") * 64, 8).alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("scaled", F.col("n") / F.max("n").over(Window.partitionBy("image_id")))


# edits on 0..1 relations; s and the sliders are 0..100 or -100..100 ----------------------------------------


def auto_white_balance(px: DataFrame, s: float) -> DataFrame:
    if s <= 0:
        return px
    k, w = strength(F.lit(float(s))), Window.partitionBy("image_id")
    m = {c: F.avg(c).over(w) for c in RGB}
    gray = (m["r"] + m["g"] + m["b"]) / 3.0
    fine = (m["r"] > 0) & (m["g"] > 0) & (m["b"] > 0)
    return px.withColumns({c: F.when(fine, F.col(c) * (1.0 + k * (clamp(gray / m[c], 0.5, 2.0) - 1.0))).otherwise(F.col(c)) for c in RGB})


def white_balance(px: DataFrame, temperature: float, tint: float) -> DataFrame:
    t, i = bipolar(F.lit(float(temperature))), bipolar(F.lit(float(tint)))
    return px.withColumns({"r": F.col("r") * (1.0 + 0.3 * t), "g": F.col("g") * (1.0 - 0.2 * i), "b": F.col("b") * (1.0 - 0.3 * t)})


def auto_exposure(px: DataFrame, s: float) -> DataFrame:
    if s <= 0:
        return px
    mean = F.avg(lum()).over(Window.partitionBy("image_id"))
    k = 1.0 + strength(F.lit(float(s))) * (clamp(EXPOSURE_TARGET / mean, 0.33, 3.0) - 1.0)
    k = F.when(mean > 0, k).otherwise(1.0)
    return px.withColumn("_k", k).withColumns(_each(lambda v: v * F.col("_k"))).drop("_k")


def exposure(px: DataFrame, e: float) -> DataFrame:
    return px.withColumns(_each(lambda v: v * F.pow(F.lit(2.0), 2.0 * bipolar(F.lit(float(e))))))


def auto_contrast(px: DataFrame, s: float) -> DataFrame:
    if s <= 0:
        return px
    h = luma_histogram(px)
    lo = percentile_bin(h, 0.01).select("image_id", (F.col("bin") / 255.0).alias("_lo"))
    hi = percentile_bin(h, 0.99).select("image_id", (F.col("bin") / 255.0).alias("_hi"))
    k, d = strength(F.lit(float(s))), px.join(lo, "image_id").join(hi, "image_id")

    def stretch(v):
        return F.when(F.col("_hi") > F.col("_lo"), v + ((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) - v) * k).otherwise(v)

    return d.withColumns(_each(stretch)).drop("_lo", "_hi")


def tone(px: DataFrame, contrast=0.0, highlights=0.0, shadows=0.0, whites=0.0, blacks=0.0) -> DataFrame:
    c, hi, sh, wh, bk = (bipolar(F.lit(float(v))) for v in (contrast, highlights, shadows, whites, blacks))
    d = px.withColumn("_l", lum())

    def one(v):
        x = (v - 0.5) * (1.0 + c) + 0.5
        x = x * (1.0 + hi * 0.4 * smoothstep(0.5, 1.0, F.col("_l"))) * (1.0 + sh * 0.5 * smoothstep(0.5, 0.0, F.col("_l")))
        return x + wh * 0.22 * smoothstep(0.72, 1.0, F.col("_l")) + bk * 0.22 * smoothstep(0.28, 0.0, F.col("_l"))

    return d.withColumns(_each(one)).drop("_l")


def split_tone(px: DataFrame, shadow_hue=0.0, shadow_sat=0.0, highlight_hue=0.0, highlight_sat=0.0) -> DataFrame:
    a, b = strength(F.lit(float(shadow_sat))) * 0.5, strength(F.lit(float(highlight_sat))) * 0.5
    low, high = hue_rgb(F.lit(float(shadow_hue))), hue_rgb(F.lit(float(highlight_hue)))
    d = px.withColumn("_l", clamp(lum(), 0.0, 1.0))
    return d.withColumns({c: F.col(c) + (1.0 - F.col("_l")) * a * (x - 0.5) + F.col("_l") * b * (y - 0.5) for c, x, y in zip(RGB, low, high)}).drop("_l")


def colour(px: DataFrame, saturation=0.0, vibrance=0.0) -> DataFrame:
    """Vibrance, then saturation, both around the luma before either."""
    s, v = bipolar(F.lit(float(saturation))), bipolar(F.lit(float(vibrance)))
    d = px.withColumn("_l", lum()).withColumn("_f", 1.0 + v * (1.0 - clamp(F.greatest(*RGB) - F.least(*RGB), 0.0, 1.0)))
    d = d.withColumns(_each(lambda x: F.col("_l") + (x - F.col("_l")) * F.col("_f")))
    return d.withColumns(_each(lambda x: F.col("_l") + (x - F.col("_l")) * (1.0 + s))).drop("_l", "_f")


def vignette(px: DataFrame, width: int, height: int, amount: float, midpoint: float) -> DataFrame:
    cx, cy = width / 2.0, height / 2.0
    far = max(1.0, (cx * cx + cy * cy) ** 0.5)
    d = F.sqrt(F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2)) / far
    k = 1.0 + bipolar(F.lit(float(amount))) * 0.8 * smoothstep(min(1.0, max(0.0, midpoint / 100.0)), 1.0, d)
    return px.withColumns(_each(lambda v: v * k))


def crop(px: DataFrame, width: int, height: int, x: float, y: float, w: float, h: float) -> DataFrame:
    """Places truncated, sizes rounded, one pixel at least; a full frame changes nothing."""
    if not (w > 0.001 and h > 0.001 and (x > 0.001 or y > 0.001 or w < 0.999 or h < 0.999)):
        return px
    x0, y0 = int(min(1.0, max(0.0, x)) * width), int(min(1.0, max(0.0, y)) * height)
    cw, ch = max(1, min(int(w * width + 0.5), width - x0)), max(1, min(int(h * height + 0.5), height - y0))
    d = px.where(F.col("x").between(x0, x0 + cw - 1) & F.col("y").between(y0, y0 + ch - 1))
    return d.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def render(px: DataFrame, p: dict, width: int, height: int) -> DataFrame:
    """The point-wise edits of byte pixels in their order; spatial filters are in ``kernels``."""
    g = lambda n: float(p.get(n, 0.0))
    d = white_balance(auto_white_balance(to_unit(px), g("auto_white_balance")), g("temperature"), g("tint"))
    d = exposure(auto_exposure(d, g("auto_exposure")), g("exposure"))
    d = tone(auto_contrast(d, g("auto_contrast")), *(g(n) for n in ("contrast", "highlights", "shadows", "whites", "blacks")))
    d = split_tone(d, *(g(n) for n in ("shadow_hue", "shadow_sat", "highlight_hue", "highlight_sat")))
    d = vignette(colour(d, g("saturation"), g("vibrance")), width, height, g("vignette_amount"), g("vignette_midpoint"))
    return to_bytes(d)


def watermark(px: DataFrame, overlay: DataFrame, opacity: float) -> DataFrame:
    """Blends overlay pixels (x, y, wr, wg, wb, wa) in; places outside the frame fall away in the join."""
    a = F.coalesce(F.col("wa") / 255.0 * strength(F.lit(float(opacity))), F.lit(0.0))
    d = px.join(overlay, ["x", "y"], "left")
    return d.withColumns({c: F.round(F.col(c) * (1.0 - a) + F.coalesce(F.col("w" + c), F.lit(0)) * a).cast("int") for c in RGB}).drop("wr", "wg", "wb", "wa")
