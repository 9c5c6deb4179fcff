"""Face boxes: decoding detector heads, suppression, the primary face and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, overlap
from ..types import BLUR_BOX_MARGIN, CROP_MARGIN, DETECTOR_INPUT, OVERLAP_THRESHOLD, SCORE_THRESHOLD


def decode(heads: DataFrame, width: int, height: int, least: float = SCORE_THRESHOLD) -> DataFrame:
    """Boxes (image_id, x, y, w, h, score) of rows (image_id, stride, idx, cls, obj, bbox of four)."""
    cols = F.lit(DETECTOR_INPUT) / F.col("stride")
    d = heads.withColumns({"_c": F.pmod(F.col("idx"), cols.cast("int")), "_r": F.floor(F.col("idx") / cols), "_s": F.col("stride").cast("double")})
    q = [F.get("bbox", F.lit(i)).cast("double") for i in range(4)]
    sx, sy = width / DETECTOR_INPUT, height / DETECTOR_INPUT
    d = d.withColumn("score", F.sqrt(F.greatest(F.lit(0.0), F.col("cls").cast("double") * F.col("obj").cast("double"))))
    d = d.where(F.col("score") >= least)
    w, h = F.exp(q[2]) * F.col("_s"), F.exp(q[3]) * F.col("_s")
    x, y = (F.col("_c") + q[0]) * F.col("_s") - w / 2, (F.col("_r") + q[1]) * F.col("_s") - h / 2
    return d.select("image_id", "stride", "idx", (x * sx).alias("x"), (y * sy).alias("y"), (w * sx).alias("w"), (h * sy).alias("h"), "score")


def suppress(boxes: DataFrame, most: float = OVERLAP_THRESHOLD) -> DataFrame:
    """Greedy suppression: by score (ties by position ``pos``) a box stays unless it overlaps a kept one by more
    than ``most``. An image's boxes are few, so a fold over its array does."""
    per = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("k"), "pos", "x", "y", "w", "h", "score"))).alias("all"))
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda acc, b: F.when(F.exists(acc, lambda o: overlap(o, b) > most), acc).otherwise(F.array_append(acc, b)))
    return per.select("image_id", F.posexplode(kept).alias("rank", "b")).select("image_id", "rank", *[F.col("b." + c).alias(c) for c in ("pos", "x", "y", "w", "h", "score")])


def primary(kept: DataFrame) -> DataFrame:
    """The largest kept box of each image; the later of equally large ones."""
    w = Window.partitionBy("image_id").orderBy((F.col("w") * F.col("h")).desc(), F.col("rank").desc())
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def face_crop(box: Column, width: int, height: int, margin: float = CROP_MARGIN) -> Column:
    """``crop_of`` for images of one size."""
    return crop_of(box, F.lit(float(width)), F.lit(float(height)), margin)


def crop_of(box: Column, width: Column, height: Column, margin: float = CROP_MARGIN) -> Column:
    """A square around a box with a margin, clamped to the frame."""
    side = F.greatest(box["w"], box["h"]) * (1.0 + 2.0 * margin)
    x0 = clamp(box["x"] + box["w"] / 2.0 - side / 2.0, 0.0, width - 1.0)
    y0 = clamp(box["y"] + box["h"] / 2.0 - side / 2.0, 0.0, height - 1.0)
    w, h = F.least(x0 + side, width.cast("double")) - x0, F.least(y0 + side, height.cast("double")) - y0
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(w, F.lit(1.0)).alias("w"), F.greatest(h, F.lit(1.0)).alias("h"))


def blur_box(box: Column, margin: float = BLUR_BOX_MARGIN) -> Column:
    """The box grown by a margin in whole pixels; left and top stop at 0 while the size stays."""
    at = {n: F.greatest(box[n] - margin * box[s], F.lit(0.0)).cast("int") for n, s in (("x", "w"), ("y", "h"))}
    return F.struct(at["x"].alias("x"), at["y"].alias("y"), (box["w"] * (1 + 2 * margin)).cast("int").alias("w"), (box["h"] * (1 + 2 * margin)).cast("int").alias("h"))
