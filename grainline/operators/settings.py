"""Edit state: settings and retouch of photos as folds of event logs, and small things of the edit panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import CROP, SLIDERS

STAMPS = "array<struct<x:float,y:float,r:float>>"


def params(log: DataFrame) -> DataFrame:
    """Settings after a log (path, seq, op, key, value, rect): one column a parameter, 0 where nothing was set.

    ``update`` sets one parameter over what is there; ``reset`` brings all to the defaults; ``crop`` sets a rectangle
    (x, y, w, h); ``crop_on`` a full frame unless a crop is there; ``crop_off`` takes the crop away. The events that
    count are those after the last reset, and of each parameter the last, so no list of events is made; corners set
    after a switch are on top of its frame."""
    last_reset = log.where("op = 'reset'").groupBy("path").agg(F.max("seq").alias("_reset"))
    d = log.join(last_reset, "path", "left").where("_reset is null or seq >= _reset")
    value = {n: F.when((F.col("op") == "update") & (F.col("key") == n), F.col("value")) for n in SLIDERS + CROP}
    for n in CROP:
        own = F.when(F.col("op") == "crop", F.col(f"rect.{n[-1]}")).when(F.col("op") == "crop_off", 0.0)
        value[n] = F.coalesce(value[n], own)
    # a switch makes a frame if no width is there: the first since a width of zero, or since the start, does
    along = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_segment": F.count(value["crop_w"]).over(along), "_w": F.coalesce(F.last(value["crop_w"], True).over(along), F.lit(0.0))})
    switch = F.when(F.col("op") == "crop_on", F.col("seq"))
    made = (F.col("op") == "crop_on") & (F.col("_w") <= 0) & (F.col("seq") == F.min(switch).over(Window.partitionBy("path", "_segment")))
    d = d.withColumn("_made", made)
    for n, v in {"crop_x": 0.0, "crop_y": 0.0, "crop_w": 1.0, "crop_h": 1.0}.items():
        value[n] = F.coalesce(value[n], F.when(F.col("_made"), v))
    set_ = [F.max_by(v, F.when(v.isNotNull(), F.col("seq"))).alias(n) for n, v in value.items()]
    out = d.groupBy("path").agg(*set_)
    return out.select("path", *[F.coalesce(n, F.lit(0.0)).cast("double").alias(n) for n in SLIDERS + CROP])


def retouch(log: DataFrame) -> DataFrame:
    """Strokes after a log (path, seq, op, stamps): ``add`` appends a stroke unless it is empty, ``undo`` drops the
    last one, ``clear`` all.

    After the last clear the log is a walk, up with a stroke and down with an undo, but not below the ground. A stroke stays
    if the walk never comes below the height that it reached; sums and minima along the log tell, and only strokes
    that stay are gathered, as they are the result."""
    none = F.array().cast(f"array<struct<stamps:{STAMPS}>>")
    cleared = log.where("op = 'clear'").groupBy("path").agg(F.max("seq").alias("_c"))
    d = log.join(cleared, "path", "left").where("_c is null or seq > _c")
    step = F.when((F.col("op") == "add") & (F.size("stamps") > 0), 1).when(F.col("op") == "undo", -1)
    d = d.withColumn("_s", step).where("_s is not null")
    along = Window.partitionBy("path").orderBy("seq", "op")
    upto, later = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(1, Window.unboundedFollowing)
    d = d.withColumn("_sum", F.sum("_s").over(upto))
    # the ground is the lowest sum so far
    d = d.withColumn("_height", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    d = d.withColumn("_lowest", F.min("_height").over(later))
    stay = d.where((F.col("_s") == 1) & (F.col("_lowest").isNull() | (F.col("_lowest") >= F.col("_height"))))
    stroke = F.struct("seq", F.struct(F.col("stamps").cast(STAMPS).alias("stamps")).alias("s"))
    left = stay.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(stroke)), lambda x: x["s"]).alias("heals"))
    return log.select("path").distinct().join(left, "path", "left").select("path", F.coalesce("heals", none).alias("heals"))


def brush_radius(size: Column) -> Column:
    """In widths, from 1 to 9 hundredths."""
    return 0.01 + size / 100.0 * 0.08


def exif_rows(files: DataFrame) -> DataFrame:
    """(path, name, value) of the camera settings that are there."""
    names = (("Camera", "model"), ("Lens", "lens"), ("ISO", "iso"), ("Aperture", "aperture"), ("Shutter", "shutter"), ("Focal", "focal"))
    each = F.array(*[F.struct(F.lit(label).alias("name"), F.col(f"exif.{c}").alias("value")) for label, c in names])
    d = files.select("path", F.explode(each).alias("r")).select("path", "r.name", "r.value")
    return d.where("value is not null and value <> ''")


def crop_file_name(stem: Column, score: Column) -> Column:
    """Name of a dumped face crop: the score in seven places first, so that names sort by it."""
    return F.concat(F.format_string("%07.1f", score), F.lit("_"), F.translate(stem, " .", "__"), F.lit(".png"))


def widest(names: DataFrame, least: int = 8) -> DataFrame:
    """The width that a column of names takes, ``least`` at least."""
    return names.agg(F.greatest(F.coalesce(F.max(F.char_length("name")), F.lit(0)), F.lit(least)).alias("width"))


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
