"""A table of previews that is refreshed, not made anew: a preview is known by its file's path and time of change and by what was edited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import PREVIEW
from . import render
from .groups import written

KEY = ("path", "modified", "digest")


def wanted(files: DataFrame, edits: DataFrame, crop_preview: bool = False, edge: int = PREVIEW) -> DataFrame:
    """path, modified and digest of the previews of files (path, modificationTime), with params and heals of edits (path,
    params, heals), where there are any."""
    d = files.select("path", F.col("modificationTime").alias("modified")).join(edits.select("path", "params", "heals"), "path", "left")
    what = F.to_json(F.struct("params", "heals", F.lit(crop_preview).alias("crop"), F.lit(edge).alias("edge")))
    return d.withColumn("digest", F.sha2(what, 256))


def refresh(spark: SparkSession, table: str, files: DataFrame, edits: DataFrame, crop_preview: bool = False, edge: int = PREVIEW) -> DataFrame:
    """The previews (path, before, after, error) of files with their edits, out of the Parquet table at the path ``table``, to
    which those that it lacks are added first: of files that are new or changed, and of edits that are.

    Only files whose preview is missing are read; their paths are with the driver, as those of every listing are."""
    from ..sources.images import decode_paths

    want = written(wanted(files, edits, crop_preview, edge))
    have = stored(spark, table)
    missing = written(want if have is None else want.join(have.select(*KEY), list(KEY), "left_anti"))
    paths = [r["path"] for r in missing.select("path").distinct().toLocalIterator()]
    if paths:
        pixels = decode_paths(spark, paths).join(missing, "path").withColumnRenamed("error", "why")
        rows = pixels.select(F.struct("path", "modified", "digest", "why").alias("image_id"), "width", "height", "data", "params", "heals")
        made = render.preview(rows, crop_preview, edge, "image_id struct<path:string,modified:timestamp,digest:string,why:string>")
        made.select("image_id.path", "image_id.modified", "image_id.digest", "before", "after", F.col("image_id.why").alias("error")).write.mode("append").parquet(table)
        have = stored(spark, table)
    if have is None:
        return spark.createDataFrame([], "path string, before binary, after binary, error string")
    # a refresh that ran twice may have added a preview twice
    return want.select(*KEY).join(have.dropDuplicates(list(KEY)), list(KEY)).select("path", "before", "after", "error")


def stored(spark: SparkSession, table: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema("path string, modified timestamp, digest string, before binary, after binary, error string").parquet(table)
