"""Files of an export, written by Spark's own committer and moved to their names afterwards.

Attempts go below a folder of their own inside the destination, a directory for each position, so that a task that is
retried, doubled or lost leaves nothing but what the committer takes over, on any store that Spark can write. Moving
a file to its name is the second step: the driver renames, as committers do, and no bytes pass through it. The step
may be run again: what has been moved is done, what has not been moved yet is moved.

Spark's text writer ends a row with a separator that may not be empty. A file's last byte is taken for it, so files are
written in one job for each last byte there is (JPEG files share theirs).
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Renames at a time, and names that the driver holds at a time.
MOVERS, NAMES = 16, 5000


def stage(rows: DataFrame, folder: str) -> str:
    """Writes rows (position, target, content, error) below a new folder inside ``folder``, whose path is given back: as a table,
    by which they are made once, and the contents as files."""
    where = f"{folder.rstrip('/')}/.attempt-{uuid.uuid4().hex[:12]}"
    last = F.coalesce(F.conv(F.hex(F.expr("substring(content, -1, 1)")), 16, 10).cast("int"), F.lit(-1))
    rows.select("position", "target", "error", last.alias("last"), "content").write.parquet(f"{where}/rows")
    d = rows.sparkSession.read.parquet(f"{where}/rows").where("error is null and last >= 0")
    for (end,) in sorted(d.select("last").distinct().collect()):  # a byte, so 256 at most
        body = F.expr("substring(content, 1, octet_length(content) - 1)").cast("string").alias("value")
        out = d.where(F.col("last") == end).select("position", body).write.partitionBy("position")
        out.option("lineSep", chr(end)).option("encoding", "ISO-8859-1").text(f"{where}/{end}")
    return where


def _store(spark: SparkSession, folder: str):
    """(file system, function from text to path); a local one without its checksum files."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = path_of(folder).getFileSystem(conf)
    if fs.getUri().getScheme() == "file":
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRawFileSystem()
    return fs, path_of


def commit(spark: SparkSession, folder: str, where: str) -> DataFrame:
    """Moves the files staged at ``where`` to their targets in ``folder``, never over another file; position, ok and error of
    each row. A row with an error of its own moves nothing and keeps it. Errors are with the driver, names pass through it."""
    fs, path_of = _store(spark, folder)

    def move(r):
        if r["error"] is not None:
            return r["position"], r["error"]
        try:
            target = path_of(f"{folder.rstrip('/')}/{r['target']}")
            there = fs.exists(target)
            if r["last"] < 0:  # an empty file
                if there and fs.getFileStatus(target).getLen():
                    return r["position"], f"{r['target']}: File exists"
                if not there:
                    fs.create(target, False).close()
                return None
            own = path_of(f"{where}/{r['last']}/position={r['position']}")
            found = [f.getPath() for f in fs.listStatus(own) if f.getPath().getName().startswith("part-")] if fs.exists(own) else []
            if not found:  # an earlier run of this step has moved it
                return None if there else (r["position"], f"{r['target']}: not written")
            return (r["position"], f"{r['target']}: File exists") if there or not fs.rename(found[0], target) else None
        except Exception as e:  # the store's faults are errors of the row
            return r["position"], f"{r['target']}: {str(e).splitlines()[0]}"

    d = spark.read.parquet(f"{where}/rows").select("position", "target", "error", "last")
    failed, names = [], d.toLocalIterator()
    with ThreadPoolExecutor(MOVERS) as pool:
        while some := list(islice(names, NAMES)):
            failed += [x for x in pool.map(move, some) if x is not None]
    bad = spark.createDataFrame(failed, "position long, error string")
    return d.select("position").join(bad, "position", "left").select("position", F.col("error").isNull().alias("ok"), "error")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Both steps for rows (position, target, content, error): one row (position, ok, error) for each of them."""
    from ..operators.groups import written

    spark = rows.sparkSession
    rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
    where = stage(rows, folder)
    out = written(commit(spark, folder, where))
    fs, path_of = _store(spark, folder)
    fs.delete(path_of(where), True)
    return out
