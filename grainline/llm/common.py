"""What the operators share: tables, the shared work folder, file access and word splitting."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = "\t\n\x0b\x0c\r "
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (single machine, tests) a temporary one is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            d = jsc.get()
        else:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="grainline-")
            spark.sparkContext.setCheckpointDir(d)
    return d if "://" in d or d.startswith("file:") else "file://" + os.path.abspath(d)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a Parquet table in the shared folder and read again: lineage ends there,
    and a lost executor costs no recomputation of what came before."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gl_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and nothing reads any more."""
    path = getattr(df, "_gl_path", None)
    if path:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_path(uri: str) -> str | None:
    """The path of a file: URI on a mounted shared folder, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    p = local_path(uri)
    if p is not None:
        os.makedirs(p, exist_ok=True)
    else:
        f, path = _fs(uri)
        f.create_dir(path, recursive=True)


class Output:
    """A file that appears under its name only when complete: attempts write aside and rename."""

    def __init__(self, uri: str):
        self.uri, self.aside = uri, f"{uri}.{uuid.uuid4().hex[:8]}.part"
        p = local_path(self.aside)
        if p is not None:
            os.makedirs(os.path.dirname(p), exist_ok=True)
            self.f = open(p, "wb")
        else:
            f, path = _fs(self.aside)
            self.f = f.open_output_stream(path)

    def __enter__(self):
        return self.f

    def __exit__(self, kind, *_):
        self.f.close()
        p = local_path(self.aside)
        if kind is not None:
            if p is not None:
                os.unlink(p)
            return
        if p is not None:
            os.replace(p, local_path(self.uri))
        else:
            f, path = _fs(self.aside)
            f.move(path, _fs(self.uri)[1])


def open_in(uri: str):
    """A seekable binary file."""
    p = local_path(uri)
    if p is not None:
        return open(p, "rb")
    f, path = _fs(uri)
    return f.open_input_file(path)


def list_files(spark: SparkSession, uri: str, suffix: str) -> list[str]:
    """The files of a folder, through Spark's own file system."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(uri)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().endswith(suffix))


_TIDIED = [0.0]


def tidy(every: float = 20.0) -> None:
    """Gives memory that earlier tasks of this Python worker have freed back to the system, now and then."""
    import pyarrow as pa

    if time.monotonic() - _TIDIED[0] < every:
        return
    _TIDIED[0] = time.monotonic()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def remainder(n: int):
    """crc32 of doc_id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def n_words(text):
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def finite_vector(e):
    """Whether an array of doubles is a vector: not null, empty or zero, and all its components finite."""
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))
