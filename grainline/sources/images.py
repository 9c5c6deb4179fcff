"""Image folders: scanning, decoding, EXIF, presets and encoding.

JPEG, PNG and BMP are decoded by Spark's image source, TIFF, lossless WebP and camera files by ``tiff`` and ``webp``;
what none of them can read becomes an error row. EXIF is read from the file's own bytes, images are encoded as JPEG.
"""

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import is_raw, is_supported
from ..types import CROP, IMAGE_EXTENSIONS, PARAMS, RAW_EXTENSIONS, SLIDERS
from . import exif, jpeg, tiff, webp

EXIF = "model string, lens string, iso string, aperture string, shutter string, focal string, taken string, subsec string, error string"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files of a folder, not of its subfolders, with their bytes; ``ordered`` sorts their paths.

    The glob keeps other files from being read, and no bytes go through a shuffle. Spark lists no empty files."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", _glob(IMAGE_EXTENSIONS)).load(folder)
    return d.where(is_supported(F.col("path")))


def ordered(files: DataFrame) -> DataFrame:
    """The paths of files, and nothing else of them, by path."""
    return files.select("path").orderBy("path")


def scan_files(spark: SparkSession, paths: list[str]) -> tuple[str, DataFrame]:
    """(folder of the first supported path by order, or empty; the supported files)."""
    kinds = tuple("." + e for e in IMAGE_EXTENSIONS)
    # a leading dot alone makes no extension
    kept = sorted(p for p in paths if p.rpartition("/")[2][1:].lower().endswith(kinds))
    if not kept:
        return "", spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return kept[0].rpartition("/")[0], spark.read.format("binaryFile").load(kept)


def _glob(kinds) -> str:
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in kinds) + "}"


#: Kinds of files that Spark's image source does not read.
OWN_KINDS = ("tif", "tiff", "webp", *RAW_EXTENSIONS)
DECODED = "path string, width int, height int, data binary, error string"


def decode_bytes(raw: bytes, camera: bool) -> np.ndarray:
    """The pixels of a TIFF, WebP or (``camera``) camera file, height x width x 3 bytes; ValueError where there are none."""
    try:
        if camera:
            a = tiff.develop(raw)
        else:
            a = webp.decode(raw) if raw[:4] == b"RIFF" else tiff.decode(raw)
    except (struct.error, IndexError, KeyError, ZeroDivisionError, OverflowError, MemoryError) as e:  # what damaged directories lead to
        raise ValueError(f"damaged file: {e or type(e).__name__}") from None
    if a.ndim != 3 or a.shape[2] != 3 or not a.size:
        raise ValueError(f"decoding gave {a.size} bytes")
    return a


def decode_files(files: DataFrame) -> DataFrame:
    """path, width, height, data (RGB) and error of files (path, content) of the kinds in ``OWN_KINDS``, one at a time."""

    def run(batches):
        for b in batches:
            for path, raw, camera in zip(b.path, b.content, b.camera):
                try:
                    a = decode_bytes(raw, camera)
                    row = (path, a.shape[1], a.shape[0], a.tobytes(), None)
                except ValueError as e:
                    row = (path, 0, 0, None, str(e))
                yield pd.DataFrame([row], columns=["path", "width", "height", "data", "error"])

    return files.select("path", "content", is_raw(F.col("path")).alias("camera")).mapInPandas(run, DECODED)


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, data (RGB) and error of a folder's images; undecodable files keep a row."""
    plain = [e for e in IMAGE_EXTENSIONS if e not in OWN_KINDS]
    made = _plain(spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", _glob(plain)).load(folder))
    others = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", _glob(OWN_KINDS)).load(folder)
    return made.unionByName(decode_files(others.where(is_supported(F.col("path")))))


def decode_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As ``decode``, of the files at these paths."""
    own = [p for p in paths if p.lower().endswith(tuple("." + e for e in OWN_KINDS))]
    plain = sorted(set(paths) - set(own))
    made = [_plain(spark.read.format("image").option("dropInvalid", "false").load(plain))] if plain else []
    made += [decode_files(spark.read.format("binaryFile").load(own))] if own else []
    if not made:
        return spark.createDataFrame([], DECODED)
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def _plain(images: DataFrame) -> DataFrame:
    """Rows of Spark's image source as ``decode`` gives them."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.width < 0 or not r.nChannels:
                    out.append((r.origin, 0, 0, None, "cannot decode"))
                    continue
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                rgb = np.repeat(a, 3, 2) if r.nChannels == 1 else a[..., 2::-1]
                out.append((r.origin, r.width, r.height, rgb.tobytes(), None))
            yield pd.DataFrame(out, columns=["path", "width", "height", "data", "error"])

    # this source writes local paths in another way than the one that ``scan`` reads with
    return images.select("image.*").mapInPandas(run, DECODED).withColumn("path", F.regexp_replace("path", "^file:///", "file:/"))


def _exif(content: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in content:
        try:
            t = exif.tags(raw)
        except Exception as e:  # any malformed container
            rows.append([None] * 8 + [str(e) or type(e).__name__])
            continue
        rows.append([*exif.settings(t), exif.text(t, exif.TAKEN), exif.text(t, exif.SUBSECOND), None])
    return pd.DataFrame(rows, columns=[c.split()[0] for c in EXIF.split(", ")])


def with_exif(files: DataFrame) -> DataFrame:
    """files (path, content) with exif and taken (capture time, null on any failure; microseconds)."""
    d = files.withColumn("exif", F.pandas_udf(_exif, EXIF)("content"))
    whole = F.try_to_timestamp("exif.taken", F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    micros = F.floor(F.coalesce(F.expr("try_cast(concat('0.', exif.subsec) as double)"), F.lit(0.0)) * 1_000_000).cast("int")
    return d.withColumn("taken", whole + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(8,6)")))


def png(width: int, height: int, data: bytes) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + data[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _png(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([png(w, h, d) for w, h, d in zip(width, height, data)])


def encode_png(width, height, data):
    """A column of PNG files; made when called, as it needs a session."""
    return F.pandas_udf(_png, "binary")(width, height, data)


def encode_jpeg(width, height, data, quality: int = jpeg.QUALITY):
    """A column of JPEG files of packed images; null where there are no pixels."""

    def run(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or not w or not h else jpeg.encode(np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3), quality) for w, h, d in zip(width, height, data)], dtype=object)

    return F.pandas_udf(run, "binary")(width, height, data)


def data_uri(encoded, kind: str = "image/jpeg"):
    """Encoded bytes as a data URI; nothing gives an empty text."""
    return F.coalesce(F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(encoded), r"\r\n", "")), F.lit(""))


def load_presets(spark: SparkSession, path: str) -> DataFrame:
    """Presets (name, params) of a JSON array; a missing or corrupt file holds none, missing sliders are 0.

    Faults of another kind (no permission, no such file system) are raised. If a crash between the two moves of ``save_presets``
    left only the old file aside, that one is read."""
    schema = f"name string, params {PARAMS}"
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path_of(path)):
        if not fs.exists(path_of(path + ".old")):
            return spark.createDataFrame([], schema)
        path += ".old"
    text = spark.read.option("wholetext", True).text(path)
    each = text.select(F.explode(F.from_json("value", f"array<struct<name:string,params:{PARAMS}>>", {"mode": "PERMISSIVE"})).alias("p"))
    params = F.struct(*[F.coalesce(F.col(f"p.params.{n}"), F.lit(0.0).cast("float")).alias(n) for n in SLIDERS + CROP])
    return each.where("p.name is not null").select("p.name", params.alias("params"))


def save_presets(presets: DataFrame, path: str) -> None:
    """Writes (name, params) as one JSON array in one file, in their order, over what was there.

    Presets are what one person has named: a handful of rows, written by the driver in one piece."""
    spark = presets.sparkSession
    rows = presets.select(F.to_json(F.struct("name", "params")).alias("j")).toLocalIterator()
    body = "[\n" + ",\n".join(r["j"] for r in rows) + "\n]\n"
    jvm = spark.sparkContext._jvm
    p, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(body.encode()))
    out.close()
    # the old file stays until the new one is whole: it is moved aside, and back if the last step fails
    old = jvm.org.apache.hadoop.fs.Path(path + ".old")
    had = fs.exists(p)
    if had:
        fs.delete(old, False)
        fs.rename(p, old)
    if not fs.rename(aside, p):
        if had:
            fs.rename(old, p)
        raise OSError(f"cannot write {path}")
    fs.delete(old, False)
