"""The photo report: what is known of every file of a library, groups included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalar import eyes, file_name, hamming
from ..types import BLUR_THRESHOLD, BURST_GAP_SECONDS, DUPLICATE_DISTANCE, EYE_THRESHOLD, THUMBNAIL
from . import cull, faces, groups, kernels

COLUMNS = ("path", "name", "width", "height", "frame_blur", "subject_blur", "is_blurry", "has_face", "eyes", "phash", "timestamp", "cluster", "burst", "error")


def build(photos: DataFrame, most: int = DUPLICATE_DISTANCE, gap: int = BURST_GAP_SECONDS, threshold: float = BLUR_THRESHOLD) -> DataFrame:
    """One row for each of photos (path, name, width, height, frame_score, face_score, eyes, phash, ts, error).

    A file with an error keeps a row of zeros and nulls and takes no part in groups: they are made of the others
    only, so it joins no clusters and leaves no gap in their numbers. A face's verdict goes before the frame's;
    ``face_score`` null means no face. Clusters and bursts of one photo have no number. A column ``thumbnail`` passes through."""
    photos = groups.written(photos)  # read for each kind of group and once more
    fine = photos.where("error is null")
    near = groups.clusters(fine.select(F.col("path").alias("id"), "phash"), most)
    cluster = groups.number_groups(near, "group", "cluster").select(F.col("id").alias("path"), "cluster")
    runs = groups.bursts(fine.select(F.col("path").alias("id"), "ts"), gap)
    burst = groups.number_groups(runs, "burst", "_n").select(F.col("id").alias("path"), F.col("_n").alias("burst"))
    d = photos.join(cluster, "path", "left").join(burst, "path", "left")
    bad = F.col("error").isNotNull()
    face = ~bad & F.col("face_score").isNotNull()
    verdict = cull.blur_verdict(F.col("face_score") < threshold, F.col("frame_score") < threshold)
    return d.select(
        "path", "name", *[F.when(bad, 0).otherwise(F.col(c)).alias(c) for c in ("width", "height")],
        F.when(bad, 0.0).otherwise(F.col("frame_score")).alias("frame_blur"), F.when(face, F.col("face_score")).alias("subject_blur"),
        F.when(bad, False).otherwise(verdict).alias("is_blurry"), face.alias("has_face"), F.when(face, F.col("eyes")).alias("eyes"),
        F.when(~bad, F.col("phash")).alias("phash"), F.when(~bad, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), "cluster", "burst", "error",
        *[c for c in photos.columns if c == "thumbnail"],
    )


def fingerprints(images: DataFrame, times: DataFrame) -> DataFrame:
    """(path, phash, blur, thumbnail, ts): decoded images (path, width, height, data) with their capture times (path, taken);
    thumbnails are JPEG files of 320 pixels at most. Every image is looked at once, one at a time."""
    from ..sources import jpeg

    rows = images.where("data is not null").withColumnRenamed("path", "image_id")

    def run(batches):
        import pandas as pd

        for b in batches:
            for r in b.itertuples():
                a = kernels.array(r)
                if a is not None:
                    small = jpeg.encode(kernels.fit(a, THUMBNAIL))
                    yield pd.DataFrame([(r.image_id, kernels.perceptual_hash(a), kernels.laplacian_score(kernels.gray(a)), small)], columns=["path", "phash", "blur", "thumbnail"])

    made = rows.select("image_id", "width", "height", "data").mapInPandas(run, "path string, phash long, blur double, thumbnail binary")
    return made.join(times.select("path", F.col("taken").alias("ts")), "path", "left")


def of_folder(images: DataFrame, times: DataFrame, subjects: DataFrame | None = None, **options) -> DataFrame:
    """The report of decoded files (path, width, height, data, error) with capture times (path, taken) and, where
    a detector ran, subjects (path, face_score, eyes)."""
    d = images.select("path", "width", "height", "error").join(fingerprints(images, times), "path", "left")
    if subjects is None:
        eye = "struct<left_ear:double,right_ear:double,both_closed:boolean,any_closed:boolean>"
        d = d.withColumns({"face_score": F.lit(None).cast("double"), "eyes": F.lit(None).cast(eye)})
    else:
        d = d.join(subjects, "path", "left")
    return build(d.withColumnRenamed("blur", "frame_score").withColumn("name", file_name(F.col("path"))), **options)


def grid_scores(grids: DataFrame, width: int, height: int, box: tuple[int, int, int, int]) -> DataFrame:
    """frame_score and face_score, that of a box (x, y, w, h), of small gray images of one size in place of their ``levels`` (whole
    numbers by rows). An image stays one row in its task: no pixel is a row, and nothing meets."""
    kept = [f for f in grids.schema.fields if f.name != "levels"]
    scores = [StructField(c, DoubleType()) for c in ("frame_score", "face_score")]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            levels = b.column(b.schema.get_field_index("levels")).flatten().to_numpy(zero_copy_only=False)
            g = levels.reshape(b.num_rows, height, width).transpose(1, 2, 0)
            made = [pa.array(kernels.grid_blur(x)) for x in (g, kernels.region(g, *box))]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(f.name)) for f in kept], *made], [f.name for f in kept + scores])

    return grids.mapInArrow(run, StructType(kept + scores))


def single(images: DataFrame, raw: Column, threshold: float = BLUR_THRESHOLD) -> DataFrame:
    """width, height, blur_score, is_blurry, phash and is_raw of each decoded image (image_id, width, height, data)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            a = [kernels.array(r) for r in b.itertuples()]
            score = [None if x is None else kernels.laplacian_score(kernels.gray(x)) for x in a]
            hashes = pd.array([None if x is None else kernels.perceptual_hash(x) for x in a], dtype="Int64")
            yield b[["image_id", "width", "height", "is_raw"]].assign(blur_score=score, phash=hashes)

    d = images.select("image_id", "width", "height", "data", raw.alias("is_raw"))
    return d.mapInPandas(run, "image_id long, width int, height int, is_raw boolean, blur_score double, phash long").withColumn("is_blurry", F.col("blur_score") < threshold)


def duplicate_clusters(photos: DataFrame, most: int = DUPLICATE_DISTANCE) -> DataFrame:
    """(id, group) of photos (id, phash, error); one file that cannot be decoded fails the whole call."""
    bad = photos.where("error is not null").select("id", "error").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['id']}: {bad[0]['error']}")
    return groups.clusters(photos, most)


def text_of(phash: Column) -> Column:
    """A hash as base64 text, and back by ``hash_of``."""
    return F.base64(F.unhex(F.lpad(F.hex(phash), 16, "0")))


def hash_of(text: Column) -> Column:
    """The hash of a base64 text; malformed text or one of another length is an error."""
    raw = F.try_to_binary(text, F.lit("base64"))
    fine = raw.isNotNull() & (F.octet_length(raw) == 8)
    high, low = (F.conv(F.hex(F.substring(raw, i, 4)), 16, 10).cast("long") for i in (1, 5))
    return F.when(fine, F.shiftleft(high, 32).bitwiseOR(low)).otherwise(F.raise_error(F.concat(F.lit("bad hash: "), F.coalesce(text, F.lit("null")))).cast("long"))


def image_distances(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """pairs (a, b) of image ids with the distance of their hashes, null where one cannot be decoded; each image is hashed once."""
    found = groups.written(kernels.hashes(images).select("image_id", "phash"))
    a, b = (found.select(F.col("image_id").alias(c), F.col("phash").alias(f"_{c}")) for c in "ab")
    d = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    return d.select("a", "b", hamming(F.col("_a"), F.col("_b")).alias("distance"))


def text_distance(a: Column, b: Column) -> Column:
    return hamming(hash_of(a), hash_of(b))


# faces: detections and landmarks are relations, whoever made them ---------------------------------------------


def mapped(landmarks: Column, rect: Column, side: float = 192.0) -> Column:
    """Landmarks of a face crop brought back to the image: rect is the crop (x, y, w, h), ``side`` the model's input."""
    return F.transform(landmarks, lambda p: F.struct((rect["x"] + p["x"] / side * rect["w"]).alias("x"), (rect["y"] + p["y"] / side * rect["h"]).alias("y")))


def face_eyes(kept: DataFrame, landmarks: DataFrame, sizes: DataFrame, threshold: float = EYE_THRESHOLD) -> DataFrame:
    """(image_id, box, eyes) of the primary face: kept boxes, landmarks (image_id, points) of its crop and image sizes.

    Images without a face have no row; landmarks that are missing or too few give null eyes."""
    box = faces.primary(kept).select("image_id", F.struct("x", "y", "w", "h", "score").alias("box"))
    d = box.join(sizes.select("image_id", "width", "height"), "image_id").join(landmarks, "image_id", "left")
    crop = faces.crop_of(F.col("box"), F.col("width"), F.col("height"))
    return d.select("image_id", "box", eyes(mapped(F.col("points"), crop), threshold).alias("eyes"))


def analyse_faces(kept: DataFrame, landmarks: DataFrame, images: DataFrame, threshold: float = EYE_THRESHOLD) -> DataFrame:
    """(image_id, box, eyes, face_score): eyes and the blur of the grown box of the primary face, one detection for
    both. Where the eyes cannot be read the whole face counts as none, its blur too."""
    found = groups.written(face_eyes(kept, landmarks, images, threshold).where("eyes is not null"))
    d = found.withColumn("_b", faces.blur_box(F.col("box"))).join(images.select("image_id", "width", "height", "data"), "image_id")
    d = d.select("image_id", "width", "height", "data", *[F.col(f"_b.{c}").alias(c) for c in "xywh"])

    def run(batches):
        import pandas as pd

        for b in batches:
            score = [kernels.region_blur(kernels.array(r), int(r.x), int(r.y), int(r.w), int(r.h)) if r.data is not None else None for r in b.itertuples()]
            yield pd.DataFrame({"image_id": b.image_id, "face_score": score})

    blur = d.mapInPandas(run, "image_id long, face_score double")
    return found.join(blur, "image_id")
