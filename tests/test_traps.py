"""Equalities, ties and orders that are easy to get wrong."""

import numpy as np
from pyspark.sql import functions as F

from grainline.functions import scalar as S
from grainline.operators import cull, exports, faces, groups, kernels, pixels, report
from grainline.types import LEFT_EYE, RIGHT_EYE


def test_thresholds_at_equality(spark):
    # blur: the score itself is sharp
    px = spark.createDataFrame([(1, y, x, int((x + y) % 2) * 4) for y in range(4) for x in range(4)], "image_id long, y int, x int, l int")
    score = pixels.blur(px).first()["score"]
    assert [pixels.blur(px, t).first()["is_blurry"] for t in (score, np.nextafter(score, 1e9))] == [False, True]
    # eyes: the threshold itself is closed
    points = [(0.0, 0.0)] * 468
    for eye in (LEFT_EYE, RIGHT_EYE):
        for at, q in zip(eye, [(0, 0), (5, 2), (15, 2), (16, 0), (15, -2), (5, -2)]):
            points[at] = (float(q[0]), float(q[1]))
    d = spark.createDataFrame([(points,)], "p array<struct<x:double,y:double>>")
    assert [d.select(S.eyes(F.col("p"), t).alias("e")).first()["e"]["both_closed"] for t in (0.25, 0.2499)] == [True, False]
    # duplicates: the distance itself counts
    two = spark.createDataFrame([(1, 0), (2, (1 << 12) - 1)], "id long, phash long")
    assert [groups.similar_pairs(two, n, bands=b).count() for n in (12, 11) for b in (True, False)] == [1, 1, 0, 0]
    # suppression: an overlap of the limit stays; a score of the limit too
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 5.0, 0.0, 10.0, 10.0, 0.8)], "image_id long, pos int, x double, y double, w double, h double, score double")
    assert [faces.suppress(boxes, t).count() for t in (50 / 150, 0.33)] == [2, 1]
    heads = spark.createDataFrame([(1, 8, 0, 0.36, 1.0, [0.0, 0.0, 0.0, 0.0]), (1, 8, 1, 0.3599, 1.0, [0.0, 0.0, 0.0, 0.0])], "image_id long, stride int, idx int, cls double, obj double, bbox array<double>")
    assert [r["idx"] for r in faces.decode(heads, 640, 640).collect()] == [0]
    # gaps: two whole seconds and a fraction are still one burst
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    t = spark.createDataFrame([(1, at), (2, at + dt.timedelta(seconds=2.9)), (3, at + dt.timedelta(seconds=5.9))], "id long, ts timestamp_ntz")
    assert [r["burst"] for r in groups.bursts(t).orderBy("id").collect()] == [1, 1, 2]


def test_ties(spark):
    kept = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 9.0), (1, 1, 5.0, 5.0, 6.0, 6.0), (1, 2, 9.0, 9.0, 5.0, 5.0)], "image_id long, rank int, x double, y double, w double, h double")
    assert faces.primary(kept).first()["rank"] == 1  # the last of equally large faces
    three = spark.createDataFrame([(7, 1), (3, 2), (5, 4)], "id long, phash long")  # all two bits from each other
    assert {r["a"]: r["nearest"] for r in groups.nearest(three).collect()} == {7: 3, 3: 5, 5: 3}  # the first of equally near photos


def test_watermark_renders_without_corrections(spark):
    items = spark.createDataFrame([("/a/x.cr2", 0, False, True), ("/a/y.PNG", 1, True, False)], "path string, position long, noop boolean, retouch_empty boolean")
    got = [(r["action"], r["edited"], r["base_name"]) for r in exports.plan(items, False, watermark=True).orderBy("position").collect()]
    assert got == [("render", False, "x.jpg"), ("render", False, "y.jpg")]
    got = [(r["action"], r["base_name"]) for r in exports.plan(items, False).orderBy("position").collect()]
    assert got == [("copy", "x.cr2"), ("copy", "y.PNG")]
    assert [r["action"] for r in exports.plan(items, True).orderBy("position").collect()] == ["render", "render"]


def test_rejects_are_counted_over_all_decisions(spark):
    photos = spark.createDataFrame([("a", False, None, None), ("b", True, True, 1)], "path string, is_blurry boolean, both_closed boolean, cluster int")
    decisions = spark.createDataFrame([("a", "keep"), ("gone", "reject"), ("b", "reject")], "path string, decision string")
    r = cull.counts(photos, decisions).first()
    assert (r["all"], r["rejects"], r["keepers"]) == (2, 2, 1) and [x["path"] for x in cull.view(photos, decisions, "rejects").collect()] == ["b"]


def test_sync_copies_geometry_and_presets_do_not(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0, 0.1)], "path string, exposure double, straighten double, crop_x double")
    look = {"exposure": 9.0, "straighten": 8.0, "crop_x": 0.7}
    assert cull.sync_to_all(d, look).first()[1:] == (9.0, 8.0, 0.7) and cull.apply_preset(d, look).first()[1:] == (9.0, 2.0, 0.1)


def test_a_face_that_cannot_be_read_is_no_face(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, 6.0, 6.0, 0.9)], "image_id long, rank int, pos int, x double, y double, w double, h double, score double")
    few = spark.createDataFrame([(1, [(0.0, 0.0)] * 12)], "image_id long, points array<struct<x:double,y:double>>")
    frame = spark.createDataFrame([(1, 9, 9, bytearray(range(243)))], "image_id long, width int, height int, data binary")
    assert report.analyse_faces(boxes, few, frame).count() == 0  # its blur is gone too


def test_crops_and_casts(spark):
    box = F.struct(F.lit(10.7).alias("x"), F.lit(-3.0).alias("y"), F.lit(20.9).alias("w"), F.lit(10.0).alias("h"))
    r = spark.range(1).select(faces.crop_of(box, F.lit(40.0), F.lit(30.0)).alias("c"), faces.blur_box(box).alias("b")).first()
    assert r["c"]["x"] != int(r["c"]["x"]) and (r["b"]["x"], r["b"]["y"]) == (8, 0)  # kept fractional; truncated and stopped at nought
    assert kernels.region(np.zeros((5, 5, 3), np.uint8), 10**9, -5, 10**9, 3).shape == (3, 1, 3)


def test_distances_of_images(spark):
    rng = np.random.default_rng(2)
    a = [np.repeat(np.kron(rng.integers(0, 256, (8, 8)), np.ones((4, 4), int))[..., None], 3, 2).astype(np.uint8) for _ in range(2)]
    d = spark.createDataFrame([(1, 32, 32, bytearray(a[0].tobytes())), (2, 32, 32, bytearray(a[1].tobytes())), (3, 32, 32, bytearray(a[0].tobytes())), (4, 0, 0, None)], "image_id long, width int, height int, data binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    got = {(r["a"], r["b"]): r["distance"] for r in report.image_distances(pairs, d).collect()}
    assert got == {(1, 2): bin((kernels.perceptual_hash(a[0]) ^ kernels.perceptual_hash(a[1])) & (2**64 - 1)).count("1"), (1, 3): 0, (1, 4): None}
