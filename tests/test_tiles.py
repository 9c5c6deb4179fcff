import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.functions import scalar as S
from grainline.operators import render, tiles
from test_codecs import picture

FULL = {
    "straighten": 40.0, "noise_reduction": 70.0, "auto_white_balance": 80.0, "auto_exposure": 60.0, "auto_contrast": 70.0, "exposure": 10.0, "contrast": 15.0, "vibrance": 20.0,
    "vignette_amount": -50.0, "vignette_midpoint": 30.0, "clarity": 60.0, "sharpening": 80.0, "crop_x": 0.1, "crop_y": 0.2, "crop_w": 0.7, "crop_h": 0.6,
}


def given(p):
    return F.struct(*[F.lit(p.get(n, 0.0)).cast("float").alias(n) for n in S.SLIDERS + S.CROP])


@pytest.mark.parametrize("shape,p", [((150, 230), FULL), ((420, 500), {"clarity": -40.0, "sharpening": 50.0}), ((90, 70), {}), ((130, 65), {"straighten": -100.0, "crop_w": 0.5, "crop_h": 1.0})])
def test_tiles_equal_the_whole_photo(spark, shape, p):
    p = {n: float(np.float32(v)) for n, v in p.items()}
    a = picture(*shape)
    d = spark.createDataFrame([(7, shape[1], shape[0], bytearray(a.tobytes())), (8, 0, 0, None)], "image_id long, width int, height int, data binary")
    params = spark.createDataFrame([(7,), (8,)], "image_id long").withColumn("params", given(p))
    r = tiles.joined(tiles.edited(tiles.split(d, 64), params, size=64), 64).collect()
    want = render.full(a, p)
    assert len(r) == 1 and (r[0]["height"], r[0]["width"]) == want.shape[:2]
    assert (np.frombuffer(r[0]["data"], np.uint8).reshape(want.shape) == want).all()


def test_photos_with_their_own_edits(spark):
    photos = {1: picture(100, 80, 1), 2: picture(70, 140, 2), 3: picture(400, 380, 3)}
    edits = {1: {"clarity": 50.0}, 2: {"exposure": 20.0, "auto_contrast": 50.0}, 3: {"clarity": 30.0}}
    d = spark.createDataFrame([(i, a.shape[1], a.shape[0], bytearray(a.tobytes())) for i, a in photos.items()], "image_id long, width int, height int, data binary")
    params = None
    for i, p in edits.items():
        row = spark.createDataFrame([(i,)], "image_id long").withColumn("params", given(p))
        params = row if params is None else params.unionByName(row)
    for r in tiles.joined(tiles.edited(tiles.split(d, 64), params, size=64), 64).collect():
        want = render.full(photos[r["image_id"]], edits[r["image_id"]])
        assert (np.frombuffer(r["data"], np.uint8).reshape(want.shape) == want).all()
