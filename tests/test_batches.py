import numpy as np
import pandas as pd
import pytest

from grainline.operators import kernels, render
from grainline.sources import jpeg


class Caught:
    """A DataFrame's place: what is mapped is kept and run here."""

    def select(self, *_):
        return self

    def mapInPandas(self, run, schema):
        return run


SHEETS = pd.DataFrame([(i, 64, 64, np.full((64, 64, 3), i, np.uint8).tobytes(), None, None) for i in range(12)] + [(99, 0, 0, None, None, None)], columns=["image_id", "width", "height", "data", "params", "heals"])


def larger(a):
    return np.repeat(np.repeat(a, 24, 0), 24, 1)


@pytest.mark.parametrize("run", [lambda: kernels.each(Caught(), larger), lambda: render.render_full(Caught())], ids=["each", "render_full"])
def test_images_leave_a_task_in_small_tables(run, monkeypatch):
    monkeypatch.setattr(render, "full", lambda a, *_: larger(a))
    made = list(run()(iter([SHEETS])))
    assert [i for t in made for i in t.image_id] == SHEETS.image_id.tolist()
    assert max(t.data.map(lambda x: len(x or b"")).sum() for t in made) <= 24 << 20  # 85 MB in all


def test_encodings_are_those_of_each_size(spark):
    d = spark.createDataFrame([(int(i), 64, 64, bytearray(x)) for i, x in zip(SHEETS.image_id[:3], SHEETS.data)] + [(99, 0, 0, None)], kernels.PACKED)
    got = {r["image_id"]: r for r in render.encodings(d, {"small": (20, 75), "whole": (None, 88)}, lambda a: np.repeat(np.repeat(a, 24, 0), 24, 1)).collect()}
    for i in range(3):
        a = larger(np.full((64, 64, 3), i, np.uint8))
        assert got[i]["small"] == jpeg.encode(kernels.fit(a, 20), 75) and got[i]["whole"] == jpeg.encode(a, 88)
    assert got[99]["small"] is None and len(got) == 4
