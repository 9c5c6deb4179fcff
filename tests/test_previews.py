"""Previews cost what their pixels cost: few neighbours a pixel, and one coding of a band."""

import tracemalloc

import numpy as np
import pytest

from grainline.operators import kernels
from grainline.sources import jpeg

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("kind", ["area", "lanczos", "triangle"])
def test_a_resampling_holds_no_share_of_every_pixel_in_every_other(kind):
    a = RNG.integers(0, 256, (4, 6000, 3), np.uint8)
    tracemalloc.start()
    got = kernels.fit(a, 5000, kind)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (3, 5000, 3) and peak < 24 << 20  # 240 MB of shares


@pytest.mark.parametrize("shape, edge", [((96, 96), 20), ((61, 97), 96), ((40, 300), 7), ((1500, 20), 30), ((3, 1), 2)])
def test_areas_are_rounded_from_whole_sums(shape, edge):
    h, w = shape
    a = RNG.integers(0, 256, (h, w, 3), np.uint8)
    got = kernels.fit(a, edge)
    for y, x in np.ndindex(got.shape[:2]):
        near = [np.abs(np.arange(n) - ((i + 0.5) * n / m - 0.5)) < 0.5001 * n / m for i, n, m in ((y, h, got.shape[0]), (x, w, got.shape[1]))]
        part = a[near[0]][:, near[1]].astype(int)
        n = part.shape[0] * part.shape[1]
        assert got[y, x].tolist() == ((2 * part.sum((0, 1)) + n) // (2 * n)).tolist()


@pytest.mark.parametrize("kind", ["area", "lanczos", "triangle"])
def test_few_neighbours_give_what_all_shares_give(kind):
    f, r = kernels._kernel(kind)
    for a in (RNG.integers(0, 256, (50, 83, 3), np.uint8), RNG.random((9, 8, 1)) * 255):
        for h, w in ((32, 32), (50, 20), (120, 83), (1, 1)):
            v, u = kernels._weights(a.shape[0], h, r, f), kernels._weights(a.shape[1], w, r, f)
            assert np.abs(kernels.resize(a, w, h, kind) - np.einsum("hy,wx,yxc->hwc", v, u, a.astype(float))).max() < 1e-9


def test_a_band_is_coded_once_while_there_is_room(monkeypatch):
    a, seen, own = RNG.integers(0, 256, (64, 200, 3), np.uint8), [], jpeg._coefficients
    monkeypatch.setattr(jpeg, "BAND", 25)  # a row of blocks at a time
    monkeypatch.setattr(jpeg, "_coefficients", lambda *x: seen.append(1) or own(*x))
    whole = jpeg.encode(a, 90)
    assert len(seen) == 8
    monkeypatch.setattr(jpeg, "HELD", 25_000, raising=False)
    assert jpeg.encode(a, 90) == whole and 16 < len(seen) < 24
    monkeypatch.setattr(jpeg, "HELD", 0, raising=False)
    assert jpeg.encode(a, 90) == whole


def test_sheets_are_dealt_over_tasks_by_their_number(spark, sf, tmp_path):
    from grainline.plans import queries as q

    d = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = d.count()
    d.crossJoin(spark.range(5)).selectExpr(f"vec_id + id * {n} AS vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert q.preview_sizes(spark, str(tmp_path)).rdd.getNumPartitions() == -(-5 * n // 512) > 1
