import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.operators import groups, near


def hashes(n=900, seed=5):
    """Random hashes with near copies at all distances, equal ones, set sign bits and one value common to a band."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, n // 3)
    v = [int(base[i % len(base)]) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 20), False)) for i in range(n - 40)]
    return v[: n - 100] + [x & ~0xFFFF for x in v[n - 100 :]] + v[:40]


def brute(v, most):
    u = np.array(v, np.int64).view(np.uint64)
    d = np.bitwise_count(u[:, None] ^ u)
    return {(int(i), int(j), int(d[i, j])) for i, j in np.argwhere(d <= most) if i < j}


def united(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, _ in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks as large tables have them."""
    monkeypatch.setattr(groups, "LEAST_BLOCK", 100)
    monkeypatch.setattr(groups, "BLOCKS", 3)


@pytest.mark.parametrize("tile", [1 << 6, 1 << 16])
@pytest.mark.parametrize("most", [0, 7, 12, 18])
def test_kernels_find_every_pair_once(monkeypatch, tile, most):
    monkeypatch.setattr(near, "TILE", tile)
    monkeypatch.setattr(near, "WIDE", tile)
    v = hashes(200)
    u = np.array(v, np.int64).view(np.uint64)
    for search in (near.compared, near.banded) if tile > 1 << 6 or most < 12 else (near.compared,):
        same = [tuple(map(int, r)) for i, j, d in search(u, u, most, True) for r in zip(i, j, d)]
        assert len(same) == len(set(same)) and set(same) == brute(v, most)
        two = [(int(i), int(j) + 90) for a, b, _ in search(u[:90], u[90:], most) for i, j in zip(a, b)]
        assert len(two) == len(set(two)) and set(two) == {(i, j) for i, j, _ in brute(v, most) if i < 90 <= j}


@pytest.mark.parametrize("most,bands", [(16, None), (14, True), (12, False)])
def test_pairs_meet_in_blocks_and_not_in_joins(spark, small_blocks, most, bands):
    v = hashes()
    d = groups.similar_pairs(spark.createDataFrame([*enumerate(v), (5000, None), (None, 3)], "id long, phash long").repartition(3), most, bands=bands)
    rows = list(map(tuple, d.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == brute(v, most)
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()  # the expanded side of a join is reckoned small, and broadcast
    text = spark.createDataFrame([(f"p{i:04}", x) for i, x in enumerate(v)], "path string, h long")
    assert {(r["a"], r["b"], r["distance"]) for r in groups.similar_pairs(text, most, "path", "h", bands).collect()} == {(f"p{i:04}", f"p{j:04}", n) for i, j, n in brute(v, most)}


def test_what_pairs_send_grows_with_the_photos(spark):
    for n in (20_000, 80_000):
        sent = groups._met(spark.range(n).select("id", F.pmod("id", F.lit(groups._blocks(n, groups.LEAST_BLOCK))).cast("int").alias("_b")), groups._blocks(n, groups.LEAST_BLOCK))
        assert sent.count() == 12 * n


def test_clusters_and_links_by_blocks(spark, small_blocks):
    v = hashes() + [1 << 61 | (1 << i) - 1 for i in range(0, 40, 3)]  # and a chain
    v += [x ^ 1 << b for x in v[:1] for b in range(60)]  # and many that are all near each other
    df = spark.createDataFrame([*enumerate(v), (5000, None)], "id long, phash long").repartition(3)
    pairs = brute(v, 12)
    want = dict(enumerate(united(len(v), pairs)), **{}) | {5000: 5000}
    assert {r["id"]: r["group"] for r in groups.clusters(df, 12).collect()} == want
    linked = list(map(tuple, groups.links(df, 12).collect()))
    assert united(len(v), [(a, b, 0) for a, b in linked]) == [want[i] for i in range(len(v))]
    assert len(linked) < len(v) < len(pairs)  # no more than connect them
    text = spark.createDataFrame([(f"p{i:04}", x) for i, x in enumerate(v)], "path string, h long")
    assert {r["id"]: r["group"] for r in groups.clusters(text, 12, "path", "h").collect()} == {f"p{i:04}": f"p{g:04}" for i, g in want.items() if i < 5000}


@pytest.mark.parametrize("cost", [0, 200])
def test_nearest_by_bands_is_never_a_broadcast_of_turned_bands(spark, monkeypatch, cost):
    monkeypatch.setattr(groups, "ROW_COST", cost)  # 0: bands as long as there are masks
    v = hashes(400)
    want = {i: min((bin((x ^ y) & (2**64 - 1)).count("1"), j) for j, y in enumerate(v) if j != i) for i, x in enumerate(v)}
    for bands in (None, 3):
        got = groups.nearest(spark.createDataFrame(list(enumerate(v)), "id long, phash long"), bands=bands, few=0, block=60)
        assert {r["a"]: (r["distance"], r["nearest"]) for r in got.collect()} == want


def test_nearest_of_more_photos_than_were_compared_at_once(spark):
    v = np.random.default_rng(3).integers(0, 2**62, 8500)  # more than 1 << 26 pairs went to bands with thousands of masks
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "id long, phash long")
    got = {r["a"]: (r["distance"], r["nearest"]) for r in groups.nearest(rows).collect()}
    d = np.bitwise_count(v[:200, None] ^ v).astype(int)
    d[np.arange(200), np.arange(200)] = 99
    assert len(got) == 8500 and all(got[i] == (d[i].min(), d[i].argmin()) for i in range(200))
