"""Second definitions and cases of operators that the tables do not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.operators import cull, exports, kernels, render, report
from grainline.sources import images
from test_codecs import picture


def plain_heal(a, stamps):
    """Healing pixel by pixel, with nothing vectorised."""
    out, (h, w) = a.astype(float).tolist(), a.shape[:2]
    for fx, fy, fr in stamps:
        r = int(min(max(2.0, math.floor(fr * w + 0.5)), min(w, h) / 3))
        cx, cy, big = math.floor(fx * w + 0.5), math.floor(fy * w + 0.5), int(1.5 * r)
        if cx - r - 1 < 0 or cy - r - 1 < 0 or cx + r + 1 >= w or cy + r + 1 >= h:
            continue
        ring = [(y, x) for y in range(-big, big + 1) for x in range(-big, big + 1) if r * r <= x * x + y * y <= big * big and 0 <= cx + x < w and 0 <= cy + y < h]
        best = None
        for far in (3.0, 5.0, 8.0):
            for k in range(12):
                sx, sy = cx + int(far * r * math.cos(k * math.tau / 12)), cy + int(far * r * math.sin(k * math.tau / 12))
                if min(sx, sy) - big < 0 or sx + big >= w or sy + big >= h or sx - r < 1 or sy - r < 1 or sx + r + 1 >= w or sy + r + 1 >= h:
                    continue
                cost = sum((out[cy + y][cx + x][c] - out[sy + y][sx + x][c]) ** 2 for y, x in ring for c in range(3)) / (3 * len(ring))
                if best is None or cost < best[0]:
                    best = cost, sx, sy
        if best is None:
            continue
        _, sx, sy = best
        disc = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if x * x + y * y <= r * r]
        src = [[list(p) for p in row] for row in out]
        for _ in range(180):
            for y, x in disc:
                for c in range(3):
                    s = lambda j, i: src[sy + j][sx + i][c]  # noqa: B023, E731
                    lap = 4 * s(y, x) - s(y - 1, x) - s(y + 1, x) - s(y, x - 1) - s(y, x + 1)
                    t = lambda j, i: out[cy + j][cx + i][c]  # noqa: B023, E731
                    out[cy + y][cx + x][c] = (t(y - 1, x) + t(y + 1, x) + t(y, x - 1) + t(y, x + 1) + lap) / 4
        out = [[[min(255.0, max(0.0, math.floor(v + 0.5))) for v in p] for p in row] for row in out]
    return np.array(out).astype(np.uint8)


def test_heal_equals_plain_loops():
    a = picture(64, 64, 5)
    stamps = [(0.5, 0.5, 0.06), (0.3, 0.6, 0.04), (0.02, 0.5, 0.1)]
    got = kernels.heal(a, stamps)
    assert (got == plain_heal(a, stamps)).all() and (got != a).any()


def test_registered_healing_changes_pixels(spark, sf):
    from grainline.plans import queries as q

    d = q.sheets(spark, sf).orderBy("image_id").collect()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert [(r["image_id"], r["width"], r["height"]) for r in d] == [(i, 64, 64) for i in range(-(-n // 64))]
    changed = {(r["image_id"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in q.heal(spark, sf).collect()}
    a = kernels.array(d[0])
    want = plain_heal(a, [(0.5, 0.5, 0.1), (0.3, 0.6, 0.05)])
    assert {k[1:]: v for k, v in changed.items() if k[0] == 0} == {(y, x): tuple(want[y, x].tolist()) for y, x in np.argwhere((want != a).any(2)).tolist()}
    assert {k[0] for k in changed} == {r["image_id"] for r in d}
    rows = [r for r in q.render_full(spark, sf).collect() if r["image_id"] == 0]
    p = q._ALL | {"straighten": 30.0, "noise_reduction": 20.0, "clarity": 20.0, "sharpening": 30.0, "crop_x": 0.1, "crop_y": 0.1, "crop_w": 0.8, "crop_h": 0.7}
    f32 = [tuple(float(np.float32(v)) for v in s) for s in ((0.5, 0.5, 0.1), (0.3, 0.6, 0.05))]
    by_parts = render.cropped(plain_heal(render.colour(kernels.straighten(a, 30.0), p), f32), p)
    out = np.zeros(by_parts.shape, np.uint8)
    for r in rows:
        out[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    assert len(rows) == by_parts.shape[0] * by_parts.shape[1] and (out == by_parts).all()


def test_report_of_a_folder(spark, tmp_path):
    big = np.repeat(np.repeat(picture(40, 60), 10, 0), 10, 1)
    other = np.repeat(np.kron(np.random.default_rng(7).integers(0, 256, (10, 10)), np.ones((5, 5), int))[..., None], 3, 2).astype(np.uint8)
    for name, a in {"a.png": big, "b.png": big, "c.png": other}.items():
        (tmp_path / name).write_bytes(images.png(a.shape[1], a.shape[0], a.tobytes()))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    files = images.scan(spark, str(tmp_path))
    d = {r["name"]: r for r in report.of_folder(images.decode(spark, str(tmp_path)), images.with_exif(files)).collect()}
    assert d["a.png"]["cluster"] == d["b.png"]["cluster"] == 1 and d["c.png"]["cluster"] is None
    size = lambda b: b[b.index(b"\xff\xc0") + 5 :][:4]
    assert size(d["a.png"]["thumbnail"]) == b"\0\xd5\x01\x40" and size(d["c.png"]["thumbnail"]) == b"\0\x32\0\x32"
    assert d["bad.png"]["error"] and d["bad.png"]["thumbnail"] is None and d["bad.png"]["width"] == 0
    one = images.decode(spark, str(tmp_path)).where("path like '%a.png'").withColumn("image_id", F.lit(1).cast("long"))
    r = report.single(one, F.col("path").endswith(".dng")).first()
    assert (r["width"], r["height"], r["is_raw"]) == (600, 400, False) and r["phash"] == kernels.perceptual_hash(big) and r["blur_score"] == kernels.laplacian_score(kernels.gray(big))
    assert kernels.resized_blur(big)[0] == r["blur_score"] > 0 and kernels.resized_blur(other)[1] > 0


def plain_drag(mode, x, y, w, h, dx, dy, least=0.05):
    clamp = lambda v, a, b: min(b, max(a, v))
    if mode == "move":
        return clamp(x + dx, 0, 1 - w), clamp(y + dy, 0, 1 - h), w, h
    x1, y1, x2, y2 = x, y, x + w, y + h
    x1 = clamp(x + dx, 0, x2 - least) if "w" in mode else x1
    x2 = clamp(x2 + dx, x1 + least, 1) if "e" in mode else x2
    y1 = clamp(y + dy, 0, y2 - least) if "n" in mode else y1
    y2 = clamp(y2 + dy, y1 + least, 1) if "s" in mode else y2
    return x1, y1, x2 - x1, y2 - y1


@pytest.mark.parametrize("mode", ["move", "n", "s", "w", "e", "nw", "ne", "sw", "se"])
def test_drags_of_every_mode(spark, mode):
    rng = np.random.default_rng(len(mode) + ord(mode[0]))
    rows = []
    for _ in range(60):
        w, h = rng.uniform(0.1, 0.6, 2)
        x, y = rng.uniform(0, 1 - w), rng.uniform(0, 1 - h)
        rows.append(tuple(map(float, (x, y, w, h, *rng.uniform(-0.7, 0.7, 2), rng.uniform(0.5, 2.0)))))
    d = spark.createDataFrame(rows, "x double, y double, w double, h double, dx double, dy double, ratio double")
    cols = [F.col(c) for c in ("x", "y", "w", "h", "dx", "dy")]
    got = d.select(exports.drag(mode, *cols).alias("free"), exports.drag(mode, *cols, ratio=F.col("ratio")).alias("locked")).collect()
    for r, row in zip(got, rows):
        assert tuple(r["free"]) == pytest.approx(plain_drag(mode, *row[:6]), abs=1e-12)
        x, y, w, h = r["locked"]
        if mode != "move":  # the shape holds, and the frame too
            assert w / h == pytest.approx(row[6], rel=1e-9) and min(x, y) > -1e-9 and x + w < 1 + 1e-9 and y + h < 1 + 1e-9
            if len(mode) == 1:  # the far side of a dragged side stays
                stay = {"n": (y + h, row[1] + row[3]), "s": (y, row[1]), "w": (x + w, row[0] + row[2]), "e": (x, row[0])}[mode]
                assert stay[0] == pytest.approx(stay[1], abs=1e-9)


def test_verdicts_and_strokes(spark):
    d = spark.createDataFrame([(False, None, None), (True, True, True), (True, False, True), (True, False, False)], "known boolean, both boolean, any boolean")
    got = [r[0] for r in d.select(cull.eyes_verdict_fine(F.col("known"), F.col("both"), F.col("any"))).collect()]
    assert got == ["no face detected", "BOTH CLOSED", "one closed", "open"]
    one = spark.range(1).select(cull.undo_stroke(F.array(F.lit(1), F.lit(2))).alias("a"), cull.undo_stroke(F.array().cast("array<int>")).alias("b")).first()
    assert one["a"] == [1] and one["b"] == []


def test_bursts_of_a_stream(spark, tmp_path):
    """Frames that come in two lots, the second with a late one: closed sessions are those of all frames at once."""
    import datetime as dt

    from grainline.streaming.bursts import streaming_bursts

    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, 0) + dt.timedelta(seconds=s)
    lots = [[0, 1, 2.5, 10, 11], [3.5, 40, 200]]
    every = spark.createDataFrame([(at(s),) for lot in lots for s in lot], "ts timestamp")
    whole = sorted((r["start"], r["frames"]) for r in streaming_bursts(every).collect())
    assert [n for _, n in whole] == [4, 2, 1, 1]
    source = str(tmp_path / "in")
    stream = spark.readStream.schema("ts timestamp").parquet(source) if (tmp_path / "in").mkdir() is None else None
    for k, lot in enumerate(lots):
        spark.createDataFrame([(at(s),) for s in lot], "ts timestamp").coalesce(1).write.mode("append").parquet(source)
        q = streaming_bursts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
    got = sorted((r["start"], r["frames"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == whole[:3]  # the last burst is still open
