"""Event logs, order statistics and the preview table against plain Python."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.functions import scalar as S
from grainline.operators import cull, previews, ranks, settings
from grainline.sources import images
from test_codecs import picture


def test_decisions_equal_the_fold(spark):
    pick, rows, want = random.Random(1), [], {}
    for path in range(150):
        now = None
        for seq in range(pick.randint(0, 9)):
            d = pick.choice(["keep", "reject", "later"][: pick.randint(1, 3)])
            rows.append((path, seq, d))
            now = None if now == d else d
        if now:
            want[path] = now
    log = spark.createDataFrame(rows, "path int, seq int, decision string")
    assert {r["path"]: r["decision"] for r in cull.decide(log).collect()} == want
    assert "collect_list" not in cull.decide(log)._jdf.queryExecution().toString()


def test_retouch_equals_the_fold(spark):
    pick, rows, want = random.Random(2), [], {}
    for path in range(150):
        now = []
        for seq in range(pick.randint(1, 14)):
            op = pick.choice(["add", "add", "undo", "clear", "add", "undo"] if path % 3 else ["add", "undo"])
            n = pick.randint(0, 2) if op == "add" else 0
            rows.append((path, seq, op, [(float(seq), 0.0, 0.0)] * n))
            now = [] if op == "clear" else now[:-1] if op == "undo" else now + [seq] if n else now
        want[path] = now
    log = spark.createDataFrame(rows, "path int, seq int, op string, stamps array<struct<x:float,y:float,r:float>>")
    got = {r["path"]: [int(s["stamps"][0]["x"]) for s in r["heals"]] for r in settings.retouch(log).collect()}
    assert got == want


def test_settings_equal_the_fold(spark):
    pick, rows, want = random.Random(3), [], {}
    frame = {"crop_x": 0.0, "crop_y": 0.0, "crop_w": 1.0, "crop_h": 1.0}
    for path in range(200):
        now = dict.fromkeys((*frame, "exposure"), 0.0)
        for seq in range(pick.randint(1, 10)):
            op = pick.choice(["update", "update", "update", "crop", "crop_on", "crop_on", "crop_off", "reset"])
            key, value, rect = pick.choice([*frame, "exposure"]), pick.choice([0.0, 0.3, 0.6]), (0.1, 0.2, pick.choice([0.0, 0.5]), 0.4)
            rows.append((path, seq, op, key, value, rect))
            if op == "update":
                now[key] = value
            elif op == "reset":
                now = dict.fromkeys(now, 0.0)
            elif op == "crop":
                now |= dict(zip(("crop_x", "crop_y", "crop_w", "crop_h"), rect))
            elif op == "crop_off":
                now |= dict.fromkeys(frame, 0.0)
            elif now["crop_w"] <= 0:
                now |= frame
        want[path] = now
    log = spark.createDataFrame(rows, "path int, seq int, op string, key string, value double, rect struct<x:double,y:double,w:double,h:double>")
    got = {r["path"]: {k: r[k] for k in want[0]} for r in settings.params(log).collect()}
    assert got == want
    log = spark.createDataFrame([("p", 1, "crop_on", None, None, None), ("p", 2, "update", "crop_x", 0.3, None), ("p", 3, "crop_on", None, None, None)], log.schema.simpleString().replace("path:int", "path:string"))
    r = settings.params(log).first()
    assert (r["crop_x"], r["crop_w"]) == (0.3, 1.0)


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one"])
def test_order_statistics(spark, monkeypatch, kind):
    monkeypatch.setattr(ranks, "BINS", 16)
    rng = np.random.default_rng(5)
    v = {"normal": rng.standard_normal(800), "ties": rng.integers(0, 4, 500) * 1.0, "wide": rng.standard_normal(300) * 10.0 ** rng.integers(-300, 300, 300), "one": np.array([7.5])}[kind].tolist()
    if kind == "wide":
        v += [-math.inf, math.inf, 1.7e308, -1.7e308, 0.0, -0.0, 5e-324]
    d = spark.createDataFrame([(x,) for x in v] + [(None,), (math.nan,)], "x double")
    places = (0, len(v) // 3, len(v) // 2, len(v) - 1, 10**9)
    n, got = ranks.at_ranks(d, "x", lambda n: places)
    assert n == len(v) and got == [sorted(v)[min(len(v) - 1, p)] for p in places]
    assert ranks.at_ranks(d.limit(0), "x", lambda n: [0]) == (0, [])


def test_previews_are_kept(spark, tmp_path):
    photos, table = tmp_path / "in", str(tmp_path / "previews")
    photos.mkdir()
    for i, name in enumerate(("a.png", "b.png", "bad.png")):
        (photos / name).write_bytes(images.png(53, 37, picture(seed=i).tobytes()) if i < 2 else b"no image")
        os.utime(photos / name, (1_700_000_000 + i, 1_700_000_000 + i))

    def edits(exposure):
        p = F.struct(*[F.lit(exposure if n == "exposure" else 0.0).cast("float").alias(n) for n in S.SLIDERS + S.CROP])
        paths = spark.createDataFrame([(f"file:{photos}/a.png",)], "path string")
        return paths.withColumns({"params": p, "heals": F.lit(None).cast("array<struct<stamps:array<struct<x:float,y:float,r:float>>>>")})

    def run(exposure):
        got = previews.refresh(spark, table, images.scan(spark, str(photos)), edits(exposure), edge=30).collect()
        return {r["path"].rsplit("/", 1)[1]: r for r in got}, previews.stored(spark, table).count()

    one, n = run(0.0)
    assert n == 3 and set(one) == {"a.png", "b.png", "bad.png"} and one["bad.png"]["error"] and one["a.png"]["before"] == one["a.png"]["after"]
    assert run(0.0) == (one, 3)  # nothing is rendered again
    two, n = run(60.0)
    assert n == 4 and two["a.png"]["before"] == one["a.png"]["before"] != two["a.png"]["after"] and two["b.png"] == one["b.png"]
    (photos / "b.png").write_bytes(images.png(53, 37, picture(seed=9).tobytes()))  # a changed file is noticed
    os.utime(photos / "b.png", (1_700_000_100, 1_700_000_100))
    three, n = run(60.0)
    assert n == 5 and three["b.png"]["after"] != two["b.png"]["after"] and three["a.png"] == two["a.png"]
