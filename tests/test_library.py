import datetime as dt
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.functions import scalar as S
from grainline.operators import cull, exports, groups, kernels, pixels, render, report, settings
from grainline.plans import queries as Q
from grainline.sources import images

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(Q.ORACLES[name])
    got = Q.QUERIES[name](spark, sf).select(*want.columns)
    plain = lambda r: repr([float(v) if isinstance(v, float) else v for v in r])
    assert sorted(map(plain, map(tuple, got.collect()))) == sorted(map(plain, want.fetchall()))


def test_bursts_truncate_gaps_and_cross_midnight(spark):
    t = dt.datetime(2024, 1, 15, 23, 59, 57)
    rows = [(0, t), (1, t + dt.timedelta(seconds=2.9)), (2, t + dt.timedelta(seconds=4.9)), (3, t + dt.timedelta(seconds=7.9)), (4, None), (5, None)]
    got = {r["id"]: r["burst"] for r in groups.bursts(spark.createDataFrame(rows, "id long, ts timestamp_ntz")).collect()}
    assert got[0] == got[1] == got[2] == 1 and got[3] == 2 and {got[4], got[5]} == {3, 4}


def test_band_join_equals_theta_join(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 60)
    v = [int(base[i % 60]) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 6), False)) for i in range(700)]
    df = spark.createDataFrame(list(enumerate(v)), "id long, phash long")
    for most in (3, 6):
        got = {(r["a"], r["b"]) for r in groups.similar_pairs(df, most).collect()}
        want = {(i, j) for i in range(700) for j in range(i + 1, 700) if bin((v[i] ^ v[j]) & (2**64 - 1)).count("1") <= most}
        assert got == want


def test_eye_rules(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    flat = F.array(*[p(0, 0)] * 388)
    r = spark.range(1).select(S.eyes(flat, 0.22).alias("e"), S.eyes(F.slice(flat, 1, 10), 0.22).alias("few")).first()
    assert r["e"]["left_ear"] == 0 and r["e"]["both_closed"] and r["few"] is None


def test_noop_and_percentile(spark):
    h = spark.createDataFrame([(1, 7, 5), (1, 200, 40)], "image_id long, bin int, n long")
    assert pixels.percentile_bin(h, 0.01).first()["bin"] == 0  # 1 % of 45 truncates to nothing
    zero = F.struct(*[F.lit(0.0).alias(n) for n in S.SLIDERS + S.CROP])
    hue = F.struct(*[F.lit(200.0 if n == "shadow_hue" else 0.0).alias(n) for n in S.SLIDERS + S.CROP])
    assert spark.range(1).select(S.is_noop(zero), S.is_noop(hue)).first()[:] == (True, False)


def test_names_do_not_collide(spark):
    rows = [(0, "a.jpg"), (1, "a.jpg"), (2, "a (1).jpg"), (3, "a.jpg"), (4, "b")]
    d = spark.createDataFrame(rows, "position long, base_name string")
    have = spark.createDataFrame([("b",)], "name string")
    got = {r["position"]: r["target"] for r in exports.unique_names(d, have).collect()}
    assert got == {0: "a.jpg", 1: "a (1).jpg", 2: "a (1) (1).jpg", 3: "a (2).jpg", 4: "b (1)"}


def test_decisions_toggle(spark):
    log = spark.createDataFrame([("p", 1, "keep"), ("p", 2, "keep"), ("q", 1, "keep"), ("q", 2, "reject")], "path string, seq int, decision string")
    assert {r["path"]: r["decision"] for r in cull.decide(log).collect()} == {"q": "reject"}


def test_kernels_behave():
    y, x = np.mgrid[:128, :128]
    board = np.repeat((((x + y) % 2) * 255).astype(np.uint8)[..., None], 3, 2)
    soft = kernels.bytes_of(kernels.gaussian(board, 4))
    assert kernels.laplacian_score(kernels.gray(board)) > 5 * kernels.laplacian_score(kernels.gray(soft))
    wave = lambda s: np.repeat(np.clip(128 + 40 * sum((np.sin(2 * np.pi * k * x / 128 + s) + np.cos(2 * np.pi * k * y / 128 + 0.7 * s)) / k for k in range(1, 7)), 0, 255).astype(np.uint8)[..., None], 3, 2)
    far = lambda a, b: bin((kernels.perceptual_hash(a) ^ kernels.perceptual_hash(b)) & (2**64 - 1)).count("1")
    assert far(wave(0), kernels.bytes_of(kernels.gaussian(wave(0), 1))) <= 12 < far(wave(0), wave(1))
    n = (31 * x + 17 * y)[:48, :48] % 11
    noisy = np.repeat(np.where(n == 0, 255, np.where(n == 1, 0, 128)).astype(np.uint8)[..., None], 3, 2)
    assert kernels.denoise(noisy, 80).std() < 0.85 * noisy.std()
    spot = np.full((80, 80, 3), 130, np.uint8)
    spot[(np.mgrid[:80, :80] - 40).__pow__(2).sum(0) <= 30] = 40
    assert kernels.heal(spot, [(0.5, 0.5, 6 / 80)])[40, 40].mean() > 100
    turned = kernels.straighten(wave(0), 100)
    assert turned.shape[0] < 128 and (turned < 3).all(2).mean() < 0.02


def test_folder_round_trip(spark, tmp_path):
    data = bytes(range(48)) * 4
    (tmp_path / "a.png").write_bytes(images.png(8, 8, data))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"")
    assert [r["path"].rsplit("/", 1)[1] for r in images.scan(spark, str(tmp_path)).select("path").collect()] == ["a.png", "bad.png"]
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.decode(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.png"]["data"]) == data and rows["bad.png"]["error"]
    assert images.with_exif(images.scan(spark, str(tmp_path))).where("taken is not null").count() == 0
    assert images.load_presets(spark, str(tmp_path / "none.json")).count() == 0
    # undecodable images pass through kernels as rows without pixels
    d = images.decode(spark, str(tmp_path)).withColumn("image_id", F.monotonically_increasing_id())
    assert sorted(r["data"] is None for r in render.thumbnails(d).collect()) == [False, True]
    assert kernels.hashes(d).where("phash is null").count() == 1


def test_presets_round_trip(spark, tmp_path):
    path = str(tmp_path / "presets.json")
    zero = F.struct(*[F.lit(float(i)).cast("float").alias(n) for i, n in enumerate(S.SLIDERS + S.CROP)])
    three = spark.createDataFrame([("a",), ("b é",), ("c",)], "name string").withColumn("params", zero)
    images.save_presets(three, path)
    images.save_presets(images.load_presets(spark, path), path)
    got = images.load_presets(spark, path).collect()
    assert [r["name"] for r in got] == ["a", "b é", "c"] and got[2]["params"]["crop_h"] == len(S.SLIDERS) + 3
    (tmp_path / ".presets.json.crc").unlink(missing_ok=True)  # written by another program from here on
    (tmp_path / "presets.json").write_text('[{"name": "x", "params": {"exposure": 3}}]')
    got = images.load_presets(spark, path).collect()
    assert got[0]["params"]["exposure"] == 3 and got[0]["params"]["tint"] == 0
    for bad in ("{oops", ""):
        (tmp_path / "presets.json").write_text(bad)
        assert images.load_presets(spark, path).count() == 0


def test_file_lists(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
    (tmp_path / "a" / "notes.txt").write_text("x")
    for name in ("z.PNG", "y.jpg"):
        (tmp_path / "b" / name).write_bytes(b"x")
    folder, d = images.scan_files(spark, [str(tmp_path / p) for p in ("a/notes.txt", "b/z.PNG", "b/y.jpg")])
    assert folder == str(tmp_path / "b") and d.count() == 2
    assert images.scan_files(spark, [str(tmp_path / "a/notes.txt")])[0] == ""
    assert [r["path"].rpartition("/")[2] for r in images.ordered(images.scan(spark, str(tmp_path / "b"))).collect()] == ["y.jpg", "z.PNG"]


PHOTO = "path long, name string, width int, height int, frame_score double, face_score double, eyes struct<both_closed:boolean>, phash long, ts timestamp_ntz, error string"


def test_report_groups_without_failed_photos(spark):
    t = dt.datetime(2024, 1, 15, 14, 30)
    s = lambda k: t + dt.timedelta(seconds=k)
    bridge, far = (1 << 8) - 1, (1 << 16) - 1  # 0 and far meet by the bridge only
    rows = [
        (1, "a", 4, 4, 500.0, 5.0, (True,), 0, s(0), None), (2, "b", 4, 4, 5.0, 500.0, (False,), bridge, s(1), "cannot decode"), (3, "c", 4, 4, 5.0, None, None, far, s(3.5), None),
        (4, "d", 4, 4, 5.0, None, None, far, None, None), (5, "e", 4, 4, 500.0, None, None, -1, s(5.9), None),
    ]
    got = {r["path"]: r for r in report.build(spark.createDataFrame(rows, PHOTO), most=8).collect()}
    assert [got[i]["cluster"] for i in range(1, 6)] == [None, None, 1, 1, None]
    assert [got[i]["burst"] for i in range(1, 6)] == [None, None, 1, None, 1]  # the failed frame joins nothing
    assert [got[i]["is_blurry"] for i in range(1, 6)] == [True, False, True, True, False]
    assert got[2]["width"] == 0 and got[2]["error"] and got[2]["phash"] is None and not got[2]["has_face"] and got[2]["timestamp"] is None
    assert got[3]["timestamp"] == "2024-01-15 14:30:03" and got[1]["eyes"]["both_closed"] and got[3]["eyes"] is None
    assert report.build(spark.createDataFrame([], PHOTO)).count() == 0
    with pytest.raises(ValueError):
        report.duplicate_clusters(spark.createDataFrame([(1, 5, None), (2, 6, "broken")], "id long, phash long, error string"))


@pytest.mark.parametrize("bands,few", [(None, 0), (2, 0), (3, 0), (None, 1 << 26)])
def test_nearest_equals_brute_force(spark, bands, few):
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**62), 2**62, 200)
    v = [int(base[i % 40]) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 12), False)) for i in range(400)] + [int(base[0])] * 3 + base.tolist() + [None]
    ids = rng.permutation(len(v)).tolist()
    df = spark.createDataFrame(list(zip(ids, v)), "id long, phash long")
    full = [(i, x) for i, x in zip(ids, v) if x is not None]
    want = sorted((i, *min((bin((x ^ y) & (2**64 - 1)).count("1"), j) for j, y in full if j != i)[::-1]) for i, x in full)
    d = groups.nearest(df, bands=bands, few=few, block=150)
    assert sorted(map(tuple, d.collect())) == want
    assert "NestedLoop" not in d._jdf.queryExecution().toString() and groups.nearest(df.limit(0)).count() == 0


def test_group_numbers_by_ranges(spark):
    d = spark.range(900).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), (F.col("id") * 7 % 211).cast("string"))).otherwise(F.col("id").cast("string")).alias("g"))
    same = lambda few: sorted(map(tuple, groups.number_groups(d, "g", "n", few).select("id", "g", "n").collect()))
    got, size = same(0), {}
    for _, g, _ in got:
        size[g] = size.get(g, 0) + 1
    number = {g: i + 1 for i, g in enumerate(sorted(g for g in size if size[g] > 1))}
    assert got == same(1000) and all(n == number.get(g) for _, g, n in got) and len(number) > 100


def test_components_by_rounds_and_at_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    e = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))], "a long, b long")
    n = spark.range(120)
    once = sorted(map(tuple, groups.components(n, e).collect()))
    monkeypatch.setattr(groups, "FEW_EDGES", -1)
    assert sorted(map(tuple, groups.components(n, e).collect())) == once


@pytest.mark.parametrize("w, h", [(600, 100), (100, 600), (64, 64), (96, 64), (3, 2)])
@pytest.mark.parametrize("slider", [100, -40, 3])
def test_straighten_keeps_the_inscribed_rectangle(w, h, slider):
    out = kernels.straighten(np.full((h, w, 3), 200, np.uint8), slider)
    iw, ih = kernels.inscribed(w, h, np.radians(0.1 * slider))
    assert out.shape[1] == max(1, min(int(iw * 0.985), w)) and out.shape[0] == max(1, min(int(ih * 0.985), h))
    assert w < 50 or (out > 190).mean() > 0.99  # no border


def test_heal_sweeps_in_order():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 255, (60, 60, 3)).astype(np.uint8)
    got = kernels.heal(a, [(0.5, 0.5, 0.07)])
    assert (got[:20] == a[:20]).all() and (got[28:33, 28:33] != a[28:33, 28:33]).any()
    assert (kernels.heal(a, [(0.01, 0.5, 0.07)]) == a).all()  # no room around the spot


def test_colour_of_packed_images_equals_pixel_rows(spark, sf):
    px = Q.rgb(spark, sf).where("image_id < 12")
    rows = pixels.render(px, Q._ALL | {"auto_contrast": 50}, 8, 8).collect()
    images_ = {r.image_id: kernels.array(r) for r in kernels.pack(px).toPandas().itertuples()}
    want = {k: render.colour(a, Q._ALL | {"auto_contrast": 50}) for k, a in images_.items()}
    off = [abs(int(want[r["image_id"]][r["y"], r["x"], c]) - r["rgb"[c]]) for r in rows for c in range(3)]
    assert max(off) <= 1 and sum(off) <= len(off) // 100


def test_whole_edit():
    y, x = np.mgrid[:64, :96]
    a = np.stack([x * 255 // 95, x * 191 // 95, 255 - x * 255 // 95], 2).astype(np.uint8)
    assert (render.full(a, {}) == a).all()  # no edit changes nothing
    p = {"straighten": 60.0, "exposure": 20.0, "crop_x": 0.25, "crop_y": 0.5, "crop_w": 0.5, "crop_h": 0.5, "clarity": 30.0}
    turned = kernels.straighten(a, 60.0)
    want = render.cropped(kernels.heal(render.colour(turned, p), [(0.5, 0.5, 0.05)]), p)
    got = render.full(a, p, [{"stamps": [{"x": 0.5, "y": 0.5, "r": 0.05}]}])
    assert (got == want).all() and got.shape[1] == int(turned.shape[1] * 0.5 + 0.5)
    extremes = dict.fromkeys(S.SLIDERS, 100.0)
    assert render.full(a, extremes).dtype == np.uint8 and render.full(a, {k: -100.0 for k in S.SLIDERS}).size
    for edge in (320, 900, 1400):
        big = kernels.fit(np.zeros((2000, 3000, 3), np.uint8), edge)
        assert max(big.shape) == edge and kernels.fit(a, edge) is a


def test_watermarks():
    a = np.full((100, 200, 3), 100, np.uint8)
    mark = np.zeros((10, 20, 4), np.uint8)
    mark[..., 0], mark[..., 3] = 255, 255
    out = render.stamp_image(a, mark, "topLeft", 50, 0)  # a tenth of the width, margin 6
    assert out[6:16, 6:26, 0].min() == 178 and out[6:16, 6:26, 1].max() == 50 and (out[16:] == 100).all() and (out[:, 26:] == 100).all()
    assert (render.watermark(a, {"kind": "text", "text": " "}) == a).all() and (render.watermark(a, {"kind": "odd"}) == a).all()


def test_export_texts(spark):
    text = spark.range(1).select(exports.status(F.lit(1), F.lit("x"), F.array(F.lit("e")))).first()[0]
    assert text == "Exported 1 photo to x — 1 failed (e)"
    items = spark.range(1)
    assert exports.request(items, True, "  ", 1, "text", " ")[1:] == (None, None) and exports.request(items, True, " S ", 4)[1] == {"prefix": "S", "start": 4}


def test_faces_without_models(spark):
    from grainline.types import LEFT_EYE, RIGHT_EYE

    points = [(0.0, 0.0)] * 468
    for eye in (LEFT_EYE, RIGHT_EYE):
        for at, q in zip(eye, [(0, 0), (5, 3), (15, 3), (20, 0), (15, -3), (5, -3)]):
            points[at] = (float(q[0]), float(q[1]))
    boxes = spark.createDataFrame([(1, 0, 0, 10.0, 10.0, 20.0, 20.0, 0.9), (2, 0, 0, 10.0, 10.0, 20.0, 20.0, 0.9)], "image_id long, rank int, pos long, x double, y double, w double, h double, score double")
    marks = spark.createDataFrame([(1, points), (2, points[:10])], "image_id long, points array<struct<x:double,y:double>>")
    y, x = np.mgrid[:64, :64]
    board = np.repeat((((x + y) % 2) * 255).astype(np.uint8)[..., None], 3, 2).tobytes()
    frames = spark.createDataFrame([(1, 64, 64, bytearray(board)), (2, 64, 64, bytearray(board)), (3, 64, 64, bytearray(board))], "image_id long, width int, height int, data binary")
    got = report.analyse_faces(boxes, marks, frames).collect()
    assert [r["image_id"] for r in got] == [1] and not got[0]["eyes"]["any_closed"] and got[0]["face_score"] > 1000
    assert got[0]["eyes"]["left_ear"] == pytest.approx(0.3, abs=1e-6)
    assert kernels.region_blur(np.zeros((0, 0, 3), np.uint8), 0, 0, 1, 1) == 0 and kernels.region_blur(np.zeros((9, 9, 3), np.uint8), 50, 50, 1, 1) == 0


def test_hash_text(spark):
    d = spark.createDataFrame([(5, -7), (-1, 0)], "a long, b long")
    r = d.select(report.hash_of(report.text_of(F.col("a"))).alias("a"), report.text_distance(report.text_of(F.col("a")), report.text_of(F.col("b"))).alias("d")).collect()
    assert [x["a"] for x in r] == [5, -1] and r[1]["d"] == 64
    for bad in ("!", "AAAA", None):
        with pytest.raises(Exception, match="bad hash"):
            spark.createDataFrame([(bad,)], "t string").select(report.hash_of(F.col("t"))).collect()


def test_exif_rows_and_small_things(spark):
    d = spark.createDataFrame([("p", ("M", None, "100", "f/2", None, ""))], "path string, exif struct<model:string,lens:string,iso:string,aperture:string,shutter:string,focal:string>")
    assert [(r["name"], r["value"]) for r in settings.exif_rows(d).collect()] == [("Camera", "M"), ("ISO", "100"), ("Aperture", "f/2")]
    assert [r[0] for r in spark.range(1, 3).select(settings.counted(F.col("id"), "photo")).collect()] == ["1 photo", "2 photos"]


def test_exif_times(spark, tmp_path):
    """A TIFF with an Exif block: capture time with a sub-second part."""
    taken, sub = b"2024:01:15 14:30:01\0", b"25\0\0"
    ifd0 = b"\x01\x00" + struct.pack("<HHII", 0x8769, 4, 1, 26) + b"\0" * 4
    sub_ifd = b"\x02\x00" + struct.pack("<HHII", 0x9003, 2, 20, 56) + struct.pack("<HHI", 0x9291, 2, 3) + sub + b"\0" * 4
    (tmp_path / "t.tif").write_bytes(b"II*\0" + struct.pack("<I", 8) + ifd0 + sub_ifd + taken)
    r = images.with_exif(images.scan(spark, str(tmp_path))).select("taken").first()
    assert r["taken"] == dt.datetime(2024, 1, 15, 14, 30, 1, 250_000)
