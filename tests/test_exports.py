import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.functions import scalar as S
from grainline.operators import exports, render
from grainline.sources import images, sink
from test_codecs import make_font, make_tiff, picture


def plain_names(items, existing=()):
    """The fold that allocation stands for: in item order the first name that is free."""
    used, out = set(existing), {}
    for position, base in sorted(items):
        stem, dot, end = base.rpartition(".")
        stem, dot = (stem, dot) if stem else (base, "")
        n, got = 0, base
        while got in used:
            n += 1
            got = f"{stem} ({n}){dot}{end if dot else ''}"
        used.add(got)
        out[position] = got
    return out


def allotted(spark, items, existing=()):
    d = spark.createDataFrame(items, "position long, base_name string")
    have = spark.createDataFrame([(x,) for x in existing], "name string") if existing else None
    return {r["position"]: r["target"] for r in exports.unique_names(d, have).collect()}


def test_names_equal_the_fold(spark):
    """Many small families at once, each with names of its own, so that one run holds many cases."""
    pick, items, existing, position = random.Random(3), [], [], 0
    for family in range(120):
        s = f"f{family}"
        pool = [f"{s}.jpg", f"{s} (1).jpg", f"{s} (2).jpg", f"{s} (3).jpg", f"{s} (1) (1).jpg", f"{s} (1) (2).jpg", f"{s}", f"{s} (1)", f"{s} (01).jpg", f"{s} (0).jpg", f".{s}", f".{s} (1)", f"{s}.", f"{s} (1)."]
        existing += [x for x in pool if pick.random() < 0.15]
        for _ in range(pick.randint(1, 12)):
            items.append((position, pick.choice(pool[: pick.choice([2, 6, len(pool)])])))
            position += 1
    pick.shuffle(items)
    got = allotted(spark, items, existing)
    assert got == plain_names(items, existing)
    assert len(set(got.values())) == len(items) and not set(got.values()) & set(existing)


def test_names_of_a_large_family(spark):
    items = [(i, "a.jpg") for i in range(3000)] + [(3000 + i, f"a ({i}).jpg") for i in range(1, 3000, 7)] + [(1, "b")]
    items += [(-1 - i, f"a ({i}).jpg") for i in range(1, 400, 3)]
    assert allotted(spark, items) == plain_names(items)
    assert allotted(spark, [(0, "a.jpg"), (1, "a.jpg"), (2, "a (1).jpg")]) == {0: "a.jpg", 1: "a (1).jpg", 2: "a (1) (1).jpg"}
    assert allotted(spark, [(0, "a.jpg"), (1, "a (1).jpg"), (2, "a.jpg")], ["a.jpg"]) == {0: "a (1).jpg", 1: "a (1) (1).jpg", 2: "a (2).jpg"}


def test_sink_writes_bytes_and_may_run_again(spark, tmp_path):
    dest = f"file:{tmp_path}"
    (tmp_path / "taken.bin").write_bytes(b"mine")
    bodies = {0: b"", 1: b"\n", 2: b"line\r\nend\n", 3: bytes(range(256)) * 40, 4: b"\xff\xd9", 5: "é".encode(), 6: b"x", 7: None}
    names = {i: f"f {i} é.bin" for i in bodies} | {6: "taken.bin"}
    d = spark.createDataFrame([(i, names[i], b and bytearray(b), "own fault" if i == 7 else None) for i, b in bodies.items()], "position long, target string, content binary, error string")
    d = d.withColumn("content", F.when(F.col("position") == 0, F.lit(b"")).otherwise(F.col("content")))
    where = sink.stage(d, dest)
    first = {r["position"]: (r["ok"], r["error"]) for r in sink.commit(spark, dest, where).collect()}
    again = {r["position"]: (r["ok"], r["error"]) for r in sink.commit(spark, dest, where).collect()}
    assert first == again == {**{i: (True, None) for i in range(6)}, 6: (False, "taken.bin: File exists"), 7: (False, "own fault")}
    for i in range(6):
        assert (tmp_path / names[i]).read_bytes() == bodies[i]
    assert (tmp_path / "taken.bin").read_bytes() == b"mine" and not list(tmp_path.glob(".f*"))
    # half of the moves done before a crash
    where = sink.stage(d.where("position in (2, 3)").withColumn("target", F.concat(F.lit("n"), F.col("position").cast("string"))), dest)
    moved = next((tmp_path / where.rsplit("/", 1)[1]).rglob("position=3/part-*"))
    moved.rename(tmp_path / "n3")
    assert [r["ok"] for r in sink.commit(spark, dest, where).collect()] == [True, True] and (tmp_path / "n2").read_bytes() == bodies[2]
    # a whole export leaves no attempts
    before = set(tmp_path.glob(".attempt-*"))
    assert sink.write_files(d.where("position = 4").withColumn("target", F.lit("last")), dest).first()["ok"] and set(tmp_path.glob(".attempt-*")) == before


def test_sink_through_sparks_file_system_only(spark, tmp_path):
    """The destination is a mount that only Spark's file systems know."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shop.link./out", f"file://{tmp_path}")
    d = spark.createDataFrame([(1, "a.bin", bytearray(b"abc"))], "position long, target string, content binary")
    r = sink.write_files(d, "viewfs://shop/out").first()
    assert r["ok"] and (tmp_path / "a.bin").read_bytes() == b"abc"


def test_export_of_every_kind(spark, tmp_path):
    src, dest = tmp_path / "in", tmp_path / "out"
    src.mkdir(), dest.mkdir()
    a = picture(40, 60)
    (src / "a.png").write_bytes(images.png(60, 40, a.tobytes()))
    (src / "b.tif").write_bytes(make_tiff(a, compression=5))
    (src / "c.png").write_bytes(b"nothing")
    p = F.struct(*[F.lit(50.0 if n == "exposure" else 0.0).cast("float").alias(n) for n in S.SLIDERS + S.CROP])
    files = images.scan(spark, str(src)).select("path", "content").join(images.decode(spark, str(src)), "path")
    paths = [f"file:{src}/a.png", f"file:{src}/b.tif", f"file:{src}/c.png", "file:/gone.png", "file:/nowhere/", f"file:{src}/a.png", f"file:{src}/b.tif"]
    items = spark.createDataFrame([(x, i, i in (0, 5), True) for i, x in enumerate(paths)], "path string, position long, noop boolean, retouch_empty boolean")

    def run(**mark):
        planned = exports.unique_names(exports.plan(items, True, watermark=bool(mark)), spark.createDataFrame([(x.name,) for x in dest.iterdir()], "name string"))
        planned = planned.withColumns({"params": p, "heals": F.lit(None).cast("array<struct<stamps:array<struct<x:float,y:float,r:float>>>>")})
        done = exports.execute(planned, files, f"file:{dest}", **mark).unionByName(exports.skipped(items))
        return exports.summary(done).first()

    r = run()
    assert r["copied"] == 4 and [x.rsplit(": ", 1)[-1] for x in r["errors"]] == ["cannot decode", "not found", "file:/nowhere/"] and r["errors"][2].startswith("skipped (no file name)")
    assert sorted(x.name for x in dest.iterdir()) == ["a (1).png", "a.png", "b (1).jpg", "b.jpg"]
    assert (dest / "a.png").read_bytes() == (src / "a.png").read_bytes() == (dest / "a (1).png").read_bytes()
    back = {x["path"].rsplit("/", 1)[1]: x for x in images.decode(spark, str(dest)).collect()}
    got = np.frombuffer(back["b.jpg"]["data"], np.uint8).reshape(40, 60, 3)
    want = render.full(a, {"exposure": 50.0})
    assert (dest / "b.jpg").read_bytes()[:2] == b"\xff\xd8" and np.abs(got.astype(int) - want).mean() < 6
    r = run(mark={"kind": "text", "text": "AD", "position": "center", "opacity": 100, "size": 100}, font=make_font())
    assert r["copied"] == 4 and len(r["errors"]) == 3  # all are rendered now; a name that is taken moves on
    assert (dest / "a.jpg").exists() and (dest / "b (2).jpg").exists() and (dest / "b (3).jpg").exists()
    assert run(mark={"kind": "text", "text": "AD"})["errors"][0].endswith("no font found for the text watermark")


def test_previews_show_one_frame(spark):
    a = picture(60, 90)
    p = F.struct(*[F.lit({"crop_x": 0.25, "crop_y": 0.25, "crop_w": 0.5, "crop_h": 0.5, "exposure": 40.0, "straighten": 10.0}.get(n, 0.0)).cast("float").alias(n) for n in S.SLIDERS + S.CROP])
    d = spark.createDataFrame([(1, 90, 60, bytearray(a.tobytes())), (2, 0, 0, None)], "image_id long, width int, height int, data binary")
    d = d.withColumns({"params": p, "heals": F.lit(None).cast("array<struct<stamps:array<struct<x:float,y:float,r:float>>>>")})
    size = lambda b: b[b.index(b"\xff\xc0") + 5 :][:4]
    cut, whole = (render.preview(d, crop_preview=c, edge=80).orderBy("image_id").collect() for c in (False, True))
    assert size(cut[0]["before"]) == size(cut[0]["after"]) != size(whole[0]["before"]) == size(whole[0]["after"])
    assert cut[0]["before"] != cut[0]["after"] and cut[1]["before"] is None


@pytest.mark.parametrize("path,ok", [("/a/b.jpg", True), ("b", True), ("/a/", False), ("", False), ("/a/..", False)])
def test_named(spark, path, ok):
    assert spark.range(1).select(exports.named(F.lit(path))).first()[0] is ok
