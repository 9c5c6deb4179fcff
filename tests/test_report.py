import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.operators import kernels, pixels, report
from grainline.plans import queries as Q


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """The smallest tables, with photos of no values, few, null, endless and too many values."""
    to = tmp_path_factory.mktemp("odd")
    kinds = {
        1: "null", 2: "[]::float[]", 3: "embedding[:30]", 4: "list_transform(embedding, lambda x, i: CASE WHEN i % 5 = 0 THEN NULL ELSE x END)",
        5: "list_transform(embedding, lambda x, i: CASE i WHEN 7 THEN 'nan'::float WHEN 9 THEN 'inf'::float WHEN 12 THEN '-inf'::float ELSE x END)",
        6: "embedding || embedding", 7: "list_transform(embedding, lambda x: 0::float)",
    }
    value = " ".join(f"WHEN {k} THEN {v}" for k, v in kinds.items())
    for t in ("events", "labels", "embeddings"):
        own = f"* REPLACE (CASE vec_id % 40 {value} ELSE embedding END AS embedding)" if t == "embeddings" else "*"
        duckdb.sql(f"COPY (SELECT {own} FROM '{sf}/{t}.parquet') TO '{to}/{t}.parquet'")
    return str(to)


@pytest.mark.parametrize("name", ["photo_labels", "library_report", "view_counts", "view_filter_all", "view_filter_blurry", "view_filter_rejects"])
def test_photos_without_values_stay(spark, odd, name):
    con = duckdb.connect()
    for t in ("events", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    want = con.sql(Q.ORACLES[name])
    got = Q.QUERIES[name](spark, odd).select(*want.columns)
    plain = lambda r: repr([float(v) if isinstance(v, float) else v for v in r])
    assert sorted(map(plain, map(tuple, got.collect()))) == sorted(map(plain, want.fetchall()))


def test_no_pixel_of_the_report_is_a_row(spark, sf, monkeypatch):
    given, build = [], report.build
    monkeypatch.setattr(report, "build", lambda rows, *a, **k: given.append(rows) or build(rows, *a, **k))
    Q.report(spark, sf)
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("Join") == 1  # the events'


def test_scores_of_grids_are_those_of_pixels(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 256, (5, 7, 9))  # five images, seven by nine
    g[4] = 3
    assert np.allclose(kernels.grid_blur(g.transpose(1, 2, 0)), [kernels.laplacian_score(a) for a in g], rtol=1e-12)
    d = spark.createDataFrame([(i, f"p{i}", a.ravel().tolist()) for i, a in enumerate(g)], "image_id long, name string, levels array<int>")
    px = d.select("image_id", F.posexplode("levels").alias("i", "l")).select("image_id", F.expr("int(i div 9)").alias("y"), F.expr("i % 9").alias("x"), "l")
    want = [{r["image_id"]: r["score"] for r in pixels.blur(p).collect()} for p in (px, pixels.region(px, 6, 1, 40, 3, 9, 7))]
    got = report.grid_scores(d, 9, 7, (6, 1, 40, 3)).collect()
    assert sorted(r["name"] for r in got) == [f"p{i}" for i in range(5)] and "levels" not in got[0]
    assert all(abs(r["frame_score"] - want[0][r["image_id"]]) < 1e-6 and abs(r["face_score"] - want[1][r["image_id"]]) < 1e-6 for r in got)
    assert report.grid_scores(d.where("false"), 9, 7, (0, 0, 1, 1)).count() == 0
