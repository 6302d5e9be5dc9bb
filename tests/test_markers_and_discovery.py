"""Marker triangles (P17), folder upserts (T03) and choices that had a slow or skewed form."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelkeel.operators import features as A
from voxelkeel.operators import labels as L
from voxelkeel.operators import matching as M
from voxelkeel.sources import projects as SP
from voxelkeel.sources.recordings import find_recordings
from voxelkeel.streaming import operators as ST

CORNERS = np.array([[-40.0, -30.0], [440.0, -30.0], [-40.0, 330.0], [440.0, 330.0]])


@pytest.mark.parametrize("n", [0, 1, 2, 5, 12, 60])
def test_circumcircles_are_empty_and_triangles_fill_the_rectangle(n):
    rng = np.random.default_rng(n)
    for _ in range(15):
        points = np.vstack([CORNERS, rng.uniform([0, 0], [400, 300], (n, 2))])
        tri = L.delaunay(points)
        assert len(tri) == 2 * n + 2
        a, b, c = (points[tri[:, k]] for k in range(3))
        area = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
        assert (area > 0).all() and np.isclose(area.sum(), 480 * 360)
        for t in tri:
            centre = np.linalg.solve(2 * (points[t[1:]] - points[t[0]]), (points[t[1:]] ** 2).sum(1) - (points[t[0]] ** 2).sum())
            assert (np.linalg.norm(points - centre, axis=1) >= np.linalg.norm(points[t[0]] - centre) * (1 - 1e-9)).all()


def test_points_on_a_grid_on_top_of_each_other_and_outside():
    grid = np.array([(40.0 * x, 30.0 * y) for x, y in itertools.product(range(1, 9), range(1, 9))])
    points = np.vstack([CORNERS, grid, grid[:3], [[900.0, 10.0]], [[-40.0, 100.0]]])
    tri = L.delaunay(points)
    assert len(tri) == 2 * len(grid) + 2 and tri.max() < 4 + len(grid)


def test_markers_of_a_series_move_their_own_places(spark):
    doc = '{"target": "ABA_Mouse_CCFv3_2017_25um.cutlas", "slices": [{"filename": "a_s001.png", "nr": 1, "width": 400, "height": 300, "anchoring": [1,2,3,4,5,6,7,8,9], "markers": [[100, 80, 110, 85], [300, 200, 290, 215], [200, 60, 200, 60]]}, {"filename": "a_s002.png", "nr": 2, "width": 400, "height": 300, "anchoring": [1,2,3,4,5,6,7,8,9]}]}'
    series = SP.parse_quint(spark.createDataFrame([("s", doc)], "series string, doc string"))
    sections = series.withColumn("section", F.col("series_number"))
    tri = L.marker_triangles(sections)
    assert {r.section: r["count"] for r in tri.groupBy("section").count().collect()} == {1: 8, 2: 2}
    points = spark.createDataFrame([(1, 100.0, 80.0), (1, 300.0, 200.0), (1, 200.0, 60.0), (1, -999.0, 0.0), (2, 33.0, 44.0)], "section long, x_px double, y_px double")
    out = {(r.section, r.x_px): (r.x_warped, r.y_warped) for r in L.warp_triangles(points, tri).collect()}
    assert np.allclose([out[1, 100.0], out[1, 300.0], out[1, 200.0], out[1, -999.0], out[2, 33.0]], [(110, 85), (290, 215), (200, 60), (-999, 0), (33, 44)])
    # and back, through the same triangles the other way round
    back = tri.select("section", "tri", *[F.col(f"{b}{n}{x}").alias(f"{a}{n}{x}") for a, b in ("pq", "qp") for n in (1, 2, 3) for x in "xy"])
    inner = spark.createDataFrame([(1, float(x), float(y)) for x in range(20, 400, 60) for y in range(20, 300, 50)], "section long, x_px double, y_px double")
    there = L.warp_triangles(inner, tri).select("section", F.col("x_px").alias("x"), F.col("y_px").alias("y"), F.col("x_warped").alias("x_px"), F.col("y_warped").alias("y_px"))
    assert all(abs(r.x - r.x_warped) < 1e-6 and abs(r.y - r.y_warped) < 1e-6 for r in L.warp_triangles(there, back).collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_folders_listed_again_are_replaced(spark, tmp_path, order):
    """Three listings, one of them twice; whatever the order, the table equals the batch over all folders."""
    from voxelkeel.plans.bindings import Tables
    from voxelkeel.plans.q_sources import _LIST
    t = Tables(spark, "/root/testdata/sf0.001")
    files = t.sql(_LIST).withColumn("part", F.pmod(F.xxhash64(F.expr("substring_index(path, '/', 4)")), F.lit(3)))

    out, check, listed = str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "listed")
    for part in (*order, order[0]):
        files.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(listed)
        stream = ST.event_stream(spark, listed, time=None)
        ST.discover_each_batch(stream, out, check).awaitTermination()
    found = ST.found_folders(spark, out)
    want = find_recordings(files.drop("part")).dropDuplicates(["dir"])
    assert found.select("dir").distinct().count() == found.count() == want.count()
    again = find_recordings(files.filter(F.col("part") == order[0]).drop("part")).select("dir")
    assert found.join(again, "dir").select("batch").distinct().count() == 1
    assert found.agg(F.max("batch")).first()[0] == found.join(again, "dir").first().batch
    both = [sorted(map(str, ST.penetrations_of(x).collect())) for x in (found, want)]
    assert both[0] == both[1]


def test_greedy_choice_equals_the_plain_rule(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(d), float(z), 1.0) for k in range(5) for d, z in zip(np.sort(rng.uniform(0, 4000, 300)).round(2), rng.choice([2.5, 3.0, 4.0, 5.0, 1.0], 300))]
    profile = spark.createDataFrame(rows, "k int, depth_um double, z double, scale_um double").withColumn("null_z", F.lit(None).cast("double"))
    peaks = A.profile_peaks(profile, ["k"]).toPandas()
    for most in (None, 4):
        got = A.detect_boundaries(profile, ["k"], max_n=most).toPandas()
        for k, mine in peaks.groupby("k"):
            kept: list[float] = []
            for r in mine.sort_values(["z", "depth_um"], ascending=[False, True]).itertuples():
                if (most is None or len(kept) < most) and all(abs(r.depth_um - d) >= 120 for d in kept):
                    kept.append(r.depth_um)
            assert sorted(got[got.k == k].depth_um) == sorted(kept)


def test_cells_without_a_section_stay(spark):
    cells = spark.createDataFrame([(1, 5, 1.0, 2.0), (1, None, 3.0, 4.0), (1, 6, 3.0, 4.0)], "project_id int, section_index int, x_px double, y_px double")
    matches = spark.createDataFrame([(1, 5, 9, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0)], "project_id int, reference_section int, section_index int, m0 double, m1 double, m2 double, m3 double, m4 double, m5 double")
    out = M.copy_cells(cells, matches).toPandas().sort_values("x_px")
    assert len(out) == 3 and out.section_index.notna().sum() == 1 and out.x_px.notna().sum() == 1
    assert isinstance(out, pd.DataFrame) and out.iloc[0].tolist() == [1, 9, 0.0, 1.0]
