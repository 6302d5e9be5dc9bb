"""What keeps queries whole on larger tables: plans that send no grown table through the driver, and exact ties."""

import duckdb
import numpy as np

import __spark_entry__ as entry
from voxelkeel.functions import geometry as G
from voxelkeel.operators import features as A
from voxelkeel.operators import labels as L
from voxelkeel.operators import matching as M
from voxelkeel.operators import spans as S
from voxelkeel.operators import trajectory as T
from voxelkeel.sources import recordings as SR


def make(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


FIELD = "section long, gx int, gy int, dx double, dy double"
POINTS = "pid long, section long, x_px double, y_px double"


def test_a_displacement_field_is_not_broadcast_and_alike_points_stay(spark):
    field = make(spark, FIELD, [(1, x, y, 1.0 + x, 2.0 * y) for x in (0, 1) for y in (0, 1)])
    pts = make(spark, POINTS, [(1, 1, 1.0, 1.0), (1, 1, 1.0, 1.0), (2, 1, 9.0, -3.0), (3, 2, 5.0, 5.0)])
    out = L.field_warp_points(pts, field, step=2.0, nx=2, ny=2)
    assert broadcasts(out) == 0
    assert sorted(map(tuple, out.collect())) == [(1, 1, 2.5, 2.0), (1, 1, 2.5, 2.0), (2, 1, 11.0, -3.0), (3, 2, 5.0, 5.0)]


LANDMARKS = "section long, i int, sx double, sy double, tx double, ty double, forward boolean"


def test_landmarks_are_not_broadcast(spark):
    lm = make(spark, LANDMARKS, [(1, i, float(i % 3), float(i // 3), float(i % 3), float(i // 3), True) for i in range(6)])
    assert broadcasts(M.tps_warp_points(make(spark, POINTS, [(1, 1, 1.0, 1.0)]), lm)) == 0


def test_pixel_chain_broadcasts_nothing_and_a_plain_shift_is_exact(spark):
    lm = make(spark, LANDMARKS, [(1, i, 15.0 * (i % 3), 12.0 * (i // 3), 15.0 * (i % 3) + 3, 12.0 * (i // 3) - 2, False) for i in range(9)])
    pts = make(spark, POINTS, [(i, 1, i % 34 - 2.0, (i * 7 % 31) * 1.1 - 1) for i in range(60)])
    moved = M.tps_warp_points(pts, lm, inverse=True).join(pts, ["pid", "section"])
    assert all((r.x_warped, r.y_warped) == (r.x_px - 3, r.y_px + 2) for r in moved.collect())
    sections = make(spark, "section long, reg_anchoring array<double>, out_w int, out_h int, resolution_um double", [(1, [1.0] * 9, 4, 4, 25.0)])
    field = make(spark, FIELD, [(1, 0, 0, 0.5, 0.5)])
    assert broadcasts(M.section_pixels_to_ccf(pts, sections, landmarks=lm, field=field, step=4.0, nx=2, ny=2)) == 0


def test_pixel_chain_keeps_points_of_one_id_apart_and_solves_splines_in_all_partitions(spark):
    lm = make(spark, LANDMARKS, [(k, i, 15.0 * (i % 3), 12.0 * (i // 3), 15.0 * (i % 3) + 3, 12.0 * (i // 3) - 2, False) for k in range(40) for i in range(9)])
    pts = make(spark, POINTS, [(7, 1, 2.0, 3.0), (7, 1, 4.0, 5.0), (8, 2, 2.0, 3.0)])
    sections = make(spark, "section long, reg_anchoring array<double>, out_w int, out_h int, resolution_um double", [(k, [1.0] * 9, 4, 4, 25.0) for k in (1, 2)])
    field = make(spark, FIELD, [(1, 0, 0, 0.5, 0.5)])
    assert sorted(r.pid for r in M.section_pixels_to_ccf(pts, sections, landmarks=lm, field=field, step=4.0, nx=2, ny=2).collect()) == [7, 7, 8]
    moved = M.tps_warp_points(make(spark, POINTS, [(k * 64, k, 1.0, 1.0) for k in range(40)]), lm)
    assert "REPARTITION_BY_NUM" in moved._jdf.queryExecution().executedPlan().toString()


def test_null_calibration_keeps_curves_in_the_group_and_takes_repeated_depths(spark):
    rows = [(1, f, 20.0 * i, float(np.sin(i * (f + 1)) + (i > 30))) for f in range(2) for i in range(64)]
    schema = "k long, feature long, depth_um double, value double"
    once, twice = make(spark, schema, rows), make(spark, schema, rows + rows)
    calibrate = lambda p: A.null_calibration(p, A.adaptive_windows(p, ["k"]), ["k"])
    assert broadcasts(calibrate(once)) == 0
    want = sorted(map(tuple, calibrate(once).collect()))
    assert len(want) == 4 and sorted(map(tuple, calibrate(twice).collect())) == want


def test_grid_contrasts_agree_with_contrasts_at_marks(spark):
    rng = np.random.default_rng(3)
    rows = [(k, f, 20.0 * i, None if i == 7 else float(rng.normal() + (i > 20) * f)) for k in (1, 2) for f in range(3) for i in range(40)]
    prof = make(spark, "k long, feature int, depth_um double, value double", rows)
    windows = make(spark, "k long, window_um double", [(1, 100.0), (1, 150.0), (2, 60.0)])
    want = A.contrast_at(prof, A.depth_marks(prof, windows, ["k"], step_um=25.0), ["k"], window="window_um")
    grid = A.contrast_grid(prof, windows, ["k"], step_um=25.0, per_feature=True)
    assert "Window" not in grid._jdf.queryExecution().executedPlan().toString() and broadcasts(grid) == 0
    key = lambda r: (r.k, r.feature, r.window_um, r.at)
    got, want = {key(r): r.contrast for r in grid.collect()}, {key(r): r.contrast for r in want.collect()}
    assert got.keys() == want.keys() and all((a is None) == (want[i] is None) and (a is None or abs(a - want[i]) < 1e-9) for i, a in got.items())


def test_multiscale_profile_is_one_pass_and_agrees_with_its_parts(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(12):
        # Shanks of equal and of other depths, a bad depth, missing rows and values, repeated depths, a flat feature.
        lo, step, n = (0.0, 20.0, 50) if k < 6 else (13.7 * k, 15.0 + k, 30 + k)
        for i in range(n):
            for f in range(3):
                v = float(rng.normal() + (i > n // 2) * (f + 1) + (40.0 if i in (0, 8) and k % 3 == 0 else 0.0))
                if not (k == 2 and f == 1 and i % 7 == 3):
                    rows.append((f"s{k}", f, lo + i * step, None if k in (3, 8) and i % 11 == f else 2.5 if k == 5 and f == 2 else v))
                    if k in (4, 9) and i % 5 == 0:
                        rows.append((f"s{k}", f, lo + i * step, v + 0.5))
        rows.append((f"s{k}", 0, None, 1.0) if k == 7 else (None, 0, 20.0 * k, 1.0))
    rows += [("short", 0, 20.0 * i, float(i)) for i in range(7)] + [("narrow", 0, 10.0 * i, float(i % 3)) for i in range(9)]
    prof = make(spark, "k string, feature int, depth_um double, value double", [rows[i] for i in rng.permutation(len(rows))])
    plan = A.multiscale_profile(prof, ["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text and "Scan ExistingRDD" in text
    whole = prof.dropna(subset=["k", "depth_um"])
    windows = A.adaptive_windows(whole, ["k"])
    stats = A.null_calibration(whole, windows, ["k"]).toPandas()
    raw = A.step_profile(whole, windows, ["k"], step_um=5.0).toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        got = {k: g.sort_values("depth_um") for k, g in A.multiscale_profile(prof, ["k"]).toPandas().groupby("k")}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(f"s{k}" for k in range(12))
    extent = whole.groupBy("k").agg({"depth_um": "min"}).toPandas().set_index("k").iloc[:, 0], whole.groupBy("k").agg({"depth_um": "max"}).toPandas().set_index("k").iloc[:, 0]
    for k, g in got.items():
        grid = extent[0][k] + np.arange(int(np.ceil((extent[1][k] + 5.0 - extent[0][k]) / 5.0))) * 5.0
        each = []
        for s in stats[stats.k == k].sort_values("window_um").itertuples():
            r = raw[(raw.k == k) & (raw.window_um == s.window_um)].sort_values("at")
            each.append(np.interp(grid, r["at"], (r["score"] - s.centre) / s.spread, left=np.nan, right=np.nan))
        each = np.array(each)
        seen = ~np.isnan(each).all(axis=0)
        best = np.where(seen, np.nanmax(np.where(np.isnan(each), -np.inf, each), axis=0), np.nan)
        assert np.array_equal(g["depth_um"], grid) and np.allclose(g["z"].astype(float), best, atol=1e-9, equal_nan=True), k
        widths = np.sort(stats[stats.k == k].window_um.to_numpy())
        assert seen.sum() > 50 and all(abs(each[list(widths).index(w), i] - best[i]) < 1e-9 for i, w in enumerate(g["scale_um"].astype(float)) if seen[i])
        assert np.allclose(g["null_z"], stats[stats.k == k].null_z.iloc[0])


def test_plane_centre_is_scaled_once(spark):
    planes = [[120.0 + i * 2.4 + (i * 7 % 5) / 10, 10.0, 5.0, (i % 7 - 3) * 0.8, 0.0, 440.0, (i % 9 - 4) * 0.9, 300.0, 2.0] for i in range(200)]
    df = make(spark, "i int, reg_anchoring array<double>, ds_anchoring array<double>, out_h int, out_w int, x0 int, x1 int, y0 int, y1 int, resolution_um double",
              [(i, p, None, 200, 250, 0, 1, 0, 1, 25.0) for i, p in enumerate(planes)])
    got = {r.i: r.plane_ap_um for r in G.section_plane_values(df).collect()}
    assert all(got[i] == (p[0] + p[3] / 2 + p[6] / 2) * 25.0 for i, p in enumerate(planes))


def test_channel_maps_that_do_not_begin_at_their_first_channel(spark, tmp_path):
    ids = [i for i in range(320) if not (i // 32 in (3, 6) and i % 32 > 1) and not (i // 32 in (5, 9) and i % 32 < 9)]
    spark.createDataFrame([(i, [0.5] * 64, i % 10) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["s07_read_channel_map"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()['s07_read_channel_map']}) q").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_merged_spans_do_not_depend_on_how_equal_ones_are_ordered(spark):
    # SQL that sorts equal spans anew for each window may number a span -1 or stretch it; the spans themselves leave nothing open.
    spans = [(30, 2895.0, 3000.0)] * 3 + [(30, 3075.0, 3180.0), (41, 2775.0, 2880.0)] + [(41, 2955.0, 3060.0)] * 3
    for rows in (spans, spans[::-1]):
        merged = S.merge_spans(make(spark, "penetration long, top_um double, bottom_um double", rows), ["penetration"])
        assert sorted(map(tuple, merged.collect())) == [(30, 0, 2895.0, 3000.0), (30, 1, 3075.0, 3180.0), (41, 0, 2775.0, 2880.0), (41, 1, 2955.0, 3060.0)]


def test_section_pairs_and_pixels_are_not_grouped_behind_their_joins(spark):
    bits = make(spark, "pair long, section long, turn double, mirror boolean, bits array<long>", [(1, 1, t, m, [3 + int(t) + m]) for t in (0.0, 3.0) for m in (False, True)])
    plan = M.section_overlaps(bits, bits.withColumn("section", bits.section + 10))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text[:text.index("Join")] and broadcasts(plan) == 0
    assert [tuple(r) for r in plan.collect()] == [(1, 1, 11, 1.0, False, 0.0)]
    pixels = make(spark, "p int, v_ap double, v_dv double, v_ml double", [(1, 0.25, 0.5, 1.0), (2, 1.0, 1.0, 1.0), (3, -0.1, 0.0, 0.0)])
    volume = make(spark, "i_ap int, i_dv int, i_ml int, value double", [(a, d, 1, 1.0 + a + 2 * d) for a in (0, 1) for d in (0, 1)])
    out = L.sample_intensity(pixels, volume, ["p"], (2, 2, 2))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text[:text.index("Join")]
    assert {r.p: r.intensity for r in out.collect()} == {1: 2.25, 2: 4.0, 3: 0.0}


def test_pixels_of_a_section_are_shuffled_once(spark):
    for key in ("w15_label_edges", "a26_mutual_information"):
        plan = entry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(p_partkey") == plan.count("Exchange"), key


def test_folders_are_spread_before_grouping_and_not_broadcast_and_a_top_one_stays(spark):
    rows = [("/top/info.rhd", False), ("/d/1/Record Node 1/notes.txt", False), ("/d/1/Record Node 1/experiment1/recording1", True),
            ("/d/2/info.rhd", False), ("/d/2/deep/er/info.rhd", False), ("/d/3/a.txt", False), ("/d/4/g0/x.imec0.ap.meta", False), ("/d/4/g0/X.imec0.ap.bin", False)]
    found = SR.find_recordings(make(spark, "path string, is_dir boolean", rows))
    assert broadcasts(found) == 0
    assert sorted(map(tuple, found.collect())) == [("/d/1/Record Node 1", "openephys"), ("/d/2", "intan"), ("/d/4", "spikeglx"), ("/top", "intan")]
    assert SR.find_recordings(make(spark, "path string, is_dir boolean", rows[5:6])).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_scores_meet_without_a_broadcast(spark):
    lfp = make(spark, "recording long, win int, sample long, channel int, shank int, uv double", [(1, 0, s, c, 0, float(s * c % 5)) for s in range(8) for c in range(4)])
    assert broadcasts(A.screen_windows(lfp)) == 0 and A.screen_windows(lfp).count() == 1


def test_triangles_are_made_in_all_partitions(spark):
    tri = L.marker_triangles(make(spark, "section long, width double, height double, markers array<array<double>>", [(1, 40.0, 30.0, [[10.0, 10.0, 11.0, 9.0]])]))
    assert "REPARTITION_BY_NUM" in plan(tri) and tri.count() == 4


def test_slides_of_fragments_are_rows_of_a_map_and_a_joined_piece_meets_earlier_ones(spark):
    # the second and third overlap; joined they are wide and large enough to stand first and take the largest too
    rows = [(1, 0, 0, 0, 10, 10, 100, 5.0, 5.0), (1, 1, 30, 0, 50, 10, 90, 40.0, 5.0), (1, 2, 4, 20, 44, 30, 80, 24.0, 25.0), (2, 3, 0, 0, 5, 5, 7, 2.0, 2.0)]
    out = M.merge_fragments(make(spark, "s long, k long, x0 long, y0 long, x1 long, y1 long, area_px long, cx double, cy double", rows), ["s"])
    assert "FlatMapGroupsInPandas" not in plan(out) and broadcasts(out) == 0
    assert sorted(map(tuple, out.select("s", "piece", "x0", "y0", "x1", "y1", "area_px", "n_merged").collect())) == [(1, 0, 0, 0, 50, 30, 270, 3), (2, 0, 0, 0, 5, 5, 7, 1)]


def test_gain_and_count_of_the_ordered_pairs_also_with_ties():
    r = np.random.default_rng(3)
    for grid in (1.0, 50.0):
        f, a = (np.sort(np.round(r.uniform(0, 3000, (400, n)) / grid) * grid, axis=1) for n in (4, 9))
        w = r.integers(1, 3, f.shape).astype(float)
        f[::7, 3], w[::7, 3], a[::5, 6:] = np.nan, np.nan, np.nan
        row, _, _, gain = T._ordered_pairs(f, w, a, 120.0, 350.0)
        total, matched = T._ordered_gain(f, w, a, 120.0, 350.0)
        assert np.array_equal(total, np.bincount(row, gain, len(f))) and np.array_equal(matched, np.bincount(row, minlength=len(f)))


def test_poses_are_worked_out_in_all_partitions(spark):
    rows = [(p, k, 1.0 + k, 2.0, 9.0, 1.0 + k, 2.0, 1.0) for p in (1, 2) for k in range(3)]
    pose = T.probe_pose(make(spark, "probe long, shank int, tip_ap double, tip_ml double, tip_dv double, entry_ap double, entry_ml double, entry_dv double", rows), ["probe"])
    assert "REPARTITION_BY_NUM" in plan(pose) and pose.count() == 2
