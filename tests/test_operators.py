"""Hand-computed cases, invariants and brute-force checks of single operators."""

import itertools
import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.functions.interp import interp, knot_arrays
from voxelkeel.functions.ranges import range_join
from voxelkeel.operators import features as A
from voxelkeel.operators import labels as L
from voxelkeel.operators import matching as M
from voxelkeel.operators import placement as P
from voxelkeel.operators import regions as R
from voxelkeel.operators import series as SE
from voxelkeel.operators import spans as S
from voxelkeel.operators import trajectory as T
from voxelkeel.sinks import tables as K
from voxelkeel.sources import projects as SP
from voxelkeel.sources import recordings as SR
from voxelkeel.streaming import operators as ST


def make(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_unknown_paxinos_alignment_raises(spark):
    df = make(spark, "ap_um double, ml_um double, dv_um double", [(1.0, 2.0, 3.0)])
    with pytest.raises(ValueError):
        G.to_paxinos(df, "bregma")
    row = G.to_paxinos(df, "none").first()
    assert (row.ap_mm, row.ml_mm, row.dv_mm) == (5.399, 5.698, 0.003)


def test_unknown_atlas_has_no_bregma(spark):
    df = make(spark, "a string", [("whs_sd_rat_39um",), ("Kim_mouse_isotropic_20um",)])
    assert [r[0] for r in df.select(G.bregma_ap(F.col("a"))).collect()] == [None, 5502.0]
    with pytest.raises(Exception, match="no bregma anchor"):
        df.select(G.require_bregma(F.col("a"))).collect()


def test_interp_modes(spark):
    knots = knot_arrays(make(spark, "k int, x double, y double", [(1, 0.0, 0.0), (1, 10.0, 20.0), (2, 5.0, 7.0)]), ["k"], "x", "y")
    q = make(spark, "k int, q double", [(1, -5.0), (1, 5.0), (1, 10.0), (1, 15.0), (2, 6.0)]).join(knots, "k")
    out = {}
    for mode in ("clamp", "extrapolate", "null"):
        out[mode] = {(r.k, r.q): r.v for r in interp(q, "v", F.col("q"), "xs", "ys", mode).collect()}
    assert out["clamp"] == {(1, -5.0): 0.0, (1, 5.0): 10.0, (1, 10.0): 20.0, (1, 15.0): 20.0, (2, 6.0): 7.0}
    assert out["extrapolate"] == {(1, -5.0): -10.0, (1, 5.0): 10.0, (1, 10.0): 20.0, (1, 15.0): 30.0, (2, 6.0): 8.0}
    assert out["null"][(1, -5.0)] is None and out["null"][(1, 10.0)] == 20.0 and out["null"][(2, 6.0)] is None


def test_range_join_half_open_and_hot_key(spark):
    points = make(spark, "k int, t double", [(1, float(i)) for i in range(100)])
    ivs = make(spark, "k int, a double, b double", [(1, 10.0, 20.0), (1, 15.0, 15.0), (1, 30.0, 25.0), (2, 0.0, 99.0)])
    got = sorted(r.t for r in range_join(points, ivs, ["k"], "t", "a", "b", bucket=7.0).collect())
    assert got == [float(i) for i in range(10, 20)]


def test_curved_without_waypoints_equals_straight(spark):
    shank = make(spark, "k int, probe_type string, tip_ap double, tip_ml double, tip_dv double, entry_ap double, entry_ml double, entry_dv double",
                 [(1, "Neuropixels 1.0", 5000.0, 3000.0, 4000.0, 5100.0, 3200.0, 500.0), (2, "Neuropixels 1.0", 0.0, 9000.0, 10.0, 0.0, 1000.0, 0.0)])
    none = make(spark, "k int, i int, ap double, ml double, dv double", [])
    straight = {(r.k, r.channel): (r.ap_um, r.ml_um, r.dv_um) for r in P.place_channels(P.with_sites(P.shank_frames(shank))).collect()}
    curved = {(r.k, r.channel): (r.ap_um, r.ml_um, r.dv_um) for r in P.place_channels_curved(P.with_sites(P.curved_frames(P.track_polyline(shank, none, ["k"])))).collect()}
    assert straight.keys() == curved.keys() and len(straight) == 768
    assert np.allclose([straight[x] for x in straight], [curved[x] for x in straight], atol=1e-6)


def test_layouts_have_published_geometry(spark):
    rows = P.probe_layouts(spark).groupBy("layout").agg(F.count("*").alias("n"), F.min("depth_from_tip_um").alias("lo"), F.max("depth_from_tip_um").alias("hi")).collect()
    got = {r.layout: (r.n, r.lo, r.hi) for r in rows}
    assert got == {P.NP1: (384, 220.0, 4040.0), P.NP2: (384, 217.0, 3082.0), P.POLY3: (32, 62.0, 337.0), P.POLY2: (32, 75.0, 850.0)}


def test_wired_maps_hold_the_catalog_sites(spark):
    wired = {(r.map_name, r.depth_um, r.x_um) for r in SR.wired_maps(spark).collect()}
    layouts = P.probe_layouts(spark).filter(F.col("layout").isin(P.POLY3, P.POLY2)).collect()
    name = {P.POLY3: SR.POLY3_WIRED, P.POLY2: SR.POLY2_WIRED}
    assert wired == {(name[r.layout], r.depth_from_tip_um, r.lateral_um) for r in layouts}


def test_region_bands_keep_unlabelled_and_repeats(spark):
    hits = make(spark, "k int, depth_um double, region string", [(1, d, r) for d, r in zip((0.0, 10.0, 20.0, 30.0, 40.0), ("A", "A", "", "A", "A"))])
    got = [(r.region, r.top_um, r.bottom_um) for r in R.region_bands(hits, ["k"]).orderBy("band").collect()]
    assert got == [("A", 0.0, 15.0), ("", 15.0, 25.0), ("A", 25.0, 40.0)]


def test_point_outside_the_atlas(spark):
    ann = make(spark, "i_ap int, i_dv int, i_ml int, structure_id int", [(0, 0, 0, 5)])
    st = make(spark, "id int, acronym string, r int, g int, b int", [(5, "X", 1, 2, 255)])
    pts = make(spark, "i int, ap_um double, ml_um double, dv_um double", [(0, 10.0, 10.0, 10.0), (1, -10.0, 10.0, 10.0), (2, 30.0, 0.0, 0.0)])
    got = {r.i: (r.region, r.region_id, r.region_color) for r in R.region_at_point(pts, ann, st, resolution_um=25.0).collect()}
    assert got == {0: ("X", 5, "#0102ff"), 1: ("", 0, ""), 2: ("", 0, "")}


def test_merge_spans_joins_exactly_one_pitch(spark):
    spans = make(spark, "p int, top_um double, bottom_um double", [(1, 0.0, 100.0), (1, 115.0, 200.0), (1, 20.0, 30.0), (1, 216.0, 300.0)])
    assert [(r.top_um, r.bottom_um) for r in S.merge_spans(spans, ["p"]).orderBy("span").collect()] == [(0.0, 200.0), (216.0, 300.0)]
    assert [(r[1], r[2]) for r in S.span_gaps(spans, ["p"]).collect()] == [(200.0, 216.0)]


def test_depth_profile_last_bin_is_closed_and_empty_bins_stay(spark):
    spikes = make(spark, "recording int, t_s double, depth_um double, amplitude double", [(1, 1.0, 0.0, 2.0), (1, 2.0, 30.0, 4.0), (1, 10.0, 25.0, 6.0)])
    rows = A.depth_profiles(spikes, ["recording"], bin_um=10.0, min_spikes=2).orderBy("bin").collect()
    assert [(r.bin, r.n_spikes, r.rate_hz, r.mean_amplitude) for r in rows] == [(0, 1, None, None), (1, 0, None, None), (2, 2, 0.2, 5.0)]


def test_thin_raster_is_exact_for_a_hot_recording(spark):
    spikes = spark.range(30000).select(F.when(F.col("id") < 20000, 0).otherwise(F.col("id") % 50 + 1).alias("recording"), F.col("id").alias("sid"))
    a = A.thin_raster(spikes, ["recording"], "sid", max_points=1234)
    n = {r.recording: r.n for r in a.groupBy("recording").agg(F.count_distinct("sid").alias("n")).collect()}
    assert n[0] == 1234 and all(v == 200 for k, v in n.items() if k)
    assert a.exceptAll(A.thin_raster(spikes, ["recording"], "sid", max_points=1234)).count() == 0


def test_welch_matches_direct_sum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    rows = [(1, 0, c, s, float(x[s, c]), 100.0) for s in range(600) for c in range(2)]
    got = A.lfp_psd(make(spark, "recording long, win int, channel int, sample long, uv double, fs double", rows)).toPandas()
    seg, hann = 256, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    for c in range(2):
        parts = [(x[s:s + seg, c] - x[s:s + seg, c].mean()) * hann for s in (0, 128, 256)]
        power = np.mean([np.abs(np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(seg)) / seg) @ p) ** 2 for p in parts], axis=0) / (100.0 * (hann ** 2).sum())
        power[1:-1] *= 2
        mine = got[got.channel == c].sort_values("freq_hz")["power"].to_numpy()
        assert np.allclose(mine, power)


def test_step_profile_finds_planted_step_and_numpy_agrees(spark):
    depths = np.arange(0.0, 1500.0, 20.0)
    rng = np.random.default_rng(1)
    vals = np.column_stack([np.where(depths < 700, 0.0, 5.0), np.where(depths < 700, 1.0, -3.0)]) + rng.normal(size=(len(depths), 2)) * 0.3
    rows = [(1, f, float(d), float(vals[i, f])) for i, d in enumerate(depths) for f in range(2)]
    prof = make(spark, "k int, feature int, depth_um double, value double", rows)
    win = make(spark, "k int, window_um double", [(1, 150.0)])
    got = A.step_profile(prof, win, ["k"], reject_bad=False).orderBy("at").toPandas()
    assert abs(got.loc[got.score.idxmax(), "at"] - 700) <= 20
    z = (vals - vals.mean(0)) / vals.std(0)
    at, score = A._contrast_curve(depths, z, 150.0, 20.0)
    assert np.allclose(got["at"], at) and np.allclose(got["score"], score)


def test_null_calibration_and_detection_on_noise_and_step(spark):
    rng = np.random.default_rng(7)
    depths = np.arange(0.0, 1600.0, 20.0)
    rows = [(k, f, float(d), float(rng.normal() + (8.0 if k == 1 and d >= 800 else 0.0))) for k in (0, 1) for d in depths for f in range(3)]
    prof = make(spark, "k int, feature int, depth_um double, value double", rows)
    multi = A.multiscale_profile(prof, ["k"], step_um=20.0)
    assert multi.filter("z IS NOT NULL").count() > 50
    found = A.detect_boundaries(multi, ["k"]).filter("k = 1").collect()
    assert any(abs(r.depth_um - 800) <= 40 for r in found)
    gaps = np.diff(sorted(r.depth_um for r in found))
    assert (gaps >= 120).all()


def test_match_ordered_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        f, a = np.sort(rng.uniform(0, 1000, 4)), np.sort(rng.uniform(0, 1000, 5))
        w = rng.uniform(0.5, 2, 4)
        got = T._ordered_pairs(f[None], w[None], a[None], 120.0, 350.0)[3].sum()
        gain = lambda i, j: w[i] * np.exp(-0.5 * ((f[i] - a[j]) / 120) ** 2) if abs(f[i] - a[j]) <= 350 else -1.0
        best = 0.0
        for n in range(1, 5):
            for ii in itertools.combinations(range(4), n):
                for jj in itertools.combinations(range(5), n):
                    g = [gain(i, j) for i, j in zip(ii, jj)]
                    if min(g) > 0:
                        best = max(best, sum(g))
        assert abs(got - best) < 1e-9


def test_assignment_is_optimal():
    rng = np.random.default_rng(11)
    for n, m in ((3, 3), (4, 6), (6, 4), (1, 5)):
        for _ in range(10):
            cost = rng.normal(size=(n, m))
            got = M._assign(cost)
            small, big = (cost, m) if n <= m else (cost.T, n)
            best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(big), len(small)))
            assert len(got) == min(n, m) and abs(sum(cost[i, j] for i, j in got) - best) < 1e-9


@pytest.mark.parametrize("forward", [True, False])
def test_spline_hits_its_landmarks_and_inverts(spark, forward):
    rng = np.random.default_rng(2)
    src = rng.uniform(0, 300, (8, 2))
    dst = src + rng.normal(size=(8, 2)) * 4
    lm = make(spark, "section long, i int, sx double, sy double, tx double, ty double, forward boolean",
              [(1, i, *map(float, src[i]), *map(float, dst[i]), forward) for i in range(8)])
    pts = make(spark, "pid long, section long, x_px double, y_px double", [(i, 1, *map(float, src[i])) for i in range(8)])
    out = M.tps_warp_points(pts, lm)
    moved = out.orderBy("pid").toPandas()[["x_warped", "y_warped"]].to_numpy()
    assert np.allclose(moved, dst, atol=1e-2)
    back = M.tps_warp_points(out.select("pid", "section", F.col("x_warped").alias("x_px"), F.col("y_warped").alias("y_px")), lm, inverse=True)
    assert np.allclose(back.orderBy("pid").toPandas()[["x_warped", "y_warped"]].to_numpy(), src, atol=1e-2)


def test_line_fit_ignores_an_outlier(spark):
    rows = [(1, i, 5000.0 + i, 3000.0, 1000.0 + 100 * i) for i in range(10)] + [(1, 10, 9000.0, 3000.0, 1500.0)]
    r = T.line_fit(make(spark, "k long, i int, ap double, ml double, dv double", rows), ["k"]).first()
    assert r.n_inliers == 10 and abs(r.tip_dv - 1900) < 1 and abs(r.entry_dv - 1000) < 1


def test_pose_and_moves_keep_the_array_rigid(spark):
    rows = [(1, s, 5000.0 + 250 * s, 4000.0, 4000.0, 5000.0 + 250 * s, 4100.0, 1000.0) for s in range(4)]
    sh = make(spark, "probe int, shank int, tip_ap double, tip_ml double, tip_dv double, entry_ap double, entry_ml double, entry_dv double", rows)
    pose = T.probe_pose(sh, ["probe"])
    p = pose.first()
    assert np.allclose((p.r_ap, p.r_ml, p.r_dv), (1, 0, 0), atol=1e-9) and p.lateral_sign == -1.0
    cand = sh.withColumns({"tilt_deg": F.lit(7.0), "roll_deg": F.lit(-4.0), "offset_um": F.lit(30.0)})
    m = T.move_probe(cand, pose, ["probe"]).orderBy("shank").toPandas()
    tips, entries = m[["tip_ap", "tip_ml", "tip_dv"]].to_numpy(), m[["entry_ap", "entry_ml", "entry_dv"]].to_numpy()
    old = np.linalg.norm(np.array(rows)[:, 2:5].astype(float) - np.array(rows)[:, 5:8].astype(float), axis=1)
    assert np.allclose(np.linalg.norm(tips - entries, axis=1), old)
    assert np.allclose(np.linalg.norm(np.diff(tips, axis=0), axis=1), 250)


def test_placement_search_recovers_a_shift(spark):
    # Slabs of 400 um in DV: evidence is taken from the track itself, moved by 100 um.
    ann = spark.range(40).select(F.lit(0).alias("i_ap"), F.col("id").cast("int").alias("i_dv"), F.lit(0).alias("i_ml"), (F.floor(F.col("id") / 4) + 1).cast("int").alias("structure_id"))
    st = spark.range(1, 11).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("acronym"), F.lit(1).alias("r"), F.lit(1).alias("g"), F.lit(1).alias("b"))
    rows = [(1, s, 20.0 + 10 * s, 50.0, 3500.0, 20.0 + 10 * s, 50.0, 500.0) for s in range(2)]
    sh = make(spark, "probe int, shank int, tip_ap double, tip_ml double, tip_dv double, entry_ap double, entry_ml double, entry_dv double", rows)
    # Boundaries at DV 400, 800, ...: from the moved tip (3600) they are 3600 - DV.
    ev = make(spark, "probe int, shank int, depth_from_tip_um double, weight double", [(1, s, 3600.0 - dv, 1.0) for s in range(2) for dv in (1200.0, 1600.0, 2400.0, 2800.0)])
    grid = T.same_grid(sh, offsets=(-100.0, 0.0, 100.0), rolls=(0.0,), tilts=(0.0,))
    scores = T.score_placements(sh, ev, ann, st, grid, resolution_um=100.0)
    best = T.best_placement(T.placement_score(scores, ["probe", "cand", *T._PARAMS])).first()
    assert best.offset_um == 100.0 and best.explained > best.baseline_explained


def test_alignment_history_needs_two_landmarks(spark):
    old = make(spark, "shank_key int, stamp string, feature_um array<double>, track_um array<double>", [(1, "a", [1.0, 2.0], [1.0, 2.0])])
    new = make(spark, "shank_key int, stamp string, feature_um array<double>, track_um array<double>", [(1, "a", [5.0], [5.0]), (1, "b", [3.0, 4.0], [3.0, 4.0])])
    assert {(r.stamp, r.feature_um[0]) for r in K.merge_history(old, new).collect()} == {("a", 1.0), ("b", 3.0)}


def test_sidecar_and_csv_files(spark, tmp_path):
    f = tmp_path / "notes.csv"
    f.write_text("Animal,Session,Insertion Depth,Dye,Extra\nm1,run1,3500,DiI (Red),x\nm2,run2,n/a,,y\n", encoding="utf-8-sig")
    rows = SR.read_sidecar(spark, str(f)).orderBy("recording").collect()
    assert [(r.subject, r.recording, r.insertion_depth_um, r.dye, r.Extra) for r in rows] == [("m1", "run1", 3500.0, "red", "x"), ("m2", "run2", None, None, "y")]
    with pytest.raises(ValueError):
        SR.read_sidecar(spark, "notes.xlsx")
    with pytest.raises(ValueError):
        SR.normalise_sidecar(make(spark, "foo string", [("a",)]))


def test_channel_csv_is_written_with_two_decimals(spark, tmp_path):
    t = make(spark, "probe string, shank int, channel int, ap_um double", [("B", 0, 1, 2.345), ("A", 0, 0, 1.0)])
    K.write_csv(t, str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("probe").collect()
    assert [(r.probe, r.ap_um) for r in got] == [("A", "1.00"), ("B", "2.35")] or got[1].ap_um == "2.34"


def test_stream_profiles_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", float(m * 10 % 70), 1.0 * m) for m in range(60)]
    batch = make(spark, "ts string, depth_um double, amplitude double", rows).withColumn("ts", F.to_timestamp("ts"))
    for part in range(3):
        batch.filter(F.minute("ts") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.event_stream(spark, str(tmp_path / "in"), glob="*.parquet")
    rule = lambda df: ST.stream_depth_profiles(df, window="10 minutes", window_s=600.0, bin_um=20.0, min_spikes=2, late="1 day")
    got = ST.drain(rule(stream), ["window_start", "bin"], str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert got.exceptAll(rule(batch)).count() == 0 and rule(batch).exceptAll(got).count() == 0


def test_stream_drops_what_is_later_than_the_watermark(spark, tmp_path):
    rows = lambda *minutes: make(spark, "ts string, depth_um double, amplitude double", [(f"2024-01-01 00:{m:02d}:00", 5.0, 1.0) for m in minutes]).withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    for part in (rows(1, 2), rows(40, 41), rows(42), rows(3), rows(45)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # the stream takes files in order of their age
    stream = ST.stream_depth_profiles(ST.event_stream(spark, str(tmp_path / "in")), window="10 minutes", bin_um=20.0, min_spikes=1, late="10 minutes")
    got = ST.drain(stream, ["window_start", "bin"], str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert sorted(r.n_spikes for r in got.collect()) == [2, 4]


def test_stream_of_a_folder_or_a_file(spark, tmp_path):
    make(spark, "a int", [(1,), (2,)]).repartition(2).write.parquet(str(tmp_path / "t.parquet"))
    single = next(p for p in (tmp_path / "t.parquet").iterdir() if p.name.endswith(".parquet"))
    for path, n in ((tmp_path / "t.parquet", 2), (single, 1)):
        out = tmp_path / f"out{n}"
        rows = ST.event_stream(spark, str(path), time=None)
        rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(str(out)).count() == n


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_screening_equals_batch_when_windows_are_split(spark, tmp_path, parts):
    rng = np.random.default_rng(4)
    rows = [(1, w, s, c, 0, float(rng.normal() + (500 if w == 1 and 10 <= s < 20 else 0) * (1 + c))) for w in range(3) for s in range(60) for c in range(4)]
    df = make(spark, "recording long, win int, sample long, channel int, shank int, uv double", rows)
    timed = df.withColumn("closes_at", F.timestamp_seconds((F.col("win") + 1) * 10))
    for p in range(parts):
        timed.filter(F.col("sample") % parts == p).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    timed.limit(1).withColumn("recording", F.lit(-1).cast("long")).withColumn("closes_at", F.timestamp_seconds(F.lit(9000))).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.event_stream(spark, str(tmp_path / "in"), glob="*.parquet", time=None)
    query = ST.screen_each_batch(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), late="1 minute")
    query.awaitTermination()
    # all that is left in state is the row that ended the stream
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    pick = lambda d: G.rounded(d.select("recording", "win", "artifact", "activity", "reject_reason"))
    got, want = pick(ST.latest_verdicts(spark, str(tmp_path / "out"))), pick(A.screen_windows(df))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 3
    once = spark.read.parquet(str(tmp_path / "out"))
    assert once.count() == 3, "each window is screened once"


def test_empty_inputs(spark):
    ann = make(spark, "i_ap int, i_dv int, i_ml int, structure_id int", [])
    st = make(spark, "id int, acronym string, r int, g int, b int", [])
    pts = make(spark, "i int, ap_um double, ml_um double, dv_um double", [])
    assert R.region_at_point(pts, ann, st, resolution_um=25.0).count() == 0
    spikes = make(spark, "recording int, t_s double, depth_um double, amplitude double", [])
    assert A.depth_profiles(spikes, ["recording"]).count() == 0
    assert S.merge_spans(make(spark, "p int, top_um double, bottom_um double", []), ["p"]).count() == 0
    assert L.label_edges(make(spark, "section int, x int, y int, region_id int", [])).count() == 0


def test_edges_need_a_neighbour_one_pixel_away(spark):
    rows = [(1, 0, 0, 7), (1, 5, 0, 8), (1, 6, 0, 8), (1, 7, 0, 9), (1, 7, 3, 1)]
    got = L.label_edges(make(spark, "section int, x int, y int, region_id int", rows)).collect()
    assert sorted((r.x, r.y) for r in got) == [(6, 0), (7, 0)]


def test_points_without_landmarks_or_field_stay(spark):
    lm = make(spark, "section long, i int, sx double, sy double, tx double, ty double, forward boolean", [(1, i, float(i % 3), float(i // 3), float(i % 3), float(i // 3), True) for i in range(6)])
    pts = make(spark, "pid long, section long, x_px double, y_px double", [(1, 1, 1.0, 1.0), (2, 9, 3.0, 4.0)])
    got = {r.pid: r for r in M.tps_warp_points(pts, lm).collect()}
    assert (got[2].x_warped, got[2].y_warped, got[2].settled) == (3.0, 4.0, True) and got[1].settled
    field = make(spark, "section long, gx int, gy int, dx double, dy double", [(1, 0, 0, 0.5, 0.0), (1, 1, 0, 0.5, 0.0), (1, 0, 1, 0.5, 0.0)])
    moved = {r.pid: r.x_warped for r in L.field_warp_points(pts, field, step=2.0, nx=2, ny=2).collect()}
    assert moved == {1: 1.5, 2: 3.0}


def test_spline_points_do_not_depend_on_each_other(spark):
    rng = np.random.default_rng(5)
    src = rng.uniform(0, 100, (9, 2))
    dst = src + rng.normal(size=(9, 2)) * 6
    lm = make(spark, "section long, i int, sx double, sy double, tx double, ty double, forward boolean", [(1, i, *map(float, src[i]), *map(float, dst[i]), False) for i in range(9)])
    pts = [(i, 1, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 400, (30, 2)))]
    schema = "pid long, section long, x_px double, y_px double"
    together = {r.pid: (r.x_warped, r.y_warped, r.settled) for r in M.tps_warp_points(make(spark, schema, pts), lm).collect()}
    for p in pts[:5]:
        alone = M.tps_warp_points(make(spark, schema, [p]), lm).first()
        assert np.allclose((alone.x_warped, alone.y_warped), together[p[0]][:2], atol=1e-6) and alone.settled == together[p[0]][2]


def test_box_neighbours_on_a_slide_of_many_boxes(spark):
    rng = np.random.default_rng(6)
    xy = rng.integers(0, 4000, (2300, 2))
    wh = rng.integers(5, 60, (2300, 2))
    rows = [(1, k, int(x), int(y), int(x + w), int(y + h), 5000, 5000) for k, ((x, y), (w, h)) in enumerate(zip(xy, wh))]
    out = SE.box_neighbours(make(spark, "slide int, k long, x0 long, y0 long, x1 long, y1 long, image_w long, image_h long", rows), ["slide"])
    got = {r.k: r.gap_px for r in out.collect()}
    b = np.array([r[2:6] for r in rows])
    for k in range(0, 2300, 37):
        x0, y0, x1, y1 = b[k]
        o = np.delete(b, k, axis=0)
        rowmates, colmates = (y1 > o[:, 1]) & (y0 < o[:, 3]), (x1 > o[:, 0]) & (x0 < o[:, 2])
        gaps = [*(o[rowmates, 0] - x1), *(x0 - o[rowmates, 2]), *(o[colmates, 1] - y1), *(y0 - o[colmates, 3])]
        assert got[k] == min((g for g in gaps if g >= 0), default=None)


def test_fragments_merge_to_the_fixed_point(spark):
    # A chain: each box overlaps only the union of those before it.
    rows = [(1, k, 10 * k, 0, 10 * k + 20, 10, 1000 - k, 10.0 * k, 5.0) for k in range(9)] + [(1, 9, 500, 0, 520, 10, 50, 510.0, 5.0)]
    out = M.merge_fragments(make(spark, "slide int, k long, x0 long, y0 long, x1 long, y1 long, area_px long, cx double, cy double", rows), ["slide"]).collect()
    assert sorted((r.x0, r.x1, r.n_merged) for r in out) == [(0, 100, 9), (500, 520, 1)]


def test_ordered_pairs_against_exhaustive_search():
    rng = np.random.default_rng(8)

    def best(f, w, a, i=0, j=0):
        if i == len(f) or j == len(a):
            return 0.0
        gap = abs(f[i] - a[j])
        pair = w[i] * np.exp(-0.5 * (gap / 50) ** 2) + best(f, w, a, i + 1, j + 1) if gap <= 120 else 0.0
        return max(pair, best(f, w, a, i + 1, j), best(f, w, a, i, j + 1))

    lists = [(np.sort(rng.uniform(0, 600, rng.integers(1, 6))), np.sort(rng.uniform(0, 600, rng.integers(1, 6)))) for _ in range(40)]
    weights = [rng.uniform(0.5, 2, len(f)) for f, _ in lists]
    pad = lambda rows: T._padded(pd.Series(rows))
    row, i, j, gain = T._ordered_pairs(pad([f for f, _ in lists]), pad(weights), pad([a for _, a in lists]), 50.0, 120.0)
    for r, (f, a) in enumerate(lists):
        mine = row == r
        assert np.isclose(gain[mine].sum(), best(f, weights[r], a))
        assert (np.diff(i[mine]) > 0).all() and (np.diff(j[mine]) > 0).all()


def test_project_documents_come_back_whole(spark, tmp_path):
    section = {"index": 3, "slide_idx": 0, "bbox_px": [1, 2, 30, 40], "ap_order": 2, "slide_number": 4, "plane": {"ap_um": 10.5, "ml_tilt_deg": 1.5, "dv_tilt_deg": -2.0, "midline_px": 7.0, "dorsal_surface_px": 3.0, "pixel_size_um": 4.0, "image_right_is_anatomical_right": True},
               "ap_source": "user", "rotation_deg": 12.5, "deepslice_anchoring": [float(i) for i in range(9)], "registration": {"anchoring": [1.0 * i for i in range(9)], "output_size_px": [20, 30], "bspline_transform_path": "t.h5", "residual": 0.5},
               "flip_h": True, "flip_v": True, "manual_affine": [[1.0, 0.0, 2.0], [0.0, 1.0, 3.0]], "manual_landmarks": {"source": [[1.0, 2.0]], "target": [[3.0, 4.0]], "forward": True}, "image_path": "s.png",
               "reference": {"project_path": "r.json", "section_index": 5, "matrix": [[1.0, 0.0, 0.0]], "mirrored": False}}
    shank = {"index": 0, "tip_px": {"x_px": 1.0, "y_px": 2.0}, "tip_section_idx": 3, "entry_px": {"x_px": 3.0, "y_px": 4.0}, "entry_section_idx": 3, "tip_ccf_um": [1.0, 2.0, 3.0], "entry_ccf_um": [4.0, 5.0, 6.0], "track_points_ccf_um": [[1.0, 2.0, 3.0]],
             "track_picks": [{"point": {"x_px": 1.0, "y_px": 2.0}, "section_idx": 3}], "ephys": {"feature_um": [1.0, 2.0], "track_um": [1.0, 2.0], "extremes_mode": "uniform", "insertion_depth_um": 100.0}}
    doc = {"version": 3, "atlas": {"name": "kim_mouse_50um", "resolution_um": 50.0}, "slides": [{"image_path": "a.tif", "source_paths": ["b.tif"], "sections": [section, {**section, "index": 4, "plane": None}], "flip_h": False, "flip_v": True, "pixel_um": 2.5}],
           "probes": [{"label": "A", "type": {"name": "NP2", "n_shanks": 1, "shank_pitch_um": 250.0}, "shanks": [shank], "recordings": [{"path": "/r", "label": "x", "stream_name": "lf", "insertion_depth_um": 3.0, "electrode_range": [0, 9], "bank_offset_um": 15.0, "epochs": [{"t_start_s": 0.0, "t_end_s": 1.0, "kept": False, "reject_reason": "noise"}]}]}],
           "section_spacing_um": 60.0, "cell_sets": [{"name": "c", "source": "s", "cells": [{"ap_um": 1.0, "ml_um": 2.0, "dv_um": 3.0, "section_index": 3, "x_px": 4.0, "y_px": 5.0, "cell_type": "t", "region": "CA1"}]}], "seen_from": "front"}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    read = SP.read_projects(spark, str(tmp_path / "p.json"))
    key = read.first().project_id
    K.save_projects(read, str(tmp_path / "same"))
    bare = lambda d: {k: bare(v) for k, v in d.items() if v is not None} if isinstance(d, dict) else [bare(x) for x in d] if isinstance(d, list) else d
    same = json.loads(spark.read.text(str(tmp_path / "same")).first().value)
    assert same == bare(doc)
    change = make(spark, "project_id string, slide_idx long, section_index long, ap_um double, flip_h boolean", [(key, 0, 4, 99.0, False)])
    shanks = make(spark, "project_id string, probe string, shank long, tip_ccf_um array<double>", [(key, "A", 0, [7.0, 8.0, 9.0])])
    K.save_projects(K.change_projects(read, sections=change, shanks=shanks), str(tmp_path / "new"))
    new = json.loads(spark.read.text(str(tmp_path / "new")).first().value)
    want = bare(doc)
    want["slides"][0]["sections"][1] |= {"plane": {"ap_um": 99.0}, "flip_h": False}
    want["probes"][0]["shanks"][0]["tip_ccf_um"] = [7.0, 8.0, 9.0]
    assert new == want
    assert SP.read_saved_projects(spark, str(tmp_path / "new")).filter("reject_reason IS NULL").count() == 1


def test_recordings_deep_down_and_beside_zarr(spark):
    rows = [("/mnt/a/b/c/d/e/f/g/h/i/rec1/info.rhd", False), ("/mnt/x.zarr/info.rhd", False), ("/mnt/x.zarr", True), ("/mnt/my.zarr_export/rec2/info.rhd", False), ("/other/rec3/info.rhd", False)]
    got = {r.dir for r in SR.find_recordings(make(spark, "path string, is_dir boolean", rows), root="/mnt").collect()}
    assert got == {"/mnt/a/b/c/d/e/f/g/h/i/rec1", "/mnt/my.zarr_export/rec2"}


def test_section_overlaps_over_all_orientations(spark):
    """Each of the 18 turns and mirrors alone, and the best of them, against bitmaps turned pixel by pixel."""
    width, height, turns = 16, 12, [float(a) for a in range(-12, 13, 3)]
    rng = np.random.default_rng(5)
    shapes = {k: rng.random((height, width)) < 0.5 for k in range(4)}

    def turned(shape, turn, mirror):
        cx, cy, a = (width - 1) / 2, (height - 1) / 2, np.radians(turn)
        oy, ox = np.mgrid[:height, :width]
        x = np.rint(cx + np.cos(a) * (ox - cx) - np.sin(a) * (oy - cy)).astype(int)
        y = np.rint(cy + np.sin(a) * (ox - cx) + np.cos(a) * (oy - cy)).astype(int)
        x = width - 1 - x if mirror else x
        inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        return inside & shape[np.clip(y, 0, height - 1), np.clip(x, 0, width - 1)]

    pixels = make(spark, "pair long, section long, x int, y int", [(0, k, int(x), int(y)) for k, s in shapes.items() for y, x in zip(*np.nonzero(s))])
    targets = M.outline_bitmaps(pixels.filter("section < 2"), ["pair", "section"], width=width, height=height, turns=turns, mirrors=(False, True)).cache()
    references = M.outline_bitmaps(pixels.filter("section >= 2"), ["pair", "section"], width=width, height=height).cache()
    own = targets.selectExpr("pair", "section * 1000 + cast(turn + 100 as long) * 2 + cast(mirror as long) as section", "turn", "mirror", "bits")
    single = {(r.section, r.reference): r.overlap for r in M.section_overlaps(own, references).collect()}
    best = {(r.section, r.reference): r for r in M.section_overlaps(targets, references).collect()}
    assert len(single) == 2 * 18 * 2 and len(best) == 4
    for t, r in itertools.product((0, 1), (2, 3)):
        want = {}
        for mirror, turn in itertools.product((False, True), turns):
            b = turned(shapes[t], turn, mirror)
            want[mirror, turn] = (b & shapes[r]).sum() / (b | shapes[r]).sum()
            assert abs(single[t * 1000 + int(turn + 100) * 2 + mirror, r] - want[mirror, turn]) < 1e-12
        top = max(want.values())
        assert abs(best[t, r].overlap - top) < 1e-12
        assert (best[t, r].mirror, best[t, r].turn) == min(o for o, v in want.items() if v >= top - 1e-12)
