"""Queries over spectra, spikes, stacks and steps along depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.operators import features as A
from voxelkeel.operators import placement as P
from voxelkeel.operators import spans as S
from voxelkeel.plans.q_spans import _DEPTH_SQL, channels
from voxelkeel.plans.registry import query

# --- screening ------------------------------------------------------------------------------

_REF_SQL = "rf AS (SELECT recording, win, sample, channel, uv - median(uv) OVER (PARTITION BY recording, win, sample, shank) AS uv FROM b_lfp)"


def _artifact_sql(source: str) -> str:
    return f"""
md AS (SELECT *, median(uv) OVER (PARTITION BY recording, win, channel) AS med FROM {source}),
ad AS (SELECT recording, win, channel, 1.4826 * median(abs(uv - med)) AS sd FROM md GROUP BY 1, 2, 3),
fl AS (SELECT recording, win, sample, avg(CASE WHEN sd > 0 AND abs(uv - med) > 6 * sd THEN 1e0 ELSE 0e0 END) AS f FROM md JOIN ad USING (recording, win, channel) GROUP BY 1, 2, 3),
ar AS (SELECT recording, win, avg(CASE WHEN f >= 0.5 THEN 1e0 ELSE 0e0 END) AS artifact FROM fl GROUP BY 1, 2),
ac AS (SELECT recording, win, stddev_pop(s) AS activity FROM (SELECT recording, win, channel, stddev_pop(uv) AS s FROM {source} GROUP BY 1, 2, 3) q GROUP BY 1, 2)"""


@query("a11_artifact_score", f"WITH {_artifact_sql('b_lfp').strip()} SELECT recording, win, round(artifact, 6) + 0e0 AS artifact FROM ar")
def _a11(t):
    return G.rounded(A.artifact_score(t.b_lfp))


@query("a12_activity_score", f"WITH {_artifact_sql('b_lfp').strip()} SELECT recording, win, round(activity, 6) + 0e0 AS activity FROM ac")
def _a12(t):
    return G.rounded(A.activity_score(t.b_lfp))


@query("a14_median_reference", f"WITH {_REF_SQL} SELECT recording, win, sample, channel, round(uv, 6) + 0e0 AS uv FROM rf")
def _a14(t):
    return G.rounded(A.median_reference(t.b_lfp).select("recording", "win", "sample", "channel", "uv"))


_SCREEN_SQL = f"""{_REF_SQL}, {_artifact_sql('rf').strip()},
sc AS (SELECT recording, win, artifact, activity, CASE WHEN artifact > 0.02 THEN 'artifact' WHEN activity <= 0 THEN 'flat' END AS reject_reason FROM ar JOIN ac USING (recording, win))"""


@query("a13_screen_windows", f"WITH {_SCREEN_SQL} SELECT recording, win, round(artifact, 6) + 0e0 AS artifact, round(activity, 6) + 0e0 AS activity, reject_reason, reject_reason IS NULL AS kept FROM sc")
def _a13(t):
    return G.rounded(A.screen_windows(t.b_lfp).select("recording", "win", "artifact", "activity", "reject_reason", "kept"))


@query("o01_rank_epochs", f"""WITH {_SCREEN_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY CASE WHEN reject_reason IS NULL THEN 0 ELSE 1 END, CASE WHEN reject_reason IS NULL THEN -activity ELSE 0 END, win) AS position FROM sc)
SELECT recording, win, CAST(position AS INT) AS position, reject_reason IS NULL AND position <= 2 AS kept, CASE WHEN reject_reason IS NULL AND position > 2 THEN 'not_among_best' ELSE reject_reason END AS reject_reason FROM o""")
def _o01(t):
    return A.rank_epochs(A.screen_windows(t.b_lfp), keep=2).select("recording", "win", "position", "kept", "reject_reason")


_RECS = "SELECT o_orderkey AS recording, 1000 + o_orderkey * 37 % 50000 AS n_samples, CASE WHEN o_orderkey % 2 = 0 THEN 2500e0 ELSE 1000e0 END AS fs FROM orders"


@query("w16_candidate_windows", f"""
SELECT recording, CAST(win AS INT) AS win, round(s, 6) + 0e0 AS t_start_s, round(s + w, 6) + 0e0 AS t_end_s FROM (
  SELECT *, least(greatest((win + 0.5) * dur / 6 - w / 2, 0), dur - w) AS s FROM (SELECT recording, unnest(generate_series(0, 5)) AS win, n_samples / fs AS dur, least(10, n_samples / fs) AS w FROM ({_RECS}) r) a) b""")
def _w16(t):
    return G.rounded(A.candidate_windows(t.sql(_RECS)).select("recording", "win", "t_start_s", "t_end_s"))


@query("w16_samples_in_windows", """
WITH r AS (SELECT recording, CAST(max(t_s) AS BIGINT) AS n FROM b_spikes GROUP BY 1),
w AS (SELECT recording, win, least(10000e0, n) AS w, least(greatest((win + 0.5) * n / 6e0 - least(10000e0, n) / 2, 0), n - least(10000e0, n)) AS a FROM (SELECT recording, n, unnest(generate_series(0, 5)) AS win FROM r) q)
SELECT w.recording, CAST(win AS INT) AS win, count(*) AS n_samples, round(sum(amplitude), 3) + 0e0 AS total FROM w JOIN b_spikes s ON s.recording = w.recording AND t_s >= a AND t_s < a + w GROUP BY 1, 2""")
def _w16b(t):
    recs = t.b_spikes.groupBy("recording").agg(F.max("t_s").cast("long").alias("n_samples")).withColumn("fs", F.lit(1.0))
    tagged = A.samples_in_windows(t.b_spikes, A.candidate_windows(recs, window_s=10000.0).select("recording", "win", "t_start_s", "t_end_s"), bucket_s=10000.0)
    return G.rounded(tagged.groupBy("recording", "win").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("amplitude").alias("total")), 3)


# --- spectra ----------------------------------------------------------------------------------


@query("a01_lfp_psd")
def _a01(t):
    return G.rounded(A.lfp_psd(t.b_lfp))


_WINDOWED = "SELECT recording, channel, freq_hz, win, power * (1 + win * 0.25e0) + win * 1e-3 AS power FROM (SELECT *, SEQ[0;2] AS win FROM b_psd) q"


@query("a02_excerpt_psd", f"SELECT recording, channel, freq_hz, round(avg(power), 9) + 0e0 AS power FROM ({_WINDOWED}) q GROUP BY 1, 2, 3")
def _a02(t):
    return G.rounded(A.excerpt_psd(t.sql(_WINDOWED)), 9)


_BAND_SQL = """
bd AS (SELECT * FROM (VALUES (0, 0e0, 4e0), (1, 4e0, 10e0), (2, 10e0, 30e0), (3, 30e0, 80e0), (4, 80e0, 200e0)) v(band, lo, hi)),
bp AS (SELECT c.recording, c.channel, bd.band, CASE WHEN count(*) = count(p.power) THEN avg(p.power) END AS power
  FROM (SELECT DISTINCT recording, channel FROM b_psd) c CROSS JOIN bd LEFT JOIN b_psd p ON p.recording = c.recording AND p.channel = c.channel AND p.freq_hz >= lo AND p.freq_hz < hi GROUP BY 1, 2, 3)"""


@query("a03_band_power", f"WITH {_BAND_SQL.strip()} SELECT recording, channel, band, round(power, 9) + 0e0 AS power FROM bp")
def _a03(t):
    return G.rounded(A.band_power(t.b_psd, ["recording", "channel"]), 9)


@query("a04_normalise_bands", f"""WITH {_BAND_SQL.strip()}, l AS (SELECT *, log10(greatest(power, 1e-12)) AS l FROM bp WHERE power IS NOT NULL),
m AS (SELECT recording, band, median(l) AS m FROM l GROUP BY 1, 2)
SELECT bp.recording, bp.channel, bp.band, round(l.l - m.m, 6) + 0e0 AS level FROM bp LEFT JOIN l USING (recording, channel, band) LEFT JOIN m ON m.recording = bp.recording AND m.band = bp.band""")
def _a04(t):
    out = A.normalise_bands(A.band_power(t.b_psd, ["recording", "channel"]), ["recording"])
    return G.rounded(out.select("recording", "channel", "band", "level"))


@query("a08_regrid_frequency", """
WITH g AS (SELECT i * 7e0 - 14 AS freq_hz FROM range(60) z(i)), k AS (SELECT recording, channel, freq_hz AS f0, power AS p0, lead(freq_hz) OVER w AS f1, lead(power) OVER w AS p1 FROM b_psd WHERE power IS NOT NULL WINDOW w AS (PARTITION BY recording, channel ORDER BY freq_hz))
SELECT c.recording, c.channel, g.freq_hz, round(coalesce(k.p0 + (k.p1 - k.p0) * (g.freq_hz - k.f0) / (k.f1 - k.f0), e.p0), 9) + 0e0 AS power
FROM (SELECT DISTINCT recording, channel FROM b_psd) c CROSS JOIN g LEFT JOIN k ON k.recording = c.recording AND k.channel = c.channel AND g.freq_hz >= k.f0 AND g.freq_hz < k.f1
LEFT JOIN k e ON e.recording = c.recording AND e.channel = c.channel AND e.f0 = g.freq_hz AND e.f1 IS NULL""")
def _a08(t):
    grid = [i * 7.0 - 14.0 for i in range(60)]
    return G.rounded(A.regrid_frequency(t.b_psd, grid, ["recording", "channel"]), 9)


@query("a36_power_image", """
WITH v AS (SELECT recording, channel, freq_hz, log10(power + 1e-12) AS v FROM b_psd), r AS (SELECT recording, freq_hz, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1, 2), c AS (SELECT recording, channel, count(v) > 0 AS row_covered FROM v GROUP BY 1, 2)
SELECT recording, channel, freq_hz, coalesce(CAST(floor(least(1, greatest(0, (v - lo) / CASE WHEN hi <= lo THEN 1 ELSE hi - lo END)) * 255) AS INT), 0) AS level, row_covered FROM v JOIN r USING (recording, freq_hz) JOIN c USING (recording, channel)""")
def _a36(t):
    return A.power_image(t.b_psd, ["recording"], "channel", per_freq=True).select("recording", "channel", "freq_hz", "level", "row_covered")


# --- spikes -------------------------------------------------------------------------------------


def _spike_sites(t):
    recs = t.b_spikes.select("recording").distinct().withColumn("probe_type", F.when(F.col("recording") % 2 == 0, P.NP1).otherwise(P.NP2))
    return P.with_sites(recs).select("recording", F.col("depth_from_tip_um").alias("site_depth_um"))


@query("s12_load_spikes", """
WITH f AS (SELECT *, CASE WHEN recording % 2 = 0 THEN depth_um >= 170 AND depth_um <= 4090 ELSE depth_um >= 167 AND depth_um <= 3132 END AS on_site FROM b_spikes)
SELECT recording, shank, count(*) FILTER (on_site) AS n_spikes, count(*) FILTER (NOT on_site) AS n_dropped_offsite, count(DISTINCT unit) AS n_units, max(t_s) AS duration_s FROM f GROUP BY 1, 2""")
def _s12(t):
    return A.spike_summary(A.load_spikes(t.b_spikes, _spike_sites(t)), ["recording", "shank"])


@query("j03_restrict_to_epochs", """
WITH e AS (SELECT recording, t0, t0 + (t1 - t0) * 0.6e0 AS t1 FROM b_epochs)
SELECT spike_id, recording, t_s FROM b_spikes s WHERE recording NOT IN (SELECT recording FROM e) OR EXISTS (SELECT 1 FROM e WHERE e.recording = s.recording AND s.t_s >= e.t0 AND s.t_s < e.t1)""")
def _j03(t):
    epochs = t.sql("SELECT recording, t0, t0 + (t1 - t0) * 0.6e0 AS t1 FROM b_epochs")
    return A.restrict_to_epochs(t.b_spikes, epochs).select("spike_id", "recording", "t_s")


@query("j03_epoch_duration", "SELECT recording, round(sum(greatest(t1 - t0, 0)), 3) + 0e0 AS duration_s FROM b_epochs GROUP BY recording")
def _j03b(t):
    return G.rounded(A.epoch_duration(t.b_epochs), 3)


@query("a05_depth_profiles", """
WITH r AS (SELECT recording, min(depth_um) AS lo, max(depth_um) AS hi, max(t_s) AS dur FROM b_spikes GROUP BY 1), n AS (SELECT *, CASE WHEN hi > lo THEN CAST(ceil((hi - lo) / 250) AS BIGINT) ELSE 1 END AS nb FROM r),
c AS (SELECT recording, least(CAST(floor((depth_um - lo) / 250) AS BIGINT), nb - 1) AS bin, count(*) AS c, sum(amplitude) AS a FROM b_spikes JOIN n USING (recording) GROUP BY 1, 2),
g AS (SELECT recording, lo, dur, unnest(generate_series(0, nb - 1)) AS bin FROM n)
SELECT recording, bin, round(lo + (bin + 0.5) * 250, 6) + 0e0 AS centre_um, coalesce(c, 0) AS n_spikes, round(CASE WHEN c >= 3 AND dur > 0 THEN c / dur END, 9) + 0e0 AS rate_hz, round(CASE WHEN c >= 3 THEN a / c END, 9) + 0e0 AS mean_amplitude
FROM g LEFT JOIN c USING (recording, bin)""")
def _a05(t):
    return G.rounded(A.depth_profiles(t.b_spikes, ["recording"], bin_um=250.0, min_spikes=3), 9)


@query("u01_all_spikes", """
SELECT recording, spike_id, t_s, depth_um, amplitude FROM b_spikes WHERE recording % 2 = 0 UNION ALL SELECT recording, spike_id, t_s, depth_um + 60, amplitude FROM b_spikes WHERE recording % 2 = 1""")
def _u01(t):
    s = t.b_spikes.select("recording", "spike_id", "t_s", "depth_um", "amplitude")
    shallow = s.filter("recording % 2 = 1").withColumn("depth_um", F.col("depth_um") + 60.0)
    return A.all_spikes(s.filter("recording % 2 = 0"), shallow)


# Which rows a hash draws is Spark's; that they are rows of the table, none twice and as many as asked for, SQL can say.
@query("o02_thin_raster", "SELECT recording, least(count(*), 40) AS n_kept, least(count(*), 40) AS n_known FROM b_spikes GROUP BY recording")
def _o02(t):
    thin = A.thin_raster(t.b_spikes, ["recording"], "spike_id", max_points=40)
    known = thin.join(t.b_spikes.select("recording", "spike_id", "t_s"), ["recording", "spike_id", "t_s"], "left_semi").groupBy("recording").agg(F.count(F.lit(1)).alias("n_known"))
    return thin.groupBy("recording").agg(F.count_distinct("spike_id").alias("n_kept")).join(known, "recording")


# --- stacks --------------------------------------------------------------------------------------

_CELLS_SQL = _DEPTH_SQL + """,
rf0 AS (SELECT penetration, max(insertion_depth_um) AS refd FROM dp GROUP BY 1),
pl AS (SELECT dp.*, CAST(round_even(x_um / 250, 0) AS INT) AS shank, axial_um + bo + 217 + refd - insertion_depth_um AS depth_um FROM dp JOIN rf0 USING (penetration)),
og AS (SELECT penetration, shank, floor(min(depth_um) / 15) * 15 AS origin FROM pl GROUP BY 1, 2),
pb AS (SELECT pl.*, origin, CAST(floor((depth_um - origin) / 15) AS BIGINT) AS bin FROM pl JOIN og USING (penetration, shank)),
ce AS (SELECT penetration, shank, recording, origin, bin, freq_hz, avg(power) AS power FROM pb JOIN b_psd USING (recording, channel) GROUP BY 1, 2, 3, 4, 5, 6),
xt AS (SELECT penetration, shank, recording, min(depth_um) AS top_um, max(depth_um) AS bottom_um FROM pb GROUP BY 1, 2, 3),
wd AS (SELECT penetration, shank, recording AS widest FROM (SELECT *, row_number() OVER (PARTITION BY penetration, shank ORDER BY bottom_um - top_um DESC, recording) AS rn FROM xt) q WHERE rn = 1),
lv AS (SELECT a.penetration, a.shank, a.recording, median(CASE WHEN a.power > 0 AND b.power > 0 THEN log10(a.power) - log10(b.power) END) AS off
  FROM ce a JOIN wd ON wd.penetration = a.penetration AND wd.shank = a.shank JOIN ce b ON b.penetration = a.penetration AND b.shank = a.shank AND b.recording = widest AND b.bin = a.bin AND b.freq_hz = a.freq_hz WHERE a.power IS NOT NULL AND b.power IS NOT NULL GROUP BY 1, 2, 3),
ct AS (SELECT xt.*, recording = widest AS is_ref, CASE WHEN recording <> widest THEN off END AS off,
    CASE WHEN recording = widest THEN 0 ELSE 15 * (SELECT count(*) FROM (SELECT DISTINCT bin FROM ce x WHERE x.penetration = xt.penetration AND x.shank = xt.shank AND x.recording = xt.recording AND x.power IS NOT NULL INTERSECT SELECT DISTINCT bin FROM ce y WHERE y.penetration = xt.penetration AND y.shank = xt.shank AND y.recording = widest AND y.power IS NOT NULL) z) END AS ov
  FROM xt JOIN wd USING (penetration, shank) LEFT JOIN lv USING (penetration, shank, recording))"""


def _cells(t):
    ch = S.shank_of_channel(channels(t))
    return A.place_psd(t.b_psd, ch.select("recording", "channel", "penetration", "shank", "depth_from_tip_um", "insertion_depth_um"))


def stacked(t):
    return A.stack_shank(_cells(t))


@query("a07_level_offset", f"WITH {_CELLS_SQL.strip()} SELECT penetration, shank, recording, top_um, bottom_um, is_ref AS is_level_reference, round(off, 6) + 0e0 AS level_offset_dec, CAST(ov AS DOUBLE) AS overlap_um FROM ct")
def _a07(t):
    return G.rounded(A.level_offsets(_cells(t)))


_STACK_SQL = _CELLS_SQL + """,
ml AS (SELECT penetration, shank, bin, freq_hz, avg(power / power(10e0, coalesce(off, 0))) AS power FROM ce JOIN ct USING (penetration, shank, recording) GROUP BY 1, 2, 3, 4),
gr AS (SELECT penetration, shank, origin, freq_hz, unnest(generate_series(0, last)) AS bin FROM (SELECT penetration, shank, origin, max(bin) AS last FROM ce GROUP BY 1, 2, 3) q JOIN (SELECT DISTINCT penetration, shank, freq_hz FROM ce) f USING (penetration, shank)),
stk AS (SELECT penetration, shank, origin + bin * 15 AS depth_um, freq_hz, power FROM gr LEFT JOIN ml USING (penetration, shank, bin, freq_hz))"""


@query("a06_stack_shank", f"WITH {_STACK_SQL.strip()} SELECT penetration, shank, depth_um, freq_hz, round(power, 8) + 0e0 AS power FROM stk")
def _a06(t):
    return G.rounded(stacked(t), 8)


@query("w02_covered_runs", f"""WITH {_STACK_SQL.strip()}, cv AS (SELECT penetration, shank, depth_um, count(power) > 0 AND depth_um % 105 <> 0 AS covered FROM stk GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY penetration, shank ORDER BY depth_um) AS pos FROM cv), i AS (SELECT *, pos - row_number() OVER (PARTITION BY penetration, shank ORDER BY depth_um) AS isl FROM p WHERE covered),
r AS (SELECT penetration, shank, min(depth_um) AS a, max(depth_um) + 15 AS b FROM i GROUP BY penetration, shank, isl)
SELECT penetration, shank, 'run' AS kind, a AS lo, b AS hi FROM r UNION ALL SELECT penetration, shank, 'gap', b, nx FROM (SELECT *, lead(a) OVER (PARTITION BY penetration, shank ORDER BY a) AS nx FROM r) q WHERE nx IS NOT NULL""")
def _w02(t):
    keys = ["penetration", "shank"]
    grid = stacked(t).groupBy(*keys, "depth_um").agg(((F.count("power") > 0) & (F.col("depth_um") % 105 != 0)).alias("covered"))
    runs = S.covered_runs(grid, keys, bin_um=15.0)
    gaps = S.run_gaps(runs, keys)
    return runs.select(*keys, F.lit("run").alias("kind"), F.col("run_top_um").alias("lo"), F.col("run_bottom_um").alias("hi")).unionByName(
        gaps.select(*keys, F.lit("gap").alias("kind"), F.col("gap_top_um").alias("lo"), F.col("gap_bottom_um").alias("hi")))


# --- steps ------------------------------------------------------------------------------------------


def _contrast_sql(source: str, marks: str, out: str = "ct") -> str:
    return f"""
{out} AS (SELECT k, feature, window_um, at_um, CASE WHEN na >= 3 AND nb >= 3 AND 0.5 * (va + vb) > 0 THEN abs(ma - mb) / sqrt(0.5 * (va + vb)) END AS contrast FROM (
  SELECT m.k, feature, window_um, at_um, count(*) FILTER (depth_um < at_um) AS na, count(*) FILTER (depth_um >= at_um) AS nb, avg(value) FILTER (depth_um < at_um) AS ma, avg(value) FILTER (depth_um >= at_um) AS mb,
    var_pop(value) FILTER (depth_um < at_um) AS va, var_pop(value) FILTER (depth_um >= at_um) AS vb FROM {marks} m JOIN {source} p ON p.k = m.k AND depth_um >= at_um - window_um AND depth_um < at_um + window_um GROUP BY 1, 2, 3, 4) q)"""


def _marks_sql(window: float, step: float, out: str = "mk") -> str:
    return f"""
{out} AS (SELECT k, {window}e0 AS window_um, lo + {window} + unnest(generate_series(0, CAST(ceil((hi - lo - 2 * {window}) / {step}) AS BIGINT) - 1)) * {step}e0 AS at_um FROM (SELECT k, min(depth_um) AS lo, max(depth_um) AS hi FROM b_profiles GROUP BY k) q)"""


_BAD_SQL = """
lv AS (SELECT k, depth_um, avg(value) AS l FROM b_profiles GROUP BY 1, 2),
lo AS (SELECT *, l - median(l) OVER (PARTITION BY k ORDER BY depth_um ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS r FROM lv),
ce AS (SELECT k, median(r) AS c, count(*) AS n FROM lo GROUP BY 1), sp AS (SELECT k, 1.4826 * median(abs(r - c)) AS s FROM lo JOIN ce USING (k) GROUP BY 1),
bad AS (SELECT k, depth_um, n >= 5 AND (l IS NULL OR coalesce(s > 0 AND abs(r) > 5 * s, false)) AS bad FROM lo JOIN ce USING (k) JOIN sp USING (k))"""
_CLEAN_SQL = _BAD_SQL + """,
gd AS (SELECT p.k, feature, p.depth_um, value, lead(p.depth_um) OVER w AS d1, lead(value) OVER w AS v1, lag(value) OVER w IS NULL AS first FROM b_profiles p JOIN bad USING (k, depth_um) WHERE NOT bad WINDOW w AS (PARTITION BY p.k, feature ORDER BY p.depth_um)),
cl AS (SELECT p.k, p.feature, p.depth_um, bad, CASE WHEN NOT bad THEN p.value WHEN p.depth_um < g.depth_um OR g.d1 IS NULL THEN coalesce(g.value, p.value) ELSE g.value + (g.v1 - g.value) * (p.depth_um - g.depth_um) / (g.d1 - g.depth_um) END AS value
  FROM b_profiles p JOIN bad USING (k, depth_um) LEFT JOIN gd g ON bad AND g.k = p.k AND g.feature = p.feature AND (p.depth_um >= g.depth_um AND (g.d1 IS NULL OR p.depth_um < g.d1) OR (g.first AND p.depth_um < g.depth_um)))"""


@query("w08_bad_channels", f"WITH {_CLEAN_SQL.strip()} SELECT k, CAST(feature AS BIGINT) AS feature, depth_um, round(value, 6) + 0e0 AS value, bad FROM cl")
def _w08(t):
    return G.rounded(A.interpolate_bad(t.b_profiles, ["k"]).withColumn("feature", F.col("feature").cast("long")))


@query("w05_boundary_contrast", f"WITH {_marks_sql(150, 25).strip()}, {_contrast_sql('b_profiles', 'mk').strip()} SELECT k, CAST(feature AS BIGINT) AS feature, round(at_um, 6) + 0e0 AS at, round(contrast, 6) + 0e0 AS contrast FROM ct WHERE contrast IS NOT NULL")
def _w05(t):
    out = A.contrast_null(t.b_profiles, ["k"])
    return G.rounded(out.select("k", F.col("feature").cast("long").alias("feature"), "at", "contrast"))


@query("w06_step_profile", f"""WITH {_CLEAN_SQL.strip()},
z AS (SELECT k, feature, depth_um, (value - avg(value) OVER (PARTITION BY k, feature)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY k, feature) > 0 THEN stddev_pop(value) OVER (PARTITION BY k, feature) ELSE 1 END AS value FROM cl),
{_marks_sql(250, 20).strip()}, {_contrast_sql('z', 'mk').strip()}
SELECT mk.k, round(mk.at_um, 6) + 0e0 AS at, round(coalesce(s, 0), 6) + 0e0 AS score FROM mk LEFT JOIN (SELECT k, at_um, avg(contrast) AS s FROM ct GROUP BY 1, 2) q ON q.k = mk.k AND q.at_um = mk.at_um""")
def _w06(t):
    windows = t.b_profiles.select("k").distinct().withColumn("window_um", F.lit(250.0))
    return G.rounded(A.step_profile(t.b_profiles, windows, ["k"]).select("k", "at", "score"))


@query("w06_multiscale_profile")
def _w06b(t):
    return G.rounded(A.multiscale_profile(t.b_profiles, ["k"]), 5)


@query("a35_null_calibration")
def _a35(t):
    return G.rounded(A.null_calibration(t.b_profiles, A.adaptive_windows(t.b_profiles, ["k"]), ["k"]), 5)


_Z = "SELECT vec_id AS k, (i - 1) * 20e0 AS depth_um, CASE WHEN i % 17 = 5 THEN NULL ELSE abs(CAST(AT[embedding;i] AS DOUBLE)) * 20 END AS z, 100e0 AS scale_um, CASE WHEN vec_id % 3 = 0 THEN 2.5e0 END AS null_z FROM (SELECT vec_id, embedding, SEQ[1;64] AS i FROM embeddings) q"


@query("w09_profile_peaks", f"""
WITH n AS (SELECT *, lag(z) OVER w AS l, lead(z) OVER w AS r, row_number() OVER w AS rn, count(*) OVER (PARTITION BY k) AS c FROM ({_Z}) q WINDOW w AS (PARTITION BY k ORDER BY depth_um))
SELECT k, depth_um, round(z, 6) + 0e0 AS z FROM n WHERE rn > 1 AND rn < c AND z >= coalesce(null_z, 2) AND (l IS NULL OR z >= l) AND (r IS NULL OR z > r)""")
def _w09(t):
    return G.rounded(A.profile_peaks(t.sql(_Z), ["k"]).select("k", "depth_um", "z"))


@query("w09_detect_boundaries")
def _w09b(t):
    return G.rounded(A.detect_boundaries(t.sql(_Z), ["k"]))


@query("a33_step_evidence")
def _a33(t):
    return G.rounded(A.step_evidence(stacked(t), ["penetration", "shank"]), 5)
