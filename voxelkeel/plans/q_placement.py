"""Queries that place sites and look up regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.operators import placement as P
from voxelkeel.operators import regions as R
from voxelkeel.plans.registry import query
from voxelkeel.sinks import tables as K

RES = 250.0
KEY = ["k"]

# Oracle pieces -------------------------------------------------------------------------------
SITES_SQL = """
sites AS (
  SELECT 'Neuropixels 1.0' AS layout, c AS channel, 220 + (c // 2) * 20e0 AS depth, CASE WHEN (c // 2) % 2 = 0 THEN 27e0 ELSE 11e0 END + (c % 2) * 32 - 35 AS lat FROM range(384) z(c)
  UNION ALL SELECT 'Neuropixels 2.0 (4-shank)', c, 217 + (c // 2) * 15e0, 27e0 + (c % 2) * 32 - 35 FROM range(384) z(c)
  UNION ALL SELECT 'NeuroNexus A1x32-Poly3-10mm-25s-177-OA32LP', row_number() OVER (ORDER BY d, x) - 1, d, x FROM (
    SELECT 62 + 25e0 * r AS d, 0e0 AS x FROM range(12) z(r) UNION ALL SELECT 74.5e0 + 25 * r, x FROM range(10) z(r), (VALUES (-18e0), (18e0)) v(x)) q
  UNION ALL SELECT 'NeuroNexus A1x32-Poly2-10mm-50s-177-OA32LP', c, 75 + 25e0 * c, CASE WHEN c % 2 = 0 THEN -21.5e0 ELSE 21.5e0 END FROM range(32) z(c)),
named AS (SELECT * FROM (VALUES ('Neuropixels 1.0', 'Neuropixels 1.0'), ('Neuropixels 2.0 (4-shank)', 'Neuropixels 2.0 (4-shank)'),
  ('NEURONEXUS A1x32', 'NeuroNexus A1x32-Poly3-10mm-25s-177-OA32LP'), ('NeuroNexus A1x32-Poly2-10mm-50s-177-OA32LP', 'NeuroNexus A1x32-Poly2-10mm-50s-177-OA32LP'),
  ('neuropix custom', 'Neuropixels 1.0'), ('Tetrode 8', 'Neuropixels 1.0')) v(probe_type, layout))"""

# Landmarks with tails handled, one row per landmark: k, i, f, t.
TAILS_SQL = """
al AS (SELECT *, n_user + 2 AS n FROM b_alignment_points),
nb AS (SELECT *, lead(feature_um - track_um) OVER w - (feature_um - track_um) AS dnext, (feature_um - track_um) - lag(feature_um - track_um) OVER w AS dprev
  FROM al WINDOW w AS (PARTITION BY k ORDER BY i)),
rg AS (SELECT k, regr_slope(track_um, feature_um) AS sl, regr_intercept(track_um, feature_um) AS ic FROM al WHERE i > 0 AND i < n - 1 GROUP BY k),
tails AS (SELECT nb.k, i, n, feature_um, track_um,
  CASE WHEN n > 2 AND extremes_mode = 'linear' AND n >= 5 AND i = 0 THEN track_um - 1e6 WHEN n > 2 AND extremes_mode = 'linear' AND n >= 5 AND i = n - 1 THEN track_um + 1e6 ELSE feature_um END AS f,
  CASE WHEN n <= 2 OR extremes_mode = 'none' THEN track_um
    WHEN extremes_mode = 'linear' AND n >= 5 THEN CASE WHEN i = 0 THEN sl * (track_um - 1e6) + ic WHEN i = n - 1 THEN sl * (track_um + 1e6) + ic ELSE track_um END
    ELSE CASE WHEN i = 0 THEN track_um - dnext WHEN i = n - 1 THEN track_um + dprev ELSE track_um END END AS t
  FROM nb LEFT JOIN rg ON rg.k = nb.k)"""


def segments_sql(source: str, name: str = "seg", x: str = "f", y: str = "t") -> str:
    """Knot segments with open ends: x0, y0, slope over [lo, hi)."""
    return f"""
{name}0 AS (SELECT k, {x} AS x0, {y} AS y0, lead({x}) OVER w AS x1, lead({y}) OVER w AS y1, row_number() OVER w AS rn, count(*) OVER (PARTITION BY k) AS nk
  FROM {source} WINDOW w AS (PARTITION BY k ORDER BY {x}, {y})),
{name} AS (SELECT k, x0, y0, CASE WHEN x1 = x0 THEN 1 ELSE (y1 - y0) / (x1 - x0) END AS sl, CASE WHEN rn = 1 THEN -1e300 ELSE x0 END AS lo,
  CASE WHEN rn = nk - 1 THEN 1e300 ELSE x1 END AS hi FROM {name}0 WHERE rn < nk)"""


PATH_SQL = """
wp AS (SELECT w.k, w.i, w.ap, w.ml, w.dv, ((w.ap - s.tip_ap) * (s.entry_ap - s.tip_ap) + (w.ml - s.tip_ml) * (s.entry_ml - s.tip_ml) + (w.dv - s.tip_dv) * (s.entry_dv - s.tip_dv)) AS pr,
    s.entry_ap = s.tip_ap AND s.entry_ml = s.tip_ml AND s.entry_dv = s.tip_dv AS flat
  FROM b_track_points w JOIN b_shanks s ON s.k = w.k),
raw AS (SELECT k, -1 AS o1, -1e300 AS o2, 0 AS o3, tip_ap AS ap, tip_ml AS ml, tip_dv AS dv FROM b_shanks WHERE tip_ap IS NOT NULL
  UNION ALL SELECT k, 0, pr, i, ap, ml, dv FROM wp WHERE NOT flat
  UNION ALL SELECT k, 1, 0, 0, entry_ap, entry_ml, entry_dv FROM b_shanks WHERE tip_ap IS NOT NULL),
st AS (SELECT *, row_number() OVER w AS rn, sqrt((ap - lag(ap) OVER w) ** 2 + (ml - lag(ml) OVER w) ** 2 + (dv - lag(dv) OVER w) ** 2) AS step,
    k IN (SELECT k FROM wp WHERE NOT flat) AS curved FROM raw WINDOW w AS (PARTITION BY k ORDER BY o1, o2, o3)),
path AS (SELECT k, curved, ap, ml, dv, row_number() OVER w AS v, count(*) OVER (PARTITION BY k) AS nv, sum(coalesce(step, 0)) OVER w AS s
  FROM st WHERE rn = 1 OR step > 1e-6 OR NOT curved WINDOW w AS (PARTITION BY k ORDER BY rn))"""

# Straight placement of rows (entry_*, tip_*, depth d, lateral lat): adds ap, ml, dv.
def straight_sql(source: str, out: str) -> str:
    return f"""
{out}0 AS (SELECT *, sqrt((tip_ap - entry_ap) ** 2 + (tip_ml - entry_ml) ** 2 + (tip_dv - entry_dv) ** 2) AS len FROM {source}),
{out}1 AS (SELECT *, (tip_ap - entry_ap) / nullif(len, 0) AS xa, (tip_ml - entry_ml) / nullif(len, 0) AS xm, (tip_dv - entry_dv) / nullif(len, 0) AS xd FROM {out}0),
{out}2 AS (SELECT *, CASE WHEN abs(xm) > 0.9 THEN 0 ELSE -xd END AS wa, CASE WHEN abs(xm) > 0.9 THEN xd ELSE 0 END AS wm, CASE WHEN abs(xm) > 0.9 THEN -xm ELSE xa END AS wd FROM {out}1),
{out} AS (SELECT *, CASE WHEN len < 1 THEN entry_ap ELSE entry_ap + (len - d) * xa + (lat - 16) * wa / sqrt(wa * wa + wm * wm + wd * wd) END AS ap,
  CASE WHEN len < 1 THEN entry_ml ELSE entry_ml + (len - d) * xm + (lat - 16) * wm / sqrt(wa * wa + wm * wm + wd * wd) END AS ml,
  CASE WHEN len < 1 THEN entry_dv ELSE entry_dv + (len - d) * xd + (lat - 16) * wd / sqrt(wa * wa + wm * wm + wd * wd) END AS dv FROM {out}2)"""


# Curved placement of rows (k, d, lat) on ``path``.
def curved_sql(source: str, out: str) -> str:
    return f"""
psg0 AS (SELECT k, v, nv, ap, ml, dv, s, lead(ap) OVER w AS ap1, lead(ml) OVER w AS ml1, lead(dv) OVER w AS dv1, lead(s) OVER w AS s1 FROM path WINDOW w AS (PARTITION BY k ORDER BY v)),
psg AS (SELECT *, CASE WHEN v = 1 THEN -1e300 ELSE s END AS lo, CASE WHEN v = nv - 1 THEN 1e300 ELSE s1 END AS hi,
  sqrt((ap1 - ap) ** 2 + (ml1 - ml) ** 2 + (dv1 - dv) ** 2) AS ln FROM psg0 WHERE v < nv),
{out}1 AS (SELECT q.*, p.ap AS pa, p.ml AS pm, p.dv AS pd, p.ap1, p.ml1, p.dv1, p.s AS ps, p.s1 AS ps1, (p.ap1 - p.ap) / ln AS ta, (p.ml1 - p.ml) / ln AS tm, (p.dv1 - p.dv) / ln AS td
  FROM {source} q JOIN psg p ON p.k = q.k AND q.d >= p.lo AND q.d < p.hi WHERE ln > 1e-12),
{out}2 AS (SELECT *, CASE WHEN abs(tm) > 0.9 THEN 0 ELSE td END AS wa, CASE WHEN abs(tm) > 0.9 THEN -td ELSE 0 END AS wm, CASE WHEN abs(tm) > 0.9 THEN tm ELSE -ta END AS wd FROM {out}1),
{out} AS (SELECT *, pa + (d - ps) * ta + (lat - 16) * wa / sqrt(wa * wa + wm * wm + wd * wd) AS ap,
  pm + (d - ps) * tm + (lat - 16) * wm / sqrt(wa * wa + wm * wm + wd * wd) AS ml, pd + (d - ps) * td + (lat - 16) * wd / sqrt(wa * wa + wm * wm + wd * wd) AS dv FROM {out}2)"""


def region_sql(source: str, out: str) -> str:
    """Left lookup of ``ap, ml, dv`` rows in the 250 um atlas."""
    return f"""
{out} AS (SELECT q.*, coalesce(s.acronym, '') AS region, coalesce(s.id, 0) AS region_id, coalesce(printf('#%02x%02x%02x', s.r, s.g, s.b), '') AS region_color
  FROM {source} q LEFT JOIN b_annotation a ON a.i_ap = floor(q.ap / 250) AND a.i_dv = floor(q.dv / 250) AND a.i_ml = floor(q.ml / 250) AND a.structure_id > 0
  LEFT JOIN b_structures s ON s.id = a.structure_id)"""


SITE_ROWS_SQL = "rows AS (SELECT b.*, s.channel, s.depth AS d, s.lat FROM b_shanks b JOIN named USING (probe_type) JOIN sites s USING (layout) WHERE tip_ap IS NOT NULL)"

ALIGNED_SQL = f"""{SITES_SQL.strip()}, {SITE_ROWS_SQL}, {TAILS_SQL.strip()}, {segments_sql('tails').strip()}, {PATH_SQL.strip()},
len AS (SELECT k, bool_or(curved) AS curved, max(s) AS plen FROM path GROUP BY k),
ident AS (SELECT k, bool_and(abs(feature_um - track_um) <= 1e-6 + 1e-5 * abs(track_um)) AS same FROM b_alignment_points GROUP BY k),
ref AS (SELECT rows.*, len.curved, plen, CASE WHEN a.insertion_depth_um > 0 THEN a.insertion_depth_um ELSE plen END AS refd,
    coalesce(a.k IS NOT NULL AND NOT (same AND abs(CASE WHEN a.insertion_depth_um > 0 THEN a.insertion_depth_um ELSE plen END - plen) <= 1e-6), false) AS used
  FROM rows JOIN len ON len.k = rows.k LEFT JOIN b_alignments a ON a.k = rows.k LEFT JOIN ident ON ident.k = rows.k),
adep AS (SELECT ref.* EXCLUDE (d), CASE WHEN used THEN plen - (seg.y0 + seg.sl * (refd - d - seg.x0)) ELSE d END AS d
  FROM ref LEFT JOIN seg ON seg.k = ref.k AND used AND refd - d >= lo AND refd - d < hi)"""

PLACED_SQL = f"""{ALIGNED_SQL}, arow AS (SELECT * FROM adep WHERE NOT curved), crow AS (SELECT * FROM adep WHERE curved),
{straight_sql('arow', 'sp').strip()}, {curved_sql('crow', 'cp').strip()},
placed AS (SELECT k, project_id, probe, shank, channel, used, ap, ml, dv FROM sp UNION ALL SELECT k, project_id, probe, shank, channel, used, ap, ml, dv FROM cp)"""


def _alignments(t):
    arrays = P.alignment_arrays(t.b_alignment_points, KEY)
    return t.b_alignments.select("k", "extremes_mode", "insertion_depth_um").join(arrays, "k")


def placed_channels(t):
    return P.place_probe_channels(t.b_shanks, t.b_track_points, _alignments(t), KEY)


# Queries ---------------------------------------------------------------------------------------


@query("s14_probe_layouts", f"""WITH {SITES_SQL.strip()}
SELECT probe, shank, probe_type, layout, CAST(channel AS INT) AS channel, depth AS depth_from_tip_um, lat AS lateral_um
FROM b_shanks JOIN named USING (probe_type) JOIN sites USING (layout)""")
def _s14(t):
    return P.with_sites(t.b_shanks).select("probe", "shank", "probe_type", "layout", "channel", "depth_from_tip_um", "lateral_um")


@query("p22_place_channels", f"""WITH {SITES_SQL.strip()}, {SITE_ROWS_SQL}, {straight_sql('rows', 'sp').strip()}
SELECT probe, shank, CAST(channel AS INT) AS channel, round(ap, 6) + 0e0 AS ap_um, round(ml, 6) + 0e0 AS ml_um, round(dv, 6) + 0e0 AS dv_um FROM sp""")
def _p22(t):
    sites = P.with_sites(P.shank_frames(t.b_shanks.filter("tip_ap IS NOT NULL")))
    return G.rounded(P.place_channels(sites).select("probe", "shank", "channel", "ap_um", "ml_um", "dv_um"))


@query("p23_place_channels_curved", f"""WITH {SITES_SQL.strip()}, {SITE_ROWS_SQL}, {PATH_SQL.strip()}, {curved_sql('rows', 'cp').strip()}
SELECT probe, shank, CAST(channel AS INT) AS channel, round(ap, 6) + 0e0 AS ap_um, round(ml, 6) + 0e0 AS ml_um, round(dv, 6) + 0e0 AS dv_um FROM cp""")
def _p23(t):
    moving = t.b_shanks.filter("tip_ap IS NOT NULL AND NOT (tip_ap = entry_ap AND tip_ml = entry_ml AND tip_dv = entry_dv)")
    sites = P.with_sites(P.curved_frames(P.track_polyline(moving, t.b_track_points, KEY)))
    return G.rounded(P.place_channels_curved(sites).select("probe", "shank", "channel", "ap_um", "ml_um", "dv_um"))


_QUERY_DEPTHS = "SELECT k, CAST(q AS BIGINT) AS q, q * 371e0 - 500 AS depth FROM (SELECT k, SEQ[0;14] AS q FROM b_alignments) z"


@query("p24_landmark_map", f"""WITH {segments_sql('b_alignment_points', 'fw', 'feature_um', 'track_um').strip()}, {segments_sql('b_alignment_points', 'bw', 'track_um', 'feature_um').strip()}
SELECT q.k, q.q, round(fw.y0 + fw.sl * (depth - fw.x0), 6) + 0e0 AS track_um, round(bw.y0 + bw.sl * (depth - bw.x0), 6) + 0e0 AS feature_um
FROM ({_QUERY_DEPTHS}) q JOIN fw ON fw.k = q.k AND depth >= fw.lo AND depth < fw.hi JOIN bw ON bw.k = q.k AND depth >= bw.lo AND depth < bw.hi""")
def _p24(t):
    arrays = P.alignment_arrays(t.b_alignment_points, KEY)
    arrays = P.sorted_knots(P.sorted_knots(arrays, "fs", "ts", "fx", "fy"), "ts", "fs", "bx", "by")
    q = t.sql(_QUERY_DEPTHS).join(arrays, "k")
    q = P.map_depth(P.map_depth(q, "track_um", F.col("depth"), "fx", "fy"), "feature_um", F.col("depth"), "bx", "by")
    return G.rounded(q.select("k", "q", "track_um", "feature_um"))


@query("p25_landmark_tails", f"""WITH {TAILS_SQL.strip()}
SELECT k, CAST(i AS INT) AS i, round(f, 4) + 0e0 AS f, round(t, 4) + 0e0 AS t FROM tails""")
def _p25(t):
    fitted = P.fit_tails(_alignments(t))
    pairs = F.posexplode(F.arrays_zip("ff", "tf")).alias("i", "p")
    return G.rounded(fitted.select("k", pairs).select("k", "i", F.col("p.ff").alias("f"), F.col("p.tf").alias("t")), 4)


@query("p26_landmark_checks", """
WITH z AS (SELECT k, feature_um AS f0, track_um AS t0, lead(feature_um) OVER w AS f1, lead(track_um) OVER w AS t1, row_number() OVER w AS rn FROM b_alignment_points WINDOW w AS (PARTITION BY k ORDER BY feature_um, track_um)),
bad AS (SELECT k, CASE WHEN f1 <= f0 THEN 0 ELSE 1 END AS kind, rn, f0, t0, f1, t1 FROM z WHERE f1 IS NOT NULL AND (f1 <= f0 OR t1 <= t0)),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY kind, rn) AS o FROM bad) q WHERE o = 1),
st AS (SELECT k, min((t1 - t0) / nullif(f1 - f0, 0)) AS mn, max((t1 - t0) / nullif(f1 - f0, 0)) AS mx FROM z WHERE f1 IS NOT NULL GROUP BY k),
off AS (SELECT k, avg(track_um - feature_um) FILTER (i > 0 AND i < n_user + 1) AS mean_off, max(CASE WHEN n_user = 0 OR (i > 0 AND i < n_user + 1) THEN track_um + 25 ELSE track_um END) AS top FROM b_alignment_points GROUP BY k)
SELECT st.k, CASE kind WHEN 0 THEN 'same_feature' WHEN 1 THEN 'crossed' END AS violation, f0 AS bad_feature, t0 AS bad_track, f1 AS next_feature, t1 AS next_track,
  round(coalesce(mean_off, 0), 6) + 0e0 AS offset_um, round(mn, 6) + 0e0 AS min_stretch, round(mx, 6) + 0e0 AS max_stretch, round(top, 6) + 0e0 AS shifted_top_um
FROM st JOIN off ON off.k = st.k LEFT JOIN b1 ON b1.k = st.k""")
def _p26(t):
    checks = P.landmark_checks(P.alignment_arrays(t.b_alignment_points, KEY))
    shifted = P.shift_landmarks(t.b_alignment_points, 25.0).groupBy("k").agg(F.max("track_um").alias("shifted_top_um"))
    return G.rounded(checks.join(shifted, "k").select(
        "k", "violation", "bad_feature", "bad_track", "next_feature", "next_track", "offset_um",
        F.array_min("stretch").alias("min_stretch"), F.array_max("stretch").alias("max_stretch"), "shifted_top_um"))


@query("p28_aligned_depths", f"""WITH {ALIGNED_SQL}
SELECT probe, shank, CAST(channel AS INT) AS channel, used AS used_alignment, round(d, 6) + 0e0 AS aligned_depth_um FROM adep""")
def _p28(t):
    out = placed_channels(t)
    return G.rounded(out.select("probe", "shank", "channel", "used_alignment", "aligned_depth_um"))


@query("w07_track_polyline", f"""WITH {PATH_SQL.strip()}
SELECT k, CAST(v - 1 AS INT) AS vertex, round(ap, 6) + 0e0 AS ap, round(ml, 6) + 0e0 AS ml, round(dv, 6) + 0e0 AS dv, round(s, 6) + 0e0 AS s FROM path""")
def _w07(t):
    tracks = P.track_polyline(t.b_shanks.filter("tip_ap IS NOT NULL"), t.b_track_points, KEY)
    return G.rounded(tracks.select("k", F.posexplode("path").alias("vertex", "p")).select("k", "vertex", "p.*"))


@query("a19_track_stats", f"""WITH {PATH_SQL.strip()},
e AS (SELECT p.*, s.tip_ap, s.tip_ml, s.tip_dv, s.entry_ap - s.tip_ap AS ua, s.entry_ml - s.tip_ml AS um, s.entry_dv - s.tip_dv AS ud FROM path p JOIN b_shanks s ON s.k = p.k),
g AS (SELECT *, sqrt(ua * ua + um * um + ud * ud) AS ln, ap - tip_ap AS ra, ml - tip_ml AS rm, dv - tip_dv AS rd FROM e),
h AS (SELECT *, CASE WHEN ln > 0 THEN (ra * ua + rm * um + rd * ud) / ln ELSE 0 END AS al FROM g)
SELECT k, round(max(s), 6) + 0e0 AS path_length_um, round(CASE WHEN max(nv) < 3 THEN 0 ELSE max(sqrt((ra - al * coalesce(ua / nullif(ln, 0), 0)) ** 2 + (rm - al * coalesce(um / nullif(ln, 0), 0)) ** 2 + (rd - al * coalesce(ud / nullif(ln, 0), 0)) ** 2)) END, 6) + 0e0 AS max_deviation_um
FROM h GROUP BY k""")
def _a19(t):
    tracks = P.track_polyline(t.b_shanks.filter("tip_ap IS NOT NULL"), t.b_track_points, KEY)
    return G.rounded(P.track_stats(tracks).select("k", "path_length_um", "max_deviation_um"))


@query("j01_region_at_point", f"""WITH pts AS (SELECT pos, ap_um AS ap, ml_um AS ml, dv_um AS dv FROM b_cells), {region_sql('pts', 'hit').strip()}
SELECT pos, region, region_id, region_color FROM hit""")
def _j01(t):
    out = R.region_at_point(t.b_cells, t.b_annotation, t.b_structures, resolution_um=RES)
    return out.select("pos", "region", "region_id", "region_color")


@query("k01_export_channel_csv", f"""WITH {PLACED_SQL}, {region_sql('placed', 'hit').strip()}
SELECT probe, shank, CAST(channel AS INT) AS channel, round(ap, 2) + 0e0 AS ap_um, round(ml, 2) + 0e0 AS ml_um, round(dv, 2) + 0e0 AS dv_um,
  CASE WHEN used THEN 'ephys_alignment' ELSE 'geometry' END AS depth_source, region, region_id, region_color FROM hit""")
def _k01(t):
    located = R.region_at_point(placed_channels(t), t.b_annotation, t.b_structures, resolution_um=RES)
    return K.channel_table(located)


@query("k02_export_paxinos_csv", f"""WITH {PLACED_SQL}, {region_sql('placed', 'hit').strip()},
m AS (SELECT *, ap - 5400 AS a, dv - 440 AS b, radians(5) AS p FROM hit)
SELECT probe, shank, CAST(channel AS INT) AS channel, round(-((a * cos(p) - b * sin(p)) * 1.031e0) / 1000, 3) + 0e0 AS ap_mm, round(-((ml - 5700) * 0.952e0) / 1000, 3) + 0e0 AS ml_mm,
  round(((a * sin(p) + b * cos(p)) * 0.885e0) / 1000, 3) + 0e0 AS dv_mm, CASE WHEN used THEN 'ephys_alignment' ELSE 'geometry' END AS depth_source, region, region_id, region_color FROM m""")
def _k02(t):
    located = R.region_at_point(placed_channels(t), t.b_annotation, t.b_structures, resolution_um=RES)
    return K.paxinos_table(located.withColumn("atlas_name", F.lit("allen_mouse_25um")), alignment="qiu2018")


TRACK_SQL = f"""smp AS (SELECT k, probe, shank, CAST(i AS BIGINT) AS sample, i * 50e0 AS depth, entry_ap + CASE WHEN ln > 0 THEN i * 50e0 * (tip_ap - entry_ap) / ln ELSE 0 END AS ap,
    entry_ml + CASE WHEN ln > 0 THEN i * 50e0 * (tip_ml - entry_ml) / ln ELSE 0 END AS ml, entry_dv + CASE WHEN ln > 0 THEN i * 50e0 * (tip_dv - entry_dv) / ln ELSE 0 END AS dv
  FROM (SELECT *, unnest(generate_series(0, CAST(floor(ln / 50) AS BIGINT))) AS i FROM (SELECT *, sqrt((tip_ap - entry_ap) ** 2 + (tip_ml - entry_ml) ** 2 + (tip_dv - entry_dv) ** 2) AS ln FROM b_shanks WHERE tip_ap IS NOT NULL) z0) z),
{region_sql('smp', 'hit').strip()},
mk AS (SELECT *, CASE WHEN lag(region) OVER w IS NULL OR lag(region) OVER w <> region THEN 1 ELSE 0 END AS st, lag(depth) OVER w AS pd, lead(depth) OVER w AS nd FROM hit WINDOW w AS (PARTITION BY k ORDER BY depth)),
rn AS (SELECT *, sum(st) OVER (PARTITION BY k ORDER BY depth) - 1 AS band FROM mk),
bands AS (SELECT k, probe, shank, CAST(band AS BIGINT) AS band, min(region) AS region, coalesce(min(CASE WHEN st = 1 THEN (depth + pd) / 2 END), min(depth)) AS top_um,
  max(coalesce((depth + nd) / 2, depth)) AS bottom_um, count(*) AS n_samples FROM rn GROUP BY k, probe, shank, band)"""


def track_hits(t):
    return R.region_at_point(P.sample_track(t.b_shanks, step_um=50.0), t.b_annotation, t.b_structures, resolution_um=RES)


def bands(t):
    return R.region_bands(track_hits(t), ["k", "probe", "shank"])


@query("w01_region_bands", f"""WITH {TRACK_SQL},
nx AS (SELECT *, lead(region) OVER w AS below, lead(bottom_um - top_um) OVER w AS nt FROM bands WINDOW w AS (PARTITION BY k ORDER BY band))
SELECT k, band, region, top_um, bottom_um, n_samples, coalesce(region <> '' AND below <> '' AND bottom_um - top_um >= 150 AND nt >= 150, false) AS boundary_below FROM nx""")
def _w01(t):
    b = bands(t)
    edges = R.candidate_boundaries(b, ["k"]).select("k", F.col("boundary_um").alias("bottom_um"), F.lit(True).alias("_e"))
    return b.join(edges, ["k", "bottom_um"], "left").select(
        "k", "band", "region", "top_um", "bottom_um", "n_samples", F.coalesce("_e", F.lit(False)).alias("boundary_below"))


@query("j01_regions_along_track", f"""WITH {TRACK_SQL}
SELECT k, region, CAST(row_number() OVER (PARTITION BY k ORDER BY f, region) AS INT) AS rank FROM (SELECT k, region, min(sample) AS f FROM hit WHERE region NOT IN ('', 'root') GROUP BY k, region) q""")
def _j01b(t):
    return R.regions_in_order(track_hits(t), ["k"], "sample").select("k", "region", "rank")


@query("w04_run_length_labels", f"""WITH {TRACK_SQL}
SELECT k, band AS run, region AS label, n_samples AS n FROM bands""")
def _w04(t):
    return R.run_length_labels(track_hits(t), ["k"], "sample", "region").select("k", "run", "label", "n")


@query("a25_region_thickness", f"""WITH {TRACK_SQL},
nx AS (SELECT *, lead(region) OVER (PARTITION BY k ORDER BY band) AS below FROM bands)
SELECT probe, region, '' AS neighbour, round(sum(bottom_um - top_um), 6) + 0e0 AS thickness_um FROM bands WHERE region <> '' GROUP BY probe, region
UNION ALL SELECT DISTINCT probe, least(region, below), greatest(region, below), 0e0 FROM nx WHERE region <> '' AND below <> '' AND region <> below""")
def _a25(t):
    b = bands(t)
    thick = R.region_thickness(b, ["probe"]).select("probe", "region", F.lit("").alias("neighbour"), "thickness_um")
    pairs = R.region_adjacency(b, ["k"], ["probe"]).select(
        "probe", F.col("region_a").alias("region"), F.col("region_b").alias("neighbour"), F.lit(0.0).alias("thickness_um"))
    return G.rounded(thick.unionByName(pairs))


@query("j07_structure_ancestors", """
WITH RECURSIVE up AS (SELECT id, id AS anc FROM b_structures UNION ALL SELECT up.id, s.parent_id FROM up JOIN b_structures s ON s.id = up.anc WHERE s.parent_id IS NOT NULL),
wm AS (SELECT DISTINCT up.id FROM up JOIN b_structures r ON r.id = up.anc AND r.acronym = 'fiber tracts'),
pts AS (SELECT pos, ap_um AS ap, ml_um AS ml, dv_um AS dv FROM b_cells), """ + region_sql("pts", "hit").strip() + """
SELECT region, region_id IN (SELECT id FROM wm) AS is_fibre, count(*) AS n_points FROM hit WHERE region <> '' GROUP BY region, region_id""")
def _j07(t):
    hits = R.region_at_point(t.b_cells, t.b_annotation, t.b_structures, resolution_um=RES).filter("region <> ''")
    counts = hits.groupBy("region", "region_id").agg(F.count(F.lit(1)).alias("n_points"))
    fibre = R.fibre_tracts(t.b_structures).select(F.col("id").alias("region_id"), F.lit(True).alias("_f"))
    return counts.join(fibre, "region_id", "left").select("region", F.coalesce("_f", F.lit(False)).alias("is_fibre"), "n_points")
