"""Queries over probe poses, moves, matching and the placement search."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.operators import features as A
from voxelkeel.operators import trajectory as T
from voxelkeel.plans.q_placement import RES, bands
from voxelkeel.plans.registry import query

EVIDENCE = """SELECT probe, shank, 250e0 + i * 620 + (k * 37) % 190 AS depth_from_tip_um, 1e0 + (k + i) % 5 * 0.5e0 AS weight
FROM (SELECT k, probe, shank, SEQ[0;3] AS i FROM b_shanks WHERE tip_ap IS NOT NULL) q"""
GRID = {"offsets": (-200.0, -100.0, 0.0, 100.0, 200.0), "rolls": (-5.0, 0.0, 5.0), "tilts": (-5.0, 0.0, 5.0)}


def _placed(t):
    return t.b_shanks.filter("tip_ap IS NOT NULL")


def _fit(t):
    return T.fit_trajectory(_placed(t), t.sql(EVIDENCE), t.b_annotation, t.b_structures, resolution_um=RES)


@query("p31_probe_pose")
def _p31(t):
    return G.rounded(T.probe_pose(_placed(t), ["probe"]), 5)


@query("p31_row_positions")
def _p31b(t):
    s = _placed(t)
    return G.rounded(T.row_positions(s, T.probe_pose(s, ["probe"]), ["probe"]).select("probe", "shank", "row_um"), 4)


# Axes given: straight down and along AP, with a small lean, so the oracle needs no eigenvector.
_AXES = "SELECT DISTINCT probe, 0.6e0 AS u_ap, 0e0 AS u_ml, 0.8e0 AS u_dv, 0.8e0 AS r_ap, 0e0 AS r_ml, -0.6e0 AS r_dv FROM b_shanks"
_CAND = "SELECT k, probe, shank, tip_ap, tip_ml, tip_dv, entry_ap, entry_ml, entry_dv, c AS cand, (c - 2) * 4e0 AS tilt_deg, (c % 3 - 1) * 6e0 AS roll_deg, c * 50e0 AS offset_um FROM (SELECT *, SEQ[0;4] AS c FROM b_shanks WHERE tip_ap IS NOT NULL) q"


def _rot_sql(src: str, out: str, points, pivot, axis, deg: str) -> str:
    """One Rodrigues rotation as a CTE: rewrites ``points`` and keeps the other columns."""
    v = [f"({p} - {c})" for p, c in zip(points, pivot)]
    al = "(" + " + ".join(f"{v[i]} * {axis[i]}" for i in range(3)) + ")"
    new = [f"{pivot[i]} + {al} * {axis[i]} * (1 - cos(radians({deg}))) + {v[i]} * cos(radians({deg})) + ({axis[(i + 1) % 3]} * {v[(i + 2) % 3]} - {axis[(i + 2) % 3]} * {v[(i + 1) % 3]}) * sin(radians({deg})) AS {points[i]}" for i in range(3)]
    return f"{out} AS (SELECT * REPLACE ({', '.join(new)}) FROM {src})"


_T, _E, _U, _R = T._TIPS, T._ENTRIES, ["u_ap", "u_ml", "u_dv"], ["r_ap", "r_ml", "r_dv"]
_CT, _CE, _Z, _PV = ["ct0", "ct1", "ct2"], ["ce0", "ce1", "ce2"], ["0e0", "0e0", "0e0"], ["ce0", "ce1", "ce2"]
def _move_sql(candidates: str, shanks: str) -> str:
    return f"""
cen AS (SELECT probe, avg(tip_ap) AS ct0, avg(tip_ml) AS ct1, avg(tip_dv) AS ct2, avg(entry_ap) AS ce0, avg(entry_ml) AS ce1, avg(entry_dv) AS ce2 FROM ({shanks}) q GROUP BY 1),
m0 AS (SELECT c.*, a.* EXCLUDE (probe), cen.* EXCLUDE (probe) FROM ({candidates}) c JOIN ({_AXES}) a ON a.probe = c.probe JOIN cen ON cen.probe = c.probe),
{_rot_sql('m0', 'm1', _T, _PV, _R, 'tilt_deg')}, {_rot_sql('m1', 'm2', _E, _PV, _R, 'tilt_deg')}, {_rot_sql('m2', 'm3', _CT, _PV, _R, 'tilt_deg')},
{_rot_sql('m3', 'm4', _U, _Z, _R, 'tilt_deg')}, {_rot_sql('m4', 'm5', _T, _CT, _U, 'roll_deg')}, {_rot_sql('m5', 'm6', _E, _CE, _U, 'roll_deg')},
mv AS (SELECT probe, shank, cand, tip_ap + offset_um * u_ap AS tip_ap, tip_ml + offset_um * u_ml AS tip_ml, tip_dv + offset_um * u_dv AS tip_dv,
  entry_ap + offset_um * u_ap AS entry_ap, entry_ml + offset_um * u_ml AS entry_ml, entry_dv + offset_um * u_dv AS entry_dv FROM m6)"""


_MOVE_SQL = _move_sql(_CAND, "SELECT * FROM b_shanks WHERE tip_ap IS NOT NULL")

def _moved(t):
    return T.move_probe(t.sql(_CAND), t.sql(_AXES), ["probe"])


@query("p32_move_probe", f"WITH {_MOVE_SQL.strip()} SELECT probe, shank, CAST(cand AS BIGINT) AS cand, " + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in (*_T, *_E)) + " FROM mv")
def _p32(t):
    return G.rounded(_moved(t).select("probe", "shank", "cand", *_T, *_E))


@query("j11_registration_suggestion", f"""WITH {_MOVE_SQL.strip()},
d AS (SELECT mv.probe, mv.cand, mv.tip_ap - s.tip_ap AS a, mv.tip_ml - s.tip_ml AS m, mv.tip_dv - s.tip_dv AS v FROM mv JOIN b_shanks s ON s.probe = mv.probe AND s.shank = mv.shank ), c AS (SELECT probe, cand, avg(a) AS ma, avg(m) AS mm, avg(v) AS mv FROM d GROUP BY 1, 2)
SELECT d.probe, CAST(d.cand AS BIGINT) AS cand, round(ma, 6) + 0e0 AS ap_um, round(mm, 6) + 0e0 AS ml_um, round(mv, 6) + 0e0 AS dv_um, round(max(sqrt((a - ma) ** 2 + (m - mm) ** 2 + (v - mv) ** 2)), 6) + 0e0 AS shank_spread_um,
  max(sqrt((a - ma) ** 2 + (m - mm) ** 2 + (v - mv) ** 2)) >= 50 AS has_rotation, round(ma / 60, 6) + 0e0 AS ap_in_sections, abs(ma) < 25 AS ap_negligible FROM d JOIN c ON c.probe = d.probe AND c.cand = d.cand GROUP BY d.probe, d.cand, ma, mm, mv""")
def _j11(t):
    # Every move of the grid, named by probe and candidate.
    moves, shanks = _moved(t).withColumn("of", F.col("probe")), t.b_shanks.filter("tip_ap IS NOT NULL")
    name = F.format_string("%d:%d", "of", "cand")
    per_move = shanks.withColumnRenamed("probe", "of").withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("probe", name)
    out = T.registration_suggestion(per_move, moves.withColumn("probe", name), section_spacing_um=60.0)
    parts = F.split("probe", ":")
    return G.rounded(out.withColumn("cand", parts[1].cast("long")).withColumn("probe", parts[0].cast("long")))


_PS = "SELECT project_id, probe, (k * 7) % 23 + e AS section_index FROM (SELECT *, SEQ[0;1] AS e FROM b_shanks WHERE tip_ap IS NOT NULL) q"


@query("u03_shared_sections", f"""
WITH s AS (SELECT DISTINCT project_id, probe, section_index FROM ({_PS}) q), p AS (SELECT DISTINCT project_id, probe FROM s),
c AS (SELECT x.project_id, x.probe, y.probe AS other, count(*) AS n FROM s x JOIN s y ON y.project_id = x.project_id AND y.section_index = x.section_index AND y.probe <> x.probe GROUP BY 1, 2, 3)
SELECT p.project_id, p.probe, c.other, coalesce(n, 0) AS n_shared, (SELECT count(*) FROM p q WHERE q.project_id = p.project_id AND q.probe <> p.probe) - (SELECT count(*) FROM c d WHERE d.project_id = p.project_id AND d.probe = p.probe) AS n_disjoint
FROM p LEFT JOIN c ON c.project_id = p.project_id AND c.probe = p.probe""")
def _u03(t):
    return T.shared_sections(t.sql(_PS))


_ax = ("ap", "ml", "dv")
_RIGID_SQL = """
a AS (SELECT k, probe, shank, tip_ap, tip_ml, tip_dv, entry_ap, entry_ml, entry_dv, sqrt((entry_ap - tip_ap) ** 2 + (entry_ml - tip_ml) ** 2 + (entry_dv - tip_dv) ** 2) + 1e-12 AS len,
  count(*) OVER (PARTITION BY probe) AS n, row_number() OVER (PARTITION BY probe ORDER BY shank) - 1 AS i FROM b_shanks WHERE tip_ap IS NOT NULL),
b AS (SELECT *, i - (n - 1) / 2e0 AS kk, (entry_ap - tip_ap) / len AS pa, (entry_ml - tip_ml) / len AS pm, (entry_dv - tip_dv) / len AS pd FROM a),
c AS (SELECT probe, avg(pa) AS ua, avg(pm) AS um, avg(pd) AS ud, avg(entry_ap) AS ca, avg(entry_ml) AS cm, avg(entry_dv) AS cd FROM b GROUP BY 1),
c2 AS (SELECT probe, ca, cm, cd, ua / z AS ua, um / z AS um, ud / z AS ud FROM (SELECT *, sqrt(ua * ua + um * um + ud * ud) + 1e-12 AS z FROM c) q),
d AS (SELECT b.*, c2.* EXCLUDE (probe), ((ca - entry_ap) * ua + (cm - entry_ml) * um + (cd - entry_dv) * ud) / greatest(pa * ua + pm * um + pd * ud, 1e-6) AS st FROM b JOIN c2 USING (probe)),
e AS (SELECT *, entry_ap + st * pa AS la, entry_ml + st * pm AS lm, entry_dv + st * pd AS ld FROM d), g AS (SELECT probe, avg(la) AS ma, avg(lm) AS mm, avg(ld) AS md FROM e GROUP BY 1),
h AS (SELECT e.*, g.* EXCLUDE (probe), (la - ma) * ua + (lm - mm) * um + (ld - md) * ud AS fu FROM e JOIN g USING (probe)),
r AS (SELECT probe, sum(kk * (la - ma - fu * ua)) AS ra, sum(kk * (lm - mm - fu * um)) AS rm, sum(kk * (ld - md - fu * ud)) AS rd, max(ua) AS ua, max(um) AS um, max(ud) AS ud FROM h GROUP BY 1),
r2 AS (SELECT probe, ra - (ra * ua + rm * um + rd * ud) * ua AS ra, rm - (ra * ua + rm * um + rd * ud) * um AS rm, rd - (ra * ua + rm * um + rd * ud) * ud AS rd FROM r),
r3 AS (SELECT probe, ra / z AS ra, rm / z AS rm, rd / z AS rd FROM (SELECT *, sqrt(ra * ra + rm * rm + rd * rd) + 1e-12 AS z FROM r2) q),
s AS (SELECT h.*, CASE WHEN n >= 3 THEN 0.75 * (ma + kk * 250 * ra - la) ELSE 0 END AS sa, CASE WHEN n >= 3 THEN 0.75 * (mm + kk * 250 * rm - lm) ELSE 0 END AS sm, CASE WHEN n >= 3 THEN 0.75 * (md + kk * 250 * rd - ld) ELSE 0 END AS sd FROM h JOIN r3 USING (probe))"""


@query("a18_fit_rigid_array", f"""WITH {_RIGID_SQL.strip()}
SELECT k, round(tip_ap + sa, 5) + 0e0 AS tip_ap, round(tip_ml + sm, 5) + 0e0 AS tip_ml, round(tip_dv + sd, 5) + 0e0 AS tip_dv, round(entry_ap + sa, 5) + 0e0 AS entry_ap, round(entry_ml + sm, 5) + 0e0 AS entry_ml, round(entry_dv + sd, 5) + 0e0 AS entry_dv,
  round(max(sqrt(sa * sa + sm * sm + sd * sd)) OVER (PARTITION BY probe), 5) + 0e0 AS max_shift_um FROM s""")
def _a18(t):
    out = T.fit_rigid_array(t.b_shanks, "probe")
    return G.rounded(out.select("k", *_T, *_E, "max_shift_um"), 5)


@query("a16_line_fit")
def _a16(t):
    return G.rounded(T.line_fit(t.b_track_points, ["k"], robust=False), 4)


@query("a17_robust_line_fit")
def _a17(t):
    return G.rounded(T.line_fit(t.b_track_points, ["k"]), 4)


@query("j10_match_boundaries")
def _j10(t):
    from voxelkeel.operators import regions as R
    edges = R.candidate_boundaries(bands(t), ["k", "probe", "shank"]).select("probe", "shank", F.col("boundary_um").alias("atlas_um"), F.concat_ws("|", "above", "below").alias("label"))
    return G.rounded(T.match_boundaries(edges, t.sql(EVIDENCE), ["probe", "shank"]))


# Arrays that lie along the given axis, off the voxel planes by a fraction, so that both engines floor alike.
_PARALLEL = """SELECT probe, shank, tip_ap, tip_ml, tip_dv, tip_ap - len * 0.6e0 AS entry_ap, tip_ml AS entry_ml, tip_dv - len * 0.8e0 AS entry_dv
FROM (SELECT probe, shank, tip_ap + 0.123e0 AS tip_ap, tip_ml + 0.377e0 AS tip_ml, tip_dv + 0.219e0 AS tip_dv, 2500.017e0 + (probe * 31) % 1500 AS len FROM b_shanks WHERE tip_ap IS NOT NULL) p"""
_GRID_CAND = f"""SELECT *, c AS cand, (CAST(floor(c / 15) AS INT) - 1) * 5e0 AS tilt_deg, (CAST(floor(c / 5) AS INT) % 3 - 1) * 5e0 AS roll_deg, (c % 5 - 2) * 100e0 AS offset_um
FROM (SELECT *, SEQ[0;44] AS c FROM ({_PARALLEL}) s) q UNION ALL SELECT *, -1 AS c, -1 AS cand, 0e0 AS tilt_deg, 0e0 AS roll_deg, 0e0 AS offset_um FROM ({_PARALLEL}) s"""


@query("a30_placement_score", f"""WITH RECURSIVE {_move_sql(_GRID_CAND, _PARALLEL).strip()},
n AS (SELECT probe FROM ({_PARALLEL}) q GROUP BY 1 HAVING count(*) >= 2),
tr AS (SELECT *, sqrt((tip_ap - entry_ap) ** 2 + (tip_ml - entry_ml) ** 2 + (tip_dv - entry_dv) ** 2) AS track FROM mv WHERE probe IN (FROM n)),
sm AS (SELECT *, -600 + i * 15e0 AS d FROM (SELECT *, unnest(range(0, CAST(ceil((track + 1215) / 15) AS BIGINT))) AS i FROM tr) q),
rg AS (SELECT probe, cand, shank, track, d, coalesce(st.acronym, '') AS region FROM (
  SELECT *, floor((entry_ap + d * (tip_ap - entry_ap) / track) / 250) AS ia, floor((entry_dv + d * (tip_dv - entry_dv) / track) / 250) AS id, floor((entry_ml + d * (tip_ml - entry_ml) / track) / 250) AS im FROM sm) p
  LEFT JOIN (SELECT * FROM b_annotation WHERE structure_id > 0) v ON v.i_ap = ia AND v.i_dv = id AND v.i_ml = im LEFT JOIN b_structures st ON st.id = v.structure_id),
ru AS (SELECT *, sum(st) OVER (PARTITION BY probe, cand, shank ORDER BY d) AS band FROM (SELECT *, CASE WHEN lag(region) OVER w IS DISTINCT FROM region THEN 1 ELSE 0 END AS st, lag(d) OVER w AS pd, lead(d) OVER w AS nd FROM rg WINDOW w AS (PARTITION BY probe, cand, shank ORDER BY d)) q),
bd AS (SELECT probe, cand, shank, any_value(track) AS track, band, any_value(region) AS region, coalesce((min(d) + arg_min_null(pd, d)) / 2, min(d)) AS top, coalesce((max(d) + arg_max_null(nd, d)) / 2, max(d)) AS bottom FROM ru GROUP BY probe, cand, shank, band),
ed AS (SELECT probe, cand, shank, track - bottom AS a, row_number() OVER (PARTITION BY probe, cand, shank ORDER BY bottom DESC) AS j FROM (
  SELECT *, lead(region) OVER w AS below, lead(bottom - top) OVER w AS nt FROM bd WINDOW w AS (PARTITION BY probe, cand, shank ORDER BY band)) q
  WHERE region <> '' AND below <> '' AND bottom - top >= 150 AND nt >= 150),
ev AS (SELECT probe, shank, depth_from_tip_um AS f, weight AS w, row_number() OVER (PARTITION BY probe, shank ORDER BY depth_from_tip_um, weight) AS i FROM ({EVIDENCE}) q),
ga AS (SELECT e.probe, cand, e.shank, i, j, w * exp(-0.5 * ((f - a) / 120) ** 2) AS g FROM ed e JOIN ev ON ev.probe = e.probe AND ev.shank = e.shank WHERE abs(f - a) <= 350),
dp(probe, cand, shank, i, j, total) AS (
  SELECT probe, cand, shank, 0::BIGINT, 0::BIGINT, 0e0 FROM tr
  UNION ALL
  SELECT probe, cand, shank, i, j, max(total) FROM (
    SELECT p.probe, p.cand, p.shank, p.i + 1 AS i, unnest([p.j, g.j]) AS j, unnest([p.total, p.total + g.g]) AS total
    FROM dp p LEFT JOIN ga g ON g.probe = p.probe AND g.cand = p.cand AND g.shank = p.shank AND g.i = p.i + 1 AND g.j > p.j WHERE p.i < 4) q
  WHERE j IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
sc AS (SELECT probe, cand, shank, max(total) AS gain FROM dp GROUP BY 1, 2, 3), we AS (SELECT probe, shank, sum(w) AS w FROM ev GROUP BY 1, 2)
SELECT sc.probe, CAST(cand AS BIGINT) AS cand, round(sum(gain) / sum(w), 5) + 0e0 AS explained, round(sum(w), 5) + 0e0 AS total_weight FROM sc JOIN we ON we.probe = sc.probe AND we.shank = sc.shank GROUP BY 1, 2""")
def _a30(t):
    shanks = t.sql(_PARALLEL)
    scores = T.score_placements(shanks, t.sql(EVIDENCE), t.b_annotation, t.b_structures, T.same_grid(shanks, **GRID), resolution_um=RES, pose=t.sql(_AXES))
    return G.rounded(T.placement_score(scores, ["probe", "cand"]).select("probe", "cand", "explained", "total_weight"), 5)


@query("a30_full_grid")
def _a30_full(t):
    shanks = _placed(t)
    scores = T.score_placements(shanks, t.sql(EVIDENCE), t.b_annotation, t.b_structures, T.same_grid(shanks, **T.FULL_GRID), resolution_um=RES)
    return G.rounded(T.best_placement(T.placement_score(scores, ["probe", "cand", *T._PARAMS])), 5)


@query("a30_residuals")
def _a30_residuals(t):
    moves = t.b_shanks.select("probe").distinct().selectExpr("probe", "explode(array(-1L, 0L)) AS cand", "0D AS roll_deg", "0D AS tilt_deg").withColumn("offset_um", F.expr("CASE WHEN cand = 0 THEN 50D ELSE 0D END"))
    matches = T.placement_matches(_placed(t), moves, t.sql(EVIDENCE), t.b_annotation, t.b_structures, resolution_um=RES)
    return G.rounded(T.residuals(matches, ["probe", "cand"]), 5)


@query("a30_unsearched_probes", f"""
WITH n AS (SELECT probe, count(entry_ap) AS n_shanks FROM b_shanks WHERE tip_ap IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT probe FROM ({EVIDENCE}) q WHERE probe % 7 <> 2)
SELECT probe, n_shanks, CASE WHEN n_shanks < 2 THEN 'fewer than two placed shanks' ELSE 'no detected boundaries' END AS reason FROM n LEFT JOIN e USING (probe) WHERE n_shanks < 2 OR e.probe IS NULL""")
def _a30b(t):
    return T.unsearched_probes(_placed(t), t.sql(EVIDENCE).filter("probe % 7 <> 2"))


@query("a31_fit_trajectory")
def _a31(t):
    best, lines = _fit(t)
    return G.rounded(best.join(T.scan_parameters(lines), "probe"), 5)


# Scores along a parameter, by a rule that both engines can state.
_LINES = """SELECT probe, 'roll_deg' AS part, shank, 0e0 AS offset_um, (c - 6) * 2.5e0 AS roll_deg, 0e0 AS tilt_deg, ((k * 7 + c * (3 + k % 4)) % 23) / 23e0 * (1 + shank) AS gain, 1e0 + shank AS weight, 1 AS matched, 2 AS available
FROM (SELECT *, SEQ[0;12] AS c FROM b_shanks WHERE tip_ap IS NOT NULL) q"""


@query("a31_scan_parameters", f"""
WITH s AS (SELECT probe, roll_deg AS v, sum(gain) / sum(weight) AS e FROM ({_LINES}) q GROUP BY 1, 2),
d AS (SELECT *, abs(e - lag(e) OVER w) AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY probe) AS n FROM s WINDOW w AS (PARTITION BY probe ORDER BY v)),
a AS (SELECT probe, max(n) AS n, max(e) AS p, min(e) AS q, median(e) AS m, median(d) AS r, arg_max(v, (e, -i)) AS v, arg_max(i, (e, -i)) AS i FROM d GROUP BY 1)
SELECT probe, 'roll_deg' AS parameter, round(v, 5) + 0e0 AS best_value, i = 1 OR i = n AS at_edge, round(CASE WHEN p > 0 THEN (p - m) / p ELSE 0 END, 5) + 0e0 AS contrast,
  round(CASE WHEN n >= 3 AND p > q THEN r / (p - q) ELSE 0 END, 5) + 0e0 AS roughness,
  NOT (i = 1 OR i = n) AND CASE WHEN p > 0 THEN (p - m) / p ELSE 0 END >= 0.25 AND CASE WHEN n >= 3 AND p > q THEN r / (p - q) ELSE 0 END <= 0.12 AS identifiable FROM a""")
def _a31_scan(t):
    return G.rounded(T.scan_parameters(t.sql(_LINES)), 5)


@query("a32_leave_one_out", f"""
WITH l AS (SELECT probe, shank, roll_deg AS v, gain, weight FROM ({_LINES}) q), h AS (SELECT probe, shank AS held, max(weight) AS w FROM l GROUP BY 1, 2),
n AS (SELECT probe, count(*) AS n, sum(w) AS total FROM h GROUP BY 1),
f AS (SELECT probe, arg_max(v, (e, -v)) AS full_value FROM (SELECT probe, v, sum(gain) / sum(weight) AS e FROM l GROUP BY 1, 2) q GROUP BY 1),
r AS (SELECT probe, held, arg_max(v, (e, -v)) AS best FROM (SELECT l.probe, held, v, sum(gain) / sum(weight) AS e FROM l JOIN h ON h.probe = l.probe AND h.held <> l.shank JOIN n ON n.probe = l.probe AND n.n >= 3 GROUP BY 1, 2, 3) q GROUP BY 1, 2),
o AS (SELECT r.probe, full_value, count(*) AS n_held, max(best) - min(best) AS spread, max(abs(best - full_value)) AS influence, arg_max(r.held, (abs(best - full_value), -r.held)) AS dominant, arg_max(w / total, (abs(best - full_value), -r.held)) AS share
  FROM r JOIN f ON f.probe = r.probe JOIN h ON h.probe = r.probe AND h.held = r.held JOIN n ON n.probe = r.probe GROUP BY 1, 2)
SELECT probe, round(full_value, 5) + 0e0 AS "full", n_held, round(spread, 5) + 0e0 AS spread, round(influence, 5) + 0e0 AS max_influence, dominant AS dominant_shank, round(share, 5) + 0e0 AS weight_share,
  n_held >= 3 AND spread <= 5 AND influence <= 5 AS stable FROM o""")
def _a32(t):
    return G.rounded(T.leave_one_out(t.sql(_LINES), "roll_deg", tolerance=5.0), 5)


@query("a32_leave_one_out_of_fit")
def _a32_fit(t):
    return G.rounded(T.leave_one_out(_fit(t)[1], "roll_deg", tolerance=5.0), 5)


@query("a34_profile_score")
def _a34(t):
    edges = T.atlas_edges(_placed(t).select("probe", "shank", *_T, *_E), t.b_annotation, t.b_structures, ["probe", "shank"], resolution_um=RES, margin_um=1200.0, step_um=20.0)
    vectors = t.embeddings.count()
    profiles = t.sql(f"SELECT s.probe, s.shank, e.depth_um, e.value AS score FROM b_shanks s JOIN (SELECT vec_id, (i - 1) * 60e0 AS depth_um, abs(CAST(AT[embedding;i] AS DOUBLE)) * 10 AS value FROM (SELECT vec_id, embedding, SEQ[1;64] AS i FROM embeddings) q) e ON e.vec_id = s.k % {vectors}")
    return G.rounded(T.profile_score(edges, profiles, ["probe", "shank"]), 5)


@query("j09_propose_landmarks")
def _j09(t):
    rows = t.sql("""SELECT vec_id AS k, transform(sequence(0, 4), i -> 150D + i * 220 + (vec_id * 13 + i * 7) % 60) AS track,
      transform(sequence(0, 63), i -> i * 20D) AS grid, transform(embedding, e -> abs(CAST(e AS DOUBLE)) * 12) AS score FROM embeddings""")
    return G.rounded(T.propose_landmarks(rows))
