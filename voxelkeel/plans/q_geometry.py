"""Queries over coordinate frames, planes and section pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.operators import sections as S
from voxelkeel.plans.registry import query

_NINE = "ARR[ox, oy, oz, ux, uy, uz, vx, vy, vz]"
PLANES = f"""
SELECT *, CASE WHEN has_reg THEN {_NINE} END AS reg_anchoring,
  CASE WHEN has_ds THEN ARR[ox + 1, oy, oz, ux, uy, uz, vx, vy, vz] END AS ds_anchoring
FROM b_sections"""


def planes(t):
    return t.sql(PLANES)


def _spread(df, column: str, keep: list[str]):
    """One scalar column per element, so results compare element by element."""
    return df.select(*keep, *[F.element_at(column, i + 1).alias(f"a{i}") for i in range(9)])


def _spread_sql(expr: str, keep: str, source: str) -> str:
    cols = ", ".join(f"round(a[{i + 1}], 6) + 0e0 AS a{i}" for i in range(9))
    return f"SELECT {keep}, {cols} FROM (SELECT *, {expr} AS a FROM ({source}) s0) s1"


@query("p01_ccf_to_paxinos", """
SELECT pos, alignment, round(-((a * cos(p) - d * sin(p)) * sap) / 1000, 6) + 0e0 AS ap_mm,
  round(-((ml_um - 5700) * sml) / 1000, 6) + 0e0 AS ml_mm,
  round(((a * sin(p) + d * cos(p)) * sdv) / 1000, 6) + 0e0 AS dv_mm
FROM (SELECT pos, alignment, ml_um, ap_um - 5400 AS a, dv_um - bdv AS d, radians(pitch) AS p, sap, sml, sdv
  FROM (SELECT *, CASE pos % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'allen_forum' WHEN 2 THEN 'qiu2018' ELSE 'dorr2008' END AS alignment FROM b_cells) c
  JOIN (VALUES ('none', 0e0, 1e0, 1e0, 1e0, 0e0), ('allen_forum', 5e0, 1e0, 1e0, 0.9434e0, 440e0),
    ('qiu2018', 5e0, 1.031e0, 0.952e0, 0.885e0, 440e0), ('dorr2008', 5e0, 1.087e0, 1e0, 0.952e0, 440e0))
    v(name, pitch, sap, sml, sdv, bdv) ON v.name = c.alignment) q""")
def _p01(t):
    cells = t.sql("SELECT *, CASE pos % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'allen_forum' WHEN 2 THEN 'qiu2018' ELSE 'dorr2008' END AS alignment FROM b_cells")
    out = G.to_paxinos(cells, F.col("alignment"))
    return G.rounded(out.select("pos", "alignment", "ap_mm", "ml_mm", "dv_mm"))


@query("p02_relative_to_ccf", """
SELECT pos, 6600 - ap_um AS ccf_ap_um, 5700 - ml_um AS ccf_ml_um, dv_um AS ccf_dv_um FROM b_cells""")
def _p02(t):
    out = G.relative_to_ccf(t.b_cells, "ap_um", "ml_um", "dv_um")
    return out.select("pos", "ccf_ap_um", "ccf_ml_um", "ccf_dv_um")


_ATLAS_NAME = """CASE {k} % 6 WHEN 0 THEN ' Allen_Mouse_25um' WHEN 1 THEN 'kim_mouse_25um' WHEN 2 THEN 'kim_mouse_isotropic_20um'
  WHEN 3 THEN 'ccfv3augmented_mouse_25um' WHEN 4 THEN 'whs_sd_rat_39um' ELSE NULL END"""


@query("p03_bregma_anchor", f"""
WITH named AS (SELECT k, {_ATLAS_NAME.format(k='k')} AS atlas FROM b_sections),
anchors AS (SELECT * FROM (VALUES ('allen_mouse', 5400e0), ('kim_mouse', 5400e0), ('kim_mouse_isotropic', 5502e0), ('ccfv3augmented_mouse', 5746e0)) v(prefix, ap))
SELECT k, atlas, max(ap_best) AS bregma_ap, coalesce(max(ap_best), 5400e0) AS bregma_display
FROM (SELECT k, atlas, arg_max(ap, length(prefix)) OVER (PARTITION BY k) AS ap_best
  FROM named LEFT JOIN anchors ON starts_with(lower(trim(atlas)), prefix)) q GROUP BY k, atlas""")
def _p03(t):
    named = t.sql(f"SELECT k, {_ATLAS_NAME.format(k='k')} AS atlas FROM b_sections")
    return named.select("k", "atlas", G.bregma_ap(F.col("atlas")).alias("bregma_ap"),
                        G.bregma_ap_for_display(F.col("atlas")).alias("bregma_display"))


@query("p04_atlas_extents", """
SELECT (max(i_ap) + 1) * 250e0 AS ap_extent_um, (max(i_dv) + 1) * 250e0 AS dv_extent_um,
  (max(i_ml) + 1) * 250e0 AS ml_extent_um, (max(i_ml) + 1) * 125e0 AS midline_um FROM b_annotation""")
def _p04(t):
    return G.atlas_extents(t.b_annotation, 250.0)


_HERBS = """SELECT pos, project_id, l_ap AS vox_ap, ml_um / CASE WHEN project_id % 2 = 0 THEN 10 ELSE 25 END AS vox_ml,
  dv_um / 25 AS vox_dv FROM (SELECT *, ap_um / CASE WHEN project_id % 2 = 0 THEN 10 ELSE 25 END AS l_ap FROM b_cells) q"""


@query("p05_herbs_voxels", f"""
WITH v AS ({_HERBS}), g AS (SELECT project_id, CASE WHEN max(vox_ap) > 800 OR max(vox_ml) > 700 THEN 10 ELSE 25 END AS grid_um FROM v GROUP BY project_id),
c AS (SELECT v.pos, v.project_id, g.grid_um, (floor(13200e0 / grid_um) - 1 - vox_ap) * grid_um AS ap, (floor(11400e0 / grid_um) - 1 - vox_ml) * grid_um AS ml, vox_dv * grid_um AS dv
  FROM v JOIN g USING (project_id))
SELECT pos, CAST(grid_um AS INT) AS grid_um, round(ap, 6) + 0e0 AS ap_um, round(ml, 6) + 0e0 AS ml_um, round(dv, 6) + 0e0 AS dv_um,
  round(floor(11400e0 / 25) - 1 - ml / 25, 6) + 0e0 AS vox_ml, round(floor(13200e0 / 25) - 1 - ap / 25, 6) + 0e0 AS vox_ap, round(dv / 25, 6) + 0e0 AS vox_dv FROM c""")
def _p05(t):
    v = t.sql(_HERBS)
    ccf = G.herbs_to_ccf(v.join(G.herbs_grid_um(v, ["project_id"]), "project_id"))
    back = G.ccf_to_herbs(ccf, 25)
    return G.rounded(back.select("pos", "grid_um", "ap_um", "ml_um", "dv_um", "vox_ml", "vox_ap", "vox_dv"))


@query("p06_display_frame", f"""
SELECT pos, 5700 - ml_um AS x_disp, CASE WHEN pos % 6 = 2 THEN 5502e0 WHEN pos % 6 = 3 THEN 5746e0 ELSE 5400e0 END - ap_um AS y_disp,
  -dv_um AS z_disp FROM b_cells""")
def _p06(t):
    cells = t.sql(f"SELECT *, {_ATLAS_NAME.format(k='pos')} AS atlas FROM b_cells")
    return G.to_display(cells, F.col("atlas")).select("pos", "x_disp", "y_disp", "z_disp")


@query("p07_quicknii_to_atlas", _spread_sql(
    "ARR[264 - oy * (264e0 / 528), 160 - oz * (160e0 / 320), 228 - ox * (228e0 / 456), -uy * (264e0 / 528), -uz * (160e0 / 320), -ux * (228e0 / 456), -vy * (264e0 / 528), -vz * (160e0 / 320), -vx * (228e0 / 456)]",
    "k", "SELECT * FROM b_sections"))
def _p07(t):
    df = t.sql(f"SELECT k, {_NINE} AS a FROM b_sections")
    return G.rounded(_spread(df.withColumn("q", G.quicknii_to_atlas(F.col("a"), (264, 160, 228))), "q", ["k"]))


@query("p08_rescale_anchoring", _spread_sql(
    "ARR[ox * (1320e0 / 528), oy * (800e0 / 320), oz * (1140e0 / 456), ux * (1320e0 / 528), uy * (800e0 / 320), uz * (1140e0 / 456), vx * (1320e0 / 528), vy * (800e0 / 320), vz * (1140e0 / 456)]",
    "k", "SELECT * FROM b_sections"))
def _p08(t):
    df = t.sql(f"SELECT k, {_NINE} AS a FROM b_sections")
    return G.rounded(_spread(df.withColumn("q", G.rescale_anchoring(F.col("a"), (528, 320, 456), (1320, 800, 1140))), "q", ["k"]))


_TILTED = "SELECT k, 3000e0 + section_index * 60 AS ap, k % 9 - 4e0 AS mt, k % 7 - 3e0 AS dt, CASE WHEN k % 3 = 0 THEN 'back' ELSE 'front' END AS seen FROM b_sections"


@query("p09_coronal_anchoring", """
WITH q AS (SELECT k, ap / 25 AS ai, seen, sin(radians(mt)) AS sm, cos(radians(mt)) AS cm, sin(radians(dt)) AS sd, cos(radians(dt)) AS cd FROM (""" + _TILTED + """) z),
w AS (SELECT k, seen, ai, -sm * 456 AS u0, 0e0 AS u1, cm * 456 AS u2, cm * (-sd * 320) AS v0, cd * 320 AS v1, sm * (-sd * 320) AS v2 FROM q),
o AS (SELECT *, ai - u0 / 2 - v0 / 2 AS o0, 160 - u1 / 2 - v1 / 2 AS o1, 228 - u2 / 2 - v2 / 2 AS o2 FROM w)
SELECT k, round(o0, 6) + 0e0 AS a0, round(o1, 6) + 0e0 AS a1, round(CASE WHEN seen = 'back' THEN 456 - o2 ELSE o2 END, 6) + 0e0 AS a2,
  round(u0, 6) + 0e0 AS a3, round(u1, 6) + 0e0 AS a4, round(CASE WHEN seen = 'back' THEN -u2 ELSE u2 END, 6) + 0e0 AS a5,
  round(v0, 6) + 0e0 AS a6, round(v1, 6) + 0e0 AS a7, round(CASE WHEN seen = 'back' THEN -v2 ELSE v2 END, 6) + 0e0 AS a8 FROM o""")
def _p09(t):
    df = t.sql(_TILTED)
    a = G.coronal_anchoring(F.col("ap"), F.col("mt"), F.col("dt"), F.col("seen"), (528, 320, 456), 25.0)
    return G.rounded(_spread(df.withColumn("q", a), "q", ["k"]))


@query("p10_anchoring_props", """
SELECT k, CASE WHEN uz >= 0 THEN 'front' ELSE 'back' END AS seen, round((ox + ux / 2 + vx / 2) * 25, 6) + 0e0 AS centre_ap_um,
  round(ox, 6) + 0e0 AS a0, round(oy, 6) + 0e0 AS a1, round(456 - oz, 6) + 0e0 AS a2, round(ux, 6) + 0e0 AS a3, round(uy, 6) + 0e0 AS a4,
  round(-uz, 6) + 0e0 AS a5, round(vx, 6) + 0e0 AS a6, round(vy, 6) + 0e0 AS a7, round(-vz, 6) + 0e0 AS a8 FROM b_sections""")
def _p10(t):
    df = t.sql(f"SELECT k, {_NINE} AS a FROM b_sections").withColumns({
        "seen": G.anchoring_view(F.col("a")), "centre_ap_um": G.anchoring_centre_ap(F.col("a")) * 25.0,
        "q": G.mirror_anchoring(F.col("a"), 456.0)})
    return G.rounded(_spread(df, "q", ["k", "seen", "centre_ap_um"]))


_PLANE_VALUES_SQL = """
p AS (SELECT *, CASE WHEN has_reg THEN ox WHEN has_ds THEN ox + 1 END AS qx, CASE WHEN has_reg THEN out_h ELSE y1 - y0 END AS hh,
    CASE WHEN has_reg THEN out_w ELSE x1 - x0 END AS ww FROM b_sections),
e AS (SELECT *, ux * 25 / ww AS p0, uy * 25 / ww AS p1, uz * 25 / ww AS p2, vx * 25 / hh AS q0, vy * 25 / hh AS q1, vz * 25 / hh AS q2 FROM p WHERE qx IS NOT NULL),
n AS (SELECT *, p1 * q2 - p2 * q1 AS n0, p2 * q0 - p0 * q2 AS n1, p0 * q1 - p1 * q0 AS n2 FROM e),
pv AS (SELECT project_id, section_index, ap_order, k, (qx + ux / 2 + vx / 2) * 25 AS plane_ap_um,
  degrees(atan2(CASE WHEN n0 < 0 THEN n1 ELSE -n1 END, abs(n0))) AS pitch_deg,
  degrees(atan2(CASE WHEN n0 < 0 THEN n2 ELSE -n2 END, abs(n0))) AS yaw_deg,
  degrees(atan2(p1, abs(p2))) AS rotation_deg_plane, sqrt(p0 * p0 + p1 * p1 + p2 * p2) AS scale_x,
  sqrt(q0 * q0 + q1 * q1 + q2 * q2) AS scale_y, uz < 0 AS mirrored FROM n)"""


@query("p11_plane_values", "WITH " + _PLANE_VALUES_SQL.strip() + """
SELECT s.k, round(plane_ap_um, 6) + 0e0 AS plane_ap_um, round(pitch_deg, 6) + 0e0 AS pitch_deg, round(yaw_deg, 6) + 0e0 AS yaw_deg,
  round(rotation_deg_plane, 6) + 0e0 AS rotation_deg_plane, round(scale_x, 6) + 0e0 AS scale_x, round(scale_y, 6) + 0e0 AS scale_y, mirrored
FROM b_sections s LEFT JOIN pv ON pv.k = s.k""")
def _p11(t):
    out = G.section_plane_values(planes(t))
    return G.rounded(out.select("k", "plane_ap_um", "pitch_deg", "yaw_deg", "rotation_deg_plane", "scale_x", "scale_y", "mirrored"))


@query("p12_section_rotation", """
SELECT k, round(CASE WHEN has_ds THEN degrees(atan2(uy, abs(uz))) END, 6) + 0e0 AS angle_deg,
  round(CASE WHEN has_ds THEN degrees(atan2(uy, abs(uz))) - rotation_deg ELSE 0 END, 6) + 0e0 AS residual_deg FROM b_sections""")
def _p12(t):
    df = planes(t)
    return G.rounded(df.select("k", G.section_rotation(F.col("ds_anchoring")).alias("angle_deg"),
                               G.straighten_angle(F.col("ds_anchoring"), F.col("rotation_deg")).alias("residual_deg")))


@query("p13_manual_pixel_to_ccf", """
SELECT pos, s.ap_um, round(5700 + CASE WHEN s.k % 2 = 0 THEN 1 ELSE -1 END * (x_px - 150) * 5, 6) + 0e0 AS ml_um,
  round((y_px - (s.k % 30)) * 5, 6) + 0e0 AS dv_um
FROM b_cells c JOIN b_sections s ON s.project_id = c.project_id AND s.section_index = c.section_index
WHERE s.ap_um IS NOT NULL AND x_px IS NOT NULL""")
def _p13(t):
    df = t.sql("""SELECT pos, s.ap_um AS plane_ap_um, x_px, y_px, 150e0 AS midline_px, s.k % 30 AS dorsal_px, 5e0 AS pixel_um, s.k % 2 = 0 AS image_right_is_right
      FROM b_cells c JOIN b_sections s ON s.project_id = c.project_id AND s.section_index = c.section_index
      WHERE s.ap_um IS NOT NULL AND x_px IS NOT NULL""")
    return G.rounded(G.manual_pixel_to_ccf(df).select("pos", "ap_um", "ml_um", "dv_um"))


_AFFINE = "1.05e0 + k % 3 * 0.01e0 AS m0, 0.02e0 * (k % 5 - 2) AS m1, k % 9 - 4e0 AS m2, 0.015e0 * (k % 7 - 3) AS m3, 0.97e0 AS m4, k % 6 - 3e0 AS m5"


@query("p14_registered_pixel_to_ccf", f"""
WITH j AS (SELECT c.pos, c.x_px AS x, c.y_px AS y, s.* FROM b_cells c JOIN (SELECT *, {_AFFINE} FROM b_sections) s
  ON s.project_id = c.project_id AND s.section_index = c.section_index WHERE s.has_reg AND c.x_px IS NOT NULL),
a AS (SELECT *, m0 * m4 - m1 * m3 AS det, y - m2 AS yr, x - m5 AS xr FROM j),
l AS (SELECT *, (m4 * yr - m1 * xr) / det AS yl, (m0 * xr - m3 * yr) / det AS xl FROM a)
SELECT pos, round((ox + xl / out_w * ux + yl / out_h * vx) * 25, 6) + 0e0 AS ap_um,
  round((oz + xl / out_w * uz + yl / out_h * vz) * 25, 6) + 0e0 AS ml_um,
  round((oy + xl / out_w * uy + yl / out_h * vy) * 25, 6) + 0e0 AS dv_um FROM l""")
def _p14(t):
    s = t.sql(f"SELECT *, {_NINE} AS reg_anchoring, {_AFFINE} FROM b_sections WHERE has_reg").drop("ap_um")
    c = t.sql("SELECT pos, project_id, section_index, x_px, y_px FROM b_cells WHERE x_px IS NOT NULL")
    j = c.join(s, ["project_id", "section_index"])
    x, y = G.affine_invert_apply([F.col(f"m{i}") for i in range(6)], F.col("x_px"), F.col("y_px"))
    out = G.registered_pixel_to_ccf(j.withColumns({"x_local": x, "y_local": y}))
    return G.rounded(out.select("pos", "ap_um", "ml_um", "dv_um"))


@query("p15_manual_affine", f"""
WITH s AS (SELECT k, y0, x0, CASE WHEN k % 4 = 0 THEN true ELSE false END AS ident, {_AFFINE} FROM b_sections),
a AS (SELECT k, y0, x0, CASE WHEN ident THEN 1e0 ELSE m0 END AS a, CASE WHEN ident THEN 0e0 ELSE m1 END AS b, CASE WHEN ident THEN 0e0 ELSE m2 END AS c,
  CASE WHEN ident THEN 0e0 ELSE m3 END AS d, CASE WHEN ident THEN 1e0 ELSE m4 END AS e, CASE WHEN ident THEN 0e0 ELSE m5 END AS f FROM s)
SELECT k, round(a * y0 + b * x0 + c - y0, 6) + 0e0 AS ty, round(d * y0 + e * x0 + f - x0, 6) + 0e0 AS tx,
  round((e * (33 - c) - b * (21 - f)) / (a * e - b * d), 6) + 0e0 AS row_px, round((a * (21 - f) - d * (33 - c)) / (a * e - b * d), 6) + 0e0 AS col_px,
  abs(a - 1) <= 1.1e-5 AND abs(b) <= 1e-6 AND abs(c) <= 1e-6 AND abs(d) <= 1e-6 AND abs(e - 1) <= 1.1e-5 AND abs(f) <= 1e-6 AS identity FROM a""")
def _p15(t):
    df = t.sql(f"SELECT k, y0, x0, {_AFFINE} FROM b_sections")
    unit = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    m = [F.when(F.col("k") % 4 == 0, F.lit(u)).otherwise(F.col(f"m{i}")) for i, u in enumerate(unit)]
    w = G.affine_world_to_section(m, F.col("y0"), F.col("x0"))
    col, row = G.affine_invert_apply(m, F.lit(21.0), F.lit(33.0))
    return G.rounded(df.select("k", w[2].alias("ty"), w[5].alias("tx"), row.alias("row_px"), col.alias("col_px"),
                               G.affine_is_identity(m).alias("identity")))


_SLICEREG = """SELECT k, k % 7 - 3e0 AS pitch_deg, k % 5 - 2e0 AS yaw_deg, 11400e0 AS plane_w_um, 8000e0 AS plane_h_um, 3000e0 + section_index * 60 AS ap_um,
  k % 11 - 5e0 AS rot_deg, 9e0 + k % 3 * 0.1e0 AS sx, 10e0 AS sy, k % 2 = 0 AS flip, k % 13 * 1e0 AS tx, k % 17 * 2e0 AS ty, 0.5e0 + k % 2 * 0.5e0 AS factor,
  out_w AS w, out_h AS h, 25e0 AS res_um FROM b_sections"""


@query("p20_slicereg_anchoring", f"""
WITH s AS ({_SLICEREG}),
r AS (SELECT *, radians(pitch_deg) AS p, radians(yaw_deg) AS y, radians(rot_deg) AS th, CASE WHEN flip THEN -1e0 ELSE 1e0 END AS fx FROM s),
b AS (SELECT *, sin(y) AS u0, 0e0 AS u1, cos(y) AS u2, cos(y) * sin(p) AS v0, cos(p) AS v1, -sin(y) * sin(p) AS v2,
  cos(th) * sx * fx AS ma, -sin(th) * sy AS mb, sin(th) * sx * fx AS mc, cos(th) * sy AS md FROM r),
o AS (SELECT *, ap_um - plane_w_um / 2 * u0 - plane_h_um / 2 * v0 AS o0, plane_h_um / 2 - plane_w_um / 2 * u1 - plane_h_um / 2 * v1 AS o1,
  plane_w_um / 2 - plane_w_um / 2 * u2 - plane_h_um / 2 * v2 AS o2 FROM b),
c AS (SELECT *, corner, (CASE WHEN corner = 1 THEN w ELSE 0 END + 0.5e0) / factor - 0.5e0 - tx AS px, (CASE WHEN corner = 2 THEN h ELSE 0 END + 0.5e0) / factor - 0.5e0 - ty AS py
  FROM o, (VALUES (0), (1), (2)) v(corner)),
st AS (SELECT *, (md * px - mb * py) / (ma * md - mb * mc) + plane_w_um / 2 AS s_, (ma * py - mc * px) / (ma * md - mb * mc) + plane_h_um / 2 AS t_ FROM c),
x AS (SELECT k, corner, (o0 + s_ * u0 + t_ * v0) / 25 AS x0, (o1 + s_ * u1 + t_ * v1) / 25 AS x1, (o2 + s_ * u2 + t_ * v2) / 25 AS x2 FROM st),
z AS (SELECT k, max(x0) FILTER (corner = 0) AS a0, max(x1) FILTER (corner = 0) AS a1, max(x2) FILTER (corner = 0) AS a2,
  max(x0) FILTER (corner = 1) AS b0, max(x1) FILTER (corner = 1) AS b1, max(x2) FILTER (corner = 1) AS b2,
  max(x0) FILTER (corner = 2) AS c0, max(x1) FILTER (corner = 2) AS c1, max(x2) FILTER (corner = 2) AS c2 FROM x GROUP BY k)
SELECT k, round(a0, 6) + 0e0 AS a0, round(a1, 6) + 0e0 AS a1, round(a2, 6) + 0e0 AS a2, round(b0 - a0, 6) + 0e0 AS a3, round(b1 - a1, 6) + 0e0 AS a4, round(b2 - a2, 6) + 0e0 AS a5,
  round(c0 - a0, 6) + 0e0 AS a6, round(c1 - a1, 6) + 0e0 AS a7, round(c2 - a2, 6) + 0e0 AS a8 FROM z""")
def _p20(t):
    return G.rounded(_spread(G.slicereg_anchoring(t.sql(_SLICEREG)), "anchoring", ["k"]))


_VIEW_SQL = """
pl AS (SELECT *, CASE WHEN uz >= 0 THEN 'front' ELSE 'back' END AS seen, has_reg OR has_ds AS placed FROM b_sections),
vw AS (SELECT project_id, max(seen_from) AS stated, count(*) FILTER (placed AND seen = 'back') AS n_back, count(*) FILTER (placed AND seen = 'front') AS n_front FROM pl GROUP BY project_id),
pv AS (SELECT project_id, n_back, n_front, coalesce(stated, CASE WHEN n_back > n_front THEN 'back' WHEN n_back + n_front > 0 THEN 'front' END, 'front') AS proj_view FROM vw)"""


@query("a21_project_view", "WITH " + _VIEW_SQL.strip() + """
SELECT pv.project_id, proj_view, CAST(n_front AS BIGINT) AS n_front, CAST(n_back AS BIGINT) AS n_back, section_index AS disagreeing_section
FROM pv LEFT JOIN (SELECT * FROM pl WHERE placed) p ON p.project_id = pv.project_id AND p.seen <> pv.proj_view""")
def _a21(t):
    return S.disagreeing_sections(planes(t)).select("project_id", "proj_view", "n_front", "n_back", "disagreeing_section")


@query("p36_mirror_planes", "WITH " + _VIEW_SQL.strip() + """
SELECT p.project_id, p.section_index, p.placed AND p.seen <> 'front' AS was_mirrored,
  round(CASE WHEN has_reg THEN CASE WHEN p.seen <> 'front' THEN 456 - oz ELSE oz END END, 6) + 0e0 AS reg_oz,
  round(CASE WHEN has_ds THEN CASE WHEN p.seen <> 'front' THEN -uz ELSE uz END END, 6) + 0e0 AS ds_uz
FROM pl p""")
def _p36(t):
    out = S.mirror_planes(planes(t), "front", atlas_ml_um=11400.0)
    return G.rounded(out.select("project_id", "section_index", "was_mirrored",
                                F.element_at("reg_anchoring", 3).alias("reg_oz"), F.element_at("ds_anchoring", 6).alias("ds_uz")))


@query("p37_slide_position", """
SELECT pos, slide_idx, round(x0 + x_px, 6) + 0e0 AS slide_x, round(y0 + y_px, 6) + 0e0 AS slide_y
FROM b_cells c JOIN b_sections s ON s.project_id = c.project_id AND s.section_index = c.section_index WHERE x_px IS NOT NULL AND y_px IS NOT NULL""")
def _p37(t):
    out = S.slide_position(t.b_cells, t.b_sections)
    return G.rounded(out.select("pos", "slide_idx", "slide_x", "slide_y"))


_PICKS = """SELECT o_orderkey AS pick, CAST(floor(o_custkey / 100) AS BIGINT) AS project_id, (o_custkey % 100) % 97 AS section_index
FROM orders"""


@query("j06_section_lookup", f"""
SELECT pick, project_id, section_index, slide_idx, x0, y0, has_transform FROM (
  SELECT q.pick, q.project_id, q.section_index, s.slide_idx, s.x0, s.y0, s.has_reg AS has_transform,
    row_number() OVER (PARTITION BY q.pick ORDER BY s.slide_idx, s.k) AS rn
  FROM ({_PICKS}) q LEFT JOIN b_sections s ON s.project_id = q.project_id AND s.section_index % 97 = q.section_index) z WHERE rn = 1""")
def _j06(t):
    sections = t.sql("SELECT project_id, section_index % 97 AS section_index, slide_idx, k AS position, x0, y0, has_reg AS has_transform FROM b_sections")
    out = S.section_lookup(t.sql(_PICKS), sections)
    return out.select("pick", "project_id", "section_index", "slide_idx", "x0", "y0", "has_transform")
