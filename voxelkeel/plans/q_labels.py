"""Queries over pixels, voxels, masks and displacement fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.operators import labels as L
from voxelkeel.plans.q_series import BOXES, SLIDE
from voxelkeel.plans.registry import query

SHAPE = (52, 32, 46)
# Planes of sections on the 250 um grid, small enough to sample every pixel.
_PLANES = """SELECT k AS section, 12 AS out_w, 8 AS out_h, 9 AS sec_w, 7 AS sec_h,
  ARR[ox / 10, oy / 10 - 2, CASE WHEN uz > 0 THEN -1e0 ELSE 46e0 END, ux / 10, uy / 10, uz / 10, vx / 10, vy / 9, vz / 10] AS anchoring FROM b_sections"""
_VOX_SQL = f"""
px AS (SELECT section, out_w, out_h, anchoring AS a, x, unnest(generate_series(0, out_h - 1)) AS y FROM (SELECT *, unnest(generate_series(0, out_w - 1)) AS x FROM ({_PLANES}) p) q),
vx AS (SELECT section, x, y, a[1] + x / out_w * a[4] + y / out_h * a[7] AS va, a[2] + x / out_w * a[5] + y / out_h * a[8] AS vd, a[3] + x / out_w * a[6] + y / out_h * a[9] AS vm FROM px)"""
_IN = "va >= 0 AND va <= 51 AND vd >= 0 AND vd <= 31 AND vm >= 0 AND vm <= 45"
_LAB_SQL = f"""{_VOX_SQL.strip()},
lab AS (SELECT section, x, y, coalesce(s.structure_id, 0) AS region_id FROM vx LEFT JOIN b_annotation s ON {_IN} AND s.i_ap = floor(va + 0.5) AND s.i_dv = floor(vd + 0.5) AND s.i_ml = floor(vm + 0.5))"""


@query("j12_sample_plane", f"WITH {_LAB_SQL} SELECT section, CAST(x AS INT) AS x, CAST(y AS INT) AS y, region_id FROM lab")
def _j12(t):
    vox = L.plane_voxels(L.plane_pixels(t.sql(_PLANES)))
    return L.sample_labels(vox, t.b_annotation, SHAPE).select("section", "x", "y", "region_id")


@query("j12_sample_intensity", f"""WITH {_VOX_SQL.strip()},
c AS (SELECT section, x, y, va, vd, vm, a, d, m FROM vx, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(d), (VALUES (0), (1)) r(m) WHERE {_IN}),
w AS (SELECT *, CASE WHEN a = 1 THEN va - floor(va) ELSE 1 - va + floor(va) END * CASE WHEN d = 1 THEN vd - floor(vd) ELSE 1 - vd + floor(vd) END * CASE WHEN m = 1 THEN vm - floor(vm) ELSE 1 - vm + floor(vm) END AS w FROM c),
s AS (SELECT w.section, w.x, w.y, sum(w * (structure_id * 1.5e0)) AS t FROM w JOIN b_annotation v ON v.i_ap = floor(va) + a AND v.i_dv = floor(vd) + d AND v.i_ml = floor(vm) + m GROUP BY 1, 2, 3)
SELECT vx.section, CAST(vx.x AS INT) AS x, CAST(vx.y AS INT) AS y, round(coalesce(t, 0), 11) + 0e0 AS intensity FROM vx LEFT JOIN s USING (section, x, y)""")
def _j12b(t):
    vox = L.plane_voxels(L.plane_pixels(t.sql(_PLANES)))
    volume = t.b_annotation.withColumn("value", F.col("structure_id") * 1.5)
    return G.rounded(L.sample_intensity(vox, volume, ["section", "x", "y"], SHAPE).select("section", "x", "y", "intensity"), 11)


@query("j13_section_labels", f"""WITH {_LAB_SQL},
sp AS (SELECT section, sx, unnest(generate_series(0, 6)) AS sy FROM (SELECT section, unnest(generate_series(0, 8)) AS sx FROM ({_PLANES}) p) q)
SELECT sp.section, CAST(sx AS INT) AS sx, CAST(sy AS INT) AS sy, region_id FROM sp JOIN lab ON lab.section = sp.section AND lab.x = round_even(sx * 11 / 8e0, 0) AND lab.y = round_even(sy * 7 / 6e0, 0)""")
def _j13(t):
    vox = L.plane_voxels(L.resize_nearest(t.sql(_PLANES)))
    return L.sample_labels(vox, t.b_annotation, SHAPE).select("section", "sx", "sy", "region_id")


_POINTS = "SELECT k AS pid, k AS section, k % 34 - 2e0 AS x_px, (k * 7 % 31) * 1.1e0 - 1 AS y_px FROM b_sections"


@query("p18_field_warp_points", f"""
WITH f AS (SELECT *, least(greatest(x_px / 4, 0), 7) AS fx, least(greatest(y_px / 4, 0), 7) AS fy FROM ({_POINTS}) p), g AS (SELECT *, least(floor(fx), 6) AS x0, least(floor(fy), 6) AS y0 FROM f)
SELECT pid, g.section, round(x_px + sum(w * dx), 9) + 0e0 AS x_warped, round(y_px + sum(w * dy), 9) + 0e0 AS y_warped
FROM (SELECT g.*, x0 + i AS cx, y0 + j AS cy, CASE WHEN i = 1 THEN fx - x0 ELSE 1 - fx + x0 END * CASE WHEN j = 1 THEN fy - y0 ELSE 1 - fy + y0 END AS w FROM g, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) g
JOIN b_field v ON v.section = g.section AND v.gx = cx AND v.gy = cy GROUP BY pid, g.section, x_px, y_px""")
def _p18(t):
    return G.rounded(L.field_warp_points(t.sql(_POINTS), t.b_field, step=4.0, nx=8, ny=8), 9)


# Some sections without a field, and fields with holes.
_HOLES = "SELECT * FROM b_field WHERE section % 6 <> 1 AND (section % 3 <> 2 OR (gx + gy * 3 + section) % 4 <> 0)"


@query("p18_field_with_holes", f"""
WITH f AS (SELECT *, least(greatest(x_px / 4, 0), 7) AS fx, least(greatest(y_px / 4, 0), 7) AS fy FROM ({_POINTS}) p), g AS (SELECT *, least(floor(fx), 6) AS x0, least(floor(fy), 6) AS y0 FROM f),
h AS (SELECT pid, sum(w) AS w, sum(w * dx) AS dx, sum(w * dy) AS dy FROM (SELECT g.*, x0 + i AS cx, y0 + j AS cy, CASE WHEN i = 1 THEN fx - x0 ELSE 1 - fx + x0 END * CASE WHEN j = 1 THEN fy - y0 ELSE 1 - fy + y0 END AS w FROM g, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) g
  JOIN ({_HOLES}) v ON v.section = g.section AND v.gx = cx AND v.gy = cy GROUP BY 1)
SELECT f.pid, f.section, round(x_px + CASE WHEN w > 0 THEN dx / w ELSE 0 END, 9) + 0e0 AS x_warped, round(y_px + CASE WHEN w > 0 THEN dy / w ELSE 0 END, 9) + 0e0 AS y_warped FROM f LEFT JOIN h USING (pid)""")
def _p18b(t):
    return G.rounded(L.field_warp_points(t.sql(_POINTS), t.sql(_HOLES), step=4.0, nx=8, ny=8), 9)


_VFIELD = "SELECT i, j, k3 AS k, CASE WHEN (i + j + k3) % 5 = 0 THEN 0e0 ELSE i * 0.9e0 + j * 0.01e0 END AS d0, CASE WHEN (i + j + k3) % 5 = 0 THEN 0e0 ELSE j * 0.8e0 END AS d1, CASE WHEN (i + j + k3) % 5 = 0 THEN 0e0 ELSE k3 * 1.1e0 END AS d2 FROM (SELECT n_nationkey AS i, j, SEQ[0;9] AS k3 FROM (SELECT n_nationkey, SEQ[0;9] AS j FROM nation) a) b"
_VPOINTS = "SELECT pos, ap_um / 400 AS v0, dv_um / 650 AS v1, ml_um / 900 - 1 AS v2, project_id FROM b_cells"


@query("p19_volume_field_to_ccf", f"""
SELECT pos, round(CASE WHEN NOT (d0 = 0 AND d1 = 0 AND d2 = 0) THEN d0 * 1000 END, 6) + 0e0 AS ap_um, round(CASE WHEN NOT (d0 = 0 AND d1 = 0 AND d2 = 0) THEN d2 * 1000 END, 6) + 0e0 AS ml_um, round(CASE WHEN NOT (d0 = 0 AND d1 = 0 AND d2 = 0) THEN d1 * 1000 END, 6) + 0e0 AS dv_um,
  abs((300 + project_id * 5) * 25 / 8000e0 - 1) <= 0.25 AS plausible
FROM ({_VPOINTS}) p LEFT JOIN ({_VFIELD}) f ON f.i = least(greatest(round_even(v0, 0), 0), 24) AND f.j = least(greatest(round_even(v1, 0), 0), 9) AND f.k = least(greatest(round_even(v2, 0), 0), 9)""")
def _p19(t):
    out = L.volume_field_to_ccf(t.sql(_VPOINTS), t.sql(_VFIELD), (25, 10, 10))
    out = out.withColumn("plausible", F.expr(L.plausible_extent("((300 + project_id * 5) * 25)")))
    return G.rounded(out.select("pos", "ap_um", "ml_um", "dv_um", "plausible"))


@query("j14_dorsal_surface", """
WITH s AS (SELECT i_ap, i_ml, min(i_dv) AS s FROM b_annotation WHERE structure_id > 0 GROUP BY 1, 2), p AS (SELECT pos, least(greatest(round_even(ap_um / 250, 0), 0), 51) AS a, least(greatest(round_even(ml_um / 250, 0), 0), 45) AS m FROM (SELECT pos, ap_um, ml_um - 1400 AS ml_um FROM b_cells) c),
e AS (SELECT DISTINCT a, m FROM p), b AS (SELECT a, m, s FROM (SELECT e.a, e.m, s.s, row_number() OVER (PARTITION BY e.a, e.m ORDER BY greatest(abs(s.i_ap - e.a), abs(s.i_ml - e.m)), s.s) AS rn FROM e, s) q WHERE rn = 1)
SELECT pos, s * 250e0 AS surface_dv_um FROM p LEFT JOIN b USING (a, m)""")
def _j14(t):
    pts = t.b_cells.select("pos", "ap_um", (F.col("ml_um") - 1400).alias("ml_um"))
    return L.dorsal_surface(pts, t.b_annotation, SHAPE, resolution_um=250.0).select("pos", "surface_dv_um")


@query("a23_region_area", "SELECT section, region_id, acronym, name, area_px FROM (SELECT section, region_id, count(*) AS area_px FROM b_labels WHERE region_id > 0 GROUP BY 1, 2) q LEFT JOIN b_structures s ON s.id = region_id")
def _a23(t):
    return L.region_area(t.b_labels, t.b_structures).select("section", "region_id", "acronym", "name", "area_px")


@query("a22_content_fingerprint", """
WITH c AS (SELECT section, max(y) + 1 AS height, max(x) + 1 AS width, sum(CAST(va * 100 AS BIGINT)) AS ps FROM b_labels GROUP BY 1)
SELECT section, height, width, CAST(ps AS BIGINT) AS pixel_sum, section % 3 = 0 AS reusable FROM c""")
def _a22(t):
    now = L.content_fingerprint(t.b_labels.withColumn("v", F.rint(F.col("va") * 100).cast("long")), "v")
    stored = now.withColumn("pixel_sum", F.col("pixel_sum") + F.when(F.col("section") % 3 == 0, 0).otherwise(1)).filter("section % 3 < 2")
    return now.join(L.reusable(stored, now), "section")


@query("w15_label_edges", """
SELECT section, x, y, region_id FROM (SELECT *, coalesce(lag(region_id) OVER r <> region_id, false) OR coalesce(lead(region_id) OVER r <> region_id, false) OR coalesce(lag(region_id) OVER c <> region_id, false) OR coalesce(lead(region_id) OVER c <> region_id, false) AS e
  FROM b_labels WINDOW r AS (PARTITION BY section, y ORDER BY x), c AS (PARTITION BY section, x ORDER BY y)) q WHERE e""")
def _w15(t):
    return L.label_edges(t.b_labels.select("section", "x", "y", "region_id"))


_SPARSE = "SELECT section, x, y, region_id FROM b_labels WHERE (x * 5 + y * 3 + section) % 4 <> 0"


@query("w15_sparse_label_edges", f"""
WITH s AS ({_SPARSE}) SELECT a.section, a.x, a.y, a.region_id FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.section = a.section AND abs(b.x - a.x) + abs(b.y - a.y) = 1 AND b.region_id <> a.region_id)""")
def _w15b(t):
    return L.label_edges(t.sql(_SPARSE))


@query("a26_mutual_information", """
WITH i AS (SELECT section, least(CAST(floor(va * 32) AS INT), 31) AS a, least(CAST(floor(vb * 32) AS INT), 31) AS b FROM b_labels WHERE region_id <> 3), h AS (SELECT section, a, b, count(*) AS c FROM i GROUP BY 1, 2, 3),
n AS (SELECT section, count(*) AS n FROM i GROUP BY 1), ra AS (SELECT section, a, sum(c) AS ca FROM h GROUP BY 1, 2), rb AS (SELECT section, b, sum(c) AS cb FROM h GROUP BY 1, 2)
SELECT section, max(n) AS n_pixels, round(CASE WHEN max(n) >= 100 THEN sum(c / n * ln((c / n) / (ca / n * cb / n))) END, 6) + 0e0 AS mutual_information FROM h JOIN n USING (section) JOIN ra USING (section, a) JOIN rb USING (section, b) GROUP BY section""")
def _a26(t):
    return G.rounded(L.mutual_information(t.b_labels, "region_id <> 3"))


@query("a27_overlap_verdict", """
SELECT section, round(dp, 6) + 0e0 AS dice_plane, round(dm, 6) + 0e0 AS dice_morph, dp > dm + 0.05 AS plane_better FROM (SELECT section,
  2e0 * count(*) FILTER (plane_mask AND tissue) / greatest(count(*) FILTER (plane_mask) + count(*) FILTER (tissue), 1) AS dp, 2e0 * count(*) FILTER (morph_mask AND tissue) / greatest(count(*) FILTER (morph_mask) + count(*) FILTER (tissue), 1) AS dm FROM b_labels GROUP BY 1) q""")
def _a27(t):
    return G.rounded(L.overlap_verdict(t.b_labels))


@query("a28_moment_similarity", """
WITH m AS (SELECT section, avg(x) FILTER (tissue) AS fx, avg(y) FILTER (tissue) AS fy, stddev_pop(x) FILTER (tissue) AS fsx, stddev_pop(y) FILTER (tissue) AS fsy, avg(x) FILTER (morph_mask) AS mx, avg(y) FILTER (morph_mask) AS my, stddev_pop(x) FILTER (morph_mask) AS msx, stddev_pop(y) FILTER (morph_mask) AS msy FROM b_labels GROUP BY 1)
SELECT section, round(msx / fsx, 6) + 0e0 AS scale_x, round(msy / fsy, 6) + 0e0 AS scale_y, round(mx - msx / fsx * fx, 6) + 0e0 AS shift_x, round(my - msy / fsy * fy, 6) + 0e0 AS shift_y FROM m""")
def _a28(t):
    return G.rounded(L.moment_similarity(t.b_labels, "tissue", "morph_mask"))


@query("a39_midline_pca", """
WITH m AS (SELECT section, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM b_labels WHERE tissue AND (x < 8 OR y > 3 + section % 3 OR x + y < 11) GROUP BY 1 HAVING count(*) >= 10),
e AS (SELECT *, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l FROM m), v AS (SELECT *, CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a < c THEN 1 ELSE 0 END ELSE l - c END AS dx, CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a < c THEN 0 ELSE 1 END ELSE b END AS dy FROM e),
u AS (SELECT *, dx / sqrt(dx * dx + dy * dy) * CASE WHEN dy < 0 THEN -1 ELSE 1 END AS ux, dy / sqrt(dx * dx + dy * dy) * CASE WHEN dy < 0 THEN -1 ELSE 1 END AS uy FROM v)
SELECT section, round(cx, 9) + 0e0 AS centroid_x, round(cy, 9) + 0e0 AS centroid_y, round(ux, 4) + 0e0 AS dir_x, round(uy, 4) + 0e0 AS dir_y, round(degrees(atan2(ux, uy)), 3) + 0e0 AS angle_deg FROM u""")
def _a39(t):
    out = L.midline_pca(t.b_labels, "tissue AND (x < 8 OR y > 3 + section % 3 OR x + y < 11)")
    return G.rounded(out, 9).withColumns({"dir_x": F.round("dir_x", 4) + 0.0, "dir_y": F.round("dir_y", 4) + 0.0, "angle_deg": F.round("angle_deg", 3) + 0.0})


@query("a29_min_area_estimate", f"""
WITH c AS (SELECT * FROM ({BOXES}) b), kp AS (SELECT *, count(*) OVER (PARTITION BY project_id, slide_idx) AS nk, row_number() OVER (PARTITION BY project_id, slide_idx ORDER BY area_px DESC, k) AS r FROM c WHERE area_px <= 0.25 * image_w * image_h AND greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) < 3.5),
tp AS (SELECT *, log10(area_px + 1) AS l FROM kp WHERE r <= greatest(2, nk // 5)), rg AS (SELECT project_id, slide_idx, min(l) AS lo, max(l) AS hi, max(area_px) AS mx FROM tp GROUP BY 1, 2),
h AS (SELECT project_id, slide_idx, lo, hi, least(CAST(floor((l - lo) / (hi - lo) * 256) AS INT), 255) AS b, count(*) AS c FROM tp JOIN rg USING (project_id, slide_idx) WHERE hi > lo GROUP BY 1, 2, 3, 4, 5),
v AS (SELECT *, lo + (b + 0.5) * (hi - lo) / 256 AS v FROM h), q AS (SELECT a.project_id, a.slide_idx, a.b, a.v, sum(z.c) FILTER (z.b <= a.b) AS w1, sum(z.c * z.v) FILTER (z.b <= a.b) AS m1, sum(z.c) AS wt, sum(z.c * z.v) AS mt FROM v a JOIN v z USING (project_id, slide_idx) GROUP BY 1, 2, 3, 4),
t AS (SELECT project_id, slide_idx, v FROM (SELECT *, row_number() OVER (PARTITION BY project_id, slide_idx ORDER BY round(w1 * (wt - w1) * (m1 / w1 - (mt - m1) / (wt - w1)) ** 2, 9) DESC, b) AS rn FROM q WHERE wt > w1) o WHERE rn = 1),
bg AS (SELECT tp.project_id, tp.slide_idx, max(area_px) AS big FROM tp LEFT JOIN t USING (project_id, slide_idx) WHERE v IS NULL OR l >= v GROUP BY 1, 2)
SELECT project_id, slide_idx, greatest(greatest(1000, CAST(floor(0.0005 * 2600 * 1700) AS BIGINT)), least(CAST(floor(coalesce(big, mx) * 0.3e0) AS BIGINT), CAST(floor(0.05 * 2600 * 1700) AS BIGINT))) AS min_area_px FROM rg LEFT JOIN bg USING (project_id, slide_idx)""")
def _a29(t):
    return L.min_area_estimate(t.sql(BOXES), SLIDE)


@query("a24_cell_tables", """
SELECT project_id, cell_type, n_cells, CAST(row_number() OVER (PARTITION BY project_id ORDER BY f, cell_type) AS INT) AS type_no FROM (SELECT project_id, cell_type, count(*) AS n_cells, min(pos) AS f FROM b_cells GROUP BY 1, 2) q""")
def _a24(t):
    return L.cell_tables(t.b_cells, ["project_id"])


_TRIANGLES = """SELECT k AS section, tri, 0e0 AS p1x, 0e0 AS p1y, CASE tri WHEN 0 THEN 30e0 ELSE 0e0 END AS p2x, CASE tri WHEN 0 THEN 0e0 ELSE 30e0 END AS p2y, 30e0 + k % 5 AS p3x, 30e0 AS p3y,
  1e0 AS q1x, k % 3 * 1e0 AS q1y, CASE tri WHEN 0 THEN 29e0 ELSE 0e0 END AS q2x, CASE tri WHEN 0 THEN 1e0 ELSE 31e0 END AS q2y, 32e0 AS q3x, 28e0 + k % 4 AS q3y FROM (SELECT k, SEQ[0;1] AS tri FROM b_sections) q"""


@query("p17_marker_warp", f"""
WITH h AS (SELECT p.*, t.*, ((x_px - p1x) * (p3y - p1y) - (p3x - p1x) * (y_px - p1y)) / ((p2x - p1x) * (p3y - p1y) - (p3x - p1x) * (p2y - p1y)) AS u, ((p2x - p1x) * (y_px - p1y) - (x_px - p1x) * (p2y - p1y)) / ((p2x - p1x) * (p3y - p1y) - (p3x - p1x) * (p2y - p1y)) AS v
  FROM ({_POINTS}) p LEFT JOIN ({_TRIANGLES}) t ON t.section = p.section),
w AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN u >= 0 AND v >= 0 AND u + v <= 1 THEN 0 ELSE 1 END, tri) AS rn FROM h)
SELECT pid, round(CASE WHEN u >= 0 AND v >= 0 AND u + v <= 1 THEN q1x + (q2x - q1x) * u + (q3x - q1x) * v ELSE x_px END, 6) + 0e0 AS x_warped, round(CASE WHEN u >= 0 AND v >= 0 AND u + v <= 1 THEN q1y + (q2y - q1y) * u + (q3y - q1y) * v ELSE y_px END, 6) + 0e0 AS y_warped FROM w WHERE rn = 1""")
def _p17(t):
    return G.rounded(L.warp_triangles(t.sql(_POINTS), t.sql(_TRIANGLES)).select("pid", "x_warped", "y_warped"))


# Eight markers a section, from the vectors: where they stand and, a little off, where they are moved to.
_MARKED = """SELECT vec_id AS section, 400D AS width, 300D AS height, transform(sequence(0, 7), i -> array(
  30D + 45 * i + abs(embedding[i]) * 9, 20D + abs(embedding[i + 8]) * 80 + (i * 89 + vec_id) % 170,
  32D + 45 * i + abs(embedding[i]) * 9 + embedding[i + 16], 22D + abs(embedding[i + 8]) * 80 + (i * 89 + vec_id) % 170 + embedding[i + 24])) AS markers FROM embeddings"""


@query("p17_marker_triangles", """SELECT vec_id AS section, CAST(18 AS BIGINT) AS n_triangles, round(480e0 * 360, 3) AS area, CAST(0 AS BIGINT) AS n_in_circles FROM embeddings""")
def _p17_triangles(t):
    # 12 points with 4 on the outline make 18 triangles, which fill the pinned rectangle, with no point in any circumcircle.
    # A section's triangles become one row, so they are made once and nothing is joined.
    tri = L.marker_triangles(t.sql(_MARKED)).groupBy("section").agg(F.collect_list(F.struct("*")).alias("t"))
    points = F.expr("array_distinct(flatten(transform(t, t -> array(struct(t.q1x AS x, t.q1y AS y), struct(t.q2x AS x, t.q2y AS y), struct(t.q3x AS x, t.q3y AS y)))))")
    area = "abs((t.q2x - t.q1x) * (t.q3y - t.q1y) - (t.q3x - t.q1x) * (t.q2y - t.q1y)) / 2"
    d = "(2 * (t.q1x * (t.q2y - t.q3y) + t.q2x * (t.q3y - t.q1y) + t.q3x * (t.q1y - t.q2y)))"
    s = lambda n: f"(t.q{n}x * t.q{n}x + t.q{n}y * t.q{n}y)"
    centre = f"""struct(({s(1)} * (t.q2y - t.q3y) + {s(2)} * (t.q3y - t.q1y) + {s(3)} * (t.q1y - t.q2y)) / {d} AS x, ({s(1)} * (t.q3x - t.q2x) + {s(2)} * (t.q1x - t.q3x) + {s(3)} * (t.q2x - t.q1x)) / {d} AS y, t.q1x, t.q1y)"""
    inside = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) < ((c.q1x - c.x) * (c.q1x - c.x) + (c.q1y - c.y) * (c.q1y - c.y)) * (1 - 1e-7D)"
    held = tri.withColumns({"p": points, "c": F.expr(f"transform(t, t -> {centre})")})
    count = f"aggregate(c, 0L, (n, c) -> n + size(filter(p, p -> {inside})))"
    return held.select("section", F.size("t").cast("long").alias("n_triangles"), (F.round(F.expr(f"aggregate(t, 0D, (a, t) -> a + {area})"), 3) + 0.0).alias("area"), F.expr(count).alias("n_in_circles"))


@query("p17_warp_by_markers")
def _p17_warp(t):
    # Every marker's own place goes to where it was moved, through the triangles laid over the moved places.
    marked = t.sql(_MARKED)
    points = marked.select("section", F.posexplode("markers").alias("i", "m")).select("section", "i", F.col("m")[0].alias("x_px"), F.col("m")[1].alias("y_px"))
    return G.rounded(L.warp_triangles(points, L.marker_triangles(marked)).select("section", "i", "x_warped", "y_warped"), 6)
