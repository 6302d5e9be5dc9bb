"""Queries over section series, boxes and slide layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.operators import series as S
from voxelkeel.plans.q_geometry import _NINE, _PLANE_VALUES_SQL, planes
from voxelkeel.plans.registry import query

BOXES = """SELECT k, project_id, slide_idx, x0, y0, x1, y1, (x0 + x1) / 2e0 AS cx, (y0 + y1) / 2e0 AS cy, CAST(2600 AS BIGINT) AS image_w, CAST(1700 AS BIGINT) AS image_h,
  CAST(floor((x1 - x0) * (y1 - y0) * (1 + k % 7) / 8) AS BIGINT) AS area_px FROM b_sections"""
SLIDE = ["project_id", "slide_idx"]


@query("a20_series_flags", f"""
WITH {_PLANE_VALUES_SQL.strip()},
rw AS (SELECT s.project_id, s.section_index, s.ap_order, coalesce(pv.plane_ap_um, s.ap_um) AS ap, pv.plane_ap_um, pitch_deg, yaw_deg, coalesce(mirrored, false) AS mirrored
  FROM b_sections s LEFT JOIN pv ON pv.k = s.k),
q AS (SELECT *, row_number() OVER w - 1 AS pos, lead(ap) OVER w - ap AS step, lead(section_index) OVER w AS nsec, count(*) OVER (PARTITION BY project_id) AS n,
  first_value(ap) OVER (PARTITION BY project_id ORDER BY ap_order, section_index) AS a0 FROM rw WHERE ap IS NOT NULL WINDOW w AS (PARTITION BY project_id ORDER BY ap_order, section_index)),
m AS (SELECT project_id, median(step) AS med, arg_max(ap, pos) AS a1 FROM q GROUP BY project_id),
c AS (SELECT q.project_id, median(ap - med * pos) AS ctr FROM q JOIN m USING (project_id) WHERE n >= 3 GROUP BY q.project_id),
t AS (SELECT q.*, abs(ap - med * pos - ctr) AS off, CASE WHEN a1 >= a0 THEN 1 ELSE -1 END AS dir FROM q JOIN m USING (project_id) JOIN c USING (project_id) WHERE n >= 3),
t2 AS (SELECT *, lead(off) OVER (PARTITION BY project_id ORDER BY pos) AS noff FROM t),
odd AS (SELECT project_id, CASE WHEN off > noff THEN section_index ELSE nsec END AS section_index, count(*) AS n_order FROM t2 WHERE step * dir <= 0 GROUP BY 1, 2),
pm AS (SELECT project_id, count(*) AS np, median(pitch_deg) AS mp, median(yaw_deg) AS my FROM rw WHERE plane_ap_um IS NOT NULL GROUP BY project_id)
SELECT rw.project_id, rw.section_index, round(off, 6) + 0e0 AS off_trend_um, coalesce(n_order, 0) AS n_out_of_order,
  coalesce(np >= 3 AND abs(pitch_deg - mp) > 2, false) AS pitch_off, coalesce(np >= 3 AND abs(yaw_deg - my) > 2, false) AS yaw_off, mirrored
FROM rw LEFT JOIN odd USING (project_id, section_index) LEFT JOIN pm USING (project_id) LEFT JOIN (SELECT project_id, section_index, off FROM t) o USING (project_id, section_index)""")
def _a20(t):
    return G.rounded(S.series_flags(S.series_rows(planes(t))))


_MEAN_AP = "SELECT project_id, section_index, ap_order, 3000e0 + section_index * 60 + CASE WHEN k % 37 = 5 THEN 90 WHEN k % 23 = 7 THEN -50 ELSE 0 END AS mean_ap FROM b_sections"


@query("a40_mean_ap_issues", f"""
WITH z AS (SELECT *, lead(mean_ap) OVER w - mean_ap AS step, lead(section_index) OVER w AS next_section, count(*) OVER (PARTITION BY project_id) AS n,
  first_value(mean_ap) OVER w AS a FROM ({_MEAN_AP}) s WINDOW w AS (PARTITION BY project_id ORDER BY ap_order, section_index)),
m AS (SELECT project_id, median(abs(step)) AS med, arg_max(mean_ap, ap_order) AS b FROM z GROUP BY project_id)
SELECT z.project_id, section_index, next_section, CASE WHEN step * CASE WHEN b - a >= 0 THEN 1 ELSE -1 END <= 0 THEN 'reversed' ELSE 'close' END AS issue
FROM z JOIN m USING (project_id) WHERE step IS NOT NULL AND n >= 3 AND med >= 1e-6 AND (step * CASE WHEN b - a >= 0 THEN 1 ELSE -1 END <= 0 OR abs(step) < 0.3 * med)""")
def _a40(t):
    return S.ap_order_issues(t.sql(_MEAN_AP))


@query("w11_assign_ap", """
WITH z AS (SELECT *, row_number() OVER w - 1 AS pos FROM b_sections WINDOW w AS (PARTITION BY project_id ORDER BY ap_order, section_index)),
st AS (SELECT project_id, count(*) AS n, count(slide_number) AS ns, count(DISTINCT slide_number) AS nd, arg_min(slide_number, pos) AS s0, arg_max(slide_number, pos) AS s1 FROM z GROUP BY project_id),
an AS (SELECT project_id, pos AS apos, ap_um AS aap, slide_number AS asn FROM z WHERE section_index = 40),
f AS (SELECT project_id, pos AS apos, ap_um AS aap, slide_number AS asn FROM z WHERE pos = 0),
a AS (SELECT f.project_id, coalesce(an.apos, f.apos) AS apos, CASE WHEN an.apos IS NOT NULL THEN an.aap ELSE f.aap END AS aap, CASE WHEN an.apos IS NOT NULL THEN an.asn ELSE f.asn END AS asn FROM f LEFT JOIN an USING (project_id))
SELECT z.project_id, z.section_index, ns = n AND nd > 1 AS by_slide_number,
  round(coalesce(aap, 5400) + CASE WHEN ns = n AND nd > 1 THEN (slide_number - asn) * CASE WHEN s1 - s0 >= 0 THEN 1 ELSE -1 END ELSE pos - apos END * spacing_um * -1, 6) + 0e0 AS assigned_ap_um
FROM z JOIN st USING (project_id) JOIN a USING (project_id)""")
def _w11(t):
    s = t.b_sections.withColumn("is_anchor", F.col("section_index") == 40)
    out = S.assign_ap(s, forward=False, anchor="is_anchor")
    return G.rounded(out.select("project_id", "section_index", "by_slide_number", "assigned_ap_um"))


_SPARSE_AP = "SELECT project_id, section_index, ap_order, CASE WHEN k % 7 = 3 AND project_id % 6 <> 5 THEN 3000e0 + section_index * 61 + k % 13 END AS ap_um FROM b_sections"


@query("w12_interpolate_ap", f"""
WITH z AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ap_order, section_index) AS pos FROM ({_SPARSE_AP}) s),
k AS (SELECT project_id, pos, ap_um, lead(pos) OVER w AS p1, lead(ap_um) OVER w AS a1, lag(pos) OVER w IS NULL AS first, count(*) OVER (PARTITION BY project_id) AS n FROM z WHERE ap_um IS NOT NULL WINDOW w AS (PARTITION BY project_id ORDER BY pos))
SELECT z.project_id, z.section_index, round(CASE WHEN z.ap_um IS NOT NULL THEN z.ap_um WHEN k.n >= 2 THEN CASE WHEN z.pos < k.pos OR k.p1 IS NULL THEN k.ap_um ELSE k.ap_um + (k.a1 - k.ap_um) * (z.pos - k.pos) / (k.p1 - k.pos) END END, 6) + 0e0 AS filled_ap_um
FROM z LEFT JOIN k ON k.project_id = z.project_id AND (z.pos >= k.pos AND (k.p1 IS NULL OR z.pos < k.p1) OR (k.first AND z.pos < k.pos))""")
def _w12(t):
    return G.rounded(S.interpolate_ap(t.sql(_SPARSE_AP)).select("project_id", "section_index", "filled_ap_um"))


@query("w13_series_numbers", """
WITH z AS (SELECT project_id, section_index, ap_order, k, row_number() OVER (PARTITION BY project_id ORDER BY ap_order, section_index) AS display_no FROM b_sections)
SELECT project_id, section_index, CAST(display_no AS INT) AS display_no, 0 AS slot, ap_order AS sequence_ap_order FROM z
UNION ALL SELECT project_id, section_index, CAST(display_no AS INT), 1, NULL FROM z WHERE k % 9 = 2""")
def _w13(t):
    return S.series_numbers(t.b_sections.withColumn("gap_after", F.col("k") % 9 == 2), "gap_after")


_GUIDE = f"""SELECT k, project_id, section_index, ap_source, CASE WHEN has_ds THEN {_NINE} END AS ds_anchoring, ap_um / 25 AS user_centre FROM b_sections"""


@query("j15_guide_planes", """
WITH z AS (SELECT project_id, section_index, ox, ox + ux / 2 + vx / 2 AS c, CASE WHEN ap_um IS NOT NULL AND NOT (ap_source IS NOT DISTINCT FROM 'deepslice') THEN ap_um / 25 - (ox + ux / 2 + vx / 2) END AS s FROM b_sections WHERE has_ds),
k AS (SELECT project_id, c, s, lead(c) OVER w AS c1, lead(s) OVER w AS s1, lag(c) OVER w IS NULL AS first FROM z WHERE s IS NOT NULL WINDOW w AS (PARTITION BY project_id ORDER BY c, s))
SELECT z.project_id, z.section_index, round(z.ox + coalesce(z.s, CASE WHEN z.c < k.c OR k.c1 IS NULL THEN k.s WHEN k.c1 = k.c THEN k.s ELSE k.s + (k.s1 - k.s) * (z.c - k.c) / (k.c1 - k.c) END, 0), 6) + 0e0 AS guided_ox
FROM z LEFT JOIN k ON z.s IS NULL AND k.project_id = z.project_id AND (z.c >= k.c AND (k.c1 IS NULL OR z.c < k.c1) OR (k.first AND z.c < k.c))""")
def _j15(t):
    out = S.guide_planes(t.sql(_GUIDE))
    return G.rounded(out.select("project_id", "section_index", F.element_at("guided_anchoring", 1).alias("guided_ox")))


@query("w10_order_sections", f"""
WITH z AS (SELECT b.*, lag(cx) OVER w AS pcx FROM ({BOXES}) b WINDOW w AS (PARTITION BY project_id, slide_idx ORDER BY cx, k)),
e AS (SELECT project_id, slide_idx, median(x1 - x0) AS ext FROM z GROUP BY 1, 2),
g AS (SELECT z.*, sum(CASE WHEN cx - pcx > greatest(ext * 0.6, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, slide_idx ORDER BY cx, k ROWS UNBOUNDED PRECEDING) AS cl FROM z JOIN e USING (project_id, slide_idx)),
mean AS (SELECT project_id, slide_idx, cl, dense_rank() OVER (PARTITION BY project_id, slide_idx ORDER BY avg(cx)) - 1 AS outr FROM g GROUP BY project_id, slide_idx, cl)
SELECT k, CAST(row_number() OVER (PARTITION BY project_id, slide_idx, outr ORDER BY cy, k) - 1 AS INT) AS row, CAST(outr AS INT) AS col,
  CAST(row_number() OVER (PARTITION BY project_id, slide_idx ORDER BY outr, cy, k) - 1 AS INT) AS rank FROM g JOIN mean USING (project_id, slide_idx, cl)""")
def _w10(t):
    return S.order_sections(t.sql(BOXES), SLIDE).select("k", "row", "col", "rank")


_SOURCES = "SELECT project_id, slide_idx, band, CAST(300 + (project_id * 7 + slide_idx * 11 + band * 13) % 400 AS BIGINT) AS height FROM (SELECT project_id, slide_idx, SEQ[0;project_id % 3] AS band FROM (SELECT DISTINCT project_id, slide_idx FROM b_sections) d) e"
_BANDS_SQL = f"bd AS (SELECT *, coalesce(sum(height + 40) OVER (PARTITION BY project_id, slide_idx ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band_y0 FROM ({_SOURCES}) s)"


@query("w14_slide_bands", f"WITH {_BANDS_SQL} SELECT project_id, slide_idx, band, CAST(band_y0 AS BIGINT) AS band_y0, CAST(band_y0 + height AS BIGINT) AS band_y1 FROM bd")
def _w14(t):
    return S.slide_bands(t.sql(_SOURCES), SLIDE).select(*SLIDE, "band", "band_y0", "band_y1")


# Ragged slides: the later sections of a slide are moved to a second one.
_ITEMS = "SELECT k, project_id, slide_idx, row_number() OVER (PARTITION BY project_id, slide_idx ORDER BY k) - 1 AS pos, w, h FROM (SELECT k, project_id, slide_idx + CASE WHEN k % 20 < 5 + k % 100 / 10 THEN 0 ELSE 1000 END AS slide_idx, x1 - x0 AS w, y1 - y0 AS h FROM b_sections) q"


@query("w14_slide_layout", f"""
WITH n AS (SELECT project_id, slide_idx, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS nc FROM ({_ITEMS}) i GROUP BY 1, 2),
i AS (SELECT *, pos // nc AS cell_row, pos % nc AS cell_col FROM ({_ITEMS}) i JOIN n USING (project_id, slide_idx)),
r AS (SELECT project_id, slide_idx, cell_row, coalesce(sum(max(h)) OVER (PARTITION BY project_id, slide_idx ORDER BY cell_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + cell_row * 40 AS y FROM i GROUP BY 1, 2, 3),
c AS (SELECT project_id, slide_idx, cell_col, coalesce(sum(max(w)) OVER (PARTITION BY project_id, slide_idx ORDER BY cell_col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + cell_col * 40 AS x FROM i GROUP BY 1, 2, 3)
SELECT k, cell_row, cell_col, CAST(x AS BIGINT) AS box_x0, CAST(y AS BIGINT) AS box_y0, CAST(x + w AS BIGINT) AS box_x1, CAST(y + h AS BIGINT) AS box_y1
FROM i JOIN r USING (project_id, slide_idx, cell_row) JOIN c USING (project_id, slide_idx, cell_col)""")
def _w14b(t):
    placed = S.grid_cells(t.sql(_ITEMS), SLIDE, "pos")
    return S.slide_layout(placed, SLIDE).select("k", "cell_row", "cell_col", "box_x0", "box_y0", "box_x1", "box_y1")


@query("j05_band_lookup", f"""WITH {_BANDS_SQL}, b AS ({BOXES}),
x AS (SELECT b.k, bd.band, row_number() OVER (PARTITION BY b.k ORDER BY CASE WHEN cy >= band_y0 AND cy < band_y0 + height THEN 0 ELSE 1 END,
  CASE WHEN cy >= band_y0 AND cy < band_y0 + height THEN 0 ELSE abs(cy - (band_y0 + band_y0 + height) * 0.5) END, bd.band) AS rn FROM b JOIN bd USING (project_id, slide_idx))
SELECT k, band FROM x WHERE rn = 1""")
def _j05(t):
    return S.band_lookup(t.sql(BOXES), S.slide_bands(t.sql(_SOURCES), SLIDE), SLIDE).select("k", "band")


@query("w10_order_by_band", f"""WITH {_BANDS_SQL}, b AS ({BOXES}),
x AS (SELECT b.*, bd.band, row_number() OVER (PARTITION BY b.k ORDER BY CASE WHEN cy >= band_y0 AND cy < band_y0 + height THEN 0 ELSE 1 END,
  CASE WHEN cy >= band_y0 AND cy < band_y0 + height THEN 0 ELSE abs(cy - (band_y0 + band_y0 + height) * 0.5) END, bd.band) AS rn FROM b JOIN bd USING (project_id, slide_idx)),
z AS (SELECT *, lag(cx) OVER (PARTITION BY project_id, slide_idx, band ORDER BY cx, k) AS pcx, median(x1 - x0) OVER (PARTITION BY project_id, slide_idx, band) AS ext FROM x WHERE rn = 1),
g AS (SELECT *, sum(CASE WHEN cx - pcx > greatest(ext * 0.6, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, slide_idx, band ORDER BY cx, k ROWS UNBOUNDED PRECEDING) AS cl FROM z)
SELECT k, band, CAST(row_number() OVER (PARTITION BY project_id, slide_idx ORDER BY band, cl, cy, k) - 1 AS INT) AS rank FROM g""")
def _w10b(t):
    return S.order_sections_by_band(t.sql(BOXES), S.slide_bands(t.sql(_SOURCES), SLIDE), SLIDE).select("k", "band", "rank")


@query("a38_box_equalise", f"""
WITH m AS (SELECT project_id, slide_idx, median(x1 - x0) AS mw, median(y1 - y0) AS mh, count(*) AS n FROM ({BOXES}) b GROUP BY 1, 2),
t AS (SELECT b.*, CASE WHEN n >= 3 AND x1 - x0 < 0.85 * mw THEN mw ELSE x1 - x0 END AS tw, CASE WHEN n >= 3 AND y1 - y0 < 0.85 * mh THEN mh ELSE y1 - y0 END AS th FROM ({BOXES}) b JOIN m USING (project_id, slide_idx)),
g AS (SELECT *, tw <> x1 - x0 OR th <> y1 - y0 AS grown FROM t)
SELECT k, CASE WHEN grown THEN greatest(0, CAST(round_even((x0 + x1) / 2e0 - tw / 2e0, 0) AS BIGINT)) ELSE x0 END AS eq_x0, CASE WHEN grown THEN least(image_w, CAST(round_even((x0 + x1) / 2e0 + tw / 2e0, 0) AS BIGINT)) ELSE x1 END AS eq_x1,
  CASE WHEN grown THEN greatest(0, CAST(round_even((y0 + y1) / 2e0 - th / 2e0, 0) AS BIGINT)) ELSE y0 END AS eq_y0, CASE WHEN grown THEN least(image_h, CAST(round_even((y0 + y1) / 2e0 + th / 2e0, 0) AS BIGINT)) ELSE y1 END AS eq_y1 FROM g""")
def _a38(t):
    return S.box_equalise(t.sql(BOXES), SLIDE).select("k", "eq_x0", "eq_x1", "eq_y0", "eq_y1")


@query("j16_box_neighbours", f"""
WITH b AS ({BOXES}),
p AS (SELECT a.k, least(min(CASE WHEN a.y1 > o.y0 AND a.y0 < o.y1 AND o.x0 >= a.x1 THEN o.x0 - a.x1 END), min(CASE WHEN a.y1 > o.y0 AND a.y0 < o.y1 AND o.x1 <= a.x0 THEN a.x0 - o.x1 END),
    min(CASE WHEN a.x1 > o.x0 AND a.x0 < o.x1 AND o.y0 >= a.y1 THEN o.y0 - a.y1 END), min(CASE WHEN a.x1 > o.x0 AND a.x0 < o.x1 AND o.y1 <= a.y0 THEN a.y0 - o.y1 END)) AS gap
  FROM b a JOIN b o ON o.project_id = a.project_id AND o.slide_idx = a.slide_idx AND o.k <> a.k GROUP BY a.k),
m AS (SELECT b.*, gap, CAST(floor(least(0.06 * least(x1 - x0, y1 - y0), coalesce(gap / 2e0, 1e18))) AS BIGINT) AS mg FROM b LEFT JOIN p USING (k))
SELECT k, gap AS gap_px, mg AS margin_px, greatest(0, x0 - mg) AS mx0, greatest(0, y0 - mg) AS my0, least(image_w, x1 + mg) AS mx1, least(image_h, y1 + mg) AS my1 FROM m""")
def _j16(t):
    return S.box_neighbours(t.sql(BOXES), SLIDE).select("k", "gap_px", "margin_px", "mx0", "my0", "mx1", "my1")


@query("o03_filter_components", f"""
SELECT k, area_px FROM (SELECT *, row_number() OVER (PARTITION BY project_id, slide_idx ORDER BY area_px DESC, k) AS rn FROM ({BOXES}) b
  WHERE area_px >= 20000 AND area_px <= CAST(floor(0.03 * image_w * image_h) AS BIGINT) AND greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) <= 1.4) q WHERE rn <= 6""")
def _o03(t):
    out = S.filter_components(t.sql(BOXES), SLIDE, min_area_px=20000, max_area_frac=0.03, aspect_ratio_max=1.4, expected_count=6)
    return out.select("k", "area_px")
