"""Queries over warps, section matching, fragments, and the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.operators import matching as M
from voxelkeel.plans.bindings import with_bindings
from voxelkeel.plans.q_features import _SCREEN_SQL
from voxelkeel.plans.q_geometry import _AFFINE
from voxelkeel.plans.q_labels import _POINTS
from voxelkeel.plans.q_placement import PLACED_SQL, region_sql
from voxelkeel.plans.q_series import BOXES, SLIDE
from voxelkeel.plans.q_sources import _LIST
from voxelkeel.plans.registry import query
from voxelkeel.session import scratch_folder, spread
from voxelkeel.sinks import tables as K
from voxelkeel.streaming import operators as ST

_LANDMARKS = """SELECT k AS section, i, (i % 3) * 90e0 + k % 7 + i AS sx, floor(i / 3) * 80e0 + k % 5 + i * 2 AS sy, (i % 3) * 90e0 + (k * 3 + i * 5) % 13 AS tx, floor(i / 3) * 80e0 + (k * 7 + i * 3) % 11 AS ty, k % 2 = 0 AS forward
FROM (SELECT k, SEQ[0;8] AS i FROM b_sections) q"""
_PTS = "SELECT k * 4 + j AS pid, k AS section, 20e0 + j * 40 + k % 9 AS x_px, 30e0 + j * 31 + k % 8 AS y_px FROM (SELECT k, SEQ[0;3] AS j FROM b_sections) q"


@query("p16_tps_warp_points")
def _p16(t):
    # A ninth of the sections have no landmarks; their points stay.
    return G.rounded(M.tps_warp_points(t.sql(_PTS), t.sql(_LANDMARKS).filter("section % 9 <> 4")), 4)


# A third of the sections have landmarks that shift by (3, -2), a third an affine correction; all have a field.
_SHIFTED = "SELECT k AS section, i, (i % 3) * 15e0 AS sx, floor(i / 3) * 12e0 AS sy, (i % 3) * 15e0 + 3 AS tx, floor(i / 3) * 12e0 - 2 AS ty, false AS forward FROM (SELECT k, SEQ[0;8] AS i FROM b_sections WHERE k % 3 = 0) q"


@query("p14_pixel_chain", f"""
WITH s AS (SELECT *, {_AFFINE} FROM b_sections), p AS (SELECT p.pid, p.section, x_px, y_px, s.* FROM ({_POINTS}) p JOIN s ON s.k = p.section),
a AS (SELECT *, CASE k % 3 WHEN 0 THEN x_px - 3 WHEN 1 THEN (m0 * (x_px - m5) - m3 * (y_px - m2)) / (m0 * m4 - m1 * m3) ELSE x_px END AS xa, CASE k % 3 WHEN 0 THEN y_px + 2 WHEN 1 THEN (m4 * (y_px - m2) - m1 * (x_px - m5)) / (m0 * m4 - m1 * m3) ELSE y_px END AS ya FROM p),
f AS (SELECT *, least(greatest(xa / 4, 0), 7) AS fx, least(greatest(ya / 4, 0), 7) AS fy FROM a), g AS (SELECT *, least(floor(fx), 6) AS gx0, least(floor(fy), 6) AS gy0 FROM f),
w AS (SELECT pid, sum(w * dx) AS dx, sum(w * dy) AS dy FROM (SELECT g.*, gx0 + i AS cx, gy0 + j AS cy, CASE WHEN i = 1 THEN fx - gx0 ELSE 1 - fx + gx0 END * CASE WHEN j = 1 THEN fy - gy0 ELSE 1 - fy + gy0 END AS w FROM g, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) g JOIN b_field v ON v.section = g.section AND v.gx = cx AND v.gy = cy GROUP BY 1),
l AS (SELECT a.*, xa + coalesce(dx, 0) AS xl, ya + coalesce(dy, 0) AS yl FROM a LEFT JOIN w USING (pid))
SELECT pid, round(CASE WHEN has_reg THEN (ox + xl / out_w * ux + yl / out_h * vx) * 25.013e0 END, 3) + 0e0 AS ap_um, round(CASE WHEN has_reg THEN (oz + xl / out_w * uz + yl / out_h * vz) * 25.013e0 END, 3) + 0e0 AS ml_um, round(CASE WHEN has_reg THEN (oy + xl / out_w * uy + yl / out_h * vy) * 25.013e0 END, 3) + 0e0 AS dv_um, true AS settled FROM l""")
def _p14b(t):
    affine = F.expr("k % 3 = 1")
    sections = t.sql(f"SELECT k AS section, k, CASE WHEN has_reg THEN ARR[ox, oy, oz, ux, uy, uz, vx, vy, vz] END AS reg_anchoring, out_w, out_h, 25.013e0 AS resolution_um, {_AFFINE} FROM b_sections")
    sections = sections.withColumns({f"m{i}": F.when(affine, F.col(f"m{i}")) for i in range(6)})
    out = M.section_pixels_to_ccf(t.sql(_POINTS), sections, landmarks=t.sql(_SHIFTED), field=t.b_field, step=4.0, nx=8, ny=8)
    return G.rounded(out.select("pid", "ap_um", "ml_um", "dv_um", "settled"), 3)


_MATCH = """SELECT k, project_id, slide_idx, section_index, (section_index * 7) % 100 AS reference_section, x1 - x0 AS w, y1 - y0 AS h, out_w, out_h, ARR[ox, oy, oz, ux, uy, uz, vx, vy, vz] AS reg_anchoring, k % 4 = 1 AS was_mirrored,
  0.7e0 + k % 5 * 0.02e0 AS m0, 0.03e0 * (k % 3 - 1) AS m1, k % 11 * 1e0 AS m2, -0.02e0 * (k % 3 - 1) AS m3, 0.72e0 AS m4, k % 6 * 1e0 AS m5, CASE WHEN k % 9 = 0 THEN NULL ELSE 4e0 + slide_idx END AS reference_pixel_um FROM b_sections WHERE has_reg"""
_FLIP = "-{0} AS {0}, {0} * (w - 1) + {1} AS {1}, -{2} AS {2}, {2} * (w - 1) + {3} AS {3}"


@query("p21_inherit_registration", f"""
WITH a AS ({_MATCH}), b AS (SELECT * REPLACE ({_FLIP.format('m0', 'm2', 'm3', 'm5')}) FROM a WHERE was_mirrored UNION ALL SELECT * FROM a WHERE NOT was_mirrored),
c AS (SELECT *, CASE WHEN reg_anchoring[6] / out_w * m0 + reg_anchoring[9] / out_h * m3 >= 0 THEN false ELSE true END AS mirrored FROM b),
d AS (SELECT * REPLACE ({_FLIP.format('m0', 'm2', 'm3', 'm5')}) FROM c WHERE mirrored UNION ALL SELECT * FROM c WHERE NOT mirrored)
SELECT k, mirrored, round(reg_anchoring[1] + m2 / out_w * reg_anchoring[4] + m5 / out_h * reg_anchoring[7], 6) + 0e0 AS a0, round(m0 * w / out_w * reg_anchoring[6] + m3 * w / out_h * reg_anchoring[9], 6) + 0e0 AS a5,
  round(m1 * h / out_w * reg_anchoring[5] + m4 * h / out_h * reg_anchoring[8], 6) + 0e0 AS a7, round(median(sqrt(abs(m0 * m4 - m1 * m3)) * reference_pixel_um) OVER (PARTITION BY project_id, slide_idx), 4) + 0e0 AS pixel_um FROM d""")
def _p21(t):
    m = M.inherit_registration(M.orient_matches(t.sql(_MATCH), "front"))
    out = m.join(M.learn_pixel_size(m), ["project_id", "slide_idx"], "left")
    return G.rounded(out.select("k", "mirrored", *[F.element_at("inherited_anchoring", i + 1).alias(f"a{i}") for i in (0, 5, 7)], "pixel_um"))


@query("p21_copy_cells", f"""
SELECT pos, m.section_index, round((m4 * (x_px - m2) - m1 * (y_px - m5)) / (m0 * m4 - m1 * m3), 9) + 0e0 AS x_px, round((m0 * (y_px - m5) - m3 * (x_px - m2)) / (m0 * m4 - m1 * m3), 9) + 0e0 AS y_px
FROM b_cells c LEFT JOIN (SELECT project_id, reference_section, section_index, m0, m1, m2, m3, m4, m5 FROM ({_MATCH}) q) m ON m.project_id = c.project_id AND m.reference_section = c.section_index AND x_px IS NOT NULL AND y_px IS NOT NULL""")
def _p21b(t):
    return G.rounded(M.copy_cells(t.b_cells, t.sql(_MATCH)).select("pos", "section_index", "x_px", "y_px"), 9)


def _outlines(t):
    shape = "SELECT section, CAST(floor(section / 50) AS BIGINT) AS pair, section % 50 < 25 AS is_target, x, y FROM b_labels WHERE {} AND (x < 8 + section % 5 OR y > 2 + section % 3)"
    turns = [float(a) for a in range(-12, 13, 3)]
    px = t.sql(shape.format("tissue"))
    targets = M.outline_bitmaps(px.filter("is_target"), ["pair", "section"], width=16, height=12, turns=turns, mirrors=(False, True))
    refs = M.outline_bitmaps(px.filter("NOT is_target"), ["pair", "section"], width=16, height=12)
    return targets, refs


@query("j08_section_iou", """
WITH p AS (SELECT section, CAST(floor(section / 50) AS BIGINT) AS pair, section % 50 < 25 AS t, x, y FROM b_labels WHERE tissue AND (x < 8 + section % 5 OR y > 2 + section % 3)), n AS (SELECT pair, section, t, count(*) AS n FROM p GROUP BY 1, 2, 3),
i AS (SELECT a.pair, a.section, b.section AS reference, count(*) AS c FROM p a JOIN p b ON b.pair = a.pair AND a.t AND NOT b.t AND b.x = a.x AND b.y = a.y GROUP BY 1, 2, 3)
SELECT a.pair, a.section, b.section AS reference, round(coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)), 6) + 0e0 AS overlap FROM n a JOIN n b ON b.pair = a.pair AND a.t AND NOT b.t LEFT JOIN i ON i.section = a.section AND i.reference = b.section""")
def _j08(t):
    targets, refs = _outlines(t)
    return G.rounded(M.section_overlaps(targets.filter("turn = 0 AND NOT mirror"), refs).select("pair", "section", "reference", "overlap"))


@query("j08_match_sections")
def _j08b(t):
    return G.rounded(M.match_sections(M.section_overlaps(*_outlines(t)), min_overlap=0.75))


@query("j17_merge_fragments")
def _j17(t):
    return G.rounded(M.merge_fragments(t.sql(BOXES), SLIDE))


@query("k03_export_all_csv", f"""WITH {PLACED_SQL}, {region_sql('placed', 'hit').strip()}
SELECT 'ccf' AS export, nullif(region, '') AS region, count(*) AS n_channels FROM hit GROUP BY 2
UNION ALL SELECT 'ccf_other_atlas', concat('x', region), count(*) FROM hit GROUP BY 2
UNION ALL SELECT 'paxinos', nullif(region, ''), count(*) FROM hit GROUP BY 2""")
def _k03(t):
    from voxelkeel.plans.q_sources import _located
    out = scratch_folder(t.spark, "export")
    placed = _located(t).withColumn("atlas_name", F.lit("allen_mouse_25um"))
    placed = placed.select("probe", "shank", "channel", "ap_um", "ml_um", "dv_um", "depth_source", "atlas_name", *K.REGION_COLUMNS)
    K.export_all(placed, placed.withColumn("region", F.concat(F.lit("x"), "region")), out)
    parts = []
    for name in ("ccf", "ccf_other_atlas", "paxinos"):
        rows = t.spark.read.csv(f"{out}/{name}", header=True)
        parts.append(rows.groupBy(F.lit(name).alias("export"), "region").agg(F.count(F.lit(1)).alias("n_channels")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _spike_stream(t):
    ev = ST.event_stream(t.spark, f"{t.sf_dir}/events.parquet")
    return ev.select("ts", ((F.col("event_id") * 37) % 5745).cast("double").alias("depth_um"), F.col("value").alias("amplitude"))


@query("t01_stream_depth_profiles", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(floor((event_id * 37) % 5745 / 2000) AS BIGINT) AS bin, count(*) AS n_spikes, round(CASE WHEN count(*) >= 3 THEN count(*) / 3600e0 END, 9) + 0e0 AS rate_hz, round(CASE WHEN count(*) >= 3 THEN sum(value) / count(*) END, 6) + 0e0 AS mean_amplitude FROM events GROUP BY 1, 2""")
def _t01(t):
    profiles = ST.stream_depth_profiles(_spike_stream(t), bin_um=2000.0, min_spikes=3, late="36500 days")  # files of a table come in any order
    ckpt = scratch_folder(t.spark, "profiles")
    out = ST.drain(profiles, ["window_start", "bin"], scratch_folder(t.spark, "profiles-out"), ckpt)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "bin", "n_spikes", (F.round("rate_hz", 9) + 0.0).alias("rate_hz"), (F.round("mean_amplitude", 6) + 0.0).alias("mean_amplitude"))


@query("t02_stream_screen_windows", f"WITH {_SCREEN_SQL} SELECT recording, win, round(artifact, 6) + 0e0 AS artifact, round(activity, 6) + 0e0 AS activity, reject_reason FROM sc")
def _t02(t):
    # Written in four parts by closing time, as a recorder would; files of one part come in any order, hence the lateness.
    closes = F.timestamp_seconds(F.expr("(recording * 4 + win + 1) * 10"))
    samples, fed, out = t.b_lfp.drop("fs").withColumn("closes_at", closes), scratch_folder(t.spark, "samples"), scratch_folder(t.spark, "screened")
    last = samples.agg(F.max("recording")).first()[0] + 1
    for part in range(4):
        samples.filter(F.floor(F.col("recording") * 4 / last) == part).write.mode("append").parquet(fed)
    end = t.spark.range(1).select(F.lit(-1).alias("recording"), F.lit(0).alias("win"), F.lit(0).alias("sample"), F.lit(0).alias("channel"), F.lit(0).alias("shank"), F.lit(0.0).alias("uv"), F.timestamp_seconds(F.lit(last * 400)).alias("closes_at"))
    end.select(*[F.col(f.name).cast(f.dataType) for f in samples.schema.fields]).write.mode("append").parquet(fed)
    # About a part at a time: batches of one file would grow in number with the table, each with all its jobs.
    per_part = -(-len(t.spark.read.parquet(fed).inputFiles()) // 4)
    stream = ST.event_stream(t.spark, fed, max_files=per_part, time=None)
    ST.screen_each_batch(stream, out, scratch_folder(t.spark, "screened-ckpt"), late=f"{10 * last + 60} seconds").awaitTermination()
    return G.rounded(ST.latest_verdicts(t.spark, out).select("recording", "win", "artifact", "activity", "reject_reason"))


@query("t03_stream_discover", """
SELECT CASE o_orderkey % 7 WHEN 0 THEN 'intan' WHEN 5 THEN 'intan' WHEN 2 THEN 'spikeglx' ELSE 'openephys' END AS format, count(*) AS n_folders FROM orders WHERE o_orderkey % 7 IN (0, 2, 3, 4, 5) GROUP BY 1""")
def _t03(t):
    # Listing files that each hold whole recording folders; they arrive in two halves, of as many files as there are partitions.
    listed, out = scratch_folder(t.spark, "listing"), scratch_folder(t.spark, "found")
    spread(t.sql(_LIST).withColumn("folder", F.expr("substring_index(path, '/', 4)")), "folder").drop("folder").write.parquet(listed)
    half = (int(t.spark.conf.get("spark.sql.shuffle.partitions")) + 1) // 2
    stream = ST.event_stream(t.spark, listed, max_files=half, time=None)
    ST.discover_each_batch(stream, out, scratch_folder(t.spark, "found-ckpt")).awaitTermination()
    return ST.found_folders(t.spark, out).groupBy("format").agg(F.count(F.lit(1)).alias("n_folders"))
