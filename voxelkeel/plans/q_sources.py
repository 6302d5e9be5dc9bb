"""Queries over sources and sinks: documents, sidecars, maps, listings, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.operators import placement as P
from voxelkeel.operators import regions as R
from voxelkeel.plans.q_features import stacked
from voxelkeel.plans.q_geometry import planes
from voxelkeel.plans.q_placement import PLACED_SQL, RES, TRACK_SQL, placed_channels, region_sql, track_hits
from voxelkeel.plans.q_trajectory import EVIDENCE
from voxelkeel.plans.registry import query
from voxelkeel.session import scratch_folder
from voxelkeel.sinks import tables as K
from voxelkeel.sources import projects as SP
from voxelkeel.sources import recordings as SR


def _documents(t):
    return K.nest_projects(planes(t), t.b_shanks)


@query("s01_read_projects", """
WITH p AS (SELECT project_id, count(*) AS n_sections FROM b_sections GROUP BY 1), s AS (SELECT project_id, count(DISTINCT probe) AS n_probes FROM b_shanks GROUP BY 1)
SELECT project_id, n_sections, n_probes, CASE project_id % 7 WHEN 3 THEN 'not_a_project' WHEN 4 THEN CASE WHEN n_sections > 0 THEN 'anchoring' END END AS reject_reason,
  CASE WHEN project_id % 7 <> 3 THEN 25e0 END AS resolution_um FROM p FULL JOIN s USING (project_id)""")
def _s01(t):
    # Some documents are broken on purpose: cut short, or with a plane of eight numbers.
    docs = _documents(t).withColumn("doc", F.expr(r"""CASE project_id % 7 WHEN 3 THEN '{"unrelated": 1' WHEN 4 THEN regexp_replace(doc, '"registration":[{]"anchoring":.[-0-9.E]+,', '"registration":{"anchoring":[') ELSE doc END"""))
    p = SP.parse_projects(docs)
    counts = t.b_sections.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_sections"))
    probes = t.b_shanks.groupBy("project_id").agg(F.count_distinct("probe").alias("n_probes"))
    return p.select("project_id", "reject_reason", F.when(F.coalesce("reject_reason", F.lit("")) != "not_a_project", F.col("resolution_um")).alias("resolution_um")).join(
        counts.join(probes, "project_id", "full_outer"), "project_id").select("project_id", "n_sections", "n_probes", "reject_reason", "resolution_um")


@query("s02_project_sections", """
SELECT project_id, slide_idx, section_index, x0, y0, x1, y1, ap_order, slide_number, ap_um, ap_source, rotation_deg, flip_h, CASE WHEN has_reg THEN out_h END AS out_h, CASE WHEN has_reg THEN ox END AS reg_ox, CASE WHEN has_ds THEN vz END AS ds_vz FROM b_sections""")
def _s02(t):
    s = SP.project_tables(SP.parse_projects(_documents(t)))["sections"]
    return s.select("project_id", F.col("slide_idx").cast("long").alias("slide_idx"), "section_index", "x0", "y0", "x1", "y1", "ap_order", "slide_number", "ap_um", "ap_source", "rotation_deg", "flip_h",
                    F.col("out_h").cast("int").alias("out_h"), F.element_at("reg_anchoring", 1).alias("reg_ox"), F.element_at("ds_anchoring", 9).alias("ds_vz"))


@query("k14_save_projects", "SELECT project_id, CAST(probe AS VARCHAR) AS probe, CAST(shank AS BIGINT) AS shank, probe_type, tip_ap, tip_ml, tip_dv, CASE WHEN entry_ap IS NOT NULL THEN entry_dv END AS entry_dv FROM b_shanks")
def _k14(t):
    s = SP.project_tables(SP.parse_projects(_documents(t)))["shanks"]
    return s.select("project_id", "probe", "shank", "probe_type", "tip_ap", "tip_ml", "tip_dv", "entry_dv")


@query("k14_change_and_save", """
SELECT section_index, slide_idx, x0, y1, ap_order, CASE WHEN k % 3 = 0 THEN ap_order * 1e0 ELSE ap_um END AS ap_um, CASE WHEN k % 3 = 0 THEN 'user' ELSE ap_source END AS ap_source, rotation_deg, CASE WHEN has_reg THEN uy END AS reg_uy, CASE WHEN has_ds THEN vz END AS ds_vz,
  CAST(project_id AS VARCHAR) AS spacing, 'kim_mouse_50um' AS atlas_name, 50e0 AS resolution_um FROM b_sections""")
def _k14b(t):
    # Whole documents of another atlas, a third of the sections changed, through files and back.
    docs = _documents(t).withColumn("doc", F.regexp_replace("doc", r'"atlas":\{[^}]*\}', '"atlas":{"name":"kim_mouse_50um","resolution_um":50.0}'))
    docs = docs.withColumn("doc", F.concat(F.lit('{"section_spacing_um":'), "project_id", F.lit(","), F.expr("substring(doc, 2)")))
    change = t.b_sections.filter("k % 3 = 0").select("project_id", "slide_idx", "section_index", (F.col("ap_order") * 1.0).alias("ap_um"), F.lit("user").alias("ap_source"))
    out = scratch_folder(t.spark, "projects")
    K.save_projects(K.change_projects(SP.parse_projects(docs), sections=change), out)
    back = SP.read_saved_projects(t.spark, out)
    s = SP.project_tables(back)["sections"].join(back.select("project_id", F.col("section_spacing_um").cast("long").cast("string").alias("spacing"), "atlas_name"), "project_id")
    return s.select("section_index", F.col("slide_idx").cast("long").alias("slide_idx"), "x0", "y1", "ap_order", "ap_um", "ap_source", "rotation_deg", F.element_at("reg_anchoring", 5).alias("reg_uy"), F.element_at("ds_anchoring", 9).alias("ds_vz"), "spacing", "atlas_name", "resolution_um")


_SIDE = """SELECT o_orderkey AS `Row No`, concat('m', CAST(o_custkey AS STRING)) AS `Animal`, CASE WHEN o_orderkey % 3 = 0 THEN '2024_01_09' ELSE '9-1-24' END AS `Session date`, concat('run', CAST(o_orderkey % 4 AS STRING)) AS `Session`,
  'ProbeA' AS `Probe Label`, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(o_orderkey % 5000 AS STRING) END AS `Insertion  Depth`, concat('x (', o_orderpriority, ')') AS `Tracer`, o_orderstatus AS `Rig` FROM orders"""


@query("s03_read_sidecar", """
SELECT o_orderkey AS row_no, concat('m', CAST(o_custkey AS VARCHAR)) AS subject, CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-09' END AS day, concat('run', CAST(o_orderkey % 4 AS VARCHAR)) AS recording, 'ProbeA' AS probe,
  CASE WHEN o_orderkey % 4 > 1 THEN o_orderkey % 5000 + 0e0 END AS insertion_depth_um, lower(o_orderpriority) AS dye, o_orderstatus AS rig FROM orders""")
def _s03(t):
    df = SR.normalise_sidecar(t.sql(_SIDE))
    return df.select(F.col("Row No").alias("row_no"), "subject", F.col("date").cast("string").alias("day"), "recording", "probe", "insertion_depth_um", "dye", F.col("Rig").alias("rig"))


_CELL_ROWS = """SELECT l_orderkey * 10 + l_linenumber AS pos, CAST(floor(l_partkey / 100) AS BIGINT) AS project_id, l_partkey % 100 AS slice_id, CASE WHEN l_quantity < 4 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS x_px,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) AS y_px, CAST(l_suppkey AS STRING) AS ap_um, '10' AS ml_um, '20.5' AS dv_um, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS cell_type, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'CA1' END AS region_acronym FROM lineitem"""
_PLACEMENT = "SELECT project_id, section_index AS slice_id, section_index + 1000 AS section_index, 0.5e0 + k % 3 * 0.25e0 AS factor FROM b_sections WHERE k % 5 <> 0"


@query("s04_read_cells", f"""
SELECT c.pos, p.section_index, CASE WHEN p.section_index IS NOT NULL AND x_px <> '' THEN (CAST(nullif(x_px, '') AS DOUBLE) + 0.5) * factor - 0.5 END AS x_px, CASE WHEN p.section_index IS NOT NULL AND x_px <> '' THEN (CAST(y_px AS DOUBLE) + 0.5) * factor - 0.5 END AS y_px,
  CAST(ap_um AS DOUBLE) AS ap_um, coalesce(nullif(cell_type, ''), 'cell') AS cell_type, nullif(region_acronym, '') AS region FROM ({_CELL_ROWS.replace('AS STRING', 'AS VARCHAR')}) c LEFT JOIN ({_PLACEMENT}) p ON p.project_id = c.project_id AND p.slice_id = c.slice_id""")
def _s04(t):
    return SP.place_cells(t.sql(_CELL_ROWS), t.sql(_PLACEMENT)).select("pos", "section_index", "x_px", "y_px", "ap_um", "cell_type", "region")


_QSEC = """SELECT project_id AS series, CASE WHEN k % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE 200 - section_index END AS nr, concat('img_s', CAST(200 - section_index AS STRING), '.png') AS filename, out_w AS width, out_h AS height,
  CASE WHEN k % 11 <> 5 THEN ARR[ox, oy, oz, ux, uy, uz, vx, vy, vz] END AS anchoring, CAST(NULL AS STRING) AS markers FROM b_sections"""


@query("k12_write_quicknii", """
SELECT project_id AS series, 'allen_mouse' AS atlas, 200 - section_index AS series_number, CAST(row_number() OVER (PARTITION BY project_id ORDER BY 200 - section_index) AS INT) AS position, concat('img_s', CAST(200 - section_index AS VARCHAR), '.png') AS filename, out_w AS width, ox AS o0, vz AS v2 FROM b_sections WHERE k % 11 <> 5""")
def _k12(t):
    docs = K.quicknii_documents(t.sql(_QSEC))
    out = SP.parse_quint(docs)
    return out.select("series", "atlas", "series_number", "position", "filename", F.col("width").cast("int").alias("width"), F.element_at("anchoring", 1).alias("o0"), F.element_at("anchoring", 9).alias("v2"))


@query("s05_read_quint_series", """
SELECT project_id AS series, 'kim_mouse' AS atlas, 200 - section_index AS series_number, CAST(row_number() OVER (PARTITION BY project_id ORDER BY 200 - section_index) AS INT) AS position, ox AS o0 FROM b_sections WHERE k % 11 <> 5""")
def _s05(t):
    docs = t.sql(_QSEC).groupBy("series").agg(F.collect_list(F.struct("filename", "width", "height", F.col("anchoring").alias("ouv"))).alias("sections"))
    docs = docs.select("series", F.to_json(F.struct(F.lit("Kim_Mouse_25um").alias("target"), "sections")).alias("doc"))
    return SP.parse_quint(docs).select("series", "atlas", "series_number", "position", F.element_at("anchoring", 1).alias("o0"))


@query("s06_read_slicereg_series", """
SELECT project_id, section_index AS slice_id, 2e0 + project_id % 3 * 0.5e0 + 1 AS project_pixel_um, round((2e0 + k % 2 + project_id % 3 * 0.5e0) / (3e0 + project_id % 3 * 0.5e0), 9) + 0e0 AS factor, 25e0 AS res_um FROM b_sections""")
def _s06(t):
    slices = t.sql("SELECT project_id, section_index AS slice_id, 2e0 + k % 2 + project_id % 3 * 0.5e0 AS pixel_um, out_w AS image_w, out_h AS image_h FROM b_sections")
    aligned = t.sql("SELECT project_id, section_index AS slice_id, out_w AS align_w, out_h AS align_h, 'allen_mouse_25um' AS atlas FROM b_sections")
    out = SP.slicereg_series(slices, aligned)
    return G.rounded(out.select("project_id", "slice_id", "project_pixel_um", "factor", SP.atlas_resolution(F.col("atlas")).alias("res_um")), 9)


@query("s07_read_channel_map", """
SELECT recording AS map_id, CAST(row_number() OVER (PARTITION BY recording ORDER BY CASE WHEN recording % 3 <> 0 THEN 31 - channel END, channel) - 1 AS INT) AS channel, axial_um AS depth_um, CASE WHEN channel % 5 = 0 THEN 0e0 ELSE x_um END AS x_um,
  CASE WHEN recording % 2 = 0 THEN CAST(shank_id AS INT) END AS shank FROM b_channels""")
def _s07(t):
    # Of every second map the first channel it has lacks its shank, of every third its number, however few channels a map has.
    rows = t.sql("""SELECT recording AS map_id, channel AS row_no, CAST(axial_um AS STRING) AS `Y_um`, CASE WHEN channel % 5 = 0 THEN ' ' ELSE CAST(x_um AS STRING) END AS x, CASE WHEN recording % 2 = 0 OR channel > first THEN CAST(shank_id AS STRING) ELSE '' END AS `group`,
      CASE WHEN recording % 3 = 0 AND channel = first THEN NULL ELSE CAST(31 - channel AS STRING) END AS chan FROM (SELECT *, min(channel) OVER (PARTITION BY recording) AS first FROM b_channels) c""")
    return SR.channel_map(rows)


@query("s08_read_rhx_probe_map", """
SELECT recording AS map_id, channel AS channel, CAST(shank_id AS INT) AS shank_page, x_um, axial_um + 40 AS depth_um FROM b_channels""")
def _s08(t):
    site = F.format_string('<ElectrodeSite channelNumber="%d" x="%s" y="%s"/>', "channel", F.col("x_um").cast("string"), F.col("axial_um").cast("string"))
    pages = t.b_channels.groupBy("recording", "shank_id").agg(F.concat_ws("", F.array_sort(F.collect_list(site))).alias("s"))
    page = F.format_string('<Page name="%d"><Line y1="-40" y2="10"/><Line y1="0" y2="5"/><Port name="A">%s</Port></Page>', "shank_id", "s")
    docs = pages.groupBy("recording").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("shank_id", page.alias("p")))), lambda x: x["p"])).alias("b"))
    out = SR.parse_rhx_map(docs.select(F.col("recording").alias("map_id"), F.concat(F.lit("<ProbeMapSettings>"), "b", F.lit("</ProbeMapSettings>")).alias("doc")))
    return out.select("map_id", F.col("channel").cast("int").alias("channel"), F.coalesce("shank", F.lit(0)).alias("shank_page"), "x_um", "depth_um")


_LIST = """SELECT concat('/d/', CAST(o_custkey % 300 AS STRING), '/', CAST(o_orderkey AS STRING), leaf) AS path, is_dir FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 7
  WHEN 0 THEN CASE e WHEN 0 THEN '/info.rhd' ELSE '/amp.dat' END WHEN 1 THEN CASE e WHEN 0 THEN '/a.rhd' ELSE '/b.rhs' END WHEN 2 THEN CASE e WHEN 0 THEN '/g0/x_t0.imec0.ap.meta' ELSE '/g0/x_t0.imec0.ap.bin' END
  WHEN 3 THEN CASE e WHEN 0 THEN '/Record Node 101/structure.oebin' ELSE '/Record Node 101/experiment1/recording1' END WHEN 4 THEN CASE e WHEN 0 THEN '/experiment2/recording1' ELSE '/experiment2/recording1/structure.oebin' END
  WHEN 5 THEN CASE e WHEN 0 THEN '/x.zarr/info.rhd' ELSE '/only.rhs' END ELSE CASE e WHEN 0 THEN '/y.imec0.meta' ELSE '/z.bin' END END AS leaf, (o_orderkey % 7 = 3 AND e = 1) OR (o_orderkey % 7 = 4 AND e = 0) AS is_dir FROM (SELECT o_orderkey, o_custkey, SEQ[0;1] AS e FROM orders) q) r"""


@query("s09_find_recordings", """
SELECT concat('/d/', CAST(o_custkey % 300 AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 7 = 3 THEN '/Record Node 101' ELSE '' END) AS dir,
  CASE o_orderkey % 7 WHEN 0 THEN 'intan' WHEN 5 THEN 'intan' WHEN 2 THEN 'spikeglx' ELSE 'openephys' END AS format FROM orders WHERE o_orderkey % 7 IN (0, 2, 3, 4, 5)""")
def _s09(t):
    return SR.find_recordings(t.sql(_LIST))


# The same folders ten levels down, below one whose name merely contains ".zarr".
_DEEP = "/mnt/a/b/c/d/e/f/g/my.zarr_export/"


@query("s09_find_deep_recordings", f"""
SELECT concat('{_DEEP}d/', CAST(o_custkey % 300 AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 7 = 3 THEN '/Record Node 101' ELSE '' END) AS dir,
  CASE o_orderkey % 7 WHEN 0 THEN 'intan' WHEN 5 THEN 'intan' WHEN 2 THEN 'spikeglx' ELSE 'openephys' END AS format FROM orders WHERE o_orderkey % 7 IN (0, 2, 3, 4, 5)""")
def _s09b(t):
    listing = t.sql(_LIST.replace("'/d/'", f"'{_DEEP}d/'"))
    return SR.find_recordings(listing.unionByName(listing.withColumn("path", F.concat(F.lit("/elsewhere"), "path"))), root="/mnt/a/b")


@query("s13_atlas_tables", """
SELECT acronym, name, len(path) AS tree_depth, count(*) AS n_voxels, min(i_dv) AS top, count(*) * 0.015625e0 AS volume_mm3 FROM b_annotation JOIN b_structures s ON s.id = structure_id WHERE structure_id > 0 GROUP BY 1, 2, 3""")
def _s13(t):
    v = SR.labelled_voxels(t.b_annotation, t.b_structures)
    return v.groupBy("acronym", "name", "tree_depth").agg(F.count(F.lit(1)).alias("n_voxels"), F.min("i_dv").alias("top"), (F.count(F.lit(1)) * 0.25 ** 3).alias("volume_mm3"))


_RECMAPS = "SELECT c_custkey AS recording, CASE c_custkey % 3 WHEN 0 THEN 'NeuroNexus A1x32-Poly3 + A32>RHD2132' WHEN 1 THEN 'NeuroNexus A1x32-Poly2 + A32>RHD2132' ELSE 'Neuropixels 1.0' END AS probe_map, CASE WHEN c_custkey % 3 = 2 THEN 384 ELSE 32 END AS n_channels FROM customer"
_POLY2 = "[375, 425, 475, 525, 575, 625, 675, 725, 775, 825, 325, 275, 225, 175, 125, 75, 100, 150, 200, 250, 300, 350, 850, 800, 750, 700, 650, 600, 550, 500, 450, 400]"


@query("s15_wired_maps", f"""
WITH p AS (SELECT CAST(unnest(generate_series(0, 31)) AS INT) AS pin, unnest([30, 26, 21, 17, 27, 22, 20, 25, 28, 23, 19, 24, 29, 18, 31, 16, 0, 15, 2, 13, 8, 9, 7, 1, 6, 14, 10, 11, 5, 12, 4, 3]) AS channel),
m AS (SELECT 'NeuroNexus A1x32-Poly3 + A32>RHD2132' AS probe_map, channel, 62 + CASE WHEN pin < 10 THEN 12.5e0 + 25 * pin WHEN pin < 16 THEN 50e0 * (pin - 10) WHEN pin < 22 THEN 275e0 - 50 * (pin - 16) ELSE 237.5e0 - 25 * (pin - 22) END AS depth_um, CASE WHEN pin < 10 THEN -18e0 WHEN pin < 22 THEN 0e0 ELSE 18e0 END AS x_um FROM p
  UNION ALL SELECT 'NeuroNexus A1x32-Poly2 + A32>RHD2132', channel, {_POLY2}[pin + 1] * 1e0, CASE WHEN pin < 16 THEN -21.5e0 ELSE 21.5e0 END FROM p
  UNION ALL SELECT 'Neuropixels 1.0', CAST(c AS INT), 220 + (c // 2) * 20e0, CASE WHEN (c // 2) % 2 = 0 THEN 27e0 ELSE 11e0 END + (c % 2) * 32 - 35 FROM range(384) z(c))
SELECT recording, channel, depth_um, x_um FROM ({_RECMAPS}) r JOIN m USING (probe_map)""")
def _s15(t):
    catalog = P.probe_layouts(t.spark).select(F.col("layout").alias("map_name"), "channel", F.col("depth_from_tip_um").alias("depth_um"), F.col("lateral_um").alias("x_um"))
    return SR.resolve_map(t.sql(_RECMAPS), SR.wired_maps(t.spark), catalog).select("recording", "channel", "depth_um", "x_um")


@query("s16_geometry_resolution", """
SELECT recording, channel, CASE WHEN recording % 3 = 0 THEN 'recording' WHEN recording % 3 = 1 THEN 'probe_map' ELSE 'channel_index' END AS geometry_source,
  CASE WHEN recording % 3 = 0 THEN axial_um WHEN recording % 3 = 1 THEN axial_um + 7 ELSE channel END AS depth_um, recording % 3 <> 2 AS usable FROM b_channels""")
def _s16(t):
    c = t.b_channels.select("recording", "channel")
    stored = t.b_channels.filter("recording % 3 = 0").select("recording", "channel", F.col("axial_um").alias("depth_um"), "x_um")
    supplied = t.b_channels.filter("recording % 3 < 2").select("recording", "channel", (F.col("axial_um") + 7).alias("depth_um"), "x_um")
    good, bad = SR.usable_geometry(SR.geometry_resolution(c, stored, supplied))
    all_rows = SR.geometry_resolution(c, stored, supplied).join(bad.select("recording", F.lit(False).alias("_u")), "recording", "left")
    return all_rows.select("recording", "channel", "geometry_source", "depth_um", F.coalesce("_u", F.lit(True)).alias("usable"))


# --- sinks --------------------------------------------------------------------------------------


def _located(t):
    return R.region_at_point(placed_channels(t), t.b_annotation, t.b_structures, resolution_um=RES)


@query("k04_export_ibl_json", f"""WITH {PLACED_SQL}, {region_sql('placed', 'hit').strip()}
SELECT probe, shank, CAST(count(*) AS INT) AS n_channels, max(CASE WHEN channel = 3 THEN coalesce(nullif(region, ''), 'void') END) AS region_3, max(CASE WHEN channel = 3 THEN region_id END) AS region_id_3 FROM hit GROUP BY 1, 2""")
def _k04(t):
    docs = K.ibl_documents(_located(t))
    return docs.select("probe", "shank", "n_channels", F.get_json_object("document", "$.channel_3.brain_region").alias("region_3"), F.get_json_object("document", "$.channel_3.brain_region_id").cast("int").alias("region_id_3"))


@query("k05_merge_alignment_history", """
WITH o AS (SELECT o_orderkey % 3000 AS shank_key, CAST(o_orderkey // 3000 AS VARCHAR) AS stamp, 1e0 * (o_orderkey % 13) AS f FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey % 3000 AS shank_key, CAST(o_orderkey // 3000 AS VARCHAR) AS stamp, 2e0 * (o_orderkey % 13) + 100 AS f FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 = 0)
SELECT shank_key, stamp, coalesce(n.f, o.f) AS first_feature FROM o FULL JOIN n USING (shank_key, stamp)""")
def _k05(t):
    base = t.orders.select((F.col("o_orderkey") % 3000).alias("shank_key"), F.floor(F.col("o_orderkey") / 3000).cast("string").alias("stamp"), "o_orderkey")
    v = F.col("o_orderkey") % 13
    old = base.filter("o_orderkey % 3 <> 0").select("shank_key", "stamp", F.array(v * 1.0, F.lit(9e3)).alias("feature_um"), F.array(v * 1.0, F.lit(9e3)).alias("track_um"))
    f = v * 2.0 + 100.0
    new = base.filter("o_orderkey % 5 = 0").select("shank_key", "stamp", F.when(F.col("o_orderkey") % 2 == 0, F.array(f, F.lit(9e3))).otherwise(F.array(f)).alias("feature_um"), F.array(f, F.lit(9e3)).alias("track_um"))
    return K.merge_history(old, new).select("shank_key", "stamp", F.get("feature_um", F.lit(0)).alias("first_feature"))


@query("k06_export_depth_features")
def _k06(t):
    rows = K.depth_feature_rows(stacked(t).withColumn("reference_um", F.lit(4000.0)), ["penetration", "shank"])
    return rows.select("penetration", "shank", F.size("depth_from_tip_um").alias("n_depths"), F.size("freqs_hz").alias("n_freqs"), F.get("depth_below_um", F.lit(0)).alias("first_below_um"), F.size("psd").alias("n_rows"))


@query("k07_fit_store", f"""
WITH e AS ({EVIDENCE}), f AS (SELECT probe, substr(sha256(string_agg(printf('%05d:%012.3f:%.6f', shank, depth_from_tip_um, weight), ',' ORDER BY printf('%05d:%012.3f:%.6f', shank, depth_from_tip_um, weight))), 1, 16) AS fingerprint FROM e GROUP BY 1)
SELECT probe, fingerprint, probe % 4 <> 1 AS reusable FROM f""")
def _k07(t):
    ev = t.sql(EVIDENCE)
    now = K.evidence_fingerprint(ev, ["probe"])
    fits = now.withColumn("fingerprint", F.when(F.col("probe") % 4 == 1, F.lit("0" * 16)).otherwise(F.col("fingerprint")))
    keep = K.reusable_fits(fits, ev, ["probe"]).select("probe", F.lit(True).alias("_r"))
    return now.join(keep, "probe", "left").select("probe", "fingerprint", F.coalesce("_r", F.lit(False)).alias("reusable"))


_EXPORTS = "SELECT o_orderkey AS export, concat('/p/', CAST(o_custkey AS STRING), '.json') AS source_path, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'old' ELSE concat('doc', CAST(o_custkey AS STRING)) END AS body FROM orders"


@query("k08_provenance", f"""
WITH e AS (SELECT export, source_path, sha256(body) AS h FROM ({_EXPORTS}) q), s AS (SELECT concat('/p/', CAST(c_custkey AS VARCHAR), '.json') AS source_path, sha256(concat('doc', CAST(c_custkey AS VARCHAR))) AS now FROM customer WHERE c_custkey % 3 <> 0),
v AS (SELECT export, CASE WHEN h IS NULL THEN 'unreadable' WHEN now IS NULL THEN 'source_missing' WHEN now = h THEN 'up_to_date' ELSE 'stale' END AS verdict FROM e LEFT JOIN s USING (source_path)) SELECT export, verdict, verdict = 'stale' AS stale FROM v""")
def _k08(t):
    exports = t.sql(_EXPORTS).select("export", "source_path", F.sha2("body", 256).alias("source_sha256"))
    sources = t.customer.filter("c_custkey % 3 <> 0").select(F.concat(F.lit("/p/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("source_path"),
                                                             F.sha2(F.concat(F.lit("doc"), F.col("c_custkey").cast("string")), 256).alias("sha256"))
    return K.staleness(exports, sources).select("export", "verdict", "stale")


@query("k09_series_manifest", """
SELECT project_id, section_index, CAST(row_number() OVER (PARTITION BY project_id ORDER BY ap_order, section_index) AS INT) AS position, round(CASE WHEN has_reg THEN (ox + ux / 2 + vx / 2) * 25 WHEN has_ds THEN (ox + 1 + ux / 2 + vx / 2) * 25 ELSE ap_um END, 6) + 0e0 AS manifest_ap_um,
  CASE WHEN has_reg THEN 'registration' WHEN has_ds THEN 'deepslice' ELSE ap_source END AS manifest_source, rotation_deg AS baked_deg, round(CASE WHEN has_ds THEN degrees(atan2(uy, abs(uz))) - rotation_deg ELSE 0 END, 6) + 0e0 AS residual_deg, CASE WHEN NOT has_reg THEN 'not_registered' END AS skip_reason FROM b_sections""")
def _k09(t):
    return G.rounded(K.series_manifest(planes(t)))


@query("k10_section_summary", """
SELECT project_id, section_index, x1 - x0 AS width_px, y1 - y0 AS height_px, CASE WHEN has_reg THEN 'registration' WHEN has_ds THEN 'deepslice' WHEN ap_um IS NOT NULL THEN ap_source END AS plane_source, k % 13 = 4 AS recut FROM b_sections""")
def _k10(t):
    now = K.section_summary(planes(t))
    before = K.section_summary(planes(t).withColumn("x1", F.col("x1") + F.when(F.col("k") % 13 == 4, 3).otherwise(0)))
    cut = K.needs_recut(before, now).withColumn("_c", F.lit(True))
    return now.join(cut, ["project_id", "section_index"], "left").select("project_id", "section_index", "width_px", "height_px", "plane_source", F.coalesce("_c", F.lit(False)).alias("recut"))


@query("k11_attach_recordings", """
WITH ex AS (SELECT recording AS probe, concat('/r/', CAST(recording AS VARCHAR)) AS path, stream, CAST(NULL AS BIGINT) AS first_electrode, CAST(NULL AS BIGINT) AS last_electrode, 15e0 AS bank_offset_um FROM b_recordings WHERE recording % 4 = 0)
SELECT * FROM ex UNION ALL SELECT recording, concat('/r/', CAST(recording AS VARCHAR)), stream, CASE WHEN recording % 3 <> 1 THEN first_electrode END, CASE WHEN recording % 3 <> 1 AND first_electrode IS NOT NULL THEN last_electrode END, 0e0 FROM b_recordings WHERE recording % 4 <> 0""")
def _k11(t):
    r = t.b_recordings.select(F.col("recording").alias("probe"), F.concat(F.lit("/r/"), F.col("recording").cast("string")).alias("path"), "stream", F.col("first_electrode").cast("long").alias("first_electrode"), F.col("last_electrode").cast("long").alias("last_electrode"))
    existing = r.filter("probe % 4 = 0").withColumns({"first_electrode": F.lit(None).cast("long"), "last_electrode": F.lit(None).cast("long"), "bank_offset_um": F.lit(15.0)})
    shanks = r.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("first_electrode", F.when((F.col("probe") % 3 == 1) & (F.col("s") == 1), F.col("first_electrode") + 5).otherwise(F.col("first_electrode")))
    return K.attach_recordings(existing, shanks)


@query("k13_herbs_table", f"""WITH {TRACK_SQL}
SELECT k, CAST(sample AS BIGINT) AS position, region AS label, round(13200 / 10 - 1 - ap / 10, 6) + 0e0 AS vox_ap, round(11400 / 10 - 1 - ml / 10, 6) + 0e0 AS vox_ml, round(dv / 10, 6) + 0e0 AS vox_dv FROM hit""")
def _k13(t):
    voxels, runs = K.herbs_tables(track_hits(t), ["k"], "sample")
    labels = R.unroll_labels(runs, ["k"])
    return G.rounded(voxels.select("k", F.col("sample").alias("position"), "vox_ap", "vox_ml", "vox_dv").join(labels, ["k", "position"]).select("k", "position", "label", "vox_ap", "vox_ml", "vox_dv"))
