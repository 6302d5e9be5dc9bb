"""Export tables: what each file holds, as DataFrames; writing is one call on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.schemas import DOCUMENT_FIELDS, PARTS

REGION_COLUMNS = ("region", "region_id", "region_color")


def _selected(placed: DataFrame, probe: str | None) -> DataFrame:
    return placed if probe is None else placed.filter(F.col("probe") == probe)


def channel_table(placed: DataFrame, *, probe=None, regions: bool = True) -> DataFrame:
    """One row per channel in CCF um (2 decimals), with its depth source and region."""
    rows = _selected(placed, probe).select(
        "probe", "shank", "channel", "ap_um", "ml_um", "dv_um", "depth_source", *(REGION_COLUMNS if regions else ()))
    return G.rounded(rows, 2)


def paxinos_table(placed: DataFrame, *, alignment: str = "qiu2018", probe=None, regions: bool = True) -> DataFrame:
    """K01's rows in stereotaxic mm (3 decimals); regions were looked up before conversion.

    An atlas without a bregma anchor fails the job.
    """
    moved = G.to_paxinos(_selected(placed, probe), alignment, bregma=G.require_bregma(F.col("atlas_name")))
    return G.rounded(moved.select("probe", "shank", "channel", "ap_mm", "ml_mm", "dv_mm", "depth_source",
                                  *(REGION_COLUMNS if regions else ())), 3)


def write_csv(table: DataFrame, path: str, *, order=("probe", "shank", "channel"), decimals: int = 2) -> None:
    """Write an export ordered by its keys; numbers become text only here."""
    text = {f.name: F.format_string(f"%.{decimals}f", f.name) for f in table.schema.fields
            if f.dataType.typeName() == "double"}
    # A range-partitioned sort: ordered part files, no single writer.
    table.orderBy(*order).withColumns(text).write.mode("overwrite").csv(path, header=True)


def export_all(placed: DataFrame, other_atlas: DataFrame | None, out_dir: str) -> dict[str, DataFrame]:
    """CCF with regions, Paxinos, and CCF with a second atlas's names where there is one.

    The placement is written once and the three exports read that, instead of placing thrice.
    """
    placed.write.mode("overwrite").parquet(f"{out_dir}/placement")
    rows = placed.sparkSession.read.parquet(f"{out_dir}/placement")
    tables = {"ccf": channel_table(rows), "paxinos": paxinos_table(rows)}
    if other_atlas is not None:
        named = other_atlas.select("probe", "shank", "channel", *REGION_COLUMNS)
        tables["ccf_other_atlas"] = channel_table(rows.drop(*REGION_COLUMNS).join(named, ["probe", "shank", "channel"]))
    for name, table in tables.items():
        write_csv(table, f"{out_dir}/{name}", decimals=3 if name == "paxinos" else 2)
    return tables


def ibl_documents(placed: DataFrame) -> DataFrame:
    """One JSON document per shank: an origin block and ``channel_<i>`` entries in Allen um.

    A shank's sites (a few hundred) are the document; shanks are the groups.
    """
    entry = F.struct(F.round("ml_um", 2).alias("x"), F.round("ap_um", 2).alias("y"), F.round("dv_um", 2).alias("z"), F.col("depth_from_tip_um").alias("axial"),
                     F.col("lateral_um").alias("lateral"), F.coalesce(F.nullif("region", F.lit("")), F.lit("void")).alias("brain_region"), F.col("region_id").alias("brain_region_id"))
    per = placed.groupBy("probe", "shank").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", entry.alias("e"))))).alias("_m"))
    named = F.transform_keys("_m", lambda k, _: F.concat(F.lit("channel_"), k.cast("string")))
    origin = F.to_json(F.struct(F.struct(F.lit("allen_ccf_um").alias("bregma")).alias("origin")))
    body = F.concat(F.expr("substring(_o, 1, length(_o) - 1)"), F.lit(","), F.expr("substring(_j, 2, length(_j))"))
    return per.withColumns({"_o": origin, "_j": F.to_json(named)}).select("probe", "shank", F.size("_m").alias("n_channels"), body.alias("document"))


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Alignment history upsert by (shank, stamp); only entries with two landmarks or more count."""
    usable = new.filter(F.size("feature_um") >= 2)
    o, n = old.alias("o"), usable.alias("n")
    return o.join(n, ["shank_key", "stamp"], "full_outer").select(
        "shank_key", "stamp", F.coalesce("n.feature_um", "o.feature_um").alias("feature_um"), F.coalesce("n.track_um", "o.track_um").alias("track_um"))


def depth_feature_rows(psd: DataFrame, keys: list[str], landmarks: DataFrame | None = None, *, reference: str = "reference_um") -> DataFrame:
    """One nested row per shank: frequencies, depths from tip and below the surface, and the map.

    A shank's map is its few hundred depths times frequencies. ``landmarks`` is left out on
    reload unless asked for, by selecting without it.
    """
    rows = psd.groupBy(*keys, reference, "depth_um").agg(F.array_sort(F.collect_list(F.struct("freq_hz", "power"))).alias("_f"))
    out = rows.groupBy(*keys, reference).agg(F.array_sort(F.collect_list(F.struct("depth_um", "_f"))).alias("_d"))
    out = out.select(*keys, F.col("_d.depth_um").alias("depth_from_tip_um"), F.expr(f"transform(_d, d -> {reference} - d.depth_um)").alias("depth_below_um"),
                     F.expr("_d[0]._f.freq_hz").alias("freqs_hz"), F.expr("transform(_d, d -> d._f.power)").alias("psd"))
    return out if landmarks is None else out.join(landmarks, keys, "left")


def evidence_fingerprint(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """16 hex digits over a probe's shanks, depths (3 decimals) and weights (6), in order."""
    item = F.concat_ws(":", F.format_string("%05d", "shank"), F.format_string("%012.3f", "depth_from_tip_um"), F.format_string("%.6f", "weight"))
    text = F.concat_ws(",", F.array_sort(F.collect_list(item)))
    return evidence.groupBy(*keys).agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def reusable_fits(fits: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Stored fits whose fingerprint equals the current evidence's."""
    return fits.join(evidence_fingerprint(evidence, keys), [*keys, "fingerprint"], "left_semi")


def source_digests(spark, glob: str) -> DataFrame:
    """Path, SHA-256 and modification time of source documents."""
    return spark.read.format("binaryFile").load(glob).select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("sha256"), "modificationTime")


def staleness(exports: DataFrame, sources: DataFrame) -> DataFrame:
    """An export is stale only if its source still exists with another digest."""
    s = sources.select("source_path", F.col("sha256").alias("_now"))
    verdict = F.expr("""CASE WHEN source_sha256 IS NULL THEN 'unreadable' WHEN _now IS NULL THEN 'source_missing' WHEN _now = source_sha256 THEN 'up_to_date' ELSE 'stale' END""")
    return exports.join(s, "source_path", "left").withColumn("verdict", verdict).withColumn("stale", F.col("verdict") == "stale").drop("_now")


def series_manifest(sections: DataFrame) -> DataFrame:
    """Sections in series order with AP, its source and rotations; unplaced ones say why they are skipped."""
    from pyspark.sql import Window
    df = G.section_plane_values(sections)
    placed = F.coalesce("reg_anchoring", "ds_anchoring").isNotNull()
    order = Window.partitionBy("project_id").orderBy("ap_order", "section_index")
    return df.select("project_id", "section_index", F.row_number().over(order).alias("position"), F.coalesce("plane_ap_um", "ap_um").alias("manifest_ap_um"),
                     F.when(F.col("reg_anchoring").isNotNull(), "registration").when(placed, "deepslice").otherwise(F.col("ap_source")).alias("manifest_source"),
                     F.col("rotation_deg").alias("baked_deg"), G.straighten_angle(F.col("ds_anchoring"), F.col("rotation_deg")).alias("residual_deg"),
                     F.when(F.col("reg_anchoring").isNull(), "not_registered").alias("skip_reason"))


def section_summary(sections: DataFrame) -> DataFrame:
    """Readable record per section with its crop key; plane from registration, prediction or assignment."""
    df = G.section_plane_values(sections)
    source = F.when(F.col("reg_anchoring").isNotNull(), "registration").when(F.col("ds_anchoring").isNotNull(), "deepslice").when(F.col("ap_um").isNotNull(), F.col("ap_source"))
    return df.select("project_id", "section_index", (F.col("x1") - F.col("x0")).alias("width_px"), (F.col("y1") - F.col("y0")).alias("height_px"),
                     F.round(F.coalesce("plane_ap_um", "ap_um"), 2).alias("plane_ap"), F.round("pitch_deg", 2).alias("plane_pitch"), source.alias("plane_source"), crop_key().alias("crop_key"))


def crop_key():
    """What a section's image is cut by."""
    return F.struct("x0", "y0", "x1", "y1", "flip_h", "rotation_deg")


def needs_recut(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections whose crop key changed, or that are new."""
    o = old.select("project_id", "section_index", F.col("crop_key").alias("_o"))
    return new.join(o, ["project_id", "section_index"], "left").filter(~F.col("_o").eqNullSafe(F.col("crop_key"))).select("project_id", "section_index")


def attach_recordings(existing: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen recordings not yet on the probe (by path and stream), bank offset 0; an electrode range
    only where all its shanks agree."""
    fresh = chosen.join(existing.select("probe", "path", "stream"), ["probe", "path", "stream"], "left_anti")
    one = fresh.groupBy("probe", "path", "stream").agg(
        F.count_distinct(F.struct("first_electrode", "last_electrode")).alias("_k"), F.count("first_electrode").alias("_f"), F.count(F.lit(1)).alias("_n"), F.min("first_electrode").alias("_a"), F.min("last_electrode").alias("_b"))
    agree = (F.col("_k") == 1) & (F.col("_f") == F.col("_n"))
    new = one.select("probe", "path", "stream", F.when(agree, F.col("_a")).alias("first_electrode"), F.when(agree, F.col("_b")).alias("last_electrode"), F.lit(0.0).alias("bank_offset_um"))
    return existing.select(*new.columns).unionByName(new)


def quicknii_documents(sections: DataFrame, *, target: str = "ABA_Mouse_CCFv3") -> DataFrame:
    """One QuickNII document per series; absent values are left out."""
    item = F.struct("nr", "filename", "width", "height", "anchoring", "markers")
    doc = F.struct(F.lit(target).alias("target"), F.array(F.lit(456), F.lit(528), F.lit(320)).alias("target-resolution"), F.array_sort(F.collect_list(item)).alias("slices"))
    return sections.groupBy("series").agg(doc.alias("_d")).select("series", F.to_json("_d", {"ignoreNullFields": "true"}).alias("doc"))


def herbs_tables(samples: DataFrame, keys: list[str], position: str, *, grid_um: int = 10) -> tuple[DataFrame, DataFrame]:
    """Samples as HERBS voxels, and their run-length region labels per shank."""
    from voxelkeel.operators.regions import run_length_labels
    return G.ccf_to_herbs(samples, grid_um), run_length_labels(samples, keys, position, "region")


def nest_projects(sections: DataFrame, shanks: DataFrame) -> DataFrame:
    """New project documents (``project_id, doc``) from flat sections and shanks, built bottom up.

    For documents that exist already see :func:`change_projects`, which keeps what it doesn't change.
    A project has some hundred sections and a few dozen shanks.
    """
    axes = ("ap", "ml", "dv")
    sec = F.struct(F.col("section_index").alias("index"), "slide_idx", F.array("x0", "y0", "x1", "y1").alias("bbox_px"), "ap_order", "slide_number",
                   F.when(F.col("ap_um").isNotNull(), F.struct("ap_um")).alias("plane"), "ap_source", "rotation_deg", F.col("ds_anchoring").alias("deepslice_anchoring"),
                   F.when(F.col("reg_anchoring").isNotNull(), F.struct(F.col("reg_anchoring").alias("anchoring"), F.array("out_h", "out_w").alias("output_size_px"))).alias("registration"), "flip_h")
    slides = sections.groupBy("project_id", "slide_idx").agg(F.array_sort(F.collect_list(F.struct("section_index", sec.alias("s")))).alias("_s"))
    slides = slides.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("slide_idx", F.struct(F.lit("").alias("image_path"), F.col("_s.s").alias("sections")).alias("d")))).alias("_d"))
    ccf = lambda end: F.when(F.col(f"{end}_ap").isNotNull(), F.array(*[f"{end}_{a}" for a in axes])).alias(f"{end}_ccf_um")
    sh = F.struct(F.col("shank").alias("index"), ccf("tip"), ccf("entry"))
    probes = shanks.groupBy("project_id", "probe", "probe_type").agg(F.array_sort(F.collect_list(F.struct("shank", sh.alias("s")))).alias("_s"))
    probe = F.struct(F.col("probe").cast("string").alias("label"), F.struct(F.col("probe_type").alias("name"), F.size("_s").alias("n_shanks")).alias("type"), F.col("_s.s").alias("shanks"))
    probes = probes.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("probe", probe.alias("p")))).alias("_p"))
    df = slides.join(probes, "project_id", "full_outer")
    doc = F.struct(F.lit(1).alias("version"), F.struct(F.lit("allen_mouse_25um").alias("name"), F.lit(25.0).alias("resolution_um")).alias("atlas"),
                   F.col("_d.d").alias("slides"), F.col("_p.p").alias("probes"))
    return df.select("project_id", F.to_json(doc).alias("doc"))


#: Columns of a section change and where their value goes in the document.
_SECTION_FIELDS = {"ap_order": "ap_order", "slide_number": "slide_number", "ap_source": "ap_source", "rotation_deg": "rotation_deg", "flip_h": "flip_h", "flip_v": "flip_v",
                   "ds_anchoring": "deepslice_anchoring", "bbox_px": "bbox_px", "ap_um": "plane.ap_um", "reg_anchoring": "registration.anchoring", "output_size_px": "registration.output_size_px"}
_SHANK_FIELDS = {"tip_ccf_um": "tip_ccf_um", "entry_ccf_um": "entry_ccf_um", "tip_section_idx": "tip_section_idx", "entry_section_idx": "entry_section_idx", "track_points_ccf_um": "track_points_ccf_um"}


def _changed(item, change, columns: list[str], fields: dict[str, str]):
    """``item`` with the fields of ``change`` replaced; all others stay. A struct that is not there yet is begun."""
    out = item
    for c in columns:
        head, _, leaf = fields[c].partition(".")
        if leaf:
            inner = F.coalesce(item[head], F.from_json(F.lit("{}"), PARTS[head])).withField(leaf, change[c])
            for other in (x for x in columns if fields[x].startswith(f"{head}.") and x != c):
                inner = inner.withField(fields[other].partition(".")[2], change[other])
            out = out.withField(head, inner)
        else:
            out = out.withField(head, change[c])
    return F.when(change.isNull(), item).otherwise(out)


def _packed(changes: DataFrame, key, fields: dict[str, str], name: str) -> tuple[DataFrame, list[str]]:
    columns = [c for c in changes.columns if c in fields]
    entry = F.struct(key, F.struct(*columns))
    return changes.groupBy("project_id").agg(F.map_from_entries(F.collect_list(entry)).alias(name)), columns


def change_projects(projects: DataFrame, *, sections: DataFrame | None = None, shanks: DataFrame | None = None) -> DataFrame:
    """Parsed documents with the given fields of some sections and shanks replaced, all else as it was.

    ``sections`` has ``project_id, slide_idx, section_index`` and columns of ``_SECTION_FIELDS``; ``shanks``
    has ``project_id, probe, shank`` and columns of ``_SHANK_FIELDS``. A project's changes travel as
    one short map.
    """
    df = projects
    if sections is not None:
        packed, columns = _packed(sections, F.format_string("%d:%d", F.col("slide_idx").cast("long"), F.col("section_index").cast("long")), _SECTION_FIELDS, "_sections")
        df = df.join(packed, "project_id", "left")
        at = lambda i, x: F.element_at(F.col("_sections"), F.format_string("%d:%d", i.cast("long"), x["index"]))
        new = lambda s, i: s.withField("sections", F.transform(s["sections"], lambda x: _changed(x, at(i, x), columns, _SECTION_FIELDS)))
        df = df.withColumn("slides", F.when(F.col("_sections").isNull(), F.col("slides")).otherwise(F.transform("slides", new))).drop("_sections")
    if shanks is not None:
        packed, columns = _packed(shanks, F.format_string("%s:%d", F.col("probe").cast("string"), F.col("shank").cast("long")), _SHANK_FIELDS, "_shanks")
        df = df.join(packed, "project_id", "left")
        at = lambda p, x: F.element_at(F.col("_shanks"), F.format_string("%s:%d", p["label"], x["index"]))
        new = lambda p: p.withField("shanks", F.transform(p["shanks"], lambda x: _changed(x, at(p, x), columns, _SHANK_FIELDS)))
        df = df.withColumn("probes", F.when(F.col("_shanks").isNull(), F.col("probes")).otherwise(F.transform("probes", new))).drop("_shanks")
    return df


def project_documents(projects: DataFrame) -> DataFrame:
    """Parsed documents as JSON texts (``project_id, doc``), every field of the schema; absent ones stay absent."""
    fields = [c for c in DOCUMENT_FIELDS if c in projects.columns]
    return projects.select("project_id", F.to_json(F.struct(*fields)).alias("doc"))


def save_projects(projects: DataFrame, path: str) -> None:
    """Write parsed (and changed) project documents, one JSON text per file row.

    ``path`` must not be the folder the documents are read from: Spark reads while it writes.
    """
    project_documents(projects).select("doc").write.mode("overwrite").text(path)
