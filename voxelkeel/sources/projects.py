"""Project documents and series files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelkeel import schemas


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project files, one row each, keyed by path; unknown keys are ignored."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("project_id"), F.col("value").alias("doc"))
    return parse_projects(text)


def read_saved_projects(spark: SparkSession, path: str) -> DataFrame:
    """Documents written by ``save_projects``, one a line, keyed by file and a hash of the text."""
    key = F.concat_ws("#", F.col("_metadata.file_path"), F.xxhash64("value").cast("string"))
    return parse_projects(spark.read.text(path).select(key.alias("project_id"), F.col("value").alias("doc")))


def parse_projects(documents: DataFrame) -> DataFrame:
    """Parse ``doc``; defaults filled, and ``reject_reason`` set where a rule is broken."""
    df = documents.withColumn("_p", F.from_json("doc", schemas.PROJECT)).select(*[c for c in documents.columns if c != "doc"], "_p.*", F.col("_p").isNull().alias("_bad"))
    bad_shanks = "exists(probes, p -> p.type.n_shanks < 1)"
    bad_index = "exists(slides, s -> exists(s.sections, x -> x.index < 0)) OR exists(probes, p -> exists(p.shanks, s -> s.index < 0))"
    bad_plane = "exists(slides, s -> exists(s.sections, x -> size(x.registration.anchoring) <> 9))"
    reason = F.expr(f"""CASE WHEN _bad OR (slides IS NULL AND probes IS NULL AND atlas IS NULL) THEN 'not_a_project' WHEN {bad_shanks} THEN 'n_shanks' WHEN {bad_index} THEN 'index' WHEN {bad_plane} THEN 'anchoring' END""")
    return df.withColumns({
        "version": F.coalesce("version", F.lit(1)), "atlas_name": F.coalesce("atlas.name", F.lit("allen_mouse_25um")),
        "resolution_um": F.coalesce("atlas.resolution_um", F.lit(25.0)), "reject_reason": reason}).drop("_bad")


def valid_projects(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined with the reason)."""
    return projects.filter("reject_reason IS NULL"), projects.filter("reject_reason IS NOT NULL")


def project_tables(projects: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of the documents; each is its own chain of explodes, so an unused one costs nothing."""
    slides = projects.select("project_id", "resolution_um", "seen_from", F.posexplode("slides").alias("slide_idx", "s"))
    sections = slides.select("project_id", "resolution_um", "seen_from", "slide_idx", F.explode("s.sections").alias("x")).select(
        "project_id", "slide_idx", F.col("x.index").alias("section_index"), *[F.get("x.bbox_px", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        F.coalesce("x.ap_order", F.lit(0)).alias("ap_order"), "x.slide_number", F.col("x.plane.ap_um").alias("ap_um"), "x.ap_source", F.coalesce("x.rotation_deg", F.lit(0.0)).alias("rotation_deg"),
        F.col("x.registration.anchoring").alias("reg_anchoring"), F.get("x.registration.output_size_px", F.lit(0)).alias("out_h"), F.get("x.registration.output_size_px", F.lit(1)).alias("out_w"),
        F.col("x.deepslice_anchoring").alias("ds_anchoring"), F.coalesce("x.flip_h", F.lit(False)).alias("flip_h"), F.coalesce("x.flip_v", F.lit(False)).alias("flip_v"), "resolution_um", "seen_from")
    probes = projects.select("project_id", F.explode("probes").alias("p")).select("project_id", F.col("p.label").alias("probe"), F.col("p.type.name").alias("probe_type"), "p.type.n_shanks", F.col("p"))
    shanks_raw = probes.select("project_id", "probe", "probe_type", F.explode("p.shanks").alias("s"))
    ends = [F.get(f"s.{e}_ccf_um", F.lit(i)).alias(f"{e}_{a}") for e in ("tip", "entry") for i, a in enumerate(("ap", "ml", "dv"))]
    key = ["project_id", "probe", F.col("s.index").alias("shank")]
    shanks = shanks_raw.select("project_id", "probe", "probe_type", F.col("s.index").alias("shank"), *ends, "s.tip_section_idx", "s.entry_section_idx")
    picks = shanks_raw.select(*key, F.posexplode("s.track_picks").alias("i", "k")).select("project_id", "probe", "shank", "i", "k.point.x_px", "k.point.y_px", "k.section_idx")
    points = shanks_raw.select(*key, F.posexplode("s.track_points_ccf_um").alias("i", "c")).select("project_id", "probe", "shank", "i", *[F.get("c", F.lit(j)).alias(a) for j, a in enumerate(("ap", "ml", "dv"))])
    landmarks = shanks_raw.select(*key, F.coalesce("s.ephys.extremes_mode", F.lit("uniform")).alias("extremes_mode"), "s.ephys.insertion_depth_um",
                                  F.posexplode(F.arrays_zip("s.ephys.feature_um", "s.ephys.track_um")).alias("i", "z")).select("project_id", "probe", "shank", "extremes_mode", "insertion_depth_um", "i", "z.feature_um", "z.track_um")
    recordings = probes.select("project_id", "probe", F.posexplode("p.recordings").alias("recording_idx", "r"))
    epochs = recordings.select("project_id", "probe", "recording_idx", F.explode("r.epochs").alias("e")).select("project_id", "probe", "recording_idx", "e.t_start_s", "e.t_end_s", F.coalesce("e.kept", F.lit(True)).alias("kept"), "e.reject_reason")
    recordings = recordings.select("project_id", "probe", "recording_idx", "r.path", F.coalesce("r.label", F.lit("")).alias("label"), "r.stream_name", F.coalesce("r.insertion_depth_um", F.lit(0.0)).alias("insertion_depth_um"),
                                   F.get("r.electrode_range", F.lit(0)).alias("first_electrode"), F.get("r.electrode_range", F.lit(1)).alias("last_electrode"), "r.bank_offset_um")
    cells = projects.select("project_id", F.explode("cell_sets").alias("c")).select("project_id", F.col("c.name").alias("set_name"), F.explode("c.cells").alias("x")).select("project_id", "set_name", "x.*").withColumn("cell_type", F.coalesce("cell_type", F.lit("cell")))
    return {"slides": slides.select("project_id", "slide_idx", "s.image_path", "s.pixel_um"), "sections": sections, "probes": probes.drop("p"), "shanks": shanks, "track_picks": picks,
            "track_points": points, "landmarks": landmarks, "recordings": recordings, "epochs": epochs, "cells": cells}


def atlas_for_target(target):
    """Atlas family of a QUINT target; others fail the job."""
    t = F.lower(target)
    return F.when(t.contains("kim"), "kim_mouse").when(t.contains("aba_mouse") | t.contains("allen") | t.contains("ccfv3"), "allen_mouse").otherwise(
        F.raise_error(F.concat(F.lit("unsupported QUINT atlas "), F.coalesce(target, F.lit("null")))))


def parse_quint(documents: DataFrame) -> DataFrame:
    """Sections of QuickNII/VisuAlign series (``series, doc``) with a plane, in series order."""
    df = documents.withColumn("_q", F.from_json("doc", schemas.QUINT)).withColumn("atlas", atlas_for_target(F.coalesce("_q.target", F.lit("ABA_Mouse_CCFv3"))))
    rows = F.expr("""coalesce(_q.slices, transform(_q.sections, s -> named_struct('filename', s.filename, 'nr', s.nr, 'width', s.width, 'height', s.height, 'anchoring', s.ouv, 'markers', s.markers)))""")
    rows = df.withColumn("_r", F.filter(rows, lambda s: F.size(s["anchoring"]) > 0))
    # A series without any plane fails; it is not silently empty.
    checked = F.when(F.coalesce(F.size("_r"), F.lit(0)) > 0, F.col("_r")).otherwise(F.raise_error(F.lit("series has no anchored sections")).cast(rows.schema["_r"].dataType))
    rows = rows.select("series", "atlas", F.posexplode(checked).alias("_pos", "s"))
    stem = F.regexp_replace("s.filename", r"\.[^.]*$", "")
    number = F.coalesce(F.nullif("s.nr", F.lit(0).cast("bigint")), F.nullif(F.regexp_extract(stem, r"_s(\d+)", 1), F.lit("")).cast("bigint"))
    order = F.row_number().over(_series_window(number))
    return rows.select("series", "atlas", F.coalesce(number, order.cast("bigint")).alias("series_number"), order.alias("position"), "s.filename", "s.width", "s.height", "s.anchoring", "s.markers")


def _series_window(number):
    from pyspark.sql import Window
    return Window.partitionBy("series").orderBy(F.coalesce(number, F.lit(0).cast("bigint")), "_pos")


def slicereg_series(slices: DataFrame, alignments: DataFrame, *, pixel_um: float | None = None) -> DataFrame:
    """Slices with their alignment; pixel size is the project's largest unless given; a size mismatch fails."""
    top = slices.groupBy("project_id").agg(F.max("pixel_um").alias("project_pixel_um"))
    df = slices.join(top, "project_id").join(alignments, ["project_id", "slice_id"])
    if pixel_um is not None:
        df = df.withColumn("project_pixel_um", F.lit(float(pixel_um)))
    wrong = (F.col("align_w") != F.col("image_w")) | (F.col("align_h") != F.col("image_h"))
    factor = F.when(wrong, F.raise_error(F.lit("alignment is for another image size")).cast("double")).otherwise(F.col("pixel_um") / F.col("project_pixel_um"))
    return df.withColumn("factor", factor)


def atlas_resolution(name):
    """Resolution in um from the end of an atlas name."""
    return F.nullif(F.regexp_extract(name, r"_(\d+(?:\.\d+)?)um$", 1), F.lit("")).cast("double")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every ``slices/slice_NN/cells.csv`` under ``path``, with its slice id and file order kept by name."""
    rows = spark.read.csv(f"{path}/slices/*/cells.csv", header=True)
    return rows.withColumn("slice_id", F.regexp_extract(F.col("_metadata.file_path"), r"slice_(\d+)/", 1).cast("bigint"))


def place_cells(rows: DataFrame, placement: DataFrame) -> DataFrame:
    """Counted cells on their section: pixel becomes (x + 0.5) * factor - 0.5; unplaced slices keep atlas positions only."""
    df = rows.join(placement.select("project_id", "slice_id", "section_index", "factor"), ["project_id", "slice_id"], "left")
    both = "section_index IS NOT NULL AND nullif(x_px, '') IS NOT NULL AND nullif(y_px, '') IS NOT NULL"
    px = lambda c: F.expr(f"CASE WHEN {both} THEN (CAST({c} AS DOUBLE) + 0.5D) * factor - 0.5D END")
    return df.withColumns({"x_px": px("x_px"), "y_px": px("y_px"), **{c: F.col(c).cast("double") for c in ("ap_um", "ml_um", "dv_um")},
                           "cell_type": F.coalesce(F.nullif("cell_type", F.lit("")), F.lit("cell")), "region": F.nullif("region_acronym", F.lit(""))}).drop("factor", "region_acronym")
