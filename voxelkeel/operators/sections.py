"""Sections, slides and cells: lookups, views and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G


def section_lookup(picks: DataFrame, sections: DataFrame) -> DataFrame:
    """Slide, box and transform of each (project, section); first match in slide order.

    The first match is taken on the section side before the join, so a popular section
    never gathers its picks in one window.
    """
    first = sections.groupBy("project_id", "section_index").agg(
        F.min(F.struct("slide_idx", "position", *[c for c in sections.columns if c not in
                       ("project_id", "section_index", "slide_idx", "position")])).alias("_s")
    )
    out = picks.join(first, ["project_id", "section_index"], "left")
    return out.select(*picks.columns, "_s.*")


def slide_position(points: DataFrame, sections: DataFrame) -> DataFrame:
    """Slide pixel = box origin + section pixel; points without a placed section give no row."""
    boxes = sections.select("project_id", "section_index", "slide_idx", "x0", "y0")
    placed = points.filter("section_index IS NOT NULL AND x_px IS NOT NULL AND y_px IS NOT NULL")
    return placed.join(boxes, ["project_id", "section_index"]).withColumns({
        "slide_x": F.col("x0") + F.col("x_px"), "slide_y": F.col("y0") + F.col("y_px")})


def section_local(points: DataFrame, sections: DataFrame) -> DataFrame:
    """P37, other direction: section pixel = slide pixel - box origin."""
    boxes = sections.select("project_id", "section_index", "x0", "y0")
    return points.join(boxes, ["project_id", "section_index"]).withColumns({
        "x_local": F.col("slide_x") - F.col("x0"), "y_local": F.col("slide_y") - F.col("y0")})


def project_view(sections: DataFrame, default: str = "front") -> DataFrame:
    """Stated view, else the majority of planes (ties are front), else the default."""
    seen = G.anchoring_view(F.coalesce("reg_anchoring", "ds_anchoring"))
    counted = sections.withColumn("_seen", seen).groupBy("project_id").agg(
        F.max("seen_from").alias("_stated"),
        F.count_if(F.col("_seen") == "front").alias("n_front"),
        F.count_if(F.col("_seen") == "back").alias("n_back"),
    )
    implied = F.when(F.col("n_back") > F.col("n_front"), "back").when(F.col("n_back") + F.col("n_front") > 0, "front")
    return counted.select("project_id", F.coalesce("_stated", implied, F.lit(default)).alias("proj_view"), "n_front", "n_back")


def disagreeing_sections(sections: DataFrame) -> DataFrame:
    """Per project its view, and one row per section placed for the other view (null if none)."""
    seen = sections.select("project_id", F.col("section_index").alias("disagreeing_section"),
                           G.anchoring_view(F.coalesce("reg_anchoring", "ds_anchoring")).alias("_seen"))
    views = project_view(sections)
    odd = seen.join(views.select("project_id", "proj_view"), "project_id").filter("_seen <> proj_view")
    return views.join(odd.select("project_id", "disagreeing_section"), "project_id", "left")


def mirror_planes(sections: DataFrame, view: str, *, atlas_ml_um: float = 11400.0) -> DataFrame:
    """Set the view and mirror every plane placed for the other one."""
    if view not in ("front", "back"):
        raise ValueError(f"unknown view {view!r}")
    plane = F.coalesce("reg_anchoring", "ds_anchoring")
    turn = F.coalesce(G.anchoring_view(plane) != view, F.lit(False))
    size = F.lit(atlas_ml_um) / F.col("resolution_um")
    out = {"was_mirrored": turn, "seen_from": F.lit(view)}
    for name in ("reg_anchoring", "ds_anchoring"):
        out[name] = F.when(turn, G.mirror_anchoring(F.col(name), size)).otherwise(F.col(name))
    if "match_mirrored" in sections.columns:
        out["match_mirrored"] = F.when(turn, ~F.col("match_mirrored")).otherwise(F.col("match_mirrored"))
    return sections.withColumns(out)
