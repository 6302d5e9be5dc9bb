"""Section series: order, AP, flags, planes, boxes and slide layout.

A slide holds tens of boxes and a project some hundred sections; windows and in-group joins
are over those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G


def series_rows(sections: DataFrame) -> DataFrame:
    """A20 input: plane values and the AP shown for each section (plane, else assigned)."""
    df = G.section_plane_values(sections)
    return df.withColumn("shown_ap_um", F.coalesce("plane_ap_um", "ap_um"))


def series_flags(rows: DataFrame, *, tilt_tolerance_deg: float = 2.0) -> DataFrame:
    """Out-of-order AP (the odd one of a pair is blamed), tilt off the median, mirrored."""
    # Sections with and without an AP are apart, so one sort serves steps, medians and neighbours.
    whole = Window.partitionBy("project_id", "_has")
    w = whole.orderBy("ap_order", "section_index")
    df = rows.withColumn("_has", F.col("shown_ap_um").isNotNull())
    df = df.withColumns({"_pos": F.row_number().over(w) - 1, "_step": F.lead("shown_ap_um").over(w) - F.col("shown_ap_um")})
    on_plane = lambda c: F.when(F.col("plane_ap_um").isNotNull(), F.col(c))
    df = df.withColumns({
        "_n": F.count("shown_ap_um").over(whole), "_med": F.median("_step").over(whole), "_a0": F.min_by("shown_ap_um", "_pos").over(whole), "_a1": F.max_by("shown_ap_um", "_pos").over(whole),
        "_np": F.count("plane_ap_um").over(whole), "_mp": F.median(on_plane("pitch_deg")).over(whole), "_my": F.median(on_plane("yaw_deg")).over(whole)})
    df = df.withColumn("_res", F.expr("CASE WHEN _n >= 3 THEN shown_ap_um - _med * _pos END"))
    df = df.withColumn("off_trend_um", F.abs(F.col("_res") - F.median("_res").over(whole)))
    backwards = F.col("_step") * F.when(F.col("_a1") >= F.col("_a0"), 1).otherwise(-1) <= 0
    # Of a backward pair the one farther off the trend is blamed: true where it is the first.
    df = df.withColumn("_self", F.when(backwards & F.col("off_trend_um").isNotNull(), F.col("off_trend_um") > F.lead("off_trend_um").over(w)))
    blamed = F.coalesce(F.col("_self").cast("int"), F.lit(0)) + F.coalesce((~F.lag("_self").over(w)).cast("int"), F.lit(0))
    tol = float(tilt_tolerance_deg)
    return df.select(
        "project_id", "section_index", "off_trend_um", blamed.cast("long").alias("n_out_of_order"),
        F.expr(f"coalesce(_np >= 3 AND abs(pitch_deg - _mp) > {tol}D, false) AS pitch_off"),
        F.expr(f"coalesce(_np >= 3 AND abs(yaw_deg - _my) > {tol}D, false) AS yaw_off"),
        F.coalesce("mirrored", F.lit(False)).alias("mirrored"))


def ap_order_issues(sections: DataFrame, *, ap: str = "mean_ap", close_frac: float = 0.3) -> DataFrame:
    """Adjacent pairs that run backwards, or closer than a fraction of the median step."""
    w = Window.partitionBy("project_id").orderBy("ap_order", "section_index")
    df = sections.withColumns({"_next": F.lead(ap).over(w), "next_section": F.lead("section_index").over(w), "_pos": F.row_number().over(w)})
    df = df.withColumn("_step", F.col("_next") - F.col(ap))
    stat = df.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"), F.median(F.abs("_step")).alias("_med"),
                                        F.min_by(ap, "_pos").alias("_a"), F.max_by(ap, "_pos").alias("_b"))
    pairs = df.filter("_step IS NOT NULL").join(stat, "project_id").filter("_n >= 3 AND _med >= 1e-6")
    issue = F.expr(f"""CASE WHEN _step * CASE WHEN _b - _a >= 0 THEN 1 ELSE -1 END <= 0 THEN 'reversed'
        WHEN abs(_step) < {close_frac}D * _med THEN 'close' END""")
    return pairs.withColumn("issue", issue).filter("issue IS NOT NULL").select("project_id", "section_index", "next_section", "issue")


def assign_ap(sections: DataFrame, *, forward: bool = True, anchor: str | None = None, default_ap_um: float = 5400.0) -> DataFrame:
    """AP along a series from one anchor section.

    Steps follow slide numbers where all are present and not all equal, else positions. The
    anchor is the section flagged by ``anchor`` (else the first); its own AP, else the default.
    """
    w = Window.partitionBy("project_id").orderBy("ap_order", "section_index")
    df = sections.withColumn("_pos", F.row_number().over(w) - 1)
    is_anchor = F.col(anchor) if anchor else F.col("_pos") == 0
    stat = df.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count("slide_number").alias("_ns"), F.count_distinct("slide_number").alias("_nd"),
        F.min_by("slide_number", "_pos").alias("_s0"), F.max_by("slide_number", "_pos").alias("_s1"),
        F.min(F.when(is_anchor, F.struct("_pos", "ap_um", "slide_number"))).alias("_a"),
        F.min(F.struct("_pos", "ap_um", "slide_number")).alias("_f"))
    stat = stat.withColumn("_a", F.coalesce("_a", "_f"))
    sign = 1 if forward else -1
    out = df.join(stat, "project_id").withColumn("by_slide_number", F.expr("_ns = _n AND _nd > 1"))
    steps = """CASE WHEN by_slide_number THEN (slide_number - _a.slide_number) * CASE WHEN _s1 - _s0 >= 0 THEN 1 ELSE -1 END ELSE _pos - _a._pos END"""
    return out.withColumn("assigned_ap_um", F.expr(f"coalesce(_a.ap_um, {default_ap_um}D) + ({steps}) * spacing_um * {sign}")).drop(
        "_pos", "_n", "_ns", "_nd", "_s0", "_s1", "_a", "_f")


def interpolate_ap(sections: DataFrame) -> DataFrame:
    """AP of unassigned sections by position between assigned neighbours, flat at the ends."""
    order = Window.partitionBy("project_id").orderBy("ap_order", "section_index")
    df = sections.withColumn("_pos", F.row_number().over(order) - 1)
    knot = F.when(F.col("ap_um").isNotNull(), F.struct("_pos", "ap_um"))
    df = df.withColumns({
        "_lo": F.last(knot, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_hi": F.first(knot, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    known = df.groupBy("project_id").agg(F.count("ap_um").alias("_known"))
    value = F.expr("""CASE WHEN ap_um IS NOT NULL OR _known < 2 THEN ap_um WHEN _lo IS NULL THEN _hi.ap_um WHEN _hi IS NULL THEN _lo.ap_um
        ELSE _lo.ap_um + (_hi.ap_um - _lo.ap_um) * (_pos - _lo._pos) / (_hi._pos - _lo._pos) END""")
    return df.join(known, "project_id").withColumn("filled_ap_um", value).drop("_pos", "_lo", "_hi", "_known")


def series_numbers(sections: DataFrame, missing_after: str) -> DataFrame:
    """1-based display numbers in AP order, with a null placeholder after flagged sections."""
    w = Window.partitionBy("project_id").orderBy("ap_order", "section_index")
    df = sections.withColumn("display_no", F.row_number().over(w))
    slots = F.when(F.col(missing_after), F.array(F.col("ap_order"), F.lit(None).cast("bigint"))).otherwise(F.array("ap_order"))
    return df.select("project_id", "section_index", "display_no", F.posexplode(slots).alias("slot", "sequence_ap_order"))


def guide_planes(sections: DataFrame) -> DataFrame:
    """Slide predicted planes along AP so pinned sections land on the user's AP.

    Needs ``ds_anchoring``, ``user_centre`` (AP of the user's plane, voxels) and ``ap_source``.
    Others take the shift interpolated between pins by predicted AP, held at the ends.
    Pins sharing a predicted AP keep their sort order.
    """
    df = sections.filter("ds_anchoring IS NOT NULL").withColumn("_c", G.anchoring_centre_ap(F.col("ds_anchoring")))
    df = df.withColumn("_pin", F.expr("user_centre IS NOT NULL AND NOT (ap_source <=> 'deepslice')"))
    order = Window.partitionBy("project_id").orderBy("_c", F.expr("CASE WHEN _pin THEN user_centre - _c END").asc_nulls_first())
    knot = F.expr("CASE WHEN _pin THEN named_struct('c', _c, 's', user_centre - _c) END")
    df = df.withColumn("_k", knot).withColumns({
        "_lo": F.last("_k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_hi": F.first("_k", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    shift = F.expr("""CASE WHEN _pin THEN user_centre - _c WHEN _lo IS NULL AND _hi IS NULL THEN 0D WHEN _lo IS NULL THEN _hi.s WHEN _hi IS NULL THEN _lo.s
        WHEN _hi.c = _lo.c THEN _lo.s ELSE _lo.s + (_hi.s - _lo.s) * (_c - _lo.c) / (_hi.c - _lo.c) END""")
    df = df.withColumn("shift_vox", shift)
    moved = F.expr("transform(ds_anchoring, (v, i) -> CASE WHEN i = 0 THEN v + shift_vox ELSE v END)")
    return df.withColumn("guided_anchoring", moved).drop("_c", "_pin", "_k", "_lo", "_hi")


def order_sections(boxes: DataFrame, keys: list[str], *, column_first: bool = True, left_to_right: bool = True,
                   top_to_bottom: bool = True, gap_factor: float = 0.6) -> DataFrame:
    """Grid row, column and order of boxes: clusters along one axis split at wide gaps, ranked inside."""
    spread, inner = ("cx", "cy") if column_first else ("cy", "cx")
    extent = "x1 - x0" if column_first else "y1 - y0"
    outer_fwd, inner_fwd = (left_to_right, top_to_bottom) if column_first else (top_to_bottom, left_to_right)
    med = boxes.groupBy(*keys).agg(F.median(F.expr(extent)).alias("_ext"))
    df = boxes.join(med, keys)
    w = Window.partitionBy(*keys).orderBy(spread, "k")
    df = df.withColumn("_gap", F.col(spread) - F.lag(spread).over(w))
    df = df.withColumn("_new", F.expr(f"CASE WHEN _gap > greatest(_ext * {gap_factor}D, 1D) THEN 1 ELSE 0 END"))
    df = df.withColumn("_cl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Clusters are already ordered along the axis they were split on, so their means are too.
    outer = F.col("_cl") if outer_fwd else F.max("_cl").over(Window.partitionBy(*keys)) - F.col("_cl")
    df = df.withColumn("_outer", outer)
    ties = F.col("k").asc() if inner_fwd else F.col("k").desc()
    by = F.col(inner).asc() if inner_fwd else F.col(inner).desc()
    df = df.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, "_outer").orderBy(by, ties)) - 1)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_outer", "_inner")) - 1
    row, col = ("_inner", "_outer") if column_first else ("_outer", "_inner")
    return df.withColumns({"row": F.col(row).cast("int"), "col": F.col(col).cast("int"), "rank": rank}).drop(
        "_ext", "_gap", "_new", "_cl", "_outer", "_inner")


def order_sections_by_band(boxes: DataFrame, bands: DataFrame, keys: list[str], **options) -> DataFrame:
    """W10 with several sources on a slide: ordered inside each band, bands one after another."""
    placed = band_lookup(boxes, bands, keys)
    ranked = order_sections(placed, [*keys, "band"], **options)
    overall = F.row_number().over(Window.partitionBy(*keys).orderBy("band", "rank")) - 1
    return ranked.withColumn("rank", overall)


def band_lookup(points: DataFrame, bands: DataFrame, keys: list[str], y: str = "cy") -> DataFrame:
    """Band [y0, y1) holding a centroid, else the nearest band centre (first on ties).

    A slide has a few bands; they travel as one small array per slide.
    """
    packed = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("band", "band_y0", "band_y1"))).alias("_b"))
    df = points.join(packed, keys, "left")
    df = df.withColumns({
        "_in": F.expr(f"get(filter(_b, b -> {y} >= b.band_y0 AND {y} < b.band_y1), 0).band"),
        "_near": F.expr(f"array_min(transform(_b, b -> named_struct('d', abs({y} - (b.band_y0 + b.band_y1) * 0.5D), 'band', b.band))).band"),
    })
    return df.withColumn("band", F.coalesce("_in", "_near")).drop("_b", "_in", "_near")


def slide_bands(sources: DataFrame, keys: list[str], *, gap_px: int = 40) -> DataFrame:
    """Vertical band of each source image stacked on a slide."""
    before = F.coalesce(F.sum(F.col("height") + gap_px).over(
        Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sources.withColumn("band_y0", before).withColumn("band_y1", F.col("band_y0") + F.col("height"))


def grid_cells(items: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Near-square grid cell of each item."""
    n = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    df = items.join(n, keys).withColumn("_c", F.expr("greatest(1, CAST(ceil(sqrt(_n)) AS BIGINT))"))
    return df.withColumns({"cell_row": F.expr(f"CAST(floor({position} / _c) AS BIGINT)"), "cell_col": F.expr(f"{position} % _c")}).drop("_n", "_c")


def slide_layout(items: DataFrame, keys: list[str], *, gap_px: int = 40) -> DataFrame:
    """Box of each item from row and column maxima; an unused row or column still takes its gap."""
    def offsets(axis: str, size: str, out: str) -> DataFrame:
        lines = items.groupBy(*keys, axis).agg(F.max(size).alias("_s"))
        running = F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return lines.select(*keys, axis, (running + F.col(axis) * gap_px).alias(out))

    df = items.join(offsets("cell_row", "h", "box_y0"), [*keys, "cell_row"]).join(offsets("cell_col", "w", "box_x0"), [*keys, "cell_col"])
    return df.withColumns({"box_x1": F.expr("box_x0 + w"), "box_y1": F.expr("box_y0 + h")})


def box_equalise(boxes: DataFrame, keys: list[str], *, image_w: str = "image_w", image_h: str = "image_h", min_frac: float = 0.85) -> DataFrame:
    """Boxes well under the slide's median size grow to it, centred and clamped; needs three boxes."""
    med = boxes.groupBy(*keys).agg(F.median(F.expr("x1 - x0")).alias("_mw"), F.median(F.expr("y1 - y0")).alias("_mh"), F.count(F.lit(1)).alias("_n"))
    df = boxes.join(med, keys).withColumns({
        "_tw": F.expr(f"CASE WHEN _n >= 3 AND x1 - x0 < {min_frac}D * _mw THEN _mw ELSE x1 - x0 END"),
        "_th": F.expr(f"CASE WHEN _n >= 3 AND y1 - y0 < {min_frac}D * _mh THEN _mh ELSE y1 - y0 END")})
    grown = "(_tw <> x1 - x0 OR _th <> y1 - y0)"
    side = lambda lo, hi, t, s: f"CAST(rint(({lo} + {hi}) / 2D {s} {t} / 2D) AS BIGINT)"
    return df.withColumns({
        "eq_x0": F.expr(f"CASE WHEN {grown} THEN greatest(0L, {side('x0', 'x1', '_tw', '-')}) ELSE x0 END"),
        "eq_x1": F.expr(f"CASE WHEN {grown} THEN least({image_w}, {side('x0', 'x1', '_tw', '+')}) ELSE x1 END"),
        "eq_y0": F.expr(f"CASE WHEN {grown} THEN greatest(0L, {side('y0', 'y1', '_th', '-')}) ELSE y0 END"),
        "eq_y1": F.expr(f"CASE WHEN {grown} THEN least({image_h}, {side('y0', 'y1', '_th', '+')}) ELSE y1 END"),
    }).drop("_mw", "_mh", "_n", "_tw", "_th")


def box_neighbours(boxes: DataFrame, keys: list[str], *, margin_frac: float = 0.06) -> DataFrame:
    """Gap to the nearest facing box, and the margin it allows.

    Boxes that face each other share a row or a column of pixels, so they are compared within
    bands about as high (or wide) as the slide's mean box, not with the whole slide.
    """
    size = boxes.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.avg(F.expr("y1 - y0"))).alias("_bh"), F.greatest(F.lit(1.0), F.avg(F.expr("x1 - x0"))).alias("_bw"))
    sized = boxes.select(*keys, "k", "x0", "y0", "x1", "y1").join(size, keys)
    sides = []
    for lo, hi, near, far, band in (("y0", "y1", "x0", "x1", "_bh"), ("x0", "x1", "y0", "y1", "_bw")):
        rows = sized.withColumn("_band", F.explode(F.expr(f"sequence(CAST(floor({lo} / {band}) AS BIGINT), CAST(floor(greatest({lo}, {hi}) / {band}) AS BIGINT))")))
        other = rows.select(*keys, "_band", *[F.col(c).alias(f"o_{c}") for c in ("k", "x0", "y0", "x1", "y1")])
        gap = F.expr(f"CASE WHEN {hi} > o_{lo} AND {lo} < o_{hi} THEN least(CASE WHEN o_{near} >= {far} THEN o_{near} - {far} END, CASE WHEN o_{far} <= {near} THEN {near} - o_{far} END) END")
        sides.append(rows.join(other, [*keys, "_band"]).filter("k <> o_k").groupBy("k").agg(F.min(gap).alias("_g")))
    nearest = sides[0].unionByName(sides[1]).groupBy("k").agg(F.min("_g").alias("gap_px"))
    want = f"{margin_frac}D * least(x1 - x0, y1 - y0)"
    df = boxes.join(nearest, "k", "left")
    df = df.withColumn("margin_px", F.expr(f"CAST(greatest(0D, floor(least({want}, coalesce(gap_px / 2D, {want})))) AS BIGINT)"))
    return df.withColumns({
        "mx0": F.expr("greatest(0L, x0 - margin_px)"), "my0": F.expr("greatest(0L, y0 - margin_px)"),
        "mx1": F.expr("least(image_w, x1 + margin_px)"), "my1": F.expr("least(image_h, y1 + margin_px)")})


def filter_components(components: DataFrame, keys: list[str], *, min_area_px: int = 5000, max_area_frac: float = 0.4,
                      aspect_ratio_max: float = 4.0, expected_count: int | None = None) -> DataFrame:
    """Components within the area limits and aspect ratio, optionally the N largest of a slide."""
    df = components.filter(F.expr(f"""area_px >= {min_area_px} AND area_px <= CAST({max_area_frac}D * image_w * image_h AS BIGINT) AND x1 > x0 AND y1 > y0
        AND greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) <= {aspect_ratio_max}D"""))
    if expected_count is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area_px"), "k"))
    return df.withColumn("_r", rank).filter(F.col("_r") <= expected_count).drop("_r")
