"""Depth spans of recordings: offsets, coverage, merging, gaps and overlaps.

A penetration has a handful of recordings, a recording a few hundred channels, so windows
here are small and there are as many as penetrations or recordings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelkeel.functions import constants as C


def with_bank_offset(channels: DataFrame, *, row_pitch_um: float = C.NP2_ROW_PITCH_UM, columns: int = 2) -> DataFrame:
    """``bank_offset_um``, depth from tip and depth below the surface of every channel.

    The offset is zero where the positions already start within two rows of it. The lowest
    position comes from a grouped minimum joined back, not from a window over the channels.
    """
    lowest = channels.groupBy("recording").agg(F.min("axial_um").alias("_lowest"))
    df = channels.join(lowest, "recording")
    first = F.col("first_electrode")
    bad = F.raise_error(F.concat(F.lit("electrode numbers are 1-based; got "), first.cast("string"))).cast("double")
    expected = F.when(first.isNull(), 0.0).when(first < 1, bad).otherwise(F.floor((first - 1) / columns) * row_pitch_um)
    df = df.withColumn("_expected", expected.cast("double"))
    df = df.withColumn("bank_offset_um", F.expr(
        f"CASE WHEN _expected <> 0 AND abs(_lowest - _expected) <= {2 * row_pitch_um}D THEN 0D ELSE _expected END"))
    return df.withColumns({
        "depth_from_tip_um": F.expr("axial_um + bank_offset_um"),
        "depth_below_um": F.expr("insertion_depth_um - (axial_um + bank_offset_um)"),
    }).drop("_lowest", "_expected")


def shank_of_channel(channels: DataFrame, *, pitch_um: float = C.SHANK_PITCH_UM) -> DataFrame:
    """Shank from x (half to even), else a numeric id; neither counts as shank 0."""
    by_x = F.rint(F.col("x_um") / pitch_um).cast("int")
    by_id = F.when(F.col("shank_id").cast("string").rlike(r"^\s*\d+\s*$"), F.trim(F.col("shank_id").cast("string")).cast("int"))
    known = F.coalesce(by_x, by_id)
    return channels.withColumns({"shank_known": known.isNotNull(), "shank": F.coalesce(known, F.lit(0))})


def block_shank(channels: DataFrame, keys: list[str]) -> DataFrame:
    """The one shank of a block of channels, or null when it spans several."""
    s = F.rint(F.col("x_um") / C.SHANK_PITCH_UM).cast("int")
    return channels.groupBy(*keys).agg(F.min(s).alias("_a"), F.max(s).alias("_b")).select(
        *keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("block_shank"))


def recording_span(channels: DataFrame) -> DataFrame:
    """Top, bottom, channel count and above-surface flag per recording on the shared axis."""
    return channels.groupBy("penetration", "recording", "label").agg(
        F.min("depth_below_um").alias("top_um"), F.max("depth_below_um").alias("bottom_um"),
        F.count(F.lit(1)).alias("n_channels"), F.bool_or(F.col("depth_below_um") < 0).alias("above_surface"))


def shank_coverage(channels: DataFrame) -> DataFrame:
    """A10: per recording and shank: sites, top, bottom, median row step and distinct columns."""
    keys = ["recording", "shank"]
    rows = channels.groupBy(*keys, "axial_um").agg(F.count(F.lit(1)).alias("_n"))
    step = F.col("axial_um") - F.lag("axial_um").over(Window.partitionBy(*keys).orderBy("axial_um"))
    by_row = rows.withColumn("_step", step).groupBy(*keys).agg(
        F.sum("_n").alias("n_sites"), F.min("axial_um").alias("top_um"), F.max("axial_um").alias("bottom_um"),
        F.coalesce(F.median("_step"), F.lit(0.0)).alias("step_um"))
    cols = channels.groupBy(*keys).agg(F.count_distinct("x_um").alias("n_columns"))
    return by_row.join(cols, keys)


def config_checks(coverage: DataFrame, recordings: DataFrame) -> DataFrame:
    """Absolute-geometry flag, short description and disagreement with the stated configuration."""
    agg = coverage.groupBy("recording").agg(
        F.count(F.lit(1)).alias("_n"), F.min("top_um").alias("_lo"), F.max("bottom_um").alias("_hi"),
        F.max("top_um").alias("_maxtop"), F.min_by("shank", "shank").alias("_shank"), F.min_by("n_columns", "shank").alias("_cols"))
    df = recordings.join(agg, "recording", "left")
    df = df.withColumns({
        "is_absolute": F.expr("coalesce(_maxtop > 30D, false)"),
        "_stated": F.lower(F.coalesce("stated_config", F.lit(""))),
        "_first": F.expr("CAST(nullif(regexp_extract(stated_config, '(\\\\d+)\\\\s*-\\\\s*(\\\\d+)', 1), '') AS BIGINT)"),
    })
    df = df.withColumns({
        "_all": F.expr("contains(_stated, 'all shank')"),
        "_one": F.expr("_stated RLIKE '\\\\bshank\\\\s*\\\\d+\\\\b' AND NOT contains(_stated, 'all shank')"),
        "_expected": F.expr(f"floor((_first - 1) / 2) * {C.NP2_ROW_PITCH_UM}D"),
    })
    df = df.withColumns({
        "description": F.expr("""CASE WHEN _n IS NULL THEN 'no sites' ELSE concat(
            CASE WHEN _n > 1 THEN concat('all ', _n, ' shanks') ELSE concat('shank ', _shank) END, ', ',
            CAST(CAST(rint(_lo) AS BIGINT) AS STRING), '-', CAST(CAST(rint(_hi) AS BIGINT) AS STRING), ' um from tip',
            CASE WHEN _cols = 1 THEN ', single column' ELSE '' END) END"""),
        "mismatch": F.expr("""CASE WHEN _stated = '' OR _n IS NULL THEN NULL
            WHEN _all AND _n = 1 THEN 'stated_all_shanks' WHEN _one AND _n > 1 THEN 'stated_one_shank'
            WHEN _first IS NOT NULL AND is_absolute AND abs(_lo - _expected) > 60D THEN 'range_start' END"""),
    })
    return df.drop("_n", "_lo", "_hi", "_maxtop", "_shank", "_cols", "_stated", "_first", "_all", "_one", "_expected")


def electrode_range(coverage: DataFrame, *, row_pitch_um: float = C.NP2_ROW_PITCH_UM, columns: int = 2) -> DataFrame:
    """Electrode range of a full bank; null unless it is a contiguous block of ``columns`` columns."""
    ok = F.expr(f"step_um > 0 AND n_columns = {columns} AND n_sites = (rint((bottom_um - top_um) / {row_pitch_um}D) + 1) * {columns}")
    first = F.expr(f"CAST(rint(top_um / {row_pitch_um}D) * {columns} + 1 AS BIGINT)")
    return coverage.withColumns({"first_electrode": F.when(ok, first), "last_electrode": F.when(ok, first + F.col("n_sites") - 1)})


def merge_spans(spans: DataFrame, keys: list[str], *, gap_um: float = C.NP2_ROW_PITCH_UM) -> DataFrame:
    """Spans joined where the gap is at most ``gap_um``."""
    w = Window.partitionBy(*keys).orderBy("top_um", "bottom_um")
    reach = F.max("bottom_um").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = spans.withColumn("_reach", reach)
    df = df.withColumn("_new", F.expr(f"CASE WHEN _reach IS NULL OR top_um - _reach > {gap_um}D THEN 1 ELSE 0 END"))
    df = df.withColumn("span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return df.groupBy(*keys, "span").agg(F.min("top_um").alias("top_um"), F.max("bottom_um").alias("bottom_um"))


def span_gaps(spans: DataFrame, keys: list[str], *, min_gap_um: float = C.NP2_ROW_PITCH_UM) -> DataFrame:
    """Uncovered stretches wider than ``min_gap_um`` between spans."""
    w = Window.partitionBy(*keys).orderBy("top_um", "bottom_um")
    reach = F.max("bottom_um").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_reach", reach).filter(F.col("top_um") - F.col("_reach") > min_gap_um).select(
        *keys, F.col("_reach").alias("gap_top_um"), F.col("top_um").alias("gap_bottom_um"))


def span_complement(spans: DataFrame, keys: list[str], extent: str = "extent_um") -> DataFrame:
    """What merged spans leave uncovered in 0..extent."""
    w = Window.partitionBy(*keys).orderBy("top_um")
    before = F.coalesce(F.lag("bottom_um").over(w), F.lit(0.0))
    df = spans.withColumns({"_prev": before, "_last": F.lead("top_um").over(w).isNull()})
    pieces = F.array(
        F.struct(F.greatest("_prev", F.lit(0.0)).alias("lo"), F.least("top_um", F.col(extent)).alias("hi")),
        F.struct(F.when(F.col("_last"), F.greatest("bottom_um", F.lit(0.0))).alias("lo"), F.col(extent).alias("hi")))
    return df.select(*keys, F.explode(pieces).alias("p")).filter("p.hi > p.lo").select(*keys, "p.lo", "p.hi")


def coverage_from_tip(coverage: DataFrame, recordings: DataFrame) -> DataFrame:
    """Merged coverage of a penetration's shanks with the tip at its deepest insertion.

    A recording of unknown depth is left out, unless no depth of the penetration is known.
    """
    deepest = recordings.groupBy("penetration").agg(F.max("insertion_depth_um").alias("_ref"))
    df = coverage.join(recordings.select("recording", "penetration", "insertion_depth_um"), "recording").join(deepest, "penetration")
    df = df.filter("_ref IS NULL OR insertion_depth_um IS NOT NULL")
    df = df.withColumn("_shift", F.expr("CASE WHEN _ref IS NULL THEN 0D ELSE _ref - insertion_depth_um END"))
    return merge_spans(df.select("penetration", "shank", F.expr("top_um + _shift AS top_um"), F.expr("bottom_um + _shift AS bottom_um")),
                       ["penetration", "shank"])


def recording_overlaps(spans: DataFrame) -> DataFrame:
    """Every pair of a penetration's recordings whose spans overlap, upper one first.

    The pair join is inside one penetration, a handful of recordings.
    """
    rank = F.row_number().over(Window.partitionBy("penetration").orderBy("top_um", "recording"))
    s = spans.withColumn("_o", rank)
    a = s.select("penetration", F.col("_o").alias("oa"), F.col("label").alias("label_a"), F.col("top_um").alias("ta"), F.col("bottom_um").alias("ba"))
    b = s.select("penetration", F.col("_o").alias("ob"), F.col("label").alias("label_b"), F.col("top_um").alias("tb"), F.col("bottom_um").alias("bb"))
    return a.join(b, "penetration").filter("oa < ob AND least(ba, bb) > greatest(ta, tb)").select(
        "penetration", "label_a", "label_b", F.expr("greatest(ta, tb) AS lo_um"), F.expr("least(ba, bb) AS hi_um"))


def coverage_fraction(spans: DataFrame, tracks: DataFrame, *, min_gap_um: float = C.NP2_ROW_PITCH_UM) -> DataFrame:
    """Covered share of the track, overlaps once, in [0, 1]; zero without recordings or length."""
    gaps = span_gaps(spans, ["penetration"], min_gap_um=min_gap_um).groupBy("penetration").agg(
        F.sum(F.col("gap_bottom_um") - F.col("gap_top_um")).alias("_gap"))
    rng = spans.groupBy("penetration").agg(F.min("top_um").alias("range_top_um"), F.max("bottom_um").alias("range_bottom_um"))
    df = tracks.join(rng, "penetration", "left").join(gaps, "penetration", "left")
    return df.withColumn("fraction", F.expr("""CASE WHEN track_length_um <= 0 OR range_top_um IS NULL THEN 0D ELSE
        least(1D, greatest(0D, (range_bottom_um - range_top_um - coalesce(_gap, 0D)) / track_length_um)) END""")).drop("_gap")


def covered_runs(grid: DataFrame, keys: list[str], *, bin_um: float) -> DataFrame:
    """Contiguous covered stretches of a depth grid; the end includes its bin."""
    w = Window.partitionBy(*keys).orderBy("depth_um")
    on = grid.withColumn("_pos", F.row_number().over(w)).filter("covered")
    on = on.withColumn("_isl", F.col("_pos") - F.row_number().over(w))
    return on.groupBy(*keys, "_isl").agg(F.min("depth_um").alias("run_top_um"), (F.max("depth_um") + bin_um).alias("run_bottom_um")).drop("_isl")


def run_gaps(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The stretches between consecutive covered runs."""
    nxt = F.lead("run_top_um").over(Window.partitionBy(*keys).orderBy("run_top_um"))
    return runs.withColumn("gap_bottom_um", nxt).filter("gap_bottom_um IS NOT NULL").select(
        *keys, F.col("run_bottom_um").alias("gap_top_um"), "gap_bottom_um")


def recorded_electrodes(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the recorded electrode ranges of a probe, zero-based."""
    return recordings.filter("first_electrode IS NOT NULL").select(
        *keys, F.explode(F.sequence(F.col("first_electrode") - 1, F.col("last_electrode") - 1)).alias("electrode")).distinct()


def only_recorded(sites: DataFrame, electrodes: DataFrame, keys: list[str], site: str = "channel") -> DataFrame:
    """U02 as a filter: recorded sites only, or all of a probe's sites where no range is known."""
    has_any = electrodes.select(*keys).distinct().withColumn("_known", F.lit(True))
    hit = electrodes.select(*keys, F.col("electrode").alias(site)).withColumn("_hit", F.lit(True))
    joined = sites.join(has_any, keys, "left").join(hit, [*keys, site], "left")
    return joined.filter("_known IS NULL OR _hit IS NOT NULL").drop("_known", "_hit")
