"""Regions: voxel lookup, bands along a track, ancestry, thickness and areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def voxel_key(i_ap: Column, i_dv: Column, i_ml: Column) -> Column:
    """One long per voxel (21 bits an axis); null outside the non-negative octant."""
    a, d, m = (c.cast("long") for c in (i_ap, i_dv, i_ml))
    inside = (a >= 0) & (d >= 0) & (m >= 0) & (F.greatest(a, d, m) < (1 << 21))
    return F.when(inside, F.shiftleft(a, 42).bitwiseOR(F.shiftleft(d, 21)).bitwiseOR(m))


def spread_outside(key: Column, *by: Column) -> Column:
    """A voxel number, or, outside, a negative one that no voxel has: outside points would else all meet in one task."""
    return F.coalesce(key, -F.shiftrightunsigned(F.xxhash64(*by), 1) - 1)


def voxel_of(df: DataFrame, resolution_um: float, ap="ap_um", ml="ml_um", dv="dv_um") -> Column:
    idx = [F.floor(F.col(c) / float(resolution_um)) for c in (ap, dv, ml)]
    return voxel_key(*idx)


def region_at_point(points: DataFrame, annotation: DataFrame, structures: DataFrame, *, resolution_um: float) -> DataFrame:
    """``region, region_id, region_color`` at CCF points; "", 0, "" where unlabelled or outside.

    An equi left join on the packed voxel: the labelled voxels are unique, so rows are kept
    one to one, and a voxel holding many points is split by adaptive skew handling; points
    outside get keys of their own that match nothing. Neither
    side carries a hint; the planner broadcasts whichever its statistics allow.
    """
    grid = annotation.filter("structure_id > 0").select(
        voxel_key(F.col("i_ap"), F.col("i_dv"), F.col("i_ml")).alias("_vox"), F.col("structure_id").alias("_sid"))
    names = structures.select(F.col("id").alias("_id"), F.col("acronym").alias("_acr"),
                              F.format_string("#%02x%02x%02x", "r", "g", "b").alias("_hex"))
    # Labels are resolved on the voxel side, which is bounded by the atlas.
    labelled = grid.join(names, F.col("_sid") == F.col("_id")).select("_vox", "_id", "_acr", "_hex")
    key = spread_outside(voxel_of(points, resolution_um), *[F.col(c) for c in ("ap_um", "ml_um", "dv_um")])
    out = points.withColumn("_vox", key).join(labelled, "_vox", "left")
    return out.withColumns({
        "region": F.coalesce("_acr", F.lit("")), "region_id": F.coalesce("_id", F.lit(0)),
        "region_color": F.coalesce("_hex", F.lit("")),
    }).drop("_vox", "_id", "_acr", "_hex")


def regions_in_order(hits: DataFrame, keys: list[str], position: str) -> DataFrame:
    """J01 variant: distinct regions of a group in first-seen order, without root and blanks."""
    seen = hits.filter("region NOT IN ('', 'root')").groupBy(*keys, "region").agg(F.min(position).alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_first", "region")
    return seen.withColumn("rank", F.row_number().over(order)).drop("_first")


def region_bands(hits: DataFrame, keys: list[str], depth: str = "depth_um", region: str = "region") -> DataFrame:
    """Contiguous runs of one region along a track; edges at sample midpoints, outer samples at the ends.

    A track is a few hundred samples, so its window is small; tracks are the parallelism.
    """
    w = Window.partitionBy(*keys).orderBy(depth)
    prev_region, prev_depth = F.lag(region).over(w), F.lag(depth).over(w)
    start = prev_region.isNull() | (prev_region != F.col(region))
    marked = hits.select(*keys, F.col(depth).alias("_d"), F.col(region).alias("_r"), prev_depth.alias("_pd"),
                         F.lead(depth).over(w).alias("_nd"), start.cast("int").alias("_start"))
    runs = marked.withColumn("band", F.sum("_start").over(Window.partitionBy(*keys).orderBy("_d")) - 1)
    bands = runs.groupBy(*keys, "band").agg(
        F.first("_r").alias("region"), F.min(F.struct("_d", "_pd")).alias("_lo"), F.max(F.struct("_d", "_nd")).alias("_hi"),
        F.count(F.lit(1)).alias("n_samples"))
    mid = lambda a, b: F.when(b.isNull(), a).otherwise((a + b) * 0.5)
    return bands.select(*keys, "band", "region", mid(F.col("_lo._d"), F.col("_lo._pd")).alias("top_um"),
                        mid(F.col("_hi._d"), F.col("_hi._nd")).alias("bottom_um"), "n_samples")


def candidate_boundaries(bands: DataFrame, keys: list[str], *, min_band_um: float = 150.0) -> DataFrame:
    """Edges whose two neighbours are labelled and thick enough."""
    w = Window.partitionBy(*keys).orderBy("band")
    nxt = bands.withColumns({
        "below": F.lead("region").over(w),
        "_next_thick": F.lead(F.col("bottom_um") - F.col("top_um")).over(w)})
    ok = ((F.col("region") != "") & (F.col("below") != "") & (F.col("bottom_um") - F.col("top_um") >= min_band_um)
          & (F.col("_next_thick") >= min_band_um))
    return nxt.filter(ok).select(*keys, F.col("bottom_um").alias("boundary_um"), F.col("region").alias("above"), "below")


def fibre_tracts(structures: DataFrame, root_acronym: str = "fiber tracts") -> DataFrame:
    """Structures that are, or descend from, the fibre-tract root; none where the atlas has no such root."""
    root = structures.filter(F.col("acronym") == root_acronym).select(F.col("id").alias("_root"))
    return structures.join(root, F.array_contains(F.col("path"), F.col("_root"))).drop("_root")


def region_thickness(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Total thickness per region over all shanks of a probe."""
    return bands.filter("region <> ''").groupBy(*keys, "region").agg(F.sum(F.col("bottom_um") - F.col("top_um")).alias("thickness_um"))


def region_adjacency(bands: DataFrame, track_keys: list[str], keys: list[str]) -> DataFrame:
    """Unordered pairs of different labelled regions that touch along a track."""
    w = Window.partitionBy(*track_keys).orderBy("band")
    pairs = bands.withColumn("_n", F.lead("region").over(w)).filter("region <> '' AND _n <> '' AND region <> _n")
    return pairs.select(*keys, F.least("region", "_n").alias("region_a"), F.greatest("region", "_n").alias("region_b")).distinct()


def run_length_labels(rows: DataFrame, keys: list[str], position: str, label: str) -> DataFrame:
    """Run-length encoding of labels in order."""
    w = Window.partitionBy(*keys).orderBy(position)
    changed = F.coalesce((~F.lag(label).over(w).eqNullSafe(F.col(label))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(changed)
    runs = rows.withColumn("_c", first).withColumn("run", F.sum("_c").over(w) - 1)
    return runs.groupBy(*keys, "run").agg(F.first(label).alias("label"), F.count(F.lit(1)).alias("n"))


def unroll_labels(runs: DataFrame, keys: list[str]) -> DataFrame:
    """K13 inverse: labels back to one row per sample, with a running offset per key."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.withColumn("_o", before).select(
        *keys, "label", "_o", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("_p", "_v")
    ).select(*keys, (F.col("_o") + F.col("_p")).alias("position"), "label")
