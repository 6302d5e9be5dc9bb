"""Depth-resolved spectral and firing features of recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelkeel.functions import constants as C
from voxelkeel.functions.interp import interp, knot_arrays
from voxelkeel.functions.ranges import range_join
from voxelkeel.session import cut_lineage, spread, unsized

#: Windows of the multiscale profile, and the largest as a fraction of the shank's extent.
WINDOW_LADDER_UM = (60.0, 100.0, 150.0, 220.0)
MAX_WINDOW_FRACTION = 1 / 3

#: Values of surrogates worked on at once: shanks of equal depths go together up to this many.
BLOCK_VALUES = 1 << 18

# --- windows and screening (W16, A11-A14, O01) ------------------------------------------------


def candidate_windows(recordings: DataFrame, *, window_s: float = 10.0, n_windows: int = 6) -> DataFrame:
    """Evenly spread windows per recording, each centred in its share and kept inside."""
    bad = F.raise_error(F.lit("fs must be positive")).cast("double")
    df = recordings.withColumn("_dur", F.when(F.col("fs") <= 0, bad).otherwise(F.col("n_samples") / F.col("fs")))
    df = df.filter("_dur > 0").withColumn("_w", F.least(F.lit(float(window_s)), F.col("_dur")))
    df = df.withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1)))) if n_windows >= 1 else df.limit(0).withColumn("win", F.lit(0))
    start = F.expr(f"least(greatest((win + 0.5D) * _dur / {n_windows} - _w / 2D, 0D), _dur - _w)")
    return df.withColumn("t_start_s", start).withColumn("t_end_s", F.expr("t_start_s + _w")).drop("_dur", "_w")


def samples_in_windows(samples: DataFrame, windows: DataFrame, *, bucket_s: float = 10.0) -> DataFrame:
    """Samples tagged with the windows they fall in."""
    return range_join(samples, windows, ["recording"], "t_s", "t_start_s", "t_end_s", bucket=bucket_s)


def median_reference(lfp: DataFrame, *, by_shank: bool = True) -> DataFrame:
    """Subtract the across-channel median of each sample (a few hundred channels)."""
    keys = ["recording", "win", "sample"] + (["shank"] if by_shank else [])
    return lfp.withColumn("uv", F.col("uv") - F.median("uv").over(Window.partitionBy(*keys)))


def artifact_score(lfp: DataFrame, *, k: float = 6.0, channel_fraction: float = 0.5) -> DataFrame:
    """Share of a window's samples where enough channels are far off their own median.

    Both medians are over one channel of one window (its fixed number of samples) and use the
    same partitioning, so they cost one shuffle.
    """
    w = Window.partitionBy("recording", "win", "channel")
    df = lfp.withColumn("_dev", F.abs(F.col("uv") - F.median("uv").over(w)))
    df = df.withColumn("_sd", F.median("_dev").over(w) * 1.4826)
    off = F.expr(f"CASE WHEN _sd > 0 AND _dev > {k}D * _sd THEN 1D ELSE 0D END")
    per_sample = df.groupBy("recording", "win", "sample").agg(F.avg(off).alias("_f"))
    return per_sample.groupBy("recording", "win").agg(F.avg((F.col("_f") >= channel_fraction).cast("double")).alias("artifact"))


def activity_score(lfp: DataFrame) -> DataFrame:
    """Population SD across channels of each channel's SD within the window."""
    per_channel = lfp.groupBy("recording", "win", "channel").agg(F.stddev_pop("uv").alias("_rms"))
    return per_channel.groupBy("recording", "win").agg(F.stddev_pop("_rms").alias("activity"))


def screen_windows(lfp: DataFrame, *, artifact_tolerance: float = 0.02) -> DataFrame:
    """Verdict per window after referencing; rejected windows stay, with the reason."""
    ref = median_reference(lfp)
    df = artifact_score(ref).join(unsized(activity_score(ref)), ["recording", "win"])
    reason = F.expr(f"CASE WHEN artifact > {artifact_tolerance}D THEN 'artifact' WHEN activity <= 0 THEN 'flat' END")
    return df.withColumn("reject_reason", reason).withColumn("kept", F.col("reject_reason").isNull())


def rank_epochs(verdicts: DataFrame, *, keep: int | None = None) -> DataFrame:
    """Kept windows by activity, those beyond ``keep`` demoted ahead of the rejected ones."""
    order = Window.partitionBy("recording").orderBy(F.desc("kept"), F.when(F.col("kept"), -F.col("activity")).asc_nulls_first(), "win")
    df = verdicts.withColumn("position", F.row_number().over(order))
    if keep is None:
        return df
    demote = F.col("kept") & (F.col("position") > keep)
    return df.withColumn("reject_reason", F.when(demote, F.coalesce("reject_reason", F.lit("not_among_best"))).otherwise(F.col("reject_reason"))
                         ).withColumn("kept", F.col("kept") & ~demote)


# --- spectra (A01-A04, A08, A36) ----------------------------------------------------------------


def lfp_psd(lfp: DataFrame, *, fmin: float = 0.0, fmax: float = 300.0) -> DataFrame:
    """Welch power of each channel of each window (Hann, half overlap, constant detrend, density).

    The transform runs per (recording, window), a fixed number of samples; windows are the
    parallelism.
    """
    def welch(pdf: pd.DataFrame) -> pd.DataFrame:
        fs = float(pdf["fs"].iloc[0])
        wide = pdf.pivot(index="sample", columns="channel", values="uv").sort_index()
        x = wide.to_numpy(dtype=float)
        n = len(x)
        seg = max(16, min(int(min(n, max(256, round(fs)))), n))
        seg = min(seg, n)
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
        starts = np.arange(0, n - seg + 1, seg - seg // 2)
        parts = np.stack([x[s:s + seg] for s in starts])
        parts = (parts - parts.mean(axis=1, keepdims=True)) * hann[None, :, None]
        power = np.abs(np.fft.rfft(parts, axis=1)) ** 2 / (fs * (hann ** 2).sum())
        power[:, 1:(-1 if seg % 2 == 0 else None)] *= 2
        freqs = np.fft.rfftfreq(seg, 1 / fs)
        ok = (freqs >= fmin) & (freqs <= fmax)
        mean = power.mean(axis=0)[ok]
        f, c = np.meshgrid(freqs[ok], wide.columns.to_numpy(), indexing="ij")
        return pd.DataFrame({"recording": pdf["recording"].iloc[0], "win": pdf["win"].iloc[0],
                             "channel": c.ravel(), "freq_hz": f.ravel(), "power": mean.ravel()})

    return spread(lfp.select("recording", "win", "channel", "sample", "uv", "fs"), "recording", "win").groupBy("recording", "win").applyInPandas(
        welch, "recording long, win int, channel int, freq_hz double, power double")


def excerpt_psd(psd: DataFrame) -> DataFrame:
    """Mean of the windows' spectra; windows are never joined end to end."""
    return psd.groupBy("recording", "channel", "freq_hz").agg(F.avg("power").alias("power"))


def band_power(psd: DataFrame, keys: list[str], bands=C.LFP_BANDS_HZ) -> DataFrame:
    """Mean power in each [lo, hi); a band without frequencies, or with a missing value, is null.

    One conditional aggregate per band, so a channel is read once and pre-aggregated in place.
    """
    inside = lambda lo, hi: f"freq_hz >= {lo}D AND freq_hz < {hi}D"
    aggs = [F.expr(f"""CASE WHEN count_if({inside(lo, hi)}) = count_if({inside(lo, hi)} AND power IS NOT NULL)
        THEN avg(CASE WHEN {inside(lo, hi)} THEN power END) END""").alias(f"_b{i}") for i, (lo, hi) in enumerate(bands)]
    wide = psd.groupBy(*keys).agg(*aggs)
    stack = ", ".join(f"{i}, _b{i}" for i in range(len(bands)))
    return wide.select(*keys, F.expr(f"stack({len(bands)}, {stack}) AS (band, power)"))


def normalise_bands(bands: DataFrame, group: list[str]) -> DataFrame:
    """log10 power minus the median channel of the same recording and band."""
    df = bands.withColumn("_l", F.log10(F.greatest("power", F.lit(1e-12))))
    df = df.withColumn("_l", F.when(F.col("power").isNotNull(), F.col("_l")))
    med = df.groupBy(*group, "band").agg(F.median("_l").alias("_m"))
    return df.join(med, [*group, "band"]).withColumn("level", F.col("_l") - F.col("_m")).drop("_l", "_m")


def regrid_frequency(psd: DataFrame, grid: list[float], keys: list[str]) -> DataFrame:
    """Spectra interpolated to the frequencies of ``grid``, null outside their own range."""
    packed = knot_arrays(psd.filter("power IS NOT NULL"), keys, "freq_hz", "power")
    return interp(packed.withColumn("freq_hz", F.explode(F.array(*[F.lit(float(f)) for f in grid]))), "power", F.col("freq_hz"), "xs", "ys", "null").select(*keys, "freq_hz", "power")


def power_image(psd: DataFrame, keys: list[str], depth: str, *, log: bool = True, per_freq: bool = False) -> DataFrame:
    """Map scaled to 0..255, missing cells 0 and left out of the scale; ``row_covered`` per depth."""
    value = "log10(power + 1e-12D)" if log else "power"
    df = psd.withColumn("_v", F.expr(f"CASE WHEN power IS NOT NULL AND NOT isnan({value}) THEN {value} END"))
    scale = keys + (["freq_hz"] if per_freq else [])
    rng = df.groupBy(*scale).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    rows = df.groupBy(*keys, depth).agg((F.count("_v") > 0).alias("row_covered"))
    df = df.join(rng, scale).join(rows, [*keys, depth])
    scaled = "least(1D, greatest(0D, (_v - _lo) / CASE WHEN _hi <= _lo THEN 1D ELSE _hi - _lo END))"
    return df.withColumn("level", F.expr(f"coalesce(CAST(floor({scaled} * 255D) AS INT), 0)")).drop("_v", "_lo", "_hi")


# --- spikes (S12, J03, A05, U01, O02) -------------------------------------------------------------


def load_spikes(spikes: DataFrame, sites: DataFrame, *, max_offsite_um: float = 50.0) -> DataFrame:
    """Spikes flagged ``on_site`` when within ``max_offsite_um`` of the recording's site span.

    Missing amplitudes are 0. Filter on the flag for use; keep it for the dropped count.
    """
    span = sites.groupBy("recording").agg(F.min("site_depth_um").alias("_lo"), F.max("site_depth_um").alias("_hi"))
    df = spikes.join(span, "recording", "left")
    on = F.expr(f"coalesce(depth_um >= _lo - {max_offsite_um}D AND depth_um <= _hi + {max_offsite_um}D, true)")
    return df.withColumns({"on_site": on, "amplitude": F.coalesce("amplitude", F.lit(0.0))}).drop("_lo", "_hi")


def spike_summary(spikes: DataFrame, keys: list[str]) -> DataFrame:
    """Kept and dropped counts, units and duration (last spike of all) per recording."""
    return spikes.groupBy(*keys).agg(
        F.count_if("on_site").alias("n_spikes"), F.count_if(~F.col("on_site")).alias("n_dropped_offsite"),
        F.count_distinct("unit").alias("n_units"), F.max("t_s").alias("duration_s"))


def restrict_to_epochs(spikes: DataFrame, epochs: DataFrame, *, bucket_s: float = 3600.0) -> DataFrame:
    """Spikes inside any [t0, t1) of their recording; a recording without epochs is not restricted."""
    some = epochs.select("recording").distinct()
    inside = range_join(spikes, epochs.select("recording", "t0", "t1"), ["recording"], "t_s", "t0", "t1", bucket=bucket_s, how="left_semi")
    free = spikes.join(some, "recording", "left_anti")
    return inside.select(*spikes.columns).unionByName(free)


def epoch_duration(epochs: DataFrame) -> DataFrame:
    """Kept seconds per recording; overlapping windows count twice."""
    return epochs.groupBy("recording").agg(F.sum(F.greatest(F.col("t1") - F.col("t0"), F.lit(0.0))).alias("duration_s"))


def depth_profiles(spikes: DataFrame, keys: list[str], *, bin_um: float = 10.0, min_spikes: int = 50,
                   durations: DataFrame | None = None) -> DataFrame:
    """Rate and mean amplitude per depth bin; null under ``min_spikes``; the last bin is closed.

    Counts are pre-aggregated per (recording, bin); the bin grid comes from the recording's
    range, so empty bins stay.
    """
    if bin_um <= 0:
        raise ValueError("bin_um must be positive")
    rng = spikes.groupBy(*keys).agg(F.min("depth_um").alias("_lo"), F.max("depth_um").alias("_hi"), F.max("t_s").alias("_dur"))
    if durations is not None:
        rng = rng.drop("_dur").join(durations.withColumnRenamed("duration_s", "_dur"), keys, "left")
    rng = rng.withColumn("_n", F.expr(f"CASE WHEN _hi > _lo THEN CAST(ceil((_hi - _lo) / {bin_um}D) AS BIGINT) ELSE 1L END"))
    binned = spikes.select(*keys, "depth_um", "amplitude").join(rng, keys).withColumn(
        "bin", F.expr(f"least(CAST(floor((depth_um - _lo) / {bin_um}D) AS BIGINT), _n - 1)"))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_c"), F.sum("amplitude").alias("_a"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    df = grid.join(counts, [*keys, "bin"], "left")
    return df.select(*keys, "bin", F.expr(f"_lo + (bin + 0.5D) * {bin_um}D AS centre_um"), F.coalesce("_c", F.lit(0)).alias("n_spikes"),
                     F.expr(f"CASE WHEN _c >= {min_spikes} AND _dur > 0 THEN _c / _dur END AS rate_hz"),
                     F.expr(f"CASE WHEN _c >= {min_spikes} THEN _a / _c END AS mean_amplitude"))


def all_spikes(*recordings: DataFrame) -> DataFrame:
    """Every recording's spikes together; each row keeps its recording, so clocks never merge."""
    out = recordings[0]
    for more in recordings[1:]:
        out = out.unionByName(more)
    return out


def thin_raster(spikes: DataFrame, keys: list[str], row_id: str, *, max_points: int, seed: int = 0) -> DataFrame:
    """A uniform, repeatable draw of exactly ``min(n, max_points)`` spikes per recording.

    Rows are ordered by a hash. Whole hash buckets are taken by their counts, and only the one
    bucket at the cut is ranked, so even a recording holding most of the rows is never sorted
    in one task.
    """
    df = spikes.withColumn("_h", F.xxhash64(F.lit(seed), F.col(row_id))).withColumn("_b", F.expr("shiftrightunsigned(_h, 48)"))
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    cut = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c")).filter(F.col("_before") < max_points)
    df = df.join(cut.select(*keys, "_b", "_upto", "_before"), [*keys, "_b"])
    whole = df.filter(F.col("_upto") <= max_points)
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", row_id))
    edge = df.filter(F.col("_upto") > max_points).withColumn("_r", rank).filter(F.col("_r") + F.col("_before") <= max_points).drop("_r")
    return whole.unionByName(edge).select(*spikes.columns)


# --- stacking (A06, A07) ----------------------------------------------------------------------------


def place_psd(psd: DataFrame, channels: DataFrame, *, bin_um: float = C.NP2_ROW_PITCH_UM) -> DataFrame:
    """A06 first stage: mean power per (penetration, shank, recording, bin, frequency).

    ``channels`` has ``shank, depth_from_tip_um, insertion_depth_um``; the tip sits at the
    deepest insertion of the penetration. The bin origin is per (penetration, shank).
    """
    ref = channels.groupBy("penetration").agg(F.max("insertion_depth_um").alias("reference_depth_um"))
    placed = channels.join(ref, "penetration").withColumn(
        "depth_um", F.expr(f"depth_from_tip_um + {C.NP2_TIP_TO_LOWEST_UM}D + reference_depth_um - insertion_depth_um"))
    origin = placed.groupBy("penetration", "shank").agg(F.expr(f"floor(min(depth_um) / {bin_um}D) * {bin_um}D AS origin_um"))
    placed = placed.join(origin, ["penetration", "shank"]).withColumn("bin", F.expr(f"CAST(floor((depth_um - origin_um) / {bin_um}D) AS BIGINT)"))
    rows = psd.join(placed.select("recording", "channel", "penetration", "shank", "origin_um", "bin", "depth_um"), ["recording", "channel"])
    return rows.groupBy("penetration", "shank", "recording", "origin_um", "bin", "freq_hz").agg(
        F.avg("power").alias("power"), F.min("depth_um").alias("_lo"), F.max("depth_um").alias("_hi"))


def level_offsets(cells: DataFrame, *, bin_um: float = C.NP2_ROW_PITCH_UM) -> DataFrame:
    """Per recording, the median log ratio to the widest recording over shared positive cells.

    The widest is the first one on ties. Overlap counts bins where both have data.
    """
    keys = ["penetration", "shank"]
    extent = cells.groupBy(*keys, "recording").agg(F.min("_lo").alias("top_um"), F.max("_hi").alias("bottom_um"))
    extent = extent.withColumn("_e", F.col("bottom_um") - F.col("top_um"))
    widest = extent.groupBy(*keys).agg(F.min(F.struct((-F.col("_e")).alias("e"), "recording")).alias("_w")).select(*keys, F.col("_w.recording").alias("widest"))
    ref = cells.join(widest, keys).filter("recording = widest AND power IS NOT NULL").select(*keys, "bin", "freq_hz", F.col("power").alias("_ref"))
    both = cells.filter("power IS NOT NULL").join(ref, [*keys, "bin", "freq_hz"])
    stats = both.groupBy(*keys, "recording").agg(
        F.median(F.when((F.col("_ref") > 0) & (F.col("power") > 0), F.log10("power") - F.log10("_ref"))).alias("_off"))
    # Bins count as shared when each recording has any frequency there, not necessarily the same one.
    has = cells.filter("power IS NOT NULL").select(*keys, "recording", "bin").distinct()
    ref_bins = has.join(widest, keys).filter("recording = widest").select(*keys, "bin")
    overlap = has.join(ref_bins, [*keys, "bin"]).groupBy(*keys, "recording").agg(F.count(F.lit(1)).alias("_ov"))
    df = extent.join(widest, keys).join(stats, [*keys, "recording"], "left").join(overlap, [*keys, "recording"], "left")
    is_ref = F.col("recording") == F.col("widest")
    return df.select(*keys, "recording", "top_um", "bottom_um", is_ref.alias("is_level_reference"),
                     F.when(~is_ref, F.col("_off")).alias("level_offset_dec"),
                     F.when(is_ref, 0.0).otherwise(F.coalesce("_ov", F.lit(0)) * float(bin_um)).alias("overlap_um"))


def stack_shank(cells: DataFrame, *, bin_um: float = C.NP2_ROW_PITCH_UM, match_levels: bool = True) -> DataFrame:
    """One depth x frequency map per shank; uncovered cells stay as nulls on the full grid."""
    keys = ["penetration", "shank"]
    cells = cut_lineage(cells)  # already binned: a small fraction of the spectra
    levelled = cells
    if match_levels:
        off = level_offsets(cells, bin_um=bin_um).select(*keys, "recording", "level_offset_dec")
        levelled = cells.join(off, [*keys, "recording"]).withColumn("power", F.expr("power / power(10D, coalesce(level_offset_dec, 0D))"))
    mean = levelled.groupBy(*keys, "bin", "freq_hz").agg(F.avg("power").alias("power"))
    freqs = cells.select(*keys, "freq_hz").distinct()
    size = cells.groupBy(*keys, "origin_um").agg(F.max("bin").alias("_last"))
    grid = size.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).join(freqs, keys)
    return grid.join(mean, [*keys, "bin", "freq_hz"], "left").select(
        *keys, (F.col("origin_um") + F.col("bin") * bin_um).alias("depth_um"), "freq_hz", "power")


# --- steps along depth (W05, W06, W08, W09, A35, A33) -------------------------------------------------


def contrast_at(profile: DataFrame, marks: DataFrame, keys: list[str], *, window: str, min_samples: int = 3) -> DataFrame:
    """Cohen's d of a feature across each marked depth ``at``: [at-w, at) against [at, at+w).

    Null below ``min_samples`` a side or without spread. ``marks`` has the keys, ``at`` and the
    window column.
    """
    group = [*keys, *(c for c in ("feature",) if c in profile.columns)]
    # Running counts and sums along depth, read off where each side of a mark begins and ends: samples and
    # marks are sorted together once, and no mark meets a sample. A mark goes before a sample at its depth.
    ends = F.array(*[F.struct(F.lit(i).alias("_end"), (F.col("at") + F.lit(float(i - 1)) * F.col(window)).alias("_at")) for i in range(3)])
    probes = marks.join(unsized(profile.select(*group).distinct()), keys).select(*group, window, "at", F.inline(ends)).withColumn("value", F.lit(None).cast("double"))
    samples = profile.select(*group, F.col("depth_um").alias("_at"), F.col("value").cast("double").alias("value"), F.lit(3).alias("_end"))
    rows = samples.unionByName(probes, allowMissingColumns=True)
    # Sums about the mean keep the variances well conditioned.
    rows = rows.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*group)))
    upto = Window.partitionBy(*group).orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.count_if(F.col("_end") == 3).over(upto), "_c": F.count("value").over(upto), "_s": F.coalesce(F.sum("value").over(upto), F.lit(0.0)), "_q": F.coalesce(F.sum(F.col("value") * F.col("value")).over(upto), F.lit(0.0))})
    at_end = [F.max(F.when(F.col("_end") == i, F.struct("_n", "_c", "_s", "_q"))).alias(f"_e{i}") for i in range(3)]
    agg = rows.filter("_end < 3").groupBy(*group, window, "at").agg(*at_end)
    for side, lo, hi in (("a", "_e0", "_e1"), ("b", "_e1", "_e2")):
        step = lambda f: F.col(f"{hi}.{f}") - F.col(f"{lo}.{f}")
        agg = agg.withColumns({f"_n{side}": step("_n"), f"_m{side}": F.when(step("_c") > 0, step("_s") / step("_c")), f"_v{side}": F.when(step("_c") > 0, step("_q") / step("_c"))})
        agg = agg.withColumn(f"_v{side}", F.greatest(F.lit(0.0), F.col(f"_v{side}") - F.col(f"_m{side}") * F.col(f"_m{side}")))
    # What rounding leaves of a side without spread is no spread.
    flat = "0.5D * (_va + _vb) > 1e-12D * greatest(_ma * _ma, _mb * _mb)"
    d = F.expr(f"""CASE WHEN _na >= {min_samples} AND _nb >= {min_samples} AND 0.5D * (_va + _vb) > 0 AND {flat}
        THEN abs(_ma - _mb) / sqrt(0.5D * (_va + _vb)) END""")
    return agg.filter("_na + _nb > 0").withColumn("contrast", d).select(*group, window, "at", "contrast")


def depth_marks(profile: DataFrame, windows: DataFrame, keys: list[str], *, step_um: float) -> DataFrame:
    """Marks every ``step_um`` from first depth + window up to (excluding) last depth - window."""
    rng = profile.groupBy(*keys).agg(F.min("depth_um").alias("_lo"), F.max("depth_um").alias("_hi"))
    df = rng.join(windows, keys).withColumn("_n", F.expr(f"CAST(ceil((_hi - window_um - (_lo + window_um)) / {step_um}D) AS BIGINT)"))
    df = spread(df.filter("_n > 0"), *keys).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return df.select(*keys, "window_um", F.expr(f"_lo + window_um + _i * {step_um}D AS at"))


def _two_sided(sums: list[np.ndarray], ends: list[np.ndarray], min_samples: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """W05 from running rows, known values, sums and squares along depth (last axis): rows around each mark, and Cohen's d or nan."""
    (na, ca, sa, qa), (nb, cb, sb, qb) = ([x[..., ends[e + 1]] - x[..., ends[e]] for x in sums] for e in (0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        ma, mb = sa / ca, sb / cb
        half = 0.5 * (np.maximum(0.0, qa / ca - ma * ma) + np.maximum(0.0, qb / cb - mb * mb))
        # What rounding leaves of a side without spread is no spread.
        ok = (na >= min_samples) & (nb >= min_samples) & (half > 1e-12 * np.maximum(ma * ma, mb * mb)) & (half > 0)
        return na + nb, np.where(ok, np.abs(ma - mb) / np.sqrt(half), np.nan)


def contrast_grid(profile: DataFrame, windows: DataFrame, keys: list[str], *, step_um: float, per_feature: bool, min_samples: int = 3) -> DataFrame:
    """W05 on a regular grid of each shank: as :func:`contrast_at` at :func:`depth_marks`, from running sums of one shank.

    With ``per_feature`` a row per feature, window and mark that has samples; else ``score``, the mean
    over features that have a contrast (0 where none has), a row per window and mark. A shank's few hundred depths are one
    group; its marks are made inside it, so no more rows are sorted than the profile has.
    """
    value = "contrast" if per_feature else "score"

    def contrasts(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, parts = pdf["depth_um"].min(), pdf["depth_um"].max(), []
        sides = []
        for feature, g in pdf.groupby("feature", sort=True):
            g = g.sort_values("depth_um")
            v = g["value"].to_numpy(float)
            known = np.isfinite(v)
            # Sums about the mean keep the variances well conditioned.
            v = np.where(known, v - (v[known].mean() if known.any() else 0.0), 0.0)
            sides.append((feature, g["depth_um"].to_numpy(float), [np.concatenate([[0.0], np.cumsum(x)]) for x in (np.ones(len(v)), known, v, v * v)]))
        for w in pdf["windows"].iloc[0]:
            at = lo + w + np.arange(max(0, int(np.ceil((hi - w - (lo + w)) / step_um)))) * step_um
            total, count = np.zeros(len(at)), np.zeros(len(at))
            for feature, depth, sums in sides:
                ends = [np.searchsorted(depth, at + d, side="left") for d in (-w, 0.0, w)]
                near, d = _two_sided(sums, ends, min_samples)
                ok = ~np.isnan(d)
                if per_feature:
                    some = near > 0
                    parts.append(pd.DataFrame({"feature": feature, "window_um": w, "at": at[some], value: d[some]}))
                else:
                    total, count = total + np.where(ok, d, 0.0), count + ok
            if not per_feature:
                parts.append(pd.DataFrame({"window_um": w, "at": at, value: np.where(count > 0, total / np.maximum(count, 1), 0.0)}))
        out = pd.concat(parts, ignore_index=True)
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[names]

    types = {f.name: f.dataType.simpleString() for f in profile.schema.fields}
    names = [*keys, *(["feature"] if per_feature else []), "window_um", "at", value]
    schema = ", ".join(f"{c} {types.get(c, 'double')}" if c in (*keys, "feature") else f"{c} double" for c in names)
    listed = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("window_um").cast("double"))).alias("windows"))
    rows = profile.select(*keys, F.col("feature"), F.col("depth_um").cast("double"), F.col("value").cast("double")).join(unsized(listed), keys)
    out = spread(rows, *keys).groupBy(*keys).applyInPandas(contrasts, schema)
    return out.withColumn(value, F.expr(f"CASE WHEN NOT isnan({value}) THEN {value} END"))


def contrast_null(profile: DataFrame, keys: list[str], *, window_um: float = 150.0, step_um: float = 25.0) -> DataFrame:
    """Contrasts over a regular grid, for comparison with a boundary's own."""
    windows = profile.select(*keys).distinct().withColumn("window_um", F.lit(float(window_um)))
    return contrast_grid(profile, windows, keys, step_um=step_um, per_feature=True).filter("contrast IS NOT NULL")


def bad_channels(profile: DataFrame, keys: list[str], *, k: float = 5.0, neighbours: int = 9) -> DataFrame:
    """Depths whose mean level is far from the local median, or missing (needs five depths).

    A shank is a few hundred depths; the running median takes the middle of a sorted frame.
    """
    half = max(1, neighbours // 2)
    level = profile.groupBy(*keys, "depth_um").agg(F.avg("value").alias("_l"))
    frame = Window.partitionBy(*keys).orderBy("depth_um").rowsBetween(-half, half)
    df = level.withColumn("_near", F.array_sort(F.collect_list("_l").over(frame)))
    df = df.withColumn("_r", F.expr("_l - (get(_near, CAST(floor((size(_near) - 1) / 2) AS INT)) + get(_near, CAST(floor(size(_near) / 2) AS INT))) / 2D"))
    centre = df.groupBy(*keys).agg(F.median("_r").alias("_c"), F.count(F.lit(1)).alias("_n"))
    df = df.join(unsized(centre), keys)
    spread = df.groupBy(*keys).agg((F.median(F.abs(F.col("_r") - F.col("_c"))) * 1.4826).alias("_s"))
    bad = F.expr(f"_n >= 5 AND (_l IS NULL OR coalesce(_s > 0 AND abs(_r) > {k}D * _s, false))")
    return df.join(unsized(spread), keys).select(*keys, "depth_um", bad.alias("bad"))


def interpolate_bad(profile: DataFrame, keys: list[str], **options) -> DataFrame:
    """Values at bad depths replaced by linear interpolation between good ones, held at the ends."""
    flags = bad_channels(profile, keys, **options)
    df = profile.join(unsized(flags), [*keys, "depth_um"])
    w = Window.partitionBy(*keys, "feature").orderBy("depth_um")
    knot = F.when(~F.col("bad"), F.struct("depth_um", "value"))
    df = df.withColumns({"_lo": F.last(knot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                         "_hi": F.first(knot, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    fixed = F.expr("""CASE WHEN NOT bad OR (_lo IS NULL AND _hi IS NULL) THEN value WHEN _lo IS NULL THEN _hi.value WHEN _hi IS NULL THEN _lo.value
        ELSE _lo.value + (_hi.value - _lo.value) * (depth_um - _lo.depth_um) / (_hi.depth_um - _lo.depth_um) END""")
    return df.withColumn("value", fixed).select(*keys, "feature", "depth_um", "value", "bad")


def standardise(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Each feature of a shank to zero mean and unit SD (SD 1 where it has none)."""
    st = profile.groupBy(*keys, "feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.expr("(value - _m) / CASE WHEN _s > 0 AND NOT isnan(_s) THEN _s ELSE 1D END")
    return profile.join(unsized(st), [*keys, "feature"]).withColumn("value", z).drop("_m", "_s")


def step_profile(profile: DataFrame, windows: DataFrame, keys: list[str], *, step_um: float = 20.0, reject_bad: bool = True) -> DataFrame:
    """Mean contrast over standardised features at every grid depth; 0 where none is defined.

    ``windows`` gives one or more ``window_um`` per shank. Shanks need four depths.
    """
    clean = interpolate_bad(profile, keys) if reject_bad else profile
    z = standardise(clean.select(*keys, "feature", "depth_um", "value"), keys)
    n = profile.groupBy(*keys).agg(F.count_distinct("depth_um").alias("_n")).filter("_n >= 4").drop("_n")
    return contrast_grid(z.join(unsized(n), keys, "left_semi"), windows, keys, step_um=step_um, per_feature=False)


def adaptive_windows(profile: DataFrame, keys: list[str], *, ladder=WINDOW_LADDER_UM, max_fraction: float = MAX_WINDOW_FRACTION) -> DataFrame:
    """The ladder's windows up to a third of the shank's extent, else the smallest."""
    ext = profile.groupBy(*keys).agg((F.max("depth_um") - F.min("depth_um")).alias("_e"))
    rungs = ", ".join(f"{w!r}D" for w in ladder)
    usable = f"filter(array({rungs}), w -> w <= _e * {max_fraction!r}D)"
    return ext.select(*keys, F.expr(f"explode(CASE WHEN size({usable}) > 0 THEN {usable} ELSE array({min(ladder)!r}D) END) AS window_um"))


def _running(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and squares along depth (first axis), row by row since rows lie together."""
    c1, c2 = np.zeros((len(z) + 1, *z.shape[1:])), np.zeros((len(z) + 1, *z.shape[1:]))
    for c, v in ((c1, z), (c2, z * z)):
        for i in range(len(z)):
            np.add(c[i], v[i], out=c[i + 1])
    return c1, c2


def _contrast_curve(depths: np.ndarray, z: np.ndarray, window: float, step: float, running: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """W06 at every mark of one profile, by running sums: mean contrast over features (last axis of ``z``), else 0."""
    marks = np.arange(depths[0] + window, depths[-1] - window, step)
    ends = [np.searchsorted(depths, marks + d, side="left") for d in (-window, 0.0, window)]
    # Sums about the column mean keep the variances well conditioned.
    c1, c2 = running or _running(z)

    def side(lo, hi):
        n = (hi - lo).reshape(len(marks), *(1 for _ in z.shape[1:]))
        mean, var = c1[hi], c2[hi]
        mean -= c1[lo]
        mean /= n
        var -= c2[lo]
        var /= n
        var -= mean * mean
        return mean, np.maximum(var, 0.0, out=var)

    with np.errstate(divide="ignore", invalid="ignore"):
        (mean, var), (mean_b, var_b) = side(ends[0], ends[1]), side(ends[1], ends[2])
        mean -= mean_b
        var += var_b
        var *= 0.5
        d = np.abs(mean, out=mean)
        d /= np.sqrt(var, out=var)
    d[(ends[1] - ends[0] < 3) | (ends[2] - ends[1] < 3)] = np.nan
    known = np.isfinite(d)
    if known.all():
        total, counts = d[..., 0].copy(), d.shape[-1]
        for i in range(1, d.shape[-1]):
            total += d[..., i]
        return marks, total / counts
    counts = known.sum(axis=-1)
    return marks, np.where(counts > 0, np.where(known, d, 0.0).sum(axis=-1) / np.maximum(counts, 1), 0.0)


def _surrogates(pdf: pd.DataFrame, n_surrogates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Depths of one shank and its standardised phase-randomised copies (depth, surrogate, feature).

    One generator per shank draws surrogate by surrogate and feature by feature. Values at the
    same depth of a feature count as their mean.
    """
    wide = pdf.groupby(["depth_um", "feature"])["value"].mean().unstack()
    filled = wide.interpolate(method="linear", limit_direction="both").fillna(0.0).to_numpy(dtype=float)
    return wide.index.to_numpy(dtype=float), _phase_copies(filled, n_surrogates, seed)


def _phase_copies(filled: np.ndarray, n_surrogates: int, seed: int) -> np.ndarray:
    """Standardised phase-randomised copies of values (depth, ..., feature) as (depth, ..., surrogate, feature)."""
    n = len(filled)
    spectra, rng = np.abs(np.fft.rfft(filled, axis=0)), np.random.default_rng(seed)
    phases = rng.uniform(0.0, 2.0 * np.pi, size=(n_surrogates, filled.shape[-1], len(spectra))).transpose(2, 0, 1)
    phases[0] = 0.0
    if n % 2 == 0:
        phases[-1] = 0.0
    turns = np.exp(1j * phases).reshape(len(spectra), *(1 for _ in filled.shape[2:]), n_surrogates, filled.shape[-1])
    copies = np.fft.irfft(spectra[..., None, :] * turns, n=n, axis=0)
    spread = copies.std(axis=0)
    return (copies - copies.mean(axis=0)) / np.where(spread > 0, spread, 1.0)


def _null_scores(depths: np.ndarray, copies: np.ndarray, windows, step_um: float, percentile: float) -> tuple[dict[float, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A35 of shanks with equal depths: (centre, spread) by window, and the null level, each by shank.

    ``copies`` is (depth, shank, surrogate, feature).
    """
    stats, peak, running = {}, np.full(copies.shape[1:3], -np.inf), _running(copies)
    for w in windows:
        scores = _contrast_curve(depths, copies, float(w), step_um, running)[1]  # mark, shank, surrogate
        if not scores.size:
            continue
        scores = np.ascontiguousarray(scores.transpose(1, 2, 0))
        flat = scores.reshape(len(scores), -1)
        centre = np.median(flat, axis=1)
        dev = np.median(np.abs(flat - centre[:, None]), axis=1) * 1.4826
        dev = np.where(dev > 0, dev, 1.0)
        stats[float(w)] = (centre, dev)
        peak = np.maximum(peak, (scores.max(axis=2) - centre[:, None]) / dev[:, None])
    return stats, np.quantile(peak, percentile, axis=1) if stats else np.full(len(peak), np.nan)


def null_calibration(profile: DataFrame, windows: DataFrame, keys: list[str], *, step_um: float = 20.0, n_surrogates: int = 16,
                     percentile: float = 0.9, seed: int = 0) -> DataFrame:
    """Per (shank, window) ``centre`` and ``spread`` of surrogate contrast, and the shank's ``null_z``.

    Shanks need eight depths; ``null_z`` is a percentile of the surrogates' peak z. A shank's few hundred
    depths are one group, and only its statistics leave it: the curves are many times the profile.
    """
    def calibrate(pdf: pd.DataFrame) -> pd.DataFrame:
        depths, z = _surrogates(pdf, n_surrogates, seed)
        found, null = _null_scores(depths, z[:, None], pdf["windows"].iloc[0], step_um, percentile)
        stats, null = [(w, centre[0], dev[0]) for w, (centre, dev) in found.items()], null[0]
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in keys), *s, null) for s in stats], columns=[*keys, "window_um", "centre", "spread", "null_z"])

    enough = profile.groupBy(*keys).agg(F.count_distinct("depth_um").alias("_n")).filter("_n >= 8").drop("_n")
    listed = windows.groupBy(*keys).agg(F.array_sort(F.collect_list("window_um")).alias("windows")).join(unsized(enough), keys)
    types = {f.name: f.dataType.simpleString() for f in profile.schema.fields}
    cols = ", ".join([*(f"{c} {types[c]}" for c in keys), "window_um double", "centre double", "spread double", "null_z double"])
    rows = profile.select(*keys, "feature", "depth_um", "value").join(unsized(listed), keys)
    return spread(rows, *keys).groupBy(*keys).applyInPandas(calibrate, cols)


def _middle(ordered: np.ndarray) -> np.ndarray:
    """Median along the last axis of sorted values whose nan lie behind; nan where there are no others."""
    n = (~np.isnan(ordered)).sum(axis=-1, keepdims=True)
    return 0.5 * (np.take_along_axis(ordered, np.maximum(n - 1, 0) // 2, axis=-1) + np.take_along_axis(ordered, np.minimum(n // 2, ordered.shape[-1] - 1), axis=-1))[..., 0]


def _bad_depths(level: np.ndarray, k: float = 5.0, neighbours: int = 9) -> np.ndarray:
    """W08 on mean levels (shank, depth): far from the local median, or without a finite level."""
    half = max(1, neighbours // 2)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(level, ((0, 0), (half, half)), constant_values=np.nan), 2 * half + 1, axis=1)
    with np.errstate(invalid="ignore"):
        off = level - _middle(np.sort(near, axis=-1))
        scale = 1.4826 * _middle(np.sort(np.abs(off - _middle(np.sort(off, axis=-1))[:, None]), axis=-1))[:, None]
        return (level.shape[1] >= 5) & (~np.isfinite(level) | ((scale > 0) & (np.abs(off) > k * scale)))


def _clean_sums(depths: np.ndarray, cell: np.ndarray, value: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values of shanks with equal depths, by (shank, feature, depth): their means, nan where there is none, and of what
    W08 leaves, standardised, the rows, known values, sums and squares that a depth holds, running along depth."""
    n = shape[2]
    held = lambda w=None: np.bincount(cell, weights=w, minlength=shape[0] * shape[1] * n).reshape(shape)
    known = ~np.isnan(value)
    rows, count, total = held(), held(known), held(np.where(known, value, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(count > 0, total / count, np.nan)
        bad = _bad_depths(total.sum(axis=1) / count.sum(axis=1))[:, None, :]
        # A bad depth takes the line between the good rows of its feature on both sides, held at the ends.
        good, at = (rows > 0) & ~bad, np.arange(n)
        lo = np.maximum.accumulate(np.where(good, at, -1), axis=-1)
        hi = np.minimum.accumulate(np.where(good, at, n)[..., ::-1], axis=-1)[..., ::-1]
        i, j = np.maximum(lo, 0), np.minimum(hi, n - 1)
        a, b = np.take_along_axis(mean, i, axis=-1), np.take_along_axis(mean, j, axis=-1)
        line = np.where(lo < 0, b, np.where(hi >= n, a, a + (b - a) * (depths - depths[i]) / (depths[j] - depths[i])))
        new = bad & (rows > 0) & ((lo >= 0) | (hi < n))
        count = np.where(new, np.where(np.isnan(line), 0, rows), count)
        line = np.where(new & (count > 0), line, 0.0)
        size = count.sum(axis=-1, keepdims=True)
        centre = np.where(new, count * line, total).sum(axis=-1, keepdims=True) / size
        off = np.where(known & ~new.ravel()[cell], value - centre.ravel()[cell // n], 0.0)
        moved = np.where(new & (count > 0), line - centre, 0.0)
        sums, squares = held(off) + count * moved, held(off * off) + count * moved * moved
        spread = np.sqrt(squares.sum(axis=-1, keepdims=True) / size)
        spread = np.where(spread > 0, spread, 1.0)
    start = np.zeros((*shape[:2], 1))
    return mean, [np.concatenate([start, np.cumsum(c, axis=-1)], axis=-1) for c in (rows, count, sums / spread, squares / spread ** 2)]


def _filled(mean: np.ndarray) -> np.ndarray:
    """Missing values along the last axis on the line between their neighbours by position, held at the ends; 0 without any."""
    n = mean.shape[-1]
    there, at = ~np.isnan(mean), np.arange(n)
    if there.all():
        return mean
    lo = np.maximum.accumulate(np.where(there, at, -1), axis=-1)
    hi = np.minimum.accumulate(np.where(there, at, n)[..., ::-1], axis=-1)[..., ::-1]
    i, j = np.where(lo < 0, np.minimum(hi, n - 1), lo), np.where(hi >= n, np.maximum(lo, 0), hi)
    a, b = np.take_along_axis(mean, i, axis=-1), np.take_along_axis(mean, j, axis=-1)
    return np.nan_to_num(np.where(there, mean, a + (b - a) / np.maximum(j - i, 1) * (at - i)), nan=0.0, posinf=np.inf, neginf=-np.inf)


def _best_scales(depths: np.ndarray, mean: np.ndarray, sums: list[np.ndarray], step_um: float, null_step_um: float,
                 n_surrogates: int, seed: int, percentile: float) -> tuple[np.ndarray, ...] | None:
    """W06 multiscale of shanks with equal depths: grid, best z and its window by (shank, grid depth), null level by shank."""
    lo, hi = depths[0], depths[-1]
    windows = [w for w in WINDOW_LADDER_UM if w <= (hi - lo) * MAX_WINDOW_FRACTION] or [min(WINDOW_LADDER_UM)]
    copies = _phase_copies(np.ascontiguousarray(_filled(mean).transpose(2, 0, 1)), n_surrogates, seed)
    stats, null = _null_scores(depths, copies, windows, null_step_um, percentile)
    if not stats:
        return None
    grid = lo + np.arange(int(np.ceil((hi + step_um - lo) / step_um))) * step_um
    best, scale = np.full((len(mean), len(grid)), -np.inf), np.full((len(mean), len(grid)), np.nan)
    for w, (centre, dev) in stats.items():
        at = lo + w + np.arange(int(np.ceil((hi - w - (lo + w)) / step_um))) * step_um
        d = _two_sided(sums, [np.searchsorted(depths, at + e, side="left") for e in (-w, 0.0, w)])[1]
        count = (~np.isnan(d)).sum(axis=1)
        z = (np.where(count > 0, np.nansum(d, axis=1) / np.maximum(count, 1), 0.0) - centre[:, None]) / dev[:, None]
        seen = np.flatnonzero((grid >= at[0]) & (grid <= at[-1]))
        i = np.clip(np.searchsorted(at, grid[seen], side="right") - 1, 0, max(len(at) - 2, 0))
        j = np.minimum(i + 1, len(at) - 1)
        slope = (z[:, j] - z[:, i]) / np.where(j > i, at[j] - at[i], 1.0)
        # At the last mark the line is drawn from there, so that it gives the mark's own value.
        end = grid[seen] >= at[-1]
        z = np.where(end, z[:, j], z[:, i] + slope * (grid[seen] - at[i]))
        better = z > best[:, seen]
        best[:, seen] = np.where(better, z, best[:, seen])
        scale[:, seen] = np.where(better, w, scale[:, seen])
    return grid, np.where(np.isnan(scale), np.nan, best), scale, null


def multiscale_profile(profile: DataFrame, keys: list[str], *, step_um: float = 5.0, n_surrogates: int = 16, seed: int = 0,
                       null_step_um: float = 20.0, percentile: float = 0.9) -> DataFrame:
    """W06 multiscale: best calibrated z over windows on a common grid, its window, and the null level.

    As :func:`step_profile` at :func:`adaptive_windows`, set off against :func:`null_calibration` and drawn on the grid, but
    in one pass: the profile is shuffled once and its rows leave their shank only as the result. Shanks of a batch that
    have the same depths are worked out together, since their marks, sides and random phases are the same. Rows without
    key, depth or feature take no part, a value that is null or nan is missing, and shanks need eight depths.
    """
    def whole(frames):
        """Rows lie together by shank; a batch's last shank waits for the next batch."""
        held = None
        for pdf in frames:
            if pdf.empty:
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            shank = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            last = np.searchsorted(shank, shank[-1])
            held = pdf.iloc[last:]
            if last:
                yield pdf.iloc[:last], shank[:last]
        if held is not None:
            yield held, np.zeros(len(held), int)

    def ranked(shank, x):
        """Rank of ``x`` among its shank's distinct values, those values, and where each shank's begin and end."""
        order = np.lexsort((x, shank))
        s, y = shank[order], x[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        new = first | np.concatenate([[True], y[1:] != y[:-1]])
        number = np.cumsum(new) - 1
        bounds = np.append(number[first], number[-1] + 1)
        rank = np.empty(len(x), int)
        rank[order] = number - bounds[s]
        return rank, y[new], bounds

    def scales(frames):
        for pdf, shank in whole(frames):
            depth, value = pdf["depth_um"].to_numpy(float), pdf["value"].to_numpy(float)
            at, depths, begin = ranked(shank, depth)
            feature, _, features = ranked(shank, pd.factorize(pdf["feature"], sort=True)[0])
            begin_row, alike = np.searchsorted(shank, np.arange(shank[-1] + 2)), {}
            for i in np.flatnonzero(np.diff(begin) >= 8):
                alike.setdefault((depths[begin[i]:begin[i + 1]].tobytes(), features[i + 1] - features[i]), []).append(i)
            for (xs, n_features), members in alike.items():
                xs = np.frombuffer(xs)
                size = max(1, BLOCK_VALUES // (n_surrogates * n_features * len(xs)))
                for block in (members[i:i + size] for i in range(0, len(members), size)):
                    rows = np.concatenate([np.arange(begin_row[i], begin_row[i + 1]) for i in block])
                    place = np.repeat(np.arange(len(block)), [begin_row[i + 1] - begin_row[i] for i in block])
                    cell = (place * n_features + feature[rows]) * len(xs) + at[rows]
                    found = _best_scales(xs, *_clean_sums(xs, cell, value[rows], (len(block), n_features, len(xs))), step_um, null_step_um, n_surrogates, seed, percentile)
                    if found is not None:
                        grid, z, scale, null = found
                        out = pdf[keys].iloc[np.repeat(begin_row[block], len(grid))].reset_index(drop=True)
                        yield out.assign(depth_um=np.tile(grid, len(block)), z=z.ravel(), scale_um=scale.ravel(), null_z=np.repeat(null, len(grid)))

    types = {f.name: f.dataType.simpleString() for f in profile.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "depth_um double, z double, scale_um double, null_z double"])
    rows = profile.select(*keys, "feature", F.col("depth_um").cast("double"), F.col("value").cast("double")).dropna(subset=[*keys, "feature", "depth_um"])
    out = spread(rows, *keys).sortWithinPartitions(*keys).mapInPandas(scales, schema)
    return out.withColumns({c: F.expr(f"CASE WHEN NOT isnan({c}) THEN {c} END") for c in ("z", "scale_um")})


def profile_peaks(profile: DataFrame, keys: list[str], *, min_z: float = 2.0) -> DataFrame:
    """Local maxima at or above the shank's null level; the two end points never count."""
    w = Window.partitionBy(*keys).orderBy("depth_um")
    df = profile.withColumns({"_l": F.lag("z").over(w), "_r": F.lead("z").over(w), "_rn": F.row_number().over(w),
                              "_end": F.lead("depth_um").over(w).isNull()})
    return df.filter(f"_rn > 1 AND NOT _end AND z >= coalesce(null_z, {min_z}D) AND (_l IS NULL OR z >= _l) AND (_r IS NULL OR z > _r)").drop("_l", "_r", "_rn", "_end")


def detect_boundaries(profile: DataFrame, keys: list[str], *, min_separation_um: float = 120.0, max_n: int | None = None) -> DataFrame:
    """Peaks strongest first at least ``min_separation_um`` apart, with prominence and weight.

    The floor of each peak is a windowed minimum; the greedy choice sees only a shank's peaks.
    """
    span = max(float(min_separation_um), 1.0)
    near = Window.partitionBy(*keys).orderBy("depth_um").rangeBetween(-int(span), int(span))
    peaks = profile_peaks(profile.withColumn("_floor", F.min("z").over(near)), keys)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        depth, z = pdf["depth_um"].to_numpy(float), pdf["z"].to_numpy(float)
        order = np.lexsort((depth, -z))
        # how far each peak is from the nearest one kept so far, brought up to date once per kept peak
        gap, kept = np.full(len(depth), np.inf), []
        for i in order:
            if gap[i] >= span:
                kept.append(i)
                gap = np.minimum(gap, np.abs(depth - depth[i]))
            if max_n is not None and len(kept) >= max_n:
                break
        return pdf.iloc[kept]

    cols = [*keys, "depth_um", "z", "scale_um", "_floor"]
    chosen = spread(peaks.select(*cols), *keys).groupBy(*keys).applyInPandas(choose, peaks.select(*cols).schema)
    return chosen.select(*keys, "depth_um", "z", (F.col("z") - F.col("_floor")).alias("prominence"), "scale_um",
                         F.greatest(F.lit(0.0), F.least("z", F.col("z") - F.col("_floor"))).alias("weight"))


def step_evidence(psd: DataFrame, keys: list[str], depth: str = "depth_um") -> DataFrame:
    """Detected boundaries per shank from its depth x frequency map (eight rows with data at least)."""
    rows = psd.groupBy(*keys, depth).agg(F.count("power").alias("_c")).filter("_c > 0")
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 8").select(*keys)
    kept = psd.join(enough, keys, "left_semi").join(rows.select(*keys, depth), [*keys, depth], "left_semi")
    kept = cut_lineage(kept)
    bands = band_power(kept, [*keys, depth]).select(*keys, F.col("band").alias("feature"), F.col(depth).alias("depth_um"), F.col("power").alias("value"))
    return detect_boundaries(multiscale_profile(cut_lineage(bands), keys), keys)
