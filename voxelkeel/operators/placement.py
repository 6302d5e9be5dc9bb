"""Where every site of every shank sits: layouts, landmark maps, straight and curved tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelkeel.functions import constants as C
from voxelkeel.functions.interp import interp
from voxelkeel.session import spread

_AXES = ("ap", "ml", "dv")
NP1, NP2 = "Neuropixels 1.0", "Neuropixels 2.0 (4-shank)"
POLY3 = "NeuroNexus A1x32-Poly3-10mm-25s-177-OA32LP"
POLY2 = "NeuroNexus A1x32-Poly2-10mm-50s-177-OA32LP"
CATALOG = (NP1, NP2, POLY3, POLY2)


def grid_layout(spark: SparkSession, name: str, n_channels: int, *, tip_um: float, row_pitch_um: float,
                n_columns: int = 1, col_pitch_um: float = 0.0) -> DataFrame:
    """The generic column-interleaved grid."""
    k = F.col("id")
    col = k % n_columns
    centre = (n_columns - 1) * col_pitch_um / 2.0
    usable = n_channels // n_columns * n_columns
    return spark.range(usable).select(
        F.lit(name).alias("layout"), k.cast("int").alias("channel"),
        (F.lit(float(tip_um)) + k * float(row_pitch_um)).alias("depth_from_tip_um"),
        (col * float(col_pitch_um) - centre).alias("lateral_um"),
    )


def probe_layouts(spark: SparkSession) -> DataFrame:
    """``layout, channel, depth_from_tip_um, lateral_um`` of the known probes (832 rows)."""
    k = F.col("id")
    row, col = F.floor(k / 2), k % 2

    def paired(name: str, tip: float, pitch: float, odd_left: float) -> DataFrame:
        left = F.when(row % 2 == 0, 27.0).otherwise(odd_left)
        return spark.range(384).select(
            F.lit(name).alias("layout"), k.cast("int").alias("channel"),
            (tip + row * pitch).cast("double").alias("depth_from_tip_um"),
            (left + col * 32.0 - 35.0).alias("lateral_um"))

    # Three columns: 12 centre sites at 25 um, 10 on each side half a pitch higher.
    centre = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda r: F.struct((62.0 + r * 25.0).alias("d"), F.lit(0.0).alias("x")))

    def side(x: float) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda r: F.struct((74.5 + r * 25.0).alias("d"), F.lit(x).alias("x")))

    poly3 = spark.range(1).select(F.posexplode(F.array_sort(F.concat(centre, side(-18.0), side(18.0)))).alias("channel", "s")).select(
        F.lit(POLY3).alias("layout"), F.col("channel"), F.col("s.d").alias("depth_from_tip_um"), F.col("s.x").alias("lateral_um"))
    poly2 = spark.range(32).select(
        F.lit(POLY2).alias("layout"), k.cast("int").alias("channel"), (75.0 + k * 25.0).alias("depth_from_tip_um"),
        F.when(k % 2 == 0, -21.5).otherwise(21.5).alias("lateral_um"))
    return (paired(NP1, 220.0, 20.0, 11.0).unionByName(paired(NP2, 217.0, 15.0, 27.0))
            .unionByName(poly3).unionByName(poly2))


def resolve_layout(probe_type: Column) -> Column:
    """Exact name, else the first layout sharing the first eight letters, else NP 1.0."""
    head = F.lower(F.substring(probe_type, 1, 8))
    out = F.when(probe_type.isin(*CATALOG), probe_type)
    for name in CATALOG:
        out = out.when(F.lit(name.lower()).startswith(head), name)
    return out.otherwise(NP1)


def with_sites(shanks: DataFrame, probe_type: str = "probe_type") -> DataFrame:
    """Every shank with every site of its layout. The layouts are a fixed 832 rows."""
    sites = probe_layouts(shanks.sparkSession)
    return shanks.withColumn("layout", resolve_layout(F.col(probe_type))).join(F.broadcast(sites), "layout")


# --- landmarks ------------------------------------------------------------------------------


def alignment_arrays(points: DataFrame, keys: list[str]) -> DataFrame:
    """Landmark pairs of a shank in their own order, as arrays ``fs`` and ``ts``."""
    packed = points.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "feature_um", "track_um"))).alias("_p"))
    return packed.select(*keys, F.col("_p.feature_um").alias("fs"), F.col("_p.track_um").alias("ts"))


def fit_tails(aligned: DataFrame, mode: str = "extremes_mode", *, extend_um: float = 1e6) -> DataFrame:
    """P25: arrays ``ff`` and ``tf`` with the tails handled as ``mode`` says.

    Without user pairs (two entries) or with mode ``none`` the pairs are used as they are.
    """
    total = lambda xs: f"aggregate({xs}, 0D, (a, x) -> a + x)"
    df = aligned.withColumns({
        "_n": F.size("fs"),
        "_how": F.expr(f"CASE WHEN size(fs) <= 2 OR {mode} = 'none' THEN 'as_is' WHEN {mode} = 'linear' AND size(fs) >= 5 THEN 'linear' ELSE 'uniform' END"),
        "_fi": F.expr("slice(fs, 2, greatest(size(fs) - 2, 0))"), "_ti": F.expr("slice(ts, 2, greatest(size(ts) - 2, 0))"),
    })
    # Uniform tails: the outer pairs move by the neighbouring change of (feature - track).
    df = df.withColumns({
        "_first": F.expr("(fs[1] - ts[1]) - (fs[0] - ts[0])"),
        "_last": F.expr("(get(fs, _n - 1) - get(ts, _n - 1)) - (get(fs, _n - 2) - get(ts, _n - 2))"),
        "_mf": F.expr(f"CASE WHEN _n > 2 THEN {total('_fi')} / (_n - 2) END"),
        "_mt": F.expr(f"CASE WHEN _n > 2 THEN {total('_ti')} / (_n - 2) END"),
    })
    # Linear tails: least squares through the interior pairs, evaluated far outside.
    sxy, sxx = total("zip_with(_fi, _ti, (f, t) -> (f - _mf) * (t - _mt))"), total("transform(_fi, f -> (f - _mf) * (f - _mf))")
    df = df.withColumns({
        "_slope": F.expr(f"CASE WHEN _how = 'linear' THEN {sxy} / {sxx} END"),
        "_lo": F.expr(f"ts[0] - {extend_um!r}D"), "_hi": F.expr(f"get(ts, _n - 1) + {extend_um!r}D"),
    })
    return df.withColumns({
        "ff": F.expr("CASE WHEN _how = 'linear' THEN transform(fs, (v, i) -> CASE WHEN i = 0 THEN _lo WHEN i = _n - 1 THEN _hi ELSE v END) ELSE fs END"),
        "tf": F.expr("""CASE _how WHEN 'as_is' THEN ts
            WHEN 'linear' THEN transform(ts, (v, i) -> CASE WHEN i = 0 THEN _mt + _slope * (_lo - _mf) WHEN i = _n - 1 THEN _mt + _slope * (_hi - _mf) ELSE v END)
            ELSE transform(ts, (v, i) -> CASE WHEN i = 0 THEN v - _first WHEN i = _n - 1 THEN v + _last ELSE v END) END"""),
    }).drop("_n", "_how", "_fi", "_ti", "_first", "_last", "_mf", "_mt", "_slope", "_lo", "_hi")


def sorted_knots(df: DataFrame, fs: str, ts: str, xs: str, ys: str) -> DataFrame:
    """Pairs sorted by ``fs`` as arrays ``xs, ys``; done per shank, before sites join."""
    df = df.withColumn("_k", F.expr(f"array_sort(zip_with({fs}, {ts}, (f, t) -> named_struct('x', f, 'y', t)))"))
    return df.withColumns({xs: F.col("_k.x"), ys: F.col("_k.y")}).drop("_k")


def map_depth(df: DataFrame, out: str, q: Column | str, xs: str, ys: str) -> DataFrame:
    """Feature depth to track depth through sorted landmarks (swap the pair for the inverse)."""
    return interp(df, out, q, xs, ys, "extrapolate")


def anchors_last_wins(points: DataFrame, keys: list[str]) -> DataFrame:
    """P24, older anchors: of pairs sharing a feature depth, the last entered one is used."""
    return points.groupBy(*keys, "feature_um").agg(F.max_by("track_um", "i").alias("track_um"), F.max("i").alias("i"))


def landmark_checks(aligned: DataFrame) -> DataFrame:
    """First crossing (if any), mean offset of user pairs, and stretches.

    One row per shank; ``stretch`` is an array over the sorted segments (null where the
    feature depths coincide). A shared feature depth is reported before a crossed track.
    """
    df = aligned.withColumn("_s", F.expr("array_sort(zip_with(fs, ts, (f, t) -> named_struct('f', f, 't', t)))"))
    df = df.withColumn("_d", F.expr("""transform(slice(_s, 1, greatest(size(_s) - 1, 0)),
        (a, i) -> named_struct('f0', a.f, 't0', a.t, 'f1', get(_s, i + 1).f, 't1', get(_s, i + 1).t))"""))
    df = df.withColumns({"_sf": F.expr("get(filter(_d, d -> d.f1 <= d.f0), 0)"), "_cr": F.expr("get(filter(_d, d -> d.t1 <= d.t0), 0)")})
    df = df.withColumn("_bad", F.coalesce("_sf", "_cr"))
    interior = lambda xs: f"slice({xs}, 2, greatest(size(fs) - 2, 0))"
    return df.withColumns({
        "violation": F.expr("CASE WHEN _sf IS NOT NULL THEN 'same_feature' WHEN _cr IS NOT NULL THEN 'crossed' END"),
        "bad_feature": F.col("_bad.f0"), "bad_track": F.col("_bad.t0"),
        "next_feature": F.col("_bad.f1"), "next_track": F.col("_bad.t1"),
        "offset_um": F.expr(f"""CASE WHEN size(fs) > 2 THEN aggregate(zip_with({interior('ts')}, {interior('fs')}, (t, f) -> t - f),
            0D, (a, x) -> a + x) / (size(fs) - 2) ELSE 0D END"""),
        "stretch": F.expr("transform(_d, d -> CASE WHEN d.f1 <> d.f0 THEN (d.t1 - d.t0) / (d.f1 - d.f0) END)"),
    }).drop("_s", "_d", "_sf", "_cr", "_bad")


def shift_landmarks(points: DataFrame, delta_um: float) -> DataFrame:
    """Shift the user pairs' track depths; with no user pairs the two ends move instead."""
    user = (F.col("i") > 0) & (F.col("i") < F.col("n_user") + 1)
    moved = F.when(user | (F.col("n_user") == 0), F.col("track_um") + delta_um)
    ends = F.when(F.col("n_user") == 0, F.col("track_um"))
    return points.withColumn("track_um", F.coalesce(moved, ends, F.col("track_um")))


# --- tracks ---------------------------------------------------------------------------------


def _norm(prefix: str, of: str = "p") -> str:
    return "sqrt(" + " + ".join(f"{of}.{prefix}{a} * {of}.{prefix}{a}" for a in _AXES) + ")"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _segments(df: DataFrame, vertices: str, out: str = "segments") -> DataFrame:
    """Per track, each segment's start (``s, ap, ml, dv``), unit tangent ``t*`` and width ``w*``.

    The width runs across the electrode columns: (entry-wards axis) x ML, or x AP for a
    lateral segment. All of this is worked out per segment, before any site joins.
    """
    kept = {"s": "p.s", **{a: f"p.{a}" for a in _AXES}}
    tangents = {f"t{a}": f"p.t{a}" for a in _AXES}
    # A segment without length points along DV.
    unit = {f"t{a}": f"CASE WHEN {_norm('d')} > 1e-12D THEN p.d{a} / {_norm('d')} ELSE {1.0 if a == 'dv' else 0.0}D END" for a in _AXES}
    side = "abs(p.tml) > 0.9D"
    raw = {"rap": f"CASE WHEN {side} THEN 0D ELSE p.tdv END", "rml": f"CASE WHEN {side} THEN -p.tdv ELSE 0D END",
           "rdv": f"CASE WHEN {side} THEN p.tml ELSE -p.tap END"}
    width = {f"w{a}": f"CASE WHEN {_norm('r')} > 1e-9D THEN p.r{a} / {_norm('r')} ELSE 0D END" for a in _AXES}
    steps = (_struct(**kept, **unit), _struct(**kept, **tangents, **raw), _struct(**kept, **tangents, **width))
    deltas = _struct(**kept, **{f"d{a}": f"get({vertices}, i + 1).{a} - p.{a}" for a in _AXES})
    df = df.withColumn(out, F.expr(f"transform(slice({vertices}, 1, greatest(size({vertices}) - 1, 0)), (p, i) -> {deltas})"))
    for step in steps:
        df = df.withColumn(out, F.expr(f"transform({out}, p -> {step})"))
    return df


def _on_segment(sites: DataFrame, seg: str, depth: str, lateral: str | None) -> DataFrame:
    off = f"({lateral} - {C.COLUMN_CENTRE_UM}D)" if lateral else "0D"
    df = sites.withColumn("_seg", F.expr(seg))
    return df.withColumns({
        f"{a}_um": F.expr(f"_seg.{a} + ({depth} - _seg.s) * _seg.t{a} + {off} * _seg.w{a}") for a in _AXES}).drop("_seg")


def shank_frames(shanks: DataFrame) -> DataFrame:
    """The straight tip-entry segment of each shank, as ``segments``."""
    ends = [_struct(s="0D", **{a: f"CAST({end}_{a} AS DOUBLE)" for a in _AXES}) for end in ("tip", "entry")]
    return _segments(shanks.withColumn("_v", F.expr(f"array({ends[0]}, {ends[1]})")), "_v").drop("_v")


_CHORD = "sqrt(" + " + ".join(f"power(entry_{a} - tip_{a}, 2)" for a in _AXES) + ")"


def place_channels(sites: DataFrame, depth: str = "depth_from_tip_um", lateral: str | None = "lateral_um") -> DataFrame:
    """Site CCF along the straight tip-entry line, adding ``ap_um, ml_um, dv_um``.

    ``sites`` carries the ``segments`` of :func:`shank_frames`. A shank shorter than 1 um has
    all its sites at the entry.
    """
    out = _on_segment(sites, "segments[0]", depth, lateral).withColumn("_len", F.expr(_CHORD))
    return out.withColumns({
        f"{a}_um": F.expr(f"CASE WHEN _len < 1D THEN entry_{a} WHEN _len >= 1D THEN {a}_um END") for a in _AXES}).drop("_len")


def sample_track(shanks: DataFrame, *, step_um: float, top_um: float = 0.0, margin_um: float = 0.0) -> DataFrame:
    """Points every ``step_um`` below the entry along each placed shank (``depth_um`` below surface)."""
    df = shanks.filter("tip_ap IS NOT NULL AND entry_ap IS NOT NULL").withColumn("_len", F.expr(_CHORD))
    last = f"greatest(CAST(floor((_len + {margin_um!r}D - {top_um!r}D) / {step_um!r}D) AS BIGINT), 0L)"
    df = df.withColumn("sample", F.expr(f"explode(sequence(0L, {last}))"))
    df = df.withColumn("depth_um", F.expr(f"sample * {step_um!r}D + {top_um!r}D"))
    return df.withColumns({
        f"{a}_um": F.expr(f"entry_{a} + CASE WHEN _len > 0 THEN depth_um * (tip_{a} - entry_{a}) / _len ELSE 0D END")
        for a in _AXES}).drop("_len")


def track_polyline(shanks: DataFrame, waypoints: DataFrame, keys: list[str]) -> DataFrame:
    """Shanks with ``path``, an array of (ap, ml, dv, s) from the tip.

    Waypoints are ordered by projection on tip-entry; a point within 1e-6 of the last kept
    one is dropped; ``s`` is the arc length so far.
    """
    picked = waypoints.groupBy(*keys).agg(F.collect_list(F.struct("i", *_AXES)).alias("_w"))
    df = shanks.join(picked, keys, "left").withColumn("_len", F.expr(_CHORD))
    df = df.withColumn("curved", F.expr("_w IS NOT NULL AND _len > 0"))
    along = " + ".join(f"(p.{a} - tip_{a}) * (entry_{a} - tip_{a})" for a in _AXES)
    end = lambda which, **more: _struct(**{a: f"CAST({which}_{a} AS DOUBLE)" for a in _AXES}, **more)
    point = _struct(**{a: f"CAST(p.{a} AS DOUBLE)" for a in _AXES})
    tagged = _struct(t=f"({along}) / _len", i="p.i", **{a: f"p.{a}" for a in _AXES})
    df = df.withColumn("_rest", F.expr(
        f"CASE WHEN curved THEN concat(transform(array_sort(transform(_w, p -> {tagged})), p -> {point}), array({end('entry')})) "
        f"ELSE array({end('entry')}) END"))
    gap = "sqrt(" + " + ".join(f"power(p.{a} - element_at(acc, -1).{a}, 2)" for a in _AXES) + ")"
    grown = _struct(**{a: f"p.{a}" for a in _AXES}, s=f"element_at(acc, -1).s + {gap}")
    df = df.withColumn("path", F.expr(
        f"aggregate(_rest, array({end('tip', s='0D')}), (acc, p) -> CASE WHEN {gap} > 1e-6D OR NOT curved THEN concat(acc, array({grown})) ELSE acc END)"))
    return df.drop("_w", "_rest", "_len")


def track_stats(tracks: DataFrame) -> DataFrame:
    """Path length and the largest departure from the tip-entry chord."""
    df = tracks.withColumns({"_a": F.expr("path[0]"), "_b": F.expr("element_at(path, -1)")})
    df = df.withColumn("_len", F.expr("sqrt(" + " + ".join(f"power(_b.{a} - _a.{a}, 2)" for a in _AXES) + ")"))
    # Squared departure = squared distance from the tip minus the squared run along the chord;
    # taken from the perpendicular components, which keeps it exact for nearly straight tracks.
    run = "CASE WHEN _len > 0 THEN (" + " + ".join(f"(p.{a} - _a.{a}) * (_b.{a} - _a.{a})" for a in _AXES) + ") / _len ELSE 0D END"
    off = "sqrt(" + " + ".join(
        f"power(p.{a} - _a.{a} - CASE WHEN _len > 0 THEN {run} * (_b.{a} - _a.{a}) / _len ELSE 0D END, 2)" for a in _AXES) + ")"
    return df.withColumns({
        "path_length_um": F.col("_b.s"),
        "max_deviation_um": F.expr(f"CASE WHEN size(path) < 3 THEN 0D ELSE array_max(transform(path, p -> {off})) END"),
    }).drop("_a", "_b", "_len")


def place_channels_curved(sites: DataFrame, depth: str = "depth_from_tip_um", lateral: str | None = "lateral_um") -> DataFrame:
    """As P22 along a polyline by arc length from the tip; ends extrapolate along their segment.

    ``sites`` carries the ``segments`` of :func:`curved_frames`.
    """
    return _on_segment(sites, f"get(segments, greatest(size(filter(segments, p -> p.s <= {depth})) - 1, 0))", depth, lateral)


def curved_frames(tracks: DataFrame) -> DataFrame:
    """Segments of each track's polyline."""
    return _segments(tracks, "path")


def aligned_depths(sites: DataFrame, length: str = "path_length_um", depth: str = "depth_from_tip_um") -> DataFrame:
    """``aligned_depth_um``, given sorted landmarks ``kx, ky``, ``used_alignment`` and ``reference_um``."""
    mapped = map_depth(sites, "_below", f"reference_um - {depth}", "kx", "ky")
    return mapped.withColumn("aligned_depth_um", F.expr(f"CASE WHEN used_alignment THEN {length} - _below ELSE {depth} END")).drop("_below")


def alignment_use(tracks: DataFrame, length: str = "path_length_um") -> DataFrame:
    """Per shank the reference depth, and whether its alignment changes anything.

    Unused with fewer than two pairs, unequal lengths, or an identity map on equal axes.
    Needs ``fs, ts`` (nullable) and ``insertion_depth_um``.
    """
    df = tracks.withColumn("reference_um", F.expr(f"CASE WHEN insertion_depth_um > 0 THEN insertion_depth_um ELSE {length} END"))
    return df.withColumn("used_alignment", F.expr(f"""coalesce(size(fs) >= 2 AND size(fs) = size(ts), false)
        AND NOT coalesce(forall(zip_with(fs, ts, (f, t) -> abs(f - t) <= 1e-6D + 1e-5D * abs(t)), b -> b)
            AND abs(reference_um - {length}) <= 1e-6D, false)"""))


def feature_reference_depth(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Deepest nonzero insertion depth of a probe's recordings."""
    return recordings.groupBy(*keys).agg(F.max(F.nullif("insertion_depth_um", F.lit(0.0))).alias("reference_depth_um"))


def place_probe_channels(shanks: DataFrame, waypoints: DataFrame, alignments: DataFrame, keys: list[str]) -> DataFrame:
    """P22/P23/P28 together: every site of every placed shank, aligned where it can be.

    ``alignments`` has ``fs, ts, extremes_mode, insertion_depth_um`` per shank.
    """
    placed = shanks.filter("tip_ap IS NOT NULL AND entry_ap IS NOT NULL")
    tracks = curved_frames(track_stats(track_polyline(placed, waypoints, keys))).drop("path")
    fitted = sorted_knots(fit_tails(alignments), "ff", "tf", "kx", "ky")
    tracks = alignment_use(tracks.join(fitted.select(*keys, "fs", "ts", "kx", "ky", "insertion_depth_um"), keys, "left"))
    # One row per shank grows into hundreds of sites from here on.
    sites = aligned_depths(with_sites(spread(tracks.drop("fs", "ts", "insertion_depth_um"), *keys)))
    # A track without waypoints is the two-vertex path, so one branch serves both; only a
    # straight shank shorter than 1 um keeps all its sites at the entry.
    out = place_channels_curved(sites, "aligned_depth_um")
    names = {f"{a}_um": F.expr(f"CASE WHEN NOT curved AND path_length_um < 1D THEN entry_{a} ELSE {a}_um END") for a in _AXES}
    source = F.when(F.col("used_alignment"), "ephys_alignment").otherwise("geometry")
    return out.withColumns(names).withColumn("depth_source", source).drop("kx", "ky", "segments", "layout")
