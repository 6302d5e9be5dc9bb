"""Streams, metadata and penetrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelkeel.functions import text as X


def attach_metadata(streams: DataFrame, rows: DataFrame) -> DataFrame:
    """Metadata row of each stream by (subject, date, recording, probe), else by session.

    The session key (without recording) is used only when it has one row or one distinct
    depth, and then its first row. Among duplicate full keys the last row wins. Streams
    without a row stay, with ``depth_source`` "unknown". The metadata side is reduced to one
    row per key before either join, so both joins are one to one.
    """
    keyed = rows.select(
        F.coalesce(X.norm_key(F.col("subject")), F.lit("")).alias("_s"), F.col("session_date").alias("_d"),
        F.coalesce(X.norm_key(F.col("recording")), F.lit("")).alias("_r"), X.probe_key(F.col("probe")).alias("_p"),
        "row_no", F.struct("row_no", "insertion_depth_um", "dye").alias("_m"))
    full = keyed.groupBy("_s", "_d", "_r", "_p").agg(F.max_by("_m", "row_no").alias("_full"))
    session = keyed.groupBy("_s", "_d", "_p").agg(
        F.min_by("_m", "row_no").alias("_first"), F.count(F.lit(1)).alias("_n"),
        (F.count_distinct("_m.insertion_depth_um") + F.max(F.col("_m.insertion_depth_um").isNull().cast("int"))).alias("_nd"))
    session = session.filter("_n = 1 OR _nd = 1").select("_s", "_d", "_p", "_first")
    s = streams.withColumns({
        "_s": F.coalesce(X.norm_key(F.col("subject")), F.lit("")), "_d": F.col("session_date"),
        "_r": F.coalesce(X.norm_key(F.col("recording_label")), F.lit("")), "_p": X.probe_key(F.col("probe_label"))})

    def same(right: DataFrame, cols):
        cond = F.lit(True)
        for c in cols:
            cond = cond & s[c].eqNullSafe(right[c])
        return cond

    j = s.join(full, same(full, ["_s", "_d", "_r", "_p"]), "left").select(s["*"], "_full")
    j = j.alias("j").join(session.alias("q"), (F.col("j._s").eqNullSafe(F.col("q._s"))) & (F.col("j._d").eqNullSafe(F.col("q._d")))
                          & (F.col("j._p").eqNullSafe(F.col("q._p"))), "left").select("j.*", "q._first")
    m = F.coalesce("_full", "_first")
    return j.withColumn("_m", m).select(
        *streams.columns, F.col("_m.row_no").alias("row_no"), F.col("_m.insertion_depth_um").alias("insertion_depth_um"),
        X.normalise_dye(F.col("_m.dye")).alias("dye"),
        F.when(F.col("_m.insertion_depth_um").isNotNull(), "sidecar").otherwise("unknown").alias("depth_source"))


def group_penetrations(candidates: DataFrame) -> DataFrame:
    """Recordings grouped by subject, date, probe, dye, and by folder where the first two are unknown.

    Aggregates are mergeable (counts, min and max); the recordings themselves stay rows.
    """
    known = F.col("subject").isNotNull() & F.col("session_date").isNotNull()
    df = candidates.withColumn("folder_hint", F.when(~known, F.col("session_folder")))
    keys = ["subject", "session_date", "probe_label", "dye", "folder_hint"]
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_recordings"), F.count_if(F.col("insertion_depth_um").isNull()).alias("n_missing_depth"),
        F.count_distinct("insertion_depth_um").alias("n_depths"), F.min("insertion_depth_um").alias("min_depth_um"),
        F.max("insertion_depth_um").alias("max_depth_um"), F.count_distinct("config").alias("n_configs"))
    grouped_by_folder = F.col("subject").isNull() | F.col("session_date").isNull()
    return agg.withColumns({
        "by_folder": grouped_by_folder,
        "mixed_configs": grouped_by_folder & (F.col("n_recordings") > 1) & (F.col("n_missing_depth") > 0) & (F.col("n_configs") > 1),
    })


def select_stream(streams: DataFrame, kind: str) -> DataFrame:
    """The LFP or wideband stream of each recording, by the name rules of its format.

    One pass: a priority per stream and a minimum per recording. No preferred stream gives no row.
    """
    if kind == "lfp":
        prio = F.expr("""CASE WHEN format = 'intan' OR contains(upper(name), 'SYNC') THEN NULL
            WHEN format = 'spikeglx' THEN CASE WHEN contains(upper(name), '.LF') OR endswith(upper(name), 'LF') THEN 1 END
            WHEN contains(upper(name), 'LFP') OR endswith(upper(name), '-LF') OR endswith(upper(name), '.LF') THEN 1 END""")
    elif kind == "wideband":
        prio = F.expr("""CASE WHEN format = 'intan' THEN CASE WHEN contains(lower(name), 'amplifier') THEN 1 END
            WHEN format = 'spikeglx' THEN CASE WHEN contains(lower(name), 'nidq') OR contains(lower(name), 'sync') THEN NULL
                WHEN contains(lower(name), '.ap') OR endswith(lower(name), 'ap') THEN 1 ELSE 2 END
            WHEN contains(name, 'Neuropix') AND contains(upper(name), 'AP') THEN 1 WHEN contains(name, 'Neuropix') THEN 2 ELSE 3 END""")
    else:
        raise ValueError(f"unknown stream kind {kind!r}; use lfp or wideband")
    ranked = streams.withColumn("_p", prio).filter("_p IS NOT NULL")
    best = ranked.groupBy("recording").agg(F.min(F.struct("_p", "pos", "name")).alias("b"))
    return best.select("recording", F.col("b.name").alias("stream"), F.col("b.pos").alias("pos"))
