"""Batch rules kept per time window or per arriving file."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelkeel.functions import text as X
from voxelkeel.operators import features as A
from voxelkeel.operators.recordings import group_penetrations
from voxelkeel.sources.recordings import find_recordings


def event_stream(spark: SparkSession, path: str, *, glob: str = "*.parquet", max_files: int = 1,
                 time: str | None = "ts") -> DataFrame:
    """Events arriving as parquet files; the schema is the batch table's.

    ``path`` is a table: a folder of files, which the stream follows, or one single file.
    """
    table = spark.read.parquet(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles()[:1]):
        path, glob = os.path.dirname(path.rstrip("/")), name
    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp")) if time else rows


def stream_depth_profiles(spikes: DataFrame, *, window: str = "1 hour", window_s: float = 3600.0, bin_um: float = 250.0,
                          min_spikes: int = 50, late: str = "10 minutes") -> DataFrame:
    """Count, rate and mean amplitude per tumbling window and depth bin; null under ``min_spikes``.

    Counts and sums are incremental state per (window, bin). In a stream, rows later than the
    watermark are dropped and windows before it forgotten. Works on a stream or a batch of ``ts, depth_um, amplitude``.
    """
    bin_ = F.floor(F.col("depth_um") / float(bin_um)).alias("bin")
    agg = spikes.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), bin_).agg(
        F.count(F.lit(1)).alias("n_spikes"), F.sum("amplitude").alias("_a"))
    enough = F.col("n_spikes") >= min_spikes
    return agg.select(F.col("w.start").alias("window_start"), "bin", "n_spikes", F.when(enough, F.col("n_spikes") / window_s).alias("rate_hz"),
                      F.when(enough, F.col("_a") / F.col("n_spikes")).alias("mean_amplitude"))


def drain(stream: DataFrame, keys: list[str], out_path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that has arrived and give its latest row per key as a batch table.

    Each micro-batch writes the rows it changed under its own id, so a retried batch replaces its
    own output, the result never passes through the driver, and state older than the watermark is
    let go.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(out_path)
    rest = [c for c in stream.columns if c not in keys]
    return changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")


def close_windows(samples: DataFrame, *, closes_at: str = "closes_at", late: str = "1 minute") -> DataFrame:
    """The samples of every window once it is over, each window once.

    A window's samples wait in keyed state, one entry per (recording, win, ``closes_at``); when the watermark on
    ``closes_at`` has passed it, the entry comes out whole and is dropped. A sample that arrives over ``late`` behind the
    newest closing time is left out, as Structured Streaming has it. A row that closes far in the future ends
    the stream and brings out what is left.
    """
    buffered = samples.withWatermark(closes_at, late).groupBy("recording", "win", closes_at).agg(F.collect_list(F.struct("sample", "channel", "shank", "uv")).alias("rows"))
    return buffered.select("recording", "win", F.explode("rows").alias("r")).select("recording", "win", "r.*")


def screen_each_batch(samples: DataFrame, out_path: str, checkpoint: str, *, closes_at: str = "closes_at", late: str = "1 minute"):
    """Windows screened by the batch rule as they close (:func:`close_windows`), from state alone.

    Medians are not incremental, so a window is screened once it is whole; nothing that arrived
    before is read again. Writes are named by the batch id: a retried batch replaces its own output.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        A.screen_windows(batch).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    closed = close_windows(samples, closes_at=closes_at, late=late)
    return closed.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_verdicts(spark: SparkSession, out_path: str) -> DataFrame:
    """The verdict of each closed window; of a window that closed twice, which only a changed closing time does, the last."""
    v = spark.read.parquet(out_path)
    best = v.groupBy("recording", "win").agg(F.max_by(F.struct(*[c for c in v.columns if c not in ("recording", "win", "batch")]), "batch").alias("v"))
    return best.select("recording", "win", "v.*")


def discover_each_batch(listing: DataFrame, out_path: str, checkpoint: str):
    """Recording folders found in arriving listings, as an upsert by folder.

    A listing file is expected to hold whole recording folders. Each batch writes the folders it lists under its own id, as the
    next version of them, and a retried batch replaces what it wrote; :func:`found_folders` reads the newest
    version of each, so a folder that is listed again is replaced and nothing earlier is read while the stream runs.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        find_recordings(batch).dropDuplicates(["dir"]).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return listing.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def found_folders(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest version of every folder found, with the batch (version) it comes from."""
    found = spark.read.parquet(out_path)
    rest = [c for c in found.columns if c not in ("dir", "batch")]
    newest = found.groupBy("dir").agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("v"))
    return newest.select("dir", "v.*")


def penetrations_of(found: DataFrame) -> DataFrame:
    """Found folders grouped into penetrations by the ids in their paths."""
    ids = X.path_ids(F.col("dir"))
    rows = found.select("dir", *[c.alias(n) for n, c in ids.items()]).withColumns({
        "probe_label": F.substring_index("dir", "/", -1), "dye": F.lit(None).cast("string"),
        "insertion_depth_um": F.lit(None).cast("double"), "config": F.lit(None).cast("string")})
    return group_penetrations(rows)
