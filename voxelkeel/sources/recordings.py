"""Metadata sidecars, site maps and file listings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelkeel import schemas
from voxelkeel.functions import text as X
from voxelkeel.functions.constants import values_table
from voxelkeel.session import cut_lineage, spread, unsized


def _norm(s: str) -> str:
    return re.sub("[^a-z0-9]+", " ", s.strip().lower()).strip()


def read_sidecar(spark: SparkSession, path: str, *, columns: dict | None = None) -> DataFrame:
    """A metadata CSV with free headers; spreadsheets are refused."""
    if path.lower().endswith((".xlsx", ".xls")):
        raise ValueError(f"{path} is a spreadsheet; export it to CSV first")
    return normalise_sidecar(spark.read.csv(path, header=True), columns=columns)


def normalise_sidecar(df: DataFrame, *, columns: dict | None = None) -> DataFrame:
    """Headers by alias, dates and dyes parsed, unparseable depths null, other columns kept."""
    mapping = {**X.SIDECAR_ALIASES, **(columns or {})}
    lookup = {_norm(alias): name for name, aliases in mapping.items() for alias in aliases}
    names = {h: lookup.get(_norm(h.lstrip("﻿")), h) for h in df.columns}
    if not set(names.values()) & set(mapping):
        raise ValueError(f"no recognisable columns (found {df.columns})")
    out = df.withColumnsRenamed({h: n for h, n in names.items() if h != n})
    extra = {}
    if "date" in out.columns:
        extra["date"] = X.parse_date(F.col("date"))
    if "dye" in out.columns:
        extra["dye"] = X.normalise_dye(F.col("dye"))
    if "insertion_depth_um" in out.columns:
        extra["insertion_depth_um"] = F.trim(F.col("insertion_depth_um")).try_cast("double")
    return out.withColumns(extra) if extra else out


_PICK = {"depth": ("depth_um", "depth", "y_um", "y"), "x": ("x_um", "x", "lateral_um", "lateral"),
         "shank": ("shank", "shank_id", "shank_ids", "group"), "channel": ("channel", "channel_id", "chan", "index")}


def channel_map(rows: DataFrame) -> DataFrame:
    """Site maps (``map_id, row_no`` and free columns, as text): depth needed, x defaults to 0, shanks all
    or none, rows in channel order only where every row names its channel."""
    have = {c.strip().lower(): c for c in rows.columns}

    def first(kind: str):
        found = [F.nullif(F.trim(F.col(have[k]).cast("string")), F.lit("")) for k in _PICK[kind] if k in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    df = rows.select("map_id", "row_no", first("depth").alias("_d"), first("x").alias("_x"), first("shank").alias("_s"), first("channel").alias("_c"))
    full = df.groupBy("map_id").agg(F.bool_and(F.col("_s").isNotNull()).alias("_all_s"), F.bool_and(F.col("_c").isNotNull()).alias("_all_c"))
    df = df.join(full, "map_id")
    number = F.col("_c").cast("double").cast("int")
    order = Window.partitionBy("map_id").orderBy(F.when(F.col("_all_c"), number), "row_no")
    depth = F.coalesce(F.col("_d").cast("double"), F.raise_error(F.concat(F.lit("no depth in map row "), F.col("row_no").cast("string"))).cast("double"))
    return df.select("map_id", (F.row_number().over(order) - 1).alias("channel"), depth.alias("depth_um"), F.coalesce(F.col("_x").cast("double"), F.lit(0.0)).alias("x_um"),
                     F.when(F.col("_all_s"), F.col("_s").cast("double").cast("int")).alias("shank"))


def parse_rhx_map(documents: DataFrame) -> DataFrame:
    """Intan RHX probe maps (``map_id, doc``): a page is a shank, depth is from its outline's lowest point.

    A channel on two ports, or a hole in the numbering, fails the job.
    """
    pages = documents.withColumn("_m", F.from_xml(F.col("doc"), schemas.RHX_MAP)).select("map_id", F.posexplode("_m.Page").alias("shank", "p"))
    tip = F.expr("coalesce(array_min(flatten(transform(p.Line, l -> array(l._y1, l._y2)))), 0D)")
    sites = pages.select("map_id", "shank", tip.alias("_tip"), F.explode("p.Port").alias("t")).select("map_id", "shank", "_tip", F.explode("t.ElectrodeSite").alias("s"))
    sites = sites.select("map_id", "shank", F.col("s._channelNumber").alias("channel"), F.coalesce("s._x", F.lit(0.0)).alias("x_um"), (F.coalesce("s._y", F.lit(0.0)) - F.col("_tip")).alias("depth_um"))
    check = sites.groupBy("map_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("channel").alias("_d"), F.max("channel").alias("_m"), F.max("shank").alias("_pages"))
    verdict = F.when(F.col("_n") != F.col("_d"), F.raise_error(F.lit("a channel appears twice")).cast("boolean")).when(
        F.col("_m") != F.col("_n") - 1, F.raise_error(F.lit("channel numbers have holes")).cast("boolean")).otherwise(True)
    ok = check.filter(verdict).select("map_id", "_pages")
    return sites.join(ok, "map_id").withColumn("shank", F.when(F.col("_pages") > 0, F.col("shank"))).drop("_pages")


def find_recordings(listing: DataFrame, *, root: str = "") -> DataFrame:
    """Recording folders of a file listing (``path, is_dir``) at or below ``root``, their format, none
    below another.

    Folders whose name ends in ``.zarr`` are not looked into. Facts of a folder, also those that a
    child or grandchild tells, are gathered by one grouping per file stem and one per folder, of rows that
    tell any; the pruning is an anti join on ancestors. Paths are many rows of few bytes once compressed, so
    both groupings are spread over all partitions, and no table of folders is broadcast.
    """
    under = root.rstrip("/") + "/"
    rows = listing.filter(F.col("path").startswith(under) & ~F.col("path").contains(".zarr/") & ~(F.col("is_dir") & F.lower("path").endswith(".zarr")))
    rows = rows.filter(F.lower("path").rlike("[.](meta|bin|rhd|rhs)$|/structure[.]oebin$|/recording[0-9]+$|/record node"))
    parent = lambda c: F.regexp_replace(c, r"/[^/]+$", "")
    rows = rows.select("path", "is_dir", parent(F.col("path")).alias("dir"), F.lower(F.substring_index("path", "/", -1)).alias("name"))
    meta, binary = F.expr("NOT is_dir AND name RLIKE '[.](imec|nidq)' AND endswith(name, '.meta')"), F.expr("NOT is_dir AND endswith(name, '.bin')")
    run = F.expr("is_dir AND name RLIKE '^recording[0-9]+$'") & F.lower(F.substring_index("dir", "/", -1)).rlike("^experiment[0-9]+$")
    told = spread(rows.withColumn("stem", F.when(meta | binary, F.regexp_replace("name", r"\.(meta|bin)$", ""))), "dir", "stem")
    by_stem = told.groupBy("dir", "stem").agg(
        F.bool_or(meta).alias("_m"), F.bool_or(binary).alias("_b"), F.bool_or(run).alias("_run"), F.bool_or(F.expr("NOT is_dir AND name IN ('info.rhd', 'info.rhs', 'settings.rhd', 'settings.rhs')")).alias("info"),
        F.count_if(F.expr("NOT is_dir AND (endswith(name, '.rhd') OR endswith(name, '.rhs'))")).alias("loose"), F.bool_or(F.expr("NOT is_dir AND name = 'structure.oebin'")).alias("oebin"))
    no = F.lit(False)
    fact = lambda at, glx, exp, info=no, loose=F.lit(0), oebin=no: F.struct(at.alias("dir"), glx.alias("glx"), exp.alias("exp"), info.alias("info"), loose.cast("long").alias("loose"), oebin.alias("oebin"))
    glx, above = F.col("_m") & F.col("_b"), parent(F.col("dir"))
    told = by_stem.select(F.inline(F.filter(F.array(
        fact(F.col("dir"), glx, no, F.col("info"), F.col("loose"), F.col("oebin")),
        F.when(glx, fact(above, F.lit(True), no)), F.when(F.col("_run"), fact(above, no, F.lit(True)))), lambda x: x.isNotNull())))
    folders = rows.filter("is_dir").select(F.inline(F.array(fact(F.col("path"), no, no))))
    df = spread(told.unionByName(folders), "dir").groupBy("dir").agg(F.bool_or("glx").alias("glx"), F.bool_or("exp").alias("exp"), F.bool_or("info").alias("_info"), F.sum("loose").alias("_loose"), F.bool_or("oebin").alias("_oebin"))
    df = df.filter(F.concat("dir", F.lit("/")).startswith(under))
    df = df.withColumn("format", F.expr("""CASE WHEN coalesce(_info, false) OR coalesce(_loose, 0) = 1 THEN 'intan' WHEN glx THEN 'spikeglx'
        WHEN coalesce(_oebin, false) OR exp OR startswith(lower(substring_index(dir, '/', -1)), 'record node') THEN 'openephys' END"""))
    # The hits are read three times below: for their depths, as folders and as ancestors.
    hits = cut_lineage(df.filter("format IS NOT NULL").select("dir", "format"))
    # Only ancestors at a depth that has hits can be one; the others, shared by most folders, would all meet in one task.
    depth = "size(split(dir, '/'))"
    depths = sorted(r[0] for r in hits.select(F.expr(depth)).distinct().collect())
    above = hits.select(F.col("dir").alias("_hit"), F.explode(F.expr(f"transform(filter(array({', '.join(map(str, depths or [0]))}), n -> n < {depth}), n -> substring_index(dir, '/', n))")).alias("dir"))
    nested = above.join(unsized(hits.select("dir")), "dir", "left_semi").select(F.col("_hit").alias("dir")).distinct()
    return hits.join(unsized(nested), "dir", "left_anti")


def labelled_voxels(annotation: DataFrame, structures: DataFrame) -> DataFrame:
    """Voxels with the acronym, name and depth in the tree of their structure."""
    s = structures.select(F.col("id").alias("structure_id"), "acronym", "name", F.size("path").alias("tree_depth"))
    return annotation.filter("structure_id > 0").join(s, "structure_id")


# A32 connector pin to RHD2132 channel.
A32_TO_RHD2132 = (30, 26, 21, 17, 27, 22, 20, 25, 28, 23, 19, 24, 29, 18, 31, 16, 0, 15, 2, 13, 8, 9, 7, 1, 6, 14, 10, 11, 5, 12, 4, 3)
# Poly2 site (height above the tip, lateral position, um) at each connector pin.
POLY2_SITES = (
    (375.0, -21.5), (425.0, -21.5), (475.0, -21.5), (525.0, -21.5), (575.0, -21.5), (625.0, -21.5), (675.0, -21.5), (725.0, -21.5),
    (775.0, -21.5), (825.0, -21.5), (325.0, -21.5), (275.0, -21.5), (225.0, -21.5), (175.0, -21.5), (125.0, -21.5), (75.0, -21.5),
    (100.0, 21.5), (150.0, 21.5), (200.0, 21.5), (250.0, 21.5), (300.0, 21.5), (350.0, 21.5), (850.0, 21.5), (800.0, 21.5),
    (750.0, 21.5), (700.0, 21.5), (650.0, 21.5), (600.0, 21.5), (550.0, 21.5), (500.0, 21.5), (450.0, 21.5), (400.0, 21.5),
)
# Names of the wired maps.
POLY3_WIRED, POLY2_WIRED = "NeuroNexus A1x32-Poly3 + A32>RHD2132", "NeuroNexus A1x32-Poly2 + A32>RHD2132"


def wired_maps(spark: SparkSession) -> DataFrame:
    """``map_name, channel, depth_um, x_um`` of the named probe + adapter + headstage maps (64 rows)."""
    pins = values_table(spark, ["pin", "channel"], list(enumerate(A32_TO_RHD2132)))
    # Poly3 pins: left column up, centre column up by twos and down again, right column down.
    poly3 = pins.select(F.lit(POLY3_WIRED).alias("map_name"), "channel", F.expr("""62D + CASE WHEN pin < 10 THEN 12.5D + 25D * pin
        WHEN pin < 16 THEN 50D * (pin - 10) WHEN pin < 22 THEN 275D - 50D * (pin - 16) ELSE 237.5D - 25D * (pin - 22) END AS depth_um"""),
        F.expr("CASE WHEN pin < 10 THEN -18D WHEN pin < 22 THEN 0D ELSE 18D END AS x_um"))
    poly2 = pins.join(F.broadcast(values_table(spark, ["pin", "depth_um", "x_um"], [(pin, *site) for pin, site in enumerate(POLY2_SITES)])), "pin")  # 32 rows
    return poly3.unionByName(poly2.select(F.lit(POLY2_WIRED).alias("map_name"), "channel", "depth_um", "x_um"))


def resolve_map(recordings: DataFrame, maps: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sites of each recording's map: a wired map by name, else a catalog layout; the channel count must agree."""
    both = maps.withColumn("_rank", F.lit(0)).unionByName(catalog.withColumn("_rank", F.lit(1)))
    size = both.groupBy("map_name", "_rank").agg(F.count(F.lit(1)).alias("_n"))
    best = recordings.select("probe_map").distinct().join(size, F.col("probe_map") == F.col("map_name")).groupBy("probe_map").agg(F.min(F.struct("_rank", "_n")).alias("_b"))
    df = recordings.join(best, "probe_map", "left")
    checked = F.when(F.col("_b").isNotNull() & (F.col("_b._n") != F.col("n_channels")), F.raise_error(F.concat(F.lit("channel count differs for map "), "probe_map")).cast("int")).otherwise(F.col("_b._rank"))
    df = df.withColumn("_r", checked)
    sites = both.select(F.col("map_name").alias("probe_map"), F.col("_rank").alias("_r"), "channel", "depth_um", "x_um")
    return df.join(sites, ["probe_map", "_r"]).drop("_b", "_r")


def geometry_resolution(channels: DataFrame, stored: DataFrame, supplied: DataFrame) -> DataFrame:
    """A channel's position as stored in the recording, else from its map, else its index (flagged).

    The choice is per recording: stored positions count only when the recording has them.
    """
    s = stored.select("recording", "channel", F.col("depth_um").alias("_sd"), F.col("x_um").alias("_sx"))
    m = supplied.select("recording", "channel", F.col("depth_um").alias("_md"), F.col("x_um").alias("_mx"))
    df = channels.join(s, ["recording", "channel"], "left").join(m, ["recording", "channel"], "left")
    source = F.when(F.col("_sd").isNotNull(), "recording").when(F.col("_md").isNotNull(), "probe_map").otherwise("channel_index")
    return df.withColumns({"geometry_source": source, "depth_um": F.coalesce("_sd", "_md", F.col("channel").cast("double")), "x_um": F.coalesce("_sx", "_mx", F.lit(0.0))}).drop("_sd", "_sx", "_md", "_mx")


def usable_geometry(channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Depth features refuse index geometry; those recordings are set apart with a reason, not lost."""
    index_only = F.col("geometry_source") == "channel_index"
    return channels.filter(~index_only), channels.filter(index_only).select("recording").distinct().withColumn("reason", F.lit("channel_index"))
