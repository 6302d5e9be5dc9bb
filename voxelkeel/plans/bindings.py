"""Domain tables derived from the given star-schema tables.

Each binding is one SQL text in the common subset of Spark SQL and DuckDB, so both
engines start from the same rows. Three tokens cover the places where the dialects differ:

* ``SEQ[a;b]``   one row per integer a..b (explode of a sequence)
* ``ARR[a,b,..]`` array constructor
* ``AT[xs;i]``   1-based array element

Otherwise only arithmetic, ``floor``, ``%`` and casts; doubles are written ``1e0``.

Groups are built from unique keys with bounded sizes (a slide has 20 boxes, a recording
32 channels), so the number of groups grows with the data and no group does.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from voxelkeel.session import spread

SOURCE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "embeddings",
)

BINDINGS: dict[str, str] = {}

# --- probes -----------------------------------------------------------------------------
BINDINGS["b_shanks"] = """
SELECT k, CAST(floor(p / 5) AS BIGINT) AS project_id, p AS probe, CAST(s AS INT) AS shank,
  CASE p % 6 WHEN 0 THEN 'Neuropixels 1.0' WHEN 1 THEN 'Neuropixels 2.0 (4-shank)'
    WHEN 2 THEN 'NEURONEXUS A1x32' WHEN 3 THEN 'NeuroNexus A1x32-Poly2-10mm-50s-177-OA32LP'
    WHEN 4 THEN 'neuropix custom' ELSE 'Tetrode 8' END AS probe_type,
  CASE WHEN k % 17 = 16 THEN NULL ELSE 4000e0 + (p * 137) % 3000 + s * 250 + (k * 7) % 11 - 5 END AS tip_ap,
  CASE WHEN k % 17 = 16 THEN NULL ELSE 1500e0 + (p * 211) % 4000 + (k * 5) % 13 - 6 END AS tip_ml,
  CASE WHEN k % 17 = 16 THEN NULL ELSE 4000e0 + (p * 97) % 2500 + (k * 3) % 17 END AS tip_dv,
  CASE WHEN k % 19 = 18 THEN 4000e0 + (p * 137) % 3000 + s * 250 + (k * 7) % 11 - 5
    ELSE 4000e0 + (p * 137) % 3000 + s * 250 + (k * 3) % 7 - 3 - ((p * 13) % 200 - 100) END AS entry_ap,
  CASE WHEN k % 19 = 18 THEN 1500e0 + (p * 211) % 4000 + (k * 5) % 13 - 6
    ELSE 1500e0 + (p * 211) % 4000 + (k * 2) % 9 - 4 - ((p * 29) % 160 - 80) END AS entry_ml,
  CASE WHEN k % 19 = 18 THEN 4000e0 + (p * 97) % 2500 + (k * 3) % 17
    ELSE 4000e0 + (p * 97) % 2500 + (k * 3) % 17 - (2500 + (p * 31) % 1500) END AS entry_dv
FROM (SELECT s_suppkey AS k, CAST(floor(s_suppkey / 4) AS BIGINT) AS p, s_suppkey % 4 AS s FROM supplier) t
"""
BINDINGS["b_track_points"] = """
SELECT k, probe, shank, i, tip_ap + f * (entry_ap - tip_ap) + (i * 29) % 31 - 15 AS ap,
  tip_ml + f * (entry_ml - tip_ml) + (i * 37) % 50 - 20 AS ml,
  tip_dv + f * (entry_dv - tip_dv) AS dv
FROM (SELECT k, probe, shank, i, tip_ap, tip_ml, tip_dv, entry_ap, entry_ml, entry_dv,
        CASE WHEN i = 2 THEN 0.2e0 WHEN i = 1 THEN 0.55e0 ELSE 0.8e0 END AS f
      FROM (SELECT *, SEQ[0;2] AS i FROM b_shanks WHERE k % 3 = 0 AND tip_ap IS NOT NULL) a) b
UNION ALL
SELECT k, probe, shank, 3 AS i, tip_ap AS ap, tip_ml AS ml, tip_dv AS dv
FROM b_shanks WHERE k % 6 = 0 AND tip_ap IS NOT NULL
"""
BINDINGS["b_alignments"] = """
SELECT k, probe, shank, k % 5 AS n_user,
  CASE k % 3 WHEN 0 THEN 'uniform' WHEN 1 THEN 'linear' ELSE 'none' END AS extremes_mode,
  CASE WHEN k % 4 = 1 THEN NULL WHEN k % 4 = 2 THEN 0e0 ELSE 3500e0 + k % 200 END AS insertion_depth_um
FROM b_shanks WHERE k % 8 <> 0
"""
BINDINGS["b_alignment_points"] = """
SELECT k, probe, shank, i, extremes_mode, n_user,
  CASE WHEN i = 0 THEN 0e0 WHEN i = n_user + 1 THEN 4000e0 + k % 50
    WHEN k % 14 = 5 AND i = 2 THEN 650e0 + (k * 11) % 90 ELSE i * 650e0 + (k * 11) % 90 END AS feature_um,
  CASE WHEN i = 0 THEN (k % 3) * 20e0 WHEN i = n_user + 1 THEN 4000e0 + k % 50 - (k % 2) * 60
    WHEN k % 12 = 7 AND i = 2 THEN 500e0 ELSE i * 640e0 + (k * 13 + i * 17) % 110 END AS track_um
FROM (SELECT k, probe, shank, extremes_mode, n_user, SEQ[0;n_user + 1] AS i FROM b_alignments) a
"""
# --- atlas: a 250 um grid whose labels are owned by the nations ---------------------------
BINDINGS["b_annotation"] = """
SELECT CAST(zone * 13 + a AS INT) AS i_ap, CAST(slab * 2 + d AS INT) AS i_dv, CAST(m AS INT) AS i_ml,
  CASE WHEN m < 2 OR m > 43 OR slab * 2 + d < 1 + (zone * 13 + a + m) % 2 THEN 0
    ELSE CAST(n_nationkey + 1 AS INT) END AS structure_id
FROM (SELECT n_nationkey, slab, zone, a, d, SEQ[0;45] AS m
  FROM (SELECT n_nationkey, slab, zone, a, SEQ[0;1] AS d
    FROM (SELECT n_nationkey, slab, zone, SEQ[0;12] AS a
      FROM (SELECT n_nationkey, CAST(floor(c / 4) AS INT) AS slab, c % 4 AS zone
        FROM (SELECT n_nationkey, SEQ[0;63] AS c FROM nation) c0
        WHERE c % 25 = n_nationkey) c1) c2) c3) c4
"""
BINDINGS["b_structures"] = """
SELECT 997 AS id, CAST(NULL AS INT) AS parent_id, 'root' AS acronym, 'root' AS name,
  255 AS r, 255 AS g, 255 AS b, ARR[997] AS path
FROM region WHERE r_regionkey = 0
UNION ALL
SELECT 101 + r_regionkey, 997, CASE WHEN r_regionkey = 0 THEN 'fiber tracts' ELSE concat('G', CAST(r_regionkey AS STRING)) END,
  r_name, 200, (r_regionkey * 40) % 256, 10, ARR[997, 101 + r_regionkey]
FROM region
UNION ALL
SELECT n_nationkey + 1, 101 + n_regionkey, concat('N', CAST(n_nationkey AS STRING)), n_name,
  (n_nationkey * 53) % 256, (n_nationkey * 101) % 256, (n_nationkey * 7) % 256,
  ARR[997, 101 + n_regionkey, n_nationkey + 1]
FROM nation
"""
# --- sections -----------------------------------------------------------------------------
BINDINGS["b_sections"] = """
SELECT k, project_id, slide_idx, section_index, x0, y0, x0 + 300 + p_size * 2 AS x1,
  y0 + 250 + (k * 7) % 60 AS y1, section_index AS ap_order,
  CASE project_id % 4 WHEN 0 THEN section_index + CAST(floor(section_index / 10) AS BIGINT)
    WHEN 1 THEN CASE WHEN k % 9 = 4 THEN NULL ELSE section_index END
    WHEN 2 THEN CAST(7 AS BIGINT) ELSE 200 - section_index END AS slide_number,
  CASE WHEN k % 3 = 1 THEN NULL ELSE 3000e0 + section_index * 60 + (k * 7) % 15 END AS ap_um,
  CASE k % 4 WHEN 0 THEN 'deepslice' WHEN 1 THEN 'manual' WHEN 2 THEN 'even_spacing' ELSE NULL END AS ap_source,
  k % 4 <> 3 AS has_reg, k % 4 IN (0, 3) AND k % 5 <> 1 AS has_ds,
  120e0 + section_index * 2.4e0 + (k * 7 % 5) / 10e0 + CASE WHEN k % 31 = 9 THEN 6e0 ELSE 0e0 END AS ox, 10e0 + k % 4 AS oy,
  CASE WHEN back THEN 451e0 ELSE 5e0 END AS oz,
  (k % 7 - 3) * 0.8e0 AS ux, (k % 5 - 2) * 1.5e0 AS uy, CASE WHEN back THEN -440e0 ELSE 440e0 END AS uz,
  (k % 9 - 4) * 0.9e0 + CASE WHEN k % 29 = 5 THEN 25e0 ELSE 0e0 END AS vx, 300e0 AS vy, (k % 3 - 1) * 2e0 AS vz,
  CASE WHEN k % 6 = 0 THEN 150 ELSE 200 END AS out_h, CASE WHEN k % 6 = 0 THEN 180 ELSE 250 END AS out_w,
  (k % 11 - 5) * 0.5e0 AS rotation_deg, k % 8 = 0 AS flip_h, CAST(p_size AS BIGINT) AS size_n,
  CAST(25e0 AS DOUBLE) AS resolution_um, 50e0 AS spacing_um,
  CASE WHEN project_id % 5 = 1 THEN 'back' ELSE NULL END AS seen_from
FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 100) AS BIGINT) AS project_id,
    CAST(floor(p_partkey % 100 / 20) AS BIGINT) AS slide_idx, p_partkey % 100 AS section_index,
    CAST((p_partkey % 5) * 500 + p_size AS BIGINT) AS x0,
    CAST(floor(p_partkey % 20 / 5) * 400 + (p_partkey * 3) % 40 AS BIGINT) AS y0, p_size,
    (CAST(floor(p_partkey / 100) AS BIGINT) % 3 = 2) <> (p_partkey % 23 = 0) AS back
  FROM part) t
"""
BINDINGS["b_cells"] = """
SELECT l_orderkey * 10 + l_linenumber AS pos, CAST(floor(l_partkey / 100) AS BIGINT) AS project_id,
  CASE WHEN l_quantity < 3 THEN NULL ELSE l_partkey % 100 END AS section_index,
  CASE WHEN l_quantity < 5 THEN NULL ELSE l_quantity * 6 END AS x_px,
  CASE WHEN l_quantity < 5 THEN NULL ELSE l_extendedprice / 400 END AS y_px,
  CASE WHEN l_returnflag = 'N' THEN 'cell' ELSE l_returnflag END AS cell_type,
  3000e0 + (l_partkey % 100) * 60 AS ap_um, 1000e0 + (l_suppkey * 91) % 9000 AS ml_um,
  300e0 + (l_orderkey * 17) % 7000 AS dv_um
FROM lineitem
"""
# --- recordings ---------------------------------------------------------------------------
BINDINGS["b_spikes"] = """
SELECT event_id AS spike_id, user_id AS recording, CAST(event_id % 4 AS INT) AS shank,
  (day(ts) - 1) * 86400e0 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS t_s,
  CAST((event_id * 37) % 5745 AS DOUBLE) AS depth_um, value AS amplitude, event_id % 20 AS unit
FROM events
"""
BINDINGS["b_epochs"] = """
SELECT recording, CAST(floor(t_s / 86400) AS BIGINT) AS epoch, min(t_s) AS t0, max(t_s) AS t1
FROM b_spikes WHERE recording % 3 <> 0 GROUP BY recording, CAST(floor(t_s / 86400) AS BIGINT)
"""
BINDINGS["b_lfp"] = """
SELECT recording, win, sample, channel, CAST(floor(channel / 4) AS INT) AS shank,
  CASE WHEN win = 3 AND channel = 7 THEN 0e0
    ELSE price + CASE WHEN (recording + win) % 4 = 2 AND sample >= 50 AND sample < 55 THEN 9000e0 * (1 + channel) ELSE 0e0 END
  END AS uv, 100e0 AS fs
FROM (SELECT CAST(floor(o_orderkey / 4000) AS BIGINT) AS recording,
    CAST(floor(o_orderkey % 4000 / 1000) AS INT) AS win,
    CAST(floor(o_orderkey % 1000 / 8) AS BIGINT) AS sample, CAST(o_orderkey % 8 AS INT) AS channel,
    (o_totalprice - 250000) / 1000e0 AS price FROM orders) t
"""
BINDINGS["b_recordings"] = """
SELECT recording, CAST(floor(recording / 4) AS BIGINT) AS penetration,
  concat('rec', CAST(recording % 4 AS STRING)) AS label, 'Neuropix-PXI.ProbeA' AS stream,
  3000e0 + (recording % 4) * 60 AS insertion_depth_um,
  CASE WHEN recording % 7 = 6 THEN NULL ELSE 1 + (recording % 3) * 8 END AS first_electrode,
  CASE WHEN recording % 7 = 6 THEN NULL ELSE 16 + (recording % 3) * 8 END AS last_electrode
FROM (SELECT DISTINCT CAST(floor(vec_id / 32) AS BIGINT) AS recording FROM embeddings) t
"""
BINDINGS["b_channels"] = """
SELECT CAST(floor(vec_id / 32) AS BIGINT) AS recording, CAST(vec_id % 32 AS INT) AS channel,
  (CASE WHEN vec_id % 32 < 16 THEN 0e0 ELSE 250e0 END) + 32e0 * (vec_id % 2) AS x_um,
  15e0 * floor((vec_id % 16) / 2) + CASE WHEN CAST(floor(vec_id / 32) AS BIGINT) % 5 = 4
    THEN 60e0 * (CAST(floor(vec_id / 32) AS BIGINT) % 3) ELSE 0e0 END AS axial_um,
  CAST(floor(vec_id % 32 / 16) AS BIGINT) AS shank_id
FROM embeddings
"""
BINDINGS["b_psd"] = """
SELECT CAST(floor(vec_id / 32) AS BIGINT) AS recording, CAST(vec_id % 32 AS INT) AS channel,
  (i - 1) * 5e0 AS freq_hz,
  CASE WHEN vec_id % 41 = 7 AND i < 4 THEN NULL
    ELSE CAST(AT[embedding;i] AS DOUBLE) * CAST(AT[embedding;i] AS DOUBLE) + 1e-6 END AS power
FROM (SELECT vec_id, embedding, SEQ[1;64] AS i FROM embeddings) t
"""
BINDINGS["b_profiles"] = """
SELECT vec_id AS k, f AS feature, (i - 1) * 20e0 AS depth_um,
  CAST(AT[embedding;i] AS DOUBLE) + CASE WHEN i > 20 + vec_id % 10 THEN 1e0 + f ELSE 0e0 END
    + CASE WHEN i = 40 AND vec_id % 5 = 0 THEN 30e0 ELSE 0e0 END AS value
FROM (SELECT vec_id, embedding, i, SEQ[0;2] AS f
  FROM (SELECT vec_id, embedding, SEQ[1;64] AS i FROM embeddings) a) t
"""
# --- streams and metadata -----------------------------------------------------------------
BINDINGS["b_streams"] = """
SELECT o_orderkey AS stream_id, CASE WHEN o_orderkey % 50 = 13 THEN NULL ELSE concat('CUST_', CAST(o_custkey % 997 AS STRING)) END AS subject,
  CASE WHEN o_orderkey % 50 = 17 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS session_date,
  concat('Run ', CAST(o_orderkey % 3 AS STRING)) AS recording_label,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ProbeA' ELSE 'ProbeB' END AS probe_label
FROM orders
"""
BINDINGS["b_metadata"] = """
SELECT o_orderkey AS row_no, concat('cust ', CAST(o_custkey % 997 AS STRING)) AS subject,
  CAST(o_orderdate AS DATE) AS session_date,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('run-', CAST(o_orderkey % 3 AS STRING)) ELSE 'other' END AS recording,
  CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'probe b' END AS probe,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE floor(o_totalprice / 100) % 5000 + 0e0 END AS insertion_depth_um,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'DiI (Red)' WHEN '2-HIGH' THEN 'Deep Red' WHEN '3-MEDIUM' THEN 'Alexa 488 green'
    WHEN '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS dye
FROM orders WHERE o_orderkey % 3 <> 2
UNION ALL
SELECT o_orderkey + 1000000000, concat('CUST-', CAST(o_custkey % 997 AS STRING)), CAST(o_orderdate AS DATE),
  concat('RUN ', CAST(o_orderkey % 3 AS STRING)), CASE WHEN o_orderkey % 2 = 0 THEN 'Probe A' ELSE 'B' END,
  floor(o_totalprice / 50) % 5000 + 0e0, 'DiO'
FROM orders WHERE o_orderkey % 11 = 0
"""
# --- pixel tables ---------------------------------------------------------------------------
BINDINGS["b_labels"] = """
SELECT k AS section, CAST(x AS INT) AS x, CAST(y AS INT) AS y,
  CAST((floor((x + k % 3) / 4) + 4 * floor((y + k % 2) / 4)) AS INT) % 7 AS region_id,
  (x * 37 + y * 17 + k * 13) % 101 / 100e0 AS va, (x * 37 + y * 19 + k * 7) % 101 / 100e0 AS vb,
  (x - 8) * (x - 8) + (y - 6) * (y - 6) <= 20 + k % 12 AS tissue,
  (x - 7) * (x - 7) + (y - 6) * (y - 6) <= 22 + k % 17 AS plane_mask,
  (x - 8) * (x - 8) + (y - 5 - k % 3) * (y - 5 - k % 3) <= 18 + k % 23 AS morph_mask
FROM (SELECT k, x, SEQ[0;11] AS y FROM (SELECT p_partkey AS k, SEQ[0;15] AS x FROM part) a) t
"""
BINDINGS["b_field"] = """
SELECT k AS section, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, ((gx * 7 + gy * 3 + k) % 11 - 5) / 4e0 AS dx,
  ((gx * 5 + gy * 2 + k) % 13 - 6) / 4e0 AS dy
FROM (SELECT k, gx, SEQ[0;7] AS gy FROM (SELECT p_partkey AS k, SEQ[0;7] AS gx FROM part) a) t
"""

#: Bindings that make hundreds of rows of one, and the given table and key they are spread by before.
GROWN = {"b_labels": ("part", "p_partkey"), "b_field": ("part", "p_partkey")}

_SOURCES = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(SOURCE_TABLES) + r")\b")
_TOKEN = re.compile(r"(SEQ|ARR|AT)\[((?:[^\[\]]|\[[^\]]*\])*)\]")


def _dialect(text: str, engine: str) -> str:
    def swap(m: re.Match) -> str:
        kind, body = m.group(1), m.group(2)
        if kind == "SEQ":
            lo, hi = body.split(";")
            if engine == "spark":
                return f"explode(sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT)))"
            return f"unnest(generate_series(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT)))"
        if kind == "ARR":
            return f"array({body})" if engine == "spark" else f"[{body}]"
        xs, i = body.split(";")
        return f"element_at({xs}, CAST({i} AS INT))" if engine == "spark" else f"{xs}[{i}]"

    return _TOKEN.sub(swap, text)


def _needed(text: str, seen: list[str]) -> list[str]:
    """Bindings ``text`` refers to, dependencies first."""
    for name in sorted(set(re.findall(r"\bb_[a-z_]+\b", text))):
        if name in BINDINGS and name not in seen:
            _needed(BINDINGS[name], seen)
            seen.append(name)
    return seen


def with_bindings(body: str, engine: str = "duckdb") -> str:
    """``body`` preceded by the CTEs of every binding it names."""
    ctes = [f"{n} AS ({_dialect(BINDINGS[n], engine)})" for n in _needed(body, [])]
    body = _dialect(body.strip(), engine)
    if not ctes:
        return body
    m = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}" + ",\n".join(ctes) + ",\n" + body[m.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Given tables and bindings of one directory as DataFrames: ``t.supplier``, ``t.b_shanks``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SOURCE_TABLES:
            return self.spark.table(self._view(name))
        if name in BINDINGS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def _view(self, name: str, key: str | None = None) -> str:
        """Temporary view of one given table, with ``key`` spread by it; made once, so its schema is read once."""
        view = f"vk_{zlib.crc32(self.sf_dir.encode()):08x}_{name}"
        if key:
            view += f"_spread{self.spark.conf.get('spark.sql.shuffle.partitions')}"
        if not self.spark.catalog.tableExists(view):
            table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            (spread(table, key) if key else table).createOrReplaceTempView(view)
        return view

    def sql(self, body: str) -> DataFrame:
        text, keys = with_bindings(body, "spark"), dict(GROWN[b] for b in _needed(body, []) if b in GROWN)
        return self.spark.sql(_SOURCES.sub(lambda m: f"{m.group(1)} {self._view(m.group(2), keys.get(m.group(2)))} AS {m.group(2)}", text))
