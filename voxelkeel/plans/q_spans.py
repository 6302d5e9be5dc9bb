"""Queries over recordings, channels, spans, streams and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.functions import text as X
from voxelkeel.operators import recordings as R
from voxelkeel.operators import spans as S
from voxelkeel.plans.registry import query

_DEPTH_SQL = """
lo AS (SELECT recording, min(axial_um) AS lowest FROM b_channels GROUP BY recording),
ex AS (SELECT c.*, r.penetration, r.label, r.insertion_depth_um, lowest, CASE WHEN first_electrode IS NULL THEN 0e0 ELSE ((first_electrode - 1) // 2) * 15e0 END AS e
  FROM b_channels c JOIN lo USING (recording) JOIN b_recordings r USING (recording)),
dp AS (SELECT *, CASE WHEN e <> 0 AND abs(lowest - e) <= 30 THEN 0e0 ELSE e END AS bo FROM ex)"""
_SPAN_SQL = _DEPTH_SQL + """,
sp AS (SELECT penetration, recording, label, min(insertion_depth_um - axial_um - bo) AS top_um, max(insertion_depth_um - axial_um - bo) AS bottom_um, count(*) AS n_channels FROM dp GROUP BY 1, 2, 3)"""


def channels(t):
    return S.with_bank_offset(t.b_channels.join(t.b_recordings, "recording"))


def spans(t):
    return S.recording_span(channels(t))


@query("p29_bank_offset", f"WITH {_DEPTH_SQL.strip()} SELECT recording, channel, bo AS bank_offset_um, axial_um + bo AS depth_from_tip_um, insertion_depth_um - axial_um - bo AS depth_below_um FROM dp")
def _p29(t):
    return channels(t).select("recording", "channel", "bank_offset_um", "depth_from_tip_um", "depth_below_um")


_CH = "SELECT recording, channel, CASE WHEN recording % 5 = 3 THEN NULL ELSE x_um END AS x_um, CASE WHEN recording % 10 = 3 THEN 'a' ELSE CAST(shank_id AS STRING) END AS shank_id, axial_um FROM b_channels"


@query("p30_shank_of_channel", f"""
SELECT recording, channel, x_um IS NOT NULL OR shank_id <> 'a' AS shank_known, CAST(coalesce(round_even(x_um / 250, 0), try_cast(shank_id AS INT), 0) AS INT) AS shank FROM ({_CH}) c""")
def _p30(t):
    return S.shank_of_channel(t.sql(_CH)).select("recording", "channel", "shank_known", "shank")


@query("a09_recording_span", f"WITH {_SPAN_SQL.strip()} SELECT penetration, recording, label, top_um, bottom_um, n_channels, top_um < 0 AS above_surface FROM sp")
def _a09(t):
    return spans(t)


_COV_SQL = """
cv AS (SELECT recording, CAST(round_even(x_um / 250, 0) AS INT) AS shank, axial_um, x_um FROM b_channels),
st AS (SELECT recording, shank, axial_um - lag(axial_um) OVER (PARTITION BY recording, shank ORDER BY axial_um) AS step FROM (SELECT DISTINCT recording, shank, axial_um FROM cv) d),
ms AS (SELECT recording, shank, coalesce(median(step), 0) AS step_um FROM st GROUP BY 1, 2),
cov AS (SELECT recording, shank, count(*) AS n_sites, min(axial_um) AS top_um, max(axial_um) AS bottom_um, max(step_um) AS step_um, count(DISTINCT x_um) AS n_columns FROM cv JOIN ms USING (recording, shank) GROUP BY 1, 2)"""


def coverage(t):
    return S.shank_coverage(S.shank_of_channel(t.b_channels))


@query("a10_shank_coverage", f"WITH {_COV_SQL.strip()} SELECT * FROM cov")
def _a10(t):
    return coverage(t).select("recording", "shank", "n_sites", "top_um", "bottom_um", "step_um", "n_columns")


_CONFIGS = """SELECT recording, CASE recording % 5 WHEN 0 THEN 'All shanks' WHEN 1 THEN 'shank 2 only' WHEN 2 THEN 'electrodes 1-96' WHEN 3 THEN NULL ELSE 'bank 900 - 996' END AS stated_config FROM b_recordings"""


@query("p35_config_checks", f"""WITH {_COV_SQL.strip()},
a AS (SELECT recording, count(*) AS n, min(top_um) AS lo, max(bottom_um) AS hi, max(top_um) AS mt, arg_min(n_columns, shank) AS nc, min(shank) AS s0 FROM cov GROUP BY 1),
c AS (SELECT *, lower(coalesce(stated_config, '')) AS st, try_cast(nullif(regexp_extract(stated_config, '(\\d+)\\s*-\\s*(\\d+)', 1), '') AS BIGINT) AS f FROM ({_CONFIGS}) q LEFT JOIN a USING (recording))
SELECT recording, mt > 30 AS is_absolute, concat(CASE WHEN n > 1 THEN concat('all ', CAST(n AS VARCHAR), ' shanks') ELSE concat('shank ', CAST(s0 AS VARCHAR)) END, ', ', CAST(CAST(round_even(lo, 0) AS BIGINT) AS VARCHAR), '-', CAST(CAST(round_even(hi, 0) AS BIGINT) AS VARCHAR), ' um from tip', CASE WHEN nc = 1 THEN ', single column' ELSE '' END) AS description,
  CASE WHEN st = '' THEN NULL WHEN st LIKE '%all shank%' AND n = 1 THEN 'stated_all_shanks' WHEN regexp_matches(st, '\\bshank\\s*\\d+\\b') AND NOT st LIKE '%all shank%' AND n > 1 THEN 'stated_one_shank'
    WHEN f IS NOT NULL AND mt > 30 AND abs(lo - ((f - 1) // 2) * 15) > 60 THEN 'range_start' END AS mismatch FROM c""")
def _p35(t):
    return S.config_checks(coverage(t), t.sql(_CONFIGS)).select("recording", "is_absolute", "description", "mismatch")


@query("p35_electrode_range", f"""WITH {_COV_SQL.strip()}
SELECT recording, shank, CASE WHEN ok THEN f END AS first_electrode, CASE WHEN ok THEN f + n_sites - 1 END AS last_electrode
FROM (SELECT *, step_um > 0 AND n_columns = 2 AND n_sites = (round_even((bottom_um - top_um) / 15, 0) + 1) * 2 AS ok, CAST(round_even(top_um / 15, 0) * 2 + 1 AS BIGINT) AS f FROM cov) q""")
def _p35b(t):
    return S.electrode_range(coverage(t)).select("recording", "shank", "first_electrode", "last_electrode")


_MERGED_SQL = """
r0 AS (SELECT *, max(bottom_um) OVER (PARTITION BY penetration ORDER BY top_um, bottom_um ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
r1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR top_um - reach > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY penetration ORDER BY top_um, bottom_um ROWS UNBOUNDED PRECEDING) AS grp FROM r0),
mg AS (SELECT penetration, grp - 1 AS span, min(top_um) AS top_um, max(bottom_um) AS bottom_um FROM r1 GROUP BY 1, 2)"""


@query("w03_span_merge", f"WITH {_SPAN_SQL.strip()}, {_MERGED_SQL.strip()} SELECT penetration, CAST(span AS BIGINT) AS span, top_um, bottom_um FROM mg")
def _w03(t):
    return S.merge_spans(spans(t), ["penetration"])


@query("w03_span_gaps", f"""WITH {_SPAN_SQL.strip()}, {_MERGED_SQL.strip()},
cmp AS (SELECT penetration, coalesce(lag(bottom_um) OVER w, 0) AS lo, top_um AS hi FROM mg WINDOW w AS (PARTITION BY penetration ORDER BY top_um)
  UNION ALL SELECT penetration, max(bottom_um), 4000 FROM mg GROUP BY penetration)
SELECT penetration, 'gap' AS kind, reach AS lo, top_um AS hi FROM r0 WHERE top_um - reach > 15
UNION ALL SELECT penetration, 'uncovered', greatest(lo, 0), least(hi, 4000) FROM cmp WHERE least(hi, 4000) > greatest(lo, 0)""")
def _w03b(t):
    sp = spans(t)
    gaps = S.span_gaps(sp, ["penetration"]).select("penetration", F.lit("gap").alias("kind"), F.col("gap_top_um").alias("lo"), F.col("gap_bottom_um").alias("hi"))
    merged = S.merge_spans(sp, ["penetration"]).withColumn("extent_um", F.lit(4000.0))
    rest = S.span_complement(merged, ["penetration"]).select("penetration", F.lit("uncovered").alias("kind"), "lo", "hi")
    return gaps.unionByName(rest)


_RECS = "SELECT recording, penetration, CASE WHEN recording % 3 = 1 OR penetration % 3 = 2 THEN NULL ELSE insertion_depth_um END AS insertion_depth_um FROM b_recordings"


@query("w03_coverage_from_tip", f"""WITH {_COV_SQL.strip()}, rc AS ({_RECS}), dm AS (SELECT penetration, max(insertion_depth_um) AS ref FROM rc GROUP BY 1),
s AS (SELECT penetration, shank, top_um + coalesce(ref - insertion_depth_um, 0) AS t, bottom_um + coalesce(ref - insertion_depth_um, 0) AS b FROM cov JOIN rc USING (recording) JOIN dm USING (penetration) WHERE ref IS NULL OR insertion_depth_um IS NOT NULL),
g AS (SELECT *, max(b) OVER (PARTITION BY penetration, shank ORDER BY t, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t - reach > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY penetration, shank ORDER BY t, b ROWS UNBOUNDED PRECEDING) - 1 AS span FROM g)
SELECT penetration, shank, CAST(span AS BIGINT) AS span, min(t) AS top_um, max(b) AS bottom_um FROM i GROUP BY 1, 2, 3""")
def _w03c(t):
    return S.coverage_from_tip(coverage(t), t.sql(_RECS))


@query("j04_recording_overlaps", f"""WITH {_SPAN_SQL.strip()}, o AS (SELECT *, row_number() OVER (PARTITION BY penetration ORDER BY top_um, recording) AS rn FROM sp)
SELECT a.penetration, a.label AS label_a, b.label AS label_b, greatest(a.top_um, b.top_um) AS lo_um, least(a.bottom_um, b.bottom_um) AS hi_um
FROM o a JOIN o b ON b.penetration = a.penetration AND a.rn < b.rn WHERE least(a.bottom_um, b.bottom_um) > greatest(a.top_um, b.top_um)""")
def _j04(t):
    return S.recording_overlaps(spans(t))


@query("a37_coverage_fraction", f"""WITH {_SPAN_SQL.strip()}, {_MERGED_SQL.strip()}, tr AS (SELECT DISTINCT penetration, 200e0 + penetration % 4 * 100 - CASE WHEN penetration % 5 = 4 THEN 1000 ELSE 0 END AS track_length_um FROM b_recordings),
g AS (SELECT penetration, sum(top_um - reach) FILTER (top_um - reach > 15) AS gap, min(top_um) AS lo, max(bottom_um) AS hi FROM r0 GROUP BY 1)
SELECT penetration, lo AS range_top_um, hi AS range_bottom_um, round(CASE WHEN track_length_um <= 0 THEN 0 ELSE least(1, greatest(0, (hi - lo - coalesce(gap, 0)) / track_length_um)) END, 6) + 0e0 AS fraction FROM tr JOIN g USING (penetration)""")
def _a37(t):
    tracks = t.sql("SELECT DISTINCT penetration, 200e0 + penetration % 4 * 100 - CASE WHEN penetration % 5 = 4 THEN 1000 ELSE 0 END AS track_length_um FROM b_recordings")
    out = S.coverage_fraction(spans(t), tracks)
    return G.rounded(out.select("penetration", "range_top_um", "range_bottom_um", "fraction"))


@query("u02_recorded_electrodes", """
WITH r AS (SELECT penetration AS probe, first_electrode AS f, last_electrode AS l FROM b_recordings WHERE penetration % 3 <> 1 AND first_electrode IS NOT NULL),
e AS (SELECT DISTINCT probe, unnest(generate_series(f - 1, l - 1)) AS channel FROM r), c AS (SELECT DISTINCT penetration AS probe, unnest(generate_series(0, 63)) AS channel FROM b_recordings)
SELECT probe, channel FROM c WHERE (probe, channel) IN (SELECT (probe, channel) FROM e) OR probe NOT IN (SELECT probe FROM e)""")
def _u02(t):
    recs = t.sql("SELECT penetration AS probe, CASE WHEN penetration % 3 <> 1 THEN first_electrode END AS first_electrode, last_electrode FROM b_recordings")
    sites = t.sql("SELECT probe, SEQ[0;63] AS channel FROM (SELECT DISTINCT penetration AS probe FROM b_recordings) d")
    return S.only_recorded(sites, S.recorded_electrodes(recs, ["probe"]), ["probe"])


_DYES = """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN ' DiI (Far Red) ' WHEN 1 THEN 'Deep Red' WHEN 2 THEN 'Alexa Green' WHEN 3 THEN 'red/green' WHEN 4 THEN 'Blue-Gold' WHEN 5 THEN '' WHEN 6 THEN 'CM-DiI' ELSE o_orderpriority END AS dye,
  CASE o_orderkey % 6 WHEN 0 THEN '2024_03_05' WHEN 1 THEN '2024-3-5' WHEN 2 THEN '3/15/2024' WHEN 3 THEN '3/15/24' WHEN 4 THEN concat('199', CAST(o_orderkey % 10 AS STRING), '-0', CAST(1 + o_orderkey % 9 AS STRING), '-11') ELSE '' END AS day,
  CASE o_orderkey % 4 WHEN 0 THEN 'Probe A' WHEN 1 THEN 'probe' WHEN 2 THEN 'ProbeB_1' ELSE concat('#', o_orderstatus, '  x') END AS probe FROM orders"""


@query("p34_text_normalise", f"""
WITH z AS (SELECT *, lower(trim(dye)) AS d0, trim(day) AS s, trim(regexp_replace(lower(trim(probe)), '[^a-z0-9]+', ' ', 'g')) AS nk FROM ({_DYES}) q),
y AS (SELECT *, CASE WHEN regexp_extract(d0, '\\(([^)]+)\\)', 0) <> '' THEN trim(regexp_extract(d0, '\\(([^)]+)\\)', 1)) ELSE d0 END AS d FROM z)
SELECT id, CASE WHEN d LIKE '%far red%' OR d LIKE '%deep red%' THEN 'far red' WHEN d LIKE '%green%' THEN 'green' WHEN d LIKE '%red%' THEN 'red' WHEN d LIKE '%blue%' THEN 'blue' ELSE nullif(d, '') END AS dye,
  CAST(CASE WHEN regexp_matches(s, '^\\d{{4}}[_-]\\d{{2}}[_-]\\d{{2}}$') THEN try_cast(replace(s, '_', '-') AS DATE)
    WHEN regexp_matches(s, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN try_cast(concat(split_part(s, '/', 3), '-', split_part(s, '/', 1), '-', split_part(s, '/', 2)) AS DATE) END AS VARCHAR) AS day,
  CASE WHEN trim(replace(nk, 'probe', '')) <> '' THEN trim(replace(nk, 'probe', '')) ELSE nk END AS probe_key, coalesce(nullif(trim(regexp_replace(probe, '[^A-Za-z0-9_-]', '_', 'g'), '_'), ''), 'probe') AS slug FROM y""")
def _p34(t):
    d = t.sql(_DYES)
    return d.select("id", X.normalise_dye(F.col("dye")).alias("dye"), X.parse_date(F.col("day")).cast("string").alias("day"),
                    X.probe_key(F.col("probe")).alias("probe_key"), X.slug(F.col("probe")).alias("slug"))


_PATHS = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('/data/CUST_', CAST(o_custkey AS STRING), '/2024_03_0', CAST(1 + o_orderkey % 9 AS STRING), '/run1/Record Node 101')
  WHEN 1 THEN concat('/lab/mouse', CAST(o_custkey AS STRING), '/2023-11-21/Raw Ephys Data/rec') WHEN 2 THEN concat('/lab/x', CAST(o_custkey AS STRING), '/Raw-Ephys/node')
  WHEN 3 THEN concat('/lab/s', CAST(o_custkey AS STRING), '/session/node') ELSE concat('/lab/2022_01_31/z', CAST(o_custkey AS STRING)) END AS path,
  CASE o_orderkey % 3 WHEN 0 THEN 'Record Node 101#Neuropix-PXI-100.ProbeA' WHEN 1 THEN 'imec0.ap' ELSE 'amplifier.' END AS stream FROM orders"""


@query("s11_path_ids", f"""
WITH p AS (SELECT *, list_filter(str_split(path, '/'), lambda x: x <> '') AS parts FROM ({_PATHS}) q),
a AS (SELECT *, list_position(list_transform(parts, lambda x: regexp_matches(x, '^\\d{{4}}[_-]\\d{{2}}[_-]\\d{{2}}$')), true) AS hit, regexp_replace(path, '/[^/]+/?$', '') AS parent FROM p),
b AS (SELECT *, regexp_replace(parent, '/[^/]+/?$', '') AS grand, trim(regexp_replace(lower(split_part(parent, '/', -1)), '[^a-z0-9]+', ' ', 'g')) AS pn FROM a)
SELECT id, CASE WHEN hit > 1 THEN parts[hit - 1] END AS subject, CASE WHEN hit > 0 THEN replace(parts[hit], '_', '-') END AS session_date, CASE WHEN hit > 0 AND hit < len(parts) THEN parts[hit + 1] END AS recording_label,
  CASE WHEN pn IN ('raw ephys data', 'raw ephys', 'ephys', 'raw', 'raw data', 'data', 'openephys', 'open ephys', 'recording', 'recordings') AND grand <> '' THEN grand ELSE parent END AS session_folder,
  CASE WHEN trim(split_part(stream, '.', -1)) <> '' THEN trim(split_part(stream, '.', -1)) ELSE stream END AS probe_label FROM b""")
def _s11(t):
    df = t.sql(_PATHS)
    ids = X.path_ids(F.col("path"))
    return df.select("id", ids["subject"].alias("subject"), ids["session_date"].cast("string").alias("session_date"), ids["recording_label"].alias("recording_label"),
                     ids["session_folder"].alias("session_folder"), X.probe_label(F.col("stream")).alias("probe_label"))


@query("j02_attach_metadata", """
WITH m AS (SELECT *, trim(regexp_replace(lower(trim(subject)), '[^a-z0-9]+', ' ', 'g')) AS s, trim(regexp_replace(lower(trim(recording)), '[^a-z0-9]+', ' ', 'g')) AS r,
    trim(replace(trim(regexp_replace(lower(trim(probe)), '[^a-z0-9]+', ' ', 'g')), 'probe', '')) AS p FROM b_metadata),
f AS (SELECT s, session_date AS d, r, p, max(row_no) AS rn FROM m GROUP BY 1, 2, 3, 4),
g AS (SELECT s, session_date AS d, p, min(row_no) AS rn FROM m GROUP BY 1, 2, 3 HAVING count(*) = 1 OR count(DISTINCT insertion_depth_um) + max(CASE WHEN insertion_depth_um IS NULL THEN 1 ELSE 0 END) = 1),
st AS (SELECT *, coalesce(trim(regexp_replace(lower(subject), '[^a-z0-9]+', ' ', 'g')), '') AS s, trim(regexp_replace(lower(recording_label), '[^a-z0-9]+', ' ', 'g')) AS r, trim(replace(lower(probe_label), 'probe', '')) AS p FROM b_streams),
j AS (SELECT st.stream_id, coalesce(f.rn, g.rn) AS rn FROM st LEFT JOIN f ON f.s = st.s AND f.d IS NOT DISTINCT FROM st.session_date AND f.r = st.r AND f.p = st.p LEFT JOIN g ON g.s = st.s AND g.d IS NOT DISTINCT FROM st.session_date AND g.p = st.p)
SELECT stream_id, j.rn AS row_no, b.insertion_depth_um, CASE WHEN lower(b.dye) LIKE '%deep red%' THEN 'far red' WHEN lower(b.dye) LIKE '%green%' THEN 'green' WHEN lower(b.dye) LIKE '%red%' THEN 'red' ELSE nullif(lower(b.dye), '') END AS dye,
  CASE WHEN b.insertion_depth_um IS NOT NULL THEN 'sidecar' ELSE 'unknown' END AS depth_source FROM j LEFT JOIN b_metadata b ON b.row_no = j.rn""")
def _j02(t):
    return R.attach_metadata(t.b_streams, t.b_metadata).select("stream_id", "row_no", "insertion_depth_um", "dye", "depth_source")


_CANDS = """SELECT stream_id, subject, session_date, CASE WHEN stream_id % 5 = 0 THEN 'ProbeA' ELSE probe_label END AS probe_label, recording_label, CASE stream_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'red' ELSE 'green' END AS dye,
  concat('/data/f', CAST(stream_id % 40 AS STRING)) AS session_folder, CASE WHEN stream_id % 7 = 2 THEN NULL ELSE 3000e0 + stream_id % 4 * 100 END AS insertion_depth_um, concat('cfg', CAST(stream_id % 2 AS STRING)) AS config FROM b_streams"""


@query("a15_group_penetrations", f"""
SELECT subject, CAST(session_date AS VARCHAR) AS session_date, probe_label, dye, hint AS folder_hint, count(*) AS n_recordings, count(*) FILTER (insertion_depth_um IS NULL) AS n_missing_depth, count(DISTINCT insertion_depth_um) AS n_depths,
  min(insertion_depth_um) AS min_depth_um, max(insertion_depth_um) AS max_depth_um, subject IS NULL OR session_date IS NULL AS by_folder,
  (subject IS NULL OR session_date IS NULL) AND count(*) > 1 AND count(*) FILTER (insertion_depth_um IS NULL) > 0 AND count(DISTINCT config) > 1 AS mixed_configs
FROM (SELECT *, CASE WHEN subject IS NULL OR session_date IS NULL THEN session_folder END AS hint FROM ({_CANDS}) c) q GROUP BY subject, q.session_date, probe_label, dye, hint""")
def _a15(t):
    out = R.group_penetrations(t.sql(_CANDS)).withColumn("session_date", F.col("session_date").cast("string"))
    return out.drop("n_configs")


_STREAM_LIST = """SELECT recording, fmt AS format, pos, CASE fmt WHEN 'intan' THEN CASE pos WHEN 0 THEN 'RHD2000 auxiliary' WHEN 1 THEN 'RHD2000 amplifier channel' ELSE 'USB board' END
  WHEN 'spikeglx' THEN CASE (pos + recording) % 4 WHEN 0 THEN 'nidq' WHEN 1 THEN 'imec0.lf' WHEN 2 THEN 'imec0.ap' ELSE 'imec0.ap-SYNC' END
  ELSE CASE (pos + recording) % 4 WHEN 0 THEN 'Record Node#Neuropix-PXI.ProbeA-LFP' WHEN 1 THEN 'NI-DAQmx' WHEN 2 THEN 'Record Node#Neuropix-PXI.ProbeA-AP' ELSE 'Neuropix.SYNC-LF' END END AS name
FROM (SELECT recording, pos, CASE recording % 3 WHEN 0 THEN 'intan' WHEN 1 THEN 'spikeglx' ELSE 'openephys' END AS fmt FROM (SELECT o_orderkey AS recording, SEQ[0;o_orderkey % 4] AS pos FROM orders) a) b"""


@query("s10_select_stream", f"""
WITH s AS (SELECT *, upper(name) AS u FROM ({_STREAM_LIST}) q),
p AS (SELECT *, CASE WHEN format <> 'intan' AND NOT contains(u, 'SYNC') AND (CASE WHEN format = 'spikeglx' THEN contains(u, '.LF') OR u LIKE '%LF' ELSE contains(u, 'LFP') OR u LIKE '%-LF' OR u LIKE '%.LF' END) THEN 1 END AS lp,
  CASE format WHEN 'intan' THEN CASE WHEN contains(u, 'AMPLIFIER') THEN 1 END WHEN 'spikeglx' THEN CASE WHEN contains(u, 'NIDQ') OR contains(u, 'SYNC') THEN NULL WHEN contains(u, '.AP') OR u LIKE '%AP' THEN 1 ELSE 2 END
    ELSE CASE WHEN contains(name, 'Neuropix') AND contains(u, 'AP') THEN 1 WHEN contains(name, 'Neuropix') THEN 2 ELSE 3 END END AS wp FROM s)
SELECT recording, 'lfp' AS kind, name AS stream, pos FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY lp, pos) AS rn FROM p WHERE lp IS NOT NULL) a WHERE rn = 1
UNION ALL SELECT recording, 'wideband', name, pos FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY wp, pos) AS rn FROM p WHERE wp IS NOT NULL) a WHERE rn = 1""")
def _s10(t):
    s = t.sql(_STREAM_LIST)
    pick = lambda kind: R.select_stream(s, kind).select("recording", F.lit(kind).alias("kind"), "stream", "pos")
    return pick("lfp").unionByName(pick("wideband"))
