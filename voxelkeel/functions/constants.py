"""Fixed values that must equal the published ones, and small constant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Allen CCF frame in um.
AP_UM, DV_UM, ML_UM = 13200.0, 8000.0, 11400.0
MIDLINE_ML_UM = 5700.0
BREGMA_AP_FROM_ORIGIN_UM = 5400.0
BREGMA_DV_FROM_ORIGIN_UM = 440.0
LEGACY_BREGMA_AP_UM = 6600.0
QUICKNII_DIMS_APDVML = (528, 320, 456)

# Bregma AP by atlas-name prefix, longest prefix wins.
BREGMA_AP_BY_ATLAS = {
    "allen_mouse": 5400.0,
    "kim_mouse": 5400.0,
    "kim_mouse_isotropic": 5502.0,
    "ccfv3augmented_mouse": 5746.0,
}

# Fixed values: (pitch_deg, scale_ap, scale_ml, scale_dv, bregma_dv_um) per preset.
PAXINOS_PRESETS = {
    "none": (0.0, 1.0, 1.0, 1.0, 0.0),
    "allen_forum": (5.0, 1.0, 1.0, 0.9434, BREGMA_DV_FROM_ORIGIN_UM),
    "qiu2018": (5.0, 1.031, 0.952, 0.885, BREGMA_DV_FROM_ORIGIN_UM),
    "dorr2008": (5.0, 1.087, 1.0, 0.952, BREGMA_DV_FROM_ORIGIN_UM),
}

# Electrode geometry.
SHANK_PITCH_UM = 250.0
COLUMN_CENTRE_UM = 16.0
NP2_ROW_PITCH_UM = 15.0
NP2_TIP_TO_LOWEST_UM = 217.0

# LFP bands in Hz, [lo, hi).
LFP_BANDS_HZ = ((0.0, 4.0), (4.0, 10.0), (10.0, 30.0), (30.0, 80.0), (80.0, 200.0))


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_table(spark: SparkSession, columns: list[str], rows) -> DataFrame:
    """A constant table as a JVM-side local relation (no Python workers involved)."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
