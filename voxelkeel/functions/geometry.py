"""Coordinate arithmetic as built-in column expressions (all stay inside codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelkeel.functions import constants as C
from voxelkeel.functions.constants import values_table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column and drop negative zeros (comparison and report form)."""
    out = {
        f.name: F.round(F.col(f.name), digits) + F.lit(0.0)
        for f in df.schema.fields
        if isinstance(f.dataType, T.DoubleType)
    }
    return df.withColumns(out) if out else df


def norm3(a: Column, b: Column, c: Column) -> Column:
    return F.sqrt(a * a + b * b + c * c)


def cross3(a, b) -> tuple[Column, Column, Column]:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot3(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


# --- P01-P06: frames --------------------------------------------------------------------


def bregma_ap(atlas_name: Column) -> Column:
    """Bregma AP by longest matching atlas-name prefix; null where unknown."""
    name = F.lower(F.trim(atlas_name))
    out = F.lit(None).cast("double")
    for prefix, value in sorted(C.BREGMA_AP_BY_ATLAS.items(), key=lambda kv: len(kv[0])):
        out = F.when(name.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def require_bregma(atlas_name: Column) -> Column:
    """As :func:`bregma_ap`, failing the job for an atlas without a known anchor."""
    message = F.concat(F.lit("no bregma anchor is known for atlas "), F.coalesce(atlas_name, F.lit("null")))
    return F.coalesce(bregma_ap(atlas_name), F.raise_error(message).cast("double"))


def bregma_ap_for_display(atlas_name: Column) -> Column:
    return F.coalesce(bregma_ap(atlas_name), F.lit(C.BREGMA_AP_FROM_ORIGIN_UM))


def to_paxinos(df: DataFrame, alignment: str | Column = "qiu2018", *, ap="ap_um", ml="ml_um", dv="dv_um",
               bregma: Column | None = None, midline: Column | None = None) -> DataFrame:
    """Stereotaxic ``ap_mm, ml_mm, dv_mm``. ``alignment`` is a preset name or a column of names.

    The four presets join as a constant table; an unknown name fails the job.
    """
    if isinstance(alignment, str):
        if alignment not in C.PAXINOS_PRESETS:
            raise ValueError(f"unknown alignment {alignment!r}; options: {sorted(C.PAXINOS_PRESETS)}")
        alignment = F.lit(alignment)
    presets = values_table(
        df.sparkSession, ["_name", "_pitch", "_sap", "_sml", "_sdv", "_bdv"],
        [(k, math.radians(v[0]), *v[1:]) for k, v in C.PAXINOS_PRESETS.items()],
    )
    joined = df.withColumn("_alignment", alignment).join(
        F.broadcast(presets), F.col("_alignment") == F.col("_name"), "left"
    )
    pitch = F.coalesce("_pitch", F.raise_error(F.concat(F.lit("unknown alignment "), "_alignment")).cast("double"))
    ap_c = F.col(ap) - (F.lit(C.BREGMA_AP_FROM_ORIGIN_UM) if bregma is None else bregma)
    ml_c = F.col(ml) - (F.lit(C.MIDLINE_ML_UM) if midline is None else midline)
    dv_c = F.col(dv) - F.col("_bdv")
    cos, sin = F.cos(pitch), F.sin(pitch)
    return joined.withColumns({
        "ap_mm": -((ap_c * cos - dv_c * sin) * F.col("_sap")) / 1000.0,
        "ml_mm": -(ml_c * F.col("_sml")) / 1000.0,
        "dv_mm": ((ap_c * sin + dv_c * cos) * F.col("_sdv")) / 1000.0,
    }).drop("_alignment", "_name", "_pitch", "_sap", "_sml", "_sdv", "_bdv")


def relative_to_ccf(df: DataFrame, ap_rel="ap_rel", ml_rel="ml_rel", dv="dv_um") -> DataFrame:
    """bregma/midline-relative um to CCF um with the legacy bregma anchor."""
    return df.withColumns({
        "ccf_ap_um": F.lit(C.LEGACY_BREGMA_AP_UM) - F.col(ap_rel),
        "ccf_ml_um": F.lit(C.MIDLINE_ML_UM) - F.col(ml_rel),
        "ccf_dv_um": F.col(dv).cast("double"),
    })


def atlas_extents(annotation: DataFrame, resolution_um: float) -> DataFrame:
    """Extents and midline from the voxel grid."""
    res = F.lit(float(resolution_um))
    sized = annotation.agg(
        ((F.max("i_ap") + 1) * res).alias("ap_extent_um"),
        ((F.max("i_dv") + 1) * res).alias("dv_extent_um"),
        ((F.max("i_ml") + 1) * res).alias("ml_extent_um"),
    )
    return sized.withColumn("midline_um", F.col("ml_extent_um") / 2)


def herbs_grid_um(points: DataFrame, keys: list[str]) -> DataFrame:
    """Voxel size of a HERBS file, read off its largest coordinates."""
    return points.groupBy(*keys).agg(
        F.when((F.max("vox_ap") > 800) | (F.max("vox_ml") > 700), 10).otherwise(25).alias("grid_um")
    )


def _herbs_max(extent: float, grid: Column) -> Column:
    return F.floor(F.lit(extent) / grid) - 1


def herbs_to_ccf(df: DataFrame) -> DataFrame:
    """``vox_ml, vox_ap, vox_dv`` on ``grid_um`` to CCF um (ML and AP axes reversed)."""
    g = F.col("grid_um")
    return df.withColumns({
        "ap_um": (_herbs_max(C.AP_UM, g) - F.col("vox_ap")) * g,
        "ml_um": (_herbs_max(C.ML_UM, g) - F.col("vox_ml")) * g,
        "dv_um": F.col("vox_dv") * g,
    })


def ccf_to_herbs(df: DataFrame, grid_um: float | Column = 10) -> DataFrame:
    """Inverse of :func:`herbs_to_ccf`."""
    g = F.lit(grid_um) if not isinstance(grid_um, Column) else grid_um
    return df.withColumns({
        "vox_ml": _herbs_max(C.ML_UM, g) - F.col("ml_um") / g,
        "vox_ap": _herbs_max(C.AP_UM, g) - F.col("ap_um") / g,
        "vox_dv": F.col("dv_um") / g,
    })


def to_display(df: DataFrame, atlas_name: Column) -> DataFrame:
    """Display frame (right, anterior, up)."""
    return df.withColumns({
        "x_disp": F.lit(C.MIDLINE_ML_UM) - F.col("ml_um"),
        "y_disp": bregma_ap_for_display(atlas_name) - F.col("ap_um"),
        "z_disp": -F.col("dv_um"),
    })


# --- P07-P12: nine-number planes ----------------------------------------------------------


def _nine(a: Column) -> list[Column]:
    return [F.element_at(a, i) for i in range(1, 10)]


def quicknii_to_atlas(a: Column, shape_apdvml=C.QUICKNII_DIMS_APDVML, source_dims=C.QUICKNII_DIMS_APDVML) -> Column:
    """QuickNII (ML, AP, DV) plane to atlas (AP, DV, ML) voxels, all directions reversed."""
    v = _nine(a)
    order = (1, 2, 0)
    ratio = [s / d for s, d in zip(shape_apdvml, source_dims, strict=True)]
    origin = [F.lit(float(shape_apdvml[j])) - v[order[j]] * ratio[j] for j in range(3)]
    rest = [-v[base + order[j]] * ratio[j] for base in (3, 6) for j in range(3)]
    return F.array(*origin, *rest)


def rescale_anchoring(a: Column, source_shape, target_shape) -> Column:
    """Restate a plane on another voxel grid."""
    ratio = F.array(*[F.lit(t / s) for s, t in zip(source_shape, target_shape, strict=True)])
    return F.transform(a, lambda v, i: v * F.element_at(ratio, (i % 3 + 1).cast("int")))


def coronal_anchoring(ap_um: Column, ml_tilt_deg: Column, dv_tilt_deg: Column, seen_from: Column,
                      shape_apdvml, resolution_um: float) -> Column:
    """Plane through AP about the atlas centre, DV tilt first and then ML tilt."""
    _, dv_size, ml_size = (float(s) for s in shape_apdvml)
    sd, cd = F.sin(F.radians(dv_tilt_deg)), F.cos(F.radians(dv_tilt_deg))
    sm, cm = F.sin(F.radians(ml_tilt_deg)), F.cos(F.radians(ml_tilt_deg))
    zero = F.lit(0.0)
    # u starts along ML, v along DV; the DV tilt turns (AP, DV), the ML tilt turns (AP, ML).
    u = [-sm * ml_size, zero, cm * ml_size]
    v_ap = -sd * dv_size
    v = [cm * v_ap, cd * dv_size, sm * v_ap]
    centre = [ap_um / resolution_um, F.lit(dv_size / 2), F.lit(ml_size / 2)]
    origin = [centre[j] - u[j] / 2 - v[j] / 2 for j in range(3)]
    back = seen_from == "back"
    origin[2] = F.when(back, F.lit(ml_size) - origin[2]).otherwise(origin[2])
    u[2] = F.when(back, -u[2]).otherwise(u[2])
    v[2] = F.when(back, -v[2]).otherwise(v[2])
    return F.array(*origin, *u, *v)


def anchoring_view(a: Column) -> Column:
    """P10: ``front`` when the plane's x axis runs towards larger ML."""
    return F.when(F.element_at(a, 6) >= 0, "front").when(F.element_at(a, 6) < 0, "back")


def mirror_anchoring(a: Column, ml_size: float | Column) -> Column:
    """P10: mirror a plane about the midline."""
    size = ml_size if isinstance(ml_size, Column) else F.lit(float(ml_size))
    return F.transform(a, lambda v, i: F.when(i == 2, size - v).when((i == 5) | (i == 8), -v).otherwise(v))


def anchoring_centre_ap(a: Column) -> Column:
    """P10: AP of the plane centre, in voxels."""
    return F.element_at(a, 1) + 0.5 * F.element_at(a, 4) + 0.5 * F.element_at(a, 7)


def plane_values(a: Column, out_h: Column, out_w: Column, resolution_um: Column) -> dict[str, Column]:
    """Readable values of a plane; the normal is flipped to point posteriorly."""
    v = [x * resolution_um for x in _nine(a)]
    w, h = F.greatest(out_w, F.lit(1)), F.greatest(out_h, F.lit(1))
    ax = [x / w for x in v[3:6]]
    ay = [x / h for x in v[6:9]]
    n = cross3(ax, ay)
    flip = F.when(n[0] < 0, -1.0).otherwise(1.0)
    return {
        "plane_ap_um": anchoring_centre_ap(a) * resolution_um,
        "pitch_deg": F.degrees(F.atan2(-n[1] * flip, n[0] * flip)),
        "yaw_deg": F.degrees(F.atan2(-n[2] * flip, n[0] * flip)),
        "rotation_deg_plane": F.degrees(F.atan2(ax[1], F.abs(ax[2]))),
        "scale_x": norm3(*ax),
        "scale_y": norm3(*ay),
        "mirrored": v[5] < 0,
    }


def section_plane_values(sections: DataFrame) -> DataFrame:
    """P11 for section rows: the registration's plane, else the predicted one on the box, else nulls."""
    reg, ds = F.col("reg_anchoring"), F.col("ds_anchoring")
    plane = F.coalesce(reg, ds)
    h = F.when(reg.isNotNull(), F.col("out_h")).otherwise(F.col("y1") - F.col("y0"))
    w = F.when(reg.isNotNull(), F.col("out_w")).otherwise(F.col("x1") - F.col("x0"))
    return sections.withColumns(plane_values(plane, h, w, F.col("resolution_um")))


def section_rotation(anchoring: Column) -> Column:
    """In-plane angle of a predicted plane."""
    return F.degrees(F.atan2(F.element_at(anchoring, 5), F.abs(F.element_at(anchoring, 6))))


def straighten_angle(anchoring: Column, baked_deg: Column) -> Column:
    """Rotation still to apply; zero without a prediction."""
    return F.coalesce(section_rotation(anchoring) - baked_deg, F.lit(0.0))


# --- P13-P15: section pixels ----------------------------------------------------------------


def manual_pixel_to_ccf(df: DataFrame) -> DataFrame:
    """Pixel to CCF by the midline and dorsal-surface anchors of a section."""
    sign = F.when(F.col("image_right_is_right"), 1.0).otherwise(-1.0)
    return df.withColumns({
        "ap_um": F.col("plane_ap_um"),
        "ml_um": F.lit(C.MIDLINE_ML_UM) + sign * (F.col("x_px") - F.col("midline_px")) * F.col("pixel_um"),
        "dv_um": (F.col("y_px") - F.col("dorsal_px")) * F.col("pixel_um"),
    })


def affine_invert_apply(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Apply the inverse of an affine on (row, col), given its top two rows row-major."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    row, col = y - c, x - f
    return ((a * col - d * row) / det, (e * row - b * col) / det)


def affine_world_to_section(m: list[Column], origin_y: Column, origin_x: Column, sign: float = 1.0) -> list[Column]:
    """Conjugate an affine by the box origin; ``sign=-1`` goes back to world."""
    a, b, c, d, e, f = m
    oy, ox = origin_y * sign, origin_x * sign
    return [a, b, a * oy + b * ox + c - oy, d, e, d * oy + e * ox + f - ox]


def affine_is_identity(m: list[Column], atol: float = 1e-6) -> Column:
    """Identity test with numpy's combined absolute and relative tolerance."""
    ok = F.lit(True)
    for value, unit in zip(m, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), strict=True):
        ok = ok & (F.abs(value - unit) <= atol + 1e-5 * unit)
    return F.coalesce(ok, F.lit(True))


def registered_pixel_to_ccf(df: DataFrame, resolution_um: Column | None = None) -> DataFrame:
    """P14 without a warp: undo the affine correction, then the plane; output (AP, ML, DV) um."""
    res = F.col("resolution_um") if resolution_um is None else resolution_um
    o = _nine(F.col("reg_anchoring"))
    su, sv = F.col("x_local") / F.col("out_w"), F.col("y_local") / F.col("out_h")
    vox = [o[j] + su * o[3 + j] + sv * o[6 + j] for j in range(3)]
    return df.withColumns({"ap_um": vox[0] * res, "ml_um": vox[2] * res, "dv_um": vox[1] * res})


# --- P20: slicereg planes ---------------------------------------------------------------------


def slicereg_anchoring(df: DataFrame) -> DataFrame:
    """P20: plane (pitch, yaw) and global fit of a slicereg slice as a nine-number plane.

    Columns in: ``pitch_deg, yaw_deg, plane_w_um, plane_h_um, ap_um, rot_deg, sx, sy, flip,
    tx, ty, factor, w, h, res_um``.
    """
    p, y = F.radians("pitch_deg"), F.radians("yaw_deg")
    pw, ph = F.col("plane_w_um"), F.col("plane_h_um")
    u = [F.sin(y), F.lit(0.0), F.cos(y)]
    v = [F.cos(y) * F.sin(p), F.cos(p), -F.sin(y) * F.sin(p)]
    centre = [F.col("ap_um"), ph / 2, pw / 2]
    origin = [centre[j] - pw / 2 * u[j] - ph / 2 * v[j] for j in range(3)]
    th = F.radians("rot_deg")
    fx = F.when(F.col("flip"), -1.0).otherwise(1.0)
    m = [F.cos(th) * F.col("sx") * fx, -F.sin(th) * F.col("sy"),
         F.sin(th) * F.col("sx") * fx, F.cos(th) * F.col("sy")]
    det = m[0] * m[3] - m[1] * m[2]

    def corner(x: Column, yy: Column) -> list[Column]:
        # Pixel centres: rescaling by 1/factor keeps (p + 0.5) proportional.
        px = (x + 0.5) / F.col("factor") - 0.5 - F.col("tx")
        py = (yy + 0.5) / F.col("factor") - 0.5 - F.col("ty")
        s = (m[3] * px - m[1] * py) / det + pw / 2
        t = (m[0] * py - m[2] * px) / det + ph / 2
        return [(origin[j] + s * u[j] + t * v[j]) / F.col("res_um") for j in range(3)]

    zero = F.lit(0.0)
    c0, cx, cy = corner(zero, zero), corner(F.col("w"), zero), corner(zero, F.col("h"))
    return df.withColumn(
        "anchoring", F.array(*c0, *[cx[j] - c0[j] for j in range(3)], *[cy[j] - c0[j] for j in range(3)])
    )
