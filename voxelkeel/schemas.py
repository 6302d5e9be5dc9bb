"""Schema of the project document."""

_POINT = "STRUCT<x_px DOUBLE, y_px DOUBLE>"
_SECTION = f"""STRUCT<`index` BIGINT, slide_idx BIGINT, bbox_px ARRAY<BIGINT>, ap_order BIGINT, slide_number BIGINT,
  plane STRUCT<ap_um DOUBLE, ml_tilt_deg DOUBLE, dv_tilt_deg DOUBLE, midline_px DOUBLE, dorsal_surface_px DOUBLE, pixel_size_um DOUBLE, image_right_is_anatomical_right BOOLEAN>,
  ap_source STRING, rotation_deg DOUBLE, deepslice_anchoring ARRAY<DOUBLE>, registration STRUCT<anchoring ARRAY<DOUBLE>, output_size_px ARRAY<BIGINT>, bspline_transform_path STRING, residual DOUBLE>,
  flip_h BOOLEAN, flip_v BOOLEAN, manual_affine ARRAY<ARRAY<DOUBLE>>, manual_landmarks STRUCT<source ARRAY<ARRAY<DOUBLE>>, target ARRAY<ARRAY<DOUBLE>>, forward BOOLEAN>, image_path STRING,
  reference STRUCT<project_path STRING, section_index BIGINT, matrix ARRAY<ARRAY<DOUBLE>>, mirrored BOOLEAN>>"""
_EPHYS = "STRUCT<feature_um ARRAY<DOUBLE>, track_um ARRAY<DOUBLE>, extremes_mode STRING, insertion_depth_um DOUBLE>"
_SHANK = f"""STRUCT<`index` BIGINT, tip_px {_POINT}, tip_section_idx BIGINT, entry_px {_POINT}, entry_section_idx BIGINT, tip_ccf_um ARRAY<DOUBLE>, entry_ccf_um ARRAY<DOUBLE>,
  track_points_ccf_um ARRAY<ARRAY<DOUBLE>>, track_picks ARRAY<STRUCT<point {_POINT}, section_idx BIGINT>>, ephys {_EPHYS}>"""
_EPOCH = "STRUCT<t_start_s DOUBLE, t_end_s DOUBLE, kept BOOLEAN, reject_reason STRING>"
_RECORDING = f"""STRUCT<path STRING, label STRING, stream_name STRING, insertion_depth_um DOUBLE, electrode_range ARRAY<BIGINT>, bank_offset_um DOUBLE, epochs ARRAY<{_EPOCH}>>"""
_PROBE = f"STRUCT<label STRING, type STRUCT<name STRING, n_shanks BIGINT, shank_pitch_um DOUBLE>, shanks ARRAY<{_SHANK}>, recordings ARRAY<{_RECORDING}>>"
_CELL = "STRUCT<ap_um DOUBLE, ml_um DOUBLE, dv_um DOUBLE, section_index BIGINT, x_px DOUBLE, y_px DOUBLE, cell_type STRING, region STRING>"
_SLIDE = f"STRUCT<image_path STRING, source_paths ARRAY<STRING>, sections ARRAY<{_SECTION}>, flip_h BOOLEAN, flip_v BOOLEAN, pixel_um DOUBLE>"

PROJECT = f"""version BIGINT, atlas STRUCT<name STRING, resolution_um DOUBLE>, slides ARRAY<{_SLIDE}>, probes ARRAY<{_PROBE}>,
  section_spacing_um DOUBLE, cell_sets ARRAY<STRUCT<name STRING, source STRING, cells ARRAY<{_CELL}>>>, seen_from STRING"""

#: Fields of the document, and the types of the structs a change may begin.
DOCUMENT_FIELDS = ("version", "atlas", "slides", "probes", "section_spacing_um", "cell_sets", "seen_from")
PARTS = {
    "plane": "ap_um DOUBLE, ml_tilt_deg DOUBLE, dv_tilt_deg DOUBLE, midline_px DOUBLE, dorsal_surface_px DOUBLE, pixel_size_um DOUBLE, image_right_is_anatomical_right BOOLEAN",
    "registration": "anchoring ARRAY<DOUBLE>, output_size_px ARRAY<BIGINT>, bspline_transform_path STRING, residual DOUBLE",
}

QUINT = """target STRING, `target-resolution` ARRAY<BIGINT>, slices ARRAY<STRUCT<filename STRING, nr BIGINT, width BIGINT, height BIGINT, anchoring ARRAY<DOUBLE>, markers ARRAY<ARRAY<DOUBLE>>>>,
  sections ARRAY<STRUCT<filename STRING, nr BIGINT, width BIGINT, height BIGINT, ouv ARRAY<DOUBLE>, markers ARRAY<ARRAY<DOUBLE>>>>"""

RHX_MAP = """Page ARRAY<STRUCT<_name STRING, Line ARRAY<STRUCT<_y1 DOUBLE, _y2 DOUBLE>>, Port ARRAY<STRUCT<_name STRING, ElectrodeSite ARRAY<STRUCT<_channelNumber BIGINT, _x DOUBLE, _y DOUBLE>>>>>>"""
