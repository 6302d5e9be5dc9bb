"""Text rules for metadata: dates, dyes, keys, slugs and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header aliases of the metadata sidecar. A later entry wins an alias both list.
SIDECAR_ALIASES = {
    "subject": ("subject", "animal", "mouse", "subject_id"),
    "date": ("date", "session_date", "session"),
    "recording": ("recording", "session", "run", "recording_label"),
    "probe": ("probe", "probe_label"),
    "insertion_depth_um": ("insertion depth", "insertion_depth", "depth", "depth_um"),
    "dye": ("dye", "tracer", "label"),
    "orientation": ("orientation", "angles", "pitch_roll"),
    "electrodes_config": ("electrodes config", "electrodes", "bank", "config"),
    "notes": ("notes", "comment", "comments"),
}

# Folder names that hold recordings without naming a session.
CONTAINER_FOLDERS = (
    "raw ephys data", "raw ephys", "ephys", "raw", "raw data", "data", "openephys", "open ephys",
    "recording", "recordings",
)


def norm_key(value: Column) -> Column:
    """Lower case, runs of other characters to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", " "))


def probe_key(value: Column) -> Column:
    """A probe's name without the word "probe", unless nothing else is left."""
    bare = F.trim(F.replace(norm_key(value), F.lit("probe"), F.lit("")))
    return F.when(bare != "", bare).otherwise(norm_key(value))


def parse_date(value: Column) -> Column:
    """``YYYY-MM-DD``, ``YYYY_MM_DD`` or ``M/D/YYYY``; anything else (two-digit years too) is null."""
    s = F.trim(value)
    iso = F.regexp_extract(s, r"^(\d{4})[_-](\d{2})[_-](\d{2})$", 0)
    slash = lambda g: F.regexp_extract(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", g)
    text = F.when(iso != "", F.regexp_replace(iso, "_", "-")).when(
        slash(0) != "", F.concat_ws("-", slash(3), F.lpad(slash(1), 2, "0"), F.lpad(slash(2), 2, "0")))
    return text.try_cast("date")


def normalise_dye(value: Column) -> Column:
    """Colour of a dye: text in parentheses first, then a known colour word, else the text itself."""
    s = F.lower(F.trim(value))
    inner = F.trim(F.regexp_extract(s, r"\(([^)]+)\)", 1))
    s = F.when(F.regexp_extract(s, r"\(([^)]+)\)", 0) != "", inner).otherwise(s)
    return (F.when(s.contains("far red") | s.contains("deep red"), "far red").when(s.contains("green"), "green")
            .when(s.contains("red"), "red").when(s.contains("blue"), "blue").otherwise(F.nullif(s, F.lit(""))))


def slug(value: Column) -> Column:
    """Each character other than letters, digits, dash and underscore becomes "_"; outer ones go."""
    kept = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9_-]", "_"), "^_+|_+$", "")
    return F.when(kept != "", kept).otherwise("probe")


def probe_label(stream: Column) -> Column:
    """Text after the last dot of a stream name, or the whole name."""
    tail = F.trim(F.substring_index(stream, ".", -1))
    return F.when(tail != "", tail).otherwise(stream)


def path_ids(path: Column) -> dict[str, Column]:
    """Subject, date and recording around the first dated folder; the session folder."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    dated = F.transform(parts, lambda p: p.rlike(r"^\d{4}[_-]\d{2}[_-]\d{2}$"))
    at = F.array_position(dated, F.lit(True))
    found = at > 0
    parent = F.regexp_replace(path, r"/[^/]+/?$", "")
    grand = F.regexp_replace(parent, r"/[^/]+/?$", "")
    is_container = norm_key(F.substring_index(parent, "/", -1)).isin(*CONTAINER_FOLDERS)
    return {
        "subject": F.when(found & (at > 1), F.get(parts, at - 2)),
        "session_date": F.when(found, F.regexp_replace(F.get(parts, at - 1), "_", "-")).try_cast("date"),
        "recording_label": F.when(found, F.get(parts, at)),
        "session_folder": F.when(is_container & (grand != ""), grand).otherwise(parent),
    }
