"""Piecewise-linear interpolation against knots held as sorted arrays.

Knots (landmarks, track vertices, frequency grids) are few per key and are gathered once
per key, with a partial aggregate; the points stay where they are, so a key holding a large
share of the points needs no window over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def knot_arrays(points: DataFrame, keys: list[str], x: str, y: str, order: str | None = None,
                xs: str = "xs", ys: str = "ys") -> DataFrame:
    """One row per key: knots sorted by ``x`` (ties by ``order``) as two arrays."""
    parts = [F.col(x).alias("x")] + ([F.col(order).alias("o")] if order else []) + [F.col(y).alias("y")]
    packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("_k"))
    return packed.select(*keys, F.col("_k.x").alias(xs), F.col("_k.y").alias(ys))


def interp(df: DataFrame, out: str, q: Column | str, xs: str, ys: str, mode: str = "clamp") -> DataFrame:
    """Add ``out``, the value at ``q``. ``clamp`` holds the ends, ``null`` gives null outside, and
    ``extrapolate`` continues the end segments (slope 1 where their x coincide; one knot is a
    shift, no knot the identity).

    The position among the knots is found once per row, in its own projection.
    """
    if mode not in ("clamp", "null", "extrapolate"):
        raise ValueError(f"unknown mode {mode!r}; use clamp, null or extrapolate")
    df = df.withColumn("_q", q if isinstance(q, Column) else F.expr(q))
    df = df.withColumn("_at", F.expr(f"size(filter({xs}, x -> x <= _q))"))
    df = df.withColumn("_i", F.expr(f"greatest(1, least(size({xs}) - 1, _at))"))
    df = df.withColumn("_s", F.expr(
        f"named_struct('x0', get({xs}, _i - 1), 'x1', get({xs}, _i), 'y0', get({ys}, _i - 1), 'y1', get({ys}, _i))"))
    slope = "CASE WHEN _s.x1 = _s.x0 THEN 1D ELSE (_s.y1 - _s.y0) / (_s.x1 - _s.x0) END"
    line = f"CASE WHEN _at >= size({xs}) THEN _s.y1 + {slope} * (_q - _s.x1) ELSE _s.y0 + {slope} * (_q - _s.x0) END"
    value = {
        "extrapolate": f"CASE WHEN {xs} IS NULL OR size({xs}) = 0 THEN _q WHEN size({xs}) = 1 THEN _q + (_s.y0 - _s.x0) ELSE {line} END",
        "clamp": f"CASE WHEN _q <= {xs}[0] THEN {ys}[0] WHEN _at >= size({xs}) THEN get({ys}, size({xs}) - 1) ELSE {line} END",
        "null": f"CASE WHEN _q >= {xs}[0] AND _q <= get({xs}, size({xs}) - 1) THEN CASE WHEN size({xs}) = 1 THEN _s.y0 ELSE {line} END END",
    }[mode]
    return df.withColumn(out, F.expr(value)).drop("_q", "_at", "_i", "_s")
