"""Pixel and voxel tables: plane sampling, label maps, masks and displacement fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelkeel.operators.regions import spread_outside, voxel_key
from voxelkeel.session import cut_lineage, spread, unsized


def plane_pixels(sections: DataFrame) -> DataFrame:
    """One row per pixel of each section's plane grid (``out_w`` x ``out_h``)."""
    rows = sections.withColumn("y", F.explode(F.expr("sequence(0, out_h - 1)")))
    return rows.withColumn("x", F.explode(F.expr("sequence(0, out_w - 1)")))


def plane_voxels(pixels: DataFrame, anchoring: str = "anchoring", x: str = "x", y: str = "y") -> DataFrame:
    """Continuous voxel position (``v_ap, v_dv, v_ml``) of pixels on their plane."""
    at = lambda j: F.expr(f"{anchoring}[{j}] + {x} / out_w * {anchoring}[{j + 3}] + {y} / out_h * {anchoring}[{j + 6}]")
    return pixels.withColumns({"v_ap": at(0), "v_dv": at(1), "v_ml": at(2)})


def _inside(shape) -> str:
    return " AND ".join(f"{c} >= 0 AND {c} <= {n - 1}" for c, n in zip(("v_ap", "v_dv", "v_ml"), shape, strict=True))


def sample_labels(pixels: DataFrame, annotation: DataFrame, shape, out: str = "region_id") -> DataFrame:
    """J12, order 0: nearest voxel's label; outside [0, n-1] is 0.

    An equi left join on the packed voxel; the labelled voxels are unique.
    """
    near = [F.expr(f"CAST(floor({c} + 0.5D) AS BIGINT)") for c in ("v_ap", "v_dv", "v_ml")]
    grid = annotation.filter("structure_id > 0").select(
        voxel_key(F.col("i_ap"), F.col("i_dv"), F.col("i_ml")).alias("_vox"), F.col("structure_id").alias("_sid"))
    keyed = pixels.withColumn("_vox", spread_outside(F.when(F.expr(_inside(shape)), voxel_key(*near)), *map(F.col, ("v_ap", "v_dv", "v_ml"))))
    return keyed.join(grid, "_vox", "left").withColumn(out, F.coalesce("_sid", F.lit(0))).drop("_vox", "_sid")


def sample_intensity(pixels: DataFrame, volume: DataFrame, keys: list[str], shape, value: str = "value") -> DataFrame:
    """J12, order 1: trilinear value at each pixel; outside [0, n-1] is 0.

    The volume is turned into one row per cell with the values of its eight corners, so a pixel takes part
    in one equi join and no pixel is multiplied or grouped. A corner without a voxel counts as 0. Pixels outside never join.
    """
    corners = [(a, d, m) for a in (0, 1) for d in (0, 1) for m in (0, 1)]
    at = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((*c, i), "admi")]) for i, c in enumerate(corners)])).alias("c")
    cells = volume.select("i_ap", "i_dv", "i_ml", F.col(value).cast("double").alias("_v"), at).groupBy(
        (F.col("i_ap") - F.col("c.a")).alias("_a"), (F.col("i_dv") - F.col("c.d")).alias("_d"), (F.col("i_ml") - F.col("c.m")).alias("_m")).agg(
        *[F.coalesce(F.max(F.when(F.col("c.i") == i, F.col("_v"))), F.lit(0.0)).alias(f"_v{i}") for i in range(8)])
    cells = cells.filter("_a >= 0 AND _d >= 0 AND _m >= 0").withColumn("_vox", voxel_key(F.col("_a"), F.col("_d"), F.col("_m"))).drop("_a", "_d", "_m")
    axes = ("v_ap", "v_dv", "v_ml")
    low = [F.expr(f"CAST(floor({v}) AS BIGINT)") for v in axes]
    keyed = pixels.withColumn("_vox", spread_outside(F.when(F.expr(_inside(shape)), voxel_key(*low)), *map(F.col, axes)))
    part = lambda v, one: f"({v} - floor({v}))" if one else f"(1D - ({v} - floor({v})))"
    total = " + ".join(f"{' * '.join(part(v, one) for v, one in zip(axes, c))} * _v{i}" for i, c in enumerate(corners))
    joined = keyed.join(cells, "_vox", "left")
    return joined.withColumn("intensity", F.expr(f"coalesce({total}, 0D)")).drop("_vox", *[f"_v{i}" for i in range(8)])


def resize_nearest(sections: DataFrame) -> DataFrame:
    """J13 without a warp: section pixel to plane pixel by rounded even spacing (half to even)."""
    rows = sections.withColumn("sy", F.explode(F.expr("sequence(0, sec_h - 1)"))).withColumn("sx", F.explode(F.expr("sequence(0, sec_w - 1)")))
    even = lambda i, n_from, n_to: f"CAST(CASE WHEN {n_to} > 1 THEN rint({i} * ({n_from} - 1) / ({n_to} - 1)) ELSE 0 END AS INT)"
    return rows.withColumns({"x": F.expr(even("sx", "out_w", "sec_w")), "y": F.expr(even("sy", "out_h", "sec_h"))})


def field_warp_points(points: DataFrame, field: DataFrame, *, step: float, nx: int, ny: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Points moved by a displacement field sampled every ``step`` px: bilinear, held at the edges.

    A point is split into the four corners of its cell, which meet the field by position and are summed
    back, so the field is read as it is. Of corners that are missing the weight goes to the others;
    a point without any stays where it is. ``points`` has ``pid, section, x_px, y_px`` and the columns of ``keep``, which
    stay; rows that are alike come back as often as they came.
    """
    at = ["pid", "section", "x_px", "y_px", *keep]
    df = points.select(*at, F.expr(f"least(greatest(x_px / {step}D, 0D), {nx - 1}D)").alias("_fx"), F.expr(f"least(greatest(y_px / {step}D, 0D), {ny - 1}D)").alias("_fy"))
    df = df.withColumns({"_x0": F.expr(f"CAST(least(floor(_fx), {nx - 2}) AS INT)"), "_y0": F.expr(f"CAST(least(floor(_fy), {ny - 2}) AS INT)")})
    corner = lambda i, j: f"""named_struct('gx', _x0 + {i}, 'gy', _y0 + {j},
        'w', ({'_fx - _x0' if i else '1D - (_fx - _x0)'}) * ({'_fy - _y0' if j else '1D - (_fy - _y0)'}))"""
    corners = df.select(*at, F.expr(f"inline(array({', '.join(corner(i, j) for i in (0, 1) for j in (0, 1))}))"))
    met = corners.join(unsized(field.select("section", "gx", "gy", "dx", "dy")), ["section", "gx", "gy"], "left")
    total = met.groupBy(*at).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.expr("CASE WHEN dx IS NOT NULL THEN w END")).alias("_w"),
        F.sum(F.col("w") * F.col("dx")).alias("_dx"), F.sum(F.col("w") * F.col("dy")).alias("_dy"))
    total = total.withColumn("_again", F.explode(F.expr("array_repeat(0, CAST(_n / 4 AS INT))")))
    moved = lambda p, d: F.expr(f"CASE WHEN _w > 0 THEN {p} + {d} / _w ELSE {p} END AS {p[0]}_warped")
    return total.select("pid", "section", *keep, moved("x_px", "_dx"), moved("y_px", "_dy"))


def volume_field_to_ccf(points: DataFrame, field: DataFrame, shape) -> DataFrame:
    """Sample voxel (``v0, v1, v2``) to CCF by a field in mm: nearest (half to even), clamped;
    an all-zero entry is unmapped (null)."""
    idx = {f"_i{j}": F.expr(f"CAST(least(greatest(rint(v{j}), 0), {n - 1}) AS INT)") for j, n in enumerate(shape)}
    df = points.withColumns(idx).join(field.select(F.col("i").alias("_i0"), F.col("j").alias("_i1"), F.col("k").alias("_i2"), "d0", "d1", "d2"), ["_i0", "_i1", "_i2"], "left")
    ok = "NOT (d0 = 0 AND d1 = 0 AND d2 = 0)"
    return df.withColumns({"ap_um": F.expr(f"CASE WHEN {ok} THEN d0 * 1000D END"), "ml_um": F.expr(f"CASE WHEN {ok} THEN d2 * 1000D END"),
                           "dv_um": F.expr(f"CASE WHEN {ok} THEN d1 * 1000D END")}).drop("_i0", "_i1", "_i2", "d0", "d1", "d2")


def plausible_extent(dv_extent_um: str, *, expected_um: float = 8000.0, tolerance: float = 0.25) -> str:
    """SQL predicate for a believable DV extent of a sample volume."""
    return f"abs({dv_extent_um} / {expected_um}D - 1D) <= {tolerance}D"


def dorsal_surface(points: DataFrame, annotation: DataFrame, shape, *, resolution_um: float) -> DataFrame:
    """First labelled DV at an (AP, ML) column, else the least over the first square ring with any.

    The surface is one row per column of the atlas. Rings are looked up once per empty column that a
    point falls on, and grow, doubling, until every such column has met a labelled one or the
    whole atlas has been seen.
    """
    surface = cut_lineage(annotation.filter("structure_id > 0").groupBy("i_ap", "i_ml").agg(F.min("i_dv").alias("_s")))
    nearest = lambda c, n: f"CAST(least(greatest(rint({c} / {float(resolution_um)}D), 0), {n - 1}) AS INT)"
    df = points.withColumns({"i_ap": F.expr(nearest("ap_um", shape[0])), "i_ml": F.expr(nearest("ml_um", shape[2]))})
    direct = df.join(surface, ["i_ap", "i_ml"], "left")
    left = cut_lineage(direct.filter("_s IS NULL AND i_ap IS NOT NULL AND i_ml IS NOT NULL").select("i_ap", "i_ml").distinct())
    lines = surface.groupBy(F.col("i_ap").alias("ra")).agg(F.array_sort(F.collect_list(F.struct(F.col("i_ml").alias("m"), F.col("_s").alias("s")))).alias("_line"))
    found, inner, widest = [], 1, max(shape[0], shape[2]) - 1
    while inner <= widest and not left.isEmpty():
        outer = min(widest, max(8, 2 * inner))
        ring = "greatest(abs(ra - i_ap), abs(c.m - i_ml))"
        # a column meets whole lines of the atlas, and of a line the columns within the ring
        rows = left.withColumn("ra", F.explode(F.expr(f"sequence(greatest(i_ap - {outer}, 0), least(i_ap + {outer}, {shape[0] - 1}))"))).join(lines, "ra")
        near = F.expr(f"array_min(transform(filter(_line, c -> abs(c.m - i_ml) <= {outer}), c -> named_struct('r', {ring}, 's', c.s)))")
        met = cut_lineage(rows.withColumn("_b", near).filter("_b IS NOT NULL").groupBy("i_ap", "i_ml").agg(F.min("_b").alias("_b")))
        found.append(met)
        left = cut_lineage(left.join(met, ["i_ap", "i_ml"], "left_anti"))
        inner = outer + 1
    if found:
        near = found[0]
        for more in found[1:]:
            near = near.unionByName(more)
        direct = direct.join(near, ["i_ap", "i_ml"], "left").withColumn("_s", F.coalesce("_s", "_b.s")).drop("_b")
    return direct.withColumn("surface_dv_um", F.col("_s") * float(resolution_um)).drop("i_ap", "i_ml", "_s")


def region_area(labels: DataFrame, structures: DataFrame) -> DataFrame:
    """Pixels per section and region, named; label 0 left out."""
    area = labels.filter("region_id > 0").groupBy("section", "region_id").agg(F.count(F.lit(1)).alias("area_px"))
    return area.join(structures.select(F.col("id").alias("region_id"), "acronym", "name"), "region_id", "left")


def content_fingerprint(pixels: DataFrame, value: str) -> DataFrame:
    """Shape and pixel sum of each section's crop."""
    return pixels.groupBy("section").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sum(value).alias("pixel_sum"))


def reusable(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Whether a stored prediction still matches its crop."""
    s = stored.select("section", F.struct("height", "width", "pixel_sum").alias("_s"))
    c = current.select("section", F.struct("height", "width", "pixel_sum").alias("_c"))
    return c.join(s, "section", "left").select("section", F.coalesce(F.col("_c") == F.col("_s"), F.lit(False)).alias("reusable"))


def label_edges(labels: DataFrame) -> DataFrame:
    """Pixels whose label differs from one of the four neighbours; both sides count.

    A pixel that is not in the table is no neighbour, so gaps make no edges.
    """
    changed = None
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy("section", line).orderBy(along)
        for step in (F.lag, F.lead):
            beside = F.abs(step(along).over(w) - F.col(along)) == 1
            differs = F.coalesce(beside & (step("region_id").over(w) != F.col("region_id")), F.lit(False))
            changed = differs if changed is None else changed | differs
    return labels.withColumn("_e", changed).filter("_e").drop("_e")


def mutual_information(pixels: DataFrame, mask: str, *, bins: int = 32) -> DataFrame:
    """Mutual information of two intensities in [0, 1] over a mask, with the mask's pixel count.

    Under 100 pixels it is null: too few to tell from independent. Values outside [0, 1] fall out of the histogram. A section has at most bins^2 cells.
    """
    inside = pixels.filter(mask)
    n = pixels.groupBy("section").agg(F.count_if(F.expr(mask)).alias("_n"))
    cell = lambda c: F.expr(f"least(CAST(floor({c} * {bins}) AS INT), {bins - 1})")
    h = inside.filter("va BETWEEN 0 AND 1 AND vb BETWEEN 0 AND 1").groupBy("section", cell("va").alias("_a"), cell("vb").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    tot, row, col = (Window.partitionBy("section", *k) for k in ((), ("_a",), ("_b",)))
    h = h.withColumns({"_t": F.sum("_c").over(tot), "_ra": F.sum("_c").over(row), "_cb": F.sum("_c").over(col)})
    mi = h.groupBy("section").agg(F.sum(F.expr("_c / _t * ln(_c * _t / (_ra * _cb))")).alias("_m"))
    return n.join(unsized(mi), "section", "left").select(
        "section", F.col("_n").alias("n_pixels"), F.expr("CASE WHEN _n >= 100 THEN coalesce(_m, 0D) END AS mutual_information"))


def overlap_verdict(pixels: DataFrame, *, margin: float = 0.05) -> DataFrame:
    """Dice of the plane's and the morphed outline with the tissue; the plane wins by a margin."""
    n = lambda cond: f"count_if({cond})"
    dice = lambda m: F.expr(f"2D * {n(f'{m} AND tissue')} / greatest({n(m)} + {n('tissue')}, 1)")
    df = pixels.groupBy("section").agg(dice("plane_mask").alias("dice_plane"), dice("morph_mask").alias("dice_morph"), F.bool_or("plane_mask").alias("_any"))
    return df.withColumn("plane_better", F.expr(f"_any AND dice_plane > dice_morph + {margin}D")).drop("_any")


def moment_similarity(pixels: DataFrame, fixed: str, moving: str, *, isotropic: bool = False) -> DataFrame:
    """Scale and translation matching two masks' centroids and spreads; identity when tiny or flat."""
    aggs = []
    for tag, mask in (("f", fixed), ("m", moving)):
        for c in ("x", "y"):
            aggs += [F.avg(F.when(F.col(mask), F.col(c))).alias(f"_{tag}c{c}"), F.stddev_pop(F.when(F.col(mask), F.col(c))).alias(f"_{tag}s{c}")]
        aggs.append(F.count_if(F.col(mask)).alias(f"_{tag}n"))
    df = pixels.groupBy("section").agg(*aggs)
    df = df.withColumn("_ok", F.expr("_fn >= 8 AND _mn >= 8 AND least(_fsx, _fsy) >= 0.001D"))
    df = df.withColumns({"_sx": F.expr("_msx / _fsx"), "_sy": F.expr("_msy / _fsy")})
    if isotropic:
        df = df.withColumn("_s", F.expr("sqrt(greatest(_sx * _sy, 1e-9D))")).withColumns({"_sx": F.col("_s"), "_sy": F.col("_s")})
    return df.select("section", F.expr("CASE WHEN _ok THEN _sx ELSE 1D END AS scale_x"), F.expr("CASE WHEN _ok THEN _sy ELSE 1D END AS scale_y"),
                     F.expr("CASE WHEN _ok THEN _mcx - _sx * _fcx ELSE 0D END AS shift_x"), F.expr("CASE WHEN _ok THEN _mcy - _sy * _fcy ELSE 0D END AS shift_y"))


def midline_pca(pixels: DataFrame, mask: str) -> DataFrame:
    """Centroid and minor principal direction of a mask, pointing down (ten pixels at least).

    The 2 x 2 eigenvector in closed form from mergeable moments.
    """
    m = pixels.filter(mask).groupBy("section").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
        F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"), F.covar_pop("x", "y").alias("_xy")).filter("_n >= 10")
    m = m.withColumn("_small", F.expr("(_xx + _yy) / 2D - sqrt(power((_xx - _yy) / 2D, 2) + _xy * _xy)"))
    flat = "abs(_xy) < 1e-12D"
    m = m.withColumns({"_dx": F.expr(f"CASE WHEN {flat} THEN CASE WHEN _xx < _yy THEN 1D ELSE 0D END ELSE _small - _yy END"),
                       "_dy": F.expr(f"CASE WHEN {flat} THEN CASE WHEN _xx < _yy THEN 0D ELSE 1D END ELSE _xy END")})
    sign = "CASE WHEN _dy < 0 THEN -1D ELSE 1D END / sqrt(_dx * _dx + _dy * _dy)"
    m = m.withColumns({"dir_x": F.expr(f"_dx * {sign}"), "dir_y": F.expr(f"_dy * {sign}")})
    return m.select("section", "centroid_x", "centroid_y", "dir_x", "dir_y", F.expr("degrees(atan2(dir_x, dir_y)) AS angle_deg"))


def min_area_estimate(components: DataFrame, keys: list[str], *, bins: int = 256) -> DataFrame:
    """Noise-size cut per slide from its component sizes (Otsu on the largest fifth's log size).

    Components are first cut to the largest fifth, then counted into 256 bins per slide, so
    the threshold works on at most 256 rows a slide.
    """
    usable = components.filter("x1 > x0 AND y1 > y0")
    base = usable.groupBy(*keys).agg(F.max(F.expr("image_w * image_h")).alias("_img"), F.count(F.lit(1)).alias("_all"))
    kept = usable.filter("area_px <= 0.25D * image_w * image_h AND greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) < 3.5D")
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nk"))
    order = Window.partitionBy(*keys).orderBy(F.desc("area_px"), "k")
    top = kept.join(n, keys).withColumn("_r", F.row_number().over(order)).filter("_r <= greatest(2, CAST(floor(_nk / 5) AS BIGINT))")
    top = top.withColumn("_l", F.log10(F.col("area_px") + 1.0))
    rng = top.groupBy(*keys).agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi"), F.max("area_px").alias("_max"))
    hist = top.join(rng, keys).filter("_hi > _lo").withColumn("_b", F.expr(f"least(CAST(floor((_l - _lo) / (_hi - _lo) * {bins}) AS INT), {bins - 1})"))
    hist = hist.groupBy(*keys, "_lo", "_hi", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_v", F.expr(f"_lo + (_b + 0.5D) * (_hi - _lo) / {bins}"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*keys)
    hist = hist.withColumns({"_w1": F.sum("_c").over(w), "_m1": F.sum(F.expr("_c * _v")).over(w), "_wt": F.sum("_c").over(full), "_mt": F.sum(F.expr("_c * _v")).over(full)})
    var = F.expr("CASE WHEN _wt > _w1 THEN CAST(_w1 AS DOUBLE) * (_wt - _w1) * power(_m1 / _w1 - (_mt - _m1) / (_wt - _w1), 2) END")
    best = hist.withColumn("_q", var).filter("_q IS NOT NULL").groupBy(*keys).agg(F.min(F.struct((-F.round("_q", 9)).alias("q"), "_b", "_v")).alias("_t"))
    large = top.join(best, keys, "left").filter("_t IS NULL OR _l >= _t._v").groupBy(*keys).agg(F.max("area_px").alias("_big"))
    df = base.join(n, keys, "left").join(large, keys, "left").join(rng.select(*keys, "_max"), keys, "left")
    est = F.expr("""CASE WHEN coalesce(_nk, 0) < 2 THEN greatest(1000L, CAST(floor(0.001D * _img) AS BIGINT))
        ELSE greatest(greatest(1000L, CAST(floor(0.0005D * _img) AS BIGINT)), least(CAST(floor(coalesce(_big, _max) * 0.3D) AS BIGINT), CAST(floor(0.05D * _img) AS BIGINT))) END""")
    return df.select(*keys, est.alias("min_area_px"))


def cell_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells per type, types numbered by first appearance."""
    per = cells.groupBy(*keys, "cell_type").agg(F.count(F.lit(1)).alias("n_cells"), F.min("pos").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", "cell_type"))
    return per.withColumn("type_no", rank).drop("_first")


#: How far outside the section its four pinned corners lie, as a share of its size.
CORNER_MARGIN = 0.1


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three places in ``points``, counter-clockwise in a frame with y up) whose circumcircles hold no other point.

    The first four points are the corners of a rectangle around the others. Points are put in one after another:
    the triangles whose circumcircle holds the new point go, and their outline is joined to it. A point on top
    of another, or outside the rectangle, is left out.
    """
    tri = np.array([[0, 1, 2], [3, 2, 1]])
    side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    (left, top), (right, bottom) = points[:4].min(axis=0), points[:4].max(axis=0)
    turned = side(points[tri[:, 0]], points[tri[:, 1]], points[tri[:, 2]]) < 0
    tri[turned] = tri[turned][:, ::-1]
    for k in range(4, len(points)):
        p = points[k]
        used = np.unique(tri)
        if not (left < p[0] < right and top < p[1] < bottom) or (np.abs(points[used] - p).max(axis=1) < 1e-9).any():
            continue
        d = points[tri] - p
        square = (d * d).sum(axis=2)
        inside = square[:, 0] * (d[:, 1, 0] * d[:, 2, 1] - d[:, 1, 1] * d[:, 2, 0]) - square[:, 1] * (d[:, 0, 0] * d[:, 2, 1] - d[:, 0, 1] * d[:, 2, 0]) + square[:, 2] * (d[:, 0, 0] * d[:, 1, 1] - d[:, 0, 1] * d[:, 1, 0])
        gone = inside > 1e-9 * np.abs(square).max(axis=1) ** 2
        # the triangle that holds the point always goes, however the rounding falls
        holds = np.min([side(points[tri[:, i]], points[tri[:, (i + 1) % 3]], p) for i in range(3)], axis=0)
        gone[np.argmax(holds)] = True
        edges = np.concatenate([tri[gone][:, [i, (i + 1) % 3]] for i in range(3)])
        inner = {(a, b) for a, b in edges.tolist()}
        outline = np.array([(a, b) for a, b in edges.tolist() if (b, a) not in inner])
        outline = outline[side(points[outline[:, 0]], points[outline[:, 1]], p) > 0]
        tri = np.concatenate([tri[~gone], np.column_stack([outline, np.full(len(outline), k)])])
    return tri


def marker_triangles(sections: DataFrame, margin: float = CORNER_MARGIN) -> DataFrame:
    """Triangles over each section's moved markers and four pinned corners, as :func:`warp_triangles` takes them.

    ``sections`` has section, width, height and markers (arrays of x, y, moved x, moved y; null: none). The
    triangulation is over the moved positions; ``p`` are a triangle's corners before, ``q`` after. A section's few dozen
    markers are a row, so this is a map over rows, spread over all partitions.
    """
    def run(batches):
        for pdf in batches:
            out = []
            for section, width, height, markers in pdf[["section", "width", "height", "markers"]].itertuples(index=False):
                x, y = margin * width, margin * height
                pinned = np.array([[-x, -y], [width + x, -y], [-x, height + y], [width + x, height + y]])
                given = np.array([m[:4] for m in markers], float).reshape(-1, 4) if markers is not None else np.zeros((0, 4))
                before, moved = np.vstack([pinned, given[:, :2]]), np.vstack([pinned, given[:, 2:]])
                out += [(section, n, *before[t].ravel(), *moved[t].ravel()) for n, t in enumerate(delaunay(moved))]
            yield pd.DataFrame(out, columns=["section", "tri", *corners])

    corners = [f"{c}{n}{a}" for c in "pq" for n in (1, 2, 3) for a in "xy"]
    kind = sections.schema["section"].dataType.simpleString()
    rows = sections.select("section", F.col("width").cast("double"), F.col("height").cast("double"), F.col("markers").cast("array<array<double>>"))
    return spread(rows, "section").mapInPandas(run, f"section {kind}, tri int, " + ", ".join(f"{c} double" for c in corners))


def warp_triangles(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Points moved by their section's triangles; the first triangle holding a point wins.

    Points outside every triangle stay. A section has a few dozen triangles, held as one array
    on its row: ``section, tri``, corners ``p1x .. p3y`` and where they move, ``q1x .. q3y``
    (swap the two sets for the inverse).
    """
    corners = [f"{c}{n}{a}" for c in "pq" for n in (1, 2, 3) for a in "xy"]
    packed = triangles.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("tri", *corners))).alias("_t"))
    det = "((t.p2x - t.p1x) * (t.p3y - t.p1y) - (t.p3x - t.p1x) * (t.p2y - t.p1y))"
    u = f"((x_px - t.p1x) * (t.p3y - t.p1y) - (t.p3x - t.p1x) * (y_px - t.p1y)) / {det}"
    v = f"((t.p2x - t.p1x) * (y_px - t.p1y) - (x_px - t.p1x) * (t.p2y - t.p1y)) / {det}"
    df = points.join(unsized(packed), "section", "left").withColumn("_h", F.expr(
        f"get(filter(transform(filter(_t, t -> abs{det} >= 1e-12D), t -> named_struct('t', t, 'u', {u}, 'v', {v})), h -> h.u >= 0 AND h.v >= 0 AND h.u + h.v <= 1), 0)"))
    out = {f"{a}_warped": F.expr(f"coalesce(_h.t.q1{a} + (_h.t.q2{a} - _h.t.q1{a}) * _h.u + (_h.t.q3{a} - _h.t.q1{a}) * _h.v, {a}_px)") for a in "xy"}
    return df.withColumns(out).drop("_t", "_h")
