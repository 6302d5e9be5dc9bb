"""Spline warps, section matching, inherited planes and fragment merging."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelkeel.functions import geometry as G
from voxelkeel.operators.labels import field_warp_points
from voxelkeel.session import spread, unsized

# --- P16: thin-plate splines ---------------------------------------------------------------------


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r2 = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    return 0.5 * r2 * np.log(np.maximum(r2, 1e-300))


def _spline(src: np.ndarray, dst: np.ndarray):
    """Exact thin-plate map with a linear term, in centred and scaled coordinates.

    It is solved for the shifts about their mean, which keeps a plain shift exact.
    """
    shift, scale = src.mean(0), max(float(np.ptp(src, axis=0).max()), 1e-9)
    s = (src - shift) / scale
    poly = np.hstack([np.ones((len(s), 1)), s])
    left = np.block([[_kernel(s, s), poly], [poly.T, np.zeros((3, 3))]])
    moved = dst - src
    w = np.linalg.solve(left, np.vstack([moved - moved.mean(0), np.zeros((3, 2))]))
    return lambda p: p + (moved.mean(0) + np.hstack([_kernel((p - shift) / scale, s), np.ones((len(p), 1)), (p - shift) / scale]) @ w)


def _settle(forward, start: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point inverse, each point on its own; points that do not settle keep the start and say so."""
    y, moving = start.copy(), np.ones(len(start), dtype=bool)
    for _ in range(200):
        step = wanted[moving] - forward(y[moving])
        y[moving] += step
        moving[moving] = np.abs(step).max(axis=1) >= 1e-4
        if not moving.any():
            break
    lost = moving & ~(np.abs(wanted - forward(y)).max(axis=1) <= 0.01)
    y[lost] = start[lost]
    return y, ~lost


def tps_warp_points(points: DataFrame, landmarks: DataFrame, *, inverse: bool = False) -> DataFrame:
    """Points moved by their section's landmark spline (``inverse`` undoes it).

    ``landmarks`` has ``section, i, sx, sy, tx, ty, forward``; a section has a few dozen. They
    travel with the points as short arrays, so a section holding many points is spread over
    tasks, neighbouring ids together; within an Arrow batch the spline is solved once per section. Points of a section
    without landmarks stay where they are; ``settled`` is false where an inverse was not found
    and the start was kept.
    """
    packed = landmarks.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("i", "sx", "sy", "tx", "ty"))).alias("_l"), F.bool_or("forward").alias("_fwd"))
    joined = points.join(unsized(packed), "section", "left")
    still = joined.filter("_l IS NULL").select("pid", "section", F.col("x_px").cast("double").alias("x_warped"), F.col("y_px").cast("double").alias("y_warped"), F.lit(True).alias("settled"))
    rows = joined.filter("_l IS NOT NULL").select("pid", "section", "x_px", "y_px", "_fwd", F.col("_l.sx").alias("sx"), F.col("_l.sy").alias("sy"), F.col("_l.tx").alias("tx"), F.col("_l.ty").alias("ty"))
    rows = spread(rows.withColumn("_near", F.floor(F.col("pid") / 64)), "section", "_near").drop("_near")

    def move(batches):
        for pdf in batches:
            parts = []
            for section, g in pdf.groupby("section", sort=False):
                head = g.iloc[0]
                src = np.column_stack([head["sx"], head["sy"]]).astype(float)
                dst = np.column_stack([head["tx"], head["ty"]]).astype(float)
                p = g[["x_px", "y_px"]].to_numpy(float)
                there, back = (src, dst) if not inverse else (dst, src)
                settled = np.ones(len(p), dtype=bool)
                # The fitted direction is applied directly; the other is solved from it.
                if bool(head["_fwd"]) != inverse:
                    out = _spline(there, back)(p)
                else:
                    out, settled = _settle(_spline(back, there), _spline(there, back)(p), p)
                parts.append(pd.DataFrame({"pid": g["pid"], "section": section, "x_warped": out[:, 0], "y_warped": out[:, 1], "settled": settled}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return still.unionByName(rows.mapInPandas(move, "pid long, section long, x_warped double, y_warped double, settled boolean"))


def section_pixels_to_ccf(points: DataFrame, sections: DataFrame, *, landmarks: DataFrame | None = None, field: DataFrame | None = None,
                          step: float = 1.0, nx: int = 2, ny: int = 2) -> DataFrame:
    """Section pixels to (AP, ML, DV) um, undoing what was laid over the registration, last first.

    A section's landmark spline is undone where it has one, else its affine correction ``m0..m5`` where
    that is given; then ``field``, the inverse of the registration's warp, moves the point to the
    slice, and the plane places it. ``points`` has ``pid, section, x_px, y_px``, ``sections`` one row per
    section with ``reg_anchoring, out_w, out_h, resolution_um``; a section without a plane gives nulls.
    """
    names = [f"m{i}" for i in range(6)]
    for name in names:
        sections = sections if name in sections.columns else sections.withColumn(name, F.lit(None).cast("double"))
    df = points.select("pid", "section", "x_px", "y_px").withColumn("settled", F.lit(True))
    corrected = F.lit(False)
    if landmarks is not None:
        moved = tps_warp_points(points, landmarks, inverse=True)
        df = moved.select("pid", "section", F.col("x_warped").alias("x_px"), F.col("y_warped").alias("y_px"), "settled")
        sections = sections.join(unsized(landmarks.select("section").distinct().withColumn("_marked", F.lit(True))), "section", "left")
        corrected = F.coalesce("_marked", F.lit(False))
    df = df.join(unsized(sections.select("section", *names, corrected.alias("_corrected"))), "section", "left")
    x, y = G.affine_invert_apply([F.col(n) for n in names], F.col("x_px"), F.col("y_px"))
    undo = F.col("m0").isNotNull() & ~F.col("_corrected")
    df = df.withColumns({"_x": F.when(undo, x).otherwise(F.col("x_px")), "_y": F.when(undo, y).otherwise(F.col("y_px"))})
    df = df.select("pid", "section", "settled", F.col("_x").alias("x_px"), F.col("_y").alias("y_px"))
    if field is not None:
        df = field_warp_points(df, field, step=step, nx=nx, ny=ny, keep=("settled",)).withColumnsRenamed({"x_warped": "x_px", "y_warped": "y_px"})
    placed = df.withColumnsRenamed({"x_px": "x_local", "y_px": "y_local"}).join(unsized(sections.select("section", "reg_anchoring", "out_w", "out_h", "resolution_um")), "section", "left")
    return G.registered_pixel_to_ccf(placed).select("pid", "section", "ap_um", "ml_um", "dv_um", "settled")


# --- P21: planes inherited from a matched section ----------------------------------------------------


def orient_matches(matches: DataFrame, view: str) -> DataFrame:
    """Turn a match's 3x3 pixel map so the section shows ``view``; ``mirrored`` says it was flipped.

    Needs the map ``m0..m5`` (top two rows), ``was_mirrored``, ``w`` and the reference's
    plane and size.
    """
    def flip(cond: str, names: list[str], out: list[str], df: DataFrame) -> DataFrame:
        a, b, c, d, e, f = names
        vals = {out[0]: f"-{a}", out[1]: b, out[2]: f"{a} * (w - 1) + {c}", out[3]: f"-{d}", out[4]: e, out[5]: f"{d} * (w - 1) + {f}"}
        return df.withColumns({k: F.expr(f"CASE WHEN {cond} THEN {v} ELSE {n} END") for (k, v), n in zip(vals.items(), names)})

    m, n = [f"m{i}" for i in range(6)], [f"_n{i}" for i in range(6)]
    df = flip("was_mirrored", m, n, matches)
    ml = "element_at(reg_anchoring, 6) / out_w * _n0 + element_at(reg_anchoring, 9) / out_h * _n3"
    df = df.withColumn("mirrored", F.expr(f"CASE WHEN {ml} >= 0 THEN 'front' ELSE 'back' END <> '{view}'"))
    return flip("mirrored", n, m, df).drop(*n)


def inherit_registration(matches: DataFrame) -> DataFrame:
    """A section's plane from its counterpart's, through three mapped corners (``w, h`` box size)."""
    def corner(j: int, x: str, y: str) -> str:
        px, py = f"(m0 * {x} + m1 * {y} + m2)", f"(m3 * {x} + m4 * {y} + m5)"
        return f"reg_anchoring[{j}] + {px} / out_w * reg_anchoring[{j + 3}] + {py} / out_h * reg_anchoring[{j + 6}]"
    o = [corner(j, "0", "0") for j in range(3)]
    u = [f"({corner(j, 'w', '0')}) - ({o[j]})" for j in range(3)]
    v = [f"({corner(j, '0', 'h')}) - ({o[j]})" for j in range(3)]
    return matches.withColumn("inherited_anchoring", F.expr(f"array({', '.join([*o, *u, *v])})"))


def learn_pixel_size(matches: DataFrame) -> DataFrame:
    """Slide pixel size, the median over matches of map scale times the reference pixel (4 decimals)."""
    scale = F.expr("sqrt(abs(m0 * m4 - m1 * m3)) * reference_pixel_um")
    return matches.filter("reference_pixel_um IS NOT NULL").groupBy("project_id", "slide_idx").agg(F.round(F.median(scale), 4).alias("pixel_um"))


def copy_cells(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """The reference's cells on the matched sections, through the inverse map; others lose their pixel.

    Cells without a section match nothing and stay where they are: as a join key they would all meet in one task.
    """
    nowhere = cells.filter("section_index IS NULL").withColumns({"x_px": F.lit(None).cast("double"), "y_px": F.lit(None).cast("double")})
    j = cells.filter("section_index IS NOT NULL").join(matches.select("project_id", F.col("reference_section").alias("section_index"), F.col("section_index").alias("_to"), *[f"m{i}" for i in range(6)]), ["project_id", "section_index"], "left")
    ok = "_to IS NOT NULL AND x_px IS NOT NULL AND y_px IS NOT NULL"
    det = "(m0 * m4 - m1 * m3)"
    return j.withColumns({
        "section_index": F.expr(f"CASE WHEN {ok} THEN _to END"), "_x": F.expr(f"CASE WHEN {ok} THEN (m4 * (x_px - m2) - m1 * (y_px - m5)) / {det} END"),
        "_y": F.expr(f"CASE WHEN {ok} THEN (m0 * (y_px - m5) - m3 * (x_px - m2)) / {det} END")}).withColumns({"x_px": F.col("_x"), "y_px": F.col("_y")}).select(*cells.columns).unionByName(nowhere.select(*cells.columns))


# --- J08: pairing sections by outline ---------------------------------------------------------------


def outline_bitmaps(pixels: DataFrame, keys: list[str], *, width: int, height: int, turns=(0.0,), mirrors=(False,)) -> DataFrame:
    """Each outline as a bitmap of longs, per mirror and turn (nearest pixel, about the centre).

    The turned positions are a fixed table of the outline grid; a pixel joins it by position.
    """
    spark = pixels.sparkSession
    cx, cy = (width - 1) / 2.0, (height - 1) / 2.0
    grid = spark.range(width * height).select((F.col("id") % width).cast("int").alias("ox"), F.floor(F.col("id") / width).cast("int").alias("oy"), F.col("id").alias("bit"))
    combos = F.array(*[F.struct(F.lit(float(a)).alias("turn"), F.lit(m).alias("mirror")) for m in mirrors for a in turns])
    g = grid.withColumn("c", F.explode(combos)).select("ox", "oy", "bit", "c.turn", "c.mirror")
    g = g.withColumns({"_x": F.expr(f"{cx}D + cos(radians(turn)) * (ox - {cx}D) - sin(radians(turn)) * (oy - {cy}D)"), "_y": F.expr(f"{cy}D + sin(radians(turn)) * (ox - {cx}D) + cos(radians(turn)) * (oy - {cy}D)")})
    g = g.select("bit", "turn", "mirror", F.expr(f"CAST(CASE WHEN mirror THEN {width - 1} - rint(_x) ELSE rint(_x) END AS INT)").alias("x"), F.rint("_y").cast("int").alias("y"))
    # each outline in one partition: pixels are few bytes, but their turned copies are aggregated there
    hit = spread(pixels.select(*keys, "x", "y"), *keys).join(F.broadcast(g), ["x", "y"])
    words = hit.groupBy(*keys, "turn", "mirror", F.floor(F.col("bit") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("v"))
    n = (width * height + 63) // 64
    packed = words.groupBy(*keys, "turn", "mirror").agg(F.map_from_entries(F.collect_list(F.struct("word", "v"))).alias("_w"))
    return packed.select(*keys, "turn", "mirror", F.expr(f"transform(sequence(0L, {n - 1}L), i -> coalesce(element_at(_w, i), 0L))").alias("bits"))


def section_overlaps(targets: DataFrame, references: DataFrame) -> DataFrame:
    """Best outline overlap (IoU) of every target and reference section of a project pair.

    Both projects have some hundred sections, so the pairs are bounded; each costs a few
    bitwise words instead of its pixels. A section's orientations are one row, so a pair of sections is
    one row too and nothing is grouped behind the join. The first mirror and turn wins a tie.
    """
    turned = targets.groupBy("pair", "section").agg(F.array_sort(F.collect_list(F.struct("mirror", "turn", "bits"))).alias("_t"))
    refs = references.groupBy("pair", F.col("section").alias("reference")).agg(F.collect_list("bits").alias("_r"))
    j = turned.join(unsized(refs), "pair")
    count = lambda op: f"aggregate(zip_with(t.bits, r, (a, b) -> bit_count(a {op} b)), 0L, (s, x) -> s + x)"
    best = j.withColumn("_b", F.expr(f"""array_min(flatten(transform(_t, t -> transform(_r, r ->
        named_struct('o', -coalesce({count('&')} / nullif({count('|')}, 0), 0D), 'mirror', t.mirror, 'turn', t.turn)))))"""))
    return best.select("pair", "section", "reference", (-F.col("_b.o")).alias("overlap"), F.col("_b.mirror").alias("mirror"), F.col("_b.turn").alias("turn"))


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment by shortest augmenting paths (rows <= columns after a transpose)."""
    if cost.shape[0] > cost.shape[1]:
        return [(r, c) for c, r in _assign(cost.T)]
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        reach, prev, done, free = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool), -1
        i, base, j_from = row, 0.0, -1
        rows_seen = [(row, 0.0)]
        while free < 0:
            step = base + cost[i] - u[i] - v
            better = ~done & (step < reach)
            reach[better], prev[better] = step[better], j_from
            j_from = int(np.argmin(np.where(done, np.inf, reach)))
            base, done[j_from] = reach[j_from], True
            if owner[j_from] < 0:
                free = j_from
            else:
                i = int(owner[j_from])
                rows_seen.append((i, base))
        for r, at in rows_seen:
            u[r] += base - at
        v[done] += reach[done] - base
        while free >= 0:
            owner[free], free = (owner[prev[free]] if prev[free] >= 0 else row), int(prev[free])
    return sorted((int(r), j) for j, r in enumerate(owner) if r >= 0)


def match_sections(overlaps: DataFrame, *, min_overlap: float = 0.75) -> DataFrame:
    """One-to-one pairing of a project pair's sections with the largest total overlap; weak pairs dropped."""
    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = {c: pdf.pivot(index="section", columns="reference", values=c) for c in ("overlap", "mirror", "turn")}
        score, out = wide["overlap"].fillna(0.0).to_numpy(), []
        for i, j in _assign(-score):
            if score[i, j] >= min_overlap and not pd.isna(wide["turn"].iat[i, j]):
                others = np.delete(score[i], j)
                out.append((pdf["pair"].iloc[0], wide["turn"].index[i], wide["turn"].columns[j], score[i, j], others.max() if others.size else 0.0,
                            wide["mirror"].iat[i, j], wide["turn"].iat[i, j]))
        return pd.DataFrame(out, columns=["pair", "section", "reference", "overlap", "runner_up", "mirror", "turn"])

    rows = overlaps.select("pair", "section", "reference", "overlap", "mirror", "turn")
    return spread(rows, "pair").groupBy("pair").applyInPandas(
        pair, "pair long, section long, reference long, overlap double, runner_up double, mirror boolean, turn double")


# --- J17: fragments of one section --------------------------------------------------------------------


def merge_fragments(boxes: DataFrame, keys: list[str], *, x_overlap_frac: float = 0.5) -> DataFrame:
    """Boxes of a slide joined until no two overlap in x by ``x_overlap_frac`` of the narrower.

    Pieces stand in order of area. While some pair overlaps enough, the first such pair in that order is
    joined and the piece takes its place again; each join leaves one piece fewer, so it ends. The
    rule is a sequence over one slide's tens of boxes, a map over slides in Arrow batches; only a new piece is
    compared again, as pieces before the first pair overlap with none.
    """
    cols = [*keys, "piece", "x0", "y0", "x1", "y1", "area_px", "cx", "cy", "n_merged"]
    sides = ["area_px", "x0", "y0", "x1", "y1", "cx", "cy"]

    def overlap(a: list, b: list) -> bool:
        narrow = min(a[3] - a[1], b[3] - b[1])
        return narrow > 0 and max(min(a[3], b[3]) - max(a[1], b[1]), 0.0) >= x_overlap_frac * narrow

    def join(a: list, b: list) -> list:
        area = a[0] + b[0]
        centre = ((u * a[0] + v * b[0]) / area for u, v in zip(a[5:7], b[5:7]))
        return [area, min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), *centre, a[7] + b[7]]

    def merge(todo: list[list]) -> list[list]:
        # ``todo`` are pieces in order not yet compared with those behind them; ``done`` overlap with none behind them.
        done, at = [], 0
        while at < len(todo):
            piece = todo[at]
            other = next((j for j in range(at + 1, len(todo)) if overlap(piece, todo[j])), None)
            if other is None:
                done.append(piece)
                at += 1
                continue
            new, rest = join(piece, todo[other]), done + todo[at + 1 : other] + todo[other + 1 :]
            n_done = len(done)
            while True:
                place = bisect_left(rest, -new[0], key=lambda p: -p[0])
                other = next((j for j, p in enumerate(rest) if overlap(p, new)), None)
                if other is None:
                    break
                n_done -= other < n_done
                new = join(new, rest.pop(other)) if other >= place else join(rest.pop(other), new)
            rest.insert(place, new)
            done, todo, at = rest[: n_done + 1], rest[n_done + 1 :], 0
        return done

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                pieces = merge([[*map(float, box), 1] for box in zip(*row[len(keys):])])
                out += [(*row[: len(keys)], n, *map(int, p[1:5]), int(p[0]), *p[5:]) for n, p in enumerate(pieces)]
            yield pd.DataFrame(out, columns=cols)

    types = ", ".join(f"{c} {'double' if c in ('cx', 'cy') else 'long'}" for c in cols)
    slides = spread(boxes.select(*keys, "k", *sides), *keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("area_px").isNull(), -F.col("area_px"), "k", *sides))).alias("_b"))
    return slides.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in sides]).mapInPandas(run, types)
