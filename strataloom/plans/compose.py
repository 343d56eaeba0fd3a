"""From labelled masks to targets: measure, group, choose z, and give points, grids or regions."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import SCALE, Affine, ImageScales, Tile, finite_or_zero, scaled, slice_bounds
from ..operators import grouped, joins, objects, raster, regions
from ..operators.components import single_linkage
from ..operators.scratch import cut
from . import modes, preview, tables


@dataclass(frozen=True)
class Planning:
    output: str = "polygon_regions"
    grouping: str = "xy_z"
    z: str = "per_roi"
    optimisation: str = "tile_count"
    merge_factor: float = 1.0
    max_z: float = 10.0
    max_extra: float = 0.10
    min_area: int = 1
    classes: tuple[int, ...] = (1, 2)
    prefix: str = "Planned"
    boundary: str = "alpha_shape"
    simplify_um: float = 10.0
    alpha_fraction: float = 0.75

    def __post_init__(self):
        if self.boundary not in ("alpha_shape", "mask_contour", "hull"):
            raise ValueError(f"unknown boundary {self.boundary!r}")
        if min(self.merge_factor, self.max_z, self.simplify_um, self.alpha_fraction) < 0:
            raise ValueError("distances must not be negative")
        if not 0 <= self.max_extra <= 1:
            raise ValueError("the share of free tiles must lie in [0, 1]")
        if self.min_area < 1:
            raise ValueError("objects have one pixel at least")

    @property
    def mode(self) -> modes.Mode:
        return modes.Mode(self.output, self.grouping, self.z, self.optimisation)


def measured_components(labels: DataFrame, classes: DataFrame, tr: Affine | ImageScales, p: Planning, z0: float, z_step: float) -> DataFrame:
    """Components (image_id, id, px, x, y, min_x.., z) in stage units; z from the modal plane of in-class pixels."""
    o = objects.measure(labels).where(F.col("area") >= p.min_area)
    inside = labels.select("image_id", "y", "x", "label").join(classes.select("image_id", "y", "x", "argmax_z", "cls"), ["image_id", "y", "x"])
    z = objects.modal_z(inside, ["image_id", "label"], p.classes)
    o, tr, z0, z_step = scaled(o, tr, z0, z_step)
    x, y = tr.apply(F.col("centroid_x"), F.col("centroid_y"))
    box = slice_bounds(tr, F.col("min_x"), F.col("max_x"), F.col("min_y"), F.col("max_y"))
    um = z0 if p.z == "overview" else F.coalesce(F.col("z") * z_step + z0, z0)
    return o.join(z, ["image_id", "label"], "left").select("image_id", F.col("label").alias("id"), "area", x.alias("x"), y.alias("y"), *[c.alias(n) for n, c in box.items()], um.alias("z"))


def pixel_rows(labels: DataFrame, tr: Affine | ImageScales) -> DataFrame:
    """(image_id, id, cells): the stage boxes of each component's runs of pixels, row by row, at pixel centres."""
    w = Window.partitionBy("image_id", "label", "y").orderBy("x")
    runs = labels.withColumn("_k", F.col("x") - F.row_number().over(w)).groupBy("image_id", "label", "y", "_k").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs, tr, *_ = scaled(runs, tr, 0.0, 0.0)
    (ax, ay), (bx, by) = tr.apply(F.col("x0"), F.col("y")), tr.apply(F.col("x1"), F.col("y"))
    box = F.array(F.least(ax, bx), F.greatest(ax, bx), F.least(ay, by), F.greatest(ay, by))
    return runs.groupBy("image_id", F.col("label").alias("id")).agg(F.collect_list(box).alias("cells"))


def group_components(c: DataFrame, tile: Tile, p: Planning, cells: DataFrame | None = None) -> DataFrame:
    """Components with ``group_id``: alone, linked in XY, linked in XY under a z limit, then merged by the tiles of
    the plan's output. ``cells`` (image_id, id, cells) are the components' pixels for that."""
    gap_x, gap_y = tile.width * p.merge_factor, tile.height * p.merge_factor
    if p.grouping == "none":
        return c.withColumn("group_id", F.col("id"))
    if p.grouping == "xy":
        g = single_linkage(c, joins.box_gap_pairs(c, gap_x, gap_y))
    else:
        g = c.join(grouped.z_constrained_groups(c.select("image_id", "id", "min_x", "max_x", "min_y", "max_y", "z"), gap_x, gap_y, p.max_z), ["image_id", "id"])
    if p.optimisation == "tile_count":  # linked groups are the pools inside which components merge as tiles are saved
        m = g.select("image_id", F.col("group_id").alias("pool"), "id", "min_x", "max_x", "min_y", "max_y", "z")
        m = m if cells is None else m.join(cells, ["image_id", "id"], "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<array<double>>")))
        m = grouped.greedy_merge(m, tile, p.max_extra, p.max_z if p.grouping == "xy_z" else None, p.merge_factor, p.output)
        g = g.drop("group_id").join(m.select("image_id", "id", "group_id"), ["image_id", "id"])
    return g


def covered_pixels(pixels: DataFrame, tiles: DataFrame, tr: Affine | ImageScales, tile: Tile) -> DataFrame:
    """Pixels in the pixel windows of tiles (id, ordinal, center_x, center_y) of their image, given in stage units,
    under a transform without rotation."""
    tiles, tr, *_ = scaled(tiles, tr, 0.0, 0.0)
    x, y = tr.invert(F.col("center_x"), F.col("center_y"))
    size = [(F.lit(n) / F.abs(F.lit(k))).alias(f"_{c}") for n, k, c in ((tile.width, tr.a, "w"), (tile.height, tr.d, "h"))]
    in_px = tiles.select(*joins.images(tiles), "id", "ordinal", x.alias("center_x"), y.alias("center_y"), *size)
    return regions.tile_coverage(pixels, in_px, regions.Extent(F.col("_w"), F.col("_h")))


def with_region_z(found: DataFrame, tiles: DataFrame, classes: DataFrame, tr: Affine | ImageScales, tile: Tile, p: Planning, z0: float, z_step: float) -> DataFrame:
    """Regions (id, z, ...) with z from the modal plane of all in-class pixels of their image under their tiles,
    detected or not; a region without any keeps its z."""
    image = joins.images(found, tiles, classes)
    key = [*image, "id"]
    inside = classes.where(F.col("cls").isin(*p.classes)).select(*image, "y", "x", "argmax_z")
    seen = covered_pixels(inside, tiles if image else tiles.drop("image_id"), tr, tile).select(*key, "y", "x", "argmax_z").distinct()
    z = objects.modal_z(seen, key).withColumnRenamed("z", "plane")
    return with_plane_z(found.join(z, key, "left"), tr, z0, z_step)


def with_plane_z(found: DataFrame, tr: Affine | ImageScales, z0: float, z_step: float) -> DataFrame:
    """``found`` with z from its ``plane``, where it has one."""
    found, _, z0, z_step = scaled(found, tr, z0, z_step)
    return found.withColumn("z", F.coalesce(F.col("plane") * z_step + z0, F.col("z"))).drop("plane", *SCALE)


def plan_targets(labels: DataFrame, classes: DataFrame, tr: Affine | ImageScales, tile: Tile, p: Planning, z0: float = 100.0, z_step: float = 5.0, final_z: bool = True) -> DataFrame:
    """The target table of labelled masks under a planning mode, with ``image_id``: each image has a plan of its
    own, under one transform and z scale or, with ``ImageScales``, its own. Without ``final_z`` regions keep the z of their groups, as in a review."""
    p.mode  # noqa: B018  refuses choices that don't go together
    at = ["image_id", "id"]
    # objects and groups are few beside the pixels that they come from, and are read many times below
    c = cut(measured_components(labels, classes, tr, p, z0, z_step))
    if p.output == "detection_points":
        return _named(c.select(F.lit("point").alias("kind"), *at, "x", "y", "z"), p)
    g = cut(group_components(c, tile, p, pixel_rows(labels, tr) if p.optimisation == "tile_count" and p.grouping != "none" else None))
    by = g.groupBy("image_id", F.col("group_id").alias("id"))
    box = by.agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), F.median("z").alias("z"))
    if p.output == "group_center_points":
        return _named(box.select(F.lit("point").alias("kind"), *at, ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y"), "z"), p)
    # grids and rectangles cover the box of centroids
    dots = by.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.median("z").alias("z"))
    mine = g.select("image_id", F.col("id").alias("label"), "group_id")
    if p.output == "tile_point_grid":
        t = regions.tile_lattice(box if p.z == "per_tile" else dots, tile).join(dots.select(*at, "z"), at)
        if p.z == "per_tile":  # only tiles with pixels of the group, each at its own modal plane
            px = labels.join(mine, ["image_id", "label"]).select("image_id", "y", "x", "group_id", "argmax_z", "cls")
            cover = covered_pixels(px, t, tr, tile).where(F.col("id") == F.col("group_id"))
            z = objects.modal_z(cover, [*at, "ordinal"], p.classes).withColumnRenamed("z", "plane")
            t = with_plane_z(t.join(cover.select(*at, "ordinal").distinct(), [*at, "ordinal"]).join(z, [*at, "ordinal"], "left"), tr, z0, z_step)
        return _named(t.select(F.lit("point").alias("kind"), *at, "ordinal", F.col("center_x").alias("x"), F.col("center_y").alias("y"), "z"), p)
    if p.output == "rectangular_regions":
        r = regions.rectangles_over(dots, tile).join(dots.select(*at, "z"), at)
        if p.z == "per_roi" and final_z:
            grid = r.select(*at, *[(F.col(f"center_{c}") + k * F.col(n) / 2).alias(f"{m}_{c}") for c, n in (("x", "width"), ("y", "height")) for m, k in (("min", -1), ("max", 1))])
            r = with_region_z(r, regions.tile_lattice(grid, tile), classes, tr, tile, p, z0, z_step)
        return _named(r.select(F.lit("rectangle").alias("kind"), *at, F.col("center_x").alias("x"), F.col("center_y").alias("y"), "z", "width", "height"), p)
    px = labels.join(mine, ["image_id", "label"]).select("image_id", F.col("group_id").alias("label"), "y", "x")
    px, t, *_ = scaled(px, tr, z0, z_step)
    um = F.greatest(F.hypot(F.lit(t.a), F.lit(t.c)), F.hypot(F.lit(t.b), F.lit(t.d)))  # of a pixel
    h = grouped.region_polygons(px.withColumn("um", um).drop(*SCALE), p.boundary, p.simplify_um, min(tile.width, tile.height) * p.alpha_fraction)
    h, t, *_ = scaled(h, tr, z0, z_step)
    sx, sy = t.apply(F.col("x"), F.col("y"))
    # a group may give several polygons, each a region with a z of its own
    v = h.select("image_id", F.struct(F.col("label").alias("g"), "part").alias("id"), "k", sx.alias("x"), sy.alias("y"))
    rings = v.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("v")).withColumn("g", F.col("id.g"))
    rings = rings.join(box.select("image_id", F.col("id").alias("g"), "z"), ["image_id", "g"]).drop("g")
    if p.z == "per_roi" and final_z:
        outer = v.groupBy(*at).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
        tiles = regions.tiles_touching(regions.tile_lattice(outer, tile), v, tile)
        rings = with_region_z(rings, tiles, classes, tr, tile, p, z0, z_step)
    return _named(rings.select(F.lit("polygon").alias("kind"), *at, "z", F.transform("v", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("vertices")), p)


def _named(t: DataFrame, p: Planning) -> DataFrame:
    """Targets numbered and named in their image and kind."""
    order = ["id", "ordinal"] if "ordinal" in t.columns else ["id"]
    n = F.row_number().over(Window.partitionBy("image_id", "kind").orderBy(*order)).cast("long")
    t = t.withColumn("_n", n).withColumn("ordinal", F.col("_n")).withColumn("name", F.concat(F.lit(p.prefix + " "), F.col("_n").cast("string"))).drop("_n", "id")
    empty = t.sparkSession.createDataFrame([], tables.SCHEMA).withColumn("image_id", F.lit(None).cast(dict(t.dtypes)["image_id"]))
    return empty.unionByName(t, allowMissingColumns=True).select("image_id", *tables.COLUMNS)


def review_plan(labels: DataFrame, kept: DataFrame, classes: DataFrame, tr: Affine | ImageScales, tile: Tile, p: Planning, z0: float = 100.0, z_step: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """A plan for the objects (image_id, label) that a review keeps, without the regions' final z, and its summary,
    one row: targets, tiles and groups, zeros without objects. A mode that needs z refuses classes without it."""
    if p.mode.needs_z and "argmax_z" not in classes.columns:
        raise ValueError("this planning mode needs the plane of each pixel")
    mine = labels.join(kept.select("image_id", "label"), ["image_id", "label"], "left_semi")
    plan = plan_targets(mine, classes, tr, tile, p, z0, z_step, final_z=False)
    # without optimisation points and regions stand for groups; polygons may be several of one
    c = cut(measured_components(mine, classes, tr, p, z0, z_step))
    groups = c if p.output == "detection_points" else group_components(c, tile, p, pixel_rows(mine, tr) if p.optimisation == "tile_count" and p.grouping != "none" else None)
    n_groups = groups.select("image_id", F.col("id" if p.output == "detection_points" else "group_id").alias("g")).distinct().agg(F.count(F.lit(1)).alias("groups"))
    n = preview.totals(plan, tile).agg(F.coalesce(F.sum("targets"), F.lit(0)).alias("targets"), F.coalesce(F.sum("tiles"), F.lit(0)).alias("tiles"))
    return plan, n.crossJoin(n_groups)  # one row by one row


def compact_review(labels: DataFrame, scored: DataFrame, n: int, classes: DataFrame, tr: Affine, tile: Tile, p: Planning, seeds: int = 24) -> DataFrame:
    """(image_id, label) of n of one image's objects (image_id, label, x, y, score) that take few tiles: selections are
    grown from the ``seeds`` best, each is planned in full as if it were an image of its own, and the fewest tiles
    win, then the greater score, then the earlier seed. All selections are planned in one job. Several images at once are
    an error, as selections take their place."""
    if len(scored.select("image_id").distinct().limit(2).collect()) > 1:
        raise ValueError("a compact review has one image")
    grown = cut(grouped.grown_selections(scored.select(F.col("label").alias("id"), "x", "y", "score"), n, tile, seeds))
    pick = grown.select(F.col("seed").alias("image_id"), F.col("id").alias("label"))
    many = labels.drop("image_id").join(pick, "label")
    px = classes.drop("image_id").crossJoin(F.broadcast(pick.select("image_id").distinct()))  # at most ``seeds`` rows by the pixels
    plan = plan_targets(many.select(*["image_id", "label"], *[c for c in labels.columns if c not in ("image_id", "label")]), px, tr, tile, p, final_z=False)
    tiles = preview.tiles(plan, tile).groupBy("image_id").agg(F.count(F.lit(1)).alias("tiles"))
    total = grown.join(scored.select(F.col("label").alias("id"), "score"), "id").groupBy("seed").agg(F.sum(finite_or_zero(F.col("score"))).alias("total"), F.min("rank").alias("rank"))
    best = total.join(tiles.withColumnRenamed("image_id", "seed"), "seed").agg(F.min(F.struct("tiles", (-F.col("total")).alias("t"), "rank", "seed"))["seed"].alias("_best"))
    chosen = grown.join(F.broadcast(best), F.col("seed") == F.col("_best")).select(F.col("id").alias("label"))
    return scored.join(chosen, "label", "left_semi").select("image_id", "label")


def review(objs: DataFrame, limits: objects.Limits, deleted: DataFrame | None = None, count: int = 0, rule: str = "confidence", accepted: bool = True) -> DataFrame:
    """A review without its screen: filter, leave out deleted labels, apply the count rule. A review that is
    not accepted raises."""
    if not accepted:
        raise RuntimeError("the review was closed without being accepted")
    kept = objects.filter_objects(objs, limits, deleted)
    return kept if count <= 0 else objects.top(kept, count, rule)


def fit_mixture(centres: np.ndarray, counts: np.ndarray, floor: float, upper: float, seed_mean: float) -> tuple[float, float, float, float, float]:
    """Poisson background and Gaussian signal (area, lambda, area, mean, sigma) of a smoothed histogram, by
    damped least squares inside bounds; the seeds where the fit does not improve on them."""
    width = centres[1] - centres[0]
    span, total = upper - floor, counts.sum()
    low = centres <= floor + 0.35 * span
    lam = max((counts[low] * (centres[low] - floor)).sum() / max(counts[low].sum(), 1), width / 2)
    x = np.asarray([0.7 * total, lam, 0.3 * total / (2.5 * max(span / 12, width)), np.clip(seed_mean, floor + 0.15 * span, upper - width / 2), max(span / 12, width)])
    lo = np.asarray([0, width / 10, 0, floor + 0.15 * span, width / 2])
    hi = np.asarray([np.inf, max(span / 2, width), np.inf, upper - width / 2, max(span, width)])
    s = np.maximum(centres - floor, 0)
    lg = np.asarray([lgamma(v + 1) for v in s])

    def residual(q):
        return (q[0] * np.exp(s * np.log(q[1]) - q[1] - lg) + q[2] * np.exp(-0.5 * ((centres - q[3]) / q[4]) ** 2) - counts) / np.sqrt(counts + 1)

    best, damp, r = x, 1e-2, residual(x)
    for _ in range(300):
        step = np.maximum(np.abs(best) * 1e-6, 1e-9)
        j = np.stack([(residual(best + np.eye(5)[k] * step[k]) - r) / step[k] for k in range(5)], 1)
        a = j.T @ j
        d = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -j.T @ r, rcond=None)[0]
        new = np.clip(best + d, lo, hi)
        rn = residual(new)
        if rn @ rn < r @ r:
            done = r @ r - rn @ rn < 1e-10 * (r @ r)
            best, r, damp = new, rn, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return tuple(float(v) for v in best)


def _smoothed(counts: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    """Counts under a Gaussian with reflected edges."""
    w = raster.gaussian_weights(sigma)
    r = len(w) - 1
    return np.convolve(np.pad(counts.astype(float), r, mode="symmetric"), np.asarray(w[:0:-1] + w), "valid")


def _background(x: np.ndarray, floor: float, a: float, lam: float) -> np.ndarray:
    s = np.maximum(x - floor, 0)
    return a * np.exp(s * np.log(lam) - lam - np.asarray([lgamma(v + 1) for v in s]))


def _first_fit(counts: np.ndarray, floor: float, upper: float, seed: float) -> dict:
    """The fit of a histogram over [floor, upper]: its threshold and the parameters of background and signal."""
    n = len(counts)
    centres, smooth = floor + (np.arange(n) + 0.5) * (upper - floor) / n, _smoothed(counts)
    a, lam, b, mean, sigma = fit_mixture(centres, smooth, floor, upper, seed)
    background, bell = _background(centres, floor, a, lam), b * np.exp(-0.5 * ((centres - mean) / sigma) ** 2)
    likely = (centres > floor) & (centres < mean) & (bell >= 0.5 * (bell + background))
    threshold = float(centres[likely][0]) if likely.any() else floor
    threshold = min(threshold, upper - (centres[1] - centres[0]))
    return {"floor": floor, "upper": upper, "threshold": threshold, "parameters": (a, lam, b, mean, sigma), "centres": centres, "counts": counts, "smoothed": smooth, "background": background, "bell": bell}


def _second_fit(counts: np.ndarray, fit: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres and signal of the histogram from the threshold on, and the signal's peak, sought within half a deviation
    below and two above its mean."""
    n, low, upper = len(counts), fit["threshold"], fit["upper"]
    found = low + (np.arange(n) + 0.5) * (upper - low) / n
    a, lam, _, mean, sigma = fit["parameters"]
    width = (upper - low) / n / ((upper - fit["floor"]) / fit["bins"])  # the fit counts by its own bins
    signal = np.maximum(_smoothed(counts) - _background(found, fit["floor"], a, lam) * width, 0)
    near = (found >= mean - 0.5 * max(sigma, 1)) & (found <= mean + 2 * max(sigma, 1))
    sought = np.where(near, signal, -1)
    return found, signal, float(found[sought.argmax()]) if sought.max() > 0 else mean


def image_levels(pixels: DataFrame, bins: int = 500) -> DataFrame:
    """One row for each image with a valid pixel: image_id, floor, upper, seed (the 90th percentile), n1 and n2 (bins of the
    two histograms), threshold, peak, parameters (array), and counts1 and counts2 (arrays of at most ``bins``).

    Bins are one for each whole number of the range where an image's first ten thousand valid values, by row and
    column, are whole, and ``bins`` at most, 8 at least. All images are counted and fitted together: the number of
    jobs does not grow with them. A flat image, and one whose peak is not above its floor, raises."""
    ok = cut(pixels.where(raster.valid(F.col("v"))).select("image_id", "y", "x", F.col("v").cast("double").alias("v")))
    first = ok.withColumn("_r", F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x"))).where("_r <= 10000")
    whole = first.groupBy("image_id").agg(F.max(F.abs(F.col("v") - F.round("v"))).alias("off"))
    ends = ok.groupBy("image_id").agg(F.min("v").alias("floor"), F.max("v").alias("top"))
    level = raster.percentiles(ok, {"high": 0.998, "seed": 0.9}).join(ends, "image_id").join(whole, "image_id")
    upper = F.when(F.col("high") > F.col("floor"), F.col("high")).otherwise(F.col("top"))
    level = level.select("image_id", "floor", upper.alias("upper"), "seed", (F.col("off") < 1e-6).alias("whole"))
    most = max(8, bins)
    count = lambda lo, hi, least: F.greatest(F.lit(least), F.when(F.col("whole"), F.least(F.lit(most), F.greatest(F.lit(8), F.ceil(F.greatest(hi - lo, F.lit(2.220446049250313e-16))).cast("int")))).otherwise(most))
    level = cut(level.withColumn("n1", count(F.col("floor"), F.col("upper"), 32)))
    kind = dict(pixels.dtypes)["image_id"]

    def counted(levels: DataFrame, lo: str, n: str) -> DataFrame:
        """Counts by bin as an array of n values for each image."""
        j = ok.join(levels.select("image_id", F.col(lo).alias("_lo"), F.col("upper").alias("_hi"), F.col(n).alias("_n")), "image_id").where(F.col("v").between(F.col("_lo"), F.col("_hi")))
        span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)  # a flat image raises when it is fitted
        b = F.least(F.floor((F.col("v") - F.col("_lo")) / (span / F.col("_n"))), F.col("_n") - 1).cast("int")
        by = j.groupBy("image_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("c")).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_m"))
        full = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long")))
        return levels.join(by, "image_id", "left").withColumn(f"counts{n[1]}", F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0).cast("long"), F.col(n))).otherwise(full)).drop("_m")

    def fit_first(frames):
        for df in frames:
            got = []
            for f, u, s, c in zip(df["floor"], df["upper"], df["seed"], df["counts1"], strict=True):
                if u <= f:
                    raise ValueError("the image is flat")
                x = _first_fit(np.asarray(c), f, u, s)
                got.append((x["threshold"], list(x["parameters"])))
            yield df.assign(threshold=[t for t, _ in got], parameters=[p for _, p in got])

    def fit_second(frames):
        for df in frames:
            peaks = []
            for f, u, t, p, n, c in zip(df["floor"], df["upper"], df["threshold"], df["parameters"], df["n1"], df["counts2"], strict=True):
                *_, peak = _second_fit(np.asarray(c), {"floor": f, "upper": u, "threshold": t, "parameters": tuple(p), "bins": n})
                if peak <= f:
                    raise ValueError("the signal peak is not above the floor")
                peaks.append(peak)
            yield df.assign(peak=peaks)

    schema = f"image_id {kind}, floor double, upper double, seed double, whole boolean, n1 int, counts1 array<long>"
    one = counted(level, "floor", "n1").select("image_id", "floor", "upper", "seed", "whole", "n1", "counts1").mapInPandas(fit_first, f"{schema}, threshold double, parameters array<double>")
    one = cut(one.withColumn("n2", count(F.col("threshold"), F.col("upper"), 8)))
    schema += ", threshold double, parameters array<double>, n2 int, counts2 array<long>"
    two = counted(one, "threshold", "n2").select(*[c.split()[0] for c in schema.split(", ")])
    return cut(two.mapInPandas(fit_second, schema + ", peak double").drop("whole"))


def signal_histogram(pixels: DataFrame, bins: int = 500) -> dict:
    """The fitted histogram of one image's valid pixels: floor, threshold, upper, parameters of background and
    signal, and the rows of the search range, from the threshold on: centres, counts and signal, smoothed."""
    r = image_levels(pixels.withColumn("image_id", F.lit(0)), bins).first()
    if r is None:
        raise ValueError("no valid pixel")
    fit = _first_fit(np.asarray(r["counts1"]), r["floor"], r["upper"], r["seed"]) | {"bins": r["n1"]}
    found, signal, _ = _second_fit(np.asarray(r["counts2"]), fit)
    return fit | {"search": found, "signal": signal}


def histogram_rows(spark, fit: dict) -> DataFrame:
    """The table of a normalisation's histogram, numbers as text of eight digits."""
    cols = (fit["centres"], fit["counts"], fit["smoothed"], fit["background"], fit["bell"], fit["background"] + fit["bell"])
    # fixed values: the columns of that file
    names = ("intensity", "count", "smoothed_count", "poisson_component", "gaussian_component", "combined_component")
    d = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*cols, strict=True)], ", ".join(f"{n} double" for n in names))
    return d.select(*[F.format_string("%.8g", F.col(n)).alias(n) for n in names])


def normalise(pixels: DataFrame, bins: int = 500) -> DataFrame:
    """``pixels`` (image_id, y, x, v) with ``norm`` = (v - floor) / (peak - floor) of their image, and padding 0. The
    peak of the signal is sought from the threshold on, within half a deviation below and two above its mean. An
    image without a valid pixel has 0 throughout; a table without any raises."""
    levels = image_levels(pixels, bins).select("image_id", F.col("floor").alias("_floor"), F.col("peak").alias("_peak"))
    if not levels.head(1):
        raise ValueError("no valid pixel")
    norm = F.when(raster.valid(F.col("v")), (F.col("v") - F.col("_floor")) / (F.col("_peak") - F.col("_floor"))).otherwise(0.0)
    return pixels.join(levels, "image_id", "left").select(*pixels.columns, norm.alias("norm"))
