"""Kernels that are sequential or geometric by nature, one group of rows at a time in Arrow batches."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Tile, finite_or_zero
from .components import single_linkage
from .joins import box_gap_links, images
from .raster import blurred
from .scratch import cut


class Grid:
    """Boxes (min_x, max_x, min_y, max_y) by cells of a plane, for kernels that look for neighbours. Boxes of very many cells
    are kept apart and are near everything."""

    def __init__(self, width: float, height: float):
        self.width, self.height = max(width, 1e-9), max(height, 1e-9)
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.wide: set[int] = set()

    def _cells(self, box, pad_x: float = 0.0, pad_y: float = 0.0) -> list[tuple[int, int]] | None:
        x0, x1 = (math.floor(v / self.width) for v in (box[0] - pad_x, box[1] + pad_x))
        y0, y1 = (math.floor(v / self.height) for v in (box[2] - pad_y, box[3] + pad_y))
        if (x1 - x0 + 1) * (y1 - y0 + 1) > 4096:
            return None
        return [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]

    def put(self, k: int, box) -> None:
        cells = self._cells(box)
        if cells is None:
            self.wide.add(k)
        for c in cells or ():
            self.cells.setdefault(c, set()).add(k)

    def take(self, k: int, box) -> None:
        self.wide.discard(k)
        for c in self._cells(box) or ():
            self.cells[c].discard(k)

    def near(self, box, pad_x: float, pad_y: float) -> set[int]:
        """All that may lie within the pads of a box on both axes, and others of the same cells."""
        cells = self._cells(box, pad_x * (1 + 1e-9) + 1e-9, pad_y * (1 + 1e-9) + 1e-9)
        found = set(self.wide)
        for c in self.cells if cells is None else cells:
            found |= self.cells.get(c, set())
        return found

    def frozen(self):
        """``near`` for a grid that stays as it is: it gives an array, in which one may stand for each cell."""
        cells = {c: np.fromiter(k, int, len(k)) for c, k in self.cells.items()}
        wide = np.fromiter(self.wide, int, len(self.wide))

        def near(box, pad_x: float, pad_y: float) -> np.ndarray:
            at = self._cells(box, pad_x * (1 + 1e-9) + 1e-9, pad_y * (1 + 1e-9) + 1e-9)
            return np.concatenate([wide, *(cells[c] for c in (cells if at is None else at) if c in cells)])

        return near


def z_constrained_groups(boxes: DataFrame, gap_x: float, gap_y: float, max_span: float) -> DataFrame:
    """(image_id, id, group_id) of boxes (image_id, id, min_x, max_x, min_y, max_y, z). Pairs are tried in
    the order of ids, and a pair joins its groups only if the z of all members then spans ``max_span`` at
    most; so the outcome depends on the order. Only boxes that chains of such pairs link can meet: chains
    that hold these are found first, and each is one group of rows.

    Equal boxes always end in one group, that of their least id: whichever pair takes one of them takes the others
    next, and their own pairs add nothing to a span. So a chain has one row for each distinct box."""
    if max_span < 0:
        raise ValueError("the z limit must not be negative")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id").reset_index(drop=True)
        n = len(df)
        if n == 1:
            return df.assign(group_id=df["id"])[["image_id", "id", "group_id"]]
        x0, x1, y0, y1, z = (df[c].to_numpy(float) for c in ("min_x", "max_x", "min_y", "max_y", "z"))
        root, lo, hi = np.arange(n), z.tolist(), z.tolist()
        members = {i: [i] for i in range(n)}
        grid = Grid(gap_x + float(np.mean(x1 - x0)), gap_y + float(np.mean(y1 - y0)))
        boxes = list(zip(x0.tolist(), x1.tolist(), y0.tolist(), y1.tolist(), strict=True))
        for i, box in enumerate(boxes):
            grid.put(i, box)
        look = grid.frozen()
        for i, box in enumerate(boxes):
            late = look(box, gap_x, gap_y)
            late = late[late > i]
            late = late[np.abs(z[late] - z[i]) <= max_span]
            late = late[np.maximum(0, np.maximum(x0[i] - x1[late], x0[late] - x1[i])) <= gap_x]
            late = late[np.maximum(0, np.maximum(y0[i] - y1[late], y0[late] - y1[i])) <= gap_y]
            # a group is tried at its first box: later ones are of the same group, or refused again, as spans only grow
            late = np.unique(late)
            groups, first = np.unique(root[late], return_index=True)
            own = int(root[i])
            for b in groups[np.argsort(first)].tolist():
                if b != own and max(hi[root[i]], hi[b]) - min(lo[root[i]], lo[b]) <= max_span:
                    a = int(root[i])
                    span = min(lo[a], lo[b]), max(hi[a], hi[b])
                    if len(members[a]) < len(members[b]):
                        a, b = b, a
                    moved = members.pop(b)
                    root[moved] = a
                    members[a] += moved
                    lo[a], hi[a] = span
        df["group_id"] = df["id"].groupby(pd.Series(root)).transform("min")
        return df[["image_id", "id", "group_id"]]

    boxes = cut(boxes)  # read by the distinct boxes and at the end
    sides = ["min_x", "max_x", "min_y", "max_y", "z"]
    finite = F.lit(True)
    for c in sides:
        finite &= F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))  # NaN is greater
    key = ["image_id", *sides, "_lone"]
    boxes = boxes.withColumn("_lone", F.when(~finite, F.col("id")))  # without finite sides a box has no equal
    distinct = cut(boxes.groupBy(*key).agg(F.min("id").alias("id")))
    linked = single_linkage(distinct, box_gap_links(distinct, gap_x, gap_y, max_span)).withColumnRenamed("group_id", "_chain")
    groups = linked.drop("_lone").groupBy("image_id", "_chain").applyInPandas(run, "image_id int, id long, group_id long")
    same = F.lit(True)
    for c in key:
        same &= F.col(f"b.{c}").eqNullSafe(F.col(f"d.{c}"))
    of = boxes.alias("b").join(distinct.alias("d"), same).select("b.image_id", F.col("d.id").alias("_first"), "b.id")
    return of.join(groups.withColumnRenamed("id", "_first"), ["image_id", "_first"]).select(F.col("image_id").cast("int").alias("image_id"), F.col("id").cast("long").alias("id"), "group_id")


def _count(span: float, tile: float, step: float) -> int:
    return 1 + math.ceil(max(0.0, span - tile) / step)


def greedy_merge(members: DataFrame, tile: Tile, max_extra: float = 0.1, max_z: float | None = None, gap: float = 1.0, output: str = "polygon_regions") -> DataFrame:
    """(pool, id, group_id, place) of members (pool, id, min_x, max_x, min_y, max_y, z) of each image: groups of one pool are
    merged while that saves tiles, or costs none. The best saving goes first, then fewer tiles, then older
    groups. A merge needs gaps of at most ``gap`` tiles on both axes, z within ``max_z``, and at most
    ``max_extra`` of its tiles free of members: of their pixels, where members have ``cells``, an array of the
    stage boxes of their pixel rows (min_x, max_x, min_y, max_y), else of their boxes. A group's tiles are those
    of the ``output``: its members for detection points, one for group centres, else the lattice of its box.
    ``place`` is the order inside the group. Pools are independent."""
    keys = [*images(members), "pool"]
    cells = "cells" in members.columns
    limit_x, limit_y = tile.width * gap, tile.height * gap

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id").reset_index(drop=True)
        rows = df[["min_x", "max_x", "min_y", "max_y", "z"]].to_numpy(float)
        live: dict[int, list[int]] = {i: [i] for i in range(len(df))}
        box = {i: (r[0], r[1], r[2], r[3], r[4], r[4]) for i, r in enumerate(rows)}
        parts = [np.asarray([list(c) for c in x], float) if cells and len(x) else rows[i : i + 1, :4] for i, x in enumerate(df["cells"] if cells else rows)]

        def takes(bounds, n):
            if output == "detection_points":
                return n
            return 1 if output == "group_center_points" else _count(bounds[1] - bounds[0], tile.width, tile.step_x) * _count(bounds[3] - bounds[2], tile.height, tile.step_y)

        cost = {i: takes(r, 1) for i, r in enumerate(rows)}

        def joined(a, b):
            p, q = box[a], box[b]
            return min(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), max(p[3], q[3]), min(p[4], q[4]), max(p[5], q[5])

        def touched(bounds, ids):
            nx, ny = _count(bounds[1] - bounds[0], tile.width, tile.step_x), _count(bounds[3] - bounds[2], tile.height, tile.step_y)
            cx, cy = (bounds[0] + bounds[1]) / 2, (bounds[2] + bounds[3]) / 2
            n, r = 0, np.concatenate([parts[i] for i in ids])
            for iy in range(ny):
                for ix in range(nx):
                    x, y = cx + (ix - (nx - 1) / 2) * tile.step_x, cy + (iy - (ny - 1) / 2) * tile.step_y
                    n += bool(((r[:, 0] <= x + tile.width / 2) & (r[:, 1] >= x - tile.width / 2) & (r[:, 2] <= y + tile.height / 2) & (r[:, 3] >= y - tile.height / 2)).any())
            return n

        def candidate(a, b):
            p, q = box[a], box[b]
            if max(0, p[0] - q[1], q[0] - p[1]) > limit_x or max(0, p[2] - q[3], q[2] - p[3]) > limit_y:
                return None
            m = joined(a, b)
            if max_z is not None and m[5] - m[4] > max_z:
                return None
            out = takes(m, len(live[a]) + len(live[b]))
            saving = cost[a] + cost[b] - out
            if saving < 0 or max(0, out - touched(m, live[a] + live[b])) / max(1, out) > max_extra:
                return None
            return -saving, out, a, b

        grid = Grid(max(limit_x, tile.width), max(limit_y, tile.height))
        for i, b in box.items():
            grid.put(i, b)
        heap = [c for a in live for b in grid.near(box[a], limit_x, limit_y) if a < b and (c := candidate(a, b))]
        heapq.heapify(heap)
        nxt = len(df)
        while heap:
            _, out, a, b = heapq.heappop(heap)
            if a not in live or b not in live:
                continue
            box[nxt], cost[nxt] = joined(a, b), out
            live[nxt] = live.pop(a) + live.pop(b)
            grid.take(a, box[a])
            grid.take(b, box[b])
            others = grid.near(box[nxt], limit_x, limit_y)
            grid.put(nxt, box[nxt])
            for other in others:
                if c := candidate(other, nxt):
                    heapq.heappush(heap, c)
            nxt += 1
        ids = df["id"].to_numpy()
        out = pd.DataFrame([(int(ids[i]), int(min(ids[m] for m in ms)), k) for ms in live.values() for k, i in enumerate(ms)], columns=["id", "group_id", "place"])
        for i, k in enumerate(keys):
            out.insert(i, k, df[k].iloc[0])
        return out

    kinds = dict(members.dtypes)
    return members.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", id long, group_id long, place int")


def grown_selections(objects: DataFrame, n: int, tile: Tile, seeds: int = 24) -> DataFrame:
    """(seed, rank, id, place): selections of n objects (id, x, y, score) grown from the ``seeds`` best scores, ranked
    from 0: each grows by the object nearest, in tiles, to what it has, the greater score first on ties, then the
    lesser id. Scores that are not finite count as 0. A review's objects are as many as a person looks at;
    selections grow in parallel, one group of rows each."""
    o = objects.withColumn("score", finite_or_zero(F.col("score")))
    top = o.orderBy(F.col("score").desc(), "id").limit(seeds).select(F.col("id").alias("seed"), "score")
    top = top.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("score").desc(), "seed")) - 1).cast("int")).drop("score")
    every = F.broadcast(top).crossJoin(o)  # at most `seeds` rows by the objects

    def grow(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        seed = int(df["seed"].iloc[0])
        x, y, s, ids = (df[c].to_numpy() for c in ("x", "y", "score", "id"))
        start = int(np.flatnonzero(ids == seed)[0])
        far = lambda k: np.maximum(np.abs(x - x[k]) / tile.width, np.abs(y - y[k]) / tile.height)
        near = far(start)
        near[start] = np.inf
        chosen = [start]
        while len(chosen) < min(n, len(df)):
            k = int(np.lexsort((ids, -s, near))[0])
            chosen.append(k)
            near = np.minimum(near, far(k))
            near[chosen] = np.inf
        return pd.DataFrame({"seed": seed, "rank": int(df["rank"].iloc[0]), "id": ids[chosen], "place": range(len(chosen))})

    return every.groupBy("seed").applyInPandas(grow, "seed long, rank int, id long, place int")


def by_object(pixels: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on each object's pixels (y, x, and um where they have it) in its image: the object's keys with the
    columns of ``schema``."""
    keys = [*images(pixels), "label"]

    def one(df: pd.DataFrame) -> pd.DataFrame:
        out = run(df)
        for i, k in enumerate(keys):
            out.insert(i, k, df[k].iloc[0])
        return out

    kinds = dict(pixels.dtypes)
    more = [c for c in ("um",) if c in pixels.columns]
    return pixels.select(*keys, "y", "x", *more).groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by the monotone chain, from the least point on, turning left."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.asarray(pts, float)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.asarray(half(pts) + half(pts[::-1]), float)


def convex_hulls(pixels: DataFrame) -> DataFrame:
    """(label, k, x, y): hull vertices of each object's pixel corners."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        c = np.concatenate([df[["x", "y"]].to_numpy(float) + d for d in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))])
        h = hull(c)
        return pd.DataFrame({"k": range(len(h)), "x": h[:, 0], "y": h[:, 1]})

    return by_object(pixels, run, "k int, x double, y double")


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open chain, ends kept; unchanged where the tolerance isn't positive."""
    if tolerance <= 0:
        return ring
    keep, todo = np.zeros(len(ring), bool), [(0, len(ring) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = ring[b] - ring[a]
        p = ring[a + 1 : b] - ring[a]
        far = np.hypot(*p.T) if not d.any() else np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / np.hypot(*d)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep]


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Closed contours of a mask at its half level, as (x, y) rings through the midpoints between set and
    unset pixels, the longest first."""
    m = np.pad(mask.astype(bool), 1).astype(int)
    links: dict[tuple, list[tuple]] = {}
    codes = m[:-1, :-1] * 8 + m[:-1, 1:] * 4 + m[1:, 1:] * 2 + m[1:, :-1]
    for y, x in np.argwhere((codes > 0) & (codes < 15)).tolist():  # the outline alone
        north, east, south, west = (x + 0.5, y), (x + 1, y + 0.5), (x + 0.5, y + 1), (x, y + 0.5)
        # set pixels stay on the left; saddles keep their set pixels apart
        code = codes[y, x]
        for frm, to in {8: [(west, north)], 4: [(north, east)], 2: [(east, south)], 1: [(south, west)], 12: [(west, east)], 6: [(north, south)], 3: [(east, west)], 9: [(south, north)], 14: [(west, south)], 7: [(north, west)], 11: [(east, north)], 13: [(south, east)], 10: [(west, north), (east, south)], 5: [(north, east), (south, west)]}.get(int(code), ()):
            links.setdefault(frm, []).append(to)
    rings = []
    for start in sorted(links):
        while links[start]:
            ring, at = [start], links[start].pop()
            while at != start:
                ring.append(at)
                at = links[at].pop()
            rings.append(np.asarray(ring, float) - 1)
    return sorted(rings, key=len, reverse=True)


def mask_contours(pixels: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(label, k, x, y): the simplified largest outline of each object; its pixel box where that has under
    three vertices."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = df["x"].min(), df["y"].min()
        mask = np.zeros((df["y"].max() - y0 + 1, df["x"].max() - x0 + 1), bool)
        mask[df["y"] - y0, df["x"] - x0] = True
        r = outlines(mask)[0]
        r = simplify(np.vstack([r, r[:1]]), tolerance)[:-1]
        if len(r) < 3:
            h, w = mask.shape
            r = np.asarray([(-0.5, -0.5), (w - 0.5, -0.5), (w - 0.5, h - 0.5), (-0.5, h - 0.5)])
        return pd.DataFrame({"k": range(len(r)), "x": r[:, 0] + x0, "y": r[:, 1] + y0})

    return by_object(pixels, run, "k int, x double, y double")


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) of distinct points by incremental insertion."""
    n = len(points)
    span = max(np.ptp(points, axis=0).max(), 1.0)
    mid = points.mean(0)
    p = np.vstack([points, mid + [-40 * span, -30 * span], mid + [40 * span, -30 * span], mid + [0, 50 * span]])
    tri = np.asarray([(n, n + 1, n + 2)])
    turn = np.ones(1)  # of each triangle, to the left
    for i in range(n):
        a, b, c = (p[tri[:, k]] - p[i] for k in range(3))
        det = (a**2).sum(1) * (b[:, 0] * c[:, 1] - c[:, 0] * b[:, 1]) - (b**2).sum(1) * (a[:, 0] * c[:, 1] - c[:, 0] * a[:, 1]) + (c**2).sum(1) * (a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1])
        bad = det * turn > 1e-9
        edge: dict[tuple, int] = {}
        for x in tri[bad].tolist():
            for e in ((x[0], x[1]), (x[1], x[2]), (x[2], x[0])):
                edge[tuple(sorted(e))] = edge.get(tuple(sorted(e)), 0) + 1
        new = np.asarray([(*e, i) for e, k in edge.items() if k == 1], int).reshape(-1, 3)
        u, v, w = (p[new[:, k]] for k in range(3))
        side = np.sign((v[:, 0] - u[:, 0]) * (w[:, 1] - u[:, 1]) - (v[:, 1] - u[:, 1]) * (w[:, 0] - u[:, 0]))
        tri, turn = np.concatenate([tri[~bad], new]), np.concatenate([turn[~bad], side])
    return tri[(tri < n).all(1)]


def islands(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected parts of a mask, numbered from 1 in scan order, and how many there are. Runs of a row are joined with
    those of the row above that they touch, and only runs are labelled one by one."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    ys, x0 = np.nonzero(step == 1)
    x1 = np.nonzero(step == -1)[1]
    head = list(range(len(ys)))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    first = np.searchsorted(ys, np.arange(mask.shape[0] + 1)).tolist()
    starts, stops = x0.tolist(), x1.tolist()
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] < stops[j] and starts[j] < stops[i]:
                a, b = sorted((find(i), find(j)))
                head[b] = a
            if stops[i] < stops[j]:
                i += 1
            else:
                j += 1
    roots = np.asarray([find(i) for i in range(len(head))], int)
    heads, number = np.unique(roots, return_inverse=True)  # a part's least run is its first in scan order
    part = np.zeros(mask.shape, int)
    size = x1 - x0
    at = np.repeat(x0 - np.cumsum(size) + size, size) + np.arange(size.sum())
    part[np.repeat(ys, size), at] = np.repeat(number + 1, size)
    return part, len(heads)


def _area(ring: np.ndarray) -> float:
    x, y = ring.T
    return abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def kept_triangles(points: np.ndarray, radius: float) -> np.ndarray:
    """Delaunay triangles (n, 3, 2) of distinct points with a circumradius of at most ``radius``."""
    # points of a raster share circles; a fixed jitter decides between equal triangulations
    t = points[delaunay(points + 1e-7 * np.random.default_rng(0).random(points.shape))]
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    twice = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    sides = np.hypot(*(a - b).T) * np.hypot(*(b - c).T) * np.hypot(*(c - a).T)
    flat = twice <= 1e-12
    return t[~flat & (sides / np.where(flat, 1, 2 * twice) <= radius)]


def alpha_islands(points: np.ndarray, radius: float, most: int = 4000) -> list[np.ndarray]:
    """Outlines of the islands of an alpha shape: its triangles drawn on pixel centres, and the largest
    outline of each connected part. Triangulates every k-th point where there are more than ``most``; empty
    where there is no triangle."""
    pts = np.unique(points, axis=0)
    pts = pts[:: math.ceil(len(pts) / most)]
    if len(pts) < 4 or radius <= 0:
        return []
    lo = np.floor(pts.min(0)).astype(int)
    w, h = np.ceil(pts.max(0)).astype(int) - lo + 1
    drawn = np.zeros((h, w), bool)
    for tri in kept_triangles(pts, radius) - lo:
        (x0, y0), (x1, y1) = np.ceil(tri.min(0)).astype(int), np.floor(tri.max(0)).astype(int)
        yy, xx = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
        side = [(q[0] - p[0]) * (yy - p[1]) - (q[1] - p[1]) * (xx - p[0]) for p, q in zip(tri, np.roll(tri, -1, 0), strict=True)]
        drawn[y0 : y1 + 1, x0 : x1 + 1] |= np.all(np.asarray(side) >= -1e-9, 0) | np.all(np.asarray(side) <= 1e-9, 0)
    part, n = islands(drawn)
    return [max(outlines(part == i), key=_area) + lo for i in range(1, n + 1)]


def _box(part: np.ndarray) -> np.ndarray:
    """Pixel box of the set pixels, at pixel edges."""
    ys, xs = np.nonzero(part)
    x0, x1, y0, y1 = xs.min() - 0.5, xs.max() + 0.5, ys.min() - 0.5, ys.max() + 0.5
    return np.asarray([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def region_polygons(pixels: DataFrame, boundary: str = "alpha_shape", tolerance: float = 0.0, radius: float = 0.0) -> DataFrame:
    """(label, part, k, x, y): polygons around pixels (label, y, x), simplified within ``tolerance`` pixels. Where
    pixels have a column ``um``, their size, tolerance and radius are lengths in that unit.

    A label with one outline follows it. With several, ``alpha_shape`` gives the islands of an alpha shape of
    ``radius`` pixels as parts, and ``mask_contour`` the hull around all; ``hull`` always gives the hull of
    the pixels. Labels too small to outline, and alpha shapes without triangles, give the box of each
    connected part; a polygon simplified to under three vertices is left out, or is the box if no other is
    left. Parts are numbered from 1 by their top, then their left edge. One label's pixels are one group."""
    if boundary not in ("alpha_shape", "mask_contour", "hull"):
        raise ValueError(f"unknown boundary {boundary!r}")

    def around(mask, tolerance, radius):
        boxes = lambda: (lambda part, n: [_box(part == i) for i in range(1, n + 1)])(*islands(mask))
        if boundary == "hull":
            ys, xs = np.nonzero(mask)
            c = np.stack([xs, ys], 1).astype(float)
            found = [hull(np.concatenate([c + d for d in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]))]
        elif min(mask.shape) < 2:
            return boxes()
        else:
            rings = outlines(mask)
            found = rings if len(rings) == 1 else alpha_islands(np.vstack(rings), radius) if boundary == "alpha_shape" else [hull(np.vstack(rings))]
        several = boundary == "alpha_shape" and len(found) != 1
        found = [r for ring in found if len(r := simplify(np.vstack([ring, ring[:1]]), tolerance)[:-1]) >= 3]
        return found or (boxes() if several else [_box(mask)])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = df["x"].min(), df["y"].min()
        mask = np.zeros((df["y"].max() - y0 + 1, df["x"].max() - x0 + 1), bool)
        mask[df["y"] - y0, df["x"] - x0] = True
        um = float(df["um"].iloc[0]) if "um" in df else 1.0
        out = sorted(around(mask, tolerance / um, radius / um), key=lambda r: (r[:, 1].min(), r[:, 0].min()))
        rows = [(i, k, x + x0, y + y0) for i, r in enumerate(out, 1) for k, (x, y) in enumerate(r)]
        return pd.DataFrame(rows, columns=["part", "k", "x", "y"])

    return by_object(pixels, run, "part int, k int, x double, y double")


def alpha_area(pixels: DataFrame, alpha: float, most: int = 4000) -> DataFrame:
    """(label, points, triangles, area) of each object's alpha shape: Delaunay triangles of its pixels (every
    k-th where there are more than ``most``) with a circumradius of at most ``alpha``."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        pts = df.sort_values(["y", "x"])[["x", "y"]].to_numpy(float)
        pts = pts[:: math.ceil(len(pts) / most)]
        t = kept_triangles(pts, alpha) if len(pts) >= 3 else np.empty((0, 3, 2))
        kept, area = len(t), float(sum(_area(q) for q in t))
        return pd.DataFrame({"points": [len(pts)], "triangles": [kept], "area": [area]})

    return by_object(pixels, run, "points int, triangles int, area double")


def features(image: np.ndarray, sigmas: tuple[float, ...]) -> np.ndarray:
    """Per sigma: Gaussian, both eigenvalues of the structure tensor, and local variance (not below 0)."""

    out = []
    for s in sigmas:
        g = blurred(image, s)
        gy, gx = np.gradient(image)
        a, b, c = blurred(gx * gx, s), blurred(gx * gy, s), blurred(gy * gy, s)
        root = np.sqrt((a - c) ** 2 + 4 * b * b)
        out += [g, (a + c + root) / 2, (a + c - root) / 2, np.maximum(blurred(image * image, s) - g * g, 0)]
    return np.stack(out, -1)


def tiled_features(pixels: DataFrame, height: int, width: int, sigmas: tuple[float, ...] = (1.0, 2.0), tile: int = 64, halo: int = 12) -> DataFrame:
    """(image_id, y, x, f array<double>) of dense images, computed by tiles with a halo: pixels are dealt to the
    tiles that see them, and each tile keeps its core. Equal to the untiled result where the halo holds
    the filters' reach."""
    if tile <= 0 or halo < 0:
        raise ValueError("tile sizes must be positive")
    span = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)), F.least(F.floor((F.col(c) + halo) / tile), F.lit((n - 1) // tile)))
    d = pixels.withColumn("ty", F.explode(span("y", height))).withColumn("tx", F.explode(span("x", width)))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = df["y"].min(), df["x"].min()
        img = np.zeros((df["y"].max() - y0 + 1, df["x"].max() - x0 + 1))
        img[df["y"] - y0, df["x"] - x0] = df["v"]
        f = features(img, sigmas) if min(img.shape) > 1 else np.zeros((*img.shape, 4 * len(sigmas)))
        core = df[(df["y"] // tile == df["ty"]) & (df["x"] // tile == df["tx"])]
        return pd.DataFrame({"image_id": core["image_id"], "y": core["y"], "x": core["x"], "f": list(f[core["y"] - y0, core["x"] - x0])})

    return d.groupBy("image_id", "ty", "tx").applyInPandas(run, "image_id int, y int, x int, f array<double>")
