import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions.geometry import Affine, Tile, ring_area, slice_bounds, tiles_for_span
from strataloom.operators import components, grouped, joins, models, objects, raster, regions
from strataloom.sources import plan_files


def mask(spark, pixels):
    return spark.createDataFrame([(0, y, x) for y, x in pixels], "image_id int, y int, x int")


def test_connectivity(spark):
    m = mask(spark, [(0, 0), (1, 1)])
    assert components.label_components(m, 10, 8).select("label").distinct().count() == 1
    assert components.label_components(m, 10, 4).select("label").distinct().count() == 2
    with pytest.raises(ValueError):
        components.label_components(m, 10, 6)


def test_components_equal_flood_fill(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((40, 40)) < 0.5
    got = {(r["y"], r["x"]): r["label"] for r in components.label_components(mask(spark, np.argwhere(grid).tolist()), 40, 8).collect()}
    seen = {}
    for y, x in np.argwhere(grid).tolist():
        if (y, x) in seen:
            continue
        todo, label = [(y, x)], y * 40 + x
        seen[y, x] = label
        while todo:
            a, b = todo.pop()
            for c in range(max(a - 1, 0), min(a + 2, 40)):
                for e in range(max(b - 1, 0), min(b + 2, 40)):
                    if grid[c, e] and (c, e) not in seen:
                        seen[c, e] = label
                        todo.append((c, e))
    assert got == seen


def test_single_pixel(spark):
    lab = mask(spark, [(3, 4)]).withColumn("label", F.lit(1))
    r = objects.measure(lab).first()
    assert (r["area"], r["axis_ratio"], r["elongation"]) == (1, 0.0, 1.0)
    assert joins.knn_mean_distance(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")).first()["nn"] == math.inf


def test_argmax_takes_least_plane_and_keeps_nan_of_plane_0(spark):
    v = spark.createDataFrame([(0, 1, 0, 0, 5.0), (0, 4, 0, 0, 5.0), (0, 0, 0, 1, math.nan), (0, 1, 0, 1, 2.0), (0, 0, 0, 2, 1.0), (0, 1, 0, 2, math.nan)], "image_id int, z int, y int, x int, v double")
    got = {r["x"]: (r["v"], r["argmax_z"]) for r in raster.project_max(v).collect()}
    assert got[0] == (5.0, 1) and math.isnan(got[1][0]) and got[1][1] == 0 and got[2] == (1.0, 0)
    with pytest.raises(ValueError):
        raster.project(v, "median")


def test_mode_ties_take_least_plane(spark):
    p = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 3)], "label int, argmax_z int")
    assert objects.modal_z(p, ["label"]).first()["z"] == 2


def test_z_chain_depends_on_order(spark):
    b = spark.createDataFrame([(0, i, 0.0, 1.0, 0.0, 1.0, z) for i, z in ((1, 0.0), (2, 8.0), (3, 16.0))], "image_id int, id long, min_x double, max_x double, min_y double, max_y double, z double")
    got = {r["id"]: r["group_id"] for r in grouped.z_constrained_groups(b, 1, 1, 10).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        grouped.z_constrained_groups(b, 1, 1, -1)


def test_span_edges(spark):
    d = spark.createDataFrame([(0.0,), (10.0,), (10.001,), (17.5,), (17.6,)], "s double")
    assert [r[0] for r in d.select(tiles_for_span(F.col("s"), 10.0, 7.5)).collect()] == [1, 1, 2, 2, 3]


def test_edge_slice_is_clamped(spark):
    tr = Affine.from_overview(0, 0, 1.0, 1.0, 10, 10)
    b = slice_bounds(tr, F.lit(0), F.lit(9), F.lit(0), F.lit(9))
    assert tuple(spark.range(1).select(*[b[k] for k in ("min_x", "max_x", "min_y", "max_y")]).first()) == (0.0, 9.5, 0.0, 9.5)


def test_boundary_pixels(spark):
    v = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)))], "id int, k int, x double, y double")
    px = mask(spark, [(y, x) for y in range(6) for x in range(6)])
    n = {k: regions.pixels_in_polygons(px, v, k).count() for k in ("incl", "open", "scan")}
    assert n["incl"] == 25 and n["open"] == 9 and n["scan"] == 16


def test_affine_round_trip(spark):
    tr = Affine(1.0, 0.5, 10.0, -0.25, 2.0, 20.0)
    x, y = tr.apply(F.col("id") * 1.0, F.col("id") * 3.0)
    back = tr.invert(x, y)
    for i, r in enumerate(spark.range(4).select(*back).collect()):
        assert r[0] == pytest.approx(i) and r[1] == pytest.approx(3 * i)
    with pytest.raises(ValueError):
        Affine(1, 2, 0, 2, 4, 0).invert(F.lit(1.0), F.lit(1.0))


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p = np.vstack([rng.random((80, 2)), rng.random((5, 2)) * 50 + 100])
    got = {r["id"]: r["nn"] for r in joins.knn_mean_distance(spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double")).collect()}
    d = np.sort(np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)), 1)[:, 1:4].mean(1)
    assert all(got[i] == pytest.approx(d[i]) for i in range(len(p)))


def test_knn_makes_no_rows_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p = [*rng.integers(0, 20, (300, 2)).tolist(), *[[3, 3]] * 5, [500, 500]]
    plans = []
    monkeypatch.setattr(joins, "cut", lambda df, real=joins.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    got = {r["id"]: r["nn"] for r in joins.knn_mean_distance(spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double")).collect()}
    assert plans and not any("Window" in plan for plan in plans)
    a = np.asarray(p, float)
    d = np.sort(np.hypot(*(a[:, None] - a[None]).transpose(2, 0, 1)), 1)[:, 1:4].mean(1)
    assert all(got[i] == pytest.approx(d[i]) for i in range(len(p)))


def test_range_joins_are_hashed(spark):
    p = spark.createDataFrame([(i, float(i), 0.0) for i in range(20)], "id long, x double, y double")
    plan = joins.proximity_pairs(p, 2.0, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins.proximity_pairs(p, 2.0, 2.0).count() == 18 + 19


def test_tiled_features_equal_untiled(spark):
    img = np.random.default_rng(0).random((30, 30))
    d = spark.createDataFrame([(1, y, x, float(img[y, x])) for y in range(30) for x in range(30)], "image_id int, y int, x int, v double")
    tiled = {(r["y"], r["x"]): r["f"] for r in grouped.tiled_features(d, 30, 30, (1.0,), tile=10, halo=12).collect()}
    whole = grouped.features(img, (1.0,))
    for y in range(12, 18):
        for x in range(12, 18):
            assert tiled[y, x] == pytest.approx(whole[y, x].tolist(), abs=1e-9)


def test_hull_contour_and_alpha(spark):
    lab = mask(spark, [(y, x) for y in range(3) for x in range(4)]).withColumn("label", F.lit(7).cast("long"))
    for rows in (grouped.convex_hulls(lab), grouped.mask_contours(lab, 0.0)):
        v = rows.orderBy("k").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("v"))
        area = v.select(ring_area(F.col("v"))).first()[0]
        assert 11.0 <= area <= 12.0
    a = grouped.alpha_area(lab, 2.0).first()
    assert a["area"] == pytest.approx(6.0)


def test_greedy_merge_takes_zero_saving_and_respects_free_tiles(spark):
    t = Tile(10, 10, 1.0, 1.0, 0.0)
    def boxes(*rows):
        return spark.createDataFrame([(0, i, x, x + 1, 0.0, 1.0, 0.0) for i, x in enumerate(rows)], "pool long, id long, min_x double, max_x double, min_y double, max_y double, z double")

    groups = lambda d, e: grouped.greedy_merge(d, t, e).select("group_id").distinct().count()
    assert groups(boxes(0.0, 3.0), 0.1) == 1
    assert groups(boxes(0.0, 10.5), 0.1) == 1  # two tiles before and after
    assert groups(boxes(0.0, 30.0), 0.1) == 2


def test_confidence_limits_drop_nan(spark):
    o = spark.createDataFrame([(0, 1, 200, 0.0, 0.0, 0.5, math.nan), (0, 2, 200, 5.0, 5.0, 0.5, 9.0)], "image_id int, label long, area long, centroid_x double, centroid_y double, elongation double, weighted double")
    assert [r["label"] for r in objects.filter_objects(o, objects.Limits(min_confidence=1.0)).collect()] == [2]
    assert [r["label"] for r in objects.top(o, 1, "confidence").collect()] == [2]
    with pytest.raises(ValueError):
        objects.Limits(min_area=5, max_area=1)


def test_empty_region(spark):
    r = spark.createDataFrame([(1,)], "id int")
    none = spark.createDataFrame([], "id int, y int, x int")
    m = spark.createDataFrame([], "y int, x int, prob double")
    got = regions.region_confidence(r, none, m).first()
    assert got["area_px"] == 0 and got["share"] == 0 and math.isnan(got["mean"]) and got["total"] == 0 and math.isnan(got["weighted"])


def test_region_polygons(spark):
    square = lambda x, y, n: [(1, y + j, x + i) for j in range(n) for i in range(n)]
    rows = square(2, 2, 4) + square(8, 2, 4) + square(24, 14, 4) + [(2, 5, x) for x in range(6)] + [(3, 0, 0)] + [(4, y, x) for _, y, x in square(0, 0, 4)]
    px = spark.createDataFrame(rows, "label long, y int, x int")

    def areas(boundary, tolerance=0.0, radius=3.0):
        v = grouped.region_polygons(px, boundary, tolerance, radius).groupBy("label", "part").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("v"))
        return {(r["label"], r["part"]): r["a"] for r in v.select("label", "part", ring_area(F.col("v")).alias("a")).collect()}

    near = areas("alpha_shape")
    assert set(near) == {(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)}  # two of the squares are linked, the third is a part of its own
    assert near[1, 1] > 2 * 15.5 and near[1, 2] == near[4, 1] == 15.5
    assert near[2, 1] == 6.0 and near[3, 1] == 1.0  # boxes of a line and of a pixel
    assert set(areas("alpha_shape", radius=0.3)) == {(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (4, 1)}  # no triangle: boxes of the parts
    assert set(areas("alpha_shape", radius=50.0)) == set(areas("mask_contour")) == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert areas("hull")[4, 1] == 16.0
    assert areas("alpha_shape", tolerance=100.0)[4, 1] == 16.0  # simplified away: its box
    assert grouped.region_polygons(px.where("false")).count() == 0
    with pytest.raises(ValueError):
        grouped.region_polygons(px, "circle")


def test_classes_of_models(spark):
    class Halves:
        """A model of two classes by the first feature."""

        classes_ = (1, 2)

        def predict(self, x):
            return (x[:, 0] > 0.5) + 1

        def predict_proba(self, x):
            return np.stack([1 - x[:, 0], x[:, 0]], 1)

    f = spark.createDataFrame([(0, 0, i, [i / 4, 1.0]) for i in range(5)], "image_id int, y int, x int, f array<double>")
    rows = lambda *a: [(r["cls"], r["prob"]) for r in models.classify(f, *a).orderBy("x").collect()]
    assert rows(Halves(), 2) == [(1, 0.0), (1, 0.25), (1, 0.5), (2, 0.75), (2, 1.0)]  # the first class on a tie
    assert rows(Halves(), 7) == [(c, 0.0) for c in (1, 1, 1, 2, 2)]
    assert rows(Halves(), None) == [(c, None) for c in (1, 1, 1, 2, 2)]
    assert models.classify(f.where("false"), Halves(), 2).count() == 0
    with pytest.raises(TypeError):
        models.classify(f, object(), 2)
    forest = models.fit_forest(f.withColumn("cls", F.when(F.col("x") > 2, 2).otherwise(1)), trees=3)
    got = rows(forest, 2)
    assert [c for c, _ in got] == [1, 1, 1, 2, 2] and all(0 <= p <= 1 for _, p in got)
    assert {p for _, p in rows(forest, 9)} == {0.0}


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("digits,width,height", [(0, 2.0, 3.0), (1, 1.5, 2.5), (4, 1.7, 1.1)])
def test_proximity_links_join_what_pairs_join(spark, digits, width, height):
    """Also where many points lie in one cell; links stay few where pairs are many."""
    rng = np.random.default_rng(digits)
    pts = np.round(rng.random((400, 2)) * [60, 90], digits)
    pts[:150] = np.round(pts[:150] / 8, max(digits, 2))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(400, None, 1.0), (401, math.nan, 1.0), (402, math.inf, 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    d = np.abs(pts[:, None] - pts[None])
    pairs = np.argwhere((d[..., 0] <= width) & (d[..., 1] <= height)).tolist()
    links = joins.proximity_links(df, width, height)
    got = {r["id"]: r["group_id"] for r in components.single_linkage(df, links).collect()}
    assert [got[i] for i in range(400)] == roots(400, pairs) and [got[i] for i in (400, 401, 402)] == [400, 401, 402]
    assert links.count() < len(pairs) / 2


def test_dense_points_have_few_links(spark):
    hot = spark.range(200_000).select("id", (F.rand(1) * 4.9).alias("x"), (F.rand(2) * 4.9).alias("y"))
    assert joins.proximity_links(hot, 5.0, 5.0).count() < 200_050


def test_box_pairs_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    c, size = rng.random((300, 2)) * 100, np.abs(rng.normal(0, 1, (300, 2)))
    size[:4] = [[300, 2], [2, 200], [90, 90], [1e6, 1e6]]  # the last would fill very many cells of the mean size
    rows = [(i, *map(float, (c[i, 0], c[i, 0] + size[i, 0], c[i, 1], c[i, 1] + size[i, 1]))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, min_x double, max_x double, min_y double, max_y double")
    for gx, gy in ((2.0, 1.0), (0.0, 0.0)):
        want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and max(a[1] - b[2], b[1] - a[2]) <= gx and max(a[3] - b[4], b[3] - a[4]) <= gy)
        assert sorted(map(tuple, joins.box_gap_pairs(df, gx, gy).collect())) == want


def test_tiles_touch_polygons_as_by_all_edges(spark):
    """Every tile against every edge, in plain Python; and a polygon of 100,000 vertices ends."""
    rng = np.random.default_rng(6)
    tile = Tile(4, 3, 1.0, 1.0, 0.25)
    rings = {1: [(0.0, 0.0), (20.0, 3.0), (9.0, 6.0), (18.0, 15.0), (1.0, 12.0)], 2: [(5.2, 5.1), (5.4, 5.1), (5.3, 5.3)], 3: [(-3.0, 0.0), (-3.0, 30.0), (-2.9, 30.0), (-2.9, 0.0)]}
    rings[4] = [(float(12 * np.cos(t) * r), float(10 * np.sin(t) * r)) for t, r in zip(np.linspace(0, 6.2, 40), rng.uniform(0.3, 1, 40))]
    tiles = [(i, k + 1, x, y) for i in rings for k, (x, y) in enumerate((float(x), float(y)) for x in np.arange(-14, 24, 3) for y in np.arange(-12, 32, 2.25))]

    def touches(ring, x, y):
        es = list(zip(ring, ring[1:] + ring[:1]))
        for px, py in ((x - 2, y - 1.5), (x + 2, y - 1.5), (x + 2, y + 1.5), (x - 2, y + 1.5)):
            if sum((ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax for (ax, ay), (bx, by) in es) % 2:
                return True
        for (ax, ay), (bx, by) in es:
            sides = [(bx - ax) * (y + sy - ay) - (by - ay) * (x + sx - ax) for sx in (-2, 2) for sy in (-1.5, 1.5)]
            if abs(ax - x) <= 2 and abs(ay - y) <= 1.5 or min(ax, bx) <= x + 2 and max(ax, bx) >= x - 2 and min(ay, by) <= y + 1.5 and max(ay, by) >= y - 1.5 and min(sides) <= 0 <= max(sides):
                return True
        return False

    want = sorted((i, k) for i, k, x, y in tiles if touches(rings[i], x, y))
    v = spark.createDataFrame([(i, k, *p) for i, r in rings.items() for k, p in enumerate(r)], "id int, k int, x double, y double")
    t = spark.createDataFrame(tiles, "id int, ordinal long, center_x double, center_y double")
    assert sorted((r["id"], r["ordinal"]) for r in regions.tiles_touching(t, v, tile).collect()) == want
    alone = spark.createDataFrame([(9, 1, 500.0, 500.0)], t.schema)
    assert [(r["center_x"], r["ordinal"]) for r in regions.tiles_touching(alone, v.where("id = 2").withColumn("id", F.lit(9)), tile).collect()] == [(pytest.approx(5.3), 1)]
    many = spark.range(100_000).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("k"), (F.cos(F.col("id") * 6.283 / 100_000) * 300).alias("x"), (F.sin(F.col("id") * 6.283 / 100_000) * 300).alias("y"))
    box = spark.createDataFrame([(1, -300.0, 300.0, -300.0, 300.0)], "id int, min_x double, max_x double, min_y double, max_y double")
    grid = regions.tile_lattice(box, Tile(10, 10, 1.0, 1.0, 0.0))
    found = regions.tiles_touching(grid, many, Tile(10, 10, 1.0, 1.0, 0.0)).count()
    assert abs(found - np.pi * 300**2 / 100) < 250 and found < grid.count()


def test_islands_equal_flooding():
    rng = np.random.default_rng(5)
    for shape, share in (((1, 1), 0.5), ((7, 9), 0.5), ((30, 40), 0.6), ((40, 5), 0.55), ((12, 12), 0.0), ((12, 12), 1.0)):
        mask = rng.random(shape) < share
        part, n = np.zeros(shape, int), 0
        for start in map(tuple, np.argwhere(mask).tolist()):
            if not part[start]:
                n, todo = n + 1, [start]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < shape[0] and 0 <= x < shape[1] and mask[y, x] and not part[y, x]:
                        part[y, x] = n
                        todo += [(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)]
        got, count = grouped.islands(mask)
        assert count == n and (got == part).all()


def test_merging_looks_at_neighbours_alone(spark, monkeypatch):
    """A grid that calls everything near gives the same groups; a large pool ends."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(250):
        x, y = rng.random(2) * 60
        w, h = rng.random(2) * (40 if i == 3 else 2)
        rows.append((0, 1, i, float(x), float(x + w), float(y), float(y + h), float(rng.integers(0, 20))))
    df = spark.createDataFrame(rows, "image_id int, pool int, id int, min_x double, max_x double, min_y double, max_y double, z double")
    tile = Tile(8, 8, 1.0, 1.0, 0.25)
    merged = lambda: sorted(map(tuple, grouped.greedy_merge(df, tile, 0.3, 12.0, 0.2).collect()))
    chained = lambda: sorted(map(tuple, grouped.z_constrained_groups(df.withColumn("id", F.col("id").cast("long")), 1.5, 1.5, 9.0).collect()))
    found = merged(), chained()

    def plain(df, limit, span):  # every pair in the order of ids
        up, lo, hi = list(range(len(df))), [r[7] for r in df], [r[7] for r in df]
        find = lambda i: i if up[i] == i else find(up[i])
        for i, p in enumerate(df):
            for j in range(i + 1, len(df)):
                q = df[j]
                if max(p[3] - q[4], q[3] - p[4]) <= limit and max(p[5] - q[6], q[5] - p[6]) <= limit and abs(p[7] - q[7]) <= span:
                    a, b = find(i), find(j)
                    if a != b and max(hi[a], hi[b]) - min(lo[a], lo[b]) <= span:
                        up[b], lo[a], hi[a] = a, min(lo[a], lo[b]), max(hi[a], hi[b])
        root = [find(i) for i in range(len(df))]
        return [(0, i, min(k for k in range(len(df)) if root[k] == r)) for i, r in enumerate(root)]

    assert found[1] == plain(rows, 1.5, 9.0) and len({r[-2] for r in found[0]}) < 250
    box = lambda k: (k, k + 1.0, 0.0, 1.0)
    grid = grouped.Grid(2.0, 2.0)
    for k in range(100):
        grid.put(k, box(3.0 * k))
    grid.put(100, (-1e9, 1e9, -1e9, 1e9))
    assert grid.near(box(30.0), 2.0, 2.0) >= {9, 10, 11, 100} and len(grid.near(box(30.0), 2.0, 2.0)) < 10
    grid.take(100, (-1e9, 1e9, -1e9, 1e9))
    assert 100 not in grid.near(box(30.0), 2.0, 2.0) and len(grid.near((-1e9, 1e9, 0.0, 1.0), 0.0, 0.0)) == 100
    many = spark.range(20_000).select(F.lit(0).alias("image_id"), F.lit(1).alias("pool"), F.col("id"), (F.col("id") % 200 * 5.0).alias("min_x"), (F.col("id") % 200 * 5.0 + 1).alias("max_x"), (F.floor(F.col("id") / 200) * 5.0).alias("min_y"), (F.floor(F.col("id") / 200) * 5.0 + 1).alias("max_y"), F.lit(0.0).alias("z"))
    assert grouped.greedy_merge(many, Tile(4, 4, 1.0, 1.0, 0.0), 0.0, None, 0.5).count() == 20_000


def test_z_groups_of_dense_boxes_take_few_links(spark, monkeypatch):
    rng = np.random.default_rng(11)
    cols = "image_id int, id long, min_x double, max_x double, min_y double, max_y double, z double"
    rows = [(0, i, float(x), float(x) + (30.0 if i == 50 else 0.0), float(y), float(y), float(z)) for i, (x, y, z) in enumerate(zip(rng.integers(0, 12, 600), rng.integers(0, 12, 600), rng.integers(0, 8, 600) * 2, strict=True))]
    rows += [(0, 600 + i, math.inf if i % 2 else 3.0, math.inf if i % 2 else 3.0, 3.0, 3.0, 4.0 if i % 2 else math.nan) for i in range(4)]
    df = spark.createDataFrame(rows, cols)
    up, lo, hi = list(range(604)), [r[6] for r in rows], [r[6] for r in rows]

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    near = lambda p, q: max(p[2] - q[3], q[2] - p[3]) <= 3 and max(p[4] - q[5], q[4] - p[5]) <= 3 and abs(p[6] - q[6]) <= 6
    for i, p in enumerate(rows):
        for j in range(i + 1, 604):
            if near(p, rows[j]):
                a, b = find(i), find(j)
                if a != b and max(hi[a], hi[b]) - min(lo[a], lo[b]) <= 6:
                    up[b], lo[a], hi[a] = a, min(lo[a], lo[b]), max(hi[a], hi[b])
    least = {}
    for i in range(604):
        least.setdefault(find(i), i)
    seen, real = [], grouped.single_linkage
    monkeypatch.setattr(grouped, "single_linkage", lambda points, pairs: seen.append((points.count(), pairs.count())) or real(points, pairs))
    got = {r["id"]: r["group_id"] for r in grouped.z_constrained_groups(df, 3.0, 3.0, 6.0).collect()}
    assert got == {i: least[find(i)] for i in range(604)}
    # copies are one row, and links stay linear where pairs go with the square
    assert seen[0][0] == len({r[2:] for r in rows[:600]}) + 4 and seen[0][1] < 16 * 600 < joins.box_gap_pairs(df.where("id < 600"), 3.0, 3.0, 6.0).count()
    loose = spark.createDataFrame([(0, i, float(x), float(x), float(y), float(y), float(z)) for i, (x, y, z) in enumerate(rng.random((300, 3)) * (60, 60, 20))], cols)
    roots = lambda links: sorted(map(tuple, components.single_linkage(loose, links).select("id", "group_id").collect()))
    assert roots(joins.box_gap_links(loose, 3.0, 3.0, 6.0)) == roots(joins.box_gap_pairs(loose, 3.0, 3.0, 6.0))


def test_forest_reads_its_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for df in batches:
            seen.add(len(df))
            yield df

    rows = spark.createDataFrame([([float(i), float(i % 7)], i % 2) for i in range(200)], "f array<double>, cls int")
    forest = models.fit_forest(rows.mapInPandas(count, rows.schema), trees=2, depth=3)
    assert seen.value == 200 and forest.getNumTrees == 2
    rng = np.random.default_rng(5)
    for shape, sigma in (((88, 64), 1.0), ((5, 3), 2.0), ((1, 9), 1.5)):
        image = rng.normal(size=shape)
        w = raster.gaussian_weights(sigma)
        k, want = np.asarray(w[:0:-1] + w), image
        for axis in (0, 1):
            want = np.apply_along_axis(lambda v: np.convolve(np.pad(v, len(w) - 1, mode="symmetric"), k, "valid"), axis, want)  # noqa: B023
        assert (raster.blurred(image, sigma) == want).all()


def test_names_are_free_or_an_error():
    assert plan_files.output_prefix("été 2/µ", set()) == "été_2_µ" and plan_files.output_prefix("", set()) == "output"
    assert plan_files.output_prefix("a", {"a", "a_2"}) == "a_3"
    with pytest.raises(ValueError):
        plan_files.output_prefix("a", {"a", *(f"a_{n}" for n in range(2, 10_000))})
