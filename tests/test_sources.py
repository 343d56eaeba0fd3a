import xml.etree.ElementTree as ET

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from strataloom import catalogue
from strataloom.functions.geometry import Affine, ImageScales, Tile
from strataloom.operators import components, raster
from strataloom.plans import compose, reviews, tables
from strataloom.sources import navigator, planes
from strataloom.sources.voxels import PlaneSource, VoxelReader


@pytest.fixture
def stacks(tmp_path):
    """Two files: one of two times, two channels and three planes, one of three planes."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (2, 2, 3, 5, 6)).astype(float), rng.integers(0, 4, (3, 5, 6)).astype(float)
    paths = [str(tmp_path / "a.npy"), str(tmp_path / "b.npy")]
    np.save(paths[0], a)
    np.save(paths[1], b)
    return paths, a, b


def image(df, i, shape=(5, 6)):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("image_id") == i).collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def test_overviews_are_as_read_whole(spark, stacks):
    paths, a, b = stacks
    assert (image(planes.read_overview(spark, paths, channel=1, z=2, time=1), 0) == a[1, 1, 2]).all()
    mean = planes.read_overview(spark, paths, projection="Mean")
    assert np.allclose(image(mean, 0), a[0, 0].mean(0)) and np.allclose(image(mean, 1), b.mean(0))  # zeros count
    best = planes.read_overview(spark, paths, scene=1, projection="max")
    assert (image(best, 1) == b.max(0)).all() and best.where("image_id = 0").count() == 0
    assert all(b[:, r["y"], r["x"]].argmax() == r["argmax_z"] for r in best.collect())
    with pytest.raises(ValueError):
        planes.read_overview(spark, paths, projection="sum")


def test_planes_not_asked_for_are_not_opened(spark, stacks):
    paths, a, _ = stacks
    opened = lambda **o: [p.key for p in VoxelReader({"paths": ",".join(paths)} | o, True).partitions() if p]
    assert len(opened()) == 12 + 3 and opened(scene="0", channel="1", time="0", z="2") == [(0, 0, 1, 0, 2)]
    assert opened(z="0,2", scene="1") == [(1, 1, 0, 0, 0), (1, 1, 0, 0, 2)] and opened(channel="7") == []
    spark.dataSource.register(PlaneSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("planes").option("paths", ",".join(paths)).option("pushdown", "true").load().where("time = 1 and channel = 0 and z in (1, 2) and v > 1")
        assert got.rdd.getNumPartitions() == 2  # two planes
        want = [(1 + z, y, x) for z in range(2) for y, x in np.argwhere(a[1, 0, 1 + z] > 1).tolist()]
        assert sorted((r["z"], r["y"], r["x"]) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert spark.read.format("planes").option("paths", ",".join(paths)).option("z", "9").load().count() == 0


def test_planes_are_resampled_before_the_fold(spark, stacks):
    paths, _, b = stacks
    got = planes.project_resampled(planes.read_planes(spark, paths, scene=1), 3, (5, 6), (10, 9))
    layer = lambda z: spark.createDataFrame([(0, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(b[z])], "image_id int, y int, x int, v double")
    each = np.stack([image(raster.resample_bilinear(layer(z), (5, 6), (10, 9)), 0, (10, 9)) for z in range(3)])
    assert np.allclose(image(got, 1, (10, 9)), each.max(0))


def test_cache(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(5).withColumn("v", F.col("id") * len(calls))

    read = lambda: sorted(map(tuple, planes.cached(spark, str(tmp_path), "k_s0", make).collect()))
    first = read()
    assert read() == first and len(calls) == 1
    assert planes.cached(spark, str(tmp_path), "k_s1", make).count() == 5 and len(calls) == 2  # another key

    def broken():
        return spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))

    with pytest.raises(Exception, match="lost"):
        planes.cached(spark, str(tmp_path), "k_s2", broken)
    assert planes.cached(spark, str(tmp_path), "k_s2", make).count() == 5  # what the failed run left is no hit


def point(x, i="1"):
    return f"<Component><CdVec3><double>{x}</double><double>2</double><double>3</double></CdVec3></Component>", f"<Component><int>{i}</int></Component>"


def document(*parts):
    return f'<D><PropertySet Key="StageNavigator">{"".join(parts)}</PropertySet></D>'


def test_reading_is_tolerant(spark):
    name = lambda n: f'<Component><PropertySet><Property ID="{navigator.NAME_SET}"><PropertySet><Property ID="{navigator.NAME}"><wstring>{n}</wstring></Property></PropertySet></Property></PropertySet></Component>'
    array = lambda number, *c: f'<Property ID="{number}">{"".join(c)}</Property>'
    rows = lambda *p: [(r["kind"], r["ordinal"], r["name"], r["x"]) for r in navigator.from_xml(spark, document(*p)).collect()]
    (a, i), (b, j) = point(10, "4"), point(20, "x")
    bad = "<Component><CdVec3><double>u</double></CdVec3></Component>"
    assert rows(array(navigator.POINT_PLACES, a, b)) == [("point", 1, "Position 1", 10.0), ("point", 2, "Position 2", 20.0)]  # no ids
    assert rows(array(navigator.POINT_PLACES, a, b), array(navigator.POINT_IDS, i, j), array(navigator.POINT_NAMES, name("first"), name(""))) == [("point", 1, "first", 10.0), ("point", 2, "Position 2", 20.0)]  # an id that is no number
    assert rows(array(navigator.POINT_PLACES, bad, b), array(navigator.POINT_IDS, i)) == [("point", 2, "Position 2", 20.0)]
    size = "<Component><CdVec2><double>5</double><double>6</double></CdVec2></Component>"
    assert rows(array(navigator.RECT_PLACES, a), array(navigator.RECT_SIZES, size)) == [("rectangle", 1, "Rectangle 1", 10.0)]
    ring = lambda z: f'<Component><PropertySet>{z}<Property ID="{navigator.VERTICES}">{size}{size}{bad}</Property></PropertySet></Component>'
    z = f'<Property ID="{navigator.Z}"><double>oops</double></Property>'
    got = navigator.from_xml(spark, document(array(navigator.POLYGONS, ring(""), ring(z), "<Component/>"))).collect()
    assert [(r["name"], r["z"], len(r["vertices"])) for r in got] == [("Mosaic 1", 0.0, 2), ("Mosaic 2", 0.0, 2)]
    assert rows() == []
    with pytest.raises(ValueError):
        navigator.from_xml(spark, "<D/>")


def test_documents_of_many_images(spark):
    t = catalogue.fixture_plan(spark, SF, points=True, rectangles=True, polygons=True)
    t = tables.with_target_ids(t.select("*", (F.col("ordinal") % 2).cast("int").alias("image_id")))
    docs = navigator.to_documents(t)
    found = {r["image_id"]: r["value"] for r in docs.collect()}
    assert sorted(found) == [0, 1] and all(navigator.problems(x) == [] and ET.fromstring(x) is not None for x in found.values())
    assert navigator.from_documents(docs).count() == t.count()
    with pytest.raises(ValueError):
        navigator.to_documents(t.withColumn("z", F.when(F.col("image_id") == 1, F.lit(float("nan"))).otherwise(F.col("z"))))


def test_percentiles_by_bins(spark):
    rng = np.random.default_rng(0)
    values = [*rng.lognormal(0, 3, 3000), *[2.5] * 2000, *[float("inf")] * 3, float("-inf"), -1e308, 1e308, 5e-324, 1e-323, 0.0]
    rows = [(i % 3, float(x)) for i, x in enumerate(values)] + [(5, 1.0), (6, float("nan")), (6, 1.0), (6, 2.0), (7, None)]
    df = spark.createDataFrame(rows, "image_id int, v double")
    want = {"a": 0.5, "b": 0.998, "c": 0.0, "d": 1.0, "e": 0.3333}
    read = lambda **o: {r["image_id"]: [repr(v) for v in r[1:]] for r in raster.percentiles(df, want, **o).collect()}
    assert read(gather=0) == read() and sorted(read()) == [0, 1, 2, 5, 6]
    assert raster.percentiles(df.where("v is null"), want, gather=0).count() == 0


def test_runs_meet_those_near_them(spark):
    """Two rows of ten thousand runs: pairs are those that touch, and the join makes few more."""
    runs = spark.range(20_000).select(F.lit(0).alias("image_id"), (F.col("id") % 2).alias("y"), (F.floor(F.col("id") / 2) * 3 + F.col("id") % 2 * 2).alias("x0"))
    runs = runs.withColumn("x1", F.col("x0") + 1).withColumn("rid", F.struct("image_id", (F.col("y") * 30_000 + F.col("x0")).alias("p")))
    assert components.touching_runs(runs, 0).count() == 9_999
    assert components.touching_runs(runs, 1).count() == 9_999 + 10_000
    rng = np.random.default_rng(4)
    grid = rng.random((40, 300)) < 0.45
    wide = np.zeros_like(grid)
    wide[5, :] = wide[7, 3:290] = True
    grid |= wide
    mask = spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(grid)], "image_id int, y int, x int")
    for connectivity in (4, 8):
        lab = {(r["y"], r["x"]): r["label"] for r in components.label_components(mask, 300, connectivity).collect()}
        todo, want = set(map(tuple, np.argwhere(grid).tolist())), {}
        steps = [(u, v) for u in (-1, 0, 1) for v in (-1, 0, 1) if (u or v) and (connectivity == 8 or not (u and v))]
        while todo:
            part, edge = [], [todo.pop()]
            while edge:
                y, x = edge.pop()
                part.append((y, x))
                near = {(y + u, x + v) for u, v in steps} & todo
                todo -= near
                edge += near
            least = min(y * 300 + x for y, x in part)
            want |= dict.fromkeys(part, least)
        assert lab == want


def test_images_are_normalised_as_alone(spark):
    m = catalogue.mip(spark, SF).select("image_id", "y", "x", F.col("v").cast("double").alias("v"))
    other = m.select(F.lit(3).alias("image_id"), "y", "x", (F.col("v") * 1.5 + 0.25).alias("v"))
    blank = spark.createDataFrame([(9, 0, 0, 0.0)], "image_id int, y int, x int, v double")
    all_ = {(r["image_id"], r["y"], r["x"]): r["norm"] for r in compose.normalise(m.unionByName(other).unionByName(blank)).collect()}
    for one in (m, other):
        assert all(all_[r["image_id"], r["y"], r["x"]] == r["norm"] for r in compose.normalise(one).collect())
    assert all_[9, 0, 0] == 0.0
    with pytest.raises(ValueError):
        compose.normalise(blank)
    flat = spark.createDataFrame([(1, 0, x, 5.0) for x in range(9)], "image_id int, y int, x int, v double")
    with pytest.raises(Exception, match="flat"):
        compose.normalise(flat).collect()
    fit = compose.signal_histogram(m)
    assert fit["floor"] < fit["threshold"] < fit["upper"]
    rows = compose.histogram_rows(spark, fit)
    assert rows.count() == len(fit["centres"]) and rows.columns == ["intensity", "count", "smoothed_count", "poisson_component", "gaussian_component", "combined_component"]


@pytest.mark.parametrize("output", ["polygon_regions", "rectangular_regions"])
def test_two_images_as_two_plans(spark, output):
    """Images of different transforms, pixel sizes and planes in one plan, as in a plan of each."""
    lab, classes, scales = catalogue.pair(spark, SF)
    p = compose.Planning(output, "xy", "per_roi", "direct", merge_factor=0.5, min_area=2, boundary="hull", simplify_um=0.5)
    key = lambda df: sorted((r["image_id"], r["name"], r["z"], r["x"], r["y"], r["width"], str(r["vertices"])) for r in df.collect())
    both = key(compose.plan_targets(lab, classes, scales, catalogue.PAIR_TILE, p))
    alone = []
    for r in scales.table.collect():
        tr = Affine(r["_a"], r["_b"], r["_tx"], r["_c"], r["_d"], r["_ty"])
        mine = F.col("image_id") == r["image_id"]
        alone += key(compose.plan_targets(lab.where(mine), classes.where(mine), tr, catalogue.PAIR_TILE, p, r["_z0"], r["_z_step"]))
    assert both == sorted(alone) and len({k[0] for k in both}) == 2


def test_a_transform_that_cannot_be_inverted(spark):
    meta = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 8, 8, 0.0, 1.0)], "image_id int, stage_x double, stage_y double, px_x double, px_y double, width int, height int, z0 double, z_step double")
    tiles = spark.createDataFrame([(1, 1, 1, 0.0, 0.0)], "image_id int, id int, ordinal int, center_x double, center_y double")
    px = spark.createDataFrame([(1, 0, 0)], "image_id int, y int, x int")
    with pytest.raises(Exception, match="inverted"):
        compose.covered_pixels(px, tiles, ImageScales.from_overviews(meta), Tile(4, 4, 1.0, 1.0)).collect()


def test_a_review_is_replayed(spark):
    """Against a plain fold of the log, event by event."""
    rng = np.random.default_rng(2)
    objs = [(i, k, int(rng.integers(1, 40)), float(rng.random()), float(rng.random()), float(rng.random() * 50), float(rng.random() * 50)) for i in (1, 2) for k in range(40)]
    o = spark.createDataFrame(objs, "image_id int, label long, area long, elongation double, weighted double, x double, y double")
    kinds, log = ("limits", "delete", "restore", "pin", "count", "cancel"), []
    for seq in range(120):
        kind = str(rng.choice(kinds))
        log.append((int(rng.integers(1, 3)), seq, kind, int(rng.integers(0, 40)), float(rng.integers(1, 9)), float(rng.integers(25, 40)), 0.05, 0.95, None if seq % 2 else 0.1, 12.0, int(rng.integers(5, 20)), str(rng.choice(["area", "confidence"]))))
    done = [(i, 500, "accept", *[None] * 9) for i in (1, 2)]
    schema = "image_id int, seq int, kind string, label long, min_area double, max_area double, min_elongation double, max_elongation double, min_confidence double, max_nn double, n int, rule string"
    frame = lambda rows: spark.createDataFrame(rows, schema).repartition(3)
    got = sorted((r["image_id"], r["label"]) for r in reviews.replay(o, frame(log + done)).collect())
    want = []
    for image in (1, 2):
        limits, gone, pins, count = None, set(), {}, None
        for i, seq, kind, label, *rest in log:
            if i == image:
                limits = rest[:6] if kind == "limits" else limits
                gone = gone | {label} if kind == "delete" else gone - {label} if kind == "restore" else gone
                if kind == "pin":
                    pins.setdefault(label, seq)
                count = rest[6:] if kind == "count" else count
        lo, hi, e0, e1, sure, far = limits
        kept = [r for r in objs if r[0] == image and r[1] not in gone and lo <= r[2] <= hi and e0 <= r[3] <= e1 and (sure is None or r[4] >= sure)]
        near = lambda r: np.mean(sorted(np.hypot(r[5] - q[5], r[6] - q[6]) for q in kept if q is not r)[:3])
        kept = [r for r in kept if near(r) <= far]
        n, rule = count
        kept.sort(key=lambda r: (pins.get(r[1], 999), -(r[2] if rule == "area" else r[4]), r[1]))
        want += [(image, r[1]) for r in kept[:n]]
    assert got == sorted(want) and len(got) > 5
    with pytest.raises(RuntimeError):
        reviews.replay(o, frame(log + done[:1]))
    assert reviews.replay(o, frame(done[:1])).count() == 40  # nothing but accepted: all of that image
