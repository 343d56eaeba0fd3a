import json

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from strataloom import catalogue
from strataloom.functions.geometry import Tile
from strataloom.operators import grouped, models, objects
from strataloom.plans import compose, detectors, modes, preview, tables
from strataloom.sources import fixtures, navigator, plan_files
from strataloom.sources.voxels import VoxelSource
from strataloom.streaming import windows


def test_modes():
    assert modes.parse(None).key == modes.DEFAULT
    for o in modes.OUTPUTS:
        for g in modes.GROUPINGS:
            for z in modes.Z_MODES:
                for t in modes.OPTIMISATIONS:
                    if z == "per_tile" and o != "tile_point_grid":
                        with pytest.raises(ValueError):
                            modes.Mode(o, g, z, t)
                    else:
                        assert modes.parse(modes.Mode(o, g, z, t).key) == modes.Mode(o, g, z, t)
    assert modes.by_label("output", "Polygon mosaics") == "polygon_regions"
    with pytest.raises(ValueError):
        modes.parse("custom:polygons|xy|overview|none")


@pytest.mark.parametrize("output,z,grouping,fewest", [("detection_points", "per_roi", "none", "direct"), ("group_center_points", "overview", "xy", "direct"), ("tile_point_grid", "per_tile", "xy_z", "tile_count"), ("polygon_regions", "per_roi", "xy", "tile_count"), ("rectangular_regions", "per_roi", "none", "direct")])
def test_composed_plans(spark, output, z, grouping, fewest):
    p = compose.Planning(output, grouping, z, fewest, merge_factor=0.15, boundary="alpha_shape" if fewest == "tile_count" else "mask_contour")
    lab = catalogue.labels(spark, SF, 4)
    t = compose.plan_targets(lab, catalogue.classes(spark, SF), catalogue.META, Tile(16, 16, 1.0, 1.0, 0.25), p, z_step=5.0)
    row = tables.validation(tables.with_target_ids(t)).first()
    assert row["targets"] > 0 and row["ids_complete"] and row["finite"]


def test_json_and_xml(spark, tmp_path):
    t = tables.with_target_ids(catalogue.fixture_plan(spark, SF, points=True, rectangles=True, polygons=True))
    text = plan_files.to_json(t, "a.vsi", modes.DEFAULT).first()["value"]
    held = json.loads(text)
    assert sorted(held) == ["overview_metadata", "planning_mode", "point_positions", "polygon_regions", "rectangular_regions", "selected_object_count", "source_image"]
    assert held["overview_metadata"] is None and held["point_positions"][3] == {"x_um": 1021.0, "y_um": 2015.0, "z_um": 115.0, "name": "NATION_3"}
    assert len(held["polygon_regions"][0]["vertices_xy_um"]) == 6 and held["polygon_regions"][0]["name"] == "Mosaic 1"
    xml = navigator.to_xml(t, "plan", corners=[(0.0, 10.0), (20.0, 10.0), (0.0, 0.0)])
    assert navigator.problems(xml) == [] and navigator.overview_box(xml) == (0.0, 0.0, 20.0, 10.0)
    key = lambda d, n: sorted((r["kind"], r[n], r["name"], *map(str, (r["x"], r["y"], r["z"], r["width"], r["height"], r["vertices"]))) for r in d.collect())
    assert key(navigator.from_xml(spark, xml), "ordinal") == key(t, "target_id")
    navigator.save_xml(xml, str(tmp_path / "a.xml"))
    assert (tmp_path / "a.xml").read_bytes()[:2] in (b"\xff\xfe", b"\xfe\xff")
    own = f'<Any><Other a="1"/><PropertySet Key="ParamSetInfo"/><PropertySet Key="StageNavigator"><Property ID="7"><int>5</int></Property><Property ID="{navigator.POINT_IDS}"><PName>kept</PName><int>9</int></Property></PropertySet></Any>'
    kept = navigator.to_xml(t.where("kind = 'point'"), "n", own)
    assert all(x in kept for x in ("<Other", '<Property ID="7">', "<PName>kept", "CPropSet")) and "<int>9</int>" in kept
    assert navigator.problems(kept) == [] and navigator.from_xml(spark, kept).count() == 25 and navigator.overview_box(kept) is None
    assert navigator.problems(xml.replace("<int>30</int>", "<int>31</int>", 1))
    empty = navigator.to_xml(t.where("false"), "none")
    assert navigator.problems(empty) == [] and navigator.from_xml(spark, empty).count() == 0
    with pytest.raises(ValueError):
        navigator.to_xml(t.withColumn("z", t["z"] * float("nan")), "x")
    with pytest.raises(ValueError):
        navigator.to_xml(t, "x", "<Other/>")


def test_quality_rows(spark):
    h = spark.createDataFrame([(1, 0, 2), (1, 1, 5), (1, 2, 5), (2, 0, 0), (2, 1, 0), (2, 2, 0)], "id int, z int, n long")
    names, planes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), spark.createDataFrame([(0, 10.0), (1, 20.0)], "z int, z_um double")
    rows = {(r["region_name"], r["z_index"]): (r["selected_z_index"], r["selected_z_um"], r["pixel_count"], r["z_um"], r["count"]) for r in plan_files.z_rows(h, names, planes, "rectangle").collect()}
    assert rows["a", 1] == (1, 20.0, 12, 20.0, 5) and rows["a", 2] == (1, 20.0, 12, None, 5) and rows["b", 0] == (None, None, 0, 10.0, 0) and len(rows) == 6
    o = spark.createDataFrame([(4, 9, 0.5, 0.5, 3.0, 1.0, 2.0, 0.6, 0.5, 5.4, 1.8)], "label long, area long, elongation double, axis_ratio double, nn double, centroid_x double, centroid_y double, mean double, least double, total double, weighted double")
    at = spark.createDataFrame([(4, "Detected 1", 7.0, 8.0, 9.0)], "label long, name string, x double, y double, z double")
    got = plan_files.object_rows(o, at)
    assert len(got.columns) == 15 and got.first()["source_label"] == 4 and got.first()["x_um"] == 7.0
    c = spark.createDataFrame([("r", 4, 2, 0.5, 0.6, 0.5, 1.2, 0.8)], "name string, area_px long, supported_px long, share double, mean double, least double, total double, weighted double")
    assert plan_files.confidence_rows(c, "polygon").first()["target_type"] == "polygon" and len(plan_files.confidence_rows(c, "polygon").columns) == 9


def test_csv_forms_and_keys(spark, tmp_path):
    t = catalogue.fixture_plan(spark, SF, points=True, rectangles=True, polygons=True)
    assert [plan_files.csv_rows(t, k).count() for k in tables.KINDS] == [25, 5, 25]
    plan_files.csv_rows(t, "point").drop("name").coalesce(1).write.option("header", True).csv(str(tmp_path / "p"))
    assert plan_files.read_points_csv(spark, str(tmp_path / "p")).count() == 25
    assert plan_files.cache_key("a", 0, 1, 2, None, 1.3) == "a_s0_c1_t2_srcpx_auto_px1p3"
    assert plan_files.cache_number(-0.5) == "m0p5"
    assert plan_files.output_prefix("a b.c", {"a_b_c"}) == "a_b_c_2"


def test_review(spark):
    with pytest.raises(RuntimeError):
        compose.review(spark.range(1), catalogue.OBJECT_LIMITS, accepted=False)
    o = catalogue.object_table(spark, SF)
    assert compose.review(o, catalogue.OBJECT_LIMITS, count=5).count() == 5


def test_mixture_fit_finds_the_signal():
    c = np.arange(200) + 0.5
    h = 900 * np.exp(-0.5 * ((c - 20) / 5) ** 2) + 300 * np.exp(-0.5 * ((c - 120) / 15) ** 2)
    assert compose.fit_mixture(c, h, 0.0, 200.0, 110.0)[3] == pytest.approx(120, abs=2)


def test_voxel_source(spark, tmp_path):
    a = np.zeros((3, 4, 5))
    a[1, 2, 3], a[2, 0, 0] = 7, 1
    np.save(tmp_path / "s.npy", a)
    spark.dataSource.register(VoxelSource)
    got = spark.read.format("voxels").option("paths", str(tmp_path / "s.npy")).load().collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 3, 7.0), (0, 2, 0, 0, 1.0)]


def test_streams(spark, tmp_path):
    fixtures.stack(spark, SF).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("image_id int, z int, y int, x int, v long").parquet(str(tmp_path / "in"))
    q = windows.running_projection(src).writeStream.format("memory").queryName("mip").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = catalogue.mip(spark, SF).select("image_id", "y", "x", "v", "argmax_z")
    assert spark.table("mip").exceptAll(want).count() == 0 and spark.table("mip").count() == want.count()
    assert windows.windowed_histogram(fixtures.table(spark, SF, "events"), 0.0, 100.0, 10).count() > 0


def test_region_z_uses_all_pixels_under_its_tiles(spark):
    found = spark.createDataFrame([(1, 100.0), (2, 100.0)], "id long, z double")
    tiles = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 1, 50.0, 50.0)], "id long, ordinal long, center_x double, center_y double")
    px = spark.createDataFrame([(5, 5, 3, 1), (5, 6, 3, 2), (6, 6, 1, 1), (4, 4, 0, 0)], "y int, x int, argmax_z int, cls int")
    tr = compose.Affine(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    out = compose.with_region_z(found, tiles, px, tr, Tile(4, 4, 1.0, 1.0, 0.0), compose.Planning(), 100.0, 5.0)
    assert {r["id"]: r["z"] for r in out.collect()} == {1: 115.0, 2: 100.0}
    with pytest.raises(ValueError):
        compose.Planning(boundary="circle")


def test_detectors(spark):
    px = spark.createDataFrame([(0, y, x, 9.0 if (x // 4) % 2 and (y // 4) % 2 else 1.0) for y in range(16) for x in range(16)], "image_id int, y int, x int, v double")
    ctx = detectors.Context(16, 16, 2.0, 2.0)
    found = detectors.ThresholdDetector(absolute=5.0, limits=objects.Limits(min_area=3)).detect(px, ctx)
    assert [(r["label"], r["area"], r["nn"]) for r in found.objects.orderBy("label").collect()] == [(i, 16, pytest.approx((16 + 16 + 16 * 2**0.5) / 3)) for i in (68, 76, 196, 204)]
    assert found.labels.count() == 64 and {r["cls"] for r in found.planning_classes.collect()} == {1}
    assert detectors.ThresholdDetector(absolute=5.0, limits=objects.Limits(min_area=3), count=1).detect(px, ctx).labels.count() == 16
    picked = detectors.Context(16, 16, choose=lambda o: o.where("label > 100"))
    assert detectors.ThresholdDetector(absolute=5.0, limits=objects.Limits(min_area=3)).detect(px, picked).objects.count() == 2
    assert detectors.ThresholdDetector(absolute=50.0).detect(px, ctx).objects.count() == 0
    f = grouped.tiled_features(px, 16, 16, (0.5,), 8, 2).join(px, ["image_id", "y", "x"]).select("image_id", "y", "x", "f", (F.col("v") > 5).cast("int").alias("cls"))
    forest = detectors.ClassifierDetector(models.fit_forest(f, trees=5), 1, (0.5,), 8, 2, limits=objects.Limits(min_area=3))
    got = forest.detect(px, ctx)
    assert got.objects.count() == 4 and got.classes.count() == 256 and got.planning_classes is got.classes


def test_preview(spark):
    t = catalogue.fixture_plan(spark, SF, points=True, rectangles=True)
    tiles = preview.tiles(t, catalogue.TILE)
    assert tiles.where("kind = 'point'").count() == 25 and tiles.where("kind = 'rectangle'").select("ordinal").distinct().count() == 5
    e = preview.extent(tiles.where("kind = 'point'"), catalogue.TILE).first()
    assert (e["min_x"], e["max_x"]) == (1000.0 - 7.5, 1000.0 + 7 * 24 + 7.5)
    assert preview.totals(t.where("false"), catalogue.TILE).count() == 0
