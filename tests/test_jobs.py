import json
import os
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from conftest import ROOT, SF, same_rows
from pyspark.sql import functions as F

from jobs import batch_targets, common, name_register, registered
from strataloom.operators import naming, raster

NOTE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query_equals_sql(spark, duck, name):
    settings = lambda: {k: v for k, v in dict(spark.conf.getAll).items() if not k.startswith(("spark.app", "spark.sql.warehouse"))}
    before = settings()
    same_rows(registered.QUERIES[name](spark, SF), duck.sql(registered.ORACLE_SQL[name]))
    assert settings() == before


def test_batch_targets_reruns_and_parts(spark, tmp_path):
    out, paths = str(tmp_path / "out"), (f"{SF}/lineitem.parquet", f"{SF}/supplier.parquet")
    table = lambda n: sorted(map(tuple, spark.read.parquet(f"{out}/{n}").select("image_id", "nation", *(["label", "area"] if n == "objects" else ["ordinal", "x", "y", "z"])).collect()))
    done = batch_targets.run(spark, *paths, out)
    first = {n: table(n) for n in ("objects", "targets")}
    assert done["images read"] == 10 and done["targets written"] == len(first["targets"]) == done["objects written"] == len(first["objects"]) > 0
    nation = first["targets"][0][1]
    part = batch_targets.run(spark, *paths, out, {"nations": [nation]})  # replaces that nation's partition alone
    assert part["targets written"] == sum(r[1] == nation for r in first["targets"])
    assert {n: table(n) for n in first} == first
    fewer = batch_targets.run(spark, *paths, str(tmp_path / "large"), {"min_area": 4})
    assert fewer["targets written"] < done["targets written"]
    assert batch_targets.run(spark, *paths, str(tmp_path / "none"), {"nations": [999]})["images read"] == 0


def test_projection_shuffles_once_and_sorts_nothing(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    mip = raster.project_max(batch_targets.voxels(lines, 32))
    plan = mip._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan
    long = 2**63 - 1
    rows = [(0, 1, 0, 0, 5), (0, 4, 0, 0, 5), (0, 0, 0, 0, -9), (0, 2, 0, 1, long), (0, 0, 0, 1, long - 1), (0, 3, 0, 2, -long - 1), (0, 1, 0, 2, None), (0, -2, 0, 3, -7), (0, 5, 0, 3, -7), (0, 6, 0, 4, None)]
    got = {r["x"]: (r["v"], r["argmax_z"]) for r in raster.project_max(spark.createDataFrame(rows, "image_id int, z int, y int, x int, v long")).collect()}
    assert got == {0: (5, 1), 1: (long, 2), 2: (-long - 1, 3), 3: (-7, -2), 4: (None, 6)}


def test_two_images_as_two_runs(spark, tmp_path):
    """One run over images of different transforms gives what runs over each alone give."""
    paths = (f"{SF}/lineitem.parquet", f"{SF}/supplier.parquet")
    nations = [r[0] for r in spark.read.parquet(paths[1]).select("s_nationkey").distinct().orderBy("s_nationkey").limit(2).collect()]
    read = lambda o: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{o}/targets").select("image_id", "x", "y", "z").collect()))
    batch_targets.run(spark, *paths, f"{tmp_path}/both", {"nations": nations, "output": "tile_point_grid"})
    for n in nations:
        batch_targets.run(spark, *paths, f"{tmp_path}/{n}", {"nations": [n], "output": "tile_point_grid"})
    assert read("both") == sorted(sum((read(n) for n in nations), []))


def test_register_takes_what_is_new(spark, tmp_path):
    notes, out, mark = (str(tmp_path / n) for n in ("notes.parquet", "out", "mark"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    add = lambda df: df.coalesce(1).write.mode("append").parquet(notes)
    rows = lambda: {r["doc_id"]: (r["prefix"], r["batch"]) for r in name_register.register(spark, out).collect()}
    add(docs.where("doc_id % 2 = 0"))
    assert name_register.run(spark, notes, out, mark) == {"notes read": 100, "batches": 1, "names written": 100}
    first = rows()
    add(docs.where("doc_id % 2 = 1"))
    assert name_register.run(spark, notes, out, mark)["notes read"] == 100
    both = rows()
    assert len(both) == 200 and {d: both[d] for d in first} == first and {b for _, b in both.values()} == {0, 1}
    assert len({p for p, _ in both.values()}) == 200
    assert name_register.run(spark, notes, out, mark) == {"notes read": 0, "batches": 0, "names written": 0}
    assert rows() == both
    # a batch that failed after its writing and runs again gives the same names
    assert name_register.name_batch(docs.where("doc_id % 2 = 1"), 1, out, 32) == 100
    assert rows() == both
    # several batches in one run, of files in order
    small = name_register.run(spark, notes, str(tmp_path / "small"), str(tmp_path / "mark2"), {"files_a_batch": 1})
    assert small == {"notes read": 200, "batches": 2, "names written": 200}


def test_names(spark):
    texts = ["Mouse 1\nmore", "Mouse 1", "Mouse_1", "Mouse", "Mouse", "été-2 µm", "", None, " \n x", "a/b:c", "x" * 50, "Mouse_1_2", "日本"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(naming.stem(F.col("t"))).collect()]
    assert got == ["Mouse_1", "Mouse_1", "Mouse_1", "Mouse", "Mouse", "été-2_µm", "output", "output", "output", "a_b_c", "x" * 32, "Mouse_1_2", "日本"]


def test_numbering_equals_plain(spark):
    """A stem that most rows have, over several blocks, with nulls, ties and numbers that were used before."""
    ids = [i * 1000 for i in range(400)] * 2 + [None, None]
    rows = [(("hot" if i % 3 else f"s{i % 5}_{i % 2}"), d, i) for i, d in enumerate(ids)]
    used = [("hot", 41), ("hot", 7), ("s0_0", 3), ("gone", 9)]
    out = naming.numbered(spark.createDataFrame(rows, "stem string, id long, tie long"), "id", spark.createDataFrame(used, "stem string, number long")).collect()
    by = defaultdict(list)
    for s, d, t in rows:
        by[s].append(((d is not None, d or 0), t))
    start = Counter({"hot": 41, "s0_0": 3})
    want = {t: (s, n) for s, xs in by.items() for n, (_, t) in enumerate(sorted(xs), start[s] + 1)}
    assert {r["tie"]: (r["stem"], r["number"]) for r in out} == want
    assert len({r["prefix"] for r in out}) == len(rows)
    assert all(r["prefix"] == f"{r['stem']}_{r['number']}" for r in out if r["number"] > 1 or r["stem"][0] == "s")


def test_settings_and_command_line(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"min_area": 3}))
    assert common.read_config(spark, str(tmp_path / "c.json"), batch_targets.DEFAULTS) == batch_targets.DEFAULTS | {"min_area": 3}
    with pytest.raises(ValueError):
        common.read_config(spark, f"{ROOT}/jobs/name_register.json", batch_targets.DEFAULTS)
    assert common.read_config(spark, f"{ROOT}/jobs/batch_targets.json", batch_targets.DEFAULTS) == batch_targets.DEFAULTS
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    cmd = [sys.executable, "-m", "jobs.name_register", "--notes", f"{SF}/documents.parquet", "--out", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/k", "--config", f"{ROOT}/jobs/name_register.json"]
    ran = subprocess.run(cmd, cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and "'notes read': 200" in ran.stderr, ran.stderr[-2000:]
    assert name_register.register(spark, f"{tmp_path}/o").count() == 200
