import math
import random

import pytest
from conftest import SF, same_rows

from strataloom.llm import hard_negatives, queries

VEC = "vec_id long, embedding array<float>, label int, row string, block string, score string, pivot string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VEC)


def plain(rows):
    """All products of all pairs."""
    used = []
    for r, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((r, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    late = lambda i: (i is None, i or 0)
    out = []
    for r, i, label, q in used:
        if i is None or i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x, strict=False)), late(j), j, m == label) for s, j, m, x in used if s != r]
        scored.sort(key=lambda t: t[:2])
        for s, _, j, same in [t for t in scored if t[3]][:5]:
            fit = [t for t in scored if not t[3] and 50 * -s <= 100 * -t[0] <= 95 * -s]
            out += [(i, j, k, n, -s, -t) for k, (t, _, n, _) in enumerate(fit[:3], 1)]
    return sorted(out, key=str)


def mined(df):
    return sorted([tuple(r) for r in hard_negatives.mine(df).collect()], key=str)


@pytest.fixture(scope="module")
def clustered():
    """Tight clusters far apart, so that most blocks need no scan, and a third of all rows near one point."""
    rng = random.Random(1)
    centres = [[rng.gauss(0, 2) for _ in range(6)] for _ in range(30)]
    rows = []
    for i in range(4000):
        c = centres[0] if i % 3 == 0 else rng.choice(centres)
        rows.append((i, [round(x + rng.gauss(0, 0.05), 3) for x in c], rng.randrange(4)))
    rows += [(i, centres[0], i % 3) for i in range(5000, 5300)]  # exact copies: ties
    rows += [(6000, [9.0] * 6, 77), (6050, [8.0] * 6, 77), (7001, [1.0] * 6, 99)]  # labels of two rows and of one
    rng.shuffle(rows)
    return rows


def test_equals_brute_force_on_clusters(spark, clustered):
    assert mined(frame(spark, clustered)) == plain(clustered)


def test_blocks_hold_each_row_once(spark, clustered):
    index = hard_negatives.Index(frame(spark, clustered))
    assert index.n_blocks > 20
    packed = index.blocks.selectExpr("sum(size(row)) AS n", "max(size(row)) AS most", "sum(int(low > high)) AS bad").first()
    assert (packed["n"], packed["bad"]) == (len(clustered), 0) and packed["most"] <= hard_negatives.BLOCK
    index.drop()


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], i % 3) for i in range(120)]
    rows += [(200, None, 1), (250, [1.0] * 5, None), (300, [1.0, None, 0.0, 0.0, 0.0], 1), (350, [1.0, float("nan"), 0.0, 0.0, 0.0], 1), (400, [float("inf")] * 5, 1)]
    rows += [(450, [0.0] * 5, 2), (500, [], 0), (550, [0.5, 0.5], 1), (None, [0.9] * 5, 1), (None, [0.8] * 5, 0), (600, [-0.0, 0.25, -0.001, 0.1, 0.7], -4)]
    rows += [(50, [0.3, 0.1, 0.9, 0.2, 0.4], 1), (50, [0.3, 0.1, 0.9, 0.2, 0.4], 1), (51, [0.3, 0.1, 0.9, 0.2, 0.4], 0), (51, [0.3, 0.1, 0.9, 0.2, 0.4], 0)]
    assert mined(frame(spark, rows)) == plain(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**24 + 2 * i), float(2**20 - i), 1.0], i % 2) for i in range(0, 220, 5)]
    assert mined(frame(spark, rows)) == plain(rows)
    wide = [(i, [2.0**22 * (1 + i / 64), float(i % 5)], i % 2) for i in range(110)]
    assert mined(frame(spark, wide)) == plain(wide) != []


def test_nothing_to_mine(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []  # no anchor
    assert mined(frame(spark, [(50, [1.0], 1)])) == []
    assert mined(frame(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, [-1.0], 2)])) == []  # no negative in the range
    assert mined(frame(spark, [(50, [0.0], 1), (51, [1.0], 1), (52, [3.0], 2)])) == [(50, 51, 1, 52, 0, 0)]


def test_query_equals_sql(spark, duck):
    same_rows(queries.op12_hard_negatives(spark, SF), duck.sql(hard_negatives.ORACLE_SQL))
