import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import outliers


def vectors(spark, seed, sizes):
    rng, rows = np.random.default_rng(seed), []
    for g, n in sizes.items():
        mix = rng.normal(size=(5, 5)) * 40
        x = rng.normal(size=(n, 5)) @ mix + rng.normal(size=5) * 200
        x[: n // 8] += np.asarray([900, -700, 800, 0, 600])
        rows += [(g, *(int(round(v)) for v in r), 40, 40, 40) for r in x]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"v{i} long" for i in range(5)) + ", e2 long, e3 long, e4 long")


def step(x, centre, cov):
    """One concentration step in numpy: the nearest SHARE by whole distance bins, as the operator has it."""
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    bins = np.floor(np.log1p(d) * 64)
    near = x[bins <= np.sort(bins)[int(np.ceil(len(x) * outliers.SHARE)) - 1]]
    return estimate(near, outliers.CONSISTENCY)


def estimate(x, factor):
    scale = outliers.SCALE**2
    c = (x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0))) * factor + np.diag(outliers.PRIOR) * outliers.PRIOR_ROWS * scale / len(x)
    return x.mean(0), whole(c)


def whole(c):
    floors = [*(v * outliers.SCALE**2 for v in outliers.LEAST_SPREAD), *(min(40 * outliers.EVENT, m * outliers.SCALE**2) for m in outliers.MOST_EVENT)]
    return c + np.diag(np.diag(c)) * outliers.RIDGE + np.diag(floors)


def quantile(v, q):
    return float(np.sort(v)[max(int(np.ceil(len(v) * q)) - 1, 0)])


def converged(x):
    med = np.asarray([quantile(v, 0.5) for v in x.T])
    spread = np.asarray([((quantile(v, 0.75) - quantile(v, 0.25)) / 1.35) ** 2 for v in x.T])
    starts = [(med, whole(np.diag(spread))), (med, whole(np.eye(5) * spread.mean())), estimate(x, 1.0)]
    for _ in range(outliers.FIRST_STEPS):
        starts = [step(x, *s) for s in starts]
    best = min(starts, key=lambda s: np.linalg.det(s[1]))
    while True:
        new = step(x, *best)
        if not np.log(np.linalg.det(new[1])) / 2 < np.log(np.linalg.det(best[1])) / 2 - 1e-6:
            return best
        best = new


def test_distances_equal_plain_concentration_steps(spark):
    d = vectors(spark, 4, {"a": 400, "b": 60, "c": 1, "d": 7})
    got = outliers.robust_distances(d).toPandas()
    for g, rows in got.groupby("g"):
        x = rows[[f"v{i}" for i in range(5)]].to_numpy(float)
        centre, cov = converged(x)
        want = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        assert rows.d2.to_numpy() == pytest.approx(want, rel=1e-4, abs=1e-6)
        if len(x) > 50:
            assert (rows.d2 > outliers.CUTOFF).sum() == pytest.approx(len(x) // 8, abs=2)


def test_few_documents_are_judged_too(spark):
    text = lambda i: " ".join(f"word{(i * 37 + k * k) % 997}" for k in range(80))
    rows = [(i, text(i), "en", "a") for i in range(9)] + [(9, " ".join(w + "#" * 40 for w in text(9).split()), "en", "a")]
    out = {r["doc_id"]: r for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i]["kept"] for i in range(9)) and all(r["distance2"] is not None for r in out.values())
    alone = outliers.judge(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string, source string")).first()
    assert alone["kept"] and alone["distance2"] == 0


def test_very_long_text(spark):
    words = 200_000
    text = "\n".join(" ".join(f"w{(i * 7919 + j) % 50021}x{i % 13}" for j in range(10)) for i in range(words // 10))
    r = outliers.base_rules(spark.createDataFrame([(1, text, "en", "a")], "doc_id long, text string, lang string, source string")).select("n_words", F.col("n_dup_lines")).first()
    assert r["n_words"] == words
