import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF

from strataloom.llm import queries, toxicity

DOC = "doc_id long, text string, lang string, source string, score string, held_out string, toxic string, hash string"
LABEL = "doc_id long, quality int, toxic int, text string"


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=300, seed=3):
    """Made-up texts; every fourth has forms of two stems that the others don't have."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["ba", "ne", "ti", "lor", "um", "ka"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["grunz", "wopf"]) + rng.choice(vocab)
        rows.append((i, " ".join(w), "en", "s", "x", "y", "z", "h"))
        labels.append((i, 0, int(i % 4 == 0), "t"))
    return rows, labels


@pytest.fixture(scope="module")
def small(spark):
    rows, labels = corpus()
    return rows, labels, spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)


def plain_ratios(texts, words):
    """Log-likelihood ratios by plain dictionaries of strings: counts of words by text, discounts, shared backoff."""
    count = defaultdict(lambda: [0, 0])
    for text, toxic in sorted(set(texts)):
        for w in set(toxicity.WORD.findall(text.lower())):
            w = "<" + w + ">"
            for k in range(1, toxicity.ORDER + 1):
                for i in range(max(1, k - 1), len(w)):
                    count[k, w[i - k + 1 : i + 1]][toxic] += 1
    after = defaultdict(list)
    for (k, g), c in count.items():
        after[k, g[:-1]].append(c)
    discount = {}
    for k in range(1, toxicity.ORDER + 1):
        sizes = [sum(c) for (j, _), c in count.items() if j == k]
        n1, n2 = sizes.count(1), sizes.count(2)
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = []
    for w in words:
        total, w = 0.0, "<" + w + ">"
        for i in range(1, len(w)):
            p = shared = [1 / toxicity.ALPHABET] * 2
            for k in range(1, min(toxicity.ORDER, i + 1) + 1):
                g = w[i - k + 1 : i + 1]
                cs, c, d = after[k, g[:-1]], count.get((k, g), [0, 0]), discount[k]
                if not cs:
                    continue
                both = (max(sum(c) - d, 0) + d * len(cs) * shared[0]) / sum(map(sum, cs))
                p = [(max(c[j] - d, 0) + (d * sum(x[j] > 0 for x in cs) + toxicity.SHARED) * both) / (sum(x[j] for x in cs) + toxicity.SHARED) for j in (0, 1)]
                shared = [both] * 2
            total += math.log(p[1] / p[0])
        out.append(total)
    return out


def test_ratios_equal_plain_counts(small):
    rows, labels, docs, marks = small
    model, _ = toxicity.fit(docs, marks)
    learnt = [(r[1], lab[2]) for r, lab in zip(rows, labels, strict=True) if not is_held(r[0])]
    words = ["grunzba", "wopf", "netilor", "unseen", "x", "日本", "a" * 24, *toxicity.WORD.findall(rows[5][1])]
    assert toxicity.Model(*model).ratios(words) == pytest.approx(plain_ratios(learnt, words), abs=1e-4)


def test_held_out_texts_are_told_apart(small):
    rows, labels, docs, marks = small
    out = {r["doc_id"]: r for r in toxicity.score(docs, marks).collect()}
    assert len(out) == len(rows)
    held = [i for i in out if out[i]["held_out"]]
    assert sorted(held) == [i for i in range(len(rows)) if is_held(i)]
    assert all(out[i]["predicted"] == int(out[i]["score"] >= 0.5) for i in out)
    assert np.mean([out[i]["predicted"] == labels[i][2] for i in held]) >= 0.95
    assert toxicity.score(docs.limit(0), marks).count() == 0


def test_given_labels_held_out(spark):
    out = queries.op11_toxicity(spark, SF.replace("sf0.001", "sf0.01")).toPandas()
    labels = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/labels.parquet").toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all()
    held = out.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.toxic).mean() >= 0.9


def test_no_input_but_the_text(spark, small):
    """Ids, languages, sources and labels of scored rows change nothing; a rerun over other partitions agrees."""
    rows, labels, docs, marks = small
    extra = [(1000 + r[0], r[1], "de", "other", "x", "y", "z", "h") for r in rows]
    out = toxicity.score(spark.createDataFrame(rows + extra, DOC).repartition(7), marks).collect()
    by = {r["doc_id"]: r["score"] for r in out}
    first = {r["doc_id"]: r["score"] for r in toxicity.score(docs, marks).collect()}
    assert [by[r[0]] for r in rows] == pytest.approx([first[r[0]] for r in rows], abs=1e-6)
    assert [by[1000 + r[0]] for r in rows] == pytest.approx([by[r[0]] for r in rows], abs=1e-6)


def test_odd_rows(spark, small):
    rows, labels, *_ = small
    long = "ne ti um " * 60_000
    odd = [(900, None), (901, ""), (902, " \n.. "), (None, "grunzba"), (903, long), (903, "twice"), (903, "twice"), (904, long + " grunzti wopfba"), (905, "X" * 200_000)]
    more = [(i, t, None, None, None, None, None, None) for i, t in odd]
    marks = [*labels, (900, None, 1, None), (903, 0, None, "t"), (904, 0, 7, "t"), (None, 1, 1, "t"), (5, 0, 1, "t"), (5, 0, 0, "t")]
    out = toxicity.score(spark.createDataFrame(rows + more, DOC), spark.createDataFrame(marks, LABEL)).collect()
    assert len(out) == len(rows) + len(odd)
    assert all(0 <= r["score"] <= 1 for r in out)
    empty = [r["score"] for r in out if r["doc_id"] in (900, 901, 902)]
    assert len(set(empty)) == 1 and empty[0] < 0.5
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    clean, toxic = (next(r["score"] for r in out if r["doc_id"] == i and r["score"] is not None) for i in (903, 904))
    assert toxic > 0.5 > min(r["score"] for r in out if r["doc_id"] == 903) and clean is not None


def test_without_a_class(spark, small):
    rows, labels, docs, _ = small
    assert {r["score"] for r in toxicity.score(docs, spark.createDataFrame([], LABEL)).collect()} == {0.0}
    one = toxicity.score(docs, spark.createDataFrame([x for x in labels if x[2]], LABEL)).collect()
    assert {(r["score"], r["predicted"]) for r in one} == {(1.0, 1)}
