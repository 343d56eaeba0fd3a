import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from strataloom.llm import common, near_dups


def classes(rows):
    """Brute force: the least id of all that links of 0.8 reach, from exact similarities of every pair that shares a shingle."""
    full = [(i, t) for i, t in rows if (t or "").strip(common.WS_CHARS)]
    text_of, value, weight, _, _ = near_dups.shingles(*common.raw_text(pa.array([t for _, t in full], pa.string())))
    cuts = np.searchsorted(text_of, np.arange(len(full) + 1))
    sets = [(value[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    head = {i: i for i, _ in rows}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    holders = defaultdict(list)
    for k, v in zip(text_of.tolist(), value.tolist()):
        holders[v].append(k)
    pairs = {(a, b) for ks in holders.values() for n, a in enumerate(ks) for b in ks[n + 1 :]}
    links = 0
    for a, b in pairs:
        if near_dups.similarity(sets[a], sets[b]) >= 0.8:
            links += 1
            x, y = sorted((find(full[a][0]), find(full[b][0])))
            head[y] = x
    return {i: find(i) for i, _ in rows}, links


def test_no_link_is_lost_on_the_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, links = classes([tuple(r) for r in d.collect()])
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(d).collect()}
    assert links > 50 and got == want


def test_blocks_within_buckets_lose_no_link(spark, monkeypatch):
    """Chains of near copies whose ends are alike no more share buckets with several components."""
    rng = random.Random(2)
    rows, n = [], 0
    for _ in range(6):
        w = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
        for _ in range(25):
            for k in rng.sample(range(120), 3):
                w[k] = f"x{rng.randint(0, 9999)}"
            rows.append((n, " ".join(w)))
            n += 1
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    want, _ = classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_one_row_of_each_class_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (1, a), (2, a + " more"), (None, b), (None, b), (None, b + " more"), (None, c), (5, c), (3, None), (3, None), (4, b + " more words")]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in near_dups.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["text"])
    assert got == [(1, a), (4, b + " more words"), (5, c)]
    blank = near_dups.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).where("text is null").count()
    assert blank == 2


def test_very_long_text(spark):
    rng = random.Random(4)
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[100:])), (3, " ".join(reversed(w)))]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
