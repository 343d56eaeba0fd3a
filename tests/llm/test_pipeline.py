import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_near import classes

from strataloom.llm import language_id, queries
from strataloom.llm.common import WORD_RE, materialize

STRIP = " \t\n\x0b\f\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        found.append((name, docs))
    return dict(found)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns_stay(stages):
    for name, df in stages.items():
        if name != "packing":
            assert df.columns == stages["documents"].columns


def test_language_stage_keeps_the_certain(stages, spark):
    docs = stages["documents"]
    model = language_id.fit(language_id.learnable(docs))
    lang, score = model.predict([r["text"] for r in rows(docs)])
    want = {r["doc_id"] for r, x, s in zip(rows(docs), lang, score) if x != "und" and s >= corpus_pipeline.LEAST_SCORE}
    assert {r["doc_id"] for r in rows(stages["language_id"])} == want


def test_line_stage_equals_brute_force(stages):
    docs = rows(stages["language_id"])
    key = lambda x: x.strip(STRIP).translate(LOW)
    holders = defaultdict(set)
    for r in docs:
        for x in (r["text"] or "").split("\n"):
            holders[key(x)].add(r["doc_id"])
    gone = lambda x, d: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and d < max(holders[key(x)])
    want = {r["doc_id"]: "\n".join(x for x in (r["text"] or "").split("\n") if not gone(x, r["doc_id"])) for r in docs}
    got = rows(stages["line_dedup"])
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_near_stage_equals_brute_force(stages):
    docs = [(r["doc_id"], r["text"]) for r in rows(stages["line_dedup"])]
    least, _ = classes(docs)
    got = [r["doc_id"] for r in rows(stages["near_dedup"])]
    assert sorted(got) == sorted(i for i, c in least.items() if i == c)


def test_mix_stage_meets_targets_with_whole_documents(stages):
    import re

    size = {r["doc_id"]: (r["source"], len(re.findall(WORD_RE, r["text"] or ""))) for r in rows(stages["near_dedup"])}
    by = Counter()
    for s, n in size.values():
        by[s] += n
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(by, key=lambda s: (s is None, s)))}
    target, open_ = {s: 3 * n for s, n in by.items()}, set(by)
    while open_:
        left = sum(by.values()) - sum(target[s] for s in by if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by[s]}
        if not over:
            target |= share
            break
        open_ -= over
    taken, copies = Counter(), Counter(r["doc_id"] for r in rows(stages["mixing"]))
    for d, n in copies.items():
        taken[size[d][0]] += n * size[d][1]
        assert n <= 3
    for s in by:
        whole = {n for d, n in copies.items() if size[d][0] == s and size[d][1]}
        assert len(whole | ({0} if any(size[d][0] == s and d not in copies for d in size) else set())) <= 2
        assert abs(taken[s] - target[s]) <= max(n for x, n in size.values() if x == s)


def test_packing_stage_holds_all_ids(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    pieces = rows(stages["packing"])
    want = Counter()
    texts = {r["doc_id"]: r["text"] or "" for r in rows(stages["near_dedup"])}
    ids = {d: np.asarray([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    for r in rows(stages["mixing"]):
        want[r["doc_id"]] += len(ids[r["doc_id"]])
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    assert got == want
    at = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at[p["sequence_id"]]
        at[p["sequence_id"]] += p["length"]
    assert set(at) == set(range(len(at))) and all(n == 2048 for s, n in at.items() if s != max(at))


def test_run_equals_its_stages(stages, spark):
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"].count()


def test_empty_and_unlabelled_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for d in (docs.limit(0), docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")):
        d = d.select(docs.columns)
        for name, stage in corpus_pipeline.STAGES:
            d = materialize(stage(spark, d, SF), name)
            assert d.count() == 0


def test_clashing_columns_stay(spark):
    """Columns of the input that are named like a stage's results come out as they went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    own = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in ("score", "lang_pred", "kept", "n_lines", "Size", "node", "part")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, SF)
        assert out.columns == own.columns, name
        rows = out.select("doc_id", "score", "lang_pred", "kept", "n_lines", "Size").collect()
        assert rows and all(r[k] == f"{c}-{r['doc_id']}" for r in rows for k, c in enumerate(("score", "lang_pred", "kept", "n_lines", "Size"), 1)), name
