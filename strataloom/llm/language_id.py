"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased letters, with runs of anything else as one space.
Document frequencies come from all documents that may be learnt from. The classifier is trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample (``SAMPLE`` documents at
most, dealt evenly to the languages), and a temperature fitted on the part of the sample that training
did not see calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, mix64, text_chunks

BITS = 15
DIM = 1 << BITS
#: Bounds of what the driver gathers to train on: the expected number of documents, and the bytes of their n-grams, all
#: of each document, 8 for each. Where these would be more, fewer documents are drawn.
SAMPLE, SAMPLE_BYTES = 2400, 80 << 20
#: The languages that are learnt are the commonest values, as many as this; weights take 262 kB for each.
LANGUAGES = 256
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 2e-3, 1e-3
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts: (text index, feature, count), sorted by text and feature."""
    pad = "   "  # no n-gram reaches from one text into the next
    codes = np.frombuffer((pad.join(t.lower() for t in texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t.lower()) + len(pad) for t in texts), np.int64, len(texts))
    text_of = np.repeat(np.arange(len(texts)), size)
    letter = _letter_table()[codes]
    keep = letter.copy()  # of each run of other characters, the first one stays, as a space
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    doc, real = text_of[keep], letter[keep]
    out = []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + c[n - 1 :]
        ok = doc[:m] == doc[n - 1 :]
        ok &= real[:m] | (real[1 : m + 1] if n > 1 else False)
        f = (mix64(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        out.append((doc[:m][ok] << BITS) | f[ok])
    key, count = np.unique(np.concatenate(out), return_counts=True) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return key >> BITS, key & (DIM - 1), count


def tfidf(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text: log counts by inverse document frequency, of unit length."""
    doc, feature, count = grams(texts)
    value = np.log1p(count) * idf[feature]
    norm = np.sqrt(np.bincount(doc, value * value, len(texts)))
    value = value / np.maximum(norm, 1e-12)[doc]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(feature[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> np.ndarray:
    """FTRL-proximal weights (DIM + 1, classes); the last row is the bias, without penalties."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    l1 = np.full(DIM + 1, L1)
    l1[DIM] = 0

    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i][:, None], 0.0, -(z[i] - np.sign(z[i]) * l1[i][:, None]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            i = np.append(rows[r][0], DIM)
            x = np.append(rows[r][1], 1.0)
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[r]] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[i] + g * g)
            z[i] += g - (root - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(DIM + 1))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The factor on the scores that makes held-back labels likeliest, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        s = scores * np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]))

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        x, y = b - g * (b - a), a + g * (b - a)
        a, b = (a, y) if loss(x) < loss(y) else (x, b)
    return float(np.exp((a + b) / 2))


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, scale: float):
        self.languages, self.idf, self.weights, self.scale = languages, idf, weights.astype(np.float32), scale

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [t or "" for t in texts]
        out, score = [], []
        for f, v in tfidf(plain, self.idf):
            if not len(f) or not self.languages:
                out.append(UNKNOWN)
                score.append(0.0)
                continue
            s = (v.astype(np.float32) @ self.weights[f] + self.weights[DIM]) * self.scale
            p = np.exp(s - s.max())
            k = int(p.argmax())
            out.append(self.languages[k])
            score.append(float(p[k] / p.sum()))
        return out, score


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model from the rows of ``docs`` (doc_id, text, lang) with a non-null lang and text. Languages are
    the values of lang. Without any such row the model knows no language."""
    good = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, langs = np.zeros(DIM, np.int64), {}
        for b in text_chunks(batches, 1):
            _, feature, _ = grams(b.column(1).to_pylist())
            df += np.bincount(feature, minlength=DIM)
            for x in b.column(2).to_pylist():
                langs[x] = langs.get(x, 0) + 1
        some = np.flatnonzero(df)
        n = len(langs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * len(some) + list(langs), pa.string()), pa.array([*some.tolist(), *[None] * n], pa.int32()), pa.array([*df[some].tolist(), *langs.values()], pa.int64())],
            ["lang", "feature", "n"],
        )

    # at most DIM rows and one for each of the languages come back, whatever the corpus holds
    counted = good.mapInArrow(frequencies, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "frequencies")
    df = np.zeros(DIM)
    for r in counted.where(F.col("feature").isNotNull()).collect():
        df[r["feature"]] = r["n"]
    common = counted.where(F.col("feature").isNull()).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    languages = {r["lang"]: r["n"] for r in common}
    discard(counted)
    total = sum(languages.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    names = sorted(languages)
    if not names:
        return LanguageModel([], idf, np.zeros((DIM + 1, 1)), 1.0)

    # a seeded share of each language: even shares of the sample, or all its documents where they are fewer
    share = F.create_map(*[F.lit(y) for x in names for y in (x, min(1.0, sample / len(names) / languages[x]))])
    text = F.xxhash64("text")
    drawn = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)) / F.element_at(share, F.col("lang"))
    # keys first, so that repeated rows count once and the number is bounded whatever the hashes
    keys = good.withColumn("drawn", drawn).where("drawn < 1").select("doc_id", text.alias("hash"), "drawn").distinct().orderBy("drawn", "hash", "doc_id").limit(2 * sample)
    same = F.coalesce(F.col("doc_id"), F.lit(0)).eqNullSafe(F.coalesce(F.col("k_id"), F.lit(0))) & F.col("doc_id").isNull().eqNullSafe(F.col("k_id").isNull())
    picked = good.withColumn("hash", text).join(F.broadcast(keys.select(F.col("doc_id").alias("k_id"), F.col("hash").alias("k_hash"), "drawn")), (F.col("hash") == F.col("k_hash")) & same)
    picked = picked.dropDuplicates(["doc_id", "hash", "lang"]).select("doc_id", "text", "lang", "drawn")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 1):
            rows = tfidf(b.column(1).to_pylist(), idf)
            cols = [b.column(0).cast(pa.int64()), b.column(2), b.column(3), *(pa.array([r[i].astype(t).tobytes() for r in rows], pa.binary()) for i, t in ((0, np.int32), (1, np.float32)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "drawn", "f", "v"])

    found = materialize(picked.mapInArrow(features, "doc_id long, lang string, drawn double, f binary, v binary"), "sample")
    size = found.agg(F.sum(F.octet_length("f") + F.octet_length("v"))).first()[0] or 0
    rows = (found if size <= SAMPLE_BYTES else found.where(F.col("drawn") < SAMPLE_BYTES / size)).collect()
    discard(found)
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["f"], r["v"]))
    x = [(np.frombuffer(r["f"], np.int32), np.frombuffer(r["v"], np.float32).astype(float)) for r in rows]
    y = np.asarray([names.index(r["lang"]) for r in rows], np.int64)
    back = np.arange(len(rows)) % 5 == 4
    w = train([r for r, b in zip(x, back, strict=True) if not b], y[~back], len(names))
    held = [r for r, b in zip(x, back, strict=True) if b]
    scores = np.asarray([v @ w[f] + w[DIM] for f, v in held]).reshape(len(held), len(names))
    return LanguageModel(names, idf, w, temperature(scores, y[back]))


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` (``und`` if the text is null or has no letter, or if the model knows no
    language) and ``score``, from the text alone. Columns of these names are replaced; the others stay."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, at):
            lang, score = model.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold: crc32 of the doc_id as text, modulo 3, is not 1. A null doc_id is
    neither held out nor learnt from."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score. Ties go to the first
    language by name. Repeated rows get equal results. Empty input: no rows."""
    model = fit(learnable(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
