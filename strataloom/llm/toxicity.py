"""Toxicity by class-conditional Kneser-Ney models of spelling.

A text's words are runs of word characters, in lower case, in pieces of at most 24. A model gives each character
of a word its probability after up to two before it, the start of the word among them. Each class, toxic and
ordinary, has discounted counts of its own; what the discount frees, and what a class has not seen, follows the
shared counts of both classes, which back off to shorter contexts as Kneser-Ney models do, down to a uniform
share. So an expression that either class has hardly met has nearly the same likelihood in both, and a new form of
a known insult has not. The log-likelihood ratio of each passage of 1 to 16 words and of the whole text is divided
by its length; a logistic function, fitted to texts that the counts have not seen, turns the highest ratios and the
text's length into a score.

Counts are gathered from every labelled text that may be learnt from, each distinct text once, each word once a
text. They are held in hashed slots, so a model's size is bounded whatever the corpus, and nothing is left out.

Null and empty texts and texts without word characters have no words, and all of them the same score. Rows that
share a doc_id are each scored; of several labels of one doc_id the highest counts. Labels other than 0 and 1 are
ignored. Without a learnable text of each class there is no model, and the score is the share of toxic
learnable texts, 0 without any. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, mix64, text_chunks

WORD = re.compile(r"\w{1,24}")
#: Characters in the longest gram: a character and the two before it.
ORDER = 3
#: Slots for grams, and as many for contexts.
SLOTS = 1 << 20
#: The shared distribution counts as so many more characters in each context of a class.
SHARED = 30.0
#: Of the uniform distribution under the shortest context.
ALPHABET = 2000
WINDOWS = (1, 2, 4, 8, 16)
#: Texts whose features the logistic function is fitted to, at most: those of the lowest hashes.
CALIBRATION = 20_000
#: Rows of ids to broadcast, at most.
BROADCAST_ROWS = 1_000_000
#: Bytes of text, and distinct words, at a time: they bound a worker's memory.
CHUNK, WORDS = 1 << 20, 1 << 14

COUNTS = "order tinyint, gram long, context long, n array<long>"
FEATURES = "toxic int, x array<double>"
START, END = 1, 2


def held_out() -> F.Column:
    """Whether a document is kept from learning; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


# --------------------------------------------------------------------------- grams of words


def grams(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For the words on end: the word of each character, and for each order the hashes of the grams that end at a
    character and of their contexts, and where there are such grams."""
    text = chr(START) + (chr(END) + chr(START)).join(words) + chr(END)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(chars == START)
    word = np.cumsum(chars == START) - 1
    place = np.arange(len(chars)) - starts[word]
    out, context = [], np.zeros(len(chars), np.uint64)
    for k in range(1, ORDER + 1):
        gram = mix64(context * np.uint64(0x9E3779B97F4A7C15) + chars + np.uint64(k << 40))
        out.append((gram, context, (place >= k - 1) & (chars != START)))
        context = np.roll(gram, 1)
    return word, out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic, fold) to grams with their counts by fold and class."""
    for batch in text_chunks(batches, 0, CHUNK):
        seen: dict[str, np.ndarray] = {}
        for text, toxic, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for w in set(WORD.findall((text or "").lower())):
                if w not in seen:
                    seen[w] = np.zeros(4, np.int64)
                seen[w][2 * fold + toxic] += 1
        if not seen:
            continue
        n = np.stack(list(seen.values()))
        word, orders = grams(list(seen))
        for k, (gram, context, at) in enumerate(orders, 1):
            keys, first, inverse = np.unique(gram[at], return_index=True, return_inverse=True)
            sums = np.stack([np.bincount(inverse, n[word[at], j]) for j in range(4)], 1).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, 4 * len(keys) + 1, 4, dtype=np.int32), pa.array(sums.ravel()))
            yield pa.record_batch([pa.array(np.full(len(keys), k, np.int8)), pa.array(keys.view(np.int64)), pa.array(context[at][first].view(np.int64)), lists], names=["order", "gram", "context", "n"])


# --------------------------------------------------------------------------- the models


class Model:
    """Counts of grams and contexts in slots: all of them, or those of one fold.

    ``rows``: kind, slot, values, types. For kind 0, of grams, values are the counts as ordinary and as toxic; for
    kind 1, of contexts, those of all grams after it, and types are the numbers of distinct grams after it that
    the ordinary class, the toxic class and either has. ``discounts`` are those of the orders."""

    def __init__(self, rows: tuple[np.ndarray, ...], discounts: np.ndarray):
        self.discounts = discounts
        kind, slot, values, types = rows
        grams_, contexts = kind == 0, kind == 1
        self.grams, self.totals, self.types = np.zeros((SLOTS, 2), np.float32), np.zeros((SLOTS, 2), np.float32), np.zeros((SLOTS, 3), np.float32)
        self.grams[slot[grams_]] = values[grams_]
        self.totals[slot[contexts]] = values[contexts]
        self.types[slot[contexts]] = types[contexts]

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word as toxic, less that as ordinary, without the last digits, which can differ
        with a word's place among others."""
        if len(words) > WORDS:
            return np.concatenate([self.ratios(words[i : i + WORDS]) for i in range(0, len(words), WORDS)])
        if not words:
            return np.zeros(0)
        word, orders = grams(words)
        shared = np.full(len(word), 1.0 / ALPHABET)
        ordinary, toxic = shared.copy(), shared.copy()
        for d, (gram, context, at) in zip(self.discounts, orders, strict=True):
            g, c = _slot(gram), _slot(context)
            n, total, types = self.grams[g].astype(float), self.totals[c].astype(float), self.types[c].astype(float)
            known = at & (total.sum(1) > 0)
            both = (np.maximum(n.sum(1) - d, 0) + d * types[:, 2] * shared) / np.maximum(total.sum(1), 1e-9)
            of_class = [(np.maximum(n[:, j] - d, 0) + (d * types[:, j] + SHARED) * both) / (total[:, j] + SHARED) for j in (0, 1)]
            ordinary, toxic, shared = (np.where(known, new, old) for new, old in ((of_class[0], ordinary), (of_class[1], toxic), (both, shared)))
        return np.round(np.bincount(word, np.log(toxic / ordinary), len(words)), 9)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


def features(texts: list[str | None], model: Model) -> np.ndarray:
    """A row for each text: mean ratio of its words, the highest of its passages by length, log of its words."""
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in WORD.findall((t or "").lower())], np.int64) for t in texts]
    ratio = model.ratios(list(index))
    out = np.zeros((len(texts), len(WINDOWS) + 2))
    for row, i in zip(out, ids, strict=True):
        if len(i):
            total = np.concatenate([[0.0], np.cumsum(ratio[i])])
            row[0], row[-1] = total[-1] / len(i), np.log1p(len(i))
            for j, w in enumerate(WINDOWS, 1):
                k = min(w, len(i))
                row[j] = (total[k:] - total[:-k]).max() / w
    return out


class Logistic:
    """Logistic regression on standardised features with a quadratic penalty, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._terms(x)
        self.weights, penalty = np.zeros(z.shape[1]), np.r_[np.ones(z.shape[1] - 1), 1e-6]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * self.weights)
            self.weights -= step
            if np.abs(step).max() < 1e-9:
                break

    def _terms(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._terms(x) @ self.weights, -30, 30)))


# --------------------------------------------------------------------------- learning


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, hash, toxic) that name each distinct labelled text once. A text with both labels is toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.where(~held_out()).select("doc_id", F.xxhash64("text").alias("hash"))
    return ids.join(known, "doc_id").groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "hash", "toxic")


def _texts(docs: DataFrame, chosen: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, fold) of the chosen rows."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    return d.join(maybe_broadcast(chosen, rows, BROADCAST_ROWS), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("text", "toxic", F.pmod("hash", F.lit(2)).cast("int").alias("fold"))


def slots(counts: DataFrame) -> DataFrame:
    """Counts by slot for grams and contexts, with distinct grams by fold and class, from grams with their counts."""
    v = [F.col("n")[j] for j in range(4)]
    n = [F.sum(v[j]).alias(f"v{j}") for j in range(4)]
    some = lambda *cs: F.sum(F.when(sum(cs[1:], cs[0]) > 0, 1).otherwise(0))
    # for fold 0, fold 1 and both: ordinary, toxic, either
    types = [some(*cs).alias(f"t{i}") for i, cs in enumerate([(v[0],), (v[1],), (v[0], v[1]), (v[2],), (v[3],), (v[2], v[3]), (v[0], v[2]), (v[1], v[3]), tuple(v)])]
    unsigned = lambda c: F.pmod(F.col(c), F.lit(SLOTS)).cast("int").alias("slot")  # noqa: E731  of two's complement: as the unsigned remainder, for a power of two
    g = counts.groupBy(F.lit(0).alias("kind"), unsigned("gram")).agg(*n, *[F.lit(0).cast("long").alias(f"t{i}") for i in range(9)])
    return g.unionByName(counts.groupBy(F.lit(1).alias("kind"), unsigned("context")).agg(*n, *types))


def fit(docs: DataFrame, labels: DataFrame):
    """(models of fold 0, fold 1 and both; logistic function), or the share of toxic texts where a class is missing."""
    spark = docs.sparkSession
    chosen = materialize(learnable(docs, labels), "toxic-ids")
    sizes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return None, sizes.get(1, 0) / total if total else 0.0
    counts = _texts(docs, chosen, total).mapInArrow(_counts, COUNTS)
    counts = counts.groupBy("order", "gram", "context").agg(*[F.sum(F.col("n")[j]).alias(f"n{j}") for j in range(4)])
    counts = materialize(counts.select("order", "gram", "context", F.array(*[f"n{j}" for j in range(4)]).alias("n")), "toxic-grams")
    seen = F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)
    ones = {r["order"]: (r["n1"], r["n2"]) for r in counts.groupBy("order").agg(F.sum((seen == 1).cast("int")).alias("n1"), F.sum((seen == 2).cast("int")).alias("n2")).collect()}
    discounts = np.array([n1 / (n1 + 2 * n2) if n1 and n2 else 0.5 for n1, n2 in (ones.get(k, (0, 0)) for k in range(1, ORDER + 1))])
    table = slots(counts).toArrow()  # two rows a slot at most
    col = lambda *names: np.stack([table.column(c).to_numpy() for c in names], 1)
    kind, slot, v, t = table.column("kind").to_numpy(), table.column("slot").to_numpy(), col("v0", "v1", "v2", "v3"), col(*[f"t{i}" for i in range(9)])
    parts = [(kind, slot, v[:, :2], t[:, :3]), (kind, slot, v[:, 2:], t[:, 3:6]), (kind, slot, v[:, :2] + v[:, 2:], t[:, 6:])]
    parts = [tuple(x.astype(np.float32) if x.ndim == 2 else x for x in p) for p in parts]
    sample = chosen.orderBy("hash", "doc_id").limit(CALIBRATION)
    shared = spark.sparkContext.broadcast((parts[:2], discounts))
    rows = _texts(docs, sample, CALIBRATION).mapInArrow(lambda batches: _features(batches, shared), FEATURES).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(WINDOWS) + 2)
    y = rows.column("toxic").to_numpy()
    order = np.lexsort((*x.T, y))  # sums in one order, whatever the tasks
    return (parts[2], discounts), Logistic(x[order], y[order])


def _features(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Features of texts by the model of the other fold."""
    parts, discounts = shared.value
    models = [Model(p, discounts) for p in parts]
    for batch in text_chunks(batches, 0, CHUNK):
        text, toxic, fold = (batch.column(i).to_pylist() for i in range(3))
        for f in (0, 1):
            mine = [i for i, g in enumerate(fold) if g == f]
            x = features([text[i] for i in mine], models[1 - f])
            yield pa.record_batch([pa.array([toxic[i] for i in mine], pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])


# --------------------------------------------------------------------------- scoring


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    d = docs.select("text", "doc_id", held_out().alias("held_out"))
    model, logistic = fit(docs, labels)
    if model is None:
        return d.select("doc_id", "held_out", F.lit(float(logistic)).alias("score"), F.lit(int(logistic >= 0.5)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast((*model, logistic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, discounts, to_score = shared.value
        m = Model(part, discounts)
        for batch in text_chunks(batches, 0, CHUNK):
            s = to_score(features(batch.column(0).to_pylist(), m))
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
