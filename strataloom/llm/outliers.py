"""Quality rules: fixed text rules, then robust multivariate outliers.

DataFrame functions only. Each document gives a vector of transformed statistics. For every language and
source, concentration steps approach the minimum covariance determinant: take the ``SHARE`` of documents
nearest by Mahalanobis distance, estimate centre and covariance from them, and repeat. Three starts (medians
with the features' own spreads, medians with one spread for all, mean and covariance of all documents) go
``FIRST_STEPS`` steps; the one of the least determinant goes on until its determinant no longer falls. A
document goes if its distance from its group's centre is beyond the cutoff.

Every step only needs counts in distance bins and sums per group, which combine before the shuffle, so a
group may hold any share of the rows. Vectors are whole numbers (steps of 1 / SCALE) and all sums are of
whole numbers: the order of addition does not matter, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, WS_CHARS, discard, materialize, maybe_broadcast

SCALE = 256
FEATURES = ("v0", "v1", "v2", "v3", "v4")
EVENTS = ("e2", "e3", "e4")
P = len(FEATURES)
SHARE = 0.75
#: Makes the covariance of the nearest 75 % of five normal variables that of all of them.
CONSISTENCY = 1.41
#: Squared distance; the chi-square law of five degrees of freedom is beyond it in 1e-4 of cases.
CUTOFF = 25.745
#: Added to the variances as a share of them, so that features that go together stay harmless.
RIDGE = 0.01
#: Added to the variances of lengths: differences of a tenth in words and a fiftieth in word length are none.
LEAST_SPREAD = (0.1**2, 0.02**2)
#: Added to the variances of counts: a symbol, a repeated trigram or a repeated line more than the others
#: have is two deviations. For the sake of short documents one such event may be much; so that each count
#: can decide alone, 50 symbols by 1000 words, a quarter of the words and half of the lines are at the
#: cutoff at most where the others have none.
EVENT = 0.25
MOST_EVENT = tuple(x / CUTOFF for x in (15.46, 0.25, 0.5))
#: Steps of all starts before the best one goes on alone.
FIRST_STEPS = 2
#: Variances of PRIOR_ROWS documents that every group is held to have besides its own, so that a few
#: documents make no narrow estimate; their part fades as 1 / n.
PRIOR, PRIOR_ROWS = (1.0, 0.09, 1.0, 0.09, 0.09), 5
#: Smaller groups are judged together, see _group.
LEAST_GROUP = 40
BROADCAST_GROUPS = 10_000


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, base_failed; the text is left out."""
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    blank = F.lit(WS_CHARS)
    d = d.withColumn("w", F.filter(F.split(F.translate("text", WS_CHARS, " " * len(WS_CHARS)), " "), lambda x: x != ""))
    d = d.withColumn("ln", F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, blank) != ""))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    trigram = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    count = F.size("w") - 2
    windows = F.when(count > 1, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct(trigram(i).alias("k"), i.alias("i")))))
    d = d.withColumn("s", windows)
    # neighbours in the sorted windows are equal: both repeat; their starts in order of the text
    same = lambda i, j: F.get("s", i)["k"] == F.get("s", j)["k"]
    repeats = F.filter("s", lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    d = d.withColumn("r", F.sort_array(F.transform(repeats, lambda x: x["i"])))
    # each start covers three words, up to the next start
    covered = F.aggregate(F.transform("r", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("r", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.select(
        "doc_id", "lang", "source", "n_words",
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("ln").cast("long").alias("n_lines"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def vectors(d: DataFrame) -> DataFrame:
    """Adds the transformed statistics as whole numbers of 1 / SCALE: log words, log word length, log
    symbols by 1000 words, root of the shares of repeated words and of repeated lines. The squares of what
    one symbol, repeated trigram or repeated line makes in the document's last three are e2, e3, e4."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    raw = (
        F.log(words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(F.col("n_symbols") * 1000 / words),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
    )
    d = d.withColumns({f: F.round(x * SCALE).cast("long") for f, x in zip(FEATURES, raw, strict=True)})
    events = (F.pow(F.log1p(1000 / words), 2), 6 / words, 1 / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"))
    return d.withColumns({e: F.round(x * SCALE * SCALE).cast("long") for e, x in zip(EVENTS, events, strict=True)})


def _group(d: DataFrame) -> DataFrame:
    """Adds ``g_lang`` and ``g_source``: the group a document is judged by. Groups of under LEAST_GROUP
    documents are judged with the other small groups of their language, and where these are too few, with
    all of such documents, however few they are; ``pool`` says which."""
    n = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = n.where(F.col("n") < LEAST_GROUP).groupBy("lang").agg(F.sum("n").alias("pooled"))
    n = n.join(small.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    n = n.withColumn("pool", F.when(F.col("n") >= LEAST_GROUP, 0).when(F.col("pooled") >= LEAST_GROUP, 1).otherwise(2))
    n = materialize(n.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "pool"), "groups")
    d = d.join(maybe_broadcast(n, n.count(), BROADCAST_GROUPS), d["lang"].eqNullSafe(n["_l"]) & d["source"].eqNullSafe(n["_s"])).drop("_l", "_s")
    lang = F.when(F.col("pool") < 2, F.concat(F.lit("="), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))).otherwise(F.lit(""))
    source = F.when(F.col("pool") == 0, F.concat(F.lit("="), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))).otherwise(F.lit(""))
    return d.withColumn("g", F.concat(lang, F.lit("\x00"), source, F.col("pool").cast("string")))


def _quantile_bin(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Least ``bin`` of each key up to which at least ``share`` of its ``n`` lies: keys, cut."""
    by = Window.partitionBy(*keys)
    run = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = counts.withColumn("_run", run).withColumn("_all", F.sum("n").over(by))
    return c.where(F.col("_run") >= F.ceil(F.col("_all") * share)).groupBy(*keys).agg(F.min("bin").alias("cut"))


def _floors(events: list[Column]) -> dict[str, Column]:
    """f0..f4: what is added to a group's variances, given the means of its documents' e2, e3, e4."""
    counts = [F.least(e * EVENT, F.lit(x * SCALE * SCALE)) for e, x in zip(events, MOST_EVENT, strict=True)]
    return {f"f{i}": x for i, x in enumerate([*[F.lit(x * SCALE * SCALE) for x in LEAST_SPREAD], *counts])}


def _moments(d: DataFrame, keys: list[str], consistency: float) -> DataFrame:
    """Centre, covariance and floors by ``keys``: m0.., c00, c10, .., f0.."""
    sums = d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(f).cast("double").alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[(F.sum(e).cast("double") / F.count(F.lit(1))).alias(e) for e in EVENTS],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).cast("double").alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)],
    )
    cov = {f"c{i}{j}": (F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")) * consistency for i in range(P) for j in range(i + 1)}
    prior = {f"c{i}{i}": cov[f"c{i}{i}"] + F.lit(PRIOR[i] * PRIOR_ROWS * SCALE * SCALE) / F.col("n") for i in range(P)}
    return sums.select(*keys, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[c.alias(k) for k, c in (cov | prior | _floors([F.col(e) for e in EVENTS])).items()])


def _starts(d: DataFrame) -> DataFrame:
    """Three rows per group, told apart by ``start``: what the estimate may begin with."""
    long = d.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("bin")) for k, f in enumerate(FEATURES)])).alias("x")).select("g", "x.f", "x.bin")
    counts = long.groupBy("g", "f", "bin").agg(F.count(F.lit(1)).alias("n"))
    cuts = [_quantile_bin(counts, ["g", "f"], q).withColumnRenamed("cut", c) for q, c in ((0.5, "med"), (0.25, "low"), (0.75, "high"))]
    q = cuts[0].join(cuts[1], ["g", "f"]).join(cuts[2], ["g", "f"])
    pick = lambda k, c: F.max(F.when(F.col("f") == k, F.col(c))).cast("double")
    spread = lambda k: F.pow((pick(k, "high") - pick(k, "low")) / 1.35, 2)
    medians = q.groupBy("g").agg(*[pick(k, "med").alias(f"m{k}") for k in range(P)], *[spread(k).alias(f"c{k}{k}") for k in range(P)])
    every = materialize(_moments(d, ["g"], 1.0), "moments")
    medians = medians.join(every.select("g", *[f"f{k}" for k in range(P)]), "g")
    medians = medians.withColumns({f"c{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)})
    one = sum((F.col(f"c{k}{k}") for k in range(P)), F.lit(0.0)) / P
    alike = medians.withColumn("_one", one).withColumns({f"c{k}{k}": F.col("_one") for k in range(P)}).drop("_one")
    starts = [x.withColumn("start", F.lit(k)) for k, x in enumerate((medians, alike, every))]
    return starts[0].unionByName(starts[1]).unionByName(starts[2])


def _cholesky(params: DataFrame) -> DataFrame:
    """(g, start, m0.., l00, l10, .., det): the triangular root of covariance plus ridge and floors, in column
    arithmetic, and the logarithm of its determinant."""
    p = params
    for j in range(P):
        diag = F.col(f"c{j}{j}") * (1 + RIDGE) + F.col(f"f{j}")
        for k in range(j):
            diag = diag - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        p = p.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diag, F.lit(1e-3))))
        for i in range(j + 1, P):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            p = p.withColumn(f"l{i}{j}", v / F.col(f"l{j}{j}"))
    det = sum((F.log(F.col(f"l{j}{j}")) for j in range(P)), F.lit(0.0))
    return p.select("g", "start", *[f"m{k}" for k in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)], det.alias("det"))


def _distance(d: DataFrame, centres: DataFrame) -> DataFrame:
    """The rows of ``d`` in the groups of ``centres``, for each ``start``, with ``d2``, the squared
    Mahalanobis distance from their group's centre."""
    p = centres.withColumnRenamed("g", "_g")
    x = d.join(maybe_broadcast(p, p.count(), BROADCAST_GROUPS), d["g"] == p["_g"])
    total: Column = F.lit(0.0)
    for i in range(P):
        y = F.col(FEATURES[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        x = x.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return x.withColumn("d2", total).select(*d.columns, "start", "d2")


def _step(d: DataFrame, centres: DataFrame) -> DataFrame:
    """One concentration step of each start: the estimates from the nearest SHARE of documents."""
    x = _distance(d, centres).withColumn("bin", F.floor(F.log1p("d2") * 64).cast("int"))
    cut = _quantile_bin(x.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n")), ["g", "start"], SHARE)
    cut = materialize(cut.withColumnsRenamed({"g": "_g", "start": "_s"}), "cuts")
    near = x.join(maybe_broadcast(cut, cut.count(), BROADCAST_GROUPS), (x["g"] == cut["_g"]) & (x["start"] == cut["_s"]) & (x["bin"] <= cut["cut"]))
    out = materialize(_cholesky(_moments(near, ["g", "start"], CONSISTENCY)), "estimates")
    discard(cut)
    return out


def robust_distances(d: DataFrame) -> DataFrame:
    """``d`` (with the features and ``g``) with ``d2`` under the converged estimate of its group."""
    state = materialize(_cholesky(_starts(d)), "centres")
    for _ in range(FIRST_STEPS):
        last, state = state, _step(d, state)
        discard(last)
    best = state.groupBy("g").agg(F.min(F.struct("det", *[c for c in state.columns if c not in ("g", "det")])).alias("b")).select("g", "b.*")
    last, state = state, materialize(best.select(*state.columns).withColumn("open", F.lit(True)), "centres")
    discard(last)
    while state.where("open").limit(1).count():  # ends: determinants only fall, by a least amount
        fresh = _step(d, state.where("open").drop("open"))
        n = fresh.select([F.col(c).alias(f"_{c}") for c in fresh.columns])
        both = state.join(n, state["g"] == n["_g"], "left")
        # a group whose nearest set no longer shrinks keeps its estimate and rests
        better = F.coalesce(F.col("_det") < F.col("det") - 1e-6, F.lit(False))
        picked = [F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fresh.columns if c != "g"]
        last, state = state, materialize(both.select("g", *picked, better.alias("open")), "centres")
        discard(last, fresh)
    return _distance(d, state).drop("start")


def judge(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and distance2 (null where no group decided).

    The estimates are fitted on the documents that pass the base rules, and only these are judged by them.
    A null language or source is a value of its own. Few documents make a wide estimate (PRIOR_ROWS); a
    document that is alone lies at its centre. Null text: no words, base_failed. Repeated rows are judged each.
    Empty input: no rows. Other columns are ignored.
    """
    d = materialize(vectors(base_rules(docs)), "statistics")
    good = _group(d.where(~F.col("base_failed")))
    judged = robust_distances(materialize(good, "grouped"))
    out = judged.drop("g", "pool").unionByName(d.where("base_failed").withColumn("d2", F.lit(None).cast("double")))
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= CUTOFF))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance2"))
