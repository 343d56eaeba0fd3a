"""Pixel classifiers: training, and classes and probabilities from feature rows (image_id, y, x, f)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def fit_forest(features: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> Model:
    """A random forest of classes 0, 1, .. trained on rows with ``f`` and ``cls``. The fit reads its rows several times, so
    they are computed once."""
    rows = cut(features.select("f", F.col("cls").cast("double").alias("label"))).select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def save_bundle(model: Model, path: str, sigmas: tuple[float, ...], spark) -> None:
    """A model with the scales of its features, in one folder."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(list(map(float, sigmas)),)], "sigmas array<double>").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load_bundle(path: str, spark) -> tuple[Model, tuple[float, ...]]:
    """The model and the scales of a saved bundle."""
    from pyspark.ml.classification import RandomForestClassificationModel

    rows = spark.read.schema("sigmas array<double>").json(f"{path}/features").collect()  # one row
    if len(rows) != 1 or not rows[0]["sigmas"]:
        raise ValueError(f"no feature scales in {path}")
    return RandomForestClassificationModel.load(f"{path}/model"), tuple(rows[0]["sigmas"])


def classify(features: DataFrame, model: object, positive: int | None = 2) -> DataFrame:
    """``features`` without ``f``, with ``cls``, the most probable class (the first on ties), and ``prob``, the
    probability of ``positive``: 0 where the model doesn't know that class, null where it is None.

    A Spark model runs in the engine. Any other object with ``predict``, or with ``predict_proba`` and
    ``classes_`` where a probability is asked for, is sent to the workers and sees batches of rows."""
    keys = [c for c in features.columns if c != "f"]
    if isinstance(model, Model):
        d = model.transform(features.withColumn("_v", array_to_vector("f")), {model.featuresCol: "_v"})
        p = vector_to_array("probability")
        prob = F.lit(None).cast("double") if positive is None else F.coalesce(F.get(p, F.lit(positive)), F.lit(0.0)) if positive >= 0 else F.lit(0.0)
        return d.select(*keys, (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("cls"), prob.alias("prob"))
    if positive is not None and not hasattr(model, "predict_proba"):
        raise TypeError("a probability needs a model with predict_proba")

    def run(batches):
        for df in batches:
            x = np.asarray(df["f"].tolist(), float)
            out = df[keys].copy()
            if not len(df):
                out["cls"], out["prob"] = pd.Series(dtype="int32"), pd.Series(dtype="float64")
            elif positive is None:
                out["cls"], out["prob"] = np.asarray(model.predict(x)), None
            else:
                p, known = np.asarray(model.predict_proba(x)), np.asarray(getattr(model, "classes_", ()))
                if p.ndim != 2 or known.ndim != 1 or p.shape[1] != len(known):
                    raise TypeError("probabilities must have one column for each of the model's classes")
                out["cls"] = known[p.argmax(1)]
                at = np.flatnonzero(known == positive)
                out["prob"] = p[:, at[0]] if len(at) else 0.0
            yield out

    kinds = dict(features.dtypes)
    return features.mapInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["cls int", "prob double"]))
