"""Scaling, oversampling, training, search and scoring of risk models on feature tables."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Model families; boosted trees stand for adaptive boosting, and there are no extremely randomised trees.
MODELS = {"tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "boosting": GBTClassifier}
GRID = {"maxDepth": [2, 3, 5, 8, 12], "minInstancesPerNode": [1, 2, 5, 10, 20], "maxBins": [32, 64]}


def fit_scaling(train: DataFrame, features: list[str]) -> DataFrame:
    """One row of bounds, to be applied to any table with these features."""
    return train.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])


def scale(df: DataFrame, bounds: DataFrame, features: list[str]) -> DataFrame:
    """Features by the bounds' range; a constant feature becomes 0, null stays null."""
    one = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), F.col(c) * 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(c)
    rest = [F.col(c) for c in df.columns if c not in features]
    return df.join(F.broadcast(bounds)).select(*rest, *[one(c) for c in features])


def smote(df: DataFrame, key: str, label: str, features: list[str], k: int = 5, seed: int = 7, block: int = 2000) -> DataFrame:
    """New rows of class 1 between a row and one of its k nearest, until the classes are even.

    Neighbours are exact: the minority is compared in blocks of bounded size, each task holds two blocks and
    passes on k candidates a row. Fewer than three minority rows give none; k is at most their number less one.
    Rows with a null feature or label stay out. Columns: key (of the origin), copy, label, features.
    """
    whole = df.select(key, F.col(label).cast("int").alias(label), F.array(*[F.col(c).cast("double") for c in features]).alias("x")).where(f"`{label}` is not null and not exists(x, v -> v is null)")
    counts = whole.agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b")).first()
    few, need = counts["a"], counts["b"] - counts["a"]
    k, blocks = min(k, few - 1), few // block + 1
    kt = dict(df.dtypes)[key]
    if k < 2 or need <= 0:
        return whole.select(F.col(key), F.lit(0).cast("long").alias("copy"), label, *[F.col("x")[i].alias(c) for i, c in enumerate(features)]).limit(0)
    rare = whole.where(F.col(label) == 1).select(F.col(key).alias("id"), "x").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    left = rare.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "x", F.col("b").cast("int").alias("b"), "o")
    # New names on this side, or the two sides of the same table would be taken for one.
    right = rare.select(F.col("id").alias("id2"), F.col("x").alias("y"), F.col("b").cast("int").alias("o2"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b2"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            y, names = np.stack(b["y"]), b["id2"].to_numpy()
            for name, x in zip(a["id"], a["x"], strict=True):
                d = ((y - x) ** 2).sum(1)
                d[names == name] = np.inf
                out += [(name, d[j], y[j]) for j in np.lexsort((names, d))[:k] if np.isfinite(d[j])]
        return pd.DataFrame(out, columns=["id", "d", "y"])

    pairs = left.groupBy("b", "o").cogroup(right.groupBy("b2", "o2")).applyInPandas(nearest, f"id {kt}, d double, y array<double>")
    best = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "y"))), 1, k).alias("near"))
    # Each minority row gives need // few new rows, and the first by a seeded order give one more.
    turn = best.join(rare.select("id", "x"), "id").withColumn("r", F.xxhash64("id", F.lit(seed)))
    rank = turn.select("id", "r").orderBy("r", "id").limit(need % few).select("id", F.lit(1).alias("more"))
    n = F.lit(need // few) + F.coalesce("more", F.lit(0))
    made = turn.join(rank, "id", "left").withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))))
    draw = lambda salt: F.pmod(F.xxhash64("id", "copy", F.lit(seed), F.lit(salt)), F.lit(1 << 30)).cast("double") / (1 << 30)
    y = F.element_at("near", (F.floor(draw(1) * F.size("near")) + 1).cast("int"))["y"]
    return made.withColumns({"y": y, "u": draw(2)}).select(F.col("id").alias(key), F.col("copy").cast("long").alias("copy"), F.lit(1).alias(label), *[(F.col("x")[i] + F.col("u") * (F.col("y")[i] - F.col("x")[i])).alias(c) for i, c in enumerate(features)])


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as one vector column; null counts as -1."""
    return df.withColumn("__x", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features])))


def train(df: DataFrame, label: str, features: list[str], model: str = "forest", seed: int = 7, **params):
    est = MODELS[model](featuresCol="__x", labelCol=label, seed=seed, **params)
    return est.fit(vectors(df.withColumn(label, F.col(label).cast("double")), features))


def search(df: DataFrame, label: str, features: list[str], model: str = "forest", metric: str = "f1", draws: int = 100, folds: int = 5, jobs: int = 5, seed: int = 7):
    """Random search: distinct draws of the grid, scored by cross validation; returns the best model and its parameters."""
    est = MODELS[model](featuresCol="__x", labelCol=label, seed=seed)
    rng, seen = random.Random(seed), {}
    most = int(np.prod([len(v) for v in GRID.values()]))
    while len(seen) < min(draws, most):
        pick = {p: rng.choice(v) for p, v in GRID.items()}
        seen[tuple(pick.values())] = pick
    maps = [{est.getParam(p): v for p, v in pick.items()} for pick in seen.values()]
    name = {"recall": "recallByLabel", "precision": "precisionByLabel"}.get(metric, metric)
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName=name, metricLabel=1.0)
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, numFolds=folds, parallelism=jobs, seed=seed)
    fitted = cv.fit(vectors(df.withColumn(label, F.col(label).cast("double")), features))
    at = int(np.argmax(fitted.avgMetrics))
    return fitted.bestModel, list(seen.values())[at]


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance, the greatest first; ties by name."""
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda p: (-p[1], p[0]))


def risk(model, df: DataFrame, features: list[str], offset: float = 0.0) -> DataFrame:
    """Adds ``risk``, the probability of class 1 plus an offset, and ``flag``, the risk rounded."""
    p: Column = vector_to_array("probability")[1] + offset
    out = model.transform(vectors(df, features)).withColumn("risk", p).withColumn("flag", F.round("risk").cast("int"))
    return out.drop("__x", "rawPrediction", "probability", "prediction")


def report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row a class: support, precision, recall, f1, and the accuracy over all."""
    t, g = F.col(truth).cast("int"), F.col(guess).cast("int")
    cells = df.select(t.alias("t"), g.alias("g")).groupBy("t", "g").count()
    hit = F.when(F.col("t") == F.col("g"), F.col("count")).otherwise(0)
    true = cells.groupBy(F.col("t").alias("class")).agg(F.sum("count").alias("support"), F.sum(hit).alias("hits"))
    said = cells.groupBy(F.col("g").alias("class")).agg(F.sum("count").alias("said"))
    acc = cells.agg((F.sum(hit) / F.sum("count")).alias("accuracy"))
    p, r = F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)), F.col("hits") / F.col("support")
    return true.join(said, "class", "left").withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).join(F.broadcast(acc)).select("class", "support", "precision", "recall", "f1", "accuracy")
