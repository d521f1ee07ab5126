"""Model registry: ridge in closed form, boosted trees through Spark ML, and a seeded search."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from barloom.operators import metrics, ridge, splits

#: Defaults and search ranges (fixed values).
DEFAULTS: dict[str, dict[str, Any]] = {
    "ridge": {"alpha": 1.0},
    "xgboost": {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8, "reg_lambda": 1.0, "random_state": 42},
    "catboost": {"iterations": 300, "depth": 6, "learning_rate": 0.05, "l2_leaf_reg": 3.0, "random_seed": 42},
}
#: Kind, lowest, highest and, of whole numbers, the step.
SPACES: dict[str, dict[str, tuple]] = {
    "ridge": {"alpha": ("log", 1e-3, 100.0)},
    "xgboost": {"n_estimators": ("int", 100, 600, 50), "max_depth": ("int", 3, 8, 1), "learning_rate": ("log", 0.01, 0.2), "subsample": ("float", 0.6, 1.0), "colsample_bytree": ("float", 0.6, 1.0), "reg_lambda": ("log", 1e-3, 10.0)},
    "catboost": {"iterations": ("int", 100, 600, 50), "depth": ("int", 3, 8, 1), "learning_rate": ("log", 0.01, 0.2), "l2_leaf_reg": ("log", 1e-2, 10.0)},
}
#: Spark's names of the parameters that its boosted trees have; those of other hardware or libraries have none.
SPARK_NAMES = {
    "n_estimators": "maxIter", "iterations": "maxIter", "max_depth": "maxDepth", "depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy", "random_state": "seed", "random_seed": "seed",
}


def parameters(model: str, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with ``given`` over them, as plain JSON values."""
    if model not in DEFAULTS:
        raise ValueError(f"Unknown model: {model}. Available models: {', '.join(sorted(DEFAULTS))}")
    return json.loads(json.dumps(DEFAULTS[model] | (given or {})))


def spark_parameters(given: dict[str, Any]) -> dict[str, Any]:
    """Parameters of ``GBTRegressor``: the names above in Spark's words, and Spark's own names as they are.

    Leaf penalties (reg_lambda, l2_leaf_reg) have no counterpart there and are left out:
    with leaves of many rows they move a leaf by lambda / (rows + lambda).
    """
    from pyspark.ml.regression import GBTRegressor

    own = {p.name for p in GBTRegressor().params}
    out = {SPARK_NAMES.get(k, k): v for k, v in given.items() if SPARK_NAMES.get(k, k) in own}
    if isinstance(out.get("featureSubsetStrategy"), float):
        out["featureSubsetStrategy"] = "all" if out["featureSubsetStrategy"] >= 1 else str(out["featureSubsetStrategy"])
    return out


def fit(df: DataFrame, model: str, features: list[str], label: str, given: dict[str, Any] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A scorer that adds ``prediction``; incomplete rows get null.

    The two boosted models share Spark's gradient-boosted trees: their rankings are
    comparable, their numbers are not those of other libraries.
    """
    p = parameters(model, given)
    if model == "ridge":
        return scorer(ridge.fit(df, features, label, p["alpha"]), features)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    vector = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    trees = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="prediction", **spark_parameters(p))
    return scorer(trees.fit(vector.transform(df.dropna(subset=[*features, label]))), features)


def scorer(artifact: Any, features: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Adds ``prediction`` by a fitted or loaded model of any kind, its ``artifact``."""
    if isinstance(artifact, ridge.Ridge):
        score = lambda x: ridge.score(x, artifact)
    else:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.sql import functions as F

        vector = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")

        def score(x: DataFrame) -> DataFrame:
            there = F.lit(True)
            for f in features:
                there = there & F.col(f).isNotNull()
            done = artifact.transform(vector.transform(x.where(there))).drop("_features")
            return done.unionByName(x.where(~there), allowMissingColumns=True)

    score.artifact = artifact
    return score


def draw(model: str, rng: random.Random, fixed: dict[str, Any] | None = None) -> dict[str, Any]:
    """One point of the model's space; ``fixed`` parameters are not drawn."""
    out = dict(fixed or {})
    for name, (kind, low, high, *step) in SPACES[model].items():
        if name in out:
            continue
        if kind == "int":
            out[name] = rng.randrange(low, high + 1, *step)
        elif kind == "log":
            out[name] = low * (high / low) ** rng.random()
        else:
            out[name] = rng.uniform(low, high)
    return out


def tune(df: DataFrame, model: str, features: list[str], label: str, folds: list[splits.Fold], trials: int = 10, metric: str = "rank_ic", top: int = 5, seed: int = 42, fixed: dict[str, Any] | None = None) -> list[dict[str, Any]]:
    """The ``top`` trials of a seeded random search over walk-forward folds, best first."""
    if metric not in metrics.METRICS:
        raise ValueError(f"Unknown tuning metric: {metric}. Available metrics: {', '.join(metrics.METRICS)}")
    rng, found = random.Random(seed), []
    for number in range(trials):
        given = draw(model, rng, fixed)
        values = []
        for fold in folds:
            scored = fit(splits.members(df, [fold], "train"), model, features, label, given)(splits.members(df, [fold], "valid"))
            values.append(metrics.evaluate(scored, label=label).first()[metric])
        found.append({"trial": number, "params": given, "score": sum(values) / len(values), "fold_scores": values})
    minimize = metric in ("mae", "ic_std", "rank_ic_std")
    return sorted(found, key=lambda t: t["score"] if minimize else -t["score"])[:top]
