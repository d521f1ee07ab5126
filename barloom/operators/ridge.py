"""Ridge regression from one distributed Gram matrix, and linear scoring without Python workers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ridge:
    features: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float
    alpha: float

    def expression(self) -> Column:
        """The prediction; null when a feature is missing."""
        parts = [(F.col(f) - m) / s * w for f, m, s, w in zip(self.features, self.means, self.scales, self.weights, strict=True)]
        return reduce(lambda a, b: a + b, parts, F.lit(self.intercept))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Ridge:
        return Ridge(**json.loads(text))


def _moments(df: DataFrame, columns: list[str], by: list[str]) -> list:
    """Counts, sums and products of every pair of columns, by group: p (p + 3) / 2 + 1 numbers each."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]
    products = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *sums, *products).collect() if by else df.agg(F.count("*").alias("n"), *sums, *products).collect()


def _solve(n: int, s: np.ndarray, p: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    means = s / n
    centred = p / n - np.outer(means, means)
    scale = np.sqrt(np.maximum(np.diag(centred)[:-1], 0))
    scale[scale <= 1e-12 * np.maximum(1, np.abs(means[:-1]))] = 1.0
    gram = centred[:-1, :-1] / np.outer(scale, scale) * n
    right = centred[:-1, -1] / scale * n
    weights = np.linalg.solve(gram + alpha * np.eye(len(scale)), right) if alpha > 0 else np.linalg.lstsq(gram, right, rcond=None)[0]
    return means[:-1], scale, weights, float(means[-1])


def fit(df: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> Ridge:
    """Median imputation, standardization with population deviations, then an unpenalized intercept.

    Products are taken about provisional centres (the first pass's means), so columns of
    large level keep their digits.
    """
    return fit_groups(df.withColumn("_all", F.lit("all")), features, label, "_all", alpha)["all"]


def fit_groups(df: DataFrame, features: list[str], label: str, by: str, alpha: float = 1.0) -> dict[str, Ridge]:
    """One model per value of ``by`` (such as a fold), all from the same passes.

    Gaps are filled with the median of the group's own rows, so a fold never sees values
    that come after it.  A feature without any value in a group is filled with 0.
    """
    known = df.where(F.col(by).isNotNull())
    first = {r[by]: r for r in known.groupBy(by).agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.count_if(F.col(f).isNull()).alias(f"n{i}") for i, f in enumerate(features)), F.avg(label).alias("y")).collect()}
    first = {k: r for k, r in first.items() if r["y"] is not None}
    if not first:
        raise ValueError("no rows to fit")
    # Exact medians cost a pass over all distinct values; only columns with gaps need them.
    gaps = [i for i in range(len(features)) if any(r[f"n{i}"] for r in first.values())]
    middle = {r[by]: r for r in known.groupBy(by).agg(*(F.percentile(features[i], 0.5).alias(f"p{i}") for i in gaps)).collect()} if gaps else {}
    fill = {k: [(middle[k][f"p{i}"] or 0.0) if i in gaps else r[f"m{i}"] or 0.0 for i in range(len(features))] for k, r in first.items()}
    at = {k: [r[f"m{i}"] or 0.0 for i in range(len(features))] for k, r in first.items()}
    of = lambda values: F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))))[F.col(by)]
    part = known.where(F.col(label).isNotNull() & F.col(by).isin(list(first)))
    centred = [(F.coalesce(F.col(f), of({k: v[i] for k, v in fill.items()})) - of({k: v[i] for k, v in at.items()})).alias(f"x{i}") for i, f in enumerate(features)]
    filled = part.select(by, *centred, (F.col(label) - of({k: r["y"] for k, r in first.items()})).alias("y"))
    names = [*(f"x{i}" for i in range(len(features))), "y"]
    out = {}
    for row in _moments(filled, names, [by]):
        size, key = len(names), row[by]
        s, p = np.array([row[f"s{i}"] for i in range(size)]), np.zeros((size, size))
        for i in range(size):
            for j in range(i + 1):
                p[i, j] = p[j, i] = row[f"p{i}_{j}"]
        means, scale, weights, mean_y = _solve(row["n"], s, p, alpha)
        out[key] = Ridge(features, fill[key], [float(m + c) for m, c in zip(means, at[key], strict=True)], scale.tolist(), weights.tolist(), mean_y + first[key]["y"], alpha)
    return out


def score(df: DataFrame, model: Ridge, name: str = "prediction") -> DataFrame:
    """``df`` with the prediction; rows with a missing feature keep a null one."""
    return df.withColumn(name, model.expression())


def score_groups(df: DataFrame, models: dict[str, Ridge], by: str, name: str = "prediction") -> DataFrame:
    """Every row by its group's model, in one projection."""
    out = F.lit(None).cast("double")
    for key, model in models.items():
        out = F.when(F.col(by) == key, model.expression()).otherwise(out)
    return df.withColumn(name, out)
