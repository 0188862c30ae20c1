"""Collinearity filter, residualizer and robust scaler: one-pass matrices, small algebra on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import validate
from .intervals import whole_bounds


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance of complete rows, in one aggregate."""
    x = [F.col(c).cast("double") for c in columns]
    d = len(x)
    row = df.na.drop(subset=columns).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)], float)
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(d)], float), cov


def vif(cov: np.ndarray) -> np.ndarray:
    """Variance inflation factors 1 / (1 - R^2) of each feature on the others, with an intercept."""
    out = []
    for i in range(len(cov)):
        rest = [j for j in range(len(cov)) if j != i]
        if not rest or cov[i, i] <= 0:
            out.append(1.0 if not rest else math.inf)
            continue
        beta = np.linalg.lstsq(cov[np.ix_(rest, rest)], cov[rest, i], rcond=None)[0]
        left = 1 - beta @ cov[rest, i] / cov[i, i]
        out.append(math.inf if left <= 1e-12 else 1 / left)
    return np.array(out)


def filter_features_by_vif(df: DataFrame, features: list[str] | None = None, threshold: float = 5.0) -> tuple[list[str], dict[str, float]]:
    """(features kept, their VIF): the largest goes until none is over the threshold."""
    if threshold <= 0:
        raise ValueError("the threshold is positive")
    names = validate.features(df, features)
    if len(names) < 2:
        raise ValueError("two features are needed")
    _, _, cov = moments(df, names)
    kept = list(range(len(names)))
    while True:
        found = vif(cov[np.ix_(kept, kept)])
        if len(kept) == 1 or found.max() <= threshold:
            return [names[k] for k in kept], {names[k]: float(v) for k, v in zip(kept, found)}
        kept.pop(int(found.argmax()))


class FeatureResidualizer:
    """Takes from each feature what correlated features, not themselves residualised before, explain of it."""

    def __init__(self):
        self.models: dict[str, tuple[float, dict[str, float]]] | None = None

    def fit(self, df: DataFrame, features: list[str] | None = None, corrcoef: float = 0.8, corr_type: str = "abs") -> FeatureResidualizer:
        if not 0 <= corrcoef <= 1:
            raise ValueError("corrcoef lies in [0, 1]")
        if corr_type not in ("abs", "pos", "positive", "negative"):
            raise ValueError("corr_type is abs, pos, positive or negative")
        names = validate.features(df, features)
        validate.finite(df, names)
        _, mean, cov = moments(df, names)
        sd = np.sqrt(np.diag(cov))
        corr = cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), np.inf)
        np.fill_diagonal(corr, 1.0)
        corr = {"abs": np.abs, "pos": lambda c: np.clip(c, 0, None), "positive": lambda c: c, "negative": lambda c: -c}[corr_type](corr).copy()
        order = np.argsort(-(np.abs(corr) if corr_type != "pos" else corr).sum(axis=1), kind="stable")
        np.fill_diagonal(corr, -1.0)
        self.features, self.models, done = names, {}, set()
        for i in order:
            by = [j for j in range(len(names)) if corr[i, j] >= corrcoef and j not in done]
            if by:
                beta = np.linalg.lstsq(cov[np.ix_(by, by)], cov[by, i], rcond=None)[0]
                self.models[names[i]] = (float(mean[i] - beta @ mean[by]), {names[j]: float(b) for j, b in zip(by, beta)})
                done.add(i)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """One projection: every predictor is a raw column."""
        if self.models is None:
            raise ValueError("fit before transforming")
        validate.same_columns(df, self.features)
        made = {}
        for c, (b0, betas) in self.models.items():
            out = F.col(c).cast("double") - b0
            for p, b in betas.items():
                out = out - F.col(p).cast("double") * b
            made[c] = out
        return df.withColumns(made) if made else df

    def fit_transform(self, df: DataFrame, **options) -> DataFrame:
        return self.fit(df, **options).transform(df)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


class RobustGaussianScaler:
    """Clip to a statistical interval, power transform of greatest likelihood, standardise."""

    def __init__(self):
        self.params: dict[str, tuple] | None = None

    def fit(self, df: DataFrame, features: list[str] | None = None, winsorize_method="stddev", power_method: str | None = "yeo-johnson") -> RobustGaussianScaler:
        if power_method not in ("yeo-johnson", "box-cox", None):
            raise ValueError("power_method is yeo-johnson, box-cox or None")
        names = validate.features(df, features)
        validate.finite(df, names)
        self.power_method = power_method
        bounds = whole_bounds(df, names, winsorize_method) if winsorize_method else {c: (None, None) for c in names}
        self.winsorization_bounds_ = [bounds[c] for c in names]
        clipped = {c: self._clip(F.col(c).cast("double"), bounds[c]) for c in names}
        lam = self._lambdas(df, clipped) if power_method else {c: None for c in names}
        shaped = {c: self._power(clipped[c], lam[c]) for c in names}
        row = df.agg(*[a.alias(f"{k}{i}") for i, c in enumerate(names) for k, a in (("m", F.avg(shaped[c])), ("s", F.stddev_pop(shaped[c])))]).first()
        self.params = {c: (bounds[c], lam[c], row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(names)}
        return self

    @staticmethod
    def _clip(x: Column, b: tuple) -> Column:
        x = F.greatest(x, F.lit(float(b[0]))) if b[0] is not None else x
        return F.least(x, F.lit(float(b[1]))) if b[1] is not None else x

    def _power(self, x: Column, lam: float | None) -> Column:
        return x if lam is None else (yeo_johnson if self.power_method == "yeo-johnson" else box_cox)(x, lam)

    def _lambdas(self, df: DataFrame, clipped: dict[str, Column], grid: int = 17, rounds: int = 5) -> dict[str, float]:
        """Grid refinement: every round evaluates all candidates of all features in one aggregate."""
        span = {c: (-3.0, 5.0) for c in clipped}
        log = (lambda x: F.signum(x) * F.log1p(F.abs(x))) if self.power_method == "yeo-johnson" else F.log
        for _ in range(rounds):
            tries = {c: np.linspace(*span[c], grid) for c in clipped}
            aggs = [F.var_pop(self._power(x, float(t))).alias(f"v{i}_{k}") for i, (c, x) in enumerate(clipped.items()) for k, t in enumerate(tries[c])]
            row = df.agg(*aggs, *[a.alias(f"{n}{i}") for i, x in enumerate(clipped.values()) for n, a in (("l", F.sum(log(x))), ("n", F.count(x)))]).first()
            for i, c in enumerate(clipped):
                fit = [-row[f"n{i}"] / 2 * math.log(row[f"v{i}_{k}"]) + (t - 1) * row[f"l{i}"] if row[f"v{i}_{k}"] else -math.inf for k, t in enumerate(tries[c])]
                best, step = int(np.argmax(fit)), tries[c][1] - tries[c][0]
                span[c] = (tries[c][best] - step, tries[c][best] + step)
        return {c: (a + b) / 2 for c, (a, b) in span.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        if self.params is None:
            raise ValueError("fit before transforming")
        validate.same_columns(df, list(self.params))
        return df.withColumns({c: (self._power(self._clip(F.col(c).cast("double"), b), lam) - m) / s for c, (b, lam, m, s) in self.params.items()})

    def fit_transform(self, df: DataFrame, **options) -> DataFrame:
        return self.fit(df, **options).transform(df)
