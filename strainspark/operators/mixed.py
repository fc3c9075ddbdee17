"""Mixed models with a random intercept by cohort, one fit a feature.

Spark reduces the rows to sufficient statistics first: moments by feature and
cohort for the linear model, successes and trials by covariate pattern for the
binomial one.  What is fitted in a Python worker is a few rows a feature, however
many samples there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.functions.special import normal_two_sided, t_two_sided

FIT = "name string, test string, coef double, se double, df double, pval double, note string"


def _hessian(f: Callable[[np.ndarray], float], at: np.ndarray, step: np.ndarray) -> np.ndarray:
    k = len(at)
    out = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            a, b = np.eye(k)[i] * step[i], np.eye(k)[j] * step[j]
            out[i, j] = out[j, i] = (f(at + a + b) - f(at + a - b) - f(at - a + b) + f(at - a - b)) / (4 * step[i] * step[j])
    return out


def _lowest(f: Callable[[float], float], low: float, high: float, rounds: int = 80) -> float:
    """Golden-section search after a grid, so that a second valley isn't taken for the first."""
    grid = np.linspace(low, high, 41)
    at = int(np.argmin([f(x) for x in grid]))
    low, high = grid[max(at - 1, 0)], grid[min(at + 1, 40)]
    g = (5**0.5 - 1) / 2
    for _ in range(rounds):
        a, b = high - g * (high - low), low + g * (high - low)
        if f(a) < f(b):
            high = b
        else:
            low = a
    return (low + high) / 2


class Reml:
    """The restricted likelihood of y = X b + u[cohort] + e from each cohort's moments of (X, y)."""

    def __init__(self, moments: list[tuple[float, np.ndarray, np.ndarray]]):
        """moments: (n, sums of the columns of (X, y), their cross products)."""
        self.moments = moments
        self.n, self.p = sum(n for n, _, _ in moments), len(moments[0][1]) - 1

    def products(self, ratio: float) -> tuple[np.ndarray, float]:
        """(X, y)' V^-1 (X, y) and log det V for a variance of u that is ``ratio`` of that of e, which is 1."""
        total, log_det = np.zeros((self.p + 1, self.p + 1)), 0.0
        for n, sums, cross in self.moments:
            total += cross - ratio / (1 + n * ratio) * np.outer(sums, sums)
            log_det += np.log1p(n * ratio)
        return total, log_det

    def deviance(self, ratio: float, variance: float | None = None) -> float:
        """-2 log of the restricted likelihood but for a constant; the variance of e is the best one if none is given."""
        m, log_det = self.products(ratio)
        xx, xy = m[:-1, :-1], m[:-1, -1]
        rest = m[-1, -1] - xy @ np.linalg.solve(xx, xy)
        free = self.n - self.p
        if variance is None:
            variance = max(rest, 1e-300) / free
        return free * np.log(variance) + log_det + np.linalg.slogdet(xx)[1] + rest / variance

    def fit(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Coefficients, standard errors, Satterthwaite's degrees of freedom, variance of e and of u."""
        best = _lowest(lambda x: self.deviance(np.exp(x)), -14.0, 10.0)
        ratio = 0.0 if self.deviance(0.0) <= self.deviance(np.exp(best)) + 1e-9 else float(np.exp(best))
        m, _ = self.products(ratio)
        xx, xy = m[:-1, :-1], m[:-1, -1]
        coef = np.linalg.solve(xx, xy)
        free = self.n - self.p
        variance = (m[-1, -1] - xy @ coef) / free
        spread = lambda theta: np.diag(np.linalg.inv(self.products(theta[1] / theta[0])[0][:-1, :-1])) * theta[0]
        se = np.sqrt(spread(np.array([variance, ratio * variance])))
        if ratio == 0.0:  # on the border the model is the plain linear one
            return coef, se, np.full(self.p, float(free)), variance, 0.0
        theta = np.array([variance, ratio * variance])
        step = theta * 1e-3
        cov = 2 * np.linalg.pinv(_hessian(lambda t: self.deviance(t[1] / t[0], t[0]), theta, step))
        slope = np.stack([(spread(theta + np.eye(2)[k] * step[k]) - spread(theta - np.eye(2)[k] * step[k])) / (2 * step[k]) for k in range(2)], axis=1)
        df = 2 * se**4 / np.maximum(np.einsum("ik,kl,il->i", slope, cov, slope), 1e-300)
        return coef, se, np.clip(df, 1.0, float(free)), variance, ratio * variance


def linear_mixed(rows: DataFrame, y: str, x: list[str], name: str = "name", cohort: str = "cohort") -> DataFrame:
    """(name, test, coef, se, df, pval, note) of y ~ x + (1 | cohort) for each name, by restricted likelihood.

    Rows with a null or NaN in a used column are left out.  The t-tests have
    Satterthwaite's degrees of freedom.  A name whose covariates are collinear,
    or that has no more rows than coefficients, gets one row with a note.
    """
    used = rows.select(F.col(name).cast("string").alias("name"), F.col(cohort).cast("string").alias("cohort"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate([*x, y])])
    n = len(x) + 1
    used = used.replace(float("nan"), None).dropna()
    sums = [F.sum(f"v{k}").alias(f"s{k}") for k in range(n)]
    cross = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    moments = used.groupBy("name", "cohort").agg(F.count("*").cast("double").alias("n"), *sums, *cross)
    tests = ["(Intercept)", *x]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in pdf.sort_values("cohort").to_dict("records"):
            s = np.array([row["n"], *[row[f"s{k}"] for k in range(n)]])
            c = np.empty((n + 1, n + 1))
            c[0], c[:, 0] = s, s
            for i in range(n):
                for j in range(i, n):
                    c[i + 1, j + 1] = c[j + 1, i + 1] = row[f"c{i}_{j}"]
            parts.append((row["n"], s, c))
        model = Reml(parts)
        key = pdf["name"].iat[0]
        xx = model.products(0.0)[0][:-1, :-1]
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        if model.n <= model.p or np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-9) < model.p:
            return pd.DataFrame([{"name": key, "test": None, "coef": None, "se": None, "df": None, "pval": None, "note": "too few rows or collinear"}])
        coef, se, df, _, _ = model.fit()
        return pd.DataFrame([{"name": key, "test": t, "coef": b, "se": s, "df": d, "pval": t_two_sided(b / s, d) if s > 0 else None, "note": None} for t, b, s, d in zip(tests, coef, se, df, strict=True)])

    return moments.groupBy("name").applyInPandas(fit, FIT)


class Binomial:
    """Laplace's likelihood of logit P = X b + u[cohort], u normal, from successes and trials by pattern."""

    def __init__(self, x: np.ndarray, hits: np.ndarray, trials: np.ndarray, cohort: np.ndarray):
        self.x, self.hits, self.trials = x, hits, trials
        self.cohorts, self.place = np.unique(cohort, return_inverse=True)

    def loglik(self, theta: np.ndarray) -> float:
        """theta: coefficients and the log of u's deviation."""
        eta, var = self.x @ theta[:-1], np.exp(2 * theta[-1])
        u = np.zeros(len(self.cohorts))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(eta + u[self.place], -35, 35)))
            slope = np.bincount(self.place, self.hits - self.trials * p, len(u)) - u / var
            curve = np.bincount(self.place, self.trials * p * (1 - p), len(u)) + 1 / var
            move = np.clip(slope / curve, -2, 2)
            u += move
            if np.abs(move).max() < 1e-10:
                break
        z = np.clip(eta + u[self.place], -35, 35)
        p = 1 / (1 + np.exp(-z))
        curve = np.bincount(self.place, self.trials * p * (1 - p), len(u)) + 1 / var
        return float((self.hits * z - self.trials * np.logaddexp(0, z)).sum() - (u * u).sum() / (2 * var) - 0.5 * np.log(curve * var).sum())

    def plain(self, ridge: float = 1e-9) -> np.ndarray:
        """Coefficients without the random intercept, by Newton steps."""
        b = np.zeros(self.x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(self.x @ b, -35, 35)))
            step = np.linalg.solve((self.x * (self.trials * p * (1 - p))[:, None]).T @ self.x + ridge * np.eye(len(b)), self.x.T @ (self.hits - self.trials * p))
            b += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-10:
                break
        return b

    def fit(self) -> tuple[np.ndarray, np.ndarray, float, bool]:
        """Coefficients, standard errors, deviation of u, and whether the search met a maximum inside."""
        b = self.plain()

        def best_given(log_sd: float, start: np.ndarray) -> np.ndarray:
            at = start.copy()
            f = lambda c: -self.loglik(np.append(c, log_sd))
            for _ in range(25):
                step = np.full(len(at), 1e-4)
                grad = np.array([(f(at + e) - f(at - e)) / 2e-4 for e in np.eye(len(at)) * 1e-4])
                h = _hessian(f, at, step)
                move = np.linalg.lstsq(h + 1e-9 * np.eye(len(at)), grad, rcond=None)[0]
                scale = 1.0
                while scale > 1e-4 and f(at - scale * move) > f(at) + 1e-12:
                    scale /= 2
                at = at - scale * move
                if np.abs(scale * move).max() < 1e-6:
                    break
            return at

        log_sd = _lowest(lambda s: -self.loglik(np.append(best_given(s, b), s)), -6.0, 2.0, 25)
        coef = best_given(log_sd, b)
        h = _hessian(lambda c: -self.loglik(np.append(c, log_sd)), coef, np.full(len(coef), 1e-3))
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(h)), 0))
        return coef, se, float(np.exp(log_sd)), bool(np.abs(coef).max() < 15)


def binomial_mixed(rows: DataFrame, hit: str, x: list[str], name: str = "name", cohort: str = "cohort", least: int = 10) -> DataFrame:
    """(name, test, coef, se, df, pval, note) of logit P(hit) ~ x + (1 | cohort) for each name, by Laplace's approximation.

    ``hit`` is 0 or 1; rows with a null are left out.  Names with ``least`` or fewer
    rows of either outcome aren't fitted and get one row with a note, as do
    separated ones.  Tests are normal, so df is null.
    """
    used = rows.select(F.col(name).cast("string").alias("name"), F.col(cohort).cast("string").alias("cohort"), F.col(hit).cast("double").alias("hit"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(x)]).dropna()
    covariates = [f"v{k}" for k in range(len(x))]
    patterns = used.groupBy("name", "cohort", *covariates).agg(F.sum("hit").alias("hits"), F.count("*").cast("double").alias("trials"))
    tests = ["(Intercept)", *x]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["name"].iat[0]
        hits, trials = pdf["hits"].to_numpy(float), pdf["trials"].to_numpy(float)
        none = lambda note: pd.DataFrame([{"name": key, "test": None, "coef": None, "se": None, "df": None, "pval": None, "note": note}])
        if min(hits.sum(), (trials - hits).sum()) <= least:
            return none("too few")
        model = Binomial(np.column_stack([np.ones(len(pdf)), pdf[covariates].to_numpy(float)]), hits, trials, pdf["cohort"].to_numpy())
        if np.linalg.matrix_rank(model.x) < model.x.shape[1]:
            return none("collinear")
        coef, se, _, inside = model.fit()
        if not inside:
            return none("separated")
        return pd.DataFrame([{"name": key, "test": t, "coef": b, "se": s, "df": None, "pval": normal_two_sided(b / s) if s > 0 else None, "note": None} for t, b, s in zip(tests, coef, se, strict=True)])

    return patterns.groupBy("name").applyInPandas(fit, FIT)
