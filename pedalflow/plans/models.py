"""Least-squares models: sums are made by Spark, the small systems are solved on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_equations(rows: DataFrame, target: str, features: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y with an intercept, in one aggregation."""
    x = [F.lit(1.0), *features]
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = [F.sum((x[i] * x[j]).cast("double")) for i, j in pairs] + [F.sum((x[i] * F.col(target)).cast("double")) for i in range(n)]
    found = [float(v or 0.0) for v in rows.agg(*sums).first()]
    a = np.zeros((n, n))
    for (i, j), v in zip(pairs, found, strict=False):
        a[i, j] = a[j, i] = v
    return a, np.array(found[len(pairs) :])


def ols(rows: DataFrame, target: str, features: dict[str, Column]) -> dict[str, float]:
    """Coefficients of a linear model; categories come as 0/1 columns. Of dependent columns the least-norm solution."""
    a, b = normal_equations(rows, target, list(features.values()))
    return dict(zip(["intercept", *features], np.linalg.lstsq(a, b, rcond=None)[0].tolist(), strict=True))


def predict(rows: DataFrame, target: str, features: dict[str, Column], fit: dict[str, float]) -> DataFrame:
    out = F.lit(fit["intercept"])
    for name, column in features.items():
        out = out + column * F.lit(fit[name])
    return rows.withColumn("predicted", out).withColumn("residual", F.col(target) - F.col("predicted"))


def rmse(rows: DataFrame, residual: str = "residual") -> DataFrame:
    return rows.agg(F.sqrt(F.avg(F.pow(residual, F.lit(2)))).alias("rmse"))


def levenberg_marquardt(model: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Parameters that minimise the squared error, from a start; derivatives by central differences."""
    p, damp = np.asarray(start, float), 1e-3
    error = y - model(x, p)
    best = float(error @ error)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(1.0, np.abs(p))
        jac = np.stack([(model(x, p + s) - model(x, p - s)) / (2 * h) for h, s in ((step[i], np.eye(len(p))[i] * step[i]) for i in range(len(p)))], axis=1)
        a, g = jac.T @ jac, jac.T @ error
        for _ in range(30):
            move = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
            fresh = y - model(x, p + move)
            now = float(fresh @ fresh)
            if np.isfinite(now) and now < best:
                break
            damp *= 4
        else:
            return p
        done = best - now < 1e-12 * max(best, 1e-12)
        p, error, best, damp = p + move, fresh, now, damp / 4
        if done:
            break
    return p


def weather_model(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Trips of a day: exp(base + weekday + growth) + weather * s-curve of temperature less rain and snow. Columns of
    x: weekday 0/1, growth, temperature, precipitation, snow depth."""
    weekday, growth, warm, rain, snow = x.T
    place = warm + p[4] * rain + p[5] * snow
    return np.exp(p[0] + p[1] * weekday + p[2] * growth) + p[3] / (1 + np.exp(np.clip((p[6] - place) / p[7], -50, 50)))


def fit_weather_model(daily: DataFrame, start: tuple[float, ...]) -> np.ndarray:
    """Fits ``daily`` (weekday, growth, temperature, precipitation, snow_depth, trips); rows are days."""
    rows = np.array(daily.select("weekday", "growth", "temperature", "precipitation", "snow_depth", "trips").collect(), float)
    return levenberg_marquardt(weather_model, rows[:, :5], rows[:, 5], np.asarray(start, float))
