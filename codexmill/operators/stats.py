"""Seeded resampling: grouped maps with numpy's generator, so that equal seeds give equal intervals everywhere."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Defaults (fixed values).
SEED, RESAMPLES, LEVEL = 12345, 1000, 0.95


def _means(values: np.ndarray, seed: int, resamples: int) -> np.ndarray:
    """Means of the resamples; the generator's stream is drawn in slices, so that a large sample is never held many times."""
    rng, n, out = np.random.default_rng(seed), len(values), []
    each = max(1, 4_000_000 // n)
    for at in range(0, resamples, each):
        out.append(values[rng.integers(0, n, size=(min(each, resamples - at), n))].mean(axis=1))
    return np.concatenate(out)


def bootstrap_ci(values, seed: int = SEED, resamples: int = RESAMPLES, level: float = LEVEL) -> dict:
    v = np.asarray(values, float)
    if not len(v):
        return {"mean": 0.0, "lo": 0.0, "hi": 0.0, "n": 0}
    low, high = np.quantile(_means(v, seed, resamples), [(1 - level) / 2, (1 + level) / 2])
    return {"mean": float(v.mean()), "lo": float(low), "hi": float(high), "n": len(v)}


def paired_bootstrap(a, b, seed: int = SEED, resamples: int = RESAMPLES, level: float = LEVEL) -> dict:
    """Interval and two-sided p of mean(a - b)."""
    if len(a) != len(b):
        raise ValueError("paired values of unequal number")
    d = np.asarray(a, float) - np.asarray(b, float)
    if not len(d):
        return {"diff": 0.0, "lo": 0.0, "hi": 0.0, "p": 1.0, "n": 0}
    means = _means(d, seed, resamples)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    p = min(1.0, 2 * min(float((means <= 0).mean()), float((means >= 0).mean())))
    return {"diff": float(d.mean()), "lo": float(low), "hi": float(high), "p": p, "n": len(d)}


def bca_ci(values, seed: int = SEED, resamples: int = RESAMPLES, level: float = LEVEL) -> dict:
    """Bias-corrected and accelerated: the shift from the share of resampled means below the mean, the acceleration from the jackknife."""
    v, normal = np.asarray(values, float), NormalDist()
    if len(v) < 2 or np.all(v == v[0]):
        return bootstrap_ci(v, seed, resamples, level)
    means, mean = _means(v, seed, resamples), v.mean()
    shift = normal.inv_cdf(float(np.clip((means < mean).mean(), 1e-6, 1 - 1e-6)))
    left_out = (v.sum() - v) / (len(v) - 1)
    away = left_out.mean() - left_out
    spread = float((away**2).sum()) ** 1.5
    bend = float((away**3).sum()) / (6 * spread) if spread else 0.0
    ends = []
    for share in ((1 - level) / 2, (1 + level) / 2):
        z = shift + normal.inv_cdf(share)
        ends.append(normal.cdf(shift + z / (1 - bend * z)))
    low, high = np.quantile(means, ends)
    return {"mean": float(mean), "lo": float(low), "hi": float(high), "n": len(v)}


def tost(a, b, margin: float, seed: int = SEED, resamples: int = RESAMPLES, alpha: float = 0.05) -> dict:
    """Two one-sided tests: equivalent if the 1 - 2 alpha interval of mean(a - b) lies within the margin, a positive number."""
    if margin <= 0:
        raise ValueError("the margin must be positive")
    if len(a) != len(b):
        raise ValueError("paired values of unequal number")
    d = np.asarray(a, float) - np.asarray(b, float)
    if not len(d):
        return {"diff": 0.0, "lo": 0.0, "hi": 0.0, "p": 1.0, "equivalent": False}
    means = _means(d, seed, resamples)
    low, high = np.quantile(means, [alpha, 1 - alpha])
    p = max(float((means <= -margin).mean()), float((means >= margin).mean()))
    return {"diff": float(d.mean()), "lo": float(low), "hi": float(high), "p": p, "equivalent": bool(low >= -margin and high <= margin)}


def grouped_ci(values: DataFrame, group: str, value: str, order: str, method=bootstrap_ci) -> DataFrame:
    """(group, mean, lo, hi, n) for each group's values in the order of a unique key; a group is one statistic's sample
    (a value for each question), read whole by one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = method(pdf.sort_values(order)[value].to_numpy())
        return pd.DataFrame([{group: pdf[group].iloc[0], **got}])[[group, "mean", "lo", "hi", "n"]]

    schema = values.select(group).schema.add("mean", "double").add("lo", "double").add("hi", "double").add("n", "long")
    return values.select(group, value, order).groupBy(group).applyInPandas(run, schema)
