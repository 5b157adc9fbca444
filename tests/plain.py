"""Plain numpy versions of the resampling operators, for groups that fit into one array."""

from __future__ import annotations

import numpy as np

RESAMPLES = 10_000


def interval(values: np.ndarray, resamples: int = RESAMPLES, seed: int = 0, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile bootstrap interval of the mean; (nan, nan) without values, the value itself for one."""
    n = len(values)
    if n == 0:
        return float("nan"), float("nan")
    if n == 1:
        return float(values[0]), float(values[0])
    draws = np.random.default_rng(seed).integers(0, n, size=(resamples, n))
    low, high = np.quantile(values[draws].mean(axis=1), [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def paired(values: np.ndarray, resamples: int = RESAMPLES, seed: int = 0, alpha: float = 0.05) -> tuple[float, float, float]:
    """Percentile bootstrap interval of the mean difference, and the two-sided sign-flip p. Sums that differ by rounding only are ties."""
    n, rng = len(values), np.random.default_rng(seed)
    low, high = np.quantile(values[rng.integers(0, n, size=(resamples, n))].mean(axis=1), [alpha / 2, 1 - alpha / 2])
    null = (values * rng.choice([-1.0, 1.0], size=(resamples, n))).mean(axis=1)
    return float(low), float(high), float((np.abs(null).round(9) >= round(abs(float(values.mean())), 9)).mean())


def logistic(x: np.ndarray, y: np.ndarray, iterations: int = 50, ridge: float = 1e-6) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-8)
        step = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def components(grid: np.ndarray) -> tuple[float, float, float]:
    """Shares of the sums of squares of rows, columns and their interaction; cells without a value are left out."""
    with np.errstate(invalid="ignore"):
        whole = np.nanmean(grid)
        row, col = np.nanmean(grid, axis=1, keepdims=True), np.nanmean(grid, axis=0, keepdims=True)
    a, b = grid.shape[1] * np.nansum((row - whole) ** 2), grid.shape[0] * np.nansum((col - whole) ** 2)
    c = np.nansum((grid - row - col + whole) ** 2)
    total = a + b + c
    return (a / total, b / total, c / total) if total > 0 else (0.0, 0.0, 0.0)
