"""Weighted logistic regression with lasso and ridge penalties, on bounded samples held by the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, lasso: float = 0.0, ridge: float = 1e-3, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) that minimise the mean weighted log loss plus the penalties.

    ``target`` may be fractional (posterior labels). Columns are standardised inside; accelerated
    proximal gradient steps with restarts; the intercept carries no penalty.
    """
    n, p = x.shape
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    mean = weight @ x
    scale = np.sqrt(np.maximum(weight @ (x - mean) ** 2, 1e-12))
    z = np.column_stack([np.ones(n), (x - mean) / scale])
    step = 1.0 / (0.25 * np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1] + ridge + 1e-9)
    rate = np.clip(weight @ target, 1e-6, 1 - 1e-6)
    beta = np.zeros(p + 1)
    beta[0] = np.log(rate / (1 - rate))
    look, momentum = beta.copy(), 1.0
    for _ in range(rounds):
        slope = z.T @ (weight * (sigmoid(z @ look) - target))
        slope[1:] += ridge * look[1:]
        new = look - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lasso, 0)
        if (look - new) @ (new - beta) > 0:
            momentum = 1.0
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / grown * (new - beta)
        done = np.max(np.abs(new - beta)) < 1e-7
        beta, momentum = new, grown
        if done:
            break
    coefficients = beta[1:] / scale
    return coefficients, float(beta[0] - coefficients @ mean)
