"""Logistic calibration of a single score."""

from __future__ import annotations

import numpy as np


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope that make 1 / (1 + exp(-(a + b x))) the probability of label 1, by Newton's method.

    Half an observation of either label is added at the mean, and the slope is held back a little, so that separable
    data give finite values.
    """
    if not len(x):
        return 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    mid = float(np.mean(x))
    design = np.stack([np.ones(len(x) + 2), np.append((x - mid) / scale, [0.0, 0.0])], axis=1)
    target = np.append(y, [0.0, 1.0]).astype(float)
    weight = np.append(weight, [0.5, 0.5])
    ridge = np.diag([0.0, 0.05])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (target - p)) - ridge @ beta
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        size = float(np.abs(step).max())
        beta += step / max(1.0, size)
        if size < 1e-9:
            break
    return float(beta[0] - beta[1] * mid / scale), float(beta[1] / scale)


def probability(x: np.ndarray, parameters: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(parameters[0] + parameters[1] * x, -30, 30)))


def class_weights(y: np.ndarray, population: tuple[int, int]) -> np.ndarray:
    """Weights that give a sample, drawn by class, the classes' shares of the population; their mean is 1."""
    share = np.array(population, dtype=float) / max(1, sum(population))
    own = np.array([max(1, int((y == value).sum())) for value in (0, 1)]) / max(1, len(y))
    return (share / own)[y.astype(int)] if len(y) else np.zeros(0)
