"""Logistic regression on few features, for calibrated scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 50) -> Logistic:
        """Newton's method with a ridge on all weights but the constant. One class only: the constant alone answers."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        weight = weight / weight.mean()
        w, penalty = np.zeros(a.shape[1]), ridge * np.append(np.ones(a.shape[1] - 1), 1e-3)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            gradient = a.T @ (weight * (p - y)) + penalty * w
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), gradient)
            w = w - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        return 1 / (1 + np.exp(-np.clip(a @ self.weights, -40, 40)))
