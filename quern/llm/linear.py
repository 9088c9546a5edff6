"""Naive-Bayes-scaled linear models: log-count ratios, hinge loss by dual coordinate descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LinearModel:
    """Weights over hashed features (log-count ratio folded in), bias and calibration."""

    weights: np.ndarray
    norms: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, keys: np.ndarray, bits: int, rows: int) -> np.ndarray:
        """Decision values of `rows` rows from distinct keys `row << bits | feature`."""
        row = keys >> bits
        feature = keys & ((1 << bits) - 1)
        total = np.bincount(row, self.weights[feature], rows)
        norm = np.sqrt(np.bincount(row, self.norms[feature], rows) + 1)
        return total / norm + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def log_ratios(p, q, n1, n0, least=3, alpha=1.0, sigmas=3.0):
    """log of the smoothed share of a feature in class 1 (p of n1 rows) over class 0 (q of n0).

    A feature in fewer than `least` rows, or whose ratio is within `sigmas` standard
    errors of 0, gets 0, which leaves it out of the model.
    """
    r = np.log((p + alpha) / (n1 + 2 * alpha)) - np.log((q + alpha) / (n0 + 2 * alpha))
    r[(p + q < least) | (np.abs(r) < sigmas * np.sqrt(1 / (p + alpha) + 1 / (q + alpha)))] = 0
    return r


def dual_descent(starts, features, values, signs, size, cost=1.0, epochs=12, seed=7):
    """Coordinate descent on the dual of the L2-regularised hinge loss, with a bias."""
    n = len(signs)
    squares = np.add.reduceat(np.append(values * values, 0.0), starts[:-1]) * (np.diff(starts) > 0) + 1.0
    weights, bias, duals = np.zeros(size), 0.0, np.zeros(n)
    share = max(1e-9, (signs > 0).mean()), max(1e-9, (signs < 0).mean())
    cap = np.where(signs > 0, cost * 0.5 / share[0], cost * 0.5 / share[1])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(n):
            a, b = starts[i], starts[i + 1]
            f, v = features[a:b], values[a:b]
            gradient = signs[i] * (weights[f] @ v + bias) - 1
            new = min(max(duals[i] - gradient / squares[i], 0.0), cap[i])
            step = (new - duals[i]) * signs[i]
            if step:
                weights[f] += step * v
                bias += step
                duals[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return weights, bias


def calibrate(margins, labels, steps=50):
    """Slope and shift of a logistic curve through the margins (smoothed targets)."""
    n1, n0 = int((labels == 1).sum()), int((labels != 1).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * margins).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * margins * margins).sum() + 1e-3, (h * margins).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 1e-3), b


def constant(share: float, size: int) -> LinearModel:
    """A model that gives every row the score `share`."""
    zero = np.zeros(size, np.float32)
    return LinearModel(zero, zero, 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))


def fit(starts, features, labels, tune, ratios, cost=1.0, epochs=12) -> LinearModel:
    """Scale indicators by their ratios, fit the hinge loss, calibrate on the `tune` rows.

    starts, features: the rows' distinct features with a ratio, concatenated.
    """
    size = len(ratios)
    if len(np.unique(labels)) < 2:
        return constant(float((labels == 1).mean()) if len(labels) else 0.5, size)
    if len(np.unique(labels[tune])) < 2 or len(np.unique(labels[~tune])) < 2:
        tune = np.ones(len(labels), bool)
        train = tune
    else:
        train = ~tune

    def part(chosen):
        chosen = np.flatnonzero(chosen)
        lengths = np.diff(starts)[chosen]
        at = np.concatenate([[0], np.cumsum(lengths)])
        f = features[np.repeat(starts[:-1][chosen] - at[:-1], lengths) + np.arange(at[-1])]
        x, row = ratios[f], np.repeat(np.arange(len(chosen)), lengths)
        return at, f, x / np.sqrt(np.bincount(row, x * x, len(chosen)) + 1)[row], row

    at, f, x, _ = part(train)
    w, bias = dual_descent(at, f, x, np.where(labels[train] == 1, 1.0, -1.0), size, cost, epochs)
    at, f, x, row = part(tune)
    slope, shift = calibrate(np.bincount(row, w[f] * x, len(at) - 1) + bias, labels[tune])
    return LinearModel((w * ratios).astype(np.float32), (ratios * ratios).astype(np.float32), float(bias), float(slope), float(shift))
