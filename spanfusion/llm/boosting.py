"""Small gradient-boosted trees for two classes, trained on a bounded sample."""

from __future__ import annotations

import numpy as np

DEPTH = 3
ROUNDS = 40
RATE = 0.3
BINS = 24


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple:
    """A tree as (feature, cut, low, high), or a leaf's value."""
    value = -g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(g) < 8:
        return value
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f, points in enumerate(cuts):
        for cut in points:
            low = x[:, f] <= cut
            if low.any() and not low.all():
                gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[~low].sum() ** 2 / (h[~low].sum() + 1.0) - whole
                if gain > best[0]:
                    best = (gain, f, cut)
    if best[1] is None:
        return value
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], g[low], h[low], cuts, depth - 1), _grow(x[~low], g[~low], h[~low], cuts, depth - 1)


def _apply(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), float(tree))
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = _apply(tree[2], x[low]), _apply(tree[3], x[~low])
    return out


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    for tree in model["trees"]:
        out += RATE * _apply(tree, x)
    return out


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    """Calibrated chance of class 1."""
    return 1 / (1 + np.exp(-np.clip(model["slope"] * margin(model, x) + model["shift"], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, seed: int = 7) -> dict:
    """Trees from two thirds of the rows; slope and shift of the chances (Platt's scaling) from a sixth; ``held`` has the places of the last sixth, which decides nothing here."""
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=float)
    if not len(y) or y.min() == y.max():
        base = 6.0 if len(y) and y[0] else -6.0
        return {"base": base, "trees": [], "slope": 1.0, "shift": 0.0, "held": np.zeros(0, np.int64)}
    draw = np.random.default_rng(seed).random(len(y))
    held, last = draw < 1 / 3, draw < 1 / 6
    if held.all() or len(set(y[~held])) < 2 or len(set(y[held & ~last])) < 2 or len(set(y[last])) < 2:
        held[:] = last[:] = False
    xs, ys, ws = x[~held], y[~held], weight[~held]
    rate = np.clip(np.average(ys, weights=ws), 1e-3, 1 - 1e-3)
    model = {"base": float(np.log(rate / (1 - rate))), "trees": [], "slope": 1.0, "shift": 0.0, "held": np.flatnonzero(last)}
    cuts = [np.unique(np.quantile(xs[:, f], np.linspace(0, 1, BINS + 1)[:-1], method="lower")) for f in range(x.shape[1])]
    m = np.full(len(ys), model["base"])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-m))
        model["trees"].append(_grow(xs, ws * (p - ys), ws * p * (1 - p), cuts, DEPTH))
        m += RATE * _apply(model["trees"][-1], xs)
    told = held & ~last
    if told.any():
        a, b, mh, yh, wh = 1.0, 0.0, margin(model, x[told]), y[told], weight[told]
        yes, no = (wh * yh).sum(), (wh * (1 - yh)).sum()
        soft = np.where(yh == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * mh + b)))
            w = wh * p * (1 - p) + 1e-6
            hess = np.array([[(w * mh * mh).sum() + 1e-3, (w * mh).sum()], [(w * mh).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, [(wh * (p - soft) * mh).sum(), (wh * (p - soft)).sum()])
        if np.isfinite(a) and a > 0:
            model["slope"], model["shift"] = float(a), float(b)
    return model
