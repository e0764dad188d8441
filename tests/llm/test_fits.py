"""What the quality rules and the shards are fitted to, against exhaustive search."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from tessera.llm import quality, sharding


@pytest.mark.parametrize("seed", range(4))
def test_lasso_weights_are_optimal(seed):
    """The conditions of an optimum: the slope of the loss is the penalty against each weight's sign, and no more where it is 0."""
    rng = np.random.default_rng(seed)
    z = (rng.random((400, 12)) < rng.uniform(0.1, 0.9, 12)).astype(float)
    z[:, 11] = z[:, 0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 1] + 0.2)))).astype(float)
    penalty = 0.01
    weights, bias = quality.lasso(z, y, penalty, steps=4000)
    slope = z.T @ (1 / (1 + np.exp(-(z @ weights + bias))) - y) / len(y)
    away = np.abs(weights) > 1e-6
    assert np.abs(slope[away] + penalty * np.sign(weights[away])).max() < 1e-5
    assert (np.abs(slope[~away]) <= penalty + 1e-5).all()
    assert abs((1 / (1 + np.exp(-(z @ weights + bias))) - y).mean()) < 1e-5
    # as few steps as are taken in training come close
    near, _ = quality.lasso(z, y, penalty)
    loss = lambda w, b: np.mean(np.logaddexp(0, z @ w + b) - y * (z @ w + b)) + penalty * np.abs(w).sum()
    assert loss(near, quality.lasso(z, y, penalty)[1]) - loss(weights, bias) < 1e-5


@pytest.mark.parametrize("seed", range(5))
def test_the_first_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x = {k: np.round(rng.normal(size=300), 2) for k in "abc"}
    y = ((x["b"] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    p = y.mean() + 1e-3
    p = p / (p + 1 - y.mean() + 1e-3)
    grad, hess = y - p, p * (1 - p)
    gains = {}
    for k, values in x.items():
        for cut in np.unique(np.quantile(values, np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = values <= cut
            part = lambda m: grad[m].sum() ** 2 / (m.sum() * hess + 1)
            gains[k, float(cut)] = part(left) + part(~left)
    name, cut = max(gains, key=gains.get)
    rules = quality.tree_rules(x, y)
    assert {rules[0].terms, rules[1].terms} == {((name, True, cut),), ((name, False, cut),)}


def test_small_packings_are_near_the_best():
    rng = np.random.default_rng(3)
    ratios = []
    for _ in range(25):
        loads = rng.integers(1, 60, (8, 3)).astype(float)
        scaled = loads / loads.sum(axis=0)

        def uneven(bins):
            held = np.zeros((3, 3))
            np.add.at(held, np.asarray(bins), scaled)
            return ((held - 1 / 3) ** 2).sum()

        best = min(uneven((0, *rest)) for rest in product(range(3), repeat=7))
        ratios.append(uneven(sharding.pack_vectors(loads, 3)) / best)
    # squares: the best of all 2,187 packings of eight vectors is at most twice as even in the median
    assert min(ratios) == pytest.approx(1) and np.median(ratios) < 4
