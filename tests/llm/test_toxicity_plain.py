"""The classifier chain against plain gradient descent over dense matrices, with three categories."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessella.llm import toxicity as X


def telling(matrix, y):
    """Columns whose 2 x 2 table with the label has G over the bound, counted cell by cell."""
    out = []
    for j in range(matrix.shape[1]):
        g = 0.0
        for have in (0, 1):
            for label in (0, 1):
                o = sum(1 for a, b in zip(matrix[:, j], y, strict=True) if a == have and b == label)
                e = sum(matrix[:, j] == have) * sum(y == label) / len(y)
                g += 2 * o * math.log(o / e) if o else 0
        if g > X.LEAST_G:
            out.append(j)
    return out


def descent(matrix, y, ridge, rounds=60_000):
    """Ridge logistic regression by gradient descent with a step that the curvature allows."""
    beta = np.zeros(matrix.shape[1])
    step = 1 / (np.linalg.eigvalsh(matrix.T @ matrix)[-1] / 4 + ridge.max())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(matrix @ beta)))
        slope = matrix.T @ (p - y) + ridge * beta
        beta -= step * slope
        if np.abs(slope).max() < 1e-7:
            break
    return beta


def plain_fit(matrix, earlier, y):
    pick = telling(matrix, y)
    dense = np.column_stack([matrix[:, pick], earlier, np.ones(len(y))])
    ridge = np.append(np.full(dense.shape[1] - 1, 3.0), 1e-3)
    beta = descent(dense, y, ridge)
    return lambda m, e: 1 / (1 + np.exp(-(np.column_stack([m[:, pick], e, np.ones(len(m))]) @ beta)))


def plain_chain(matrix, labels):
    """(models, out-of-fold predictions) with folds by row number."""
    n, earlier, models = len(matrix), np.zeros((len(matrix), 0)), []
    for c in range(labels.shape[1]):
        held = np.zeros(n)
        for k in range(X.FOLDS):
            out = np.arange(n) % X.FOLDS == k
            held[out] = plain_fit(matrix[~out], earlier[~out], labels[~out, c])(matrix[out], earlier[out])
        models.append(plain_fit(matrix, earlier, labels[:, c]))
        earlier = np.column_stack([earlier, held])
    return models, earlier


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(8)
    matrix = (r.random((360, 14)) < 0.3).astype(float)
    junk = (matrix[:, 0] + matrix[:, 1] + r.random(360) > 1.4).astype(float)
    rude = (matrix[:, 2] + 0.5 * junk + 0.6 * r.random(360) > 1.1).astype(float)
    toxic = (0.8 * rude + matrix[:, 3] + 0.5 * r.random(360) > 1.2).astype(float)  # follows from the category before
    return matrix, np.column_stack([junk, rude, toxic])


def test_chain_equals_plain_descent(data):
    matrix, labels = data
    features = [np.flatnonzero(row).astype(np.uint32) for row in matrix]
    chain = X.train_chain(features, labels, ["junk", "rude", "toxic"])
    got = chain.score(iter(features), len(features))
    models, held = plain_chain(matrix, labels)
    earlier = np.zeros((len(matrix), 0))
    for c, model in enumerate(models):
        p = model(matrix, earlier)
        assert np.abs(p - got[:, c]).max() < 0.02, c
        earlier = np.column_stack([earlier, p])
        best = max(2 * labels[held[:, c] >= t, c].sum() / ((held[:, c] >= t).sum() + labels[:, c].sum()) for t in held[:, c])
        mine = held[:, c] >= chain.cuts[c]
        assert 2 * labels[mine, c].sum() / (mine.sum() + labels[:, c].sum()) > best - 0.04


def test_later_models_use_earlier_categories(data):
    matrix, labels = data
    features = [np.flatnonzero(row).astype(np.uint32) for row in matrix]
    chain = X.train_chain(features, labels, ["junk", "rude", "toxic"])
    assert chain.models[2][1][1] > 1  # what is rude makes toxic likelier
    alone = X.train_chain(features, labels[:, 2:], ["toxic"])
    right = lambda ch, c: ((ch.score(iter(features), len(features))[:, c] >= ch.cuts[c]) == labels[:, 2]).mean()
    assert right(chain, 2) >= right(alone, 0) - 0.01
