"""The classifiers' learners against plain ones that are written from their definitions."""

import math

import numpy as np
import pytest

from voxlake.llm import quality, toxicity


def test_preferences_equal_plain_gradient_ascent():
    """The mean log chance that the good one of each pair is preferred, less the ridge, climbed step by step."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, len(quality.FEATURES)))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=60) * 0.8 > 0.4).astype(int)
    model = quality.fit_preferences(x, y)
    mean, scale = x.mean(0), x.std(0)
    z = np.clip((x - mean) / scale, -6, 6)
    good, poor = [z[k] for k in range(60) if y[k]], [z[k] for k in range(60) if not y[k]]
    most = max(len(good), len(poor))
    pairs = [good[r % len(good)] - poor[(r + k * (most // quality.OPPONENTS + 1)) % len(poor)] for k in range(quality.OPPONENTS) for r in range(most)]
    d, w = np.array(pairs), np.zeros(x.shape[1])
    for _ in range(60_000):
        gradient = (d / (1 + np.exp(d @ w))[:, None]).mean(0) - quality.RIDGE * w
        w += 0.2 * gradient
        if np.abs(gradient).max() < 1e-8:
            break
    np.testing.assert_allclose(model.weights, w, atol=2e-3 * max(1, np.abs(w).max()))
    # The threshold parts as many scores as there are poor ones.
    assert ((z @ np.array(model.weights)) < model.threshold).sum() == len(poor)
    own = model.score(x)
    assert ((own < 0.5) == ((z @ np.array(model.weights)) < model.threshold)).all()


def scalar_ftrl(rows, y):
    """One coordinate after another, with nothing but floats and dictionaries."""
    documents = {}
    for row in rows:
        for i in set(row):
            documents[i] = documents.get(i, 0) + 1
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == "bias" else toxicity.L1
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -math.copysign(abs(zi) - l1, zi) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for row, label in zip(rows, y, strict=True):
            own = [i for i in row if documents[i] >= toxicity.MIN_DOCS] + ["bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-max(-50, min(50, sum(w.values()))))) - label
            for i in own:
                was = n.get(i, 0.0)
                now = was + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(now) - math.sqrt(was)) / toxicity.ALPHA * w[i]
                n[i] = now
    found = {i: weight(i) for i in z}
    return {i: w for i, w in found.items() if w and i != "bias"}, found.get("bias", 0.0)


def test_ftrl_equals_a_scalar_one():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(500):
        label = int(rng.random() < 0.4)
        own = set(rng.integers(100, 200, 12).tolist()) | ({int(rng.integers(0, 6))} if label and rng.random() < 0.9 else set()) | ({int(rng.integers(6, 9))} if not label else set())
        rows.append(np.array(sorted(own), np.int32))
        y.append(label)
    rows.append(np.array([7, 999_999], np.int32))  # a gram that one document has gets no weight
    y.append(1)
    model = toxicity.fit(rows, y)
    weights, bias = scalar_ftrl([r.tolist() for r in rows], y)
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(weights, rel=1e-5)
    assert model.bias == pytest.approx(bias) and set(range(6)) <= set(weights) and 999_999 not in weights and len(weights) < 80
    table = model.dense()
    for row in (np.array([0, 1, 1, 150], np.int32), np.array([7], np.int32), np.zeros(0, np.int32)):
        total = bias + sum(weights.get(int(i), 0.0) for i in set(row.tolist()))
        assert model.score(row, table) == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-5)
