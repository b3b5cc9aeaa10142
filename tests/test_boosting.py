"""Boosting against a naive booster that sorts values and tries every split of every leaf."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustline.plans import boosting, model


def naive_tree(x, residual, setting, absolute):
    """Leaves as (rows, value), grown best first."""
    g = -np.sign(residual) if absolute else -residual
    l2, least = setting["l2"], setting["least_rows"]

    def best(rows):
        found = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= least:
                    gain = sum(g[r].sum() ** 2 / (len(r) + l2) * s for r, s in ((left, 1), (right, 1), (rows, -1)))
                    if gain > 1e-10 and (found is None or gain > found[0] + 1e-9 * max(1, gain)):
                        found = (gain, left, right)
        return found

    leaves = [(np.arange(len(x)), best(np.arange(len(x))))]
    while len(leaves) < setting["leaves"] and any(b for _, b in leaves):
        i = max((k for k, (_, b) in enumerate(leaves) if b), key=lambda k: leaves[k][1][0])
        _, left, right = leaves.pop(i)[1]
        leaves += [(left, best(left)), (right, best(right))]
    value = lambda rows: np.median(residual[rows]) if absolute else residual[rows].sum() / (len(rows) + l2)
    return [(rows, setting["step"] * value(rows)) for rows, _ in leaves]


def naive(x, y, setting, rounds, absolute):
    raw = np.full(len(y), np.median(y) if absolute else y.mean())
    for _ in range(rounds):
        residual = y - raw
        for rows, value in naive_tree(x, residual, setting, absolute):
            raw[rows] += value
    return raw


def table(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 30, n), np.round(rng.random(n), 2), rng.integers(0, 4, n)], axis=1).astype(float)
    y = np.clip(0.4 + 0.2 * (x[:, 0] > 11) - 0.3 * x[:, 1] * (x[:, 2] > 1) + rng.normal(size=n) * 0.05, 0, 1)
    rows = [(f"s{i}", float(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, accuracy double, a double, b double, c double"), x, y


SETTINGS = [{"step": 0.1, "leaves": 6, "least_rows": 8, "l2": 0.0}, {"step": 0.3, "leaves": 15, "least_rows": 20, "l2": 0.7}, {"step": 0.2, "leaves": 2, "least_rows": 1, "l2": 5.0}]


@pytest.mark.parametrize("loss", ["mse", "mae"])
def test_boosting_equals_naive(spark, monkeypatch, loss):
    monkeypatch.setattr(boosting, "KEEP_EVERY", 2)
    for name, value in (("TASK_ROWS", 200), ("TASK_BYTES", 1 << 14), ("TASK_LEAVES", 5)):
        monkeypatch.setattr(boosting, name, value)
    df, x, y = table(spark)
    n = len(y)
    y_odd = y if loss == "mse" else y[: n - 1]
    df = df if loss == "mse" else df.where(f"sample_id <> 's{n - 1}'")
    fitted = boosting.boost(df.repartition(3), ["a", "b", "c"], SETTINGS, 3, loss)
    for (booster, *_), setting in zip(fitted, SETTINGS):
        assert max(len(t.value) for t in booster.trees) <= 2 * setting["leaves"] - 1
        want = naive(x[: len(y_odd)], y_odd, setting, 3, loss == "mae")
        assert np.abs(booster.raw(x[: len(y_odd)]) - want).max() < (1e-9 if loss == "mse" else 3 / boosting.RESIDUAL_BINS)


def test_held_rows_are_judged_and_not_learned_from(spark):
    df, x, y = table(spark, 150)
    held = F.substring("sample_id", -1, 1) == "3"
    out = np.array([i % 10 == 3 for i in range(150)])
    (booster, absolute, squared), = boosting.boost(df, ["a", "b", "c"], SETTINGS[:1], 4, "mse", held)
    alone = boosting.boost(df.where(~held), ["a", "b", "c"], SETTINGS[:1], 4, "mse")[0][0]
    raw = booster.raw(x)
    assert np.allclose(raw, alone.raw(x)) and np.isclose(absolute, np.abs(raw - y)[out].mean()) and np.isclose(squared, ((raw - y)[out] ** 2).mean())


def test_settings_side_by_side_choose_as_one_by_one(spark):
    df, *_ = table(spark, 200)
    together = model.train(df, ["a", "b", "c"], grid=[*SETTINGS, SETTINGS[1]], rounds=3)
    apart = [boosting.boost(df.repartition(2), ["a", "b", "c"], [s], 3, "mae", model.is_validation("sample_id", 13))[0][1] for s in SETTINGS]
    assert np.allclose(together.chosen["scores"], [*apart, apart[1]]) and together.chosen["scores"].index(min(together.chosen["scores"])) < 3
    assert {k: together.chosen[k] for k in SETTINGS[0]} == SETTINGS[int(np.argmin(apart))]


def test_constant_features_few_rows_and_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "sample_id string, accuracy double, a double")
    booster = boosting.boost(make([("s", 0.25, 1.0), ("t", 0.75, 1.0)]), ["a"], SETTINGS[:1], 2, "mse")[0][0]
    assert [len(t.value) for t in booster.trees] == [1, 1] and booster.raw(np.array([[1.0], [9.0]])).tolist() == [0.5, 0.5]
    with pytest.raises(ValueError):
        boosting.boost(make([]), ["a"], SETTINGS[:1], 1)
    with pytest.raises(Exception, match="null"):
        boosting.boost(make([("s", 0.5, None), ("t", 0.5, 1.0)]), ["a"], SETTINGS[:1], 1)


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(4000).selectExpr("concat('s', id) AS sample_id", "id / 4000.0D AS accuracy", "cast(id * 7919 % 4000 AS double) AS a", "cast(id AS double) AS b")
    booster = boosting.boost(df, ["a", "b"], [{"step": 1.0, "leaves": 15, "least_rows": 40, "l2": 0.0}], 1, "mse")[0][0]
    assert all(len(e) <= 254 for e in booster.edges) and set(booster.trees[0].feature.tolist()) == {-1, 1}
    raw = booster.raw(np.stack([np.zeros(4000), np.arange(4000)], axis=1))
    assert np.abs(raw - np.arange(4000) / 4000).max() < 0.08 and len(np.unique(raw)) == 15
