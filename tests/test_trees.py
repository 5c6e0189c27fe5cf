"""Fits of all cells in one job, and their trees, against plain Python."""

import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import dataset, model, trees
from tidewater.plans import mining


def loops(x, y, w, leaves, least):
    """A leaf-wise tree as nested lists of rows: every threshold of every leaf is tried."""
    value = lambda rows: sum(w[r] * y[r] for r in rows) / sum(w[r] for r in rows)
    score = lambda rows: sum(w[r] * y[r] for r in rows) ** 2 / sum(w[r] for r in rows)
    parts, splits = [list(range(len(y)))], {}
    while len(parts) < leaves:
        found = []
        for k, rows in enumerate(parts):
            for f in range(len(x[0])):
                values = sorted({x[r][f] for r in rows})
                for a, b in zip(values, values[1:]):
                    low = [r for r in rows if x[r][f] <= a]
                    high = [r for r in rows if x[r][f] > a]
                    if min(len(low), len(high)) >= least:
                        found.append((score(low) + score(high) - score(rows), -k, -f, -a, low, high))
        if not found or max(found)[0] <= 1e-12:
            break
        _, k, _, _, low, high = max(found)
        parts[-k : -k + 1] = [low, high]
    out = [0.0] * len(y)
    for rows in parts:
        for r in rows:
            out[r] = value(rows)
    return out, splits


@pytest.mark.parametrize(("leaves", "least"), [(2, 1), (6, 3), (200, 1)])
def test_a_tree_against_loops(leaves, least):
    r = np.random.default_rng(3)
    x, y, w = r.integers(0, 9, (60, 3)).astype(float), r.standard_normal(60), r.uniform(0.5, 2, 60)
    bins = trees.binned(x, trees.edges_of(x))
    got = trees.grow(bins, y, w, leaves, least, 0.0).predict(bins)
    assert got == pytest.approx(loops(x.tolist(), y.tolist(), w.tolist(), leaves, least)[0], abs=1e-9)


def test_boosting_against_loops():
    r = np.random.default_rng(4)
    x = r.integers(0, 6, (50, 2)).astype(float)
    y, w = x[:, 0] * 2 + r.standard_normal(50), np.ones(50)
    done = np.full(50, y.mean())
    for _ in range(4):
        done += 0.1 * np.array(loops(x.tolist(), (y - done).tolist(), w.tolist(), 5, 2)[0])
    assert trees.boosted(x, y, w, x, 0, 4, leaves=5, least_rows=2) == pytest.approx(done, abs=1e-9)


def test_models_learn_and_meet_odd_samples():
    r = np.random.default_rng(5)
    x = r.uniform(-1, 1, (3000, 4))  # more values than bins
    y = np.sign(x[:, 1]) + x[:, 2] ** 2
    for f in model.MODELS.values():
        error = f(x[:2000], y[:2000], np.ones(2000), x[2000:], 1, 40) - y[2000:]
        assert (error**2).mean() < 0.1 * y.var()
        assert f(x[:1], y[:1], np.ones(1), x[:3], 1, 3) == pytest.approx([y[0]] * 3)
        assert f(x[:50] * 0, y[:50], np.ones(50), x[:2], 1, 3) == pytest.approx([y[:50].mean()] * 2, abs=0.5)
        assert len(f(x[:50], y[:50], np.ones(50), x[:0], 1, 3)) == 0


def test_all_cells_in_one_job(spark):
    """Every cell by itself gives the same; partitions change nothing; a number of jobs that cells don't change."""
    r = random.Random(9)
    rows = [("1.0", d, p, k, side, c, t, float(c % 7 + t), r.random(), float(c), None) for d in (1, 2) for p in (1, 2) for k in (0, 1) for side, many in (("train", 30), ("eval", 8)) for c in range(many) for t in (1, 2)]
    made = spark.createDataFrame(rows, "version string, d int, p int, repeat int, side string, change_id long, t int, label double, weight double, a double, b double")
    go = lambda df: sorted(map(tuple, model.all_cells(df, ["a", "b"], list(model.MODELS), ["version"], trees=5).collect()))
    whole = go(made.repartition(5))
    assert len(whole) == 2 * 8 * 16 and whole == go(made.repartition(2, F.rand(1)))
    part = go(made.filter("d = 2 and p = 1 and repeat = 1"))
    assert part == [x for x in whole if x[2:5] == (2, 1, 1)] and len(part) == 32
    assert all(x[7] == x[6] % 7 + x[5] for x in whole)
    assert go(made.filter("side = 'eval'")) == go(made.limit(0)) == []
    assert len(dataset.cells()) == 36


def test_samples_fitted_together_are_as_alone():
    """Samples of other sizes, other numbers of bins and one that ends early; a forest's trees grow together as one by one."""
    r, samples = np.random.default_rng(6), []
    for rows, values in ((300, 9), (50, 400), (700, 3), (40, 1)):
        x = r.integers(0, values, (rows, 4)).astype(float)
        samples.append((x, x[:, 0] + r.standard_normal(rows) * (values > 1), r.uniform(0.5, 2, rows), x[:20] + 0.5))
    made = model.TOGETHER["gradient_boosting"](samples, [1] * 4, 12)
    assert all((got == trees.boosted(*s, 1, 12)).all() and len(got) == 20 for got, s in zip(made, samples))
    bins = trees.binned(samples[0][0], trees.edges_of(samples[0][0]))
    w = r.integers(0, 3, (5, 300)).astype(float)
    grown, said = trees.grow_each(bins, samples[0][1], w, 20, 1, 0.0)
    each = np.stack([trees.grow(bins, samples[0][1], x, 20, 1, 0.0).predict(bins) for x in w])
    assert (grown.predict_each(bins) == each).all() and (said == np.where(w > 0, each, 0)).all()


def test_train_predict_fits_whole_models(spark, monkeypatch):
    """Two hundred trees of both models for all cells and repeats, as the reference's settings are."""
    seen, plain = [], inspect.signature(model.all_cells)
    monkeypatch.setattr(model, "all_cells", lambda *a, **k: seen.append(plain.bind(*a, **k)) or a[0])
    mining.train_predict(spark, "/root/testdata/sf0.001")
    seen[0].apply_defaults()
    assert seen[0].arguments["trees"] == 200 and seen[0].arguments["models"] == list(model.MODELS) and seen[0].arguments["features"] == dataset.FEATURES
