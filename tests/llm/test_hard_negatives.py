import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor_id int, i int, dims string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "s", 1, 2, "d") for i, v, label in rows], SCHEMA).repartition(3)


def mined(spark, rows, every=50, **options):
    out = hard_negatives.mine(table(spark, rows), F.col("vec_id") % every == 0, **options)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def plain(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    """Loops over distinct sound rows."""
    sound = {(i, label, tuple(int(np.floor(np.float32(x).astype(float) * scale)) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    anchors = {}
    for i, label, v in sorted(sound, reverse=True):
        if i % every == 0:
            anchors[i] = (label, v)
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own == label) for i, own, w in sound if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, i) for n, i, same in scored if not same and -low * s <= -100 * n <= -high * s][:negatives]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def test_keys_sort_as_intended():
    rows = [(a, s, n, i) for a in (-7, 0, 3) for s in (2**63 - 1, 5, 0, -1, -(2**63)) for n in (False, True) for i in (-2, 0, 9)]
    assert sorted(map(tuple, rows), key=lambda r: hard_negatives.pack(*r)) == rows
    assert all(hard_negatives.unpack(hard_negatives.pack(*r)) == r for r in rows)


@pytest.mark.parametrize("s", [0, 1, 7, 100, 12345])
def test_window_ends(s):
    a, b = hard_negatives.window_ends(s, 50, 95)
    fit = [n for n in range(-5, s + 5) if 50 * s <= 100 * n <= 95 * s]
    assert [n for n in range(-5, s + 5) if a <= n <= b] == fit


@pytest.mark.parametrize("cells", [None, (3, 40)])
def test_against_loops_with_ties_and_hot_label(spark, monkeypatch, cells):
    if cells:  # many cells, some of them without anchors
        monkeypatch.setattr(hard_negatives, "ANCHORS", cells[0])
        monkeypatch.setattr(hard_negatives, "ROWS", (cells[1], cells[1]))
    r = np.random.default_rng(5)
    x = r.integers(-3, 4, (700, 6)) / 8.0  # few distinct values: many ties
    label = np.where(r.random(700) < 0.4, 0, r.integers(0, 6, 700))
    rows = [(k, x[k].tolist(), int(label[k])) for k in range(700)]
    want = plain(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_rows_left_out_and_odd_ones(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 1.0], 1), (2, [0.7, 0.4], 2), (3, [0.6, 0.4], 2), (4, [0.5, 0.5], 3)]
    odd = [(None, [1.0, 1.0], 1), (60, None, 1), (61, [1.0, None], 1), (62, [float("nan"), 1.0], 2), (63, [float("inf"), 1.0], 2), (64, [1.0, 1.0], None), (65, [1.0], 1), (66, [], 1), (100, [1.0, 2.0, 3.0], 5)]
    assert mined(spark, rows + odd) == plain(rows) != []
    assert mined(spark, []) == mined(spark, odd) == []


def test_repeated_rows_and_ids(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 1.0], 1), (2, [0.7, 0.4], 2), (3, [0.6, 0.4], 2), (4, [0.5, 0.5], 3), (2, [0.5, 0.6], 2), (0, [0.9, 0.9], 2), (0, [1.0, 0.25], 1), (50, [0.5, 1.0], 2)]
    want = plain(rows)
    assert mined(spark, rows) == mined(spark, rows * 3) == want
    assert {r[0] for r in want} == {0, 50}


def test_negative_zero_and_huge_scores(spark):
    rows = [(0, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (4, [0.0, -1.0], 2)]
    assert mined(spark, rows) == plain(rows) == [(0, 2, 1, 3, 0, 0), (0, 2, 2, 4, 0, 0)]
    huge = [(0, [3e6, 3e6], 1), (1, [3e6, 2.9e6], 1), (2, [2e6, 2e6], 2)]  # beyond 2**53, within a long
    assert mined(spark, huge) == plain(huge) != []
    assert mined(spark, [(0, [3e30], 1), (1, [3e30], 1), (2, [2e30], 2)]) == []  # beyond a long: no score
