import numpy as np
import pytest

from tidewater.llm import ann, cosine

SCHEMA = "vec_id long, embedding array<float>, label int, score string, bucket int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "s", 1) for i, v in rows], SCHEMA).repartition(3)


def odd(n):
    return [(9001, None), (9002, [0.0] * n), (9003, [float("nan")] * n), (9004, [float("inf")] + [1.0] * (n - 1)), (9005, [None] + [1.0] * (n - 1)), (9006, []), (None, [1.0] * n)]


def vectors(seed, n, dims, scale=False):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims)).astype(np.float32)
    near = x[r.integers(0, n, n // 3)] + 0.1 * r.standard_normal((n // 3, dims)).astype(np.float32)
    x[-(n // 3) :] = near
    x[5:25] = x[3]
    return x * r.uniform(0.5, 3, (n, 1)).astype(np.float32) if scale else x


@pytest.mark.parametrize(("lists", "scale"), [(None, False), (9, True)])
def test_nearest(spark, lists, scale):
    x = vectors(1, 900, 24, scale)
    out = ann.nearest(table(spark, [*enumerate(x.tolist()), (9020, [1.0] * 7), *odd(24)]), lists=lists).collect()
    y, hit = x.astype(np.float64), 0
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 900, 20))
    for q, rows in got.items():
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hit += len({r.vec_id for r in rows} & set(best.tolist()))
    assert hit / (20 * len(got)) >= 0.9


def test_few_rows_and_none(spark):
    x = vectors(2, 30, 5)[:12]
    out = ann.nearest(table(spark, [(20 * k, v) for k, v in enumerate(x.tolist())])).collect()
    assert len(out) == 12 * 11
    assert ann.nearest(table(spark, odd(3))).collect() == []
    assert ann.nearest(table(spark, [])).collect() == []


def test_tests_abandon_most_and_keep_the_near():
    r = np.random.default_rng(3)
    points, query = r.standard_normal((4000, 64)), r.standard_normal((5, 64))
    d = ann.distances(query, points)
    radius = np.sort(d, 1)[:, 19]
    q, p = ann.scan(query, radius, points, 2.1)
    assert len(q) <= 100 and sum(d[i, j] <= radius[i] for i, j in zip(q, p)) == len(q) >= 95


def brute(x, threshold=0.95):
    y = x.astype(np.float64)
    c = y @ y.T / np.sqrt((y**2).sum(1)[:, None] * (y**2).sum(1)[None])
    link = c >= threshold
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min(comp[i], comp[link[i]].min(initial=comp[i])) for i in range(len(x))])
        if (new == comp).all():
            return link.sum(1), comp
        comp = new


@pytest.mark.parametrize("block", [1500, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(cosine, "BLOCK", block)
    x = vectors(4, 300, 16, True)
    out = {r.vec_id: r for r in cosine.near_duplicates(table(spark, [*enumerate(x.tolist()), *odd(16)])).collect()}
    links, comp = brute(x)
    assert links.max() > 15
    for i in range(300):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (links[i], comp[i], comp[i] == i)
    for i, _ in odd(16):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, i is not None)


def test_no_vectors(spark):
    assert cosine.near_duplicates(table(spark, [])).collect() == []


def test_lengths_are_searched_by_themselves_and_ids_may_repeat(spark):
    """Vectors of two lengths; vec_id 40 has one of each, vec_id 3 two different ones and a copy."""
    r = np.random.default_rng(8)
    rows = [(k, r.standard_normal(6).tolist()) for k in range(45)] + [(100 + k, r.standard_normal(4).tolist()) for k in range(41)]
    rows += [(40, r.standard_normal(4).tolist()), (3, rows[7][1]), (3, rows[3][1])]
    got = {}
    for x in ann.nearest(table(spark, rows), k=5).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, round(x.score, 9)))
    want = {}
    known = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows]
    for q, v in known:
        if q % 20 == 0:
            for i, w in known:
                if i != q and len(w) == len(v):
                    want.setdefault(q, {})[i] = max(want.get(q, {}).get(i, -np.inf), float((v * w).sum()))
    assert set(got) == set(want) == {0, 20, 40, 100, 120, 140}
    for q, near in want.items():
        best = sorted(near.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got[q]) == [(k + 1, i, round(s, 9)) for k, (i, s) in enumerate(best)]


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share a vec_id share their component; every row counts as a link of its equals."""
    a, b = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    out = sorted(map(tuple, cosine.near_duplicates(table(spark, [(5, a), (5, b), (7, a), (9, b), (2, [-1.0, 0.0, 0.0])])).collect()))
    assert {x[0]: x[2] for x in out} == {2: 2, 5: 5, 7: 5, 9: 5} and len(out) == 5


def test_one_id_with_different_vectors_links_them(spark):
    """3 and 5 share a vector, 5 and 7 another; 8 holds two of which one is near 9."""
    a, b, c, d = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, d), (9, [0.0, 0.0, 0.1, 1.0]), (10, c)]
    out = sorted((r.vec_id, r.component_id, r.kept) for r in cosine.near_duplicates(table(spark, rows)).collect())
    assert out == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True), (8, 8, True), (9, 8, False), (10, 8, False)]
