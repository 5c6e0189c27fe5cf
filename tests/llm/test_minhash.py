import random
import re

import numpy as np
import pytest

from tidewater.llm import minhash

SCHEMA = "doc_id long, text string, doc_id_2 int, key string, bands string"


def brute(rows, shingle, percent=80):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w)} if 0 < len(w) < shingle else {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)})
    parent = {d: d for d, _ in rows if d is not None}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            n = len(sets[i] & sets[j])
            if a is not None and b is not None and n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), d if d is None or not s else root(d), d is not None and (not s or root(d) == d)) for (d, _), s in zip(rows, sets)), key=str)


def made(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 120))] for _ in range(6)]
    rows = [(None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "x" * 50_000), (7, "x" * 50_000)]
    for k in range(10, 10 + n):
        text = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(text) // 12))):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        rows.append((k, " ".join(text)))
    return rows + [rows[-1], rows[-1]]


@pytest.mark.parametrize(("shingle", "chunk"), [(2, 400), (2, 7), (5, 9)])
def test_against_brute_force(spark, monkeypatch, shingle, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = made(shingle * chunk)
    docs = spark.createDataFrame([(d, t, 1, "k", None) for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, shingle).collect()), key=str)
    assert got == brute(rows, shingle)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    a, b = np.arange(1, 901, dtype=np.uint64), np.arange(101, 1001, dtype=np.uint64)
    sets = np.concatenate([a, b, a[:1]])
    out = minhash.sketches(sets, np.array([0, 900, 1800, 1801, 1801]), 252)
    assert (out[:3] != np.uint64((1 << 64) - 1)).all()
    assert (out[3] == np.uint64((1 << 64) - 1)).all()
    assert abs((out[0] == out[1]).mean() - 0.8) < 0.1


def boilerplate(n, seed, common=90, own=40):
    """n documents that share most of their words, near copies of every tenth, and copies of the first."""
    r = random.Random(seed)
    shared = [f"s{r.randrange(10**6)}" for _ in range(common)]
    rows = [(k, " ".join([*shared, *(f"u{r.randrange(10**9)}" for _ in range(own))])) for k in range(n)]
    near = [(n + k, f"{rows[k][1]} end") for k in range(0, n, 10)]
    return rows + near + [(2 * n + k, f"c{k} {rows[0][1]}") for k in range(n // 3)]


@pytest.mark.parametrize(("hubs", "rulers", "direct"), [(4, 12, 0), (1, 2, 2), (0, 0, 9)])
def test_boilerplate_groups_against_brute_force(spark, monkeypatch, hubs, rulers, direct):
    monkeypatch.setattr(minhash, "CHUNK", 15)
    monkeypatch.setattr(minhash, "HUBS", hubs)
    monkeypatch.setattr(minhash, "RULERS", rulers)
    monkeypatch.setattr(minhash, "DIRECT", direct)
    monkeypatch.setattr(minhash, "banding", lambda n, percent: (60, 3))
    rows = boilerplate(90, hubs)
    docs = spark.createDataFrame([(d, t, 1, "k", None) for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, 2).collect()), key=str)
    assert got == brute(rows, 2)


def test_one_id_with_different_texts_links_them(spark):
    """3 and 5 share a text, 5 and 7 another; 8 holds two, of which one is a near copy of 9."""
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(3, text(1)), (5, text(1)), (5, text(2)), (7, text(2)), (8, text(3)), (8, text(4)), (9, text(4) + " more"), (10, text(3)), (11, text(5)), (5, None)]
    out = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame([(d, t, 1, "k", None) for d, t in rows], SCHEMA)).collect())
    assert out == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (7, 3, False), (8, 8, True), (8, 8, True), (9, 8, False), (10, 8, False), (11, 11, True)]
