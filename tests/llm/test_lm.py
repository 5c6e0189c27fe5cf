import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa

from tidewater.llm import gru, lm

SCHEMA = "doc_id long, text string, held_out string, size int"


def made():
    rows = [(None, "One two"), (1, None), (2, ""), (3, " \n"), (4, "é " * 20), (5, "x" * 10_000)]
    for k in range(6, 300):
        rows.append((k, " ".join(("The cat sat on a mat", "le chat est ici ce soir")[k % 2].split() * (k % 5 + 1)) + f" rare{k}" * (k % 3 == 0)))
    return rows + [rows[-1], rows[-1]]


def base(rows):
    split = [(d, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]) for d, t in rows]
    held = [zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for (_, ws), h in zip(split, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(((d, h, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, ws), h in zip(split, held)), key=str)


def test_base_against_brute_force_and_model_beats_it(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 3000)
    rows = made()
    docs = spark.createDataFrame([(d, t, "no", 1) for d, t in rows], SCHEMA).repartition(3)
    out = lm.scores(docs, vocabulary=12, classes=4, rate=0.1).collect()
    assert sorted([(*r[:5], round(r.base_score, 6)) for r in out], key=str) == base(rows)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in out)
    assert len({round(r.score, 3) for r in out if r.doc_id == rows[-1][0]}) == 1


def test_the_model_knows_all_words_seen_often_enough(spark, monkeypatch):
    sizes, new = [], gru.new
    monkeypatch.setattr(gru, "new", lambda counts, at: sizes.append((len(counts), len(at) - 1)) or new(counts, at))
    monkeypatch.setattr(lm, "PIECE", 1000)
    for n in (500, 4000):
        rows = [(k, " ".join(f"w{i}" for i in range(n)) + f" once{k}", "no", 1) for k in (1, 3, 4) if zlib.crc32(str(k).encode()) % 7 != 2]
        assert len(rows) > 1
        out = lm.scores(spark.createDataFrame(rows, SCHEMA)).collect()
        assert all(r.n_tokens == n + 2 and r.score < 0 for r in out)
    assert [s for s, _ in sizes] == [502, 4002] and sizes[0][1] < sizes[1][1]
    assert lm.least_count(100) == 2 and 2 < lm.least_count(10**6) < lm.least_count(10**8)


def test_partitions_of_the_input_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 3000)
    rows = [(d, t, "no", 1) for d, t in made()]
    got = []
    for order, parts in ((rows, 2), (rows[::-1], 7)):
        out = lm.scores(spark.createDataFrame(order, SCHEMA).repartition(parts), rate=0.1, share=1)
        got.append(sorted(((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in out.collect()), key=lambda x: x[:3]))
    for a, b in zip(*got, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 * abs(b[2]) and abs(a[3] - b[3]) < 1e-6 * abs(b[3])


def test_shards_are_averaged_in_a_tree(spark, monkeypatch):
    """Many shards of few documents, two models at most in a task: scores stay those of a model, and training still helps."""
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "PIECE", 700)
    monkeypatch.setattr(lm, "least_count", lambda n: 2)
    monkeypatch.setattr(lm, "max", lambda *x: 400 if x[0] == 1 << 20 else max(*x), raising=False)
    rows = [(k, " ".join((f"a{k % 5}", f"b{k % 5}") * 20), "no", 1) for k in range(100)]
    out = lm.scores(spark.createDataFrame(rows, SCHEMA), rate=0.2).collect()
    held = [r for r in out if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_numbers_come_back_from_their_planes():
    for n in ([], [0], [1, 70_000, 2**32 - 1, 3]):
        assert lm.unsqueezed(pa.scalar(lm.squeezed(np.array(n, np.int64)), pa.binary())).tolist() == n


def test_empty_table(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).collect() == []


def small():
    counts = np.array([50.0, 30, 20, 10, 5, 4, 3, 2, 1, 0])
    at = gru.classes_of(counts, 4)
    w = gru.new(counts, at)
    draw = np.random.default_rng(0)
    return {k: (v + 0.3 * draw.standard_normal(v.shape)).astype(np.float32) for k, v in w.items()}, at


def test_probabilities_sum_to_one():
    w, at = small()
    h = np.tanh(np.random.default_rng(1).standard_normal((5, gru.HIDDEN))).astype(np.float32)
    total = sum(np.exp(gru.log_likelihood(w, at, h, np.full(5, k))) for k in range(10))
    assert np.allclose(total, 1, atol=1e-5)


def test_gradients_match_differences():
    w, at = small()
    draw = np.random.default_rng(2)
    tokens, keep, h = draw.integers(0, 10, (7, 3)), (draw.random((6, 3)) > 0.2).astype(np.float32), np.zeros((3, gru.HIDDEN), np.float32)
    grad, _, _ = gru.gradients(w, at, tokens[:-1], tokens[1:], keep, h)
    rows, values = grad["embed"]
    grad["embed"] = np.zeros_like(w["embed"])
    grad["embed"][rows] = values
    for name in w:
        at_ = np.unravel_index(np.abs(grad[name]).argmax(), w[name].shape)
        ends = []
        for d in (-1e-2, 1e-2):
            v = {k: x.copy() for k, x in w.items()}
            v[name][at_] += d
            ends.append(gru.gradients(v, at, tokens[:-1], tokens[1:], keep, h)[2])
        # Gradients are those of the negative log likelihood.
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[name][at_]) < 0.03 * max(1, abs(grad[name][at_])), name


def test_state_is_carried_over_windows_and_documents_are_apart():
    w, at = small()
    draw = np.random.default_rng(4)
    documents = [draw.integers(1, 10, n).astype(np.int32) for n in (500, 3, 0, 1, 40, 200)]
    together = gru.score(w, at, documents)
    for d, got in zip(documents, together):
        h, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        before = 0
        for k, token in enumerate([*d.tolist(), 0]):
            h = gru.run(w, np.array([[before]]), np.array([[float(k > 0)]], np.float32), h)[-1][-1]
            total += float(gru.log_likelihood(w, at, h, np.array([token]))[0])
            before = token
        assert abs(total - got) < 1e-2


def test_memory_follows_the_tokens_not_the_longest_text():
    """511 short texts beside one of 300,000 tokens: a rectangle over the longest one would take gigabytes."""
    import tracemalloc

    w, at = small()
    draw = np.random.default_rng(6)
    documents = [draw.integers(1, 10, n).astype(np.int32) for n in [300_000, *[20] * 511]]
    tracemalloc.start()
    together = gru.score(w, at, documents)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60_000_000
    assert together[1:] == pytest.approx(gru.score(w, at, documents[1:]), abs=1e-4) and np.isfinite(together).all()


def plain(w, at, h, target, grad):
    """log_likelihood() with all rows of a class at once, each of its formulas a pass over the logits of its own."""
    kind = np.repeat(np.arange(len(at) - 1), np.diff(at))[target]
    back, out = np.zeros_like(h), np.zeros(len(h), np.float32)

    def softmax(rows, want, w, grad):
        p = h[rows] @ w[:, :-1].T + w[:, -1]
        p = np.exp(np.clip(p, -60, 60, out=p), out=p)
        p *= (1 / (p @ np.ones(p.shape[1], p.dtype)))[:, None]
        out[rows] += np.log(p[np.arange(len(rows)), want])
        p[np.arange(len(rows)), want] -= 1
        grad[:, :-1] += (h[rows].T @ p).T
        grad[:, -1] += np.ones(len(p), p.dtype) @ p
        back[rows] += p @ w[:, :-1]

    for k in range(0, len(h), 2048):
        softmax(np.arange(k, min(k + 2048, len(h))), kind[k : k + 2048], w["wc"], grad["wc"])
    order = np.argsort(kind, kind="stable")
    edge = np.searchsorted(kind[order], np.arange(len(at)))
    for c in np.flatnonzero(np.diff(at) > 1):
        rows = order[edge[c] : edge[c + 1]]
        softmax(rows, target[rows] - at[c], w["ww"][at[c] : at[c + 1]], grad["ww"][at[c] : at[c + 1]])
    grad["h"] = back
    return out


def test_softmaxes_equal_plain_ones_and_clip_nothing_in_vain(monkeypatch):
    """A model of 15,000 words: no pass over the logits for bounds that nothing reaches."""
    counts, draw = np.floor(4e6 / np.arange(1.0, 15_001)), np.random.default_rng(5)
    at = gru.classes_of(counts, gru.how_many_classes(len(counts)))
    w = {k: (v + 0.1 * draw.standard_normal(v.shape)).astype(np.float32) for k, v in gru.new(counts, at).items()}
    h = np.tanh(draw.standard_normal((20_000, gru.HIDDEN))).astype(np.float32)
    target = draw.choice(len(counts), len(h), p=counts / counts.sum())
    grad_a, grad_b = ({x: np.zeros_like(w[x]) for x in ("wc", "ww")} for _ in range(2))
    a, clipped = plain(w, at, h, target, grad_a), []
    monkeypatch.setattr(np, "clip", lambda x, *_, **__: clipped.append(x.size) or x)
    assert np.allclose(a, gru.log_likelihood(w, at, h, target, grad_b), atol=1e-3)
    assert all(np.allclose(grad_a[x], grad_b[x], atol=1e-2, rtol=1e-3) for x in ("wc", "ww", "h"))
    assert not clipped


def test_a_shut_gate_is_zero_without_warning(recwarn):
    w, _ = small()
    w["b"] = np.repeat(np.float32([0, -200, 0]), gru.HIDDEN)  # states take every candidate
    *_, n, after = gru.run(w, np.ones((3, 2), int), np.ones((3, 2), np.float32), np.zeros((2, gru.HIDDEN), np.float32))
    assert np.isfinite(after).all() and np.allclose(after, n, atol=1e-6) and not recwarn.list


def test_logits_of_very_large_weights_stay_finite():
    w, at = small()
    w = {k: v * np.float32(400 if k in ("wc", "ww") else 1) for k, v in w.items()}
    h = np.tanh(np.random.default_rng(1).standard_normal((5, gru.HIDDEN)) * 3).astype(np.float32)
    grad = {k: np.zeros_like(w[k]) for k in ("wc", "ww")}
    each = np.array([gru.log_likelihood(w, at, h, np.full(5, k), grad) for k in range(10)])
    assert np.isfinite(each).all() and all(np.isfinite(g).all() for g in grad.values())
    assert np.allclose(np.exp(each).sum(0), 1, atol=1e-5)
