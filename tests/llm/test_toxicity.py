import math
import random
import zlib

import numpy as np

from tidewater.llm import toxicity

SCHEMA = "doc_id long, text string, score string, toxic int"
LABELS = "doc_id long, quality int, toxic int"


def made(seed=1, n=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abehinorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        text = [r.choice(vocabulary) for _ in range(r.randint(5, 300))]
        toxic = k % 5 == 0
        if toxic:
            text[r.randrange(len(text))] = r.choice(["vile", "Vileness", "viler"]) + r.choice(["", ",", "!"])
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = made()
    odd = [(None, "who"), (901, None), (902, ""), (903, "x" * 50_000), (904, "vile " * 20_000), (905, " \n"), (904, "vile " * 20_000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows + odd], SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None), (2, 1, 0), (2, 1, 0)], LABELS)
    out = toxicity.toxicity(docs, known).collect()
    assert len(out) == len(rows) + len(odd)
    for r in out:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    truth = {d: t for d, _, t in labels}
    held = [(truth[r.doc_id], r.predicted) for r in out if r.doc_id in truth and r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    score = {r.doc_id: r.score for r in out}
    assert score[901] == score[902] == score[905] and score[904] > 0.5


def test_labels_of_held_out_rows_don_t_matter(spark):
    rows, labels = made(2, 200)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert toxicity.toxicity(docs, none).first().score == 0.5
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), none).collect() == []


def plain_features(text):
    """Features by their definition: n-grams of each distinct word between two blanks, counted by the distinct words that hold them (once for each place)."""
    import re

    found = sorted(set(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))))
    out = {}
    for word in found:
        framed = f" {word} ".lower()
        for n in toxicity.ORDERS:
            for i in range(len(framed) - n + 1):
                h = n
                for c in framed[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
                    h ^= h >> 31
                out[h % toxicity.BUCKETS] = out.get(h % toxicity.BUCKETS, 0) + 1
    return {b: c / math.sqrt(max(1, len(found))) for b, c in out.items()}


def plain_fit(rows, labels, passes=8, batch=32, rate=0.3, l2=1e-4):
    """Log-count ratios and logistic regression by AdaGrad, one number at a time."""
    sums = [{}, {}]  # a text counts a feature once
    for x, y in zip(rows, labels):
        for b in x:
            sums[y][b] = sums[y].get(b, 0) + 1
    total = [toxicity.BUCKETS + sum(s.values()) for s in sums]
    known = set(sums[0]) | set(sums[1])
    r = {b: math.log((sums[1].get(b, 0) + 1) / total[1]) - math.log((sums[0].get(b, 0) + 1) / total[0]) for b in known}
    w, bias, seen, seen_b = dict.fromkeys(known, 0.0), 0.0, dict.fromkeys(known, 1e-3), 1e-3
    n = [len(labels) - sum(labels), sum(labels)]
    draw = np.random.default_rng(5)
    for _ in range(passes):
        order = draw.permutation(len(labels))
        for k in range(0, len(order), batch):
            grad, g_b, some = {}, 0.0, order[k : k + batch]
            for i in some:
                z = bias + sum(w[b] * x * r[b] for b, x in rows[i].items())
                g = (1 / (1 + math.exp(-z)) - labels[i]) * len(labels) / (2 * n[labels[i]]) / len(some)
                g_b += g
                for b, x in rows[i].items():
                    grad[b] = grad.get(b, 0.0) + g * x * r[b]
            for b, g in grad.items():
                g += l2 * w[b]
                seen[b] += g * g
                w[b] -= rate * g / math.sqrt(seen[b])
            seen_b += g_b * g_b
            bias -= rate * g_b / math.sqrt(seen_b)
    return {b: w[b] * r[b] for b in known}, bias


def test_features_ratios_and_scores_against_a_plain_version(spark):
    rows, labels = made(3, 90)
    rows = [(d, t + (" ÄRGER é\u3000z\tx\n" if d % 3 == 0 else " a  ")) for d, t in rows] + [(500, ""), (501, None), (502, "abababab abababab aaaaaaaa")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    truth = {d: t for d, _, t in labels}
    train = sorted(d for d in truth if zlib.crc32(str(d).encode()) % 5)
    texts = dict(rows)
    weights, bias = plain_fit([plain_features(texts[d]) for d in train], [truth[d] for d in train])
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()}
    for d, text in rows:
        z = bias + sum(x * weights.get(b, 0.0) for b, x in plain_features(text).items())
        assert abs(got[d] - 1 / (1 + math.exp(-z))) < 2e-3, (d, got[d], z)
