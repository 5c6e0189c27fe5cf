"""Toxicity scores from character n-grams: a linear classifier over features scaled by naive Bayes log-count ratios.

The features of a text are the n-grams of 3 to 5 characters of its distinct words, each word between two blanks and in
lower case; a feature counts the distinct words that hold the n-gram, and n-grams are hashed into buckets. For every
bucket, r is the log ratio of its smoothed shares in toxic and in other training texts; the classifier is a logistic
regression on count * r, divided by the square root of the number of distinct words.

The classifier is fitted on a bounded sample of labelled rows (at most `max_per_class` of each label, taken by a hash
of doc_id), in one task, with both labels weighing the same. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words
from tidewater.llm.common import crc32_text

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
SLICE = 4 << 20


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, str]:
    """Row and word number of each distinct word of each row; the distinct words, joined and framed by blanks."""
    raw, at = words.as_bytes(column, lower=True)
    starts, ends, first = words.spans(raw, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), " "
    _, one, word = np.unique(words.hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    pair = np.unique(row * len(one) + word)
    size = ends[one] - starts[one] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 0x20, np.uint8)
    inner = np.arange(to[-1]) - np.repeat(to[:-1], size)
    keep = inner < np.repeat(size - 1, size)
    out[keep] = raw[(np.repeat(starts[one], size) + inner)[keep]]
    return pair // len(one), pair % len(one), " " + out.tobytes().decode()


def ngrams(joined: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word number and bucket of all n-grams of the given words, one order after another."""
    low = joined.lower()
    code = np.frombuffer((low if low.count(" ") == joined.count(" ") else joined).encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = code == 32
    before = np.cumsum(blank)
    for n in ORDERS:
        if len(code) < n:
            continue
        h, inside = np.full(len(code) - n + 1, n, np.uint64), np.ones(len(code) - n + 1, bool)
        for k in range(n):
            h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + code[k : len(code) - n + 1 + k])
            if 0 < k < n - 1:
                inside &= ~blank[k : len(code) - n + 1 + k]
        at = np.flatnonzero(inside)
        yield before[at + 1] - 1, (h[at] % np.uint64(BUCKETS)).astype(np.int64)


def score_texts(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    row, word, joined = distinct_words(column)
    of_word = np.zeros(joined.count(" ") + 1)
    for w, bucket in ngrams(joined):
        of_word += np.bincount(w, weights[bucket], len(of_word))
    n = np.bincount(row, minlength=len(column))
    z = np.bincount(row, of_word[word], len(column)) / np.sqrt(np.maximum(n, 1)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: offsets, buckets and counts divided by the root of the number of distinct words."""
    row, word, joined = distinct_words(column)
    order = np.argsort(word, kind="stable")
    row, word = row[order], word[order]
    rows_of = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=joined.count(" ") + 1))])
    keys = []
    for w, bucket in ngrams(joined):
        n = rows_of[w + 1] - rows_of[w]
        at = np.repeat(rows_of[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        keys.append(row[at] * BUCKETS + np.repeat(bucket, n))
    key, count = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(column)), 1))
    return np.searchsorted(key, np.arange(len(column) + 1) * BUCKETS), key % BUCKETS, count * scale[key // BUCKETS]


def fit(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray, passes: int = 8, batch: int = 32, rate: float = 0.3, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights (already times r) and bias, by AdaGrad over small batches in a fixed order."""
    size = np.concatenate([np.diff(p[0]) for p in parts])
    at = np.concatenate([[0], np.cumsum(size)])
    bucket, value = np.concatenate([p[1] for p in parts]).astype(np.int32), np.concatenate([p[2] for p in parts]).astype(np.float32)
    of = np.repeat(label, size)
    p, q = (np.bincount(bucket[of == k], minlength=BUCKETS) + 1.0 for k in (1, 0))
    r = np.log((p / p.sum()) / (q / q.sum()))
    value = value * r[bucket].astype(np.float32)
    w, b, seen, seen_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-3), 1e-3
    weight = np.where(label == 1, len(label) / max(1, 2 * label.sum()), len(label) / max(1, 2 * (1 - label).sum()))
    draw = np.random.default_rng(5)
    for _ in range(passes):
        order = draw.permutation(len(label))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            take = np.concatenate([np.arange(at[i], at[i + 1]) for i in rows])
            doc = np.repeat(np.arange(len(rows)), size[rows])
            z = np.bincount(doc, w[bucket[take]] * value[take], len(rows)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label[rows]) * weight[rows] / len(rows)
            touched, inverse = np.unique(bucket[take], return_inverse=True)
            grad = np.bincount(inverse, g[doc] * value[take]) + l2 * w[touched]
            seen[touched] += grad**2
            w[touched] -= rate * grad / np.sqrt(seen[touched])
            seen_b += g.sum() ** 2
            b -= rate * g.sum() / np.sqrt(seen_b)
    return w * r, b


def train(documents: DataFrame, labels: DataFrame, max_per_class: int = 3000) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows whose crc32(doc_id) mod 5 is not 0.

    A doc_id with several labels counts as toxic if one of them says so; null labels are none. Without a toxic and a
    clean row among the documents the weights are zero (see learnt()) and the bias is that of the label counts.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(crc32_text("doc_id") % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    picked = None
    for k in (0, 1):
        some = known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * max_per_class ids: their number doesn't grow with the tables.
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1, SLICE):
                at, bucket, value = features(part.column(1))
                cut = lambda x, t: pa.array([x[i:j].astype(t).tobytes() for i, j in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), cut(bucket, np.int32), cut(value, np.float32)], ["doc_id", "toxic", "bucket", "value"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["toxic"].nunique() < 2:  # the labels of the other class name no document
            return pd.DataFrame({"weights": [], "bias": []})
        pdf = pdf.sort_values(["doc_id", "bucket"], ignore_index=True)
        parts = [(np.array([0, len(b) // 4]), np.frombuffer(b, np.int32), np.frombuffer(v, np.float32)) for b, v in zip(pdf["bucket"], pdf["value"])]
        weights, bias = fit(parts, pdf["toxic"].to_numpy())
        return pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    sample = rows.mapInArrow(extract, "doc_id long, toxic int, bucket binary, value binary")
    model = sample.groupBy().applyInPandas(learn, "weights binary, bias double").collect() if len(counts) == 2 else []
    if not model:
        return np.zeros(BUCKETS, np.float32), float(prior)
    return np.frombuffer(model[0]["weights"], np.float32), model[0]["bias"]


def learnt(model: tuple[np.ndarray, float]) -> bool:
    """Whether the model tells texts apart: not if a class had no training row, as all scores are equal then."""
    return bool(model[0].any())


def score(documents: DataFrame, model: tuple[np.ndarray, float], name: str = "toxicity_score") -> DataFrame:
    """documents with one more column (0 to 1); a null text is scored as an empty one. The name must be free (see common.free_name())."""
    handle = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats: a fixed size
    schema = documents.select("*", F.lit(0.0).alias(name)).schema
    text = documents.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = handle.value
        for batch in batches:
            for part in words.slices(batch, text, SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score_texts(part.column(text), weights, bias))], [*part.schema.names, name])

    return documents.mapInArrow(apply, schema)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is an input of the score. Null and empty texts get the score of a text without features; equal texts
    get equal scores; a null doc_id is never labelled and counts as held out by the crc32 of the empty text.
    """
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", (crc32_text("doc_id") % 5 == 0).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= threshold).cast("int").alias("predicted"))
