"""Hard-negative mining by a secondary sort: keys (anchor, descending score, id), a stream that opens positive windows.

Anchors meet all rows in cells of bounded size. A first pass over the cells of each label finds every anchor's best
positives; they tell the windows of scores that a second pass keeps, of each cell at most as many negatives a window as
can be asked for. What is left is packed into keys and goes through repartitionAndSortWithinPartitions: an anchor's
scores reach one task in descending order, where a positive opens its window and negatives fill the open ones, without
an anchor ever being held whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written
from tidewater.llm.groups import whole_groups

ROWS = (1 << 11, 1 << 16)  # rows of a cell: as many as give CELLS cells, within these ends
ANCHORS = 1 << 12
CELLS = 64
COMPONENTS = 1 << 22  # of all rows of a cell together, which longer vectors make smaller
PAIRS = 1 << 21
_SIGN = 1 << 63
KEY = struct.Struct(">QQBQ")
FOUND = "anchor_id long, id long, score long"


def pack(anchor: int, score: int, negative: bool, id_: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, positives first, id."""
    return KEY.pack(anchor + _SIGN, _SIGN - 1 - score, negative, id_ + _SIGN)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, id_ = KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, bool(negative), id_ - _SIGN


def scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Exact inner products of integer-valued rows, and which of them a long can hold (None: all)."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64), None
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    held = np.array([[-_SIGN <= x < _SIGN for x in row] for row in exact], bool).reshape(exact.shape)
    return np.where(held, exact, 0).astype(np.int64), held


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(len(column), -1)


def window_ends(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest negative score with low * score <= 100 * negative <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. embeddings: vec_id, label, embedding; anchors: a condition on vec_id.

    A component x counts as floor(scale * x); a row's score is its inner product with the anchor; higher scores come first,
    ties by smaller vec_id. An anchor's positives are its first rows of the same label; for each, the first rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned, ranked from 1.

    Rows without vec_id or label, null vectors and those with null or non-finite components take no part. Equal rows (in
    vec_id, label and vector) count once; different rows of a vec_id are candidates of their own, but never of an anchor
    of their own vec_id, and of those only the first by label and vector is the anchor. Vectors of different lengths, and
    those whose product a long can't hold, have no score; empty vectors score 0. An anchor without positives or without
    negatives gives no rows. Other columns are not looked at.
    """
    e = F.col("embedding")
    sound = F.coalesce(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = embeddings.filter(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = written(rows.distinct().withColumn("dims", F.size("embedding")), "rows")
    asked = rows.filter(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "dims")).alias("a")).select("vec_id", "a.*")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = _met(rows, asked.withColumn("held", F.array().cast("array<long>")), ["label", "dims"], _positives(positives, scale))
    first = written(found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= positives).drop("_n"), "positives")
    # A window of a negative score is empty, as negatives would have to score less and more at once.
    windows = first.filter("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("score").alias("held"))
    left = _met(rows, asked.join(windows.hint("merge"), "vec_id"), ["dims"], _negatives(negatives, low, high, scale))
    keyed = first.filter("score >= 0").withColumn("negative", F.lit(False)).union(left.withColumn("negative", F.lit(True)))
    return _streamed(keyed, negatives, low, high)


def _met(rows: DataFrame, asked: DataFrame, keys: list[str], compare) -> DataFrame:
    """compare() on cells: every block of rows meets every block of the anchors with equal keys."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(asked.groupBy(*keys).agg(F.count("*").alias("asks")), keys)
    fits = F.greatest(F.lit(1), (F.lit(COMPONENTS) / F.greatest("dims", F.lit(1))).cast("long"))
    per = F.least(fits, F.greatest(F.lit(ROWS[0]), F.least(F.lit(ROWS[1]), F.ceil(F.col("n") / CELLS))))
    sizes = n.select(*keys, F.ceil(F.col("n") / per).alias("is"), F.ceil(F.col("asks") / F.least(fits, F.lit(ANCHORS))).alias("js"))
    of = lambda salt, most: F.pmod(F.xxhash64("vec_id", "embedding", F.lit(salt)), F.col(most))
    all_ = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.col(most) - 1))
    none = F.array().cast("array<long>")
    held = rows.join(sizes, keys).select(*keys, of(1, "is").alias("i"), all_("js").alias("j"), F.lit(True).alias("is_row"), "vec_id", F.col("label").alias("own"), "embedding", none.alias("held"))
    asks = asked.join(sizes, keys).select(*keys, all_("is").alias("i"), of(2, "js").alias("j"), F.lit(False).alias("is_row"), "vec_id", F.col("label").alias("own"), "embedding", "held")
    met = held.union(asks).repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "is_row", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in whole_groups(batches, [*keys, "i", "j"], ROWS[0]):
            for a, b in zip(at[:-1], at[1:]):
                cell = part.slice(a, b - a).combine_chunks()
                split = int(np.count_nonzero(~cell["is_row"].to_numpy(zero_copy_only=False)))
                if 0 < split < cell.num_rows:
                    yield from compare(cell.slice(0, split), cell.slice(split))

    return met.mapInArrow(run, FOUND)


def _lines(asked: pa.Table, held: pa.Table, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each anchor: its place, its scores with the rows (in the order of vec_id), and which of them count."""
    v, name = matrix(held["embedding"].combine_chunks(), scale), held["vec_id"].to_numpy()
    a, own = matrix(asked["embedding"].combine_chunks(), scale), asked["vec_id"].to_numpy()
    step = max(1, PAIRS // len(v))
    for k in range(0, len(a), step):
        s, fits = scores(a[k : k + step], v)
        other = name[None] != own[k : k + step, None]
        for r, line in enumerate(s):
            yield k + r, line, other[r] if fits is None else other[r] & fits[r]


def _rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        anchor = np.repeat(np.array([f[0] for f in found]), [len(f[1]) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["anchor_id", "id", "score"])


def _positives(most: int, scale: float):
    def compare(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        own, name, found = asked["vec_id"].to_numpy(), held["vec_id"].to_numpy(), []
        for k, line, ok in _lines(asked, held, scale):
            at = np.flatnonzero(ok)
            if len(at) > most:
                at = at[line[at] >= np.partition(line[at], len(at) - most)[len(at) - most]]
            at = at[np.argsort(-line[at], kind="stable")][:most]  # rows come by vec_id, which settles ties
            found.append((own[k], name[at], line[at]))
        yield from _rows(found)

    return compare


def _negatives(most: int, low: int, high: int, scale: float):
    def compare(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        own, label, windows = asked["vec_id"].to_numpy(), asked["own"].to_numpy(), asked["held"].to_pylist()
        name, labels, found = held["vec_id"].to_numpy(), held["own"].to_numpy(), []
        for k, line, ok in _lines(asked, held, scale):
            ends = [window_ends(s, low, high) for s in windows[k]]
            at = np.flatnonzero(ok & (labels != label[k]) & (line >= min(a for a, _ in ends)) & (line <= max(b for _, b in ends)))
            at = at[np.argsort(-line[at], kind="stable")]
            down, keep = -line[at], np.zeros(len(at), bool)
            for a, b in ends:
                first, last = np.searchsorted(down, -b), np.searchsorted(down, -a, side="right")
                keep[first : min(last, first + most)] = True
            found.append((own[k], name[at[keep]], line[at[keep]]))
        yield from _rows(found)

    return compare


def _streamed(scored: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """The secondary sort of scored (anchor_id, id, score, negative), and the stream over its partitions."""
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = scored.rdd.map(lambda r: (pack(r["anchor_id"], r["score"], r["negative"], r["id"]), None))
    ordered = pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))

    def stream(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
        anchor, windows = None, []  # open windows: positive, its score, ends, negatives so far
        for key, _ in keys:
            own, score, negative, id_ = unpack(key)
            if own != anchor:
                anchor, windows = own, []
            windows = [w for w in windows if w[2] <= score and w[4] < negatives]
            if not negative:
                windows.append([id_, score, *window_ends(score, low, high), 0])
                continue
            for w in windows:
                if score <= w[3]:
                    w[4] += 1
                    yield anchor, w[0], w[4], id_, w[1], score

    return spark.createDataFrame(ordered.mapPartitions(stream), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
