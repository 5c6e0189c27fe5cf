"""Nearest neighbours by largest inner product: inverted lists scanned by column blocks of rotated vectors.

Vectors get one more coordinate that makes all norms equal, so that the largest inner product is the smallest distance,
and a random rotation, so that the first d coordinates of a difference estimate its length. Centres of lists, the number
of lists to probe and each query's first radius come from a bounded sample; every vector is put into a list. Within a
probed list, a block of columns at a time is added to the distances, and a candidate is abandoned as soon as a test on
its partial distance rejects that it lies within the radius (at `strictness` standard deviations). A query first probes
its nearest lists, and its k-th score so far is its radius in the others. Scores of what is left are inner products of
the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written
from tidewater.llm.cosine import usable
from tidewater.llm.groups import whole_groups

SAMPLE = 8192
RADIUS_SAMPLE = 4096
COLUMNS = 16
BLOCK = 4096
FOUND = "query_id long, vec_id long, score double"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def lifted(vectors: np.ndarray, norm: float, turn: np.ndarray, query: bool) -> np.ndarray:
    """With the coordinate that fills the norm up (0 for queries), and rotated."""
    last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, norm**2 - (vectors**2).sum(1)))
    return np.concatenate([vectors, last[:, None]], 1) @ turn


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T)


def centres_of(points: np.ndarray, n: int, passes: int = 8) -> np.ndarray:
    """Lloyd's method from distinct starting points."""
    start = np.unique(points, axis=0)
    centres = start[np.random.default_rng(13).permutation(len(start))[:n]]
    for _ in range(passes):
        near = distances(points, centres).argmin(1)
        for k in np.unique(near):
            centres[k] = points[near == k].mean(0)
    return centres


def probes_for(points: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many lists hold the given share of the sample's exact neighbours."""
    of = distances(points, centres).argmin(1)
    rank = np.argsort(np.argsort(distances(queries, centres), 1), 1)
    near = np.argsort(distances(queries, points), 1)[:, 1 : k + 1]
    ranks = np.sort(np.take_along_axis(rank, of[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


def scan(query: np.ndarray, radius: np.ndarray, points: np.ndarray, strictness: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a point (both rotated) that no test abandons; radius: squared, one per query."""
    dims = points.shape[1]
    q = p = partial = None
    for k in range(0, dims, COLUMNS):
        last = min(k + COLUMNS, dims)
        if partial is None:
            d = distances(query[:, k:last], points[:, k:last])
            q, p = np.nonzero(d <= radius[:, None] * (last / dims) * (1 + strictness / np.sqrt(last)) ** 2)
            partial = d[q, p]
        else:
            partial = partial + ((query[q, k:last] - points[p, k:last]) ** 2).sum(1)
            slack = (1 + strictness / np.sqrt(last)) ** 2 * last / dims if last < dims else 1 + 1e-9
            keep = partial <= radius[q] * slack
            q, p, partial = q[keep], p[keep], partial[keep]
    return q, p


def best(query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k largest scores, ties to the smaller vec_id."""
    order = np.lexsort((vec_id, -score, query_id))
    group = query_id[order]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    return order[rank < k]


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, lists: int | None = None, recall: float = 0.96, strictness: float = 2.1) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vec_id that `every` divides, ties to the smaller vec_id.

    Null and zero vectors, those with null or non-finite components and rows without a vec_id take no part. Vectors of
    different lengths have no inner product: each length is searched by itself (the driver goes through the lengths, so
    there should be few). Rows of the query's own vec_id are no candidates; a vec_id appears once
    per query, with its largest score. A query for which fewer than k (or all) candidates are found is searched once
    more, over all lists and without tests.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    shape = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).alias("norm")).orderBy("dims").collect()
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.union, (nearest_of_length(rows.filter(F.size("embedding") == s.dims), *s, k, every, lists, recall, strictness) for s in shape))
    # A vec_id whose rows hold vectors of several lengths has one answer.
    if len(shape) > 1:
        best_ = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = best_.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def nearest_of_length(rows: DataFrame, dims: int, n: int, ids: int, norm: float, k: int, every: int, lists: int | None, recall: float, strictness: float) -> DataFrame:
    """nearest() for n usable vectors (vec_id, embedding) of dims components, with ids distinct vec_ids and norm the largest norm."""
    spark = rows.sparkSession
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows at most
    turn = rotation(dims + 1)
    original = np.array([r["embedding"] for r in taken], np.float64)
    points, asked = lifted(original, norm, turn, False), lifted(original[:256], norm, turn, True)
    centres = centres_of(points, lists or min(256, max(1, n // 800)))
    probes = probes_for(points, asked, centres, k, recall)
    some = points[:RADIUS_SAMPLE]
    fixed = spark.sparkContext.broadcast((turn, centres, some, np.array([r["vec_id"] for r in taken[:RADIUS_SAMPLE]])))  # sizes are bounded above
    kind = rows.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_, centres_, _, _ = fixed.value
        for batch in batches:
            if batch.num_rows:
                of = distances(lifted(matrix(batch.column(1)), norm, turn_, False), centres_).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *batch.columns], ["list", "vec_id", "embedding"])

    def probe(first: int, last: int, limited: bool):
        """The lists from the first-th to the last-th nearest, and a radius: that of the k-th score so far, else of the sample."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn_, centres_, some_, own = fixed.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q, name = lifted(matrix(batch.column(1)), norm, turn_, True), batch.column(0).to_numpy()
                order = np.argsort(distances(q, centres_), 1, kind="stable")[:, first:last]
                radius = np.full(len(q), np.inf)
                if limited and len(some_) > k:
                    d = distances(q, some_)
                    d[name[:, None] == own[None]] = np.inf
                    # The k-th of the sample, or of some lists, is no nearer than the k-th of all.
                    radius = np.partition(d, k - 1, 1)[:, k - 1]
                if limited:
                    held = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    radius = np.fmin(radius, (q**2).sum(1) + norm**2 - 2 * held)
                take = batch.select([0, 1]).take(pa.array(np.repeat(np.arange(len(q)), order.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel(), pa.int64()), *take.columns, pa.array(np.repeat(np.maximum(radius, 0) * (1 + 1e-9) + 1e-12, order.shape[1]))], ["list", "vec_id", "embedding", "radius"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_ = fixed.value[0]
        for part, at in whole_groups(batches, ["list", "i", "j"], BLOCK):
            is_query = part["is_query"].to_numpy(zero_copy_only=False)
            name, vectors, radius = part["vec_id"].to_numpy(), matrix(part["embedding"].combine_chunks()), part["radius"].to_numpy()
            for i, j in zip(at[:-1], at[1:]):
                asks = i + np.flatnonzero(is_query[i:j])
                held = i + np.flatnonzero(~is_query[i:j])
                if not len(asks) or not len(held):
                    continue
                for s in range(0, len(asks), 256):
                    own = asks[s : s + 256]
                    q, p = scan(lifted(vectors[own], norm, turn_, True), radius[own], lifted(vectors[held], norm, turn_, False), strictness)
                    q, p = own[q], held[p]
                    q, p = q[other := name[q] != name[p]], p[other]
                    score = np.concatenate([(vectors[q[c : c + 50_000]] * vectors[p[c : c + 50_000]]).sum(1) for c in range(0, len(q), 50_000)] or [np.zeros(0)])
                    top = best(name[q], name[p], score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(name[q[top]]), pa.array(name[p[top]]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    listed = written(rows.mapInArrow(assign, f"list long, vec_id long, embedding {kind}"), "lists")
    sizes = listed.groupBy("list").agg(F.count("*").alias("n"))

    def search(queries: DataFrame, first: int, last: int, limited: bool = True) -> DataFrame:
        """Blocks of a list's vectors meet blocks of the queries that probe it; both are of bounded size."""
        asks = queries.select("vec_id", "embedding", "held").mapInArrow(probe(first, last, limited), f"list long, vec_id long, embedding {kind}, radius double")
        blocks = sizes.join(asks.groupBy("list").agg(F.count("*").alias("asks")), "list").select("list", F.ceil(F.col("n") / BLOCK).alias("is"), F.ceil(F.col("asks") / BLOCK).alias("js"))
        small = F.broadcast(blocks)  # a row per list, of which there are 256 at most
        of = lambda salt, most: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(most))
        all_ = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.col(most) - 1))
        held = listed.join(small, "list").select("list", of(1, "is").alias("i"), all_("js").alias("j"), F.lit(False).alias("is_query"), "vec_id", "embedding", F.lit(0.0).alias("radius"))
        met = held.union(asks.join(small, "list").select("list", all_("is").alias("i"), of(2, "js").alias("j"), F.lit(True), "vec_id", "embedding", "radius"))
        return met.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(compare, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("held", F.lit(None).cast("double"))
    near = max(1, probes // 8)
    found = written(top(search(queries, 0, near)).drop("rank"), "found")
    if near < probes:
        held = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("held")).filter(F.col("n") == k).drop("n")
        found = written(top(found.union(search(queries.drop("held").join(held.hint("merge"), "vec_id", "left"), near, probes))).drop("rank"), "found")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, ids - 1))
    short = written(queries.join(enough.hint("merge"), F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if not short.isEmpty():
        found = found.union(search(short, 0, len(centres), False)).distinct()
    return top(found).select("query_id", "rank", "vec_id", "score")
