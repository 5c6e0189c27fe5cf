"""Centroid clustering on bit planes: vectors of 64 integers as one uint64 for each bit, distances by weighted AND-popcounts.

An integer component in two's complement is the sum of its bits times their weights (the top one's is negative). Bit k
of all 64 components is one word, so the dot product of two vectors is the sum over pairs of planes of
weight * weight * popcount(plane AND plane), exactly. Vectors are packed once, into as many planes as their largest
component needs, and every round reads the packed table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written

DIMS = 64
LARGEST = 1 << 27  # components from here on could give squared distances beyond a long
ROWS = 1 << 14


def planes_of(values: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) uint64: bit j of word k is bit k of component j, in two's complement."""
    bits = (values[:, None, :] >> np.arange(n)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), 2, bitorder="little").view("<u8")[:, :, 0]


def values_of(planes: np.ndarray) -> np.ndarray:
    """The components that planes_of() packed."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("rkj,k->rj", bits.astype(np.int64), weights(planes.shape[1]))


def weights(n: int) -> np.ndarray:
    return np.concatenate([1 << np.arange(n - 1, dtype=np.int64), [-(1 << (n - 1))]]).astype(np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows of a with one vector b, or with rows of b one by one: weighted AND-popcounts of every two planes."""
    w, b = weights(a.shape[1]), np.broadcast_to(b, a.shape)
    out = np.zeros(len(a), np.int64)
    for p in range(a.shape[1]):
        counts = np.bitwise_count(a[:, p, None] & b).astype(np.int64)
        out += w[p] * (counts @ w)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties to the smaller number) and its squared distance."""
    own = dots(planes, planes)
    far = np.stack([own - 2 * dots(planes, c) + dots(c[None], c[None])[0] for c in centroids])
    return far.argmin(0), far.min(0)


def packed(embeddings: DataFrame, scale: float) -> tuple[DataFrame, int]:
    """vec_id, planes (bytes of uint64 words), written; and the number of planes. See clusters()."""
    e = F.col("embedding")
    whole = F.coalesce((F.size(e) == DIMS) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= LARGEST)), F.lit(False))
    rows = embeddings.filter(whole & F.col("vec_id").isNotNull()).select("vec_id", F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))
    ends = rows.agg(F.min(F.array_min("v")).alias("a"), F.max(F.array_max("v")).alias("b")).first()
    n = 1 + max((ends["b"] or 0).bit_length(), (-(ends["a"] or 0) - 1).bit_length() if (ends["a"] or 0) < 0 else 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = planes_of(batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, DIMS), n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary())], ["vec_id", "planes"])

    return written(rows.mapInArrow(pack, "vec_id long, planes binary"), "planes"), n


def _words(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, n)


def _sums(vectors: DataFrame, centroids: np.ndarray, n: int) -> list:
    """Each cluster's size and sums of components, put together in tasks before the shuffle; a row per cluster and component reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), object)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                planes = _words(batch.column(0).slice(k, ROWS), n)
                of, values = nearest(planes, centroids)[0], values_of(planes)
                for c in np.unique(of):
                    size[c] += (of == c).sum()
                    total[c] += values[of == c].sum(0)
        held = np.flatnonzero(size)
        c, j = np.repeat(held, DIMS), np.tile(np.arange(DIMS), len(held))
        sums = pa.array([Decimal(int(x)) for x in total[held].ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(j), pa.array(size[c]), sums], ["cluster", "component", "n", "total"])

    parts = vectors.select("planes").mapInArrow(add, "cluster long, component long, n long, total decimal(38,0)")
    return parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # 64 rows a cluster


def clusters(embeddings: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64.0, salt: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of 64 components.

    A component x counts as floor(scale * x). Centroids start as the k vectors with the smallest sha256 of salt:vec_id (all,
    if fewer) and are numbered in that order. Each round assigns every vector to its nearest centroid by squared distance
    (ties: the smaller number) and replaces every non-empty centroid by the floors of its vectors' means. Null vectors,
    those of other lengths or with null or non-finite components, and rows without a vec_id are left out; so are vectors
    with a component of 2^27 or more after scaling, whose squared distances need not fit into a long. Rows that repeat a
    vec_id are vectors of their own (as starting centroids the one with the smaller bytes comes first). Inertias beyond a
    long are null. Without vectors there are no rows. Other columns are not looked at.
    """
    spark = embeddings.sparkSession
    vectors, n = packed(embeddings, scale)
    start = vectors.withColumn("_h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)).orderBy("_h", "vec_id", "planes").limit(k).collect()
    kind = "vec_id long, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], f"{kind}, cluster_inertia long, inertia long, centroid_sha256 string")
    values = values_of(np.stack([np.frombuffer(bytes(r["planes"]), "<u8") for r in start]))
    for _ in range(rounds):
        for r in _sums(vectors, planes_of(values, n), n):
            values[r["cluster"], r["component"]] = int(r["total"]) // r["n"]
    centroids = planes_of(values, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                of, far = nearest(_words(part.column(1), n), centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    assigned = written(vectors.mapInArrow(assign, kind), "assigned")
    inertia = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row per cluster
    known = [(c, str(t), str(sum(inertia.values())), hashlib.sha256(",".join(map(str, values[c].tolist())).encode()).hexdigest()) for c, t in inertia.items()]
    told = spark.createDataFrame(known, "cluster int, cluster_inertia string, inertia string, centroid_sha256 string")
    told = told.withColumns({c: F.col(c).try_cast("long") for c in ("cluster_inertia", "inertia")})
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
