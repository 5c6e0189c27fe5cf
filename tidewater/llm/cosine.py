"""Near-duplicate embeddings: sign bits of random hyperplanes in several tables, exact cosines, connected components.

Equal vectors form one class and are not compared with each other. In each table, the classes with equal bits form a
bucket, in which only ids and bits travel; a bucket is dealt out in blocks of bounded size, and every two blocks of it
meet in one task. A pair leaves the first table that it shares if its bits of all tables don't rule out the threshold,
and its exact cosine decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written
from tidewater.llm.components import components
from tidewater.llm.groups import whole_groups

BLOCK = 1500
PAIRS = 200_000


def sign_codes(vectors: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, one integer per table: on which side of its hyperplanes the vector lies; and all these bits, eight in a byte."""
    planes = np.random.default_rng([7, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    side = vectors @ planes > 0
    return side.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)), np.packbits(side, 1)


def usable(vector) -> F.Column:
    """Neither null nor zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def sizes_for(n: int, threshold: float, missed: float = 3e-6) -> tuple[int, int]:
    """Tables and bits for n vectors: more bits for more vectors, so that buckets of chance stay small, and as many tables as a pair at the threshold needs."""
    bits = max(12, math.ceil(math.log2(max(n, 1) / 16)))
    return math.ceil(math.log(missed) / math.log(1 - (1 - math.acos(threshold) / math.pi) ** bits)), bits


def near_pairs(classes: DataFrame, threshold: float, tables: int, bits: int) -> DataFrame:
    """classes: node, embedding. Returns a, b (a < b), once each: pairs that share a bucket and whose cosine reaches the threshold."""
    share = np.arccos(threshold) / np.pi
    most = tables * bits * share + 6 * np.sqrt(tables * bits * share * (1 - share))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.concatenate([[0], np.cumsum(size)])
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                vectors = flat[(start[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)
                code, side = sign_codes(vectors, tables, bits)
                packed = pa.array([c.tobytes() for c in side], pa.binary())
                key = ((n * tables + np.arange(tables)) << bits) + code
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(key[:, t]), batch.column(0).take(pa.array(rows)), packed], ["bucket", "node", "codes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in whole_groups(batches, ["bucket", "i", "j"], 20_000):
            node = part["node"].to_numpy()
            code = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(len(node), -1)
            table = (part["bucket"].to_numpy() >> bits) % tables
            size = np.diff(at)
            end = np.repeat(at[1:], size)
            # Blocks that meet themselves pair each row with those after it; of two blocks, the first one's rows come first.
            same, right = part["i"].to_numpy() == part["j"].to_numpy(), part["right"].to_numpy(zero_copy_only=False)
            first = end - np.repeat(np.add.reduceat(right.astype(np.int64), at[:-1]), size)
            first = np.where(same, np.arange(len(node)) + 1, np.where(right, end, first))
            done = np.concatenate([[0], np.cumsum(end - first)])
            for k in range(0, int(done[-1]), PAIRS):
                pair = np.arange(k, min(k + PAIRS, int(done[-1])))
                x = np.searchsorted(done, pair, side="right") - 1
                y = first[x] + pair - done[x]
                x, y = x[keep := node[x] != node[y]], y[keep]
                differ = code[x] ^ code[y]
                near = np.flatnonzero(np.bitwise_count(differ).sum(1) <= most)
                x, y = x[near], y[near]
                other = np.unpackbits(differ[near], 1, tables * bits).reshape(len(near), tables, bits).any(2)
                keep = other.argmin(1) == table[x]
                a, b = node[x[keep]], node[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    coded = written(classes.mapInArrow(codes, "bucket long, node long, codes binary"), "buckets")
    # Buckets with one class are done; the others get as many blocks as their size needs.
    sizes = coded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = coded.join(sizes.hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meets = meets.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") >= F.col("other")).alias("right"), "node", "codes")
    met = meets.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "right").mapInArrow(compare, "a long, b long").distinct()

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    sized = classes.select("node", "embedding", F.sqrt(dot("embedding", "embedding")).alias("norm"))
    one, two = (sized.select(F.col("node").alias(k), F.col("embedding").alias(f"v{k}"), F.col("norm").alias(f"n{k}")).hint("merge") for k in ("a", "b"))
    return met.join(one, "a").join(two, "b").filter(dot("va", "vb") / (F.col("na") * F.col("nb")) >= threshold).select("a", "b").distinct()


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    n_links counts the other rows linked directly, equal vectors among them; component_id is the smallest vec_id
    reachable by links, itself included. Null and zero vectors, vectors with null or non-finite components and rows
    without a vec_id link with nothing; vectors of different length are never linked. Rows that share a vec_id share
    their component; vectors that have the same smallest vec_id among their equals count their links together. A pair at cosine 0.95 meets in no table with a chance of about 3e-6.
    """
    rows = embeddings.select("vec_id", "embedding").withColumn("ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    classes = written(rows.filter("ok").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    pairs = written(near_pairs(classes.select("node", "embedding"), threshold, *sizes_for(classes.count(), threshold)), "pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # A vec_id whose rows hold different vectors names several classes: their sizes add up.
    weight = classes.groupBy("node").agg(F.sum("n").alias("n"))
    degree = both.join(weight.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    # A vec_id whose rows hold different vectors is in several classes, and links them.
    several = rows.filter("ok").groupBy("vec_id").agg(F.min(F.xxhash64("embedding")).alias("_a"), F.max(F.xxhash64("embedding")).alias("_b")).filter("_a < _b").select("vec_id")
    own = rows.filter("ok").join(several.hint("merge"), "vec_id").join(classes.select("embedding", "node").hint("merge"), "embedding")
    linked = pairs.union(own.select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    found = degree.join(components(linked).hint("merge"), "node", "full")
    of_class = classes.join(found.hint("merge"), "node", "left").select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = rows.filter("ok").join(of_class.hint("merge"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
