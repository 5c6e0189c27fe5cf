import hashlib

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string, n int, planes int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def clustered(spark, rows, **options):
    out = kmeans.clusters(table(spark, rows), **options)
    return sorted(tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def plain(rows, k=16, rounds=3, scale=64):
    """Loops on Python integers."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:k]
    centroids = [v for _, v in first]
    for r in range(rounds + 1):
        far = [[sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids] for _, v in kept]
        of = [min(range(len(d)), key=lambda c: (d[c], c)) for d in far]
        if r < rounds:
            for c in set(of):
                own = [v for (_, v), o in zip(kept, of) if o == c]
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    inertia = {c: sum(d[c] for d, o in zip(far, of) if o == c) for c in set(of)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, o, d[o], inertia[o], sum(inertia.values()), sha[o]) for (i, _), d, o in zip(kept, far, of))


def test_planes_hold_all_values():
    r = np.random.default_rng(1)
    for bits in (1, 2, 7, 28):
        x = r.integers(-(1 << (bits - 1)), 1 << (bits - 1), (50, 64))
        assert (kmeans.values_of(kmeans.planes_of(x, bits)) == x).all()
        y = r.integers(-(1 << (bits - 1)), 1 << (bits - 1), 64)
        assert (kmeans.dots(kmeans.planes_of(x, bits), kmeans.planes_of(y[None], bits)[0]) == x @ y).all()


def test_against_loops(spark):
    x = np.random.default_rng(2).standard_normal((300, 64)).round(2)
    x[50:150] = x[7]  # a third of all vectors are equal: ties, empty clusters
    rows = [(k - 20, v) for k, v in enumerate(x.tolist())]
    assert clustered(spark, rows) == plain(rows)
    few = rows[:9]
    assert clustered(spark, few) == plain(few)


def test_left_out_repeated_and_none(spark):
    x = np.random.default_rng(3).uniform(-3, 3, (20, 64))
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    odd = [(90, None), (91, []), (92, [1.0] * 63), (93, [1.0] * 65), (94, [None] + [1.0] * 63), (95, [float("nan")] + [1.0] * 63), (96, [float("-inf")] * 64), (None, [1.0] * 64), (97, [1e30] * 64)]
    assert clustered(spark, rows + odd, k=4) == plain(rows, 4)
    assert clustered(spark, odd) == clustered(spark, []) == []
    same = rows + rows[:5] * 2
    assert clustered(spark, same, k=4) == clustered(spark, same[::-1], k=4)
    assert len(clustered(spark, same, k=4)) == 30


def test_largest_components(spark):
    top = float(np.nextafter(np.float32((1 << 27) / 64), np.float32(0)))
    rows = [(1, [top] * 64), (2, [-top] * 64), (3, [0.0] * 64)]
    assert clustered(spark, rows, k=2) == plain(rows, 2)
    assert kmeans.packed(table(spark, rows), 64.0)[1] == 28


def test_constant_vectors(spark):
    assert clustered(spark, [(1, [0.0] * 64), (2, [0.0] * 64)]) == plain([(1, [0.0] * 64), (2, [0.0] * 64)])
    assert clustered(spark, [(1, [-0.001] * 64)]) == plain([(1, [-0.001] * 64)])
    assert kmeans.clusters(table(spark, []).withColumn("extra", F.lit(1))).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
