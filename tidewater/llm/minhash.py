"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

The set of a document holds the 64-bit hashes of its word shingles. A sketch has t coordinates; in round i every element
is thrown into a bin with the value i plus a fraction, by hashes of the round, and each bin keeps its least value. In
the first t rounds the bin is drawn by the hash; in the next t rounds it is the round's own bin, so every coordinate is
filled after 2t rounds at the latest, and a set of t log t elements or more is done after a round or two. Coordinates of
two sets agree with the probability of their Jaccard similarity.

Documents with equal sets form one class. Classes that share a band are candidates: the components of the candidate
links are groups, and only documents in groups are read again for their full sets. Within a group, every two sets that
are not yet connected are compared exactly, and links that connect something new are kept. Groups above a bounded size
are dealt out in chunks: a few hub documents meet every chunk, which connects what is close to them. Then groups are
refined: two sets that are near share an element that is rare in the group (a prefix in a common order, rare elements
first), so what holds a group together only by elements that most of it holds falls apart, and what is left is compared
in its own, smaller groups. Where documents outside a group's largest component fill few chunks (DIRECT: a group is then
sent a bounded number of times), or refining no longer halves what lies in large groups, they meet all chunks instead,
so no link is lost and no task holds a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words
from tidewater.llm.common import written
from tidewater.llm.components import components
from tidewater.llm.groups import whole_groups

SLICE = 4 << 20
CHUNK = 400
HUBS = 24
RULERS = 128
DIRECT = 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _long(x: Column) -> Column:
    return x.cast("long")


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one row after another, and the rows' offsets.

    Fewer words than a shingle has are one shingle; a row without words has none. A-Z are lower-cased.
    """
    raw, at = words.as_bytes(column, lower=True)
    starts, ends, first = words.spans(raw, at)
    h = words.hash_spans(raw, starts, ends)
    w, inside = words.windows(h, first, size)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= size:
            out.append(np.unique(w[i : j - size + 1]))
        elif j > i:
            x = np.array([j - i], np.uint64)
            for k in range(i, j):
                x = words.mix(x * _B + h[k])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def sketches(sets: np.ndarray, at: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches of t coordinates for each set; an empty set's are all ones."""
    full = np.uint64((1 << 64) - 1)
    out = np.full((len(at) - 1, t), full)
    flat, size = out.reshape(-1), np.diff(at)
    doc, element = np.repeat(np.arange(len(size)), size), sets
    for i in range(2 * t):
        if not len(doc):
            break
        h = words.mix(element * _A + np.uint64((2 * i + 1) * int(_B) % (1 << 64)))
        bin_ = (h >> np.uint64(32)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        value = (np.uint64(i) << np.uint64(54)) | (words.mix(h + _B) >> np.uint64(10))
        np.minimum.at(flat, doc * t + bin_.astype(np.int64), value)
        open_ = (out == full).any(1) & (size > 0)
        keep = open_[doc]
        doc, element = doc[keep], element[keep]
    return out


def bands_of(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of `rows` coordinates."""
    bands = sketch.shape[1] // rows
    out = np.repeat(np.arange(bands, dtype=np.uint64)[None], len(sketch), 0)
    for k in range(rows):
        out = words.mix(out * _A + sketch[:, k::rows][:, :bands])
    return out


def connect(node: np.ndarray, comp: np.ndarray, probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets that are not in one component yet, each joining two components; probes meet all others."""
    names, of = np.unique(comp, return_inverse=True)
    parent = list(range(len(names)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    size = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
    flag, out = np.zeros(len(distinct), bool), []
    roots = of.copy()  # kept up to date as components join
    for i in np.flatnonzero(probe).tolist():
        close = (roots != roots[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if not close.any():
            continue
        own = place[at[i] : at[i + 1]]
        flag[own] = True
        if 4 * close.sum() < len(size):
            js = np.flatnonzero(close)
            common = np.array([np.count_nonzero(flag[place[at[j] : at[j + 1]]]) for j in js.tolist()])
        else:
            js = np.flatnonzero(close)
            common = np.diff(np.concatenate([[0], np.cumsum(flag[place])])[at])[js]
        flag[own] = False
        for j in js[100 * common >= percent * (size[i] + size[js] - common)].tolist():
            a, b = root(of[i]), root(of[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                roots[roots == max(a, b)] = min(a, b)
                out.append((int(node[i]), int(node[j])))
    return out


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """rows: g, s, j (one task per value of all three), node, comp, probe, elements. Returns links a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in whole_groups(batches, ["g", "s", "j"], 8 << 20, lambda b: b.nbytes):
            node, comp = part["node"].to_numpy(), part["comp"].to_numpy()
            probe = part["probe"].to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part["elements"].combine_chunks()] if part.num_rows else []
            out = [x for i, j in zip(at[:-1], at[1:]) if j - i > 1 for x in connect(node[i:j], comp[i:j], probe[i:j], sets[i:j], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    met = rows.select("g", "s", "j", "node", "comp", "probe", "elements").repartition("g", "s", "j").sortWithinPartitions("g", "s", "j")
    return met.mapInArrow(run, "a long, b long")


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """rows: g, j (one task per value of both), node, comp, ruler, own, elements. Returns key, node, comp, short for rows of their own.

    Elements are ordered by the number of the group's rulers that hold them, rare ones first. Two sets near enough share
    an element among the first of both: the smaller set's within its short prefix, the larger one's within its long one.
    A key stands for group and element.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in whole_groups(batches, ["g", "j"], 8 << 20, lambda b: b.nbytes):
            g, node, comp = (part[k].to_numpy() for k in ("g", "node", "comp"))
            ruler, own = (part[k].to_numpy(zero_copy_only=False) for k in ("ruler", "own"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part["elements"].combine_chunks()] if part.num_rows else []
            key, row, short = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                known, times = np.unique(np.concatenate([key[0], *(sets[k] for k in range(i, j) if ruler[k])]), return_counts=True)
                for k in (i + np.flatnonzero(own[i:j])).tolist():
                    x, n = sets[k], len(sets[k])
                    seen = np.zeros(n, np.int64)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        seen = np.where(known[place] == x, times[place], 0)
                    first = np.lexsort((x, seen))[: n - -(-percent * n // 100) + 1]
                    key.append(words.mix(x[first] * _A + np.uint64(int(g[k]) % (1 << 64))))
                    row.append(np.full(len(first), k))
                    short.append(np.arange(len(first)) < n - -(-2 * percent * n // (100 + percent)) + 1)
            at_row = np.concatenate(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(node[at_row]), pa.array(comp[at_row]), pa.array(np.concatenate(short))], ["key", "node", "comp", "short"])

    met = rows.select("g", "j", "node", "comp", "ruler", "own", "elements").repartition("g", "j").sortWithinPartitions("g", "j")
    return met.mapInArrow(run, "key long, node long, comp long, short boolean")


def _refined(rows: DataFrame, percent: int) -> DataFrame:
    """rows: g, m, node, comp, elements. Returns node, g, m: the groups that are left when only sets of different components that share a rare element stay together."""
    own = _long(F.pmod(F.xxhash64("node"), F.col("chunks")))
    dealt = rows.withColumn("chunks", _long(F.ceil(F.col("m") / CHUNK))).withColumn("ruler", F.pmod(F.xxhash64("node", F.lit(3)), F.col("m")) < RULERS)
    dealt = dealt.withColumn("j", F.explode(F.when(F.col("ruler"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own))))
    prefixes = written(_prefixes(dealt.withColumn("own", F.col("j") == own), percent), "prefixes")
    pivots = prefixes.groupBy("key").agg(F.min("node").alias("pivot"), F.max("short").alias("short"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    pivots = pivots.filter("short and low < high").select("key", "pivot")
    stars = prefixes.join(pivots.hint("merge"), "key").filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    grouped = components(stars)
    sizes = grouped.groupBy("component").agg(F.count("*").alias("m"))
    return grouped.join(sizes.hint("merge"), "component").select("node", F.col("component").alias("g"), "m")


def _strays(of: DataFrame) -> DataFrame:
    """of: node, g, comp. Adds main, the group's largest component, and parts, by the number of nodes outside it; groups that are one component are left out."""
    most = of.groupBy("g", "comp").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    most = most.select("g", F.col("top.comp").alias("main"), _long(F.ceil((F.col("all") - F.col("top.n")) / CHUNK)).alias("parts")).filter("parts > 0")
    return of.join(most.hint("merge"), "g").select("node", "comp", "main", "parts")


def _in_groups(sets: DataFrame, percent: int) -> DataFrame:
    """sets: node, g, m, elements. Links a, b that connect all of a group that is near."""
    zero = F.lit(0).cast("long")
    rows = sets.withColumn("comp", F.col("node"))
    links = _linked(rows.filter(F.col("m") <= CHUNK).withColumns({"s": zero, "j": zero, "probe": F.lit(True)}), percent)
    large = rows.filter(F.col("m") > CHUNK)
    near, size, shrinks = None, large.count(), True
    while size:
        dealt = large.withColumn("chunks", _long(F.ceil(F.col("m") / CHUNK)))
        chunk, every = _long(F.pmod(F.xxhash64("node"), F.col("chunks"))), F.sequence(zero, F.col("chunks") - 1)
        hub = F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")) < HUBS
        met = written(_linked(dealt.withColumns({"s": zero, "j": F.explode(F.when(hub, every).otherwise(F.array(chunk))), "probe": F.lit(True)}), percent), "links")
        near = met if near is None else near.union(met)
        known = components(near)
        of = large.select("node", "g").distinct().join(known.hint("merge"), "node", "left").select("g", "node", F.coalesce("component", "node").alias("comp"))
        of = written(_strays(of), "strays")
        dealt = dealt.drop("comp").join(of.hint("merge"), "node")
        # As a probe, a stray meets every chunk; as a member, every document meets the probes of every part.
        rest = dealt.filter(F.col("parts") <= DIRECT if shrinks else F.lit(True)).withColumn("probe", F.col("comp") != F.col("main"))
        probes = rest.filter("probe").withColumns({"s": _long(F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))), "j": F.explode(every)})
        others = rest.withColumns({"j": chunk, "s": F.explode(F.sequence(zero, F.col("parts") - 1)), "probe": F.lit(False)})
        links = links.union(_linked(probes.unionByName(others), percent))
        before = of.filter(F.col("parts") > DIRECT).count() if shrinks else 0
        if not before:
            break
        members = written(_refined(dealt.filter(F.col("parts") > DIRECT), percent), "members")
        rows = sets.drop("g", "m").join(members.hint("merge"), "node").join(of.select("node", "comp").hint("merge"), "node")
        links = links.union(_linked(rows.filter(F.col("m") <= CHUNK).withColumns({"s": zero, "j": zero, "probe": F.lit(True)}), percent))
        large = rows.filter(F.col("m") > CHUNK)
        size = large.count()
        shrinks = 2 * size <= before
    return links if near is None else links.union(near)


def banding(n: int, percent: int, missed: float = 3e-6) -> tuple[int, int]:
    """Bands and rows for n documents: longer bands for more documents, so that chance candidates stay in proportion, and as many bands as a pair at the threshold needs."""
    rows = max(6, math.ceil(math.log10(max(n, 1))))
    return math.ceil(math.log(missed) / math.log(1 - (percent / 100) ** rows)), rows


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id, kept.

    Links documents whose shingle sets have a Jaccard similarity of percent / 100 or more; component_id is the smallest
    doc_id reachable, itself included; kept marks the document that has it. Null and empty texts and null ids link with
    nothing; rows that repeat a doc_id are one document, which is linked with what any of its rows is linked with. A pair at similarity 0.8 shares no band with a chance of
    about 3e-6; a pair that shares one, or whose documents are in one group, is decided on full sets.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1, SLICE):
                sets, at = shingle_sets(part.column(1), shingle)
                band = bands_of(sketches(sets, at, bands * rows), rows)
                total = [np.concatenate([[np.uint64(0)], np.cumsum(words.mix(sets * m + m), dtype=np.uint64)]) for m in (_A, _B)]
                key = np.stack([x[at[1:]] - x[at[:-1]] for x in total], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part.column(0)) + 1, dtype=np.int32) * bands), pa.array(band.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array([k.tobytes() for k in key], pa.binary()), lists], ["doc_id", "n_shingles", "key", "bands"])

    source = documents.select("doc_id", "text")
    bands, rows = banding(documents.count(), percent)
    sketched = written(source.mapInArrow(sketch, "doc_id long, n_shingles long, key binary, bands array<long>"), "sketches")
    classes = sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("band", "pivot")
    stars = banded.join(pivots.hint("merge"), "band").filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    grouped = components(stars)
    sizes = grouped.groupBy("component").agg(F.count("*").alias("m"))
    members = grouped.join(sizes.hint("merge"), "component").select(F.col("node").alias("doc_id"), F.col("component").alias("g"), "m")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1, SLICE):
                sets, at = shingle_sets(part.column(1), shingle)
                elements = pa.array([sets[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), elements], ["node", "g", "m", "elements"])

    sets = written(source.join(members.hint("merge"), "doc_id").mapInArrow(full, "node long, g long, m long, elements binary"), "sets")
    # A doc_id whose rows hold different sets is in several classes, and links them.
    several = sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("_a"), F.max("key").alias("_b")).filter("_a < _b").select("doc_id")
    own = sketched.filter("n_shingles > 0").select("doc_id", "key").join(several.hint("merge"), "doc_id").join(classes.select("key", "node").hint("merge"), "key")
    found = components(_in_groups(sets, percent).select("a", "b").union(own.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))

    named = classes.select("key", "node").join(found.hint("merge"), "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    linked = sketched.filter("n_shingles > 0 and doc_id is not null").drop("bands").join(named.hint("merge"), "key").select("doc_id", "n_shingles", "component_id")
    alone = sketched.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
