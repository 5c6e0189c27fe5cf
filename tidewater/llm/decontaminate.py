"""Benchmark decontamination: a broadcast hash set of normalised n-grams, verified hits, removal of spans or documents.

Every item's windows of `size` words (the whole item, if it has fewer) become a 64-bit hash, by which documents are
scanned, and a SHA-256 of their words, by which every hit is verified. Entries are (window, item) pairs of fixed size.
They are broadcast while there are at most `most` of them; more are dealt into shards of that size, each of which is
broadcast by itself, and what the shards find in a document is put together by a shuffle of the hits alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import free_name, written
from tidewater.llm.words import _A, as_bytes, hash_spans, mix, slices, spans

SLICE = 4 << 20
FILTER_BITS = 22
ENTRY = "size int, hash long, digest binary, item string"
HITS = "spans array<struct<start:long,stop:long>>, items array<string>"

# What lies between words, once A-Z are lower case: all of ASCII but digits and letters.
BREAKS = np.ones(256, bool)
BREAKS[0x30:0x3A] = BREAKS[0x61:0x7B] = BREAKS[0x80:] = False


def digest(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return hashlib.sha256(b" ".join(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist()))).digest()


def hashes_by_size(hashes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of 1, 2, ... words from each word on (where that many follow)."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(min(most, len(hashes))):
        out = mix(out[: len(hashes) - k] * _A + hashes[k:])
        yield k + 1, out


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """size, hash, digest, item: the distinct windows of each item."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                raw, at = as_bytes(part.column(1), lower=True)
                starts, ends, first = spans(raw, at, BREAKS)
                by_size = dict(hashes_by_size(hash_spans(raw, starts, ends), size))
                text, count = raw.tobytes(), np.diff(first)
                length = np.minimum(count, size)
                n = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
                row = np.repeat(np.arange(len(n)), n)
                place = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                for k in range(0, len(row), 50_000):  # some at a time: a digest is an object
                    r, p = row[k : k + 50_000], place[k : k + 50_000]
                    hashed = np.array([by_size[s][i] for s, i in zip(length[r].tolist(), p.tolist())], np.uint64)
                    digests = [digest(text, starts[i : i + s], ends[i : i + s]) for s, i in zip(length[r].tolist(), p.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(length[r].astype(np.int32)), pa.array(hashed.view(np.int64)), pa.array(digests, pa.binary()), part.column(0).take(pa.array(r))], ["size", "hash", "digest", "item"])

    named = items.select(F.col("item_id").cast("string").alias("item"), F.col("text")).filter("item is not null and text is not null")
    return named.mapInArrow(emit, ENTRY).distinct()


class WindowSet:
    """(window, item) entries for look-up: by size, sorted hashes behind a bit filter, digests, and items of each window."""

    def __init__(self, entries: pa.Table) -> None:
        names = pc.unique(entries["item"])
        self.names = names.take(pc.array_sort_indices(names))  # in the order of their UTF-8 bytes
        code = pc.index_in(entries["item"], value_set=self.names).to_numpy()
        hashed, size = entries["hash"].to_numpy().view(np.uint64), entries["size"].to_numpy()
        digests = np.frombuffer(b"".join(entries["digest"].to_pylist()), np.uint64).reshape(-1, 4)
        self.sizes = {}
        for s in np.unique(size).tolist():
            own = np.flatnonzero(size == s)
            own = own[np.lexsort((code[own], *digests[own].T, hashed[own]))]
            new = np.ones(len(own), bool)
            new[1:] = (hashed[own[1:]] != hashed[own[:-1]]) | (digests[own[1:]] != digests[own[:-1]]).any(1)
            first = np.flatnonzero(new)
            hashes = hashed[own[first]]
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.sizes[s] = (hashes, seen, digests[own[first]].tobytes(), np.append(first, len(own)), code[own])

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word and end of every verified occurrence; distinct pairs of a row and an item's code. row: of each word."""
        text = raw.tobytes()
        begin, stop, rows, codes = [], [], [], []
        for size, hashed in hashes_by_size(hash_spans(raw, starts, ends), max(self.sizes, default=0)):
            if size not in self.sizes:
                continue
            hashes, seen, digests, edge, item = self.sizes[size]
            at = np.flatnonzero(seen[hashed >> np.uint64(64 - FILTER_BITS)] & (row[: len(hashed)] == row[size - 1 :]))
            low = np.searchsorted(hashes, hashed[at])
            known = hashes[np.minimum(low, len(hashes) - 1)] == hashed[at]
            found = []
            for p, k in zip(at[known].tolist(), low[known].tolist()):
                own = digest(text, starts[p : p + size], ends[p : p + size])
                while k < len(hashes) and hashes[k] == hashed[p] and digests[32 * k : 32 * k + 32] != own:
                    k += 1
                if k < len(hashes) and hashes[k] == hashed[p]:
                    found.append((p, k))
            if found:
                p, window = np.array(found).T
                begin.append(p)
                stop.append(p + size)
                r, w = np.unique(np.stack([row[p], window]), axis=1)  # a window that recurs in a row names its items once
                n = edge[w + 1] - edge[w]
                rows.append(np.repeat(r, n))
                codes.append(item[np.repeat(edge[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        if not begin:
            return (np.zeros(0, np.int64),) * 4
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(codes)]), axis=1)
        return np.concatenate(begin), np.concatenate(stop), *pairs


def runs(begin: np.ndarray, stop: np.ndarray, n: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of covered words among n, cut where a row begins."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, stop, -1)
    covered = np.concatenate([[False], np.cumsum(step)[:n] > 0, [False]])
    opens, ends = covered[1:] & ~covered[:-1], ~covered[1:] & covered[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    inner = inner[covered[inner] & covered[inner + 1]]
    opens[inner] = ends[inner] = True
    return np.flatnonzero(opens), np.flatnonzero(ends)


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def hits(rows: DataFrame, known, text: int, only: bool) -> DataFrame:
    """rows with n_words, spans and items (see overlaps()), by a broadcast WindowSet; only: just the rows with hits."""
    names = [free_name(rows, "n_words"), free_name(rows, "spans"), free_name(rows, "items")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = known.value
        for batch in batches:
            for part in slices(batch, text, SLICE):
                raw, at = as_bytes(part.column(text), lower=True)
                starts, ends, first = spans(raw, at, BREAKS)
                count = np.diff(first)
                begin, stop, r, c = windows.find(raw, starts, ends, np.repeat(np.arange(len(count)), count))
                a, b = runs(begin, stop, len(starts), first)
                owner = np.searchsorted(first, a, side="right") - 1
                held = pa.StructArray.from_arrays([pa.array(a - first[owner], pa.int64()), pa.array(b - first[owner], pa.int64())], ["start", "stop"])
                named = windows.names.take(pa.array(c)).cast(pa.string())
                size = len(count)
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array(count), lists(held, np.bincount(owner, minlength=size)), lists(named, np.bincount(r, minlength=size))], [*part.schema.names, *names])
                yield out.filter(pa.array(np.bincount(owner, minlength=size) > 0)) if only else out

    kinds = HITS.replace("spans", f"`{names[1]}`").replace("items", f"`{names[2]}`")
    return rows.mapInArrow(scan, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{names[0]}` long, {kinds}")


def overlaps(docs: DataFrame, items: DataFrame, size: int = 10, most: int = 1 << 20) -> DataFrame:
    """doc_id, text, n_words, spans, items: what of each document lies inside windows of items (item_id, text).

    A-Z count as a-z; words are runs of digits, letters and characters beyond ASCII. A window is `size` following words
    of an item; an item of fewer words, but not none, is one window. spans: the longest runs of covered words, as
    places of words (stop is the first one after); items: the ids, as strings and sorted as such, of the items of which
    a window occurs. Null and empty texts have no words; items without an id take no part; rows that repeat an item_id
    are one item with the windows of all of them; rows that repeat a doc_id, and those without one, are documents of
    their own. Without items or documents nothing is covered, or nothing returned. Other columns are not looked at.
    `most` bounds the entries, of about 100 bytes each, that are broadcast at once.
    """
    rows, spark = docs.select("doc_id", "text"), docs.sparkSession
    entries = written(windows_of(items, size), "windows")
    n = entries.count()
    if n <= most:
        return hits(rows, spark.sparkContext.broadcast(WindowSet(entries.toArrow())), 1, False)
    # More than may be broadcast at once: the documents are scanned once a shard, and only hits are shuffled.
    shards = -(-2 * n // most)  # half full on average, so that none gets more than it may
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("digest", "item"), F.lit(shards)))
    keyed = rows.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = []
    for shard in range(shards):
        known = spark.sparkContext.broadcast(WindowSet(dealt.filter(F.col("shard") == shard).drop("shard").toArrow()))
        found.append(written(hits(keyed.select("_key", "text"), known, 1, True).select("_key", "spans", "items"), "hits"))
        known.destroy()
    # Equal texts have equal hits: those of each text are put together once.
    of_text = reduce(DataFrame.union, found).distinct().groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.from_json(F.lit('{"spans": [], "items": []}'), HITS)
    counted = hits(keyed, spark.sparkContext.broadcast(WindowSet(entries.limit(0).toArrow())), 1, False).drop("spans", "items")
    joined = counted.join(of_text.hint("merge"), "_key", "left").select("doc_id", "text", "n_words", F.coalesce("spans", empty["spans"]).alias("spans"), F.coalesce("items", empty["items"]).alias("items"))
    return joined.mapInArrow(_joined_runs, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_words long, {HITS}")


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row, sorted and put together where they touch or overlap."""
    for batch in batches:
        rows, first = batch.column(3).to_pylist(), np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())]).astype(np.int64)
        begin = np.array([first[k] + s["start"] for k, of in enumerate(rows) for s in of], np.int64)
        stop = np.array([first[k] + s["stop"] for k, of in enumerate(rows) for s in of], np.int64)
        a, b = runs(begin, stop, int(first[-1]), first)
        owner = np.searchsorted(first, a, side="right") - 1
        held = pa.StructArray.from_arrays([pa.array(a - first[owner], pa.int64()), pa.array(b - first[owner], pa.int64())], ["start", "stop"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(held, np.bincount(owner, minlength=batch.num_rows)), batch.column(4)], batch.schema.names)


def n_hit(spans_column: str) -> F.Column:
    return F.aggregate(spans_column, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def decontaminated(docs: DataFrame, items: DataFrame, remove: str = "spans", size: int = 10, share: float = 0.0, most: int = 1 << 20) -> DataFrame:
    """docs (doc_id, text, other columns of any name) without what overlaps() finds.

    remove="spans": covered words go, with what stands between them, and texts without any stay as they are.
    remove="documents": documents of whose words more than `share` is covered go, and the others stay as they are.
    Null texts, and documents without words, always stay; otherwise as overlaps().
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"unknown removal: {remove}")
    named = docs.withColumnsRenamed({c: f"_{k}" for k, c in enumerate(docs.columns)})
    doc_id, text = (f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    # The other columns travel as one, under a name that clashes with none.
    found = overlaps(named.select(F.struct(doc_id, *(c for c in named.columns if c not in (doc_id, text))).alias("doc_id"), F.col(text).alias("text")), items, size, most)
    if remove == "documents":
        found = found.filter(n_hit("spans") <= F.lit(share) * F.col("n_words"))
    else:
        found = found.mapInArrow(_without_spans, found.schema)
    back = found.select(*(F.col("text").alias("text") if c == "text" else F.col(f"doc_id._{k}").alias(c) for k, c in enumerate(docs.columns)))
    return back.to(docs.schema) if back.schema != docs.schema else back


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, SLICE):
            raw, at = as_bytes(part.column(1), lower=True)
            whole = as_bytes(part.column(1))[0]
            starts, ends, first = spans(raw, at, BREAKS)
            texts = part.column(1).to_pylist()
            for k, of in enumerate(part.column(3).to_pylist()):
                if of:
                    cut = [at[k], *(x for s in of for x in (starts[first[k] + s["start"]], ends[first[k] + s["stop"] - 1])), at[k + 1]]
                    texts[k] = b"".join(whole[a:b].tobytes() for a, b in zip(cut[::2], cut[1::2])).decode()
            yield part.set_column(1, "text", pa.array(texts, pa.string()))
