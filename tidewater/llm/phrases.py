"""Repeated passages: windows of words that also start in a document with a smaller id are found and removed.

1. Documents are cut into blocks of a few megabytes. Every window of words has a mark, the least hash of its shorter
   word sequences; neighbouring windows mostly share it, and equal windows always do. Blocks send their distinct marks
   to buckets, which answer with those that more than one document holds.
2. Windows with such a mark are confirmed: blocks send their hashes, with the smallest and largest document of the
   block that holds them, and buckets answer with the smallest document of all blocks. A hash is 63 bits and 32 bits of
   another one, so among n windows about n * n / 2^96 pairs are taken for equal that aren't: 0.001 among 10^13.
3. Each block is a shard: of every run of repeated windows it takes just as many passages as cover the run, compiles
   them into one Aho-Corasick automaton, over a few letters per word, and streams all its documents through it. Every
   occurrence after the passage's first document is removed.

A block sends each mark and window once, whatever the number of documents that hold it, so a passage in a third of all
documents is no large group anywhere. No automaton holds more than the passages of its own documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words
from tidewater.llm.common import shared_path
from tidewater.llm.groups import whole_groups

BLOCK = 4 << 20
SHORT = 5
LETTERS = 64
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: after all others
KEYS = np.uint64((1 << 64) - 1)  # the bits of a window's hash that are its key; fewer in tests
_CHECK = np.uint64(0xA0761D6478BD642F)
_FAST, _SMALL = (pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=k)) for k in (1, 6))
PACKED = "kind int, block long, bucket long, payload binary"


def pack(batch: pa.RecordBatch, small: bool = False) -> bytes:
    """Rows in Arrow's stream format, packed fast or small (for texts, which travel several times)."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_SMALL if small else _FAST) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload.as_buffer()).read_next_batch()


def arrays(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def rows(kind: int, block, bucket, payload: list[bytes]) -> pa.RecordBatch:
    n = len(payload)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())], ["kind", "block", "bucket", "payload"])


def question(key: np.ndarray, check: np.ndarray, low: np.ndarray) -> bytes:
    """Windows in the order of their first documents: hashes as they are, documents as packed differences."""
    packed = pa.compress(np.diff(low, prepend=0).astype(np.int64), codec="zstd", asbytes=True) if len(key) else b""
    return answer(key, check) + packed


def asked_of(payload: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = payload.as_buffer()
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    low = np.cumsum(np.frombuffer(pa.decompress(raw.slice(8 + 12 * n), 8 * n, codec="zstd"), np.int64)) if n else np.zeros(0, np.int64)
    return np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n), low


def answer(key: np.ndarray, check: np.ndarray) -> bytes:
    return np.int64(len(key)).tobytes() + key.tobytes() + check.tobytes()


def answered_of(payloads: list[pa.Scalar]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all answers, sorted."""
    key, check = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for p in payloads:
        raw = p.as_buffer()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        key.append(np.frombuffer(raw, np.uint64, n, 8))
        check.append(np.frombuffer(raw, np.uint32, n, 8 + 8 * n))
    key, check = np.concatenate(key), np.concatenate(check)
    order = np.argsort(key, kind="stable")
    return key[order], check[order]


def dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by bucket, and where each bucket begins in it."""
    bucket = (key >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


class Block:
    """Words, windows and marks of the documents of one block."""

    def __init__(self, batch: pa.RecordBatch, size: int, keys: np.uint64 = KEYS):
        self.batch, self.size = batch, size
        ids = batch.column("doc_id")
        self.doc_id = ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.raw, at = words.as_bytes(batch.column("text"))
        self.starts, self.ends, self.first = words.spans(self.raw, at)
        self.word = words.hash_spans(self.raw, self.starts, self.ends)
        self.window, self.inside = words.windows(self.word, self.first, size)
        self.window &= keys
        self.doc = np.repeat(self.doc_id, np.diff(self.first))

    def marks(self) -> np.ndarray:
        """The least hash of the shorter sequences in the window at each word (only inside windows count)."""
        short = min(SHORT, self.size)
        h, _ = words.windows(self.word, self.first, short)
        out = h.copy()
        for k in range(1, self.size - short + 1):
            out[: len(h) - k] = np.minimum(out[: len(h) - k], h[k:])
        return out

    def checks(self, at: np.ndarray) -> np.ndarray:
        """32 more bits of the windows at the given words, mixed in another way."""
        out = np.full(len(at), self.size, np.uint64)
        for k in range(self.size):
            out = words.mix(out + words.mix(self.word[at + k] ^ _CHECK))
        return (out >> np.uint64(32)).astype(np.uint32)

    def first_last(self, at: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows at the given words (keys with the lowest bit set, checks), or distinct given keys, with the smallest and largest document that holds each."""
        check = self.checks(at) if key is None else np.zeros(len(at), np.uint32)
        k = (self.window | np.uint64(1) if key is None else key)[at]
        order = np.lexsort((check, k)) if key is None else np.argsort(k, kind="stable")
        k, check, d = k[order], check[order], self.doc[at][order]
        if not len(k):
            return k, check, d, d
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (check[1:] != check[:-1])]))
        return k[new], check[new], np.minimum.reduceat(d, new), np.maximum.reduceat(d, new)

    def passages(self, answer: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that cover every run of repeated windows, given the confirmed ones (sorted); with each, the document of this block that keeps it, or one before all."""
        key, n = answer | np.uint64(1), len(self.window)
        place = np.searchsorted(key, self.window | np.uint64(1))
        found = np.flatnonzero(self.inside & (key[np.minimum(place, len(key) - 1)] == self.window | np.uint64(1)) if len(key) else np.zeros(n, bool))
        own, hit, first = self.checks(found), np.zeros(len(found), bool), place.copy()
        # Answers that share a key lie side by side and differ in their checks.
        for k in range(int(np.unique(key, return_counts=True)[1].max()) if len(key) else 0):
            at = np.minimum(first[found] + k, len(key) - 1)
            new = ~hit & (key[at] == self.window[found] | np.uint64(1)) & (check[at] == own)
            place[found[new]], hit = at[new], hit | new
        found = found[hit]
        least = np.full(len(key), LAST)
        np.minimum.at(least, place[found], self.doc[found])
        least[(answer & np.uint64(1)) == 1] = np.iinfo(np.int64).min
        at = found[least[place[found]] < self.doc[found]]
        repeated = np.zeros(len(self.window), bool)
        repeated[at] = True
        before = np.zeros(len(repeated), bool)
        before[1:] = repeated[:-1]
        start = self.first[:-1][self.first[:-1] < len(repeated)]
        before[start] = False
        begin = np.flatnonzero(repeated & ~before)
        run = np.cumsum(repeated & ~before) - 1
        last = np.zeros(len(begin), np.int64)
        np.maximum.at(last, run[at], at)
        take = at[((at - begin[run[at]]) % self.size == 0) | (at == last[run[at]])]
        _, one = np.unique(place[take], return_index=True)
        return take[one], least[place[take[one]]]

    def removed(self, answer: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Which words are covered: all occurrences of the passages, by an automaton over the letters of words."""
        gone = np.zeros(len(self.word) + 1, np.int64)
        at, least = self.passages(answer, check) if len(answer) and len(self.word) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(at):
            _, number = np.unique(self.word, return_inverse=True)
            text, width = letters(number)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, i in enumerate(at.tolist()):
                automaton.add_word(text[i * width : (i + self.size) * width], k)
            automaton.make_automaton()
            hits = np.array([x for x in automaton.iter(text)], np.int64).reshape(-1, 2)
            hits = hits[(hits[:, 0] + 1) % width == 0]
            begin = (hits[:, 0] + 1) // width - self.size
            # A match across the end of a document is none; nor is one in the passage's first document.
            good = self.inside[begin] & (self.doc[begin] > least[hits[:, 1]])
            np.add.at(gone, begin[good], 1)
            np.add.at(gone, begin[good] + self.size, -1)
        return np.cumsum(gone[:-1]) > 0

    def kept(self, gone: np.ndarray) -> pa.Array:
        """Each document's kept words joined by one blank."""
        at = np.flatnonzero(~gone)
        size = self.ends[at] - self.starts[at] + 1
        to = np.concatenate([[0], np.cumsum(size)])
        out = np.full(to[-1], 0x20, np.uint8)
        inner = np.arange(to[-1]) - np.repeat(to[:-1], size)
        letter = inner < np.repeat(size - 1, size)
        out[letter] = self.raw[(np.repeat(self.starts[at], size) + inner)[letter]]
        edge = to[np.searchsorted(at, self.first)]
        text = memoryview(out).cast("B")
        return pa.array([bytes(text[i : max(i, j - 1)]).decode() for i, j in zip(edge.tolist(), edge[1:].tolist())], pa.string())


def letters(number: np.ndarray) -> tuple[str, int]:
    """Numbers as letters, as many for each as the largest needs; there are few different ones, as the automaton's nodes look for a letter in a list."""
    width = 1
    while len(number) and number.max() >= LETTERS**width:
        width += 1
    digit = np.stack([number // LETTERS**k % LETTERS for k in range(width - 1, -1, -1)], 1)
    return (digit.ravel() + ord("0")).astype(np.uint8).tobytes().decode("ascii"), width


def repeated_windows_removed(documents: DataFrame, size: int = 13, keep_clean: bool = False, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """documents with text replaced by the kept words joined by one blank, and n_words, n_removed (both of the whole text).

    A word goes if a window of `size` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. Null and empty texts have no words and come back empty; texts shorter than a window and
    repeated rows of one doc_id keep their words for that reason; null doc_ids count as larger than all others; an
    empty table gives no rows. counts names the two columns that are added: input columns with these names are replaced,
    all others come back unchanged. With keep_clean, texts that lose
    no word stay as they are, with their white space (null ones too).
    """
    spark = documents.sparkSession
    source = documents.drop(*counts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for part in words.slices(batch, batch.schema.get_field_index("text"), BLOCK):
                block = Block(part, size, KEYS)
                # The lowest bit of a mark tells whether two documents of the block hold it.
                key, _, low, high = block.first_last(np.flatnonzero(block.inside), block.marks() | np.uint64(1))
                key = key ^ (low == high).astype(np.uint64)
                order, at = dealt(key, buckets)
                yield rows(0, [base + n], [0], [pack(part, small=True)])
                some = np.flatnonzero(np.diff(at))
                yield rows(1, [base + n] * len(some), some, [key[order[at[k] : at[k + 1]]].tobytes() for k in some])
                n += 1

    def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in whole_groups(batches, ["bucket"], 1):
            payload = part["payload"].combine_chunks()
            for first, last in zip(at[:-1], at[1:]):
                own = [np.frombuffer(payload[k].as_buffer(), np.uint64) for k in range(first, last)]
                key = np.concatenate(own)
                known, count = np.unique(key | np.uint64(1), return_counts=True)
                many = np.union1d(known[count > 1], key[(key & np.uint64(1)) == 1])
                yield rows(1, part["block"].to_numpy()[first:last], [0] * (last - first), [np.intersect1d(k | np.uint64(1), many).tobytes() for k in own])

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, list[pa.Scalar]]]:
        for part, at in whole_groups(batches, ["block"], 1):
            payload = part["payload"].combine_chunks()
            for first, last in zip(at[:-1], at[1:]):
                yield part["block"][first].as_py(), Block(unpack(payload[first]), size, KEYS), [payload[k] for k in range(first + 1, last)]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, answers in by_block(batches):
            many = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in answers] or [np.zeros(0, np.uint64)]))
            mark = block.marks() | np.uint64(1)
            place = np.minimum(np.searchsorted(many, mark), max(0, len(many) - 1))
            at = np.flatnonzero(block.inside & (many[place] == mark)) if len(many) else np.zeros(0, np.int64)
            key, check, low, high = block.first_last(at)
            key = key ^ (low == high).astype(np.uint64)  # the lowest bit, as in marks
            order = np.argsort(low, kind="stable")
            key, check, low = key[order], check[order], low[order]
            order, at = dealt(key, buckets)
            some = np.flatnonzero(np.diff(at))
            yield rows(2, [name] * len(some), some, [question(key[o], check[o], low[o]) for o in (order[at[k] : at[k + 1]] for k in some)])

    def first_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in whole_groups(batches, ["bucket"], 1):
            payload = part["payload"].combine_chunks()
            for first, last in zip(at[:-1], at[1:]):
                own = [asked_of(payload[k]) for k in range(first, last)]
                asked, check, low = (np.concatenate([x[c] for x in own]) for c in (0, 1, 2))
                key = asked | np.uint64(1)
                order = np.lexsort((low, check, key))
                new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])])[: len(key)]
                least = np.empty(len(key), np.int64)
                least[order] = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                earlier, later = least < low, (least == low) & ((asked & np.uint64(1)) == 1)
                # Lowest bit 1: the first document is in another block; 0: it is in this one, and later ones hold the window too.
                told, keep = np.where(earlier, key, key ^ np.uint64(1)), earlier | later
                edge = np.concatenate([[0], np.cumsum([len(x[0]) for x in own])])
                out = [answer(told[i:j][keep[i:j]], check[i:j][keep[i:j]]) for i, j in zip(edge, edge[1:])]
                yield rows(2, part["block"].to_numpy()[first:last], [0] * (last - first), out)

    names = source.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, answers in by_block(batches):
            gone = block.removed(*answered_of(answers))
            total = np.concatenate([[0], np.cumsum(gone)])[block.first]
            text, lost = block.kept(gone), np.diff(total)
            if keep_clean:
                text = pc.if_else(pa.array(lost == 0), block.batch.column("text").cast(pa.string()), text)
            columns = [text if n == "text" else block.batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(block.first)), pa.array(lost)], [*names, *counts])

    def answered(asked: DataFrame, f) -> DataFrame:
        return asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(f, PACKED)

    def met(answers: DataFrame) -> DataFrame:
        """The blocks, each followed by its answers."""
        both = text.select("kind", "block", "payload").union(answers.select("kind", "block", "payload"))
        return both.repartition(parts, "block").sortWithinPartitions("block", "kind")

    path = shared_path(spark, "blocks")
    source.mapInArrow(split, PACKED).write.partitionBy("kind").option("compression", "none").parquet(path)
    table = spark.read.schema("block long, bucket long, payload binary, kind int").parquet(path)
    text = table.filter("kind = 0")
    asked = met(answered(table.filter("kind = 1"), recurring)).mapInArrow(candidates, PACKED)
    done = source.select("*", *(F.lit(0).cast("long").alias(c) for c in counts))
    return met(answered(asked, first_documents)).mapInArrow(clean, done.schema)
