"""Vector bin packing of training examples into sequences.

A sequence has limits on its tokens, its segments and its loss-bearing tokens. Examples wait in a pool of bounded size;
a sequence takes, again and again, the example that fits and has the largest dot product with what the sequence has
left, both as shares of the limits. Where examples may be cut and none fits any more, the largest one in the pool fills
the gap. Each task packs what its partition holds. The pieces of a sequence that isn't full (the last of a partition, or
one at its limit of segments) are dealt out to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bpe, words

POOL = 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs examples given as (n_tokens, n_loss, what): the last n_loss tokens of an example bear loss."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool, pool: int = POOL):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.cut, self.sizes, self.what = cut, np.full((pool, 3), np.inf), [None] * pool
        self.from_ = np.zeros(pool, np.int64)
        self.free = list(range(pool))[::-1]

    def add(self, n_tokens: int, n_loss: int, what) -> Iterator[list[tuple]]:
        """Takes one example; yields the sequences that became full, each a list of (what, start, length)."""
        if not self.cut and (n_tokens > self.limits[0] or n_loss > self.limits[2]):
            raise ValueError(f"an example of {n_tokens} tokens, {n_loss} with loss, fits no sequence and may not be cut")
        k = self.free.pop()
        self.sizes[k], self.what[k], self.from_[k] = (n_tokens, 1, n_loss), what, 0
        while not self.free:
            yield self.sequence()

    def rest(self) -> Iterator[list[tuple]]:
        while len(self.free) < len(self.what):
            yield self.sequence()

    def take(self, k: int, n: int) -> tuple:
        """The first n tokens of an example in the pool."""
        start, tokens = int(self.from_[k]), int(self.sizes[k, 0])
        piece = (self.what[k], start, n)
        if n == tokens:
            self.sizes[k], self.what[k] = np.inf, None
            self.free.append(k)
        else:
            self.from_[k] += n
            self.sizes[k, 0] -= n
            self.sizes[k, 2] = min(self.sizes[k, 2], self.sizes[k, 0])
        return piece

    def sequence(self) -> list[tuple]:
        left, out = self.limits.copy(), []
        while left[0] > 0 and left[1] > 0:
            fits = (self.sizes <= left).all(1)
            if fits.any():
                at = np.flatnonzero(fits)
                k = int(at[np.argmax((self.sizes[at] / self.limits) @ (left / self.limits))])
                n = int(self.sizes[k, 0])
            elif self.cut and len(self.free) < len(self.what):
                # The part of the example before its loss, and as much of its loss as the sequence still takes.
                used = np.flatnonzero(np.isfinite(self.sizes[:, 0]))
                size = self.sizes[used]
                can = np.minimum(left[0], size[:, 0] - size[:, 2] + left[2])
                best = int(np.lexsort((size[:, 0], can))[-1])
                k, n = int(used[best]), int(can[best])
                if n < 1:
                    break
            else:
                break
            loss = max(0, n - int(self.sizes[k, 0] - self.sizes[k, 2]))
            left -= (n, 1, loss)
            out.append(self.take(k, n))
        return out


def powers(sequence: list[tuple], tokens: int) -> Iterator[list[tuple]]:
    """A sequence as it is if it is full, else its pieces in sequences whose lengths are powers of two, the longest first."""
    left = sum(n for _, _, n in sequence)
    if left == tokens:
        yield sequence
        return
    pieces = sequence[::-1]
    while left:
        room = size = 1 << (left.bit_length() - 1)
        out = []
        while room:
            what, start, n = pieces.pop()
            out.append((what, start, min(n, room)))
            if n > room:
                pieces.append((what, start + room, n - room))
            room -= min(n, room)
        left -= size
        yield out


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 256, max_loss_tokens: int | None = None, loss: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id. loss names a column with the number of its last tokens that bear loss, as in
    instruction data, whose prompts bear none (null and larger numbers: all, negative ones: none); without it all do, and
    the limit on them is that on tokens unless max_loss_tokens is smaller. Documents may be cut; whole sequences are cut from the
    front of long ones. Null and empty texts are the end_id alone; repeated rows are packed each; an empty table gives
    no rows; other columns are ignored. sequence_id holds the partition above the lower 32 bits.
    """
    most_loss = max_tokens if max_loss_tokens is None else max_loss_tokens
    chunk = min(max_tokens, most_loss)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = bpe.library_tokenizer(tokenizer), Packer(max_tokens, max_segments, most_loss, cut=True)
        base, n, rows = TaskContext.get().partitionId() << 32, 0, []

        def put(sequence: list[tuple]) -> None:
            nonlocal n
            offset = 0
            for (doc_id, ids, shift, total), start, size in sequence:
                rows.append((doc_id, shift + start, size, zlib.crc32(ids[start : start + size]), total, base + n, offset))
                offset += size
            n += 1

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], PIECES.replace(" long", "").split(", "))
            rows.clear()
            return made

        for batch in batches:
            for part in words.slices(batch, 1, bpe.SLICE):
                ids, at = encode(part.column(1))
                ids = ids.astype("<u4")
                bearing = part.column(2).to_pylist()
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(own) // chunk * chunk if chunk == max_tokens else 0
                    for s in range(0, whole, chunk):
                        put([((doc_id, own[s : s + chunk], s, len(own)), 0, chunk)])
                    if len(own) > whole:
                        # A copy: what waits in the pool must not hold on to the rest of its document.
                        left = len(own) - whole
                        n_loss = left if bearing[k] is None else max(0, min(left, bearing[k]))
                        for sequence in packer.add(left, n_loss, (doc_id, own[whole:].copy(), whole, len(own))):
                            for s in powers(sequence, max_tokens):
                                put(s)
                yield out()
        for sequence in packer.rest():
            for s in powers(sequence, max_tokens):
                put(s)
        yield out()

    return documents.select("doc_id", "text", (F.col(loss) if loss else F.lit(None)).cast("long").alias("loss")).mapInArrow(apply, PIECES)
