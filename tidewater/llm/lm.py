"""Language-model scores of whole documents: a unigram base and a gated recurrent model, both learnt from all training documents.

1. Documents are cut into blocks; a block keeps its tokens as numbers in its own list of distinct words (64-bit hashes)
   and sends that list with its training counts to buckets. Buckets answer every block with the counts of all training
   documents, and give the words that the model knows: those seen at least least_count() times, so that their number
   grows with the corpus, about as the root of its length; the other words are one token of the model, followed by the
   word's add-one share among them.
2. Each block meets the counts of its words and turns into documents: base score, and tokens of the model.
3. The model starts as the unigram model. Training documents are dealt out to shards by a hash of doc_id and text, and
   read in its order, so partitions of the input change nothing. In each of a few rounds every shard trains the model on
   its documents of the round, and the weights are averaged in a tree; every training document is used once. A shard
   holds SHARE tokens for every weight of the model, so the number of shards grows with the corpus, and what they send
   stays a fixed part of it.
4. Documents are scored where they lie, the model's state carried from the first to the last token of a document.

What is broadcast is the model, whose size follows from the number of words it knows. Words are told apart by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import gru, words
from tidewater.llm.common import crc32_text, shared_path, written
from tidewater.llm.groups import whole_groups
from tidewater.llm.phrases import arrays, dealt, pack, unpack

BLOCK = 4 << 20
AT_ONCE = 2_500_000
ROUNDS = (1, 3, 12)  # sixteenths of the training documents
SHARE = 8
FAN = 32  # models averaged at once
PIECE = 1 << 16
DOCUMENTS = "doc_id long, held_out boolean, place long, n_tokens long, n_known long, base_score double, rest double, tokens binary"
PACKED = "kind int, block long, bucket long, payload binary, tokens binary, known binary"
MODELS = "shard long, piece int, seen long, weights binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def rows(kind: int, block, bucket, payload: list[bytes], tokens: bytes | None = None, known: bytes | None = None) -> pa.RecordBatch:
    n = len(payload)
    binary = lambda x: pa.array([x] * n, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary()), binary(tokens), binary(known)], [c.split()[0] for c in PACKED.split(", ")])


def order_of(weights: dict) -> list[tuple[str, tuple[int, ...]]]:
    return [(k, weights[k].shape) for k in sorted(weights)]


def flat(weights: dict) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k, _ in order_of(weights)])


def shaped(values: np.ndarray, shapes: list[tuple[str, tuple[int, ...]]]) -> dict:
    out, at = {}, 0
    for k, shape in shapes:
        n = int(np.prod(shape))
        out[k] = values[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, packed as planes of their bytes: low numbers (of frequent words) leave the upper planes empty."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.int64(len(numbers)).tobytes() + pa.compress(planes, codec="zstd", asbytes=True) if planes else np.int64(0).tobytes()


def unsqueezed(packed: pa.Scalar) -> np.ndarray:
    raw = packed.as_buffer()
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    if not n:
        return np.zeros(0, np.uint32)
    return np.frombuffer(pa.decompress(raw.slice(8), 4 * n, codec="zstd"), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def numbered(known: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The model's token of each known word: 1 for those outside the vocabulary (hashes by frequency), which starts at 2."""
    order = np.argsort(vocabulary)
    if not len(order):
        return np.ones(len(known), np.int32)
    place = np.minimum(np.searchsorted(vocabulary[order], known), len(order) - 1)
    return np.where(vocabulary[order][place] == known, order[place] + 2, 1).astype(np.int32)


def least_count(tokens: int) -> int:
    """How often a word is seen at least, among so many training tokens, for the model to know it."""
    return max(2, int(tokens**0.5 / 32))


def average(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean of some models' pieces, weighted by the tokens they saw, in the order of their shards."""
    pdf = pdf.sort_values("shard")
    seen = int(pdf["seen"].sum())
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) * n for x, n in zip(pdf["weights"], pdf["seen"])) / max(1, seen)
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1] // FAN, "piece": pdf["piece"].iloc[:1], "seen": [seen], "weights": [total.astype(np.float32).tobytes()]})


def scores(documents: DataFrame, vocabulary: int | None = None, classes: int | None = None, rate: float = 0.2, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Held out are documents whose crc32(doc_id) mod 7 is 2; null ids count as the empty text. Null and empty texts are
    one end token; repeated rows count, train and are scored each; other columns are ignored. Without training
    documents every count is 0. The model knows every word that is seen often enough (see least_count()), or the most
    frequent `vocabulary` of them, in `classes` classes (see gru.how_many_classes()). A shard holds about `share` tokens
    for every weight. The partitions of documents change scores by rounding only (about 1e-6 of their size).
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    # place orders documents for training: it depends on what a row holds, not on where it lies.
    source = documents.select("doc_id", "text", (crc32_text("doc_id") % 7 == 2).alias("held_out"), F.xxhash64("doc_id", "text").alias("place"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for part in words.slices(batch, 1, BLOCK):
                raw, at = words.as_bytes(part.column(1), lower=True)
                starts, ends, first = words.spans(raw, at)
                coded = pa.array(words.hash_spans(raw, starts, ends)).dictionary_encode()  # in half the time of sorting them
                known, number = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                uses = np.bincount(number, minlength=len(known))
                rank = np.argsort(-uses, kind="stable")  # frequent words get low numbers
                place = np.empty(len(known), np.int64)
                place[rank] = np.arange(len(known))
                known, number = known[rank], place[number]
                size, train = np.diff(first), ~part.column(2).to_numpy(zero_copy_only=False)
                count = np.bincount(number[np.repeat(train, size)], minlength=len(known))
                order, at = dealt(known, buckets)
                about = pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(size)], ["doc_id", "held_out", "place", "size"])
                yield rows(0, [base + n], [0], [pack(about)], squeezed(number), known.tobytes())
                yield rows(4, [base + n], [int(count.sum())], [b""])
                some = np.flatnonzero(np.diff(at))
                yield rows(1, [base + n] * len(some), some, [pack(arrays(key=known[o], count=count[o])) for o in (order[at[k] : at[k + 1]] for k in some)])
                n += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in whole_groups(batches, ["bucket"], 1):
            payload = part["payload"].combine_chunks()
            for first, last in zip(at[:-1], at[1:]):
                own = [[c.to_numpy() for c in unpack(payload[k]).columns] for k in range(first, last)]
                key, which = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                total = np.bincount(which, np.concatenate([c for _, c in own]), len(key)).astype(np.int64)
                top = np.lexsort((key, -total))[:vocabulary]
                top = top[total[top] >= least]
                edge = np.concatenate([[0], np.cumsum([len(k) for k, _ in own])])
                yield rows(2, part["block"].to_numpy()[first:last], part["bucket"].to_numpy()[first:last], [pack(arrays(count=total[which[i:j]])) for i, j in zip(edge, edge[1:])])
                yield rows(3, [0], [part["bucket"][first].as_py()], [pack(arrays(key=key[top], count=total[top]))], pack(arrays(total=np.array([total.sum(), (total > 0).sum()]))))

    def saved(df: DataFrame, label: str) -> DataFrame:
        path = shared_path(spark, label)
        df.write.partitionBy("kind").option("compression", "none").parquet(path)
        return spark.read.schema("block long, bucket long, payload binary, tokens binary, known binary, kind int").parquet(path)

    cut = saved(source.mapInArrow(split, PACKED), "lm-blocks")
    least = least_count(cut.filter("kind = 4").agg(F.sum("bucket")).first()[0] or 0)
    asked = cut.filter("kind = 1").select("bucket", "block", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
    counted = saved(asked.mapInArrow(count, PACKED), "lm-counts")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, total in zip(batch.column(0), batch.column(1)):
                got, sums = unpack(payload), unpack(total).column(0).to_pylist()
                # The sums have a row of their own, as a bucket may have no word that is frequent enough.
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), *(pa.array([x], pa.int64()) for x in sums)], ["key", "n", "total", "kinds"])
                none = pa.array([0] * got.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([got.column(0).cast(pa.uint64()).view(pa.int64()), got.column(1), none, none], ["key", "n", "total", "kinds"])

    # A bucket's most frequent words, and in a row with n = 0 its number of tokens and of distinct training words.
    top = counted.filter("kind = 3").select("payload", "tokens").mapInArrow(frequent, "key long, n long, total long, kinds long")
    sums = top.agg(F.sum("total"), F.sum("kinds")).first()
    known_ = top.select("key", "n").filter("n > 0").orderBy(F.desc("n"), "key")
    held = (known_ if vocabulary is None else known_.limit(vocabulary)).collect()  # as many rows as the model knows words
    ends = source.filter("not held_out").count()
    n, v = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    keys = np.array([r["key"] for r in held], np.int64).view(np.uint64)
    counts = np.array([ends, (sums[0] or 0) - sum(r["n"] for r in held), *(r["n"] for r in held)], np.float64)
    other, kinds = counts[1], (sums[1] or 0) - len(held)
    at = gru.classes_of(counts, classes or gru.how_many_classes(len(counts)))
    weights = gru.new(counts, at)
    shapes = order_of(weights)
    narrow = "<u2" if len(counts) <= 1 << 16 else "<u4"
    words_known = spark.sparkContext.broadcast(keys)  # the model's words

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the counts of their words become documents."""
        for part, edge in whole_groups(batches, ["block"], 1):
            columns = [part[c].combine_chunks() for c in ("payload", "tokens", "known")]
            for i, j in zip(edge[:-1], edge[1:]):
                about, number, own = unpack(columns[0][i]), unsqueezed(columns[1][i]), np.frombuffer(columns[2][i].as_buffer(), np.uint64)
                to = np.concatenate([[0], np.cumsum(about.column(3).to_numpy())])
                order, _ = dealt(own, buckets)
                count_ = np.zeros(len(own), np.int64)
                count_[order] = np.concatenate([unpack(columns[0][k]).column(0).to_numpy() for k in range(i + 1, j)] or [np.zeros(0, np.int64)])
                token = numbered(own, words_known.value)
                logs = np.log10((count_ + 1) / (n + v + 1))
                rests = np.where(token == 1, np.log10((count_ + 1) / (other + kinds + 1)), 0.0)
                of = np.repeat(np.arange(about.num_rows), np.diff(to))
                sums_ = [np.bincount(of, x[number], about.num_rows) for x in (count_ > 0, logs, rests)]
                flat_, base = memoryview(token[number].astype(narrow)).cast("B"), sums_[1] + np.log10((ends + 1) / (n + v + 1))
                wide = np.dtype(narrow).itemsize
                text = pa.array([flat_[wide * a : wide * b].tobytes() for a, b in zip(to.tolist(), to[1:].tolist())], pa.binary())
                known_here = sums_[0].astype(np.int64) + (ends > 0)
                yield pa.RecordBatch.from_arrays([*about.columns[:3], pa.array(np.diff(to) + 1), pa.array(known_here), pa.array(base), pa.array(sums_[2]), text], [c.split()[0] for c in DOCUMENTS.split(", ")])

    answers = counted.filter("kind = 2").select("kind", "block", "bucket", "payload", "tokens", "known")
    both = cut.filter("kind = 0").select("kind", "block", "bucket", "payload", "tokens", "known").union(answers)
    turned = written(both.repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(turn, DOCUMENTS), "lm-documents")

    shards = max(1, round(n / max(1 << 20, share * len(flat(weights)))))
    dealt_ = turned.filter("not held_out").select(F.pmod("place", F.lit(shards)).alias("shard"), F.pmod(F.shiftright("place", 32), F.lit(sum(ROUNDS))).alias("turn"), "place", "tokens")
    first = 0
    for length in ROUNDS:
        handle = spark.sparkContext.broadcast(flat(weights))  # the model

        def learn(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            start, shard, learner, held_, size = shaped(handle.value, shapes), None, None, [], 0

            def ready() -> None:
                learner.learn(np.concatenate([np.zeros(1, np.int32), *held_]))
                held_.clear()

            def sent() -> pa.RecordBatch:
                values = flat(learner.weights).astype(np.float32)
                pieces = [values[k : k + PIECE].tobytes() for k in range(0, len(values), PIECE)]
                return pa.RecordBatch.from_arrays([pa.array([shard] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array([learner.seen] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["shard", "piece", "seen", "weights"])

            for batch in batches:
                for number, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if number != shard or size > 400_000:
                        if held_:
                            ready()
                            size = 0
                        if number != shard:
                            if learner is not None:
                                yield sent()
                            shard, learner = number, gru.Learner(start, at, rate)
                    held_ += [np.frombuffer(tokens.as_buffer(), narrow).astype(np.int32), np.zeros(1, np.int32)]
                    size += len(held_[-2]) + 1
            if held_:
                ready()
                yield sent()

        # Several times as many partitions as shards, so that few of them hold two.
        now = dealt_.filter((F.col("turn") >= first) & (F.col("turn") < first + length)).select("shard", "place", "tokens").repartition(4 * shards, "shard")
        trained = now.sortWithinPartitions("shard", "place").select("shard", "tokens").mapInArrow(learn, MODELS)
        left = shards
        while True:  # FAN models at most meet in a task; the tree has as many levels as the shards need
            trained = trained.groupBy(F.floor(F.col("shard") / FAN).alias("_group"), "piece").applyInPandas(average, MODELS)
            left = -(-left // FAN)
            if left <= 1:
                break
        total = sorted(trained.collect(), key=lambda r: r["piece"])  # one model
        if total and total[0]["seen"]:
            weights = shaped(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in total]), shapes)
        first += length

    model = spark.sparkContext.broadcast(flat(weights))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held_, size = shaped(model.value, shapes), [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held_)
            found = gru.score(w, at, [np.frombuffer(x.as_buffer(), narrow).astype(np.int32) for c in table["tokens"].chunks for x in c]) / np.log(10)
            score = pa.array(found + table["rest"].to_numpy())
            return pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(found), n)), table["base_score"].combine_chunks(), score], [c.split()[0] for c in SCORES.split(", ")])

        for batch in batches:
            if batch.num_rows:
                held_.append(batch)
                size += batch.nbytes // np.dtype(narrow).itemsize
            if size >= AT_ONCE:
                yield out()
                held_, size = [], 0
        if held_:
            yield out()

    return turned.drop("place").mapInArrow(finish, SCORES)
