"""Byte-level BPE over whole columns: distinct pieces are encoded once, a trie shares the work on common prefixes.

A text is cut before every blank that stands between two other characters that can't be white space: the pattern that
splits text before the merges always starts a new token there, so such pieces are encoded independently, and equal
pieces only once. The distinct words of the distinct pieces go into a trie. The last token of a prefix's encoding
determines the rest: the token t ends the encoding of a prefix p + t exactly if t follows the last token of p, that
is, if the two bytes strings together are encoded as these two tokens. A depth-first walk of the trie therefore carries
the last token of every prefix on the path, and what words share at their front is computed once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewater.llm import words

SLICE = 4 << 20
MOST_CACHED = 1_200_000
# Fixed value: how byte-level tokenizers cut texts before merging, where their file says use_regex.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}


def supported(spec: dict) -> None:
    """Raises where a tokenizers file asks for another way of encoding than the one that is built here."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wanted = {
        "normalizer": (spec.get("normalizer"), None), "pre_tokenizer": (before.get("type"), "ByteLevel"), "add_prefix_space": (before.get("add_prefix_space"), False),
        "use_regex": (before.get("use_regex", True), True), "model": (model.get("type", "BPE"), "BPE"),
    }
    wanted |= {k: (model.get(k) or None, None) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
    wrong = [f"{k} {given!r}" for k, (given, known) in wanted.items() if given != known]
    if wrong:
        raise ValueError(f"not a byte-level BPE with the standard splitting: {', '.join(wrong)}")


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers file with a byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        supported(spec)
        byte = byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        raw = {t: bytes(byte[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: k for t, k in spec["model"]["vocab"].items()}
        self.rank = {(raw[a], raw[b]): k for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.longest = max(map(len, self.ids))
        text = self.ids | self.special
        by_id = {k: b for b, k in text.items()}
        self.bytes = [by_id.get(k, b"") for k in range(max(by_id) + 1)]
        self.built = {}  # token: the two parts and the rank of the merge that makes it
        for (a, b), k in self.rank.items():
            self.built.setdefault(a + b, (a, b, k))
        self.known: dict[int, bool] = {}
        self._edges: dict[tuple[bytes, int], list[tuple[bytes, int, float]]] = {}

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int, float]]:
        """What stands at one edge of a token (0 left, 1 right) while it is built: part, rank that makes it, rank that ends it."""
        out = self._edges.get((token, side))
        if out is None:
            out, part, end = [], token, float("inf")
            while part is not None:
                built = self.built.get(part)
                out.append((part, built[2] if built else -1, end))
                part, end = (built[side], built[2]) if built else (None, 0)
            self._edges[token, side] = out
        return out

    def follows(self, a: int, b: int) -> bool:
        """Whether a and b side by side are encoded as a, b: no merge across their border comes while both its parts stand there.

        Of equal ranks the leftmost merge comes first: the one inside a, then the one across, then the one inside b.
        """
        known = self.known.get(a << 32 | b)
        if known is None:
            if len(self.known) > 500_000:
                self.known.clear()
            rank = self.rank
            known = True
            for x, made, end in self.edge(self.bytes[a], 1):
                for y, made_y, end_y in self.edge(self.bytes[b], 0):
                    m = rank.get((x, y))
                    if m is not None and made < m < end and made_y < m <= end_y:
                        known = False
            self.known[a << 32 | b] = known
        return known


ONE = [bytes([b]) for b in range(256)]


def trie_of(distinct: set[bytes]) -> dict:
    """A trie of nested dicts by byte; -1 marks the end of a word."""
    trie: dict = {}
    for word in distinct:
        node = trie
        for b in word:
            child = node.get(b)
            if child is None:
                child = node[b] = {}
            node = child
        node[-1] = True
    return trie


def encode_words(vocabulary: Vocabulary, distinct: set[bytes]) -> dict[bytes, tuple[int, ...]]:
    """The encodings of all given words, by one depth-first walk of their trie."""
    token_of, known, follows, longest, out = vocabulary.ids.get, vocabulary.known.get, vocabulary.follows, vocabulary.longest, {}
    last, back = [-1], [0]  # of the first k bytes of the path: the last token, and where it starts
    stack = [(b"", trie_of(distinct))]
    while stack:
        path, node = stack.pop()
        depth = len(path)
        if depth:
            del last[depth:], back[depth:]
            start = max(0, depth - longest)
            token = token_of(path[start:])
            while token is None or start and not (known(last[start] << 32 | token) or follows(last[start], token)):
                start += 1
                token = token_of(path[start:])
            last.append(token)
            back.append(start)
        for b, child in node.items():
            if b >= 0:
                stack.append((path + ONE[b], child))
            else:
                parts, k = [], depth
                while k:
                    parts.append(last[k])
                    k = back[k]
                out[path] = tuple(parts[::-1])
    return out


def trie_encoder(vocabulary: Vocabulary) -> Callable[[list[bytes]], list[tuple[int, ...]]]:
    """Encodes pieces: their words by the trie, special tokens by their ids."""

    def encode(pieces: list[bytes]) -> list[tuple[int, ...]]:
        split = [() if p in vocabulary.special else [w.encode() for w in SPLIT.findall(p.decode())] for p in pieces]
        of = encode_words(vocabulary, {w for ws in split for w in ws})
        return [(vocabulary.special[p],) if p in vocabulary.special else of[ws[0]] if len(ws) == 1 else tuple(t for w in ws for t in of[w]) for p, ws in zip(pieces, split)]

    return encode


def pieces(raw: np.ndarray, at: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces, and their number before each row.

    White space outside ASCII starts with the bytes C2, E1, E2 or E3 in UTF-8; beside a character that starts with
    one of these, nothing is cut.
    """
    n = len(raw)
    unsure = (raw <= 0x20) | (raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3))
    long = np.zeros(n, bool)  # ends such a character
    long[1:] |= (raw[:-1] == 0xC2) & (raw[1:] >= 0x80)
    long[2:] |= (raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3)
    cut = np.zeros(n + 1, bool)
    cut[1 : n - 1] = (raw[1 : n - 1] == 0x20) & ~(unsure | long)[: n - 2] & ~unsure[2:] if n > 2 else False
    if n:
        cut[at[:-1]] = True
        cut[n] = True
        text = raw.tobytes() if special else b""
        for token in special:
            k = text.find(token)
            while k >= 0:
                if at[np.searchsorted(at, k, side="right")] >= k + len(token):
                    cut[[k, k + len(token)]] = True
                    k = text.find(token, k + len(token))
                else:
                    k = text.find(token, k + 1)
    edges = np.flatnonzero(cut)
    return edges[:-1], edges[1:], np.searchsorted(edges[:-1], at)


class Encoder:
    """Encodes columns; keeps the encodings of pieces, by their hashes, from one column to the next."""

    def __init__(self, encode: Callable[[list[bytes]], list[tuple[int, ...]]], special: list[bytes]):
        self.encode, self.special = encode, special
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and each row's offsets. Nulls are empty texts."""
        raw, at = words.as_bytes(column)
        starts, ends, first = pieces(raw, at, self.special)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        distinct, one, which = np.unique(words.hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MOST_CACHED:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != distinct[inside]
        if new.any():
            text, fresh = raw.tobytes(), one[new]
            got = self.encode([text[i:j] for i, j in zip(starts[fresh].tolist(), ends[fresh].tolist())])
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.keys = np.insert(self.keys, place[new], distinct[new])
            self.slots = np.insert(self.slots, place[new], np.arange(len(self.at) - 1, len(self.at) - 1 + len(got)))
            self.ids = np.concatenate([self.ids, np.fromiter((t for ts in got for t in ts), np.uint32, int(size.sum())).astype(np.uint32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        slot = self.slots[np.searchsorted(self.keys, distinct)][which]
        ids, to = ragged(self.ids, self.at, slot)
        return ids, to[first]


def ragged(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given ragged rows one after another, and the rows' offsets in them."""
    size = at[rows + 1] - at[rows]
    to = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(at[rows] - to[:-1], size) + np.arange(to[-1])], to


@lru_cache(maxsize=1)
def trie_tokenizer(path: str) -> tuple[Vocabulary, Encoder]:
    """Kept by a Python worker from task to task."""
    vocabulary = Vocabulary(path)
    return vocabulary, Encoder(trie_encoder(vocabulary), list(vocabulary.special))


def digests(documents: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Every whole text is encoded, special tokens in it as the library does, and its ids are decoded again. Null and
    empty texts have no ids and the digest of nothing; repeated rows are repeated; other columns are ignored.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encode = trie_tokenizer(tokenizer)
        letters = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        letters_at = np.concatenate([[0], np.cumsum([len(b) for b in vocabulary.bytes])])
        for batch in batches:
            for part in words.slices(batch, 1, SLICE):
                ids, at = encode(part.column(1))
                decoded, to = ragged(letters, letters_at, ids.astype(np.int64))
                flat = memoryview(ids.astype("<u4")).cast("B")
                text = memoryview(decoded).cast("B")
                ids_sha = [hashlib.sha256(flat[4 * i : 4 * j]).hexdigest() for i, j in zip(at, at[1:])]
                text_sha = [hashlib.sha256(whole(text[i:j])).hexdigest() for i, j in zip(to[at], to[at[1:]])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(apply, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def whole(text: memoryview) -> bytes:
    """Decoding replaces what is not UTF-8, as the library's decode() does."""
    return bytes(text).decode("utf-8", "replace").encode()


def _joins(piece: bytes) -> bool:
    """Whether a piece starts with a cut blank and ends with a character that can't be white space, so that pieces before and after it don't matter."""
    if len(piece) < 2 or piece[0] != 0x20 or piece[1] <= 0x20 or piece[1] == 0xC2 or 0xE1 <= piece[1] <= 0xE3 or piece[-1] <= 0x20:
        return False
    return piece[-1] < 0x80 or piece[-2] != 0xC2 and not 0xE1 <= piece[-3] <= 0xE3


def library_encoder(vocabulary: Vocabulary, path: str) -> Callable[[list[bytes]], list[tuple[int, ...]]]:
    """Encodes pieces with the tokenizers library, many in one text; the lengths of the tokens tell where each ends."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    length = np.array([len(b) for b in vocabulary.bytes])

    def encode(given: list[bytes]) -> list[tuple[int, ...]]:
        joins = [k for k, p in enumerate(given) if _joins(p)]
        out: list = [None] * len(given)
        for k in range(0, len(joins), 5000):
            some = joins[k : k + 5000]
            ids = tokenizer.encode(b"".join([given[i] for i in some]).decode(), add_special_tokens=False).ids
            ends = np.searchsorted(np.cumsum(length[ids]), np.cumsum([len(given[i]) for i in some])) + 1
            first = 0
            for i, last in zip(some, ends.tolist()):
                out[i] = ids[first:last]
                first = last
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, got in zip(rest, tokenizer.encode_batch([given[i].decode() for i in rest], add_special_tokens=False)):
            out[k] = got.ids
        return out

    return encode


@lru_cache(maxsize=1)
def library_tokenizer(path: str) -> Encoder:
    """Kept by a Python worker from task to task."""
    vocabulary = Vocabulary(path)
    return Encoder(library_encoder(vocabulary, path), list(vocabulary.special))
