import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(PATH)
TRIE = bpe.Encoder(bpe.trie_encoder(VOCABULARY), list(VOCABULARY.special))
SHARED = bpe.library_tokenizer(PATH)
SCHEMA = "doc_id long, text string, n_tokens string, start int"


@pytest.mark.parametrize("encode", [TRIE, SHARED])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t 　\u0085'sabé.,12<|endoftext|>\U0001f600", max_size=40), st.none()), max_size=8))
def test_ids_are_the_library_s(encode, texts):
    ids, at = encode(pa.array(texts, pa.string()))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


def rows():
    r = random.Random(1)
    texts = [None, "", " ", "<|endoftext|> a<|endoftext|>", "a  b \n c", "漢字" * 2000, "word " * 5000, "x" * 20_000]
    texts += [" ".join("".join(r.choice("abcdehinorst") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 400))) for _ in range(150)]
    return [*enumerate(texts), (None, "no id"), (3, texts[3])]


def test_digests(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows()], SCHEMA).repartition(2)
    want = []
    for d, t in rows():
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_pieces_hold_every_id_once_without_padding(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows() if d is not None][:-1], SCHEMA).repartition(3)
    got = packing.pack(df, PATH).collect()
    ids = {d: np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows()}
    ends = {d: 0 for d in ids if d is not None}
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        assert p.start == ends[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        ends[p.doc_id] += p.length
    assert ends == {d: len(ids[d]) for d in ends}
    sequences = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert all(0 < n <= 2048 and n & (n - 1) == 0 for n in sequences.values())
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    assert sum(p.doc_id is None for p in packing.pack(spark.createDataFrame([(None, "a", "x", 1)] * 2, SCHEMA), PATH).collect()) == 2


@pytest.mark.parametrize("cut", [False, True])
def test_packer_keeps_all_limits(cut):
    r = random.Random(2)
    packer = packing.Packer(1000, 5, 300, cut, pool=40)
    examples = [(n := r.randint(1, 1000), r.randint(0, min(n, 300))) for _ in range(400)]
    full = [s for k, (n, loss) in enumerate(examples) for s in packer.add(n, loss, k)] + list(packer.rest())
    held = [0] * len(examples)
    for s in full:
        assert sum(n for _, _, n in s) <= 1000 and len(s) <= 5
        loss = sum(max(0, min(start + n, examples[k][0]) - max(start, examples[k][0] - examples[k][1])) for k, start, n in s)
        assert loss <= 300
        for k, start, n in s:
            assert start == held[k] and (cut or n == examples[k][0])
            held[k] += n
    assert held == [n for n, _ in examples]
    assert sum(n for n, _ in examples) / len(full) > 550


def test_packer_refuses_what_fits_nowhere():
    with pytest.raises(ValueError):
        list(packing.Packer(10, 2, 5, False).add(11, 0, "x"))


def plain_packer(examples, limits, pool):
    """The heuristic once more, in plain Python: (tokens, loss, name) to sequences of (name, start, length)."""
    slots, free, out = [None] * pool, list(range(pool))[::-1], []

    def sequence():
        left, made = list(limits), []
        while left[0] > 0 and left[1] > 0:
            best, top = None, -1.0
            for k, e in enumerate(slots):
                if e and e[0] <= left[0] and 1 <= left[1] and e[1] <= left[2]:
                    dot = sum(x / m * (y / m) for x, y, m in zip((e[0], 1, e[1]), left, limits))
                    if dot > top + 1e-12:
                        best, top = k, dot
            n = slots[best][0] if best is not None else 0
            if best is None:
                can = [(min(left[0], e[0] - e[1] + left[2]), e[0], k) for k, e in enumerate(slots) if e]
                if not can or max(can)[0] < 1:
                    break
                n, _, best = max(can)
            tokens, loss, name, start = slots[best]
            made.append((name, start, n))
            left = [left[0] - n, left[1] - 1, left[2] - max(0, n - (tokens - loss))]
            if n == tokens:
                slots[best] = None
                free.append(best)
            else:
                slots[best] = (tokens - n, min(loss, tokens - n), name, start + n)
        return made

    for tokens, loss, name in examples:
        slots[free.pop()] = (tokens, loss, name, 0)
        while not free:
            out.append(sequence())
    while len(free) < pool:
        out.append(sequence())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packer_against_plain_python(seed):
    r = random.Random(seed)
    # Sizes that differ in all ways, so that no two dot products are equal.
    examples = [(n := r.randint(1, 90), r.randint(0, n), k) for k in range(120)]
    limits, got = (64, 5, 40), []
    packer = packing.Packer(*limits, cut=True, pool=9)
    for tokens, loss, name in examples:
        got += list(packer.add(tokens, loss, name))
    got += list(packer.rest())
    want = plain_packer(examples, limits, 9)
    assert [[tuple(map(int, p)) for p in s] for s in got] == want
    assert any(sum(n for _, _, n in s) < 64 for s in want)  # the limits on segments and loss act


def test_examples_whose_prompts_bear_no_loss(spark):
    """The limit on loss keeps answers apart where prompts alone would fit together; a null number means all tokens."""
    rows = [(k, "one two three four five six seven eight nine ten " * 3, 20, "x") for k in range(30)] + [(100, "short", None, "x"), (101, None, -5, "x"), (102, "a b", 99, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer int, loss string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    few = packing.pack(docs, path, max_tokens=256, max_loss_tokens=64, loss="answer").collect()
    assert sorted({r.doc_id for r in few}) == sorted(r[0] for r in rows)
    bearing = {r[0]: r[2] for r in rows}
    loss_of = {}
    for r in few:
        n = r.doc_tokens if bearing[r.doc_id] is None else max(0, min(bearing[r.doc_id], r.doc_tokens))
        own = max(0, r.start + r.length - max(r.start, r.doc_tokens - n))
        loss_of[r.sequence_id] = loss_of.get(r.sequence_id, 0) + own
    assert max(loss_of.values()) <= 64
    assert len({r.sequence_id for r in packing.pack(docs, path, max_tokens=256).collect()}) < len(loss_of)


def test_other_tokenizers_are_refused():
    """A file that cuts texts otherwise would give wrong ids."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.supported(spec)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", spec["pre_tokenizer"] | {"use_regex": False}), ("pre_tokenizer", None), ("model", spec["model"] | {"ignore_merges": True})):
        with pytest.raises(ValueError, match="splitting"):
            bpe.supported(spec | {key: value})
    with pytest.raises(ValueError, match="pre_tokenizer"):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
