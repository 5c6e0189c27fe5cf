import random
import re

import numpy as np
import pytest

from tidewater.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n_words string, block int"


def brute(rows, size):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, float("inf")), float("inf") if d is None else d)
    out = []
    for d, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (float("inf") if d is None else d):
                gone.update(range(k, k + size))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    few = ["a", "b", "é", "漢字", "Word"]
    passages = [[f"p{k}x{i}" for i in range(r.randint(13, 60))] for k in range(5)]
    rows = [(None, " ".join(passages[0])), (None, " ".join(passages[0])), (3, None), (4, ""), (5, " \n\t "), (6, "x" * 30_000 + " " + " ".join(passages[1]))]
    for k in range(10, 70):
        text = []
        for _ in range(r.randint(1, 6)):
            p = r.choice(passages)
            text += p[r.randint(0, 5) : r.randint(10, len(p))] + [r.choice(few) for _ in range(r.randint(0, 30))]
        rows.append((k, r.choice([" ", "\n", "\t "]).join(text)))
    rows += [rows[-1], rows[-1], (70, rows[-1][1]), (9, rows[20][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "block"), [(13, 4 << 20), (13, 1500), (4, 900), (6, 3000)])
def test_against_brute_force(spark, monkeypatch, size, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows = made(size + block)
    docs = spark.createDataFrame([(d, t, "en", "kept?", 1) for d, t in rows], SCHEMA).repartition(3)
    out = phrases.repeated_windows_removed(docs, size)
    assert out.columns == ["doc_id", "text", "lang", "block", "n_words", "n_removed"]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()], key=str) == brute(rows, size)


def test_empty_table(spark):
    assert phrases.repeated_windows_removed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_letters_tell_numbers_apart():
    for top in (3, 64, 300_000):
        text, width = phrases.letters(np.arange(0, top + 1, max(1, top // 50)))
        found = [text[k : k + width] for k in range(0, len(text), width)]
        assert len(set(found)) == len(found)


@pytest.mark.parametrize("block", [4 << 20, 900])
def test_windows_whose_keys_collide_are_told_apart(spark, monkeypatch, block):
    """Keys of windows are cut to a few bits, so that very many different windows share one."""
    rows = made(5)
    docs = spark.createDataFrame([(d, t, "en", "kept?", 1) for d, t in rows], SCHEMA).coalesce(2)
    monkeypatch.setattr(phrases, "KEYS", np.uint64(0b110 | 3 << 40))
    monkeypatch.setattr(phrases, "BLOCK", block)
    out = phrases.repeated_windows_removed(docs, 6)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()], key=str) == brute(rows, 6)
