import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_phrases import brute as phrase_brute
from tidewater.llm import toxicity


def made():
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(500)]
    bad = ["idiot", "moron", "scum", "trash"]
    passage = " ".join(f"passage{k}" for k in range(60))
    rows, labels = [], []
    for k in range(240):
        text = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(6):
                text[r.randrange(len(text))] = r.choice(bad)
        if k % 7 == 1:
            text.insert(5, passage)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    for k in range(240, 270):
        text = rows[k - 239][1].split(" ")
        text[-1] = "changed"
        rows.append((k, " ".join(text)))
    return [*rows, (300, None), (301, ""), (302, "x" * 20_000)], labels


def test_run_against_plain_python(spark, tmp_path):
    rows, labels = made()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = [row for row, s in zip(rows, toxicity.score_texts(pa.array([t for _, t in rows], pa.string()), *model)) if s < 0.5]
    toxic = {d for d, _, t in labels if t}
    assert not toxic & {d for d, _ in clean}
    assert {d for d, _, t in labels if not t} <= {d for d, _ in clean}
    kept = {d for d, _, _, k in near_brute(clean, 5) if k}
    left = {d: text for d, _, _, text in phrase_brute([x for x in clean if x[0] in kept], 13)}
    assert 0 < len(left) < len(clean) < len(rows)
    assert sum("passage0" in t for t in left.values()) == 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in left.items()}
    assert {r.doc_id for r in got} == set(want)
    ends = dict.fromkeys(want, 0)
    for p in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = want[p.doc_id]
        assert p.start == ends[p.doc_id] and p.doc_tokens == len(ids)
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        ends[p.doc_id] += p.length
    assert ends == {d: len(ids) for d, ids in want.items()}


@pytest.mark.parametrize("k", range(4))
def test_stages_of_empty_documents(spark, tmp_path, k):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.collect() == []
    assert k == 3 or out.columns == docs.columns


@pytest.mark.parametrize("labels", [[], [(1, 1, None), (2, 0, None)], [(0, 1, 1), (5, 1, 0)], [(1, 1, 1), (2, 1, 1)], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1), (9999, 1, 0)]])
def test_no_document_is_rejected_without_both_classes(spark, tmp_path, labels):
    if labels and labels[0][0] == 0:  # all labelled rows are held out
        labels = [(d, 1, d % 2) for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 0]
    elif labels:
        assert all(zlib.crc32(str(d).encode()) % 5 for d, _, _ in labels)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "an idiot", "en", "s", 8), (2, "a fine day", "en", "s", 10), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).collect())) == rows


def test_documents_that_lose_no_word_keep_their_text(spark):
    passage = "\n".join(f"p{k}" for k in range(20))
    texts = [(1, passage + "\n\n  a\tb "), (2, "x\n  y"), (3, "c\n" + passage + "\nd"), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 7) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(map(tuple, corpus_pipeline.without_repeats(spark, docs.coalesce(1), "").select("doc_id", "text", "n_chars").collect()))
    assert out == [(d, t, len(t or "")) for d, t in [*texts[:2], (3, "c d"), *texts[3:]]]


def test_stages_keep_columns_with_clashing_names_and_settle_ties(spark, tmp_path):
    """Null and repeated doc_ids, and columns that are called like those the stages add."""
    r = random.Random(3)
    words = lambda n: " ".join(r.choice(["one", "two", "red", "sea", "tree", "stone"]) + str(r.randint(0, 999)) for _ in range(n))
    passage = words(40)
    rows = [(k, words(30) + (" you idiot moron scum" * 3 if k % 3 == 0 else "")) for k in range(60)]
    spark.createDataFrame([(d, 1, int(d % 3 == 0)) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows += [(None, words(20)), (None, None), (100, "b " + passage), (100, "a " + passage), (100, None), (101, words(9) + " " + passage), (101, words(9))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity_score string, n_words string, N_Removed string, _row int, score int, kept string"
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "mine", "mine", "mine", k, 3, "kept") for k, (d, t) in enumerate(rows)], schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all((x.toxicity_score, x.n_words, x.N_Removed, x.score, x.kept) == ("mine", "mine", "mine", 3, "kept") for x in got)
        if name == "near_duplicates":
            assert [x.text for x in got if x.doc_id == 100] == ["a " + passage] and sum(x.doc_id is None for x in got) == 2
            assert sum(x.doc_id == 101 for x in got) == 1 and len({x.doc_id for x in got}) == len(got) - 1
        elif name == "repeated_passages":
            assert len(got) == len(rows) and sum(passage in (x.text or "") for x in got) == 2  # those of doc_id 100 are not each other's repeats
    packed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()
    assert sum(x.start == 0 for x in packed) == len(rows)


def test_scratch_can_be_cleared(spark):
    from pathlib import Path

    from tidewater.llm.common import clear_scratch, shared_path

    path = shared_path(spark, "cleared")
    spark.range(3).write.parquet(path)
    assert Path(path.removeprefix("file:")).exists() or Path(path.removeprefix("file://")).exists()
    assert clear_scratch(spark, "cleared") == 1 and not Path(path.removeprefix("file://")).exists()
    assert clear_scratch(spark, "cleared") == 0
