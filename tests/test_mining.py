"""The registered queries that mine whole tables, against plain Python on small ones."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.operators import dataset, keywords
from tidewater.plans import mining
from tidewater.plans import standins as S


def comments(spark, folder):
    r = random.Random(4)
    polite, passage = "please fix this before we can merge it to the branch".split(), [f"p{k}" for k in range(12)]
    rows, labels = [(900, None), (901, ""), (902, "one")], [(900, 0, 0), (901, 0, 1), (902, 1, 1)]
    for k in range(120):
        text = [r.choice(["a", "b", "cc", "d"]) for _ in range(r.randint(1, 15))]
        text += polite * (k % 3 == 0) + passage * (k % 4 == 0)
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 3 > 0), int(k % 4 == 0)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    known = {d: (q == 0, t == 1) for d, q, t in labels}
    total, request, confirmation = Counter(), Counter(), Counter()
    for d, t in rows:
        words = (t or "").split()
        phrases = {" ".join(words[i : i + n]) for n in range(1, 11) for i in range(len(words) - n + 1)}
        total.update(phrases)
        request.update(phrases if known[d][0] else ())
        confirmation.update(phrases if known[d][1] else ())
    return total, request, confirmation


def test_phrases_of_one_to_ten_words(spark, tmp_path):
    total, request, confirmation = comments(spark, tmp_path)
    got = mining.mined_phrase_counts(spark, str(tmp_path)).collect()
    assert {(x.phrase, x.total, x.request, x.confirmation) for x in got} == {(p, n, request[p], confirmation[p]) for p, n in total.items()} and len(got) == len(total)
    assert {len(p.split()) for p in total} == set(range(1, 11))
    precise = lambda of, ratio: {p for p, n in total.items() if n >= 10 and of[p] / n >= ratio}
    want = {("request", p, total[p]) for p in precise(request, 0.3)} | {("confirmation", p, total[p]) for p in precise(confirmation, 0.9)}
    assert set(map(tuple, mining.mined_keyword_precision(spark, str(tmp_path)).collect())) == want
    least = lambda x: {p for p in x if not any(q != p and q in p for q in x)}
    mined = {("request", p) for p in least(precise(request, 0.9))} | {("confirmation", p) for p in least(precise(confirmation, 0.9))}
    out = list(map(tuple, mining.mined_keywords(spark, str(tmp_path)).collect()))
    assert set(out) == mined and len(out) == len(mined) and {k for k, _ in out} == {"request", "confirmation"}


def test_frequent_phrases_are_those_of_all_counts(spark):
    """Against counting everything; the filter prunes nothing wrongly when it is almost full, and slices cut no comment."""
    r = random.Random(7)
    rows = [(" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 30))), k % 2 == 0) for k in range(200)] + [(None, True), ("", False), ("x" * 5000, True), (" ".join(["again"] * 3000), True)]
    comments = spark.createDataFrame(rows, "cleaned string, flag boolean").repartition(3)
    want = {tuple(x) for x in keywords.phrase_counts(comments.fillna(""), ["flag"], 1, 5).filter("total >= 4").collect()}
    for bits, words in ((26, 1 << 19), (7, 40)):
        out = list(map(tuple, keywords.frequent_phrases(comments, ["flag"], 4, 5, bits, words).collect()))
        assert len(out) == len(set(out)) and set(out) == want and {len(p.split()) for p, *_ in want} >= {1, 2, 3}
    assert keywords.frequent_phrases(comments.limit(0), ["flag"]).collect() == []


def test_feature_vectors_of_every_day(spark):
    folder = "/root/testdata/sf0.001"
    out = mining.feature_vectors_daily(spark, folder).toPandas()
    assert list(out.columns) == ["change_number", "t", *dataset.FEATURES] and not out.isna().any().any()
    known = {(r.change_number, r.t): r for r in out.itertuples()}
    start, days = S.ntz(S.GRID[0]), 181
    want = set()
    grid = [r.t for r in spark.range(days).select((start + F.make_dt_interval(F.col("id").cast("int"))).alias("t")).collect()]
    for c in S.changes(spark, folder).select("change_number", F.col("created").cast("timestamp_ntz").alias("created"), F.col("decision_time").cast("timestamp_ntz").alias("decided")).collect():
        want |= {(c.change_number, t) for t in grid if c.created <= t and (t - c.created).total_seconds() <= 365 * 86400 and (c.decided is None or t < c.decided)}
    assert set(known) == want and len(out) == len(want)
    some = mining.feature_vectors(spark, folder).collect()
    assert len(some) == len(want)
    for r in some[::50]:
        assert all(abs(getattr(known[r.change_number, r.t], f) - r[f]) < 1e-5 for f in dataset.FEATURES)


def test_comments_are_cut_in_bounded_pieces():
    """A batch of comments is no longer turned into words as a whole."""
    rows = ["x" * 40, None, "", "y" * 300, "z", "w" * 60, "v" * 60]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(range(7))], ["cleaned", "n"])
    parts = [p.column(0).to_pylist() for p in keywords._pieces(batch, 100)]
    assert sum(parts, []) == rows and all(len(p) == 1 or sum(len(x or "") for x in p) <= 100 for p in parts) and len(parts) == 4
    assert list(keywords._pieces(batch.slice(0, 0), 100)) == []


def test_all_phrases_are_counted_without_sending_them(spark):
    """What goes to buckets is less than the comments, equal windows of a block go once, and counts are those of plain Python."""
    r = random.Random(11)
    rows = [(" ".join(r.choice(["a", "bb", "c", f"w{r.randint(0, 40)}"]) for _ in range(r.randint(0, 25))), r.choice([True, False, None])) for _ in range(150)]
    rows += [(None, True), ("", False), ("  b  b ", None), ("x x x x x x x x x x x x x", True)] + [("the same comment again and again and again in every copy", False)] * 50
    for least, most, block in ((1, 10, 1 << 20), (1, 10, 300), (2, 3, 2000), (1, 1, 2000), (3, 4, 2000)):
        want = {}
        for text, flag in rows:
            words = [w for w in (text or "").split(" ") if w]
            for p in {" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)}:
                was = want.get(p, (0, None))
                want[p] = (was[0] + 1, was[1] if flag is None else (was[1] or 0) + flag)
        got = keywords.phrase_counts(spark.createDataFrame(rows, "cleaned string, flag boolean").repartition(3), ["flag"], least, most, block).collect()
        assert {x[0]: (x[1], x[2]) for x in got} == want and len(got) == len(want)
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for t, _ in rows]), pa.array([1] * len(rows))], ["cleaned", "total"])
    sent = list(keywords._windows(batch, 1, 10, 2))
    copies = keywords._windows(batch.slice(len(rows) - 50), 1, 10, 2)
    assert sum(len(p[2]) + len(p[4]) + len(p[5]) for p in sent) < 2 * sum(len(t or "") for t, _ in rows) and sum(p[1] for p in copies) <= 2 * 11


def test_buckets_do_not_multiply_what_is_sent():
    """With a hundred times the buckets a word's spelling used to go to each of them, now frequent words have numbers; other words and all counts stay."""
    r = random.Random(2)
    known = [f"word{k}" for k in range(300)]
    rows = [" ".join(r.choice(known) if r.random() < 0.97 else f"rare{r.randint(0, 10**6)}" for _ in range(40)) for _ in range(300)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([1] * len(rows))], ["cleaned", "total"])
    size = lambda pieces: sum(len(p[2]) + len(p[4]) + len(p[5]) for p in pieces)
    want = {}
    for t in rows:
        words = (t or "").split()
        for p in {" ".join(words[i : i + n]) for n in range(1, 11) for i in range(len(words) - n + 1)}:
            want[p] = want.get(p, 0) + 1
    for listed in (None, pa.array(known), pa.array(["word5", "absent"]), pa.array([*known, *(f"rare{k}" for k in range(10**5))])):
        few, many = (list(keywords._windows(batch, 1, 10, n, listed)) for n in (3, 300))
        assert listed is None or len(listed) == 2 or size(many) < 1.6 * size(few)
        got = {}
        for bucket in {p[0] for p in many}:
            for phrases, sums in keywords._counted([p[1:] for p in many if p[0] == bucket], 1, 10, 1, listed):
                got.update(zip(phrases.to_pylist(), sums[0].tolist()))
        assert got == want
    assert listed is not None and not {w for p in few for w in pa.decompress(p[2], p[3], codec="zstd", asbytes=True).decode().split()} & set(known)


def test_texts_without_labels_are_not_moved(spark, tmp_path):
    """Before the join with labels most of them are left out, and none that is wanted; keys of any kind, nulls and empty tables do no harm."""
    rows = spark.createDataFrame([(k if k else None, f"t{k}") for k in range(3000)], "k long, text string").repartition(3)
    other = spark.createDataFrame([(k if k % 10 else None,) for k in range(0, 4000, 7)], "k long")
    got = {r.k for r in keywords.held_by(rows, other, "k").collect()}
    want = {k for k in range(3000) if k % 7 == 0 and k % 10}
    assert want <= got and len(got) < len(want) + 5
    assert len(keywords.held_by(rows, other, "k", 8).join(other, "k").collect()) == len(want)
    assert keywords.held_by(rows, other.limit(0), "k").collect() == keywords.held_by(rows.limit(0), other, "k").collect() == []
    spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, 1) for k in range(0, 100, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plan = mining._comments(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [doc_id" in plan and "MapInArrow" in plan[plan.index("SortMergeJoin") :] and mining._comments(spark, str(tmp_path)).count() == 20


def test_words_are_listed_from_a_part_of_the_comments(spark):
    rows = spark.createDataFrame([("a a b",), ("b c  a",), (None,), ("",), ("d " * 50,)], "cleaned string").coalesce(1)
    assert keywords._frequent_words(rows, 1 << 20, 2).to_pylist() == ["d", "a"] and keywords._frequent_words(rows, 5, 9).to_pylist() == ["a", "b"]
    assert keywords._frequent_words(rows.limit(0), 5, 9).to_pylist() == []


def test_later_levels_read_what_longer_phrases_can_hold(spark, monkeypatch):
    """Comments are trimmed once, words that others were between do not become neighbours, and counts stay those of everything."""
    r = random.Random(5)
    rows = [(" ".join(["one two three four five", "a b c d", "b c d e", f"u{k}  v{k}"][r.randint(0, 3)] if r.random() < 0.7 else f"z{r.randint(0, 3)}" for _ in range(9)), k % 2 == 0) for k in range(60)] + [(None, True), ("", True)]
    comments, kept = spark.createDataFrame(rows, "cleaned string, flag boolean").repartition(2), []
    trim = keywords._trimmed
    monkeypatch.setattr(keywords, "_trimmed", lambda *x: kept.append(trim(*x)) or kept[-1])
    got = list(map(tuple, keywords.frequent_phrases(comments, ["flag"], 3, 10).collect()))
    want = {tuple(x) for x in keywords.phrase_counts(comments, ["flag"]).filter("total >= 3").collect()}
    assert set(got) == want and len(got) == len(want) and max(len(p.split()) for p, *_ in got) > 4
    assert len(kept) == 1 and not any(w[:1] in ("u", "v") for x in kept[0].collect() for w in x.cleaned.split())


def test_cleaning_looks_for_links_where_they_can_begin(spark):
    """Against the patterns as they are stated; a long run of letters no longer takes time by its square."""
    from tidewater.functions import text

    r = random.Random(3)
    parts = ["a.bc", ".", "..", "http://", "www.", "x", " ", "<", '"', ".com", "1", "é", "😀", "nova", "ci", "CI", "verified", "ſ", "code-review+2", "-", ",", "\u00a0", "patch set 3:", "(2 comments)", "İ", "K"]
    rows = [("".join(r.choice(parts) for _ in range(r.randint(0, 14))),) for _ in range(3000)] + [("y" * 60000,)]
    df = spark.createDataFrame(rows, "c string")
    plain = F.lower("c")
    for p in ("(?U)" + text.LINKS, "(?U)" + text.PATCH_SET, "(?U)" + text.INLINE, "(?iU)" + text.alternation(mining.LABELS), text.SYMBOLS, "(?U)" + text.PROJECTS, " +"):
        plain = F.regexp_replace(plain, p, " ")
    assert df.filter("length(c) < 1000").filter(text.clean_comment("c", mining.LABELS) != F.trim(plain)).count() == 0
    assert "(?<![^" in text._links() and df.filter(F.length(text.clean_comment("c", mining.LABELS)) == 60000).count() == 1
