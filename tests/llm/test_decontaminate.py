import random
import re

import pytest

from tidewater.llm import decontaminate

DOCS = "doc_id long, text string, n_words string, spans int, items string, `a b` int"
ITEMS = "item_id string, text string, size int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y", 1) for i, t in rows], DOCS).repartition(3)


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], ITEMS).repartition(2)


def plain(rows, items, size=10):
    out = []
    for i, text in rows:
        w, hit, named = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(size, len(v))
            for k in range(max(len(v) - size, 0) + 1 if v and item is not None else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        named.add(item)
        spans = [(p, next(q for q in range(p, len(w) + 1) if q not in hit)) for p in sorted(hit) if p - 1 not in hit]
        out.append((i, len(w), spans, sorted(named)))
    return sorted(out, key=str)


def found(spark, rows, items, **options):
    out = decontaminate.overlaps(docs(spark, rows), bench(spark, items), **options).collect()
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], list(r["items"])) for r in out), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["a", "bb", "Ünï", "word9", "漢字", "verylongwordindeed", "x"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", say(r.choice([1, 3, 9, 10, 11, 25, 40]) if k else 12)) for k in range(8)] + [("i3", say(14)), ("none", " .,"), ("null", None), (None, say(10))]
    rows = [(k, say(r.randrange(60))) for k in range(60)]
    for k in range(0, 60, 4):
        item = words(items[r.randrange(8)][1])
        rows[k] = (k, f"{say(5)}, {'. '.join(item).upper()}! {say(4)} {'-'.join(item[:9])} ? {say(2)}")
    return rows, items


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_against_loops(spark, most):
    for seed in (1, 2):
        rows, items = corpus(seed)
        assert found(spark, rows, items, most=most) == plain(rows, items)


def test_sizes_of_windows(spark):
    rows, items = corpus(3)
    assert found(spark, rows, items, size=4) == plain(rows, items, 4)
    assert found(spark, rows, items, size=1) == plain(rows, items, 1)


@pytest.mark.parametrize("most", [1 << 20, 2])
def test_odd_rows(spark, most):
    rows = [(1, None), (2, ""), (3, "..."), (None, "a b c"), (4, "a b c"), (4, "a b c"), (4, "c b a")]
    items = [("p", "A b"), ("q", "c"), ("p", "b a")]
    want = [(None, 3, [(0, 3)], ["p", "q"]), (1, 0, [], []), (2, 0, [], []), (3, 0, [], []), (4, 3, [(0, 3)], ["p", "q"]), (4, 3, [(0, 3)], ["p", "q"]), (4, 3, [(0, 3)], ["p", "q"])]
    assert found(spark, rows, items, most=most) == sorted(want, key=str) == plain(rows, items)
    assert found(spark, rows, [], most=most) == plain(rows, [])
    assert found(spark, [], items, most=most) == []


def test_long_text_and_windows_at_edges_of_rows(spark):
    long = " ".join(["lorem", "ipsum"] * 400_000)
    item = "p q r s t u v w x y"
    rows = [(1, long + " " + item + " " + long), (2, "p q r s t"), (3, "u v w x y"), (4, item), (5, item + " z"), (6, "o" * 3_000_000)]
    out = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans]) for r in decontaminate.overlaps(docs(spark, rows).coalesce(1), bench(spark, [("i", item)])).collect()}
    assert out == {1: (1_600_010, [(800_000, 800_010)]), 2: (5, []), 3: (5, []), 4: (10, [(0, 10)]), 5: (11, [(0, 10)]), 6: (1, [])}


def test_removal_keeps_columns_and_clean_texts(spark):
    rows = [(1, "Keep this, p Q r. And that"), (2, "no\n  hit "), (3, None), (4, "p q r"), (5, "é p q r ü p q r"), (None, "x p q r")]
    items = [("i", "P q; r")]
    table = docs(spark, rows)
    out = decontaminate.decontaminated(table, bench(spark, items))
    assert out.schema == table.schema
    got = {r.doc_id: r for r in out.collect()}
    assert {k: r.text for k, r in got.items()} == {1: "Keep this, . And that", 2: "no\n  hit ", 3: None, 4: "", 5: "é  ü ", None: "x "}
    assert all(r["a b"] == 1 and r.n_words == "x" and r.spans == 7 and r["items"] == "y" for r in got.values())
    kept = decontaminate.decontaminated(table, bench(spark, items), "documents")
    assert kept.schema == table.schema
    assert {r.doc_id: r.text for r in kept.collect()} == {2: "no\n  hit ", 3: None}
    assert {r.doc_id for r in decontaminate.decontaminated(table, bench(spark, items), "documents", share=0.5).collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        decontaminate.decontaminated(table, bench(spark, items), "all")
