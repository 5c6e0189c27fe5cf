"""Hand-made cases for the semantics that are easy to get wrong."""

import datetime as dt
import hashlib
import itertools
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewater.functions import math, text, time
from tidewater.operators import asof, changes, cohorts, dataset, distribution, drift, history, identity, keywords, lifetime, metrics, quantiles, releases, requests, revisions
from tidewater.sources import ingest, readers, sinks

T = dt.datetime


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("2015-01-02 03:04:05.123456789", T(2015, 1, 2, 3, 4, 5, 123456)), ("2015-01-02T03:04:05Z", T(2015, 1, 2, 3, 4, 5)), ("2015-01-02T03:04:05+09:00", T(2015, 1, 2, 3, 4, 5)), ("garbage", None), ("2015-01-02", T(2015, 1, 2))],
)
def test_parse(spark, given, want):
    assert one(spark, time.parse("v"), v=given) == want


def test_units(spark):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2015-01-01", "2015-01-02"))
    assert one(spark, time.between(a, b, "days")) == 1.0
    assert one(spark, time.label_value(a, b, "fortnights")) == 24.0
    with pytest.raises(ValueError):
        time.between(a, b, "fortnights")
    assert one(spark, time.elapsed_minutes(b, a)) == -1.0
    assert one(spark, time.relative_x(a, b, b)) == 0.0
    assert one(spark, time.bin_index(a, b, b + F.expr("interval 6 days"), 6)) == -1


def test_active_days_borders(spark):
    rows = [(1, T(2020, 1, 3), None), (2, T(2020, 1, 1), T(2020, 1, 3)), (3, T(2020, 1, 1), None), (4, T(2020, 1, 1, 0, 0, 1), None), (5, T(2020, 1, 2, 12), T(2020, 1, 2, 13)), (6, None, None)]
    df = spark.createDataFrame(rows, "id long, created timestamp_ntz, decision_time timestamp_ntz")
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2020-01-01 12:00:00", "2020-01-04"))
    got = sorted((r.id, r.t.day) for r in changes.active_days(df, start, end, 2).collect())
    want = sorted((i, t.day) for i, c, d in rows if c for t in (T(2020, 1, 2), T(2020, 1, 3), T(2020, 1, 4)) if t - dt.timedelta(2) <= c <= t and (d is None or t < d))
    assert got == want
    assert {r.id for r in changes.active_days(df, start, end, None, undecided=False).collect()} == {2}


def test_next_after_is_strict(spark):
    probes = spark.createDataFrame([(1, T(2020, 1, 1)), (1, T(2020, 1, 2)), (2, T(2020, 1, 1))], "k long, t timestamp_ntz")
    events = spark.createDataFrame([(1, T(2020, 1, 1)), (1, T(2020, 1, 2)), (1, T(2020, 1, 2))], "k long, at timestamp_ntz")
    got = {(r.k, r.t): r.n for r in asof.next_after(probes, events, "k", "t", "at", "n").collect()}
    assert got == {(1, T(2020, 1, 1)): T(2020, 1, 2), (1, T(2020, 1, 2)): None, (2, T(2020, 1, 1)): None}


def test_revision_in_force(spark):
    probes = spark.createDataFrame([(1, T(2020, 1, 2)), (1, T(2019, 1, 1))], "change_number long, t timestamp_ntz")
    revs = spark.createDataFrame([(1, T(2020, 1, 2), 1, "a"), (1, T(2020, 1, 2), 2, "b"), (1, T(2020, 1, 3), 3, "c")], "change_number long, created timestamp_ntz, number int, files string")
    got = {r.t.year: r.files for r in revisions.state_at(probes, revs, ["files"]).collect()}
    assert got == {2020: "b", 2019: None}


def person(i=None, n="", u="", e=""):
    return (i, n, u, e)


def test_humans(spark):
    who = "struct<_account_id: bigint, name: string, username: string, email: string>"
    rows = [
        (1, person(1, "Ann"), person(9), "autogenerated:x"), (2, person(2, "CI Bot"), person(9), None), (3, person(9), person(9, "Other"), None), (4, person(None, "", "", "a@b"), person(5, "", "", "a@b"), None),
        (5, person(None, "", "", ""), person(None, "", "", ""), None), (6, person(6, "Bob"), person(7, "bob"), "other"),
    ]
    df = spark.createDataFrame(rows, f"id int, author {who}, owner {who}, tag string")
    assert {r.id for r in identity.human_messages(df, ["ci bot"]).collect()} == {5, 6}
    bots = spark.createDataFrame([("ci bot",)], "identity string")
    assert {r.id for r in identity.without_bots(df, bots, identity.identities(F.col("author"))).collect()} == {1, 3, 4, 5, 6}


def test_cycles_and_majors(spark):
    rows = [("p", "12.0.0", T(2015, 1, 1)), ("p", "2010.1", T(2015, 3, 1)), ("p", "13.0.0", T(2015, 6, 1)), ("p", "13.0.1", T(2015, 6, 1)), ("p", "13.0.0.0rc1", T(2015, 5, 1)), ("p", "12.5.0", T(2015, 7, 1)), ("p", "15.0.0", T(2016, 1, 1)), ("p", "14.0.0", T(2016, 6, 1))]
    df = spark.createDataFrame(rows, "project string, version string, release_date timestamp_ntz")
    got = {r.version: r.cycle_start for r in releases.cycles(df).collect()}
    assert "12.0.0" not in got
    assert got["2010.1"] == T(2015, 1, 1) and got["13.0.0.0rc1"] == T(2015, 1, 1) and got["13.0.0"] == T(2015, 5, 1) and got["13.0.1"] == T(2015, 5, 1)
    probes = spark.createDataFrame([("p", T(2015, 1, 1)), ("p", T(2015, 5, 31)), ("p", T(2016, 1, 1)), ("p", T(2016, 7, 1)), ("q", T(2015, 1, 1))], "component string, t timestamp_ntz")
    got = {(r.component, r.t): r.days_to_major for r in releases.days_to_major(probes, releases.of_component(df, "p")).collect()}
    assert got[("p", T(2015, 1, 1))] == 151.0 and got[("p", T(2015, 5, 31))] == 1.0 and got[("p", T(2016, 1, 1))] == -1.0 and got[("q", T(2015, 1, 1))] == -1.0


def test_increments_against_the_loop(spark):
    r = random.Random(1)
    for case in range(3):
        rows = [("p", f"{r.randint(1, 6)}.0.0", T(2020, 1, 1) + dt.timedelta(r.randint(0, 9))) for _ in range(8)]
        df = spark.createDataFrame(rows, "component string, version string, release_date timestamp_ntz")
        probes = [T(2020, 1, 1) + dt.timedelta(k) for k in range(-1, 11)]
        got = {x.t: x.days_to_major for x in releases.days_to_major(spark.createDataFrame([("p", t) for t in probes], "component string, t timestamp_ntz"), df).collect()}
        ordered = sorted((d, int(v.split(".")[0])) for _, v, d in rows)
        for t in probes:
            base = ([m for d, m in ordered if d <= t] or [-1])[-1]
            want = -1.0
            for d, m in ordered:
                if d > t:
                    if m > base:
                        want = (d - t).total_seconds() / 86400
                        break
                    base = m
            assert got[t] == want, (case, t)


@pytest.mark.parametrize(
    ("subject", "message", "bug", "refactor", "test"),
    [
        ("Closes-Bug: #123", None, 1, 0, 0), ("bug 42", "", 2, 0, 0), ("see [7]", "", 1, 0, 0), ("prefix fixture", "", 0, 0, 0), ("12.3/4", "", 1, 0, 0), ("", None, 0, 0, 0), (None, "12", 1, 0, 0), ("simplified", "", 0, 0, 0),
        ("simplify", "", 0, 1, 0), ("move", "", 0, 1, 0), ("code   cleanup", "", 0, 1, 0), ("the latest", "", 0, 0, 1), ("Fix", "", 1, 1, 0), ("[12]", "", 2, 0, 0),
    ],
)
def test_text_scores(spark, subject, message, bug, refactor, test):
    got = spark.createDataFrame([(subject, message)], "s string, m string").select(text.bug_fix_confidence("s", "m"), text.refactoring_confidence("s", "m"), text.mentions_test("s", "m")).first()
    assert tuple(got) == (bug, refactor, test)


def test_comments(spark):
    cleaned = lambda v, labels=None: one(spark, text.clean_comment(F.col("v"), labels), v=v)
    assert cleaned("Patch Set 3: See https://a.b/c?d and host.example.org (2 inline comments), Nova!") == "see and"
    assert cleaned("Code-Review+2 ok", ["Code-Review+2"]) == "2 ok" or cleaned("Code-Review+2 ok", ["Code-Review+2"]) == "ok"
    words = F.split(F.lit("a b c"), " ")
    assert one(spark, text.ngrams(words, 1, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, text.ngrams(F.array().cast("array<string>"), 1, 2)) == []
    df = spark.createDataFrame([("good",), ("looks good",), ("looks good to me",), ("goo d",)], "phrase string")
    assert {r.phrase for r in keywords.without_longer(df).collect()} == {"good", "goo d"}
    assert [one(spark, text.language_of(F.lit(p))) for p in ("a/b.py", "x.js", "x.md", "Makefile", "a.b/c", "r")] == ["Python", "JavaScript", None, None, None, None]
    assert [one(spark, text.flag(F.lit(p))) for p in ("1", " 1.0 ", "0", "")] == [True, True, False, False]


def test_antichain_against_all_pairs(spark):
    r = random.Random(2)
    phrases = {"".join(r.choice("ab ") for _ in range(r.randint(1, 7))).strip() or "a" for _ in range(60)}
    got = {x.phrase for x in keywords.without_longer(spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    assert got == {p for p in phrases if not any(q != p and q in p for q in phrases)}


def test_antichain_of_thousands_of_phrases(spark):
    """5000 phrases of words, most of which begin alike; no key of a join is more than one phrase."""
    r = random.Random(3)
    words = ["the", "then", "other", "fix", "fixes", *(f"w{k}" for k in range(400))]
    phrases = {" ".join(["the"] * r.randint(0, 1) + [r.choice(words) for _ in range(r.randint(1, 5))]) for _ in range(5200)}
    out = [x.phrase for x in keywords.without_longer(spark.createDataFrame([(p,) for p in phrases] * 2, "phrase string")).collect()]
    short = sorted(phrases, key=len)
    least = []
    for p in short:
        if not any(q in p for q in least):
            least.append(p)
    assert len(phrases) > 4500 and sorted(out) == sorted(least)
    assert keywords.without_longer(spark.createDataFrame([(None,)], "phrase string")).collect() == []


@pytest.mark.parametrize("most", [1 << 22, 40_000])
def test_thousands_of_phrases_in_comments(spark, most):
    """5000 phrases that overlap, against plain search, in one automaton and in several."""
    r = random.Random(11)
    phrases = [(r.choice("abc"), "".join(r.choice("xyz ") for _ in range(r.randint(4, 30)))) for _ in range(5000)] + [("d", "xx"), ("e", "ü"), (None, "x"), ("a", None)]
    texts = [(k, "".join(r.choice("xyz ") for _ in range(r.randint(0, 300)))) for k in range(60)] + [(90, None), (91, ""), (92, "fü")]
    df = spark.createDataFrame(texts, "id long, cleaned string").withColumn("kind", F.lit(1))
    out = {x.id: x.kinds for x in keywords.kinds_found(df.repartition(3), spark.createDataFrame(phrases, "kind string, phrase string"), most=most).collect()}
    assert out == {k: sorted({kind for kind, p in phrases if kind and p is not None and t is not None and p in t}) for k, t in texts}
    assert {x.id: x.kinds for x in keywords.kinds_found(df, spark.createDataFrame([("z", "")], "kind string, phrase string")).collect()} == {k: [] if t is None else ["z"] for k, t in texts}
    assert keywords.kinds_found(df.limit(3), spark.createDataFrame([], "kind string, phrase string")).filter("size(kinds) > 0").collect() == []


def test_outliers(spark):
    rows = [("few", 1, 1.0), ("few", 2, 2.0), ("few", 3, 999.0)] + [("many", k, float(v)) for k, v in enumerate((1, 2, 3, 4, 5.5, 100))]
    df = spark.createDataFrame(rows, "g string, decision_time long, screening double")
    kept = lambda **kw: {(r.g, r.screening) for r in distribution.drop_outliers(df, ["g"], **kw).collect()}
    assert ("few", 999.0) in kept() and ("many", 100.0) not in kept() and ("many", 5.5) in kept()
    assert len(kept(method="none")) == 9
    with pytest.raises(ValueError):
        distribution.drop_outliers(df, ["g"], "other")


def test_histogram(spark):
    make = lambda vs, **kw: [(r.bin, r["count"]) for r in lifetime.histogram(spark.createDataFrame([("g", float(v)) for v in vs], "g string, value double"), ["g"], 4, **kw).orderBy("bin").collect()]
    assert sum(n for _, n in make([5])) == 1 and sum(n for _, n in make([2, 2, 2])) == 3
    assert make([1, 10, 100, 1000, 10000]) == [(0, 1), (1, 1), (2, 1), (3, 2)]
    assert sum(n for _, n in make([1, 10, 100], min_value=5.0)) == 2
    assert make([0, 1, 2, 3, 4], log_bins=False) == [(0, 1), (1, 1), (2, 1), (3, 2)]


def test_wait_class(spark):
    assert [one(spark, math.wait_class(F.lit(float(v)))) for v in (0, 23.9, 24, 168, 720, 1e6)] == [0, 0, 1, 2, 3, 3]
    assert [one(spark, math.layer_quota(F.lit(5.0), F.lit(a), F.lit(b))) for a, b in ((1, 1), (7, 3))] == [2, 4]


def test_request_states_against_the_loop(spark):
    r = random.Random(3)
    messages, revs, want = [], [], {}
    for key in range(40):
        events = sorted(((r.randint(0, 6), r.choice("mv"), r.random() < 0.5, r.random() < 0.4) for _ in range(r.randint(1, 9))), key=lambda e: (e[0], e[1]))
        pending, last, asked, done = [], None, 0, 0
        for t, kind, is_request, is_confirmation in events:
            at = T(2020, 1, 1) + dt.timedelta(t)
            if kind == "v":
                last = t
                revs.append((key, at))
                continue
            messages.append((key, at, is_request, is_confirmation))
            if is_confirmation and last is not None:
                done += sum(p < last for p in pending)
                pending = [p for p in pending if p >= last]
            if is_request:
                asked += 1
                pending.append(t)
        if asked:
            want[key] = (len(pending), done)
    m = spark.createDataFrame(messages, "change_number long, ts timestamp_ntz, is_request boolean, is_confirmation boolean")
    v = spark.createDataFrame(revs, "change_number long, ts timestamp_ntz")
    assert {x.change_number: (x.n_open, x.n_done) for x in requests.open_requests(m, v).collect()} == want
    assert requests.open_requests(m, v, "2019-01-01").collect() == []


def test_history_against_the_loop(spark):
    r = random.Random(4)
    day = lambda: T(2020, 1, 1) + dt.timedelta(hours=6 * r.randint(0, 60))
    events = [(r.randint(0, 2), day(), day() if r.random() < 0.6 else None) for _ in range(60)]
    probes = [(k, day()) for k in (0, 1, 2, 3) for _ in range(10)]
    e = spark.createDataFrame(events, "owner_id long, created timestamp_ntz, merged timestamp_ntz")
    p = spark.createDataFrame(probes, "owner_id long, t timestamp_ntz")
    for x in history.developer_history(p, e, "owner_id", 5).collect():
        mine = [(c, m) for o, c, m in events if o == x.owner_id]
        past = sum(c <= x.t for c, _ in mine)
        recent = [(c, m) for c, m in mine if x.t - dt.timedelta(5) <= c <= x.t]
        merged = sum(m is not None and m <= x.t for _, m in mine)
        both = sum(m is not None and m <= x.t for _, m in recent)
        assert (x.past_reports, x.recent_reports) == (past, len(recent))
        assert x.merge_rate == pytest.approx(merged / past if past else 0) and x.recent_merge_rate == pytest.approx(both / len(recent) if recent else 0)


def test_history_of_a_hot_owner_within_days_and_after_the_last_event(spark):
    """One owner has a third of all changes, events fall at any instant, and probes go on after the last one."""
    r = random.Random(6)
    at = lambda: T(2020, 1, 1) + dt.timedelta(seconds=r.randint(0, 60 * 86400))
    events = [(0 if k % 3 == 0 else k % 40, at(), None if k % 4 == 0 else at(), r.randint(0, 9)) for k in range(600)]
    probes = [(k, t) for k in (0, 1, 2, 77) for t in [T(2019, 12, 1), T(2020, 6, 1), *(T(2020, 1, 1) + dt.timedelta(d) for d in range(0, 80, 9)), *(e[1] for e in events[:30]), *(e[1] + dt.timedelta(14) for e in events[:30])]]
    e = spark.createDataFrame(events, "owner_id long, created timestamp_ntz, merged timestamp_ntz, lines long")
    p = spark.createDataFrame(probes, "owner_id long, t timestamp_ntz")
    rows = history.developer_history(p, e, "owner_id", 14).collect()
    assert len(rows) == len(set(probes))
    for x in rows:
        mine = [(c, m) for o, c, m, _ in events if o == x.owner_id]
        recent = [m for c, m in mine if x.t - dt.timedelta(14) <= c <= x.t]
        past, done, both = sum(c <= x.t for c, _ in mine), sum(m is not None and m <= x.t for _, m in mine), sum(m is not None and m <= x.t for m in recent)
        assert (x.past_reports, x.recent_reports) == (past, len(recent)) and x.merge_rate == pytest.approx(done / past if past else 0) and x.recent_merge_rate == pytest.approx(both / len(recent) if recent else 0)
    changed = e.withColumnsRenamed({"merged": "decision_time"}).withColumn("updated", F.col("created"))
    for x in history.open_count(changed, p).collect():
        assert x.n_open == sum(c <= x.t for _, c, _, _ in events) - sum(m is not None and m <= x.t for _, _, m, _ in events)
    for x in history.lines_in_period(changed, p, 14).collect():
        assert x.reviewed_lines == sum(n for _, c, _, n in events if x.t - dt.timedelta(14) <= c <= x.t)


def test_step_functions_split_owners_by_time(spark):
    """No window is over a key alone but those of blocks; deltas of one instant are combined."""
    e = spark.createDataFrame([(1, T(2020, 1, 1), None)], "owner_id long, created timestamp_ntz, merged timestamp_ntz")
    plan = history.developer_history(e.select("owner_id", F.col("created").alias("t")), e)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("_block" in w for w in windows)


def test_open_count_and_lines_as_reported_once(spark):
    late = spark.createDataFrame([(1, T(2020, 1, 1), None), (2, T(2020, 1, 2), None), (3, T(2020, 1, 1), T(2020, 1, 3))], "change_number long, created timestamp_ntz, decision_time timestamp_ntz")
    four_weeks = spark.createDataFrame([(T(2020, 1, 31),)], "t timestamp_ntz")
    assert [r.n_open for r in history.open_count(late, four_weeks).collect()] == [2]
    updates = spark.createDataFrame([(T(2020, 1, 1, 23), 5), (T(2020, 1, 2), 1)], "updated timestamp_ntz, lines long")
    assert [r.reviewed_lines for r in history.lines_in_period(updates, spark.createDataFrame([(T(2020, 1, 16),)], "t timestamp_ntz")).collect()] == [1]


def test_quantiles_against_sorting(spark):
    """A group with most rows, ties, one value, nulls, values far apart, a null key."""
    r = random.Random(8)
    rows = [("hot", r.gauss(1e6, 1)) for _ in range(3000)] + [("ties", float(r.randint(0, 3))) for _ in range(500)] + [("one", -2.5), ("none", None), (None, 1.0), (None, 4.0), ("wide", -1e300), ("wide", 0.0), ("wide", 1e-300)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    percents = [0.0, 1.0, 25.0, 50.0, 90.0, 99.9, 100.0]
    counts = quantiles.counted(df, ["g"], "value")
    told = {x.g: x for x in quantiles.described(counts, ["g"], percents).collect()}
    assert set(told) == {"hot", "ties", "one", "wide", None} and {x.g: x.quantiles for x in quantiles.select(counts, ["g"], percents).collect()} == {g: x.quantiles for g, x in told.items()}
    for g, x in told.items():
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert x.n == len(own) and x.min == own[0] and x.max == own[-1]
        if g != "wide":
            assert x.mean == pytest.approx(statistics.fmean(own), rel=1e-12) and x.std == pytest.approx(statistics.pstdev(own), abs=1e-9)
        for p, q in zip(percents, x.quantiles):
            k = (len(own) - 1) * p / 100
            low, high = own[int(k)], own[min(int(k) + 1, len(own) - 1)]
            assert q == pytest.approx(low + (high - low) * (k - int(k)) if k > int(k) else low, rel=1e-12)
    ranks = quantiles.below(counts, ["g"]).collect()
    assert all(x.below == sum(v is not None and v < x.value for k, v in rows if k == x.g) for x in ranks[::7])
    assert quantiles.select(quantiles.counted(df.limit(0), ["g"], "value"), ["g"], percents).collect() == []


def test_exact_p_values_against_enumeration():
    known = {(a, b, u): p for a, b, u, p in cohorts.exact_p_values(12)}
    for n in range(2, 13):
        for n1 in range(1, n):
            sums = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n + 1), n1)]
            for u in range(n1 * (n - n1) + 1):
                tail = min(sum(s <= u for s in sums), sum(s >= u for s in sums))
                assert known[(n1, n - n1, u)] == pytest.approx(min(1.0, 2 * tail / len(sums)))
            assert set(sums) == set(range(n1 * (n - n1) + 1))


def test_rank_test_is_exact_for_small_groups_without_ties(spark):
    rows = [("a", "x", 1.0), ("a", "x", 2.0), ("a", "x", 3.0), ("a", "y", 4.0), ("a", "y", 5.0), ("a", "y", None), ("t", "x", 1.0), ("t", "y", 1.0), ("t", "y", 2.0), ("e", "x", 1.0)]
    rows += [("big", "xy"[k % 2], float(k)) for k in range(40)]
    got = {r.g: r for r in cohorts.mann_whitney(spark.createDataFrame(rows, "g string, side string, value double"), ["g"], "side", "x", "y").collect()}
    assert (got["a"].n1, got["a"].n2, got["a"].u1, got["a"].median1, got["a"].mean2) == (3, 2, 0.0, 2.0, 4.5) and got["a"].p_value == pytest.approx(0.2)
    z = got["t"].z
    assert got["t"].p_value == pytest.approx(2 * (1 - statistics.NormalDist().cdf(abs(z))), abs=1e-6) and got["e"].p_value is None
    assert got["big"].p_value == pytest.approx(2 * (1 - statistics.NormalDist().cdf(abs(got["big"].z))), abs=1e-6) and got["big"].median1 == 19.0


def test_metrics(spark):
    rows = [(1, 1, 0, "a", k, float(y), float(z)) for k, (y, z) in enumerate([(1, 4), (2, 3), (3, 2), (4, 1)])] + [(1, 1, 0, "b", 9, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "d int, p int, repeat int, t string, change_id long, y_true double, y_pred double")
    got = metrics.rank_metrics(df).collect()
    assert len(got) == 1 and got[0].rank_mae == pytest.approx((1 + 1 / 3 + 1 / 3 + 1) / 4) and 0 < got[0].ndcg < 1
    flat = df.withColumn("y_true", F.lit(5.0))
    assert metrics.regression_metrics(flat).first().r2_log is None and metrics.class_metrics(flat).first().qwk is None
    assert metrics.class_metrics(df.withColumn("y_pred", F.col("y_true"))).first().micro_f1 == 1.0


def test_splits_do_not_leak(spark):
    r = random.Random(5)
    rows = [(k, r.choice((-1, 0, 1)), T(2020, 1, 1)) for k in range(120) for _ in range(3)]
    records = spark.createDataFrame(rows, "change_id long, bin int, t timestamp_ntz").distinct()
    pairs = spark.createDataFrame([(1, 1, -1, 0), (1, 2, 0, 1), (3, 1, -9, 0)], "d int, p int, i int, j int")
    layered = dataset.layers(records, pairs)
    chosen = dataset.split(layered, 40, 10, 2)
    counts = {(x.d, x.p, x.repeat, x.side): x.n for x in chosen.groupBy("d", "p", "repeat", "side").agg(F.countDistinct("change_id").alias("n")).collect()}
    assert counts == {(1, p, k, s): n for p in (1, 2) for k in (0, 1) for s, n in (("train", 40), ("eval", 10))}
    assert chosen.groupBy("d", "p", "repeat", "change_id").count().filter("count > 1").isEmpty()
    made = dataset.samples(records, chosen, pairs)
    assert made.filter("side = 'train' and bin != case p when 1 then -1 else 0 end").isEmpty()
    assert {round(x.w, 9) for x in made.filter("side = 'train'").groupBy("d", "p", "repeat", "change_id").agg(F.sum("weight").alias("w")).collect()} == {1.0}


def test_samples_by_bound_are_the_first_of_each_layer(spark):
    """Against sorting everything; with a slack so small that layers are taken whole; the window holds few rows."""
    r = random.Random(12)
    rows = [(d, 1, k, r.choice((1, 1, 1, 2, 3))) for d in (1, 2) for k in range(3000)]
    layered = spark.createDataFrame(rows, "d int, p int, change_id long, layer int")
    quota = {(x.d, x.p): x for x in dataset.quotas(layered, 40, 10).collect()}
    want = set()
    for d in (1, 2):
        q = quota[(d, 1)]
        for repeat in (0, 1):
            for layer in (1, 2, 3):
                order = sorted((hashlib.md5(f"{42 + repeat}-{k}".encode()).hexdigest(), k) for x, _, k, own in rows if (x, own) == (d, layer))
                cut, end = {1: (q.t1, q.t1), 2: (q.t2, q.t2 + q.e2), 3: (0, q.e3)}[layer]
                want |= {(d, 1, repeat, k, "train" if i < cut else "eval") for i, (_, k) in enumerate(order[:end])}
    for slack in (6.0, 1.0, 0.0):
        assert set(map(tuple, dataset.split(layered, 40, 10, 2, slack=slack).collect())) == want
    plan = dataset.split(layered, 40, 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_drift(spark):
    step = [("m", 1, p, v) for p, v in enumerate((0.1, 0.1, 0.1, 0.9, 0.9, 0.9), 1)] + [("m", 2, p, 0.5) for p in range(1, 7)] + [("m", 3, p, 0.5) for p in (1, 2)]
    s = drift.series(spark.createDataFrame(step, "metric string, d int, p int, value double"), ["metric", "d"])
    seen = {x.d: (round(x.statistic, 6), x.split) for x in drift.change_point(s, ["metric", "d"]).collect()}
    assert seen == {1: (0.8, 3), 2: (0.0, 1)}
    tests = {x.d: x.p_value for x in drift.permutation_test(s, ["metric", "d"], 200).collect()}
    assert tests[2] == 1.0 and tests[1] < 0.25


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    change = {"change_number": 1, "created": "2020-01-01 00:00:00.000000000", "revisions": {"r1": {"_number": 1, "files": {"a.py": {"lines_inserted": 3}}}, "r2": {"_number": 2, "files": {}}}, "comments": {"f": [{"id": "x"}, {"id": "y"}]}}
    (tmp_path / "in" / "change_1.json").write_text(json.dumps(change))
    (tmp_path / "in" / "change_2.json").write_text(json.dumps([{"change_number": 2}, {"change_number": 3}]))
    (tmp_path / "in" / "change_4.json").write_text("{broken")
    rows = readers.changes(spark, str(tmp_path / "in")).cache()
    assert {r.change_number for r in rows.collect()} == {1, 2, 3}
    assert {r.change_number: r.comments_count for r in ingest.flat_changes(rows).collect()} == {1: 2, 2: 0, 3: 0}
    made = ingest.flat_commits(ingest.commits(ingest.revision_scope(rows, "first"))).collect()
    assert [(r.revision_id, r.files_changed, r.lines_inserted, r.lines_deleted) for r in made] == [("r1", 1, 3, 0)]
    (tmp_path / "bots.ini").write_text("[other]\nbots = no\n[organization]\nname=x\nbots = CI Bot, Zuul ,\n")
    (tmp_path / "bots.csv").write_text("name,email\nJenkins,j@x\nname,other\n")
    (tmp_path / "extra.txt").write_text("# no\nExtra\n\n")
    bots = readers.all_bots(readers.bot_names(spark, str(tmp_path / "bots.ini")), readers.bot_accounts(spark, str(tmp_path / "bots.csv")), readers.extra_bots(spark, str(tmp_path / "extra.txt")))
    assert {r.identity for r in bots.collect()} == {"ci bot", "zuul", "jenkins", "j@x", "name", "other", "extra"}
    (tmp_path / "labels.json").write_text(json.dumps({"Code-Review": {"plus": ["+2"], "minus": ["-1"]}, "Verified": {"plus": ["v"]}}))
    assert {(r.label, r.role) for r in readers.review_labels(spark, str(tmp_path / "labels.json")).collect()} == {("+2", "confirmation"), ("-1", "request"), ("v", "strip")}
    (tmp_path / "releases.csv").write_text("project,version,release_date\np,1,2020-01-01\np,2,never\n")
    assert [r.version for r in readers.releases(spark, str(tmp_path / "releases.csv")).collect()] == ["1"]
    matrix = spark.createDataFrame([("m", 1, 1, 0.5, 0.1), ("m", 2, 2, None, None)], "metric string, d int, p int, value double, iqr double")
    assert {(r.d, r.p1, r.p2) for r in sinks.wide(matrix, 2).collect()} == {(1, 0.5, None), (2, None, None)}
    assert sinks.table(matrix.limit(0), str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    sinks.keywords(spark.createDataFrame([("request", "b"), ("request", "a")], "kind string, phrase string"), str(tmp_path / "k"))
    assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "k")).collect())) == {"request": ["a", "b"]}
    assert {r.phrase for r in readers.keywords(spark, str(tmp_path / "k"), {"request": "request"}).collect()} == {"a", "b"}
