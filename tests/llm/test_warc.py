import base64
import gzip
import hashlib
import io

import pytest

from tidewater.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, record_type int"


def brute(rows, least=0):
    body = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, b in body:
        ids = [q for q, c in body if c == b and q is not None]
        first = min(ids) if ids and len(b) >= least else None
        revisit = first is not None and first != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def made():
    texts = [None, "", "é漢😀", "WARC/1.1\r\n\r\n", "x" * 300_000, "a\nb"]
    rows = [(k, f"http://h/{k}", texts[k % 6]) for k in range(60)]
    return rows + [(7, "http://again", "other"), (7, "http://again", "other"), (None, None, "lonely"), (None, "u", "a\nb"), (100, "bad\r\nurl", "one"), (-5, None, "one")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*r, "no", 1) for r in made()], SCHEMA).repartition(3)
    out = warc.archive_round_trip(df, least)
    got = sorted((tuple(r) for r in out.drop("url").collect()), key=str)
    assert got == brute(made(), least)
    assert {r.url for r in out.filter("page_id = 100").collect()} == {"bad%0D%0Aurl"}


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_roll_and_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame([(*r, "no", 1) for r in made()], SCHEMA).coalesce(1)
    manifest = warc.write_archives(df, f"file://{tmp_path}/w", archive_bytes=2000)
    paths = [r.path for r in manifest.collect()]
    assert len(paths) > 3 and manifest.agg({"n_records": "sum"}).first()[0] == len(made())
    text = gzip.decompress(open(paths[0], "rb").read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert sum(1 for p in paths for _ in warc.records(io.BytesIO(open(p, "rb").read()))) == len(made())


def test_records_have_dates_ids_of_their_own_and_name_a_response(spark, tmp_path):
    df = spark.createDataFrame([(*r, "no", 1) for r in made()], SCHEMA)
    paths = [r.path for r in warc.write_archives(df, f"file://{tmp_path}/w", date="2020-01-02T03:04:05Z").collect()]
    heads = [h for p in paths for h, _ in warc.records(io.BytesIO(open(p, "rb").read()))]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(ids) == len(made()) and {h["warc-date"] for h in heads} == {"2020-01-02T03:04:05Z"}
    response = {h["warc-record-id"]: h["warc-payload-digest"] for h in heads if h["warc-type"] == "response"}
    assert all(response[h["warc-refers-to"]] == h["warc-payload-digest"] for h in heads if h["warc-type"] == "revisit")


def test_partitions_that_change_are_an_error(spark, tmp_path):
    seen = []
    df = spark.createDataFrame([(*r, "no", 1) for r in made()], SCHEMA).coalesce(2)
    other = spark.createDataFrame([(9, "u", "not seen before", "no", 1)], SCHEMA)
    read = warc.payloads
    try:
        warc.payloads = lambda pages: seen.append(1) or read(pages if len(seen) == 1 else pages.union(other))
        with pytest.raises(Exception, match="changed between two readings"):
            warc.write_archives(df, f"file://{tmp_path}/w")
    finally:
        warc.payloads = read


def test_shuffles_hold_no_payload(spark):
    df = spark.createDataFrame([(1, "u", "x", "p", 1)], SCHEMA)
    plan = warc.originals(df)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("payload" in x or "html" in x for x in exchanges)
