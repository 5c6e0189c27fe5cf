"""Queries on what is written and read again, on who wrote what, and on nested change records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import math, text, time
from tidewater.operators import changes, dataset, drift, identity, keywords, lifetime, metrics, revisions
from tidewater.plans import analyses, mining
from tidewater.plans import standins as S
from tidewater.plans.activity import LIFE, pool, r6
from tidewater.plans.registry import query
from tidewater.sources import readers, sinks
from tidewater.sources.scratch import folder

# The same instant as it is found in landed files, or none: texts by o_orderkey mod 5.
CREATED = ["00:00:00.000000000", "00:00:00Z", "00:00:00+09:00", ""]


def _landed(spark, sf_dir):
    """Orders as landed JSON files of lists of change records (a list of at most 4000 keys), one file that can't be parsed among them."""
    o = S.changes(spark, sf_dir)
    day = F.date_format("created", "yyyy-MM-dd")
    how = F.col("change_number") % 5
    at = F.when(how == 4, "some day")
    for k, tail in enumerate(CREATED):
        at = F.when(how == k, F.concat(day, F.lit(("T" if k else " ") + tail if tail else ""))).otherwise(at)
    record = F.struct(
        "change_number", F.col("project"), "status", at.alias("created"), F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"), F.struct(F.col("owner_id").alias("_account_id")).alias("owner"),
        F.when(how > 0, how).cast("int").alias("insertions"),
    )
    path = folder(spark, "changes")
    lists = o.groupBy(F.floor(F.col("change_number") / 4000).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    lists.repartition("part").write.partitionBy("part").text(path)
    spark.range(1).select(F.lit('[{"change_number": 1, "created": ').alias("value"), F.lit(-1).alias("part")).write.mode("append").partitionBy("part").text(path)
    return path


@query(S.using("changes") + """ select owner_id, created, case status when 'MERGED' then updated end as merged, decision_time, updated,
(change_number % 5)::BIGINT as lines_added, 0::BIGINT as lines_deleted from changes where change_number % 5 <> 4""")  # fmt: skip
def landed_changes(spark, sf_dir):
    """Change records read from JSON files, times parsed, as the history that features are made of."""
    rows = readers.changes(spark, _landed(spark, sf_dir), glob="part-*")
    rows = rows.select(F.col("owner._account_id").alias("owner_id"), time.parse("created").alias("created"), time.parse("updated").alias("updated"), "status", "insertions", "deletions")
    return changes.history(rows).withColumns({c: F.col(c).cast("long") for c in ("lines_added", "lines_deleted")})


@query("""select o_orderpriority as project, o_orderkey::VARCHAR as version, o_orderdate as release_date,
(row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey))::INT as place from orders where o_orderkey % 7 <> 0""")  # fmt: skip
def landed_releases(spark, sf_dir):
    """Releases written sorted as CSV and read again, without those whose date can't be parsed; place counts from the newest."""
    from pyspark.sql import Window

    date = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    rows = S.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("component"), F.col("o_orderkey").cast("string").alias("version"), date.alias("release_date"))
    path = folder(spark, "releases")
    sinks.releases(rows, path)
    order = Window.partitionBy("project").orderBy(F.desc("release_date"), F.col("version").cast("long"))
    return readers.releases(spark, path).withColumn("place", F.row_number().over(order))


@query("""select o_orderpriority as component, o_orderkey::VARCHAR as version, o_orderdate as release_date, 'n/' || o_orderkey as release_notes_url
from orders where (o_orderpriority = '1-URGENT' and o_orderkey % 2 = 0) or (o_orderpriority = '5-LOW' and o_orderkey % 3 = 0)""")  # fmt: skip
def deliverables(spark, sf_dir):
    """Releases that list the wanted repository, from JSON documents of deliverables (a customer's orders)."""
    repos = F.array(*(F.when(F.col("o_orderkey") % k == 0, F.struct(F.lit(f"r{k}").alias("repo"))).otherwise(F.struct(F.lit("other").alias("repo"))) for k in (2, 3)))
    one = F.struct(F.col("o_orderkey").cast("string").alias("version"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("n/"), F.col("o_orderkey").cast("string")).alias("notes_url"), repos.alias("projects"))
    docs = S.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("component"), "o_custkey").agg(F.collect_list(one).alias("releases")).drop("o_custkey")
    path = folder(spark, "deliverables")
    sinks.table(docs, path, "json")
    wanted = spark.createDataFrame([("1-URGENT", "r2"), ("5-LOW", "r3"), ("none", "r2")], "component string, repo string")
    return readers.deliverables(spark, path, wanted)


MESSAGES = """m as (select l_orderkey as change_number, l_suppkey, l_shipdate as date, s_nationkey, o_custkey, l_returnflag from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey),
people as (select * from m where l_returnflag <> 'A' and s_nationkey % 5 <> 0 and l_suppkey % 10 not in (0, 1) and l_suppkey <> o_custkey)"""


def _messages(spark, sf_dir):
    """Shipments as messages of nested changes, by their suppliers; owners are customers. Half of the changes hold them as comments of files."""
    s = S.table(spark, sf_dir, "supplier").join(S.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = S.table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    person = lambda i, name, user: F.struct(i.alias("_account_id"), name.alias("name"), user.alias("username"), F.lit("").alias("email"))
    author = person(F.col("l_suppkey"), F.col("s_name"), F.col("n_name"))
    one = F.struct(author.alias("author"), F.col("l_shipdate").alias("date"), F.when(F.col("l_returnflag") == "A", "autogenerated:ci").alias("tag"))
    held = rows.groupBy(F.col("l_orderkey").alias("change_number")).agg(F.collect_list(one).alias("all"))
    owners = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number"), person(F.col("o_custkey"), F.lit(""), F.lit("")).alias("owner"))
    nested = held.join(owners, "change_number").withColumn("messages", F.when(F.col("change_number") % 2 == 0, F.col("all")).otherwise(F.array()))
    return identity.message_rows(nested.withColumn("comments", F.create_map(F.lit("a.py"), F.slice("all", 1, 1), F.lit("b.py"), F.expr("slice(all, 2, greatest(size(all), 1))"))).drop("all"))


def _bots(spark, sf_dir):
    """Bots from three files: an ini file that names nations, a CSV of accounts and a list with remarks, both of suppliers."""
    paths = [folder(spark, f"bots{k}") for k in range(3)]
    names = S.table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"))  # nations are 25
    lines = F.concat(F.lit("[other]\nbots = nobody\n[organization]\nname = x\nbots = "), F.col("names"), F.lit("\n[end]\nx = y"))
    names.select(lines.alias("value")).write.text(paths[0])
    s = S.table(spark, sf_dir, "supplier")
    s.filter("s_suppkey % 10 = 0").select(F.col("s_name").alias("name"), F.lit("x@y").alias("email")).write.option("header", True).csv(paths[1])
    s.filter("s_suppkey % 10 in (1, 2)").select(F.when(F.col("s_suppkey") % 10 == 1, F.upper("s_name")).otherwise(F.concat(F.lit("# "), F.col("s_name"))).alias("value")).write.text(paths[2])
    return readers.bot_names(spark, paths[0]), readers.bot_accounts(spark, paths[1]), readers.extra_bots(spark, paths[2]), readers.bot_names(spark, paths[0], lower=False)


@query(f"with {MESSAGES} select change_number, string_agg(strftime(date, '%Y-%m-%d %H:%M:%S'), ',' order by date) as times, count(*) as n_reviews from people group by 1")
def human_messages(spark, sf_dir):
    """Messages that are neither automatic nor by a bot nor by the owner, by change, in the order of time."""
    people = identity.human_messages(_messages(spark, sf_dir))
    people = identity.without_bots(people, readers.all_bots(*_bots(spark, sf_dir)[:3]), identity.identities(F.col("author")))
    out = identity.human_times(people).withColumn("n_reviews", F.size("times").cast("long"))
    return out.withColumn("times", F.array_join(F.transform("times", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ","))


@query("""select lower(n_name) as identity, 1 as n_lists from nation where n_nationkey % 5 = 0 union all select lower(s_name), 1 from supplier where s_suppkey % 10 in (0, 1) union all select 'x@y', 1
union all select n_name, 2 from nation where n_nationkey % 5 = 0""")  # fmt: skip
def bot_identities(spark, sf_dir):
    """The union of all lists, each identity once; and (2) the names as they are spelt."""
    a, b, c, spelt = _bots(spark, sf_dir)
    return readers.all_bots(a, b, c, b).select("identity", F.lit(1).alias("n_lists")).unionByName(spelt.select("identity", F.lit(2).alias("n_lists")))


# Labels and keywords as configuration files hold them.
LABEL_FILE = '{"Code-Review": {"plus": ["code-review+2", "the lazy"], "minus": ["code-review-1", "about"]}, "Verified": {"plus": ["verified"], "minus": ["people"]}, "Workflow": {"plus": ["workflow+1"]}}'
KEYWORD_FILE = '{"requests": ["idiot", "scum"], "confirmations": ["moron", "than"], "other": ["not read"]}'
STRIPPED = ["workflow+1", "verified", "people"]
_STRIP_SQL = r"\b(?:" + "|".join(x.replace("+", r"\+") for x in STRIPPED) + r")\b"
CLASS_SQL = mining.CLEAN_SQL.replace(mining.LABEL_SQL, _STRIP_SQL)


@query(f"""with c as (select doc_id, {CLASS_SQL} as cleaned from documents)
select doc_id, case when regexp_matches(cleaned, 'idiot|scum|\\bcode-review-1\\b|\\babout\\b') then 'request' when regexp_matches(cleaned, 'moron|than|\\bcode-review\\+2\\b|\\bthe lazy\\b') then 'confirmation' else 'other' end as class from c""")  # fmt: skip
def labelled_comment_classes(spark, sf_dir):
    """Classes by keywords and labels that come from files; only labels outside Code-Review are stripped before."""
    paths = [folder(spark, n) for n in ("labels", "keywords")]
    for path, value in zip(paths, (LABEL_FILE, KEYWORD_FILE)):
        spark.range(1).select(F.lit(value).alias("value")).write.text(path)
    labels = {role: [] for role in ("request", "confirmation", "strip")}
    for r in readers.review_labels(spark, paths[0]).collect():  # a configuration file
        labels[r.role].append(r.label)
    words = readers.keywords(spark, paths[1], {"requests": "request", "confirmations": "confirmation"})  # a table: mined ones may be many
    cleaned = S.table(spark, sf_dir, "documents").select("doc_id", text.clean_comment("text", labels["strip"]).alias("cleaned"))
    rows = keywords.kinds_found(cleaned, words)
    asks, confirms = (F.array_contains("kinds", k) | text.holds_keyword(F.col("cleaned"), [], labels[k]) for k in ("request", "confirmation"))
    return rows.select("doc_id", text.comment_class(asks, confirms).alias("class"))


@query(mining.MINED.replace("<where>", "where source <> 'nobody'") + mining.MINED_KEYWORDS)
def checklist_keywords(spark, sf_dir):
    """The miner from a checklist CSV to the file of keywords and back: flags as people set them, all changes of the table."""
    rows = S.table(spark, sf_dir, "documents").join(S.table(spark, sf_dir, "labels"), "doc_id")
    flag = lambda on: F.when(on, F.when(F.col("doc_id") % 2 == 0, "1").otherwise(" 1.0 ")).otherwise(F.when(F.col("doc_id") % 2 == 0, "  ").otherwise("0"))
    rows = rows.select(F.col("doc_id").alias("PRNumber"), F.col("source").alias("author"), F.col("text").alias("comment"), flag(F.col("quality") == 0).alias("request"), flag(F.col("toxic") == 1).alias("confirmation"))
    paths = [folder(spark, n) for n in ("checklist", "keywords")]
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(paths[0])
    sinks.keywords(keywords.mine(readers.checklist(spark, paths[0], None), mining.LABELS, bots=["nobody"]), paths[1])
    return readers.keywords(spark, paths[1], {"request": "request", "confirmation": "confirmation"})


@query(mining.TESTED + ", found as (select metric, coalesce(bool_or(p_value < 0.2), false) as drift_exists, min(p_value) as m from tests group by 1) select metric, drift_exists, round(m, 6) as min_p_value, 1::BIGINT as n, drift_exists::INT::BIGINT as k from found")
def recomputed_drift(spark, sf_dir):
    """Predictions saved as compressed CSV are read again and give tests and counts, which are saved and read as well."""
    path = folder(spark, "recomputed")
    sinks.predictions(S.predictions(spark, sf_dir), path, {"model": "none"})
    out = analyses.recompute(readers.predictions(spark, f"{path}/rows"), [], mining.N_PERM, 0.2)
    sinks.drift_test(out["tests"], f"{path}/tests")
    tests = spark.read.schema(out["tests"].schema).json(f"{path}/tests")
    found = drift.drift_exists(tests, ["metric"], 0.2)
    sinks.drift_count(found, drift.drift_count(found, ["metric"]), f"{path}/count")
    counts = spark.read.schema("metric string, n long, k long, ratio double").json(f"{path}/count/json")
    rows = spark.read.schema("metric string, drift_exists boolean, min_p_value double").option("header", True).csv(f"{path}/count/csv")
    return rows.join(counts, "metric").select("metric", "drift_exists", *r6("min_p_value"), "n", "k")


@query(S.using("predictions") + " select d, p, repeat, t::VARCHAR as t, change_id, y_true, round(y_pred, 6) as y_pred from predictions")
def saved_predictions(spark, sf_dir):
    """Predictions as compressed CSV and as Parquet: half of the repeats each."""
    rows, path = S.predictions(spark, sf_dir).withColumn("t", F.col("t").cast("string")), folder(spark, "predictions")
    sinks.predictions(rows.filter("repeat = 0"), f"{path}/0", {"repeat": 0})
    sinks.predictions(rows.filter("repeat = 1"), f"{path}/1", {"repeat": 1}, "parquet")
    sinks.predictions(rows.filter("repeat = 2"), f"{path}/2", {})  # nothing is written of nothing
    both = readers.predictions(spark, f"{path}/0/rows").unionByName(readers.predictions(spark, f"{path}/1/rows", "parquet"))
    return both.select("d", "p", "repeat", "t", "change_id", "y_true", *r6("y_pred"))


@query(mining.MATRIX + " select metric, d::INT as d, p::INT as p, round(value, 6) as value, round(iqr, 6) as iqr, round(value, 6) as in_wide, round(value, 6) as in_long from matrix")
def saved_matrix(spark, sf_dir):
    """The drift matrix from its JSON form, with the values of its wide and long tables."""
    path = folder(spark, "matrix")
    sinks.drift_matrix(metrics.matrices(S.predictions(spark, sf_dir)), path, 4)
    rows = readers.matrix(spark, f"{path}/json").filter("value is not null")
    wide = spark.read.schema("d int, p1 double, p2 double, p3 double, p4 double, metric string").option("header", True).csv(f"{path}/wide")
    long = spark.read.schema("distance int, position int, in_long double, metric string").option("header", True).csv(f"{path}/long")
    wide = wide.select("metric", "d", F.posexplode(F.array("p1", "p2", "p3", "p4")).alias("p", "in_wide")).withColumn("p", F.col("p") + 1)
    rows = rows.join(wide, ["metric", "d", "p"]).join(long.withColumnsRenamed({"distance": "d", "position": "p"}), ["metric", "d", "p"])
    return rows.select("metric", "d", "p", *r6("value", "iqr", "in_wide", "in_long"))


_BINS = LIFE + """, v as (select value from life where grp = 'all' and version = '20.0.0'), e as (select min(value) as lo, max(value) as hi, count(*) as n from v),
edges as (select i, case when i = 0 then lo when i = 10 then hi else pow(10, log10(lo) + (log10(hi) - log10(lo)) * i / 10) end as a from e, range(0, 11) t(i)),
b as (select l.i as pos, l.a as bin_left, r.a as bin_right from edges l join edges r on r.i = l.i + 1)
select pos::INT as pos, round(bin_left, 6) as bin_left, round(bin_right, 6) as bin_right, count(value) as count, (select n from e) as n, 'days' as unit
from b left join v on value >= bin_left and (value < bin_right or (pos = 9 and value <= bin_right)) group by pos, bin_left, bin_right"""


@query(_BINS)
def saved_histogram(spark, sf_dir):
    """A histogram with its summary and facts, as CSV and JSON, read again in the order of the bins."""
    values, path = lifetime.lifetimes(pool(spark, sf_dir)).filter("grp = 'all' and version = '20.0.0'").drop("version"), folder(spark, "histogram")
    sinks.histogram(lifetime.histogram(values, ["grp"], 10).drop("grp", "bin"), lifetime.summarize(values, ["grp"]).drop("grp"), path, {"unit": "days"})
    listed = spark.read.schema("histogram string, summary string").json(f"{path}/json")
    listed = listed.select(F.from_json("histogram", "unit string, bins array<struct<bin_left: double, bin_right: double, count: long>>").alias("h"), F.get_json_object("summary", "$.n").cast("long").alias("n"))
    rows = listed.select("n", "h.unit", F.posexplode("h.bins").alias("pos", "b")).select("pos", "b.*", "n", "unit")
    table = spark.read.schema("bin_left double, bin_right double, count long").option("header", True).csv(f"{path}/csv")
    return rows.join(table, ["bin_left", "bin_right", "count"], "left_semi").select("pos", *r6("bin_left", "bin_right"), "count", "n", "unit")


@query(mining.RANKS + """, x as (select d, p, repeat, t, ndcg from ranked where d = 1 and p = 1)
select repeat, pos::INT as pos, t::VARCHAR as timestamp, round(ndcg, 6) as mean from (select *, row_number() over (partition by repeat order by epoch_us(t)) - 1 as pos from x)""")  # fmt: skip
def saved_distribution(spark, sf_dir):
    """Points over time of two runs, written as CSV and as one JSON record each, read again in the order of x."""
    rows = metrics.rank_metrics(S.predictions(spark, sf_dir)).filter("d = 1 and p = 1")
    rows = rows.select("repeat", F.unix_date("t").cast("double").alias("x"), F.col("t").cast("string").alias("timestamp"), F.col("ndcg").alias("mean"))
    path, out = folder(spark, "distribution"), None
    for k in (0, 1):
        sinks.distribution(rows.filter(F.col("repeat") == k).drop("repeat"), f"{path}/{k}", {"repeat": k})
        listed = spark.read.text(f"{path}/{k}/json").select(F.from_json("value", "repeat int, points array<struct<x: double, timestamp: string, mean: double>>").alias("v"))
        points = listed.select("v.repeat", F.posexplode("v.points").alias("pos", "b")).select("repeat", "pos", "b.*")
        table = spark.read.schema("x double, timestamp string, mean double").option("header", True).csv(f"{path}/{k}/csv")
        points = points.join(table, ["x", "timestamp", "mean"], "left_semi").select("repeat", "pos", "timestamp", *r6("mean"))
        out = points if out is None else out.unionByName(points)
    return out


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus = 'F' union all select count(*), 0, 'none' from orders where o_orderstatus = 'Q'")
def saved_table(spark, sf_dir):
    """A table partitioned by a column, read by its partition; nothing is written of an empty one."""
    rows, path = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), folder(spark, "table")
    sinks.table(rows, path, "parquet", ["o_orderstatus"])
    empty = spark.range(1).select(F.lit(int(sinks.table(rows.filter("o_orderstatus = 'Q'"), f"{path}-none"))).cast("long").alias("o_orderkey"), F.lit(0).cast("long").alias("o_custkey"), F.lit("none").alias("o_orderstatus"))
    return spark.read.parquet(path).filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus").unionByName(empty)


@query(S.using("lines") + """ select l_orderkey as change_number, 'part ' || arg_max(l_partkey, number) as said, coalesce('s' || arg_min(l_suppkey, number) filter (l_suppkey % 3 = 0) || '@x', '') as email,
'commit_' || l_orderkey || '_' || substr(md5(concat_ws('-', l_orderkey::VARCHAR, max(number)::VARCHAR)), 1, 8) as file, 'change_' || l_orderkey as key, count(*)::INT as n from lines group by 1""")  # fmt: skip
def change_texts(spark, sf_dir):
    """What a change says, its owner's address and a commit's file name, all from its revisions."""
    rows = mining._nested(spark, sf_dir)
    name = F.md5(F.concat_ws("-", F.col("change_number").cast("string"), F.size("revisions").cast("string")))
    # Even changes name their current revision, odd ones a revision that isn't there.
    current = F.when(F.col("change_number") % 2 == 0, name).otherwise("gone")
    said = text.change_text(F.col("revisions"), current, F.when(F.col("change_number") % 3 == 0, ""))
    return rows.select("change_number", said.alias("said"), text.owner_email(F.col("owner"), F.col("revisions")).alias("email"), text.commit_file_key(F.col("change_number"), name).alias("file"), text.change_file_key(F.col("change_number")).alias("key"), F.size("revisions").alias("n"))


@query(S.using("lines") + """, c as (select l_orderkey, arg_max(round(l_quantity)::BIGINT, number) as q, arg_max(round(l_discount * 100)::BIGINT, number) as d from lines group by 1)
select o_orderkey as change_number, case when o_orderkey % 5 = 0 then 0 else coalesce(q, 0) end::BIGINT as lines_added, case when o_orderkey % 5 = 0 then 0 else coalesce(d, 0) end::BIGINT as lines_deleted,
case when o_orderkey % 5 = 0 or q is null then 0 else 1 end as files_changed from orders left join c on l_orderkey = o_orderkey""")  # fmt: skip
def change_lines(spark, sf_dir):
    """Lines and files of every order's current revision (else its latest); 0 where nothing is known."""
    rows = mining._nested(spark, sf_dir).filter("change_number % 5 != 0")
    name = F.md5(F.concat_ws("-", F.col("change_number").cast("string"), F.size("revisions").cast("string")))
    r = rows.withColumn("r", revisions.current(F.col("revisions"), F.when(F.col("change_number") % 2 == 0, name).otherwise("gone")))
    files = F.col("r.files")
    lines = r.select("change_number", revisions.file_lines(files, "lines_inserted").alias("lines_added"), revisions.file_lines(files, "lines_deleted").alias("lines_deleted"), revisions.files_changed(files).alias("files_changed"))
    return revisions.with_lines(S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number")), lines)


@query(S.using("lines") + """, c as (select o_orderkey as change_number, o_orderdate + interval 30 day as t from orders),
h as (select l_orderkey, l_shipdate, number, substr(md5(concat_ws('-', l_orderkey::VARCHAR, number::VARCHAR)), 1, 8) as sha from lines),
f as (select l_orderkey, sha, max(l_shipdate) as dated from h where l_orderkey % 3 = 0 and number % 4 <> 3 group by all),
r as (select l_orderkey, l_shipdate as dated from h where l_orderkey % 3 <> 0 union all select l_orderkey, dated from h join f using (l_orderkey, sha))
select change_number, t, count(l_orderkey) filter (dated <= t) as revision_count from c left join r on l_orderkey = change_number group by all""")  # fmt: skip
def revision_count_from_files(spark, sf_dir):
    """Revisions at a time; every third change has no revisions but lists commits, of which some have no file."""
    rows = S.lines(spark, sf_dir)
    name = F.md5(F.concat_ws("-", F.col("change_number").cast("string"), F.col("number").cast("string")))
    listed = F.col("change_number") % 3 == 0
    made = rows.select("change_number", name.alias("revision_id"), F.when(~listed, F.col("l_shipdate")).alias("created"), listed.alias("listed"))
    date = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.lit(".000000000"))
    files = rows.filter(listed & (F.col("number") % 4 != 3)).select("change_number", name.alias("revision_id"), F.struct(F.struct(date.alias("date")).alias("committer")).alias("commit"))
    probes = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("t"))
    return revisions.count_with_fallback(probes, made, files)


@query(LIFE + " select version, grp, count(*) as n, round(sum(greatest(value, 50)), 4) as floored, coalesce(min(value) > 0 and max(value) / min(value) > 100, false) as log_axis from life group by all")
def axis_rules(spark, sf_dir):
    """Values as they go on an axis with a logarithm, and whether a group needs one."""
    rows = lifetime.lifetimes(pool(spark, sf_dir))
    out = rows.groupBy("version", "grp").agg(F.count("*").alias("n"), F.round(F.sum(math.for_log_axis(F.col("value"), 50.0)), 4).alias("floored"), F.min("value").alias("a"), F.max("value").alias("b"))
    return out.select("version", "grp", "n", "floored", math.needs_log_axis(F.col("a"), F.col("b")).alias("log_axis"))


@query("select event_id, round(ln(1 + value), 6) as label, round(value, 6) as hours from events where value >= 0")
def label_transform(spark, sf_dir):
    """Labels as models see them and as they come back."""
    rows = S.table(spark, sf_dir, "events").filter("value >= 0").withColumn("label", math.to_label(F.col("value")))
    return rows.select("event_id", *r6("label"), F.round(math.from_label(F.col("label")), 6).alias("hours"))


@query(S.using("changes", "releases", "cycles") + """, d as (select version, cycle_start as s, cycle_end as e, unnest(generate_series(cycle_start - (cycle_end - cycle_start), cycle_end, interval 1 day)) as t from cycles),
r as (select version, floor((epoch_us(t) - epoch_us(s)) / 1e6 / ((epoch_us(e) - epoch_us(s)) / 1e6 / 6.0))::INT as bin, (epoch_us(decision_time) - epoch_us(t)) / 3.6e9 as label
from d join changes on created >= s - (e - s) and created <= e and created <= t and t < decision_time)
select version, bin, count(*) as n, round(avg(label), 4) as mean_label from r group by all""")  # fmt: skip
def drift_records(spark, sf_dir):
    """Records of all releases by bin: open changes of a cycle and of the span as long before it, by day."""
    c = S.changes(spark, sf_dir).select("change_number", "project", "created", "decision_time")
    rows = analyses.records(c, S.cycles(spark), lambda rows: rows, "time_to_decision", alike=["version", "cycle_start", "cycle_end", "decision_time"])
    mean = F.sum(F.col("label") * F.col("n_alike")) / F.sum("n_alike")
    return rows.groupBy("version", "bin").agg(F.sum("n_alike").alias("n"), F.round(mean, 4).alias("mean_label"))


@query(mining.SPLIT + """, s as (select d, p, repeat, change_id, side, case side when 'train' then i else j end as bin from chosen join pairs using (d, p))
select d, p, repeat::INT as repeat, side, change_id, t, bin::INT as bin, round(case side when 'train' then 1.0 / count(*) over (partition by d, p, repeat, side, change_id) end, 6)::DOUBLE as weight
from s join records using (change_id, bin)""")  # fmt: skip
def sample_weights(spark, sf_dir):
    """The records of chosen changes; those of a change in training weigh as much as one record together."""
    records, pairs = mining._records(spark, sf_dir), mining._pairs(spark)
    chosen = dataset.split(dataset.layers(records, pairs), 80, 20, 2)
    return dataset.samples(records, chosen, pairs).select("d", "p", "repeat", "side", "change_id", "t", "bin", *r6("weight"))
