"""Queries on texts, commits, splits, metrics, drift and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import asof, changes, dataset, drift, features, history, keywords, metrics, model, releases
from tidewater.plans import analyses
from tidewater.plans import standins as S
from tidewater.plans.activity import r6
from tidewater.plans.registry import query
from tidewater.sources import ingest
from tidewater.sources.scratch import folder, written
from tidewater.streaming import ingest as stream

# Subjects that the documents' own words never give, so that every score occurs.
SUBJECTS = ["Fix bug #12 in the parser", "Refactoring of the scheduler", "code   cleanup and more", "The latest state", "12.3/4"]
SUBJECT_SQL = "case doc_id % 6 " + " ".join(f"when {k} then '{s}'" for k, s in enumerate(SUBJECTS)) + " else '' end"
BUG_SQL = "|".join(text.BUG_NUMBERS)
REFACTOR_SQL = "|".join(p.replace(" ", r"\s+") for p in text.REFACTORING)
LABELS = ["code-review+2", "verified", "workflow+1"]
LABEL_SQL = r"\b(?:" + "|".join(x.replace("+", r"\+").replace("-", r"\-") for x in sorted(LABELS, key=lambda x: -len(x))) + r")\b"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CLEAN_SQL = "lower(text)"
for _p in (text.LINKS, text.PATCH_SET, text.INLINE):
    CLEAN_SQL = f"regexp_replace({CLEAN_SQL}, '{_p}', ' ', 'g')"
CLEAN_SQL = f"regexp_replace(regexp_replace(regexp_replace({CLEAN_SQL}, '{LABEL_SQL}', ' ', 'gi'), '{text.SYMBOLS.replace(chr(39), chr(39) * 2)}', ' ', 'g'), '{text.PROJECTS}', ' ', 'g')"
CLEAN_SQL = f"trim(regexp_replace({CLEAN_SQL}, ' +', ' ', 'g'))"
COMMENTS = f"with c as (select doc_id, {CLEAN_SQL} as cleaned, quality = 0 as request, toxic = 1 as confirmation from documents join labels using (doc_id)), w as (select *, list_filter(string_split(cleaned, ' '), lambda x: x <> '') as w from c), "
COUNTS = COMMENTS + "g as (select distinct doc_id, request, confirmation, unnest(w) as phrase from w), counts as (select phrase, count(*) as total, sum(request::INT)::BIGINT as request, sum(confirmation::INT)::BIGINT as confirmation from g group by all)"
TWO = COMMENTS + "g as (select distinct doc_id, request, confirmation, x as phrase from w, lateral (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as x)), counts as (select phrase, count(*) as total, sum(confirmation::INT)::BIGINT as confirmation from g group by all), kept as (select phrase from counts where total >= 10 and confirmation / total >= 0.9)"


@query(f"""with t as (select doc_id, {SUBJECT_SQL} as subject, text from documents), x as (select *, lower(concat_ws(' ', nullif({STRIP.format("subject")}, ''), nullif({STRIP.format("coalesce(text, '')")}, ''))) as low from t)
select doc_id, least(2, regexp_matches(low, '{BUG_SQL}')::INT + regexp_matches(low, '{text.BUG_WORDS}')::INT + (regexp_full_match({STRIP.format("subject")}, '{text.NUMBERS_ONLY}') or regexp_full_match({STRIP.format("coalesce(text, '')")}, '{text.NUMBERS_ONLY}'))::INT)::INT as bug_fix,
regexp_matches(subject || ' ' || coalesce(text, ''), '(?i)\\b({REFACTOR_SQL})\\b')::INT as refactoring, (contains(lower(subject), 'test') or contains(lower(coalesce(text, '')), 'test'))::INT as tests from x""")
def text_scores(spark, sf_dir):
    subject = F.lit("")
    for k, s in enumerate(SUBJECTS):
        subject = F.when(F.col("doc_id") % 6 == k, s).otherwise(subject)
    rows = S.table(spark, sf_dir, "documents").select("doc_id", subject.alias("subject"), "text")
    return rows.select("doc_id", text.bug_fix_confidence("subject", "text").alias("bug_fix"), text.refactoring_confidence("subject", "text").alias("refactoring"), text.mentions_test("subject", "text").alias("tests"))


def _labelled(spark, sf_dir):
    """Documents with their labels. Texts without labels are left where they are; the join goes by sorting, as labels are of any number."""
    labels = S.table(spark, sf_dir, "labels")
    return keywords.held_by(S.table(spark, sf_dir, "documents").select("doc_id", "text"), labels, "doc_id").join(labels.hint("merge"), "doc_id")


def _comments(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return rows.select("doc_id", text.clean_comment("text", LABELS).alias("cleaned"), (F.col("quality") == 0).alias("request"), (F.col("toxic") == 1).alias("confirmation"))


@query(COMMENTS + "x as (select 1) select doc_id, md5(cleaned) as digest, len(w) as n_words from w where regexp_full_match(cleaned, '[ -~]*')")
def comment_clean(spark, sf_dir):
    rows = _comments(spark, sf_dir)
    return rows.select("doc_id", F.md5("cleaned").alias("digest"), F.size(text.word_list(F.col("cleaned"))).cast("long").alias("n_words"))


@query(COUNTS + " select * from counts")
def phrase_counts(spark, sf_dir):
    return keywords.phrase_counts(_comments(spark, sf_dir), ["request", "confirmation"], 1, 1)


@query(COUNTS + " select 'request' as kind, phrase, total from counts where total >= 10 and request / total >= 0.3 union all select 'confirmation', phrase, total from counts where total >= 10 and confirmation / total >= 0.9")
def keyword_precision(spark, sf_dir):
    counts = keywords.phrase_counts(_comments(spark, sf_dir), ["request", "confirmation"], 1, 1)
    found = [keywords.precise(counts, k, 10, ratio).select(F.lit(k).alias("kind"), "phrase", "total") for k, ratio in (("request", 0.3), ("confirmation", 0.9))]
    return found[0].unionByName(found[1])


@query(TWO + " select phrase from kept a where not exists (select 1 from kept b where b.phrase <> a.phrase and contains(a.phrase, b.phrase))")
def keyword_antichain(spark, sf_dir):
    counts = keywords.phrase_counts(_comments(spark, sf_dir), ["confirmation"], 1, 2)
    return keywords.without_longer(keywords.precise(counts, "confirmation").select("phrase"))


# Phrases of 1 to 10 words; <where> narrows the comments.
MINED = (
    f"with c as (select doc_id, {CLEAN_SQL} as cleaned, quality = 0 as request, toxic = 1 as confirmation from documents join labels using (doc_id) <where>), "
    "w as (select *, list_filter(string_split(cleaned, ' '), lambda x: x <> '') as w from c), "
    "g as (select distinct doc_id, request, confirmation, array_to_string(w[i : i + n - 1], ' ') as phrase from w, range(1, 11) t(n), unnest(range(1, len(w) - n + 2)) u(i)), "
    "counts as (select phrase, count(*) as total, sum(request::INT)::BIGINT as request, sum(confirmation::INT)::BIGINT as confirmation from g group by all)"
)
MINED_KEYWORDS = """, k as (select 'request' as kind, phrase from counts where total >= 10 and request / total >= 0.9 union all select 'confirmation', phrase from counts where total >= 10 and confirmation / total >= 0.9)
select kind, phrase from k where not exists (select 1 from k o where o.kind = k.kind and o.phrase <> k.phrase and contains(k.phrase, o.phrase))"""


@query(MINED.replace("<where>", "") + " select * from counts")
def mined_phrase_counts(spark, sf_dir):
    """phrase_counts of all phrases of 1 to 10 words."""
    return keywords.phrase_counts(_comments(spark, sf_dir), ["request", "confirmation"])


@query(MINED.replace("<where>", "") + " select 'request' as kind, phrase, total from counts where total >= 10 and request / total >= 0.3 union all select 'confirmation', phrase, total from counts where total >= 10 and confirmation / total >= 0.9")
def mined_keyword_precision(spark, sf_dir):
    """keyword_precision of all phrases of 1 to 10 words."""
    counts = keywords.frequent_phrases(_comments(spark, sf_dir), ["request", "confirmation"], 10)
    found = [keywords.precise(counts, k, 10, ratio).select(F.lit(k).alias("kind"), "phrase", "total") for k, ratio in (("request", 0.3), ("confirmation", 0.9))]
    return found[0].unionByName(found[1])


@query(MINED.replace("<where>", "") + MINED_KEYWORDS)
def mined_keywords(spark, sf_dir):
    """The whole miner, from raw comments to the keywords of both kinds, over phrases of 1 to 10 words."""
    rows = _labelled(spark, sf_dir)
    return keywords.mine(rows.select(F.col("text").alias("comment"), (F.col("quality") == 0).cast("int").alias("request"), (F.col("toxic") == 1).cast("int").alias("confirmation")), LABELS)


@query(COMMENTS + "k as (select *, regexp_matches(cleaned, 'idiot|moron|scum') as r, regexp_matches(cleaned, 'the') as c from w) select doc_id, case when r then 'request' when c then 'confirmation' else 'other' end as class, round(least((contains(cleaned, 'idiot')::INT + contains(cleaned, 'moron')::INT + contains(cleaned, 'scum')::INT) / 5.0, 1.0), 6)::DOUBLE as urgency from k")
def comment_classes(spark, sf_dir):
    """Three-way classes by keywords, and urgency."""
    words, cleaned = ["idiot", "moron", "scum"], F.col("cleaned")
    return _comments(spark, sf_dir).select("doc_id", text.comment_class(text.holds_keyword(cleaned, words, []), text.holds_keyword(cleaned, ["the"], [])).alias("class"), F.round(text.urgency(cleaned, words), 6).alias("urgency"))


EXTENSIONS = ["py", "java", "c", "js", "r", "md"]
EXT_SQL = "case l_partkey % 6 " + " ".join(f"when {k} then '{e}'" for k, e in enumerate(EXTENSIONS)) + " end"


def _paths(spark, sf_dir):
    ext = F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (F.col("l_partkey") % 6 + 1).cast("int"))
    return S.lines(spark, sf_dir).withColumn("path", F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit("."), ext))


@query(f"select case ext when 'py' then 'Python' when 'java' then 'Java' when 'c' then 'CPP' when 'js' then 'JavaScript' when 'r' then 'R' end as language, count(distinct l_orderkey) as n_changes, sum(l_quantity::BIGINT)::BIGINT as n_lines from (select *, {EXT_SQL} as ext from lineitem) group by 1")
def language_breakdown(spark, sf_dir):
    rows = _paths(spark, sf_dir).withColumn("language", text.language_of("path"))
    return rows.groupBy("language").agg(F.countDistinct("change_number").alias("n_changes"), F.sum(F.col("l_quantity").cast("long")).alias("n_lines"))


def _nested(spark, sf_dir):
    """Orders as nested change records: lines are patch sets of one file each, and messages.

    Narrow rows are dealt out and come together in lists; what is wide is made of the lists afterwards.
    """
    rows = S.table(spark, sf_dir, "lineitem")
    line = F.struct("l_shipdate", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("inserted"), F.round(F.col("l_discount") * 100).cast("int").alias("deleted"))
    narrow = rows.select(F.col("l_orderkey").alias("change_number"), line.alias("_line"), (F.col("l_returnflag") == "R").alias("_r")).repartition(S.parts(rows), "change_number")
    made = narrow.groupBy("change_number").agg(F.array_sort(F.collect_list("_line")).alias("_lines"), F.sum("_line.inserted").cast("int").alias("insertions"), F.count_if("_r").alias("_r"))

    def entry(x, i):
        who = lambda key: F.concat(F.lit("s"), key.cast("string"))
        sign = F.struct(who(x["l_suppkey"]).alias("name"), F.when(x["l_suppkey"] % 3 == 0, F.concat(who(x["l_suppkey"]), F.lit("@x"))).alias("email"), x["l_shipdate"].cast("string").alias("date"))
        path = F.concat(F.lit("src/f"), x["l_partkey"].cast("string"), F.lit("."), F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (x["l_partkey"] % 6 + 1).cast("int")))
        files = F.create_map(path, F.struct(x["inserted"].alias("lines_inserted"), x["deleted"].alias("lines_deleted"), F.lit(None).cast("int").alias("size_delta")))
        commit = F.struct(F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("message"), sign.alias("author"), sign.alias("committer"), F.array(F.struct(F.lit("x").alias("commit"))).alias("parents"))
        name = F.md5(F.concat_ws("-", F.col("change_number").cast("string"), (i + 1).cast("string")))
        return F.struct(name.alias("k"), F.struct((i + 1).alias("_number"), x["l_shipdate"].cast("string").alias("created"), files.alias("files"), commit.alias("commit")).alias("v"))

    made = made.select("change_number", F.map_from_entries(F.transform("_lines", entry)).alias("revisions"), "insertions", "_r")
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number"), F.col("o_orderpriority").alias("component"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("string").alias("created"))
    comment = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_r").cast("int"))), lambda i: i)
    nulls = {c: F.lit(None).cast("string") for c in ("change_id", "project", "branch", "subject", "updated", "submitted")}
    rows = made.join(o.hint("merge"), "change_number").withColumns(nulls).withColumn("comments", F.create_map(F.lit("f"), F.when(F.col("_r") > 0, comment))).withColumn("reviewers", F.create_map(F.lit("R"), F.array(F.lit(1), F.lit(2))))
    return rows.withColumn("owner", F.struct(F.lit("o").alias("name"), F.lit("").alias("email"))).withColumn("deletions", F.lit(None).cast("int")).drop("_r")


@query("select l_orderkey as change_number, o_orderpriority as component, sum(l_quantity::INT)::INT as insertions, 0 as deletions, count(*) filter (l_returnflag = 'R')::INT as comments_count, 2 as reviewers_count from lineitem join orders on o_orderkey = l_orderkey group by 1, 2")
def flat_changes(spark, sf_dir):
    return ingest.flat_changes(_nested(spark, sf_dir)).select("change_number", "component", "insertions", "deletions", "comments_count", "reviewers_count")


@query("select l_orderkey as change_number, md5(concat_ws('-', l_orderkey::VARCHAR, number::VARCHAR)) as revision_id, 'part ' || l_partkey as message, 1 as files_changed, l_quantity::BIGINT as lines_inserted, round(l_discount * 100)::BIGINT as lines_deleted, 1 as parent_count from (" + S.using("lines") + " select * from lines)")
def commit_summary(spark, sf_dir):
    return ingest.flat_commits(ingest.commits(_nested(spark, sf_dir))).select("change_number", "revision_id", "message", "files_changed", "lines_inserted", "lines_deleted", "parent_count")


@query(S.using("lines") + " select l_orderkey as change_number, md5(concat_ws('-', l_orderkey::VARCHAR, '1')) as revision_id, 'part ' || l_partkey as message from lines where number = 1")
def first_revisions(spark, sf_dir):
    """The scope that keeps first revisions only."""
    return ingest.flat_commits(ingest.commits(ingest.revision_scope(_nested(spark, sf_dir), "first"))).select("change_number", "revision_id", "message")


@query("select count(distinct l_orderkey) as total_changes, count(*) as total_commits from lineitem")
def ingest_totals(spark, sf_dir):
    rows = _nested(spark, sf_dir)
    return ingest.totals(rows, ingest.commits(rows))


@query("select l_orderkey as change_number, l_shipdate as updated, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_shipdate desc, l_partkey desc, l_suppkey desc) as k from lineitem) where k = 1")
def latest_by_key(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_number"), F.col("l_shipdate").alias("updated"), "l_partkey", "l_suppkey")
    return ingest.latest_by_key(rows, "change_number", [F.desc("updated"), F.desc("l_partkey"), F.desc("l_suppkey")]).drop("l_suppkey")


@query(S.using("changes") + " select o_orderpriority as component, count(*) as fetched, count(*) filter (status <> 'NEW') as saved, count(*) filter (status = 'NEW') as skipped, min(updated) as earliest, max(updated) as latest, 'success' as status from changes join orders on o_orderkey = change_number group by 1")
def ingest_manifest(spark, sf_dir):
    rows = S.changes(spark, sf_dir).join(S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number"), F.col("o_orderpriority").alias("component")), "change_number")
    return ingest.run_manifest(rows.select("component", "change_number", "updated"), rows.filter("status != 'NEW'").select("component", "change_number"))


@query("with c as (select n_name as component, c_custkey, o_orderdate from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey) select component, count(c_custkey) as n, count(c_custkey) - count(o_orderdate) as missing_dates, min(o_orderdate) as earliest, max(o_orderdate) as latest, case when count(c_custkey) > 0 then 'success' else 'failed' end as status from c group by 1")
def release_manifest(spark, sf_dir):
    """Customers' orders as releases of nations."""
    c = S.table(spark, sf_dir, "customer").join(S.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(S.table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return ingest.release_manifest(S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("component")), c.select(F.col("n_name").alias("component"), F.col("o_orderdate").alias("release_date")))


PAIRS = dataset.cells()
PAIR_SQL = "pairs(d, p, i, j) as (values " + ", ".join(f"({d}, {p}, {i}, {j})" for p, d, i, j in PAIRS) + ")"
RECORDS = S.using("changes", "grid") + f", records as (select change_number as change_id, t, floor((epoch_us(t) - epoch_us(timestamp '1998-04-01')) / 1e6 / (90 * 86400 / 6.0))::INT as bin from grid join changes on created <= t and created >= t - interval 365 day and (decision_time is null or t < decision_time)), {PAIR_SQL}, held as (select distinct change_id, bin from records), layered as (select d, p, change_id, case when count(*) filter (bin = i) = 0 then 3 when count(*) filter (bin = j) = 0 then 1 else 2 end as layer from held join pairs on bin in (i, j) group by all)"
QUOTAS = RECORDS + ", n as (select d, p, count(*) filter (layer = 1) as n1, count(*) filter (layer = 2) as n2, count(*) filter (layer = 3) as n3 from layered group by all), q as (select *, round_even(80.0 * n1 / nullif(n1 + n2, 0), 0)::BIGINT as t1, round_even(20.0 * n3 / nullif(n3 + n2, 0), 0)::BIGINT as e3 from n), qq as (select *, 80 - t1 as t2, 20 - e3 as e2, coalesce(t1 <= n1 and e3 <= n3 and 80 - t1 >= 0 and 20 - e3 >= 0 and 80 - t1 + 20 - e3 <= n2, false) as ok from q)"


def _records(spark, sf_dir):
    rows = changes.active_days(S.changes(spark, sf_dir).select("change_number", "created", "decision_time"), S.ntz(S.GRID[0]), S.ntz(S.GRID[1]), S.LOOKBACK)
    return dataset.with_bins(rows.withColumnRenamed("change_number", "change_id"), S.ntz("1998-04-01"), S.ntz("1998-06-30"), 6)


def _pairs(spark):
    return spark.createDataFrame([(d, p, i, j) for p, d, i, j in PAIRS], "d int, p int, i int, j int")


@query(RECORDS + " select bin, count(*) as n_records, count(distinct change_id) as n_changes from records group by 1")
def bins(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n_records"), F.countDistinct("change_id").alias("n_changes"))


@query(RECORDS + " select d, p, layer, count(*) as n from layered group by all")
def layers(spark, sf_dir):
    return dataset.layers(_records(spark, sf_dir), _pairs(spark)).groupBy("d", "p", "layer").agg(F.count("*").alias("n"))


@query(QUOTAS + " select d, p, n1, n2, n3, t1, e3, t2, e2, ok from qq")
def split_quota(spark, sf_dir):
    return dataset.quotas(dataset.layers(_records(spark, sf_dir), _pairs(spark)), 80, 20)


SPLIT = QUOTAS + """, r as (select l.d, l.p, repeat, change_id, layer, t1, t2, e2, e3,
row_number() over (partition by l.d, l.p, repeat, layer order by md5(concat_ws('-', (42 + repeat)::VARCHAR, change_id::VARCHAR)), change_id) as k from layered l join qq using (d, p), range(0, 2) t(repeat) where ok),
chosen as (select d, p, repeat, change_id, case when (layer = 1 and k <= t1) or (layer = 2 and k <= t2) then 'train' else 'eval' end as side from r
where (layer = 1 and k <= t1) or (layer = 2 and k <= t2 + e2) or (layer = 3 and k <= e3))"""


@query(SPLIT + " select d, p, repeat::INT as repeat, change_id, side from chosen")
def split_sample(spark, sf_dir):
    return dataset.split(dataset.layers(_records(spark, sf_dir), _pairs(spark)), 80, 20, 2)


RANKS = S.using("predictions") + """, r as (select *, count(*) over g as size, (rank() over (g order by y_true) + (count(*) over (partition by d, p, repeat, t, y_true) - 1) / 2.0 - 1) / nullif(count(*) over g - 1, 0) as a, (rank() over (g order by y_pred) + (count(*) over (partition by d, p, repeat, t, y_pred) - 1) / 2.0 - 1) / nullif(count(*) over g - 1, 0) as b, row_number() over (g order by y_true, change_id) as rt, row_number() over (g order by y_pred, change_id) as rp from predictions window g as (partition by d, p, repeat, t)),
ranked as (select d, p, repeat, t, avg(abs(a - b)) as rank_mae, sqrt(avg((a - b) * (a - b))) as rank_rmse, sum(case when rp <= 10 then (size - rt + 1) / log2(rp + 1) end) / sum(case when rt <= 10 then (size - rt + 1) / log2(rt + 1) end) as ndcg from r where size >= 2 group by all)"""
REGRESSION = "regression as (select d, p, repeat, avg(abs(a - b)) as mae_log, sqrt(avg((a - b) * (a - b))) as rmse_log, case when min(a) < max(a) then 1 - avg((a - b) * (a - b)) / var_pop(a) end as r2_log from (select *, log10(1 + y_true) as a, log10(1 + y_pred) as b from predictions) group by all)"
_CLASS = "(({0} >= 24)::INT + ({0} >= 168)::INT + ({0} >= 720)::INT)"
_F1 = " + ".join(f"coalesce(2.0 * count(*) filter (a = {k} and b = {k}) / nullif(count(*) filter (a = {k}) + count(*) filter (b = {k}), 0), 0)" for k in range(4))
CLASSES = f"classes as (select d, p, repeat, ({_F1}) / 4 as macro_f1, count(*) filter (a = b) / count(*) as micro_f1, case when min(a) < max(a) then 1 - avg((a - b) * (a - b)) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)) end as qwk from (select *, {_CLASS.format('y_true')} as a, {_CLASS.format('y_pred')} as b from predictions) group by all)"
_LONG = " union all ".join([f"select d, p, repeat, '{m}' as metric, median({m}) as value from ranked group by all" for m in metrics.RANK_METRICS] + [f"select d, p, repeat, '{m}', {m} from regression" for m in metrics.REGRESSION] + [f"select d, p, repeat, '{m}', {m} from classes" for m in metrics.CLASSES])
MATRIX = f"{RANKS}, {REGRESSION}, {CLASSES}, per_repeat as (select * from ({_LONG}) where value is not null), matrix as (select metric, d, p, median(value) as value, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr, list(round(value, 6) order by repeat) as per_repeat from per_repeat group by all)"


@query(RANKS + " select d, p, repeat, t, round(rank_mae, 6) as rank_mae, round(rank_rmse, 6) as rank_rmse, round(ndcg, 6) as ndcg from ranked")
def rank_metrics(spark, sf_dir):
    return metrics.rank_metrics(S.predictions(spark, sf_dir)).select("d", "p", "repeat", "t", *r6(*metrics.RANK_METRICS))


@query(S.using("predictions") + f", {REGRESSION} select d, p, repeat, round(mae_log, 6) as mae_log, round(rmse_log, 6) as rmse_log, round(r2_log, 6) as r2_log from regression")
def pooled_regression(spark, sf_dir):
    return metrics.regression_metrics(S.predictions(spark, sf_dir)).select("d", "p", "repeat", *r6(*metrics.REGRESSION))


@query(S.using("predictions") + f", {CLASSES} select d, p, repeat, round(macro_f1, 6) as macro_f1, round(micro_f1, 6) as micro_f1, round(qwk, 6) as qwk from classes")
def pooled_classification(spark, sf_dir):
    return metrics.class_metrics(S.predictions(spark, sf_dir)).select("d", "p", "repeat", *r6(*metrics.CLASSES))


@query(MATRIX + " select metric, d, p, round(value, 6) as value, round(iqr, 6) as iqr, per_repeat from matrix")
def drift_matrix(spark, sf_dir):
    return metrics.matrices(S.predictions(spark, sf_dir)).select("metric", "d", "p", *r6("value", "iqr"), F.transform("per_repeat", lambda x: F.round(x, 6)).alias("per_repeat"))


GOOD = "case when metric in ('" + "', '".join(metrics.HIGHER_IS_BETTER) + "') then value else 1 - value end"


@query(MATRIX + f" select metric, d, p, round({GOOD}, 6) as goodness, round({GOOD} / max({GOOD}) over (partition by metric), 6) as relative from matrix")
def relative_matrix(spark, sf_dir):
    return metrics.relative(metrics.matrices(S.predictions(spark, sf_dir))).select("metric", "d", "p", *r6("goodness", "relative"))


SERIES = MATRIX + ", s0 as (select metric, d, row_number() over (partition by metric, d order by p) as pos, value, count(*) over (partition by metric, d) as n from matrix), s as (select metric, d, pos, value from s0 where n >= 3)"
_POINT = "round(abs(avg(value) over ({0} order by pos) - avg(value) over ({0} order by pos rows between 1 following and unbounded following)), 12) as st"
OBSERVED = SERIES + f", o as (select metric, d, pos, {_POINT.format('partition by metric, d')} from s), seen as (select metric, d, max(st) as statistic, arg_min(pos, (-st, pos)) as split from o where st is not null group by all)"
N_PERM = 200
TESTED = OBSERVED + f", sh as (select metric, d, perm, value, row_number() over (partition by metric, d, perm order by md5(concat_ws('-', '42', perm::VARCHAR, pos::VARCHAR)), pos) as pos from s, range(1, {N_PERM + 1}) t(perm)), sp as (select metric, d, perm, {_POINT.format('partition by metric, d, perm')} from sh), dr as (select metric, d, perm, max(st) as drawn from sp group by all), tests as (select metric, d, statistic, (count(*) filter (drawn >= statistic) + 1) / {N_PERM + 1}.0::DOUBLE as p_value from dr join seen using (metric, d) group by all)"


def _series(spark, sf_dir):
    return drift.series(metrics.matrices(S.predictions(spark, sf_dir)), ["metric", "d"])


@query(OBSERVED + " select metric, d, round(statistic, 6) as statistic, split::INT as split from seen")
def changepoint(spark, sf_dir):
    return drift.change_point(_series(spark, sf_dir), ["metric", "d"]).select("metric", "d", *r6("statistic"), "split")


@query(TESTED + " select metric, d, round(statistic, 6) as statistic, round(p_value, 6) as p_value from tests")
def permutation_test(spark, sf_dir):
    return drift.permutation_test(_series(spark, sf_dir), ["metric", "d"], N_PERM).select("metric", "d", *r6("statistic", "p_value"))


@query(TESTED + ", found as (select metric, bool_or(p_value < 0.2) as drift_exists, min(p_value) as m from tests group by 1) select count(*) as n, count(*) filter (drift_exists) as k, round(count(*) filter (drift_exists) / count(*), 6) as ratio from found")
def drift_count(spark, sf_dir):
    tests = drift.permutation_test(_series(spark, sf_dir), ["metric", "d"], N_PERM)
    return drift.drift_count(drift.drift_exists(tests, ["metric"], 0.2), []).select("n", "k", *r6("ratio"))


def _features(spark, sf_dir):
    """Records of the grid with what the change's owner and the project had done by then."""
    c = S.changes(spark, sf_dir)
    grid = [S.ntz(t) for t in S.GRID]
    spans = changes.open_spans(c.select("change_number", "owner_id", "created", "decision_time"), *grid, S.LOOKBACK).filter("owner_id is not null")
    events = c.select("owner_id", "created", changes.merged_time(F.col("status"), F.col("updated")).alias("merged"))
    rows = features.history_daily(spans.select("change_number", "owner_id", "_first", "_last"), *grid, events, 90)
    # What is known by day alone is a row per midnight of the grid.
    return rows.join(F.broadcast(history.open_count(c, features.midnights(spark, *grid))), "t")


@query(S.using("changes", "human", "grid") + ", a as (select change_number, owner_id, t from grid join changes on created <= t and created >= t - interval 365 day and (decision_time is null or t < decision_time)), p as (select distinct owner_id, t from a), k as (select p.owner_id, p.t, count(*) filter (created <= p.t) as past, count(*) filter (created <= p.t and created >= p.t - interval 90 day) as recent, count(*) filter (status = 'MERGED' and updated <= p.t) as m, count(*) filter (created <= p.t and created >= p.t - interval 90 day and status = 'MERGED' and updated <= p.t) as rm from p join changes using (owner_id) group by all), o as (select t, (select count(*) from changes where created <= t) - (select count(*) from changes where decision_time <= t) as n_open from grid) select change_number, t, past as past_reports, recent as recent_reports, round(coalesce(m / nullif(past, 0)::DOUBLE, 0), 6) as merge_rate, round(coalesce(rm / nullif(recent, 0)::DOUBLE, 0), 6) as recent_merge_rate, n_open from a join k using (owner_id, t) join o using (t)")
def drift_features(spark, sf_dir):
    return _features(spark, sf_dir).select("change_number", "t", "past_reports", "recent_reports", *r6("merge_rate", "recent_merge_rate"), "n_open")


VECTORS = S.using("changes", "releases", "lines", "grid") + """,
a as (select change_number, owner_id, created, t from grid join changes on created <= t and created >= t - interval 365 day and (decision_time is null or t < decision_time)),
m as (select *, cast(split_part(version, '.', 1) as int) as m from releases where regexp_matches(version, '^[0-9]+\\.0\\.0$')),
i as (select release_date from (select *, coalesce(lag(m) over (order by release_date, m), -1) as base from m) where m > base),
l as (select change_number, l_shipdate, max(number) as number, arg_max(round(l_quantity)::BIGINT, number) as la, arg_max(round(l_discount * 100)::BIGINT, number) as ld from lines group by all),
s as (select a.change_number, a.t, la, ld, number from a asof join l on l.change_number = a.change_number and a.t >= l.l_shipdate),
w as (select change_number, updated, sum(round(l_quantity)::BIGINT) as n from changes join lineitem on l_orderkey = change_number group by all),
g as (select t, round(coalesce((select min((epoch_us(release_date) - epoch_us(t)) / 8.64e10) from i where release_date > t), -1), 6) as days_to_major_release,
  ((select count(*) from changes where created <= t) - (select count(*) from changes where decision_time <= t))::DOUBLE as open_ticket_count,
  (select coalesce(sum(n), 0) from w where updated <= t and updated >= t - interval 14 day)::DOUBLE as reviewed_lines_in_period from grid),
p as (select distinct owner_id, t from a),
k as (select p.owner_id, p.t, count(*) filter (created <= p.t) as past, count(*) filter (created <= p.t and created >= p.t - interval 90 day) as recent, count(*) filter (status = 'MERGED' and updated <= p.t) as mm,
  count(*) filter (created <= p.t and created >= p.t - interval 90 day and status = 'MERGED' and updated <= p.t) as rm from p join changes using (owner_id) group by all)
select a.change_number, a.t, (o_orderpriority = '1-URGENT')::INT::DOUBLE as bug_fix_confidence, coalesce(la, 0)::DOUBLE as lines_added, coalesce(ld, 0)::DOUBLE as lines_deleted,
(number is not null)::INT::DOUBLE as files_changed, round((epoch_us(a.t) - epoch_us(created)) / 6e7, 6) as elapsed_time, coalesce(number, 0)::DOUBLE as revision_count, 0::DOUBLE as test_code_presence,
0::DOUBLE as refactoring_confidence, past::DOUBLE as past_report_count, recent::DOUBLE as recent_report_count, round(coalesce(mm / nullif(past, 0)::DOUBLE, 0), 6) as merge_rate,
round(coalesce(rm / nullif(recent, 0)::DOUBLE, 0), 6) as recent_merge_rate, days_to_major_release, open_ticket_count, reviewed_lines_in_period
from a join orders on o_orderkey = a.change_number join g using (t) join k on k.owner_id = a.owner_id and k.t = a.t left join s on s.change_number = a.change_number and s.t = a.t"""


@query(VECTORS)
def feature_vectors(spark, sf_dir):
    """All fifteen features of every active change on every day of the grid; urgent orders speak of a bug."""
    return _daily(spark, sf_dir).select("change_number", "t", *(F.round(f, 6).alias(f) for f in dataset.FEATURES))


@query(None)
def feature_vectors_daily(spark, sf_dir):
    """feature_vectors as they are, not rounded."""
    return _daily(spark, sf_dir).select("change_number", "t", *dataset.FEATURES)


def _daily(spark, sf_dir):
    c = S.changes(spark, sf_dir).select("change_number", "owner_id", "created", "decision_time")
    grid = [S.ntz(t) for t in S.GRID]
    return features.build_daily(changes.open_spans(c, *grid, S.LOOKBACK), *grid, *_known(spark, sf_dir))


def _known(spark, sf_dir):
    """What features are made of: texts, patch sets, events, calendar, component."""
    rows = S.lines(spark, sf_dir)
    sets = rows.select("change_number", F.col("l_shipdate").alias("created"), "number", F.round("l_quantity").cast("long").alias("lines_added"), F.round(F.col("l_discount") * 100).cast("long").alias("lines_deleted"), F.lit(1).alias("files_changed"))
    total = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("change_number")).agg(F.sum(F.round("l_quantity").cast("long")).alias("lines"))
    c = S.changes(spark, sf_dir).join(total.hint("merge"), "change_number").withColumn("merged", changes.merged_time(F.col("status"), F.col("updated")))
    texts = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number"), F.when(F.col("o_orderpriority") == "1-URGENT", "a defect here").otherwise("").alias("subject"), F.lit(None).cast("string").alias("message"))
    return texts, sets, c, releases.of_component(S.releases(spark), S.PROJECT), S.PROJECT


def _known_by(spark, sf_dir):
    """A function that gives sampled rows (change_number, owner_id, created, t, ...) all fifteen features."""

    def known(made):
        own = F.broadcast(made.select("change_number").distinct())  # as many as the design samples
        texts, sets, *others = _known(spark, sf_dir)
        return features.build(made, texts.join(own, "change_number", "left_semi"), sets.join(own, "change_number", "left_semi"), *others)

    return known


def _samples(spark, sf_dir, n_train, n_eval, repeats):
    """The records of all cells, sampled, with what they were sampled by."""
    c = S.changes(spark, sf_dir).select("change_number", "owner_id", "created", "decision_time")
    rows = _next_reviews(spark, sf_dir)(changes.open_spans(c, S.ntz(S.GRID[0]), S.ntz(S.GRID[1]), S.LOOKBACK).drop("decision_time"))
    rows = written(dataset.span_bins(rows, S.ntz("1998-04-01"), S.ntz("1998-06-30"), 6).withColumnRenamed("change_number", "change_id"), "records")
    chosen = dataset.split(dataset.layers(rows, _pairs(spark)), n_train, n_eval, repeats)
    return dataset.labelled(dataset.samples(rows, chosen, _pairs(spark)), "time_to_next_review").drop("next_review")


def _next_reviews(spark, sf_dir):
    return lambda spans: asof.next_of_days(spans, S.human(spark, sf_dir).select("change_number", "date"), "change_number", "date", "next_review")


LABELLED = S.using("changes", "human", "grid") + f""", records as (select a.change_number as change_id, a.t, floor((epoch_us(a.t) - epoch_us(timestamp '1998-04-01')) / 1e6 / (90 * 86400 / 6.0))::INT as bin
from (select change_number, t from grid join changes on created <= t and created >= t - interval 365 day and (decision_time is null or t < decision_time)) a asof join human h on h.change_number = a.change_number and h.date > a.t), {PAIR_SQL}"""
DRAWN = SPLIT.replace(RECORDS, LABELLED + RECORDS[RECORDS.index(", held as") :]).replace("80.0 *", "400.0 *").replace("20.0 *", "100.0 *").replace("80 - t1", "400 - t1").replace("20 - e3", "100 - e3").replace("range(0, 2) t(repeat)", "range(0, 10) t(repeat)")


@query(DRAWN + """ select c.d, c.p, c.repeat::INT as repeat, c.side, count(*) as n_records, count(distinct c.change_id) as n_changes, round(case when any_value(c.side) = 'train' then count(distinct c.change_id) end, 6)::DOUBLE as weight
from chosen c join pairs using (d, p) join records r on r.change_id = c.change_id and r.bin = case c.side when 'train' then i else j end group by 1, 2, 3, 4""")
def sampled_records(spark, sf_dir):
    """How many labelled records and changes all cells and ten repeats hold, 400 changes to train and 100 to evaluate each; weights sum to the changes."""
    rows = _samples(spark, sf_dir, 400, 100, 10)
    return rows.groupBy("d", "p", "repeat", "side").agg(F.count("*").alias("n_records"), F.countDistinct("change_id").alias("n_changes"), F.round(F.sum("weight"), 6).alias("weight"))


@query(None)
def train_predict(spark, sf_dir):
    """All cells and ten repeats from records to predictions, on the fifteen features, by both models: split, weights, fits (of 200 trees), predictions."""
    made = written(_samples(spark, sf_dir, 400, 100, 10), "samples")
    known = _known_by(spark, sf_dir)(made.select(F.col("change_id").alias("change_number"), "owner_id", "created", "t").distinct()).withColumnRenamed("change_number", "change_id").drop("owner_id", "created")
    return model.all_cells(made.join(known, ["change_id", "t"]), dataset.FEATURES, list(model.MODELS))


@query(None)
def drift_run(spark, sf_dir):
    """The whole drift analysis, from changes to counts: which releases show drift in which metric of which model, and how many do.

    All releases and cells, both models (of 5 trees), one repeat, 100 changes to train and 25 to evaluate, 200 permutations.
    """
    c = S.changes(spark, sf_dir).select("project", "change_number", "owner_id", "created", "decision_time")
    labels = lambda spans: _next_reviews(spark, sf_dir)(spans.drop("decision_time"))
    out = analyses.analyze(c, S.cycles(spark), None, dataset.FEATURES, folder(spark, "drift-run"), tuple(model.MODELS), n_train=100, n_eval=25, repeats=1, trees=5, permutations=200, late=_known_by(spark, sf_dir), labels=labels)
    return out["found"].join(out["count"], ["model", "metric"]).select("model", "metric", "version", "drift_exists", "n", "k")


@query("with x as (select l_quantity as a, l_extendedprice as b from lineitem), s as (select avg(a) as ma, stddev_samp(a) as sa, avg(b) as mb, stddev_samp(b) as sb from x) select l_orderkey, l_linenumber, round((l_quantity - ma) / sa, 4) as quantity, round((l_extendedprice - mb) / sb, 4) as price from lineitem, s")
def feature_scaling(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    out = model.scaled(S.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("_v", vector_to_array("scaled"))
    return out.select("l_orderkey", "l_linenumber", F.round(F.get("_v", F.lit(0)), 4).alias("quantity"), F.round(F.get("_v", F.lit(1)), 4).alias("price"))


@query("select o_orderkey, o_custkey, o_orderstatus, 1::BIGINT as n_ingested from orders")
def resumable_ingest(spark, sf_dir):
    """Orders landed as files are ingested by a stream that is stopped and resumed, and run once more without new files; n_ingested counts the rows an order got."""
    base = folder(spark, "ingest")
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING"
    for part in ("y < 1996", "y >= 1996", None):
        if part:
            rows.filter(part).drop("y").write.mode("append").json(f"{base}/landed")
        stream.ingest(spark, f"{base}/landed", schema, f"{base}/target", f"{base}/checkpoint", per_batch=4)
    counted = spark.read.parquet(f"{base}/target").groupBy("o_orderkey").agg(F.count("*").alias("n_ingested"))
    return stream.latest(spark, f"{base}/target", "o_orderkey", []).select("o_orderkey", "o_custkey", "o_orderstatus").join(counted, "o_orderkey")


@query("""select o_orderkey as change_number, case when o_orderkey % 3 = 0 then o_orderstatus else 'NEW' end as status, (year(o_orderdate) * 100 + case when o_orderkey % 3 = 0 then 50 else 10 end)::INT as updated,
(case when o_orderkey % 3 = 0 then 2 when o_orderkey % 7 = 0 then 4 else 1 end)::INT as landing from orders""")
def upserted_changes(spark, sf_dir):
    """Changes that land as files and are merged by their numbers: first all as new, then a third as decided, then stale ones, then again what is as old."""
    base = folder(spark, "upsert")
    rows = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number"), "o_orderstatus", (F.year("o_orderdate") * 100).alias("y"))
    schema = "change_number BIGINT, status STRING, updated INT, landing INT"
    for landing, (part, status, add) in enumerate((("true", F.lit("NEW"), 10), ("change_number % 3 = 0", F.col("o_orderstatus"), 50), ("change_number % 5 = 0", F.lit("STALE"), 1), ("change_number % 7 = 0 and change_number % 3 != 0", F.lit("NEW"), 10)), 1):
        landed = rows.filter(part).select("change_number", status.alias("status"), (F.col("y") + add).cast("int").alias("updated"), F.lit(landing).alias("landing"))
        landed.coalesce(1).write.mode("append").json(f"{base}/landed")
        stream.upsert(spark, f"{base}/landed", schema, f"{base}/target", f"{base}/checkpoint", "change_number", ["updated"], 16)
    return stream.current(spark, f"{base}/target", schema)


@query("""select distinct year(o_orderdate)::INT as y, md5(o_orderpriority) as component from orders
where (year(o_orderdate), o_orderpriority) not in (select distinct year(o_orderdate), o_orderpriority from orders where o_orderkey % 40 = 0 and year(o_orderdate) < 1997)""")  # fmt: skip
def ledger(spark, sf_dir):
    """Intervals that the ledger of earlier runs (of some orders before 1997) doesn't name."""
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.md5("o_orderpriority").alias("component"))
    done = rows.filter("o_orderkey % 40 = 0 and y < 1997").select("y", "component", F.lit("done").alias("status"))
    return stream.not_done(rows.select("y", "component").distinct(), done, ["y", "component"])


@query("""with c as (select o_custkey, min(o_orderdate) as first, max(o_orderdate) as last from orders group by 1),
y as (select *, unnest(range(year(first), year(last) + 1)) as y from c)
select o_custkey, y - year(first) + 1 as chunk, case when y = year(first) then first else make_timestamp(y, 1, 1, 0, 0, 0.0) end as chunk_start,
case when y = year(last) then last else make_timestamp(y + 1, 1, 1, 0, 0, 0.0) end as chunk_end from y""")
def year_chunks(spark, sf_dir):
    """Contiguous yearly intervals of each customer's history."""
    from tidewater.functions.time import date_chunks

    rows = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    rows = rows.select("o_custkey", F.posexplode(date_chunks(F.col("first"), F.col("last"), 1)).alias("pos", "c"))
    return rows.select("o_custkey", (F.col("pos") + 1).cast("long").alias("chunk"), F.col("c.start").alias("chunk_start"), F.col("c.end").alias("chunk_end"))
