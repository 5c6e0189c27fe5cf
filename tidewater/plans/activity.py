"""Queries on lifetimes, releases, active sets, reviews and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import asof, changes, cohorts, distribution, history, lifetime, releases, requests, revisions
from tidewater.plans import standins as S
from tidewater.plans.registry import query

POOL = S.using("changes", "releases", "cycles") + ", pool as (select c.*, version, cycle_start, cycle_end from changes c join cycles on created >= cycle_start - interval 365 day and created <= cycle_end)"
LIFE = POOL + ", life as (select version, grp, change_number, (epoch_us(updated) - epoch_us(created)) / 1e6 / 86400 as value from pool join (values ('merged', 'MERGED'), ('abandoned', 'ABANDONED'), ('all', 'MERGED'), ('all', 'ABANDONED')) g(grp, s) on s = status where updated > created)"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def pool(spark, sf_dir):
    return lifetime.in_cycles(S.changes(spark, sf_dir), S.cycles(spark), S.LOOKBACK)


@query(LIFE + """, e as (select version, grp, min(value) as lo, case when max(value) <= min(value) then min(value) * 10 else max(value) end as hi from life group by all),
edges as (select version, grp, i as bin, case when i = 0 then lo when i = 20 then hi else pow(10, log10(lo) + (log10(hi) - log10(lo)) * i / 20) end as a from e, range(0, 21) t(i)),
bins as (select l.version, l.grp, l.bin, l.a as bin_left, r.a as bin_right from edges l join edges r on l.version = r.version and l.grp = r.grp and r.bin = l.bin + 1)
select b.version, b.grp, b.bin::INT as bin, round(bin_left, 6) as bin_left, round(bin_right, 6) as bin_right, count(value) as count from bins b left join life l on l.version = b.version and l.grp = b.grp and value >= bin_left and (value < bin_right or (bin = 19 and value <= bin_right)) group by all""")
def lifetime_histogram(spark, sf_dir):
    out = lifetime.histogram(lifetime.lifetimes(pool(spark, sf_dir)), ["version", "grp"], 20)
    return out.select("version", "grp", "bin", *r6("bin_left", "bin_right"), "count")


SUMMARY = "count(*) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(min(value), 6) as min, round(max(value), 6) as max, " + ", ".join(f"round(quantile_cont(value, {q / 100}), 6) as p{q}" for q in (10, 25, 50, 75, 90))
NAMES = ["mean", "median", "min", "max", "p10", "p25", "p50", "p75", "p90"]


@query(LIFE + f" select version, grp, {SUMMARY} from life group by all")
def lifetime_summary(spark, sf_dir):
    return lifetime.summarize(lifetime.lifetimes(pool(spark, sf_dir)), ["version", "grp"]).select("version", "grp", "n", *r6(*NAMES))


@query(POOL + " select version, count(*) filter (status = 'NEW') as n_excluded_unfinished from pool group by all")
def lifetime_excluded(spark, sf_dir):
    return lifetime.undecided(pool(spark, sf_dir))


@query(LIFE + """, q as (select version, grp, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from life group by all),
x as (select *, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from life join q using (version, grp))
select version, grp, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, count(*) as n, round(min(value) filter (inside), 6) as whisker_low, round(max(value) filter (inside), 6) as whisker_high, count(*) filter (not inside) as n_fliers from x group by all""")
def lifetime_boxplot(spark, sf_dir):
    out = lifetime.box_plot(lifetime.lifetimes(pool(spark, sf_dir)), ["version", "grp"])
    return out.select("version", "grp", *r6("q1", "median", "q3"), "n", *r6("whisker_low", "whisker_high"), "n_fliers")


@query(LIFE + f", o as (select version, row_number() over (order by cycle_end, version) as release_ord from cycles), once as (select life.*, row_number() over (partition by grp, change_number order by release_ord) as k from life join o using (version)) select grp, {SUMMARY} from once where k = 1 group by all")
def lifetime_mixed_dedup(spark, sf_dir):
    from pyspark.sql import Window

    order = S.cycles(spark).select("version", F.row_number().over(Window.orderBy("cycle_end", "version")).alias("release_ord"))
    once = lifetime.first_occurrence(lifetime.lifetimes(pool(spark, sf_dir)), order)
    return lifetime.summarize(once, ["grp"]).select("grp", "n", *r6(*NAMES))


@query(S.using("releases", "cycles") + " select project, version, cycle_start, cycle_end, (select count(*) from orders where o_orderdate >= cycle_start and o_orderdate < cycle_end) as n_created from cycles")
def release_cycles(spark, sf_dir):
    """Cycles, and how many changes each saw created."""
    made = lifetime.in_cycles(S.table(spark, sf_dir, "orders").select(F.lit(S.PROJECT).alias("project"), F.col("o_orderdate").alias("created")), S.cycles(spark), 0)
    n = made.filter("created < cycle_end").groupBy("version").agg(F.count("*").alias("n"))
    return S.cycles(spark).join(n, "version", "left").select("project", "version", "cycle_start", "cycle_end", F.coalesce("n", F.lit(0).cast("long")).alias("n_created"))


@query(S.using("releases") + """, m as (select *, cast(split_part(version, '.', 1) as int) as m from releases where regexp_matches(trim(version), '^[0-9]+\\.0\\.0$')),
i as (select release_date from (select *, coalesce(lag(m) over (partition by project order by release_date, m), -1) as base from m) where m > base),
t as (select distinct o_orderdate as t from orders)
select t, round(coalesce(min((epoch_us(release_date) - epoch_us(t)) / 1e6 / 86400), -1.0), 6) as days_to_major from t left join i on release_date > t group by all""")
def days_to_major_release(spark, sf_dir):
    probes = S.table(spark, sf_dir, "orders").select(F.lit(S.PROJECT).alias("component"), F.col("o_orderdate").alias("t")).distinct()
    out = releases.days_to_major(probes, releases.of_component(S.releases(spark), S.PROJECT))
    return out.select("t", *r6("days_to_major"))


@query(S.using("changes", "grid") + ", a as (select t from grid join changes on created <= t and created >= t - interval 365 day and (decision_time is null or t < decision_time)) select t, count(*) as n_active from a group by all")
def active_set_daily(spark, sf_dir):
    rows = changes.active_days(S.changes(spark, sf_dir).select("change_number", "created", "decision_time"), S.ntz(S.GRID[0]), S.ntz(S.GRID[1]), S.LOOKBACK)
    return rows.groupBy("t").agg(F.count("*").alias("n_active"))


@query(S.using("changes") + ", e as (select created as t, 1 as d from changes union all select decision_time, -1 from changes where decision_time is not null), days as (select unnest(generate_series((select min(t) from e), (select max(t) from e), interval 1 day)) as t), s as (select t, sum(d) as d from e group by all) select days.t, cast(sum(coalesce(d, 0)) over (order by days.t) as BIGINT) as n_open from days left join s on s.t = days.t")
def open_ticket_count(spark, sf_dir):
    made = S.changes(spark, sf_dir)
    return history.open_count(made, history.days_between_events(made))


@query(S.using("human") + " select change_number, count(*) as n_reviews, min(date) as first_review, max(date) as last_review from human group by all")
def human_reviews(spark, sf_dir):
    return S.human(spark, sf_dir).groupBy("change_number").agg(F.count("*").alias("n_reviews"), F.min("date").alias("first_review"), F.max("date").alias("last_review"))


@query(S.using("changes", "human") + " select c.change_number, min(date) as first_review, round((epoch_us(min(date)) - epoch_us(created)) / 3.6e9, 6) as hours_to_first_review from changes c left join human h on h.change_number = c.change_number group by c.change_number, created")
def first_review(spark, sf_dir):
    from tidewater.functions import time

    first = S.human(spark, sf_dir).groupBy("change_number").agg(F.min("date").alias("first_review"))
    rows = S.changes(spark, sf_dir).join(first, "change_number", "left").withColumn("hours_to_first_review", time.between("created", "first_review", "hours"))
    return rows.select("change_number", "first_review", *r6("hours_to_first_review"))


ACTIVE_SQL = S.using("changes", "human", "grid") + ", active as (select change_number, created, decision_time, t from grid join changes on created <= t and created >= t - interval 365 day and (decision_time is null or t < decision_time))"


def reviewed_days(spark, sf_dir, undecided=True):
    rows = changes.active_days(S.changes(spark, sf_dir).select("change_number", "owner_id", "created", "decision_time"), S.ntz(S.GRID[0]), S.ntz(S.GRID[1]), S.LOOKBACK, undecided)
    return asof.next_after(rows, S.human(spark, sf_dir), "change_number", "t", "date", "next_review")


@query(ACTIVE_SQL + " select a.change_number, a.t, round((epoch_us(h.date) - epoch_us(a.t)) / 3.6e9, 6) as label from active a asof join human h on h.change_number = a.change_number and h.date > a.t")
def next_review_label(spark, sf_dir):
    from tidewater.operators.dataset import labelled

    return labelled(reviewed_days(spark, sf_dir), "time_to_next_review").select("change_number", "t", *r6("label"))


POINTS = "count(*) as n_active, avg(v) as mean, stddev_pop(v) as std, avg(v) - stddev_pop(v) as lower, avg(v) + stddev_pop(v) as upper, " + ", ".join(f"quantile_cont(v, {q / 100}) as p{q}" for q in distribution.PERCENTS)
POINT_NAMES = ["mean", "std", "lower", "upper", *(f"p{q}" for q in distribution.PERCENTS)]
WAIT = POOL + f""", bounds as (select version, quantile_cont(s, 0.25) - 1.5 * (quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) as low, quantile_cont(s, 0.75) + 1.5 * (quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) as high, count(*) as n from (select *, (epoch_us(decision_time) - epoch_us(created)) / 1e6 as s from pool where decision_time is not null) group by all),
kept as (select pool.* from pool join bounds using (version) where decision_time is not null and (n < 4 or (epoch_us(decision_time) - epoch_us(created)) / 1e6 between low and high)),
days as (select version, cycle_start, cycle_end, unnest(generate_series(cycle_start, cycle_end, interval 1 day)) as t from cycles),
active as (select d.version, d.t, d.cycle_start, d.cycle_end, (epoch_us(k.decision_time) - epoch_us(d.t)) / 8.64e10 as v from days d join kept k on k.version = d.version and created <= t and created >= t - interval 365 day and t < decision_time),
points as (select version, (epoch_us(t) - epoch_us(cycle_start)) / (epoch_us(cycle_end) - epoch_us(cycle_start))::DOUBLE as x, t as timestamp, {POINTS} from active group by version, t, cycle_start, cycle_end having count(*) >= 5)"""


def waiting_points(spark, sf_dir):
    rows = distribution.drop_outliers(distribution.drop_unfinished(distribution.screened(pool(spark, sf_dir), "time_to_decision")), ["version"])
    active = changes.active_days(rows, F.col("cycle_start"), F.col("cycle_end"), S.LOOKBACK, undecided=False, alike=["version", "cycle_start", "cycle_end", "decision_time"])
    return distribution.points(active, ["version"], distribution.waiting("time_to_decision", F.col("t"), "days"), F.col("cycle_start"), F.col("cycle_end"), times="n_alike")


@query(WAIT + " select version, round(x, 6) as x, timestamp, n_active, " + ", ".join(f"round({n}, 6) as {n}" for n in POINT_NAMES) + " from points")
def waiting_distribution(spark, sf_dir):
    return waiting_points(spark, sf_dir).select("version", *r6("x"), "timestamp", "n_active", *r6(*POINT_NAMES))


@query(WAIT + """, ends as (select min(x) as a, max(x) as b from points), placed as (select *, (len(list_filter(range(0, 10), lambda i: a + (b - a) * i / 10 <= x)) - 1)::INT as bin from points, ends)
select bin, round(a + (b - a) * (bin + 0.5) / 10, 6) as x, sum(n_active)::BIGINT as n_active, round(avg(mean), 6) as mean, round(stddev_pop(mean), 6) as std, round(avg(lower), 6) as lower, round(avg(upper), 6) as upper, """ + ", ".join(f"round(avg(p{q}), 6) as p{q}" for q in distribution.PERCENTS) + ", 'mixed' as release_version from placed group by bin, a, b")
def waiting_distribution_mixed(spark, sf_dir):
    return distribution.bin_points(waiting_points(spark, sf_dir), 10).select("bin", *r6("x"), "n_active", *r6(*POINT_NAMES), "release_version")


def _screening(spark, sf_dir):
    first = S.human(spark, sf_dir).groupBy("change_number").agg(F.min("date").alias("first_review"))
    return distribution.screened(pool(spark, sf_dir).join(first, "change_number", "left"), "time_to_next_review")


SCREEN = S.using("changes", "human", "releases", "cycles") + ", pool as (select c.*, version, cycle_start, cycle_end from changes c join cycles on created >= cycle_start - interval 365 day and created <= cycle_end), f as (select change_number, min(date) as first_review from human group by all), s as (select pool.*, (epoch_us(first_review) - epoch_us(created)) / 1e6 as screening from pool left join f using (change_number)), done as (select * from s where decision_time is not null and screening is not null)"


@query(SCREEN + ", b as (select version, quantile_cont(screening, 0.25) as q1, quantile_cont(screening, 0.75) as q3, count(*) as n from done group by all), k as (select version, count(*) as k from done join b using (version) where n < 4 or screening between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all) select version, count(*) as n_total, count(*) filter (decision_time is null or screening is null) as n_dropped_unfinished, (count(*) filter (decision_time is not null and screening is not null) - coalesce(any_value(k), 0))::BIGINT as n_dropped_outliers from s left join k using (version) group by all")
def outlier_iqr(spark, sf_dir):
    return distribution.exclusions(_screening(spark, sf_dir), ["version"], "iqr")


@query(SCREEN + ", b as (select version, quantile_cont(screening, 0.01) as low, quantile_cont(screening, 0.99) as high, count(*) as n from done group by all), k as (select version, count(*) as k from done join b using (version) where n < 4 or screening between low and high group by all) select version, count(*) as n_total, count(*) filter (decision_time is null or screening is null) as n_dropped_unfinished, (count(*) filter (decision_time is not null and screening is not null) - coalesce(any_value(k), 0))::BIGINT as n_dropped_outliers from s left join k using (version) group by all")
def outlier_percentile(spark, sf_dir):
    return distribution.exclusions(_screening(spark, sf_dir), ["version"], "percentile")


PROBES = S.using("history") + ", probes as (select distinct owner_id, date_trunc('day', created) as t from history)"


def _developers(spark, sf_dir):
    h = S.history(spark, sf_dir)
    probes = h.select("owner_id", F.date_trunc("day", "created").cast("timestamp_ntz").alias("t"))
    return history.developer_history(probes, h, "owner_id", S.LOOKBACK_EVENTS)


@query(PROBES + " select p.owner_id, t, count(*) filter (created <= t) as past_reports from probes p join history h using (owner_id) group by all")
def past_reports(spark, sf_dir):
    return _developers(spark, sf_dir).select("owner_id", "t", "past_reports")


@query(PROBES + " select p.owner_id, t, count(*) filter (created <= t and created >= t - interval 7 day) as recent_reports from probes p join history h using (owner_id) group by all")
def recent_reports(spark, sf_dir):
    return _developers(spark, sf_dir).select("owner_id", "t", "recent_reports")


@query(PROBES + " select p.owner_id, t, round(coalesce(count(*) filter (merged <= t) / nullif(count(*) filter (created <= t), 0)::DOUBLE, 0), 6) as merge_rate from probes p join history h using (owner_id) group by all")
def merge_rate(spark, sf_dir):
    return _developers(spark, sf_dir).select("owner_id", "t", *r6("merge_rate"))


@query(PROBES + " select p.owner_id, t, round(coalesce(count(*) filter (created <= t and created >= t - interval 7 day and merged <= t) / nullif(count(*) filter (created <= t and created >= t - interval 7 day), 0)::DOUBLE, 0), 6) as recent_merge_rate from probes p join history h using (owner_id) group by all")
def recent_merge_rate(spark, sf_dir):
    return _developers(spark, sf_dir).select("owner_id", "t", *r6("recent_merge_rate"))


@query(
    S.using("history")
    + """, d as (select distinct case when date_trunc('day', created) < created then date_trunc('day', created) + interval 1 day else created end as t from history),
asked as (select t from d union select t + interval 40 hour from d)
select t, coalesce(sum(lines), 0)::BIGINT as reviewed_lines from asked left join history on created <= t and created >= t - interval 3 day group by t"""
)
def reviewed_lines(spark, sf_dir):
    """Lines of the three days before every midnight after an update, and before an instant within a day."""
    from tidewater.functions.time import first_midnight

    made = S.history(spark, sf_dir).withColumnRenamed("created", "updated")
    days = made.select(first_midnight(F.col("updated")).alias("t")).distinct()
    return history.lines_in_period(made, days.union(days.select(F.col("t") + F.expr("interval 40 hours"))), 3)


@query(S.using("lines") + ", probes as (select o_orderkey as change_number, o_orderdate + interval 30 day as t from orders) select p.change_number, p.t, number::INT as number, round(l_quantity)::BIGINT as lines_inserted, round(l_discount * 100)::BIGINT as lines_deleted from probes p left join (select *, row_number() over (partition by change_number, l_shipdate order by number desc) as k from lines) l on l.change_number = p.change_number and l_shipdate = (select max(l_shipdate) from lineitem x where x.l_orderkey = p.change_number and x.l_shipdate <= p.t) and k = 1")
def revision_state_at_t(spark, sf_dir):
    probes = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("t"))
    rows = S.lines(spark, sf_dir)
    files = F.create_map(F.concat(F.lit("src/f"), F.col("l_partkey").cast("string")), F.struct(F.round("l_quantity").cast("int").alias("lines_inserted"), F.round(F.col("l_discount") * 100).cast("int").alias("lines_deleted")))
    made = rows.select("change_number", F.col("l_shipdate").alias("created"), "number", files.alias("files"))
    made = made.withColumns({"lines_inserted": revisions.file_lines(F.col("files"), "lines_inserted"), "lines_deleted": revisions.file_lines(F.col("files"), "lines_deleted")}).drop("files")
    return revisions.state_at(probes, made, ["number", "lines_inserted", "lines_deleted"])


@query("select o_orderkey as change_number, o_orderdate + interval 30 day as t, count(l_orderkey) filter (l_shipdate <= o_orderdate + interval 30 day) as revision_count from orders left join lineitem on l_orderkey = o_orderkey group by all")
def revision_count(spark, sf_dir):
    probes = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_number"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("t"))
    made = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_number"), F.col("l_shipdate").alias("created"))
    return revisions.count_at(probes, made)


@query("with m as (select user_id as change_number, ts, event_type = 'error' as req, event_type = 'purchase' as conf from events where event_type in ('error', 'purchase')), v as (select user_id as change_number, ts from events where event_type = 'signup'), r as (select change_number, ts, (select min(v.ts) from v where v.change_number = m.change_number and v.ts > m.ts) as up from m where req), s as (select r.*, (select min(c.ts) from m c where c.conf and c.change_number = r.change_number and c.ts > r.up) as done from r) select change_number, count(*) filter (done is null) as n_open, count(done) as n_done from s group by all")
def open_requests(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("change_number"), "ts", "event_type")
    messages = e.filter("event_type in ('error', 'purchase')").withColumns({"is_request": F.col("event_type") == "error", "is_confirmation": F.col("event_type") == "purchase"})
    return requests.open_requests(messages, e.filter("event_type = 'signup'"))


COHORT = S.using("changes", "human", "releases", "cycles") + ", n as (select change_number, count(*) as k from human group by all), x as (select c.*, coalesce(k, 0) > 0 as reviewed from changes c left join n using (change_number)), met as (select x.*, version, 'early' as period from x join cycles on created between cycle_start and cycle_start + interval 30 day union all select x.*, version, 'late' from x join cycles on created between cycle_end - interval 30 day and cycle_end)"


def _cohorts(spark, sf_dir):
    n = S.human(spark, sf_dir).groupBy("change_number").agg(F.count("*").alias("review_count"))
    rows = S.changes(spark, sf_dir).join(n, "change_number", "left").fillna({"review_count": 0})
    return changes.cohorts(rows, S.cycles(spark))


@query(COHORT + " select version, period, reviewed, count(*) as n, round(avg((epoch_us(updated) - epoch_us(created)) / 8.64e10), 6) as mean_days from met group by all")
def period_cohorts(spark, sf_dir):
    from tidewater.functions import time

    rows = _cohorts(spark, sf_dir).withColumn("days", time.between("created", "updated", "days"))
    return rows.groupBy("version", "period", "reviewed").agg(F.count("*").alias("n"), F.round(F.avg("days"), 6).alias("mean_days"))


@query(COHORT + """, v as (select version, period, (epoch_us(updated) - epoch_us(created)) / 8.64e10 as value from met), r as (select *, rank() over (partition by version order by value) + (count(*) over (partition by version, value) - 1) / 2.0 as rk from v),
t as (select version, sum(c * c * c - c)::DOUBLE as ties from (select version, value, count(*) as c from v group by all) group by all),
u as (select version, count(*) filter (period = 'early')::DOUBLE as n1, count(*) filter (period = 'late')::DOUBLE as n2, sum(rk) filter (period = 'early')::DOUBLE as r1, avg(value) filter (period = 'early') as mean1, avg(value) filter (period = 'late') as mean2, median(value) filter (period = 'early') as median1, median(value) filter (period = 'late') as median2 from r group by all),
z as (select *, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) as z0 from u join t using (version)),
e as (select *, abs(z0) / sqrt(2.0) as x, 1 / (1 + 0.3275911 * abs(z0) / sqrt(2.0)) as q from z),
pv as (select *, ((((1.061405429 * q - 1.453152027) * q + 1.421413741) * q - 0.284496736) * q + 0.254829592) * q * exp(-x * x) as pv from e)
select version, round(pv, 6) as p_value, pv < 0.05 as differ, n1::BIGINT as n1, n2::BIGINT as n2, round(r1 - n1 * (n1 + 1) / 2, 6) as u1, round(z0, 6) as z, round(mean1, 6) as mean1, round(mean2, 6) as mean2, round(median1, 6) as median1, round(median2, 6) as median2 from pv""")
def mann_whitney(spark, sf_dir):
    from tidewater.functions import time

    rows = _cohorts(spark, sf_dir).withColumn("value", time.between("created", "updated", "days"))
    out = cohorts.mann_whitney(rows, ["version"], "period", "early", "late")
    return out.select("version", "n1", "n2", "differ", *r6("p_value", "u1", "z", "mean1", "mean2", "median1", "median2"))


SMALL = cohorts.EXACT


@query(f"""with v as (select o_custkey as owner_id, o_orderstatus = 'F' as a, o_totalprice as value from orders where o_orderstatus in ('F', 'O')),
r as (select *, rank() over (partition by owner_id order by value) + (count(*) over (partition by owner_id, value) - 1) / 2.0 as rk, count(*) over (partition by owner_id, value) as same from v),
u as (select owner_id, count(*) filter (a) as n1, count(*) filter (not a) as n2, sum(rk) filter (a) as r1, max(same) as same from r group by 1),
masks as (select n, bit_count(m)::BIGINT as n1, list_sum(list_transform(range(0, n), lambda i: case when (m >> i) & 1 = 1 then i + 1 else 0 end))::BIGINT as s from range(2, {SMALL + 1}) t(n), lateral (select unnest(range(1, (1::BIGINT << n) - 1)) as m)),
c as (select n, n1, s - n1 * (n1 + 1) // 2 as u, count(*) as c from masks group by all),
p as (select n, n1, u, least(1.0, 2.0 * least(sum(c) over (g order by u), sum(c) over (g order by u desc)) / sum(c) over g)::DOUBLE as p from c window g as (partition by n, n1))
select owner_id, u.n1, u.n2, round(r1 - u.n1 * (u.n1 + 1) / 2, 6)::DOUBLE as u1, round(p, 6) as p_value, p < 0.05 as differ
from u join p on p.n = u.n1 + u.n2 and p.n1 = u.n1 and p.u = r1 - u.n1 * (u.n1 + 1) / 2 where same = 1""")
def mann_whitney_exact(spark, sf_dir):
    """Whether a customer's finished orders cost other than open ones, by exact p-values: customers of few orders without ties."""
    rows = S.table(spark, sf_dir, "orders").filter("o_orderstatus in ('F', 'O')").select(F.col("o_custkey").alias("owner_id"), "o_orderstatus", F.col("o_totalprice").alias("value"))
    apart = rows.groupBy("owner_id").agg(F.count("*").alias("n"), F.countDistinct("value").alias("k")).filter(f"n <= {SMALL} and n = k")
    out = cohorts.mann_whitney(rows.join(apart, "owner_id", "left_semi"), ["owner_id"], "o_orderstatus", "F", "O").filter("n1 > 0 and n2 > 0")
    return out.select("owner_id", "n1", "n2", *r6("u1", "p_value"), "differ")


@query("select o_orderpriority as project, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from orders group by 1")
def project_shares(spark, sf_dir):
    return cohorts.shares(S.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "project"), "project").select("project", "n", *r6("percent"))
