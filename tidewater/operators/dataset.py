"""Records (change, t, features, label, bin) and splits into training and evaluation that no change crosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import time
from tidewater.functions.math import layer_quota
from tidewater.sources.scratch import written

#: Labels by name, as expressions over t and a record's columns; null labels are censored records. More can be added.
LABELS = {"time_to_next_review": lambda unit: time.label_value("t", "next_review", unit), "time_to_decision": lambda unit: time.label_value("t", "decision_time", unit)}

# The order of the features in a vector.
FEATURES = [
    "bug_fix_confidence", "lines_added", "lines_deleted", "files_changed", "elapsed_time", "revision_count", "test_code_presence", "refactoring_confidence",
    "past_report_count", "recent_report_count", "merge_rate", "recent_merge_rate", "days_to_major_release", "open_ticket_count", "reviewed_lines_in_period",
]


def labelled(records: DataFrame, label: str, unit: str = "hours") -> DataFrame:
    return records.withColumn("label", LABELS[label](unit)).filter("label is not null")


def with_bins(records: DataFrame, start: Column, end: Column, bins: int = 6, mode: str = "equal_time") -> DataFrame:
    if mode != "equal_time":
        raise NotImplementedError(mode)
    return records.withColumn("bin", time.bin_index(F.col("t"), start, end, bins))


def span_bins(spans: DataFrame, start: Column, end: Column, bins: int = 6) -> DataFrame:
    """spans (_first, _last), cut at the bins of with_bins(): a row per bin in which a span has a midnight."""
    # Differences of times are dear: those of a span's cycle are taken once, and days are numbers. It is bin_index() of midnights, digit for digit.
    of = lambda day: F.floor((day * F.lit(86400.0) - F.col("_start")) / F.col("_width")).cast("int")
    rows = spans.withColumns({"_start": time.epoch(start), "_end": time.epoch(end), "_lo": F.unix_date(F.col("_first").cast("date")), "_hi": F.unix_date(F.col("_last").cast("date"))})
    rows = rows.withColumn("_width", (F.col("_end") - F.col("_start")) / F.lit(float(bins))).withColumns({"_a": of(F.col("_lo")), "_b": of(F.col("_hi"))}).filter("_a is not null")
    rows = rows.withColumn("bin", F.explode(F.sequence("_a", "_b")))
    # The first day of a bin by its width; rounding may miss it by one, so the bin of the days around decides.
    for at, bin in (("_d", F.col("bin")), ("_e", F.col("bin") + 1)):
        near = F.ceil((F.col("_start") + bin * F.col("_width")) / 86400.0).cast("int")
        rows = rows.withColumn(at, near).withColumn(at, F.when(of(F.col(at) - 1) >= bin, F.col(at) - 1).when(of(F.col(at)) < bin, F.col(at) + 1).otherwise(F.col(at)))
    rows = rows.withColumns({"_lo": F.greatest("_lo", "_d"), "_hi": F.least(F.col("_hi"), F.col("_e") - 1)}).filter("_lo <= _hi")
    return rows.withColumns({"_first": time.midnight(F.col("_lo")), "_last": time.midnight(F.col("_hi"))}).select(*spans.columns, "bin")


def span_days(spans: DataFrame) -> DataFrame:
    """spans with a row per midnight t."""
    return spans.withColumn("t", F.explode(F.sequence("_first", "_last", F.expr("interval 1 day")))).drop("_first", "_last")


def cells(bins: int = 6) -> list[tuple[int, int, int, int]]:
    """p, d (from 1), training bin, evaluation bin of every cell: distances 1 to bins, positions 1 to bins."""
    return [(p + 1, d, p - d, p) for p in range(bins) for d in range(1, bins + 1)]


def layers(records: DataFrame, pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, d, p, change_id, layer: 1 only in the training bin, 2 in both, 3 only in the evaluation bin. pairs: d, p, i, j (few rows). keys tell releases apart.

    A change's bins come together as bits of one row, so that what is grouped are changes; cells multiply them afterwards.
    """
    keys, cells = keys or [], pairs.select("d", "p", "i", "j").collect()  # the design, which doesn't grow with the tables
    known = sorted({b for c in cells for b in (c.i, c.j)})
    at = {b: (k // 62, 1 << k % 62) for k, b in enumerate(known)}  # the word and bit of a bin
    bits = records.sparkSession.createDataFrame([(c.d, c.p, *at[c.i], *at[c.j]) for c in cells], "d int, p int, _wi int, _bi long, _wj int, _bj long")
    own = F.create_map(*(F.lit(x) for b, (_, bit) in at.items() for x in (b, bit))) if at else F.lit(None).cast("map<int,bigint>")
    place = F.create_map(*(F.lit(x) for b, (word, _) in at.items() for x in (b, word))) if at else F.lit(None).cast("map<int,int>")
    marked = records.select(*keys, "change_id", F.try_element_at(own, F.col("bin")).alias("_bit"), F.try_element_at(place, F.col("bin")).alias("_word")).filter("_bit is not null")
    held = marked.groupBy(*keys, "change_id").agg(*(F.coalesce(F.bit_or(F.when(F.col("_word") == w, F.col("_bit"))), F.lit(0).cast("long")).alias(f"_w{w}") for w in range(max(1, -(-len(known) // 62)))))
    # Cells multiply what came together in few partitions because it was small, so it is dealt out again (by all columns: by the
    # keys of the grouping alone Spark would leave it where it is).
    held = held.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), *held.columns)
    words = F.array(*(c for c in held.columns if c.startswith("_w")))
    met = held.select(*keys, "change_id", words.alias("_words")).crossJoin(F.broadcast(bits))
    met = met.select(*keys, "d", "p", "change_id", *((F.get("_words", F.col(f"_w{x}")).bitwiseAND(F.col(f"_b{x}")) != 0).alias(f"_{x}") for x in "ij"))
    return met.filter("_i or _j").select(*keys, "d", "p", "change_id", F.when(~F.col("_j"), 1).when(~F.col("_i"), 3).otherwise(2).alias("layer"))


def quotas(layered: DataFrame, n_train: int, n_eval: int, keys: list[str] | None = None) -> DataFrame:
    """keys, d, p, n1, n2, n3, t1, t2, e3, e2 (how many changes each layer gives) and ok: false where a layer holds too few."""
    n = layered.groupBy(*(keys or []), "d", "p").agg(*(F.count_if(F.col("layer") == k).alias(f"n{k}") for k in (1, 2, 3)))
    t1 = F.when(F.col("n1") + F.col("n2") > 0, layer_quota(F.lit(float(n_train)), F.col("n1"), F.col("n2")))
    e3 = F.when(F.col("n3") + F.col("n2") > 0, layer_quota(F.lit(float(n_eval)), F.col("n3"), F.col("n2")))
    q = n.withColumns({"t1": t1, "e3": e3}).withColumns({"t2": F.lit(n_train) - F.col("t1"), "e2": F.lit(n_eval) - F.col("e3")})
    return q.withColumn("ok", F.coalesce(F.expr("t1 <= n1 and e3 <= n3 and t2 >= 0 and e2 >= 0 and t2 + e2 <= n2"), F.lit(False)))


def split(layered: DataFrame, n_train: int, n_eval: int, repeats: int = 1, seed: int = 42, keys: list[str] | None = None, slack: float = 6.0) -> DataFrame:
    """keys, d, p, repeat, change_id, side (train or eval): changes in the order of md5(seed + repeat, id), the first ones of each layer.

    A layer is thinned before it is put in order: as its size is known, a bound on the md5 keeps a few more changes than
    are wanted. Where it kept too few (a chance of about 1e-9 at the given slack), that layer is taken whole.
    """
    cell = [*(keys or []), "d", "p"]
    q = written(quotas(layered, n_train, n_eval, keys).filter("ok"), "quotas")
    take = F.when(F.col("layer") == 1, F.col("t1")).when(F.col("layer") == 2, F.col("t2") + F.col("e2")).otherwise(F.col("e3"))
    size = F.when(F.col("layer") == 1, F.col("n1")).when(F.col("layer") == 2, F.col("n2")).otherwise(F.col("n3"))
    rows = layered.join(F.broadcast(q), cell).withColumn("_take", take).filter("_take > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))  # q: a row per cell; cells multiply what is on the other side, whose estimated size says nothing
    draw = F.md5(F.concat_ws("-", (F.lit(seed) + F.col("repeat")).cast("string"), F.col("change_id").cast("string")))
    share = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    bound = (F.col("_take") + F.lit(slack) * F.sqrt("_take") + F.lit(slack * slack)) / size
    rows = rows.withColumn("_draw", draw).withColumn("_low", share < bound).select(*cell, "repeat", "layer", "change_id", "_draw", "_low", "_take", "t1", "t2", "e2", "e3")
    layer = [*cell, "repeat", "layer"]
    low = written(rows.filter("_low"), "drawn")  # a few more than are wanted, so that changes meet all cells once
    wanted = F.array(*(F.struct(F.lit(k).alias("layer"), n.alias("_take")) for k, n in ((1, F.col("t1")), (2, F.col("t2") + F.col("e2")), (3, F.col("e3")))))
    asked = q.withColumn("_l", F.explode(wanted)).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    asked = asked.select(*cell, "repeat", "_l.*").join(low.groupBy(*layer).agg(F.count("*").alias("_n")), layer, "left")
    short = written(asked.filter("coalesce(_n, 0) < _take").select(*layer), "short")  # no rows, as a rule
    kept = low if short.isEmpty() else low.unionByName(rows.filter("not _low").join(F.broadcast(short), layer, "left_semi"))
    ranked = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*layer).orderBy("_draw", "change_id"))).filter(F.col("_n") <= n_train + n_eval)
    train = F.expr("(layer = 1 and _n <= t1) or (layer = 2 and _n <= t2)")
    evaluate = F.expr("(layer = 3 and _n <= e3) or (layer = 2 and _n > t2 and _n <= t2 + e2)")
    return ranked.withColumn("side", F.when(train, "train").when(evaluate, "eval")).filter("side is not null").select(*cell, "repeat", "change_id", "side")


def samples(records: DataFrame, chosen: DataFrame, pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The chosen changes' records: training rows of the training bin, evaluation rows of the evaluation bin; weight 1 / rows of the change in its training set.

    Records may be spans (_first, _last) in place of days: the days of chosen ones are made here.
    """
    sides = pairs.select("d", "p", F.explode(F.array(F.struct(F.lit("train").alias("side"), F.col("i").alias("bin")), F.struct(F.lit("eval").alias("side"), F.col("j").alias("bin")))).alias("x")).select("d", "p", "x.*")
    keys = keys or []
    # Days multiply records after their size was estimated, so Spark would take them for small.
    rows = chosen.join(sides, ["d", "p", "side"]).join(records.hint("merge"), [*keys, "change_id", "bin"])
    rows = span_days(rows) if "_first" in records.columns else rows
    own = Window.partitionBy(*keys, "d", "p", "repeat", "side", "change_id")
    return rows.withColumn("weight", F.when(F.col("side") == "train", F.lit(1.0) / F.count("*").over(own)))
