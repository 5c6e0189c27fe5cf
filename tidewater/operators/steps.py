"""Step functions of time: sums of deltas up to any instant, in two levels, so that no key is one task.

Time is cut into blocks. A block's deltas are added up, and a window over a key's blocks (few rows) carries their sum
into every later one as a row of its own; a window inside each block of each key does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import time

DAY = 86_400_000_000  # microseconds


def sums_until(probes: DataFrame, deltas: DataFrame, keys: list[str], columns: list[str], block_days: float = 7) -> DataFrame:
    """keys, t and, for each of the columns, its sum over deltas (keys, at, columns) at or before t. probes: keys, t, made distinct.

    0 where nothing came before; deltas without a time don't count, probes without one are left out. keys may be empty.
    """
    width = int(block_days * DAY)
    block = F.floor(F.col("_s") / F.lit(width)).cast("long").alias("_block")
    none = F.lit(None).cast("timestamp_ntz").alias("t")
    zero = [F.lit(0).cast("long").alias(c) for c in columns]
    # Combined before the shuffle: an instant that recurs is one row.
    made = deltas.filter("at is not null").withColumn("_s", time.micros("at")).groupBy(*keys, "_s").agg(*(F.sum(c).cast("long").alias(c) for c in columns)).select(*keys, block, "_s", none, *columns)
    asked = probes.filter("t is not null").select(*keys, "t").distinct().withColumn("_s", time.micros("t")).select(*keys, block, "_s", "t", *zero)
    both = made.union(asked)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*keys, "_block").agg(*(F.sum(c).alias(c) for c in columns))  # a row per key and block
    carried = blocks.select(*keys, "_block", (F.col("_block") * F.lit(width) - 1).alias("_s"), none, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(c) for c in columns))
    # At equal instants deltas come before probes.
    within = Window.partitionBy(*keys, "_block").orderBy("_s", F.col("t").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.union(carried).withColumns({c: F.sum(c).over(within) for c in columns}).filter("t is not null").select(*keys, "t", *columns)
