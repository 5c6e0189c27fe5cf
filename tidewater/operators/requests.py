"""Review requests that are still open at a time.

A request is done as soon as some confirmation comes strictly after a revision that itself comes strictly after the
request. So each request looks for the first revision after it, and then for the first confirmation after that: two
forward as-of steps instead of a state machine. A confirmation that is also a request stays open as a request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.asof import next_after


def request_states(messages: DataFrame, revisions: DataFrame, key: str = "change_number") -> DataFrame:
    """messages: key, ts, is_request, is_confirmation (bots removed); revisions: key, ts. Returns each request with done_at (null if open)."""
    asked = messages.filter("is_request").select(key, F.col("ts").alias("asked_at"))
    uploaded = next_after(asked, revisions.select(key, "ts"), key, "asked_at", "ts", "uploaded_at")
    waiting = uploaded.filter("uploaded_at is not null")
    confirmed = next_after(waiting, messages.filter("is_confirmation").select(key, "ts"), key, "uploaded_at", "ts", "done_at")
    return confirmed.unionByName(uploaded.filter("uploaded_at is null"), allowMissingColumns=True).select(key, "asked_at", "uploaded_at", "done_at")


def open_requests(messages: DataFrame, revisions: DataFrame, t: str | None = None, key: str = "change_number") -> DataFrame:
    """key, n_open, n_done over all events, or over those at or before a time."""
    if t is not None:
        limit = F.lit(t).cast("timestamp_ntz")
        messages, revisions = messages.filter(F.col("ts") <= limit), revisions.filter(F.col("ts") <= limit)
    states = request_states(messages, revisions, key)
    return states.groupBy(key).agg(F.count_if(F.col("done_at").isNull()).alias("n_open"), F.count("done_at").alias("n_done"))
