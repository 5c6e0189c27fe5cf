"""Queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from functools import wraps

from tidewater.sources.workers import reachable

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        @wraps(f)
        def run(spark, sf_dir):
            reachable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return run

    return add
