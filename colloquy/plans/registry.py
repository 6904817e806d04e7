"""Catalog of runnable queries and the SQL that states the same result."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None, views=()):
    """Register ``fn(spark, sf_dir)``; ``sql`` may start with its own WITH list."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _compose(sql, views)
        return fn

    return wrap


def _compose(sql, views):
    from colloquy.plans.oracle_views import cte_list

    body = sql.strip()
    ctes = cte_list(views)
    if not ctes:
        return body
    upper = body[:15].upper()
    if upper.startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ctes + ",\n" + body[14:].lstrip()
    if upper.startswith("WITH"):
        return "WITH " + ctes + ",\n" + body[4:].lstrip()
    return "WITH " + ctes + "\n" + body
