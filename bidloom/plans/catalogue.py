"""Every registered query of the quote engine and its SQL equivalent."""

from __future__ import annotations

from bidloom.plans import jobs, links, names, quotes, reports, responses, runs, stores, web

MODULES = (quotes, reports, web, names, responses, jobs, stores, links, runs)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
