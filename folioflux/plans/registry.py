"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflux.plans import ledger_queries as ledger
from folioflux.plans import page_queries as pages
from folioflux.plans import trace_queries as traces


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": ledger.p1_found, "p1_coverage": ledger.p1_coverage, "p3_found": ledger.p3_found, "p3_hierarchy": ledger.p3_hierarchy, "p3_descendants": ledger.p3_descendants, "p3_all_descendants": ledger.p3_all_descendants, **traces.queries(), **pages.queries()}


def oracle_sql() -> dict[str, str]:
    return {**ledger.P1_SQL, **ledger.P3_SQL, **traces.SQL, **pages.SQL}
