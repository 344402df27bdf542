"""The registry of queries: each with its Spark plan and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its name, with the SQL that must agree."""

    def register(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql is not None:
            ORACLE[plan.__name__] = sql
        return plan

    return register
