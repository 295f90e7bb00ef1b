"""Registry of the bound queries: name -> (plan builder, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Plan, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return register
