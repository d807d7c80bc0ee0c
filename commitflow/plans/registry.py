"""Collects the registered queries: name, Spark plan, and the SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def keep(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"duplicate query {name}")
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = sql
            return plan

        return keep
