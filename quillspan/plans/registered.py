"""A register of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans.fixtures import sql, view

Build = Callable[..., DataFrame]


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, *views: str, oracle: str | None = None, oracle_views: tuple[str, ...] | None = None) -> Callable[[Build], Build]:
        """Register a function of the named views; `oracle` is DuckDB SQL over the same views unless others are named."""

        def put(build: Build) -> Build:
            self.queries[name] = lambda spark, sf_dir: build(*(view(spark, sf_dir, v) for v in views))
            if oracle is not None:
                self.sql[name] = sql(oracle, *(v for v in (oracle_views if oracle_views is not None else views) if v in _views()))
            return build

        return put


def _views() -> dict:
    from quillspan.plans.fixtures import VIEWS

    return VIEWS
