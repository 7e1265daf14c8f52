"""All registered queries of the retrieval and concept-graph operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans import queries_build, queries_flow, queries_graph, queries_store, queries_text

_ALL = (queries_text.register, queries_graph.register, queries_build.register, queries_store.register, queries_flow.register)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["p2_hybrid_retrieval"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for r in _ALL for name, query in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for r in _ALL for name, text in r.sql.items()}
