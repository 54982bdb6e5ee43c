"""Named queries with the SQL text that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import Source, sql_with_views


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[Source], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Registers a function of a :class:`Source`; ``covers`` lists the SURVEY rows it exercises."""

    def register(fn: Callable[[Source], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, covers, fn, None if oracle is None else sql_with_views(oracle))
        return fn

    return register


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.run(Source(spark, sf_dir))

    return run
