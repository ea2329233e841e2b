"""Registration of queries: a Spark builder, the operators it exercises, and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from evidencelake.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """The driver tables of one directory, read lazily by attribute."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = configure(spark)
        self.root = root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Registered:
    name: str
    operators: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a builder under its own name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Registered(name, operators, build, sql)
        return build

    return register


def load_all() -> dict[str, Registered]:
    """Import every module that registers queries."""
    from evidencelake.plans import (  # noqa: F401
        digest_queries,
        log_queries,
        metric_queries,
        sink_queries,
        source_queries,
        store_queries,
        text_queries,
    )

    return REGISTRY
