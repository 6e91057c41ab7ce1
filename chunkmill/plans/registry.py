"""Registry of named queries: a Spark builder and, where SQL can express it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle.strip() if oracle else None, ids)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    from . import q_chunking, q_store, q_merge, q_browse, q_samples, q_sources, q_inventory, q_streaming  # noqa: F401

    return REGISTRY
