"""Query registry shared by ``__spark_entry__``, the bench and the tests."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_MODULES = ["curation", "shaping", "sampling_plans", "text_plans", "vector_plans", "metric_plans", "run_plans", "contrast_plans", "gate_plans", "io_plans", "stream_plans"]


def register(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"noisesift.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"noisesift.plans.{m}":
                raise
