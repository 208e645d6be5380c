"""User code: encoders, decoders, transforms, metrics and tasks by dotted class path."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def load(class_path: str, **init_args):
    """An object of a dotted class path."""
    module, _, name = class_path.rpartition(".")
    if not module:
        raise ValueError(f"not a class path: {class_path}")
    return getattr(importlib.import_module(module), name)(**init_args)


def encode(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """An encoder or decoder over batches of rows; `make` builds it once in each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = make()
        for batch in batches:
            yield apply(batch)

    return df.mapInPandas(run, schema)


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Transforms in order, as one."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


class Metric:
    """A user's aggregate: update() folds a batch into a state, merge() joins two states, compute() ends it.

    Each partition folds its own rows and gives one state; the states of all partitions meet in one row."""

    def start(self) -> dict:
        raise NotImplementedError

    def update(self, state: dict, batch: pd.DataFrame) -> dict:
        raise NotImplementedError

    def merge(self, a: dict, b: dict) -> dict:
        return {k: a[k] + b[k] for k in a}

    def compute(self, state: dict) -> float:
        raise NotImplementedError


def measure(df: DataFrame, metric: Metric) -> float:
    """The metric over all rows; states, not rows, reach the driver: one for each partition."""
    import json

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = metric.start()
        for batch in batches:
            state = metric.update(state, batch)
        yield pd.DataFrame({"state": [json.dumps(state)]})

    state = metric.start()
    for row in df.mapInPandas(fold, "state string").toLocalIterator():
        state = metric.merge(state, json.loads(row.state))
    return metric.compute(state)


class Tasks:
    """Named tasks: functions of (spark, sf_dir)."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def task(self, name: str):
        def add(fn):
            self.known[name] = fn
            return fn

        return add

    def run(self, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.known[name](spark, sf_dir)
