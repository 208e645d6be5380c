"""Named queries of the engine: each name has a builder and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects (name, builder, oracle) entries; a name may be used once."""

    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
        def add(builder: Builder) -> Builder:
            if name in self.builders:
                raise ValueError(f"query {name} is registered twice")
            self.builders[name] = builder
            if oracle is not None:
                self.oracles[name] = oracle
            return builder

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Spark's reader resolves the path, whatever the store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; on this machine only where that is unset and nothing runs elsewhere."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="orpheon-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"
