"""Writers. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_jsonl(df: DataFrame, path: str, keys: tuple[str, ...] = ("fold", "split")) -> None:
    """JSON lines in a folder for each fold and split; rows keep both columns."""
    out = df.select("*", *(F.col(k).alias(f"_{k}") for k in keys))
    out.repartition(*(f"_{k}" for k in keys)).write.mode("overwrite").partitionBy(*(f"_{k}" for k in keys)).json(path)


def grid_csv(grid: DataFrame, path: str) -> None:
    """A condition grid, all cells in order, numbers with six digits. It has conditions x conditions rows."""
    cells = grid.select(F.col("query_cond").alias("query_program"), F.col("target_cond").alias("target_program"), F.format_string("%.6f", "map").alias("map"), "n_queries")
    cells.orderBy("query_program", "target_program").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def score_dump(histogram: DataFrame, path: str) -> None:
    """One JSON row for each cell and pool, with its bins in order."""
    bins = F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: F.struct(x["bin"].alias("bin"), x["n"].alias("n")))
    histogram.groupBy("qc", "gc", "pool").agg(bins.alias("bins")).write.mode("overwrite").json(path)


def prediction_dump(df: DataFrame, label: str, pred: str, path: str) -> None:
    """Per-class table, confusion counts and rows, in three folders."""
    from orpheon.operators.metrics import confusion, per_class

    per_class(df, label, pred).write.mode("overwrite").parquet(f"{path}/classes")
    confusion(df, label, pred).write.mode("overwrite").parquet(f"{path}/confusion")
    df.write.mode("overwrite").parquet(f"{path}/rows")


def inference_jsonl(df: DataFrame, path: str, order: str) -> None:
    """Rows in a global order: ranges of the key in numbered files."""
    df.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").json(path)


def csv_rows(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", "true").csv(path)


def embeddings(df: DataFrame, path: str, encoder: str, task: str, config: str, width: int | None = None) -> None:
    """Vectors under encoder / task / config; a vector of another width fails the write, and then nothing is written."""
    if width is not None:
        df = df.withColumn("vec", F.when(F.size("vec") != width, F.raise_error(F.lit("a vector has another width")).cast(df.schema["vec"].dataType)).otherwise(F.col("vec")))
    stamped = df.withColumns({"encoder": F.lit(encoder), "task": F.lit(task), "config_hash": F.lit(config)})
    stamped.write.mode("append").partitionBy("encoder", "task", "config_hash").parquet(path)


def cache_report(spark: SparkSession, path: str) -> DataFrame:
    """(encoder, task, config_hash, clips, files, bytes) of an embedding cache."""
    rows = spark.read.parquet(path).select("encoder", "task", "config_hash", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
    by_file = rows.groupBy("encoder", "task", "config_hash", "f").agg(F.count("*").alias("clips"), F.first("s").alias("s"))
    return by_file.groupBy("encoder", "task", "config_hash").agg(F.sum("clips").alias("clips"), F.count("*").alias("files"), F.sum("s").alias("bytes"))


def long_metrics(df: DataFrame, names: list[str], split: str) -> DataFrame:
    """(metric, value) rows of a one-row table of metrics."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{split}/{n}").alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("p")
    return df.select(pairs).select("p.metric", "p.value")
