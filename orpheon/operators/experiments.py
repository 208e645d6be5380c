"""Leaderboards and sweep summaries over run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_runs(runs: DataFrame, keys: list[str], priorities: list[str], summary: str) -> DataFrame:
    """Highest value of the first metric present (by priority) for each key."""
    value = F.coalesce(*(F.col(summary)[p] for p in priorities))
    return runs.withColumn("value", value).where("value is not null").groupBy(*keys).agg(F.max("value").alias("value"))


def best_layer(values: DataFrame, group: list[str], layer: str = "layer", value: str = "value") -> DataFrame:
    """Best single layer (the lowest on ties) beside the mean of all (-1), and which one wins."""
    single = values.where(F.col(layer) >= 0).groupBy(*group).agg(F.max_by(F.col(layer), F.struct(F.col(value), -F.col(layer))).alias("best_layer"), F.max(value).alias("best_value"))
    mean_all = values.where(F.col(layer) == -1).groupBy(*group).agg(F.max(value).alias("meanall"))
    winner = F.when(F.col("best_value").isNull(), "meanall").when(F.col("meanall").isNull() | (F.col("best_value") >= F.col("meanall")), "layer").otherwise("meanall")
    return single.join(mean_all, group, "full").withColumn("winner", winner)


def cross_table(best: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    return best.groupBy(row).pivot(column, columns).agg(F.max(value))


def layer_profile(values: DataFrame, group: list[str], layer: str = "layer", value: str = "value") -> DataFrame:
    """least, median, most, population std, gain and the three best layers; needs two layers."""
    ordered = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(layer).alias("l")))), 1, 3), lambda x: x["l"])
    each = values.where(F.col(layer) >= 0).groupBy(*group).agg(F.min(value).alias("least"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("most"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"), ordered.alias("top"))
    return each.where("n >= 2").withColumn("gain", F.col("most") - F.col("least"))


def gap_verdict(best: DataFrame) -> DataFrame:
    gap = (F.col("best_value") - F.col("meanall")) / F.col("meanall")
    return best.where("meanall is not null and best_value is not null").withColumn("gap", gap).withColumn("verdict", F.when(gap < 0.02, "tie").when(gap < 0.10, "small").otherwise("large"))


def consistency(best: DataFrame, by: str) -> DataFrame:
    return best.where("best_layer is not null").groupBy(by).agg(F.percentile("best_layer", 0.5).alias("median"), (F.max("best_layer") - F.min("best_layer")).alias("range"), F.count("*").alias("n"))


def fold_summary(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean and sample std over folds (0 for one fold), nulls ignored, ranked by the mean."""
    each = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))
    return each


def best_by(values: DataFrame, group: list[str], by: str, layer: str = "layer") -> DataFrame:
    """The row of each group with the highest `by` (the lowest layer on ties); rows without it do not count."""
    order = F.struct(F.col(by), -F.col(layer))
    rest = [c for c in values.columns if c not in group]
    return values.where(F.col(by).isNotNull()).groupBy(*group).agg(F.max_by(F.struct(*rest), order).alias("best")).select(*group, "best.*")


def window_layer_grid(values: DataFrame, window: str, layers: list[int], value: str, layer: str = "layer") -> DataFrame:
    """One row for each layer, one column for each window met."""
    return values.where(F.col(layer).isin(layers)).groupBy(layer).pivot(window).agg(F.max(value))


def top_k(values: DataFrame, group: list[str], value: str, tie: str, k: int, highest: bool = True) -> DataFrame:
    order = F.desc(value) if highest else F.asc(value)
    return values.withColumn("rk", F.row_number().over(Window.partitionBy(*group).orderBy(order, tie))).where(F.col("rk") <= k)


def running_best(values: DataFrame, group: list[str], epoch: str, value: str) -> DataFrame:
    """Each epoch with the best value so far and the epoch that reached it first."""
    w = Window.partitionBy(*group).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return values.withColumn("best", F.max(value).over(w)).withColumn("best_epoch", F.max_by(F.col(epoch), F.struct(F.col(value), -F.col(epoch))).over(w))


def arm_delta(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """a - b for each key; null where either is missing."""
    left, right = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    return left.join(right, keys, "full").withColumn("delta", F.col("a") - F.col("b"))


def concurrency(ram: Column, gpu: Column, ram_each: Column, gpu_each: Column, most: Column) -> Column:
    return F.greatest(F.least(F.floor(ram / ram_each), F.floor(gpu / gpu_each), most), F.lit(1))


def planned_changes(current: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """Desired rows that differ from the current ones: applying them twice changes nothing more."""
    return desired.exceptAll(current.select(*desired.columns)).join(current.select(key), key, "left_semi")


def normalised(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
