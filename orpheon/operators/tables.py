"""Audits, deduplication, splits, samples and latest-wins selections."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failure(rules: list[tuple[str, Column]], ok: str = "ok") -> Column:
    """The name of the first rule whose condition does not hold (null counts as not)."""
    out = None
    for name, holds in rules:
        bad = ~F.coalesce(holds, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return F.lit(ok) if out is None else out.otherwise(ok)


def audit(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n) over all rows."""
    return df.groupBy(first_failure(rules).alias("reason")).agg(F.count("*").alias("n"))


def drift_class(drift: Column, small: float = 0.05, large: float = 1.0) -> Column:
    d = F.abs(drift)
    return F.when(d <= small, "ok").when(d <= large, "minor").otherwise("large")


def uniform_grid(df: DataFrame, key: str, time: str, hop: float) -> DataFrame:
    """(key, starts_at_zero, worst, ok): a grid starts within half a hop of 0 and steps within a quarter hop."""
    w = Window.partitionBy(key).orderBy(time)
    step = F.abs(F.col(time) - F.lag(time).over(w) - hop)
    each = df.withColumn("_d", step).groupBy(key).agg((F.abs(F.min(time)) <= hop / 2).alias("starts_at_zero"), F.max("_d").alias("worst"))
    return each.withColumn("ok", F.col("starts_at_zero") & (F.coalesce("worst", F.lit(0.0)) <= hop / 4))


def dedup_within_group(df: DataFrame, group: str, content: str, order: str, least: int = 2) -> DataFrame:
    """First row of each content hash in a group; groups left with fewer than `least` rows go."""
    w = Window.partitionBy(group, F.sha2(content, 256)).orderBy(order)
    kept = df.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(group))).where(F.col("_n") >= least).drop("_n")


def split_override(df: DataFrame, overrides: DataFrame, key: str, own: str) -> DataFrame:
    """split = the override's, else the row's own."""
    return df.join(overrides.select(key, F.col("split").alias("_split")), key, "left").withColumn("split", F.coalesce("_split", own)).drop("_split")


def hash_split(id: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> Column:
    """train, val or test by a hash bucket of the id; the same id always falls into the same split."""
    bucket = F.conv(F.substring(F.md5(id.cast("string")), 1, 8), 16, 10).cast("long") % 1000
    return F.when(bucket < round(1000 * ratios[0]), "train").when(bucket < round(1000 * (ratios[0] + ratios[1])), "val").otherwise("test")


def group_folds(sizes: dict[str, int], n_folds: int = 5, val_frac: float = 0.15, seed: int = 0) -> list[dict[str, str]]:
    """For each fold, group -> split, without a group in two splits.

    Groups are packed into test folds, the largest first into the smallest fold, in an order that the seed breaks;
    validation groups are drawn in a seeded order until the quota. Raises where a split would be empty. The group
    table is small by nature (groups, not rows) and lives on the driver; rows are split by joining the map."""
    names = sorted(sizes)
    if len(names) < n_folds:
        raise ValueError(f"{n_folds} folds need as many groups; there are {len(names)}")
    order = list(names)
    random.Random(seed).shuffle(order)
    order.sort(key=lambda g: -sizes[g])
    counts, fold_of = [0] * n_folds, {}
    for g in order:
        fold_of[g] = min(range(n_folds), key=lambda k: (counts[k], k))
        counts[fold_of[g]] += sizes[g]
    quota = max(1, round(val_frac * sum(sizes.values())))
    folds = []
    for k in range(n_folds):
        rest = [g for g in names if fold_of[g] != k]
        random.Random(seed * 1000 + k).shuffle(rest)
        split, taken = {g: "test" for g in names if fold_of[g] == k}, 0
        for g in rest:
            split[g] = "val" if taken < quota else "train"
            taken += sizes[g] if taken < quota else 0
        if set(split.values()) != {"train", "val", "test"}:
            raise ValueError(f"fold {k} has an empty split")
        folds.append(split)
    return folds


def round_robin_folds(names: list[str], n_folds: int = 5, seed: int = 0) -> list[dict[str, str]]:
    """Shuffled once; fold k tests every n-th name, and the last sixth of the others, two names at least, validates."""
    order = sorted(names)
    random.Random(seed).shuffle(order)
    out = []
    for k in range(n_folds):
        test = order[k::n_folds]
        rest = [x for x in order if x not in set(test)]
        n_val = max(2, len(rest) // 6)
        out.append({**dict.fromkeys(test, "test"), **dict.fromkeys(rest[:-n_val], "train"), **dict.fromkeys(rest[-n_val:], "val")})
    return out


def ratio_split(ids: list[str], seed: int = 0, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), given: dict[str, str] | None = None) -> dict[str, str]:
    """A seeded shuffle cut by ratios; ids with a given split keep it."""
    given = given or {}
    rest = sorted(x for x in ids if x not in given)
    random.Random(seed).shuffle(rest)
    a, b = int(len(rest) * ratios[0]), int(len(rest) * (ratios[0] + ratios[1]))
    return {**{x: given[x] for x in ids if x in given}, **dict.fromkeys(rest[:a], "train"), **dict.fromkeys(rest[a:b], "val"), **dict.fromkeys(rest[b:], "test")}


def assign(df: DataFrame, group: str, split_of: dict[str, str]) -> DataFrame:
    """Join a driver-side map of groups; a group that it lacks gets a null split."""
    spark = df.sparkSession
    small = spark.createDataFrame(list(split_of.items()), f"{group} string, split string")
    return df.join(F.broadcast(small), group, "left")  # one row a group


def stratified(df: DataFrame, label: str, id: str, quota: int) -> DataFrame:
    """At most `quota` rows of each class, those with the smallest hash of the id."""
    w = Window.partitionBy(label).orderBy(F.md5(F.col(id).cast("string")), id)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= quota).drop("_rk")


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """(the first n rows by an explicit order)."""
    return df.orderBy(order).limit(n)


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in columns))


def worst(df: DataFrame, measure: Column, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(F.abs(measure)), tie).limit(n)


def assert_none(df: DataFrame, what: str) -> DataFrame:
    """Fails at run time if df has a row; otherwise an empty result."""
    return df.select(F.raise_error(F.lit(what)).alias("error"))


