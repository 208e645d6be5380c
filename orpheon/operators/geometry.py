"""Embedding geometry: pooling, centering, whitening, component removal and anisotropy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orpheon.functions.vectors import l2_normalize, mean_vectors, norm, scale, subtract

#: The widest vector whose covariance the driver takes apart.
MAX_DIMENSION = 4096


def file_embeddings(clips: DataFrame, key: str, vec: str, clip: str, first_of: tuple[str, ...] = (), normalize_clips: bool = True) -> DataFrame:
    """One vector a file: clips normalised (or raw), averaged, normalised; other columns are the first clip's."""
    v = l2_normalize(F.col(vec).cast("array<double>")) if normalize_clips else F.col(vec).cast("array<double>")
    pooled = mean_vectors(clips.select(key, v.alias("v")), [key], "v")
    out = pooled.withColumn("vec", l2_normalize(F.col("vec")))
    if first_of:
        out = out.join(clips.groupBy(key).agg(*(F.min_by(c, clip).alias(c) for c in first_of)), key)
    return out


def center(df: DataFrame, vec: str, group: str | None = None) -> DataFrame:
    """Subtract the mean vector (of all rows or of the group) and normalise again."""
    rows = df.withColumn(vec, F.col(vec).cast("array<double>"))
    if group is None:
        mean = mean_vectors(rows.select(F.lit(0).alias("_k"), vec), ["_k"], vec, "_mean")
        joined = rows.withColumn("_k", F.lit(0)).join(F.broadcast(mean), "_k").drop("_k")  # one vector
    else:
        joined = rows.join(mean_vectors(rows.select(group, vec), [group], vec, "_mean"), group)
    return joined.withColumn(vec, l2_normalize(subtract(F.col(vec), F.col("_mean")))).drop("_mean")


def moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance), summed by partition: the driver gets one matrix for each partition's group, H x H each."""
    def part(frames):
        n, s, ss = 0, None, None
        for f in frames:
            if not len(f):
                continue
            x = np.array(f["v"].tolist(), np.float64)
            n += len(x)
            s = x.sum(0) if s is None else s + x.sum(0)
            ss = x.T @ x if ss is None else ss + x.T @ x
        if n:
            if len(s) > MAX_DIMENSION:
                raise ValueError("vectors are too wide for a covariance on the driver")
            yield pd.DataFrame({"i": np.arange(len(s) + 1), "row": [s.tolist(), *ss.tolist()], "n": n})

    sums = df.select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(part, "i long, row array<double>, n long")
    each = sums.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = each.collect()  # (H + 1) x H numbers
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    h = max(r.j for r in rows) + 1
    table = np.zeros((h + 1, h))
    for r in rows:
        table[r.i, r.j] = r.x
    n = rows[0].n
    mean = table[0] / n
    return n, mean, table[1:] / n - np.outer(mean, mean)


def _apply(df: DataFrame, vec: str, mean: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """normalise(matrix (v - mean)) as array expressions over literals of H x H numbers."""
    @F.pandas_udf("array<double>")
    def transform(v: pd.Series) -> pd.Series:
        x = (np.array(v.tolist(), np.float64) - mean) @ matrix.T
        return pd.Series(list(x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)))

    return df.withColumn(vec, transform(F.col(vec).cast("array<double>")))


#: Fixed: the share of whitening, and the relative floor of the spectrum, where there are enough samples and where not.
FULL_ALPHA, SHRUNK_ALPHA = 1.0, 0.6
NO_FLOOR, RELATIVE_FLOOR = 0.0, 1e-2


def auto_whiten_params(n_works: int, n_files: int, hidden: int) -> tuple[float, float]:
    """(alpha, relative floor) for a space of `hidden` dimensions: whitening is whole only with a work for each
    dimension, and the floor goes away only with two files for each."""
    alpha = SHRUNK_ALPHA if hidden > n_works else FULL_ALPHA
    floor = NO_FLOOR if n_files // 2 >= hidden else RELATIVE_FLOOR
    return alpha, floor


def whiten(df: DataFrame, vec: str, alpha: float = 1.0, eps_rel: float = 0.0, eps_floor: float = 1e-10) -> DataFrame:
    """ZCA: U (L + eps_rel * max)^(-alpha/2) U' (x - mean), normalised. alpha 0 is centering."""
    _, mean, cov = moments(df, vec)
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, eps_floor) + eps_rel * values.max()
    return _apply(df, vec, mean, vectors @ np.diag(values ** (-alpha / 2)) @ vectors.T)


def all_but_the_top(df: DataFrame, vec: str, k: int) -> DataFrame:
    """Centre and take out the k leading principal directions."""
    _, mean, cov = moments(df, vec)
    _, vectors = np.linalg.eigh(cov)
    top = vectors[:, vectors.shape[1] - k :]
    return _apply(df, vec, mean, np.eye(len(mean)) - top @ top.T)


def treatment(df: DataFrame, vec: str, spec: str) -> DataFrame:
    """raw, centered, abtt-K, whiten-aA or whiten-aA-erelE."""
    import re

    if spec == "raw":
        return df.withColumn(vec, l2_normalize(F.col(vec).cast("array<double>")))
    if spec == "centered":
        return center(df, vec)
    if m := re.fullmatch(r"abtt-(\d+)", spec):
        return all_but_the_top(df, vec, int(m[1]))
    if m := re.fullmatch(r"whiten-a([\d.]+?)(?:-erel([\d.e-]+))?", spec):
        return whiten(df, vec, float(m[1]), float(m[2] or 0))
    raise ValueError(f"unknown treatment: {spec}")


def anisotropy(df: DataFrame, vec: str) -> DataFrame:
    """n, mean_norm (of unit vectors' mean) and mean_cosine over all pairs, in closed form: (|sum u|^2 - n) / (n (n - 1))."""
    unit = df.select(F.lit(0).alias("k"), l2_normalize(F.col(vec).cast("array<double>")).alias("u"))
    mean = mean_vectors(unit, ["k"], "u", "m").join(unit.groupBy("k").agg(F.count("*").alias("n")), "k")
    n = F.col("n")
    squared = norm(F.col("m")) * norm(F.col("m")) * n * n
    return mean.select("n", norm(F.col("m")).alias("mean_norm"), F.when(n > 1, (squared - n) / (n * (n - 1))).otherwise(float("nan")).alias("mean_cosine"))


def spectrum(df: DataFrame, vec: str) -> dict[str, float]:
    """top1 (largest share of variance) and effective_rank (exp of the entropy of the shares)."""
    n, _, cov = moments(df, vec)
    if n < 2:
        return {"top1": float("nan"), "effective_rank": float("nan")}
    values = np.maximum(np.linalg.eigvalsh(cov), 0)
    share = values / values.sum()
    share = share[share > 0]
    return {"top1": float(share.max()), "effective_rank": float(np.exp(-(share * np.log(share)).sum()))}


def select_layers(df: DataFrame, layer: str, wanted: list[int | str]) -> DataFrame:
    """Rows of these layers: numbers, or "a..b" for a range with both ends."""
    numbers: list[int] = []
    for w in wanted:
        if isinstance(w, str) and ".." in w:
            a, b = w.split("..")
            numbers += range(int(a), int(b) + 1)
        else:
            numbers.append(int(w))
    return df.where(F.col(layer).isin(numbers))


def mix_layers(df: DataFrame, keys: list[str], layer: str, vec: str, mode: str = "mean", weights: list[float] | None = None) -> DataFrame:
    """Layers of a clip as one vector: mean, sum, concat (in layer order) or softmax of fixed weights."""
    v = F.col(vec).cast("array<double>")
    if mode == "mean":
        return mean_vectors(df.select(*keys, v.alias(vec)), keys, vec)
    if mode == "concat":
        ordered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(layer, v.alias("v")))).alias("l"))
        return ordered.select(*keys, F.flatten(F.transform("l", lambda x: x["v"])).alias("vec"))
    if mode == "softmax":
        w = np.exp(np.array(weights) - max(weights))
        share = F.element_at(F.array(*(F.lit(float(x)) for x in w / w.sum())), (F.col(layer) + 1).cast("int"))
        rows = df.select(*keys, layer, scale(v, share).alias(vec))
    elif mode == "sum":
        rows = df.select(*keys, v.alias(vec))
    else:
        raise ValueError(f"unknown mode: {mode}")
    each = rows.select(*keys, F.posexplode(vec).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l")).select(*keys, F.transform("l", lambda p: p["x"]).alias("vec"))


def adaptive_pool(v: Column, size: Column, target: int) -> Column:
    """Average into `target` bins of sizes as even as can be: bin k has [floor(k n / t), ceil((k + 1) n / t))."""
    ks = F.sequence(F.lit(0), F.lit(target - 1))

    def one(k):
        a = F.floor(k * size / target)
        b = F.ceil((k + 1) * size / target)
        return F.aggregate(F.slice(v, (a + 1).cast("int"), (b - a).cast("int")), F.lit(0.0), lambda s, x: s + x) / (b - a)

    return F.transform(ks, one)


def interpolate(v: Column, size: Column, target: int) -> Column:
    """Linear resampling to `target` points, sample centres aligned (no aligned corners)."""

    def one(k):
        x = F.greatest(F.lit(0.0), (k + 0.5) * size / target - 0.5)
        a = F.floor(x)
        b = F.least(a + 1, size - 1)
        left, right = F.get(v, a.cast("int")), F.get(v, b.cast("int"))
        return left + (right - left) * (x - a)

    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), one)
