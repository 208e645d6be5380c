"""Classification, tagging, regression, frame, event and text-distance metrics over rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from orpheon.functions.vectors import argmax, mean_vectors, sigmoid, softmax


def file_scores(clips: DataFrame, key: str, logits: str, label: str, clip: str, probabilities: bool = False) -> DataFrame:
    """Mean of the clips' logits (or of their softmax probabilities) for each file, with the first clip's label."""
    v = F.col(logits).cast("array<double>")
    pooled = mean_vectors(clips.select(key, (softmax(v) if probabilities else v).alias("v")), [key], "v", "scores")
    return pooled.join(clips.groupBy(key).agg(F.min_by(label, clip).alias(label)), key)


def accuracy(files: DataFrame, scores: str, label: str) -> DataFrame:
    return files.agg(F.count("*").alias("n"), F.avg((argmax(F.col(scores)) == F.col(label)).cast("int")).alias("accuracy"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    """class, precision, recall, f1, support; zero denominators give 0. One pass over the confusion counts."""
    c = confusion(df, label, pred)
    rows = c.select(F.col("label").alias("class"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"))
    rows = rows.union(c.select("pred", F.lit(0).cast("long"), F.lit(0).cast("long"), "n"))
    each = rows.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    each = each.select("class", precision.alias("precision"), recall.alias("recall"), "support")
    total = F.col("precision") + F.col("recall")
    return each.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def macro_f1(classes: DataFrame) -> DataFrame:
    return classes.agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_classes"))


def rank_metrics(df: DataFrame, tag: str, score: str, truth: str) -> DataFrame:
    """auroc and average precision for each tag. Ties share their mean rank (auroc) and threshold (precision).

    Rows are first added up by (tag, score), so a tag's window holds its distinct scores, not its rows."""
    by_score = df.groupBy(tag, score).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("n"))
    down = Window.partitionBy(tag).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = by_score.withColumn("tp", F.sum("p").over(down)).withColumn("k", F.sum("n").over(down))
    neg = F.col("n") - F.col("p")
    out = cum.groupBy(tag).agg(
        F.sum(neg * (F.col("tp") - F.col("p") / 2)).alias("wins"), F.sum("p").alias("pos"), F.sum(neg).alias("neg"), F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("ap")
    )
    return out.select(tag, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("wins") / (F.col("pos") * F.col("neg"))).alias("auroc"), F.when(F.col("pos") > 0, F.col("ap") / F.col("pos")).alias("ap"))


def tag_scores(clips: DataFrame, key: str, logits: str) -> DataFrame:
    """(key, tag, score): mean logits of each file, then sigmoid."""
    pooled = mean_vectors(clips.select(key, F.col(logits).cast("array<double>").alias("v")), [key], "v", "v")
    return pooled.select(key, F.posexplode(sigmoid(F.col("v"))).alias("tag", "score"))


def r2(df: DataFrame, pred: str, truth: str) -> Column:
    """1 - SSres / SStot of the mean (not the squared correlation)."""
    res = F.sum((F.col(truth) - F.col(pred)) * (F.col(truth) - F.col(pred)))
    return 1 - res / (F.count(truth) * F.var_pop(truth))


def frame_accuracy(df: DataFrame, pred: str, target: str, tolerance: int = 2, ignore: int = -1, modulo: int | None = None) -> DataFrame:
    """correct / valid frames over all rows; lengths may differ by `tolerance` and are cropped to the shorter; no valid
    frame gives 0. modulo 12 compares chroma."""
    a, b = F.col(pred), F.col(target)
    n = F.least(F.size(a), F.size(b))
    fits = F.when(F.abs(F.size(a) - F.size(b)) <= tolerance, n).otherwise(F.raise_error(F.lit("lengths differ by more than the tolerance")).cast("int"))
    pairs = F.zip_with(F.slice(a, F.lit(1), fits), F.slice(b, F.lit(1), fits), lambda x, y: F.struct(x.alias("p"), y.alias("t")))
    valid = F.filter(pairs, lambda z: z["t"] != ignore)
    same = F.filter(valid, lambda z: (F.pmod(z["p"], F.lit(modulo)) == F.pmod(z["t"], F.lit(modulo))) if modulo else z["p"] == z["t"])
    sums = df.agg(F.sum(F.size(same)).alias("correct"), F.sum(F.size(valid)).alias("valid"))
    return sums.select("correct", "valid", F.when(F.col("valid") > 0, F.col("correct") / F.col("valid")).otherwise(0.0).alias("accuracy"))


def tempo_accuracy(df: DataFrame, pred: str, ref: str, tol: float = 0.04) -> DataFrame:
    """acc1 (within tol of the reference), acc2 (also of its double, half, triple and third) and mae; none gives 0."""
    def near(k: float) -> Column:
        return F.abs(F.col(pred) - F.col(ref) * k) <= tol * F.col(ref) * k

    any_of = near(1.0)
    for k in (2.0, 0.5, 3.0, 1 / 3):
        any_of = any_of | near(k)
    zero = F.lit(0.0)
    return df.agg(F.coalesce(F.avg(near(1.0).cast("int")), zero).alias("acc1"), F.coalesce(F.avg(any_of.cast("int")), zero).alias("acc2"), F.coalesce(F.avg(F.abs(F.col(pred) - F.col(ref))), zero).alias("mae"))


def match_count(est: list[float], ref: list[float], tol: float) -> int:
    """The most one-to-one pairs within tol: greedy over sorted times, which is optimal for one fixed tolerance."""
    a, b, i, j, n = sorted(est), sorted(ref), 0, 0, 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tol:
            n, i, j = n + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return n


def matched(est: Column, ref: Column, tol: float) -> Column:
    @pandas_udf("long")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([match_count(list(x), list(y), tol) for x, y in zip(a, b, strict=True)])

    return count(est, ref)


def event_f_measure(df: DataFrame, est: str, ref: str, tol: float = 0.07) -> DataFrame:
    """Matches, estimates and references added up over rows, then F1; both empty 1, one empty 0."""
    rows = df.select(matched(F.col(est), F.col(ref), tol).alias("m"), F.size(est).alias("e"), F.size(ref).alias("r"))
    s = rows.agg(F.sum("m").alias("matched"), F.sum("e").alias("n_est"), F.sum("r").alias("n_ref"))
    f1 = F.when((F.col("n_est") == 0) & (F.col("n_ref") == 0), 1.0).when(F.col("matched") == 0, 0.0).otherwise(2 * F.col("matched") / (F.col("n_est") + F.col("n_ref")))
    return s.withColumn("f1", f1)


def boundary_metrics(df: DataFrame, id: str, ref: str, est: str, windows: tuple[float, ...] = (0.5, 3.0)) -> DataFrame:
    """For each row precision, recall and f at each window, and the median gap from each reference to its nearest estimate."""
    cols = [F.col(id)]
    both = (F.size(ref) == 0) & (F.size(est) == 0)
    for k, w in enumerate(windows):
        m = matched(F.col(est), F.col(ref), w)
        p = F.when(both, 1.0).when(F.size(est) == 0, 0.0).otherwise(m / F.size(est))
        r = F.when(both, 1.0).when(F.size(ref) == 0, 0.0).otherwise(m / F.size(ref))
        cols += [p.alias(f"p_{k}"), r.alias(f"r_{k}"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias(f"f_{k}")]
    gaps = F.array_sort(F.transform(F.col(ref), lambda t: F.array_min(F.transform(F.col(est), lambda e: F.abs(e - t)))))
    n = F.size(gaps)
    middle = (F.get(gaps, F.floor((n - 1) / 2).cast("int")) + F.get(gaps, F.floor(n / 2).cast("int"))) / 2
    return df.select(*cols, F.when((F.size(ref) > 0) & (F.size(est) > 0), middle).alias("median_gap"))


def seam_recall(seam: Column, est: Column, window: float) -> Column:
    return F.exists(est, lambda e: F.abs(e - seam) <= window)


def pairwise_f(df: DataFrame, key: list[str], ref: str, est: str) -> DataFrame:
    """Frame agreement as co-clustering: F1 over unordered frame pairs, from contingency counts (no pair is made)."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = df.groupBy(*key, ref, est).agg(F.count("*").alias("n"))
    both = cells.groupBy(*key).agg(F.sum(pairs("n")).alias("both"))
    in_ref = cells.groupBy(*key, ref).agg(F.sum("n").alias("n")).groupBy(*key).agg(F.sum(pairs("n")).alias("in_ref"))
    in_est = cells.groupBy(*key, est).agg(F.sum("n").alias("n")).groupBy(*key).agg(F.sum(pairs("n")).alias("in_est"))
    total = F.col("in_ref") + F.col("in_est")
    return both.join(in_ref, key).join(in_est, key).select(*key, F.when(total > 0, 2 * F.col("both") / total).otherwise(1.0).alias("f"))


def edits(ref: list, hyp: list) -> int:
    row = list(range(len(hyp) + 1))
    for i, a in enumerate(ref, 1):
        new = [i]
        for j, b in enumerate(hyp, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def token_edits(ref: Column, hyp: Column) -> Column:
    """Edit distance of two token arrays."""

    @pandas_udf("int")
    def plain(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    return plain(ref, hyp)


def error_rate(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """edits, tokens and rate = edits / reference tokens; an empty reference gives 0 or 1 for an empty or other hypothesis."""
    rows = df.select(token_edits(F.col(ref), F.col(hyp)).alias("e"), F.size(ref).alias("n"), F.size(hyp).alias("h"))
    s = rows.agg(F.sum("e").alias("edits"), F.sum("n").alias("tokens"), F.sum("h").alias("h"))
    return s.select("edits", "tokens", F.when(F.col("tokens") > 0, F.col("edits") / F.col("tokens")).otherwise(F.when(F.col("h") > 0, 1.0).otherwise(0.0)).alias("rate"))


def blank_share(df: DataFrame, tokens: str, blank) -> DataFrame:
    """least, most and ratio: the smallest and largest token, and the share of the blank one, over all rows' arrays."""
    one = F.filter(tokens, lambda x: x == blank)
    sums = df.agg(F.min(F.array_min(tokens)).alias("least"), F.max(F.array_max(tokens)).alias("most"), F.sum(F.size(one)).alias("b"), F.sum(F.size(tokens)).alias("n"))
    return sums.select("least", "most", F.when(F.col("n") > 0, F.col("b") / F.col("n")).otherwise(0.0).alias("ratio"))


def mean_over_clips(df: DataFrame, clip: list[str], pred: str, target: str) -> DataFrame:
    """accuracy, precision, recall and f1 of binary frames, taken clip by clip and then averaged; n_clips. A ratio
    without a denominator is 0."""
    hit = F.sum((F.col(pred) & F.col(target)).cast("int"))
    said, true = F.sum(F.col(pred).cast("int")), F.sum(F.col(target).cast("int"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = df.groupBy(*clip).agg(F.avg((F.col(pred) == F.col(target)).cast("int")).alias("accuracy"), ratio(hit, said).alias("precision"), ratio(hit, true).alias("recall"), ratio(2 * hit, said + true).alias("f1"))
    return each.agg(*(F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")), F.count("*").alias("n_clips"))


def _mixed(x):
    """A finaliser that spreads 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bootstrap_interval(df: DataFrame, correct: str, n_resamples: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of a mean: each resample weighs rows by Poisson(1) draws of a hash of (seed, resample, row).

    A row becomes (n_resamples) partial sums inside one aggregate per partition, never rows."""
    import numpy as np

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, weights = np.zeros(n_resamples), np.zeros(n_resamples)
        steps = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(12)])  # of a Poisson(1) draw
        salt = _mixed(np.arange(n_resamples, dtype=np.uint64) + np.uint64(seed << 20))
        for f in frames:
            key, value = f["key"].to_numpy().view(np.uint64), f["value"].to_numpy()
            for low in range(0, len(f), 4096):
                draw = _mixed(key[low : low + 4096, None] ^ salt[None, :]) / 2.0**64
                w = np.searchsorted(steps, draw, side="right")
                sums += value[low : low + 4096] @ w
                weights += w.sum(axis=0)
        yield pd.DataFrame({"resample": np.arange(n_resamples), "s": sums, "w": weights})

    keyed = df.select(F.xxhash64(*df.columns).alias("key"), F.col(correct).cast("double").alias("value"))
    means = keyed.mapInPandas(part, "resample int, s double, w double").groupBy("resample").agg((F.sum("s") / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))


def masked_cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits)[target]; null where the target is negative."""
    from orpheon.functions.vectors import log_sum_exp

    return F.when(target >= 0, log_sum_exp(logits) - F.get(logits, target))


def threshold_sweep(df: DataFrame, score: str, truth: str) -> DataFrame:
    """threshold, precision, recall, f1 when everything at the score or over is taken, for each distinct score."""
    by = df.groupBy(score).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # distinct scores
    total = by.agg(F.sum("p").alias("all"))
    c = by.withColumn("tp", F.sum("p").over(w)).withColumn("k", F.sum("n").over(w)).crossJoin(F.broadcast(total))  # one row
    precision, recall = F.col("tp") / F.col("k"), F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0)
    return c.select(F.col(score).alias("threshold"), precision.alias("precision"), recall.alias("recall"), (2 * F.col("tp") / (F.col("k") + F.col("all"))).alias("f1"))
