"""Time alignment: clips, points in clips, as-of and interval joins, frame labels.

Point-in-clip and interval-in-frame joins are arithmetic (a clip or frame number is computed and exploded), never a
range join; as-of joins are one window over the union of both sides, so no side is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling_clips(frames_total: Column, clip_frames: Column, min_ratio: float = 1.0, at_least_one: bool = False) -> Column:
    """How many clips a recording has: whole ones, and the rest if it reaches the ratio."""
    whole = F.floor(frames_total / clip_frames)
    n = whole + F.when((frames_total % clip_frames) / clip_frames >= min_ratio, 1).otherwise(0)
    n = F.when((frames_total > 0) & (clip_frames > 0), n).otherwise(0)
    return F.greatest(n, F.lit(1)) if at_least_one else n


def explode_clips(df: DataFrame, n: Column, name: str = "slice") -> DataFrame:
    return df.withColumn("_n", n.cast("int")).where("_n > 0").withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def sliding_chunks(total: Column, window: int, overlap: float, last: str = "pad") -> Column:
    """Starts of windows of step window * (1 - overlap). last: "pad" keeps a short one, "overlap" moves it back, "discard" drops it."""
    step = max(1, int(window * (1 - overlap)))
    full = F.when(total >= window, F.transform(F.sequence(F.lit(0), F.floor((total - window) / step).cast("int")), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    covered = F.when(F.size(full) > 0, F.element_at(full, -1) + window).otherwise(0)
    if last == "discard":
        return full
    extra = F.greatest(total - window, F.lit(0)) if last == "overlap" else F.when(F.size(full) > 0, F.element_at(full, -1) + step).otherwise(0)
    return F.when(covered < total, F.concat(full, F.array(extra.cast("int")))).otherwise(full)


def bar_windows(max_bar: Column, window: int, stride: int) -> Column:
    """(first, last) bar spans, both ends included; a short piece is one span; a window of one or less is every bar."""
    if window <= 1:
        return F.transform(F.sequence(F.lit(1), max_bar), lambda b: F.struct(b.alias("first"), b.alias("last")))
    starts = F.sequence(F.lit(1), max_bar - window + 1, F.lit(stride))
    many = F.transform(starts, lambda b: F.struct(b.alias("first"), (b + window - 1).alias("last")))
    return F.when(max_bar > window, many).otherwise(F.array(F.struct(F.lit(1).alias("first"), max_bar.alias("last"))))


def events_in_clips(events: DataFrame, time: str, seconds: float, rate: float) -> DataFrame:
    """Each event with its clip and frame: clip = floor(t / seconds), frame = rint((t - start) * rate)."""
    clip = F.floor(F.col(time) / seconds)
    return events.withColumn("clip", clip).withColumn("frame", F.rint((F.col(time) - clip * seconds) * rate).cast("int"))


def as_of(points: DataFrame, marks: DataFrame, key: str, time: str, value: str, default=None, strict: bool = False, tolerance: float = 0.0) -> DataFrame:
    """points with the value of the last mark of the same key at or before (strictly before, if strict) their time;
    marks may be later by up to the tolerance (by less, if strict).

    Both sides meet in one window per key: union, sort, carry the last value forward."""
    order = F.lit(1 if strict else 0)
    m = marks.select(F.col(key), (F.col(time) - tolerance).alias(time) if tolerance else F.col(time), F.col(value).alias("_value"), F.lit(True).alias("_mark"), order.alias("_order"))
    p = points.withColumn("_value", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_mark", F.lit(False)).withColumn("_order", F.lit(0 if strict else 1))
    w = Window.partitionBy(key).orderBy(time, "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(m, allowMissingColumns=True).withColumn("_seen", F.last("_value", ignorenulls=True).over(w))
    seen = F.col("_seen") if default is None else F.coalesce("_seen", F.lit(default))
    return both.where("not _mark").withColumn(value, seen).drop("_value", "_mark", "_order", "_seen")


def required(found: DataFrame, value: str) -> DataFrame:
    """The rows as they are, but a run-time error where one has no value."""
    said = F.raise_error(F.lit(f"no mark applies: {value}")).cast(found.schema[value].dataType)
    return found.withColumn(value, F.coalesce(F.col(value), said))


def score_bridge(score: DataFrame, points: DataFrame, piece: str, digits: int = 3) -> DataFrame:
    """(piece, id, point): notes of a score and the points of the same piece, pitch and time, once the points are shifted.

    score: piece, id, pitch, t; points: piece, point, pitch, t. A piece's shift is the most frequent difference of times
    between a point and a note of one pitch (the smallest of equally frequent ones); equal times are counted before they
    are compared, so copies make no pairs."""
    a = score.groupBy(piece, "pitch", "t").agg(F.count("*").alias("n"))
    b = points.groupBy(piece, "pitch", F.col("t").alias("u")).agg(F.count("*").alias("m"))
    apart = a.join(b, [piece, "pitch"]).groupBy(piece, F.round(F.col("u") - F.col("t"), digits + 1).alias("d")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    shift = apart.groupBy(piece).agg(F.min_by("d", F.struct(-F.col("n"), F.col("d"))).alias("d"))
    keyed = score.join(shift, piece).withColumn("at", F.round(F.col("t") + F.col("d"), digits)).drop("t", "d")
    return keyed.join(points.withColumn("at", F.round("t", digits)).drop("t"), [piece, "pitch", "at"]).select(piece, "id", "point")


def chord_frames(frames: DataFrame, chords: DataFrame, key: str, none: int = 24) -> DataFrame:
    """Frame labels of clips: (key, clip, frame, t, chord).

    frames: key, clip, clip_start, frame, t; chords: key, start, chord. Inside a clip a no-chord segment takes the
    label of the segment before it; only a leading one stays."""
    w = Window.partitionBy(key).orderBy("start")
    marks = chords.withColumn("before", F.lag("chord").over(w)).withColumn("prior_start", F.lag("start").over(w))
    carried = as_of(frames, marks.select(F.col(key), F.col("start").alias("t"), F.struct("start", "chord", "before").alias("m")), key, "t", "m")
    inside = F.col("m.start") > F.col("clip_start")
    label = F.when((F.col("m.chord") == none) & inside, F.coalesce("m.before", F.lit(none))).otherwise(F.coalesce("m.chord", F.lit(none)))
    return carried.select(key, "clip", "frame", "t", label.cast("int").alias("chord"))


def paint_notes(notes: DataFrame, key: list[str], length: int, rate: float) -> DataFrame:
    """(keys, frame, pitch): frames [floor(on * rate), ceil(off * rate)) of each note, clipped to [0, length); the
    note that comes last in `no` wins. notes: keys, onset, offset, pitch, no."""
    a = F.greatest(F.floor(F.col("onset") * rate), F.lit(0)).cast("int")
    b = F.least(F.ceil(F.col("offset") * rate), F.lit(length)).cast("int")
    each = notes.withColumn("_a", a).withColumn("_b", b).where("_a < _b").select(*key, "pitch", "no", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("frame"))
    return each.groupBy(*key, "frame").agg(F.max_by("pitch", "no").alias("pitch"))


def sampled_label(samples: Column, k: Column, start: Column, rate: float, label_rate: float, none: int = -1) -> Column:
    """samples[rint((start + (k + 1/2) / label_rate) * rate)], or none outside."""
    return F.coalesce(F.get(samples, F.rint((start + (k + 0.5) / label_rate) * rate).cast("int")), F.lit(none))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)


def interval_overlap_join(a: DataFrame, b: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of overlapping intervals of one key; a, b: key, id, start, end. Both are dealt into buckets of `width`
    and a pair is reported in the bucket of its later start only."""
    def bucketed(df, p):
        return df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in ("id", "start", "end")), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bucket"))

    j = bucketed(a, "a").join(bucketed(b, "b"), [key, "bucket"])
    j = j.where(overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    return j.where(F.col("bucket") == F.floor(F.greatest("a_start", "b_start") / width)).drop("bucket")


def clip_to_window(on: Column, off: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A note cut to [start, end) and counted from start."""
    return F.greatest(on, start) - start, F.least(off, end) - start


def clamp_onsets(on: Column, duration: Column) -> tuple[Column, Column]:
    """(onset, duration) with what lies before 0 cut off."""
    return F.greatest(on, F.lit(0.0)), F.when(on < 0, duration + on).otherwise(duration)


def widen(events: Column, n: int) -> Column:
    """0.5 ** distance to the nearest event within n, else 0; events are 1."""
    idx = F.sequence(F.lit(0), F.size(events) - 1)
    hits = F.filter(F.transform(events, lambda x, i: F.when(x > 0, i).otherwise(-1)), lambda i: i >= 0)
    return F.transform(idx, lambda i: F.coalesce(F.array_max(F.transform(hits, lambda h: F.when(F.abs(h - i) <= n, F.pow(F.lit(0.5), F.abs(h - i))).otherwise(0.0))), F.lit(0.0)))


def heat_map(frames: Column, length: int, sigma: float) -> Column:
    """Sum of Gaussian bumps at the frames, clipped to [0, 1]."""
    def at(i):
        return F.aggregate(frames, F.lit(0.0), lambda s, c: s + F.exp(-0.5 * F.pow((i - c) / F.lit(sigma), 2)))

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.least(F.greatest(at(i), F.lit(0.0)), F.lit(1.0)))


def main_segment(activations: Column, threshold: float) -> Column:
    """From the first to the last value at the threshold or over; empty if there is none."""
    at = F.filter(F.transform(activations, lambda x, i: F.when(x >= threshold, i).otherwise(-1)), lambda i: i >= 0)
    first, last = F.get(at, F.lit(0)), F.element_at(at, -1)
    return F.when(F.size(at) > 0, F.slice(activations, first + 1, last - first + 1)).otherwise(F.slice(activations, 1, 0))


def peaks(values: Column, threshold: float, min_distance: int) -> Column:
    """Local maxima (not below either neighbour, above one) at the threshold or over; of close ones the higher stays.

    Candidates are taken in the order of falling value (then rising place); one stays if no kept one is closer than
    min_distance."""
    low = F.lit(float("-inf"))

    def candidate(x, i):
        left, right = F.coalesce(F.get(values, i - 1), low), F.coalesce(F.get(values, i + 1), low)
        ok = (x >= threshold) & (x >= left) & (x >= right) & ((x > left) | (x > right))
        return F.when(ok, F.struct((-x).alias("v"), i.alias("i")))

    ordered = F.array_sort(F.filter(F.transform(values, candidate), lambda c: c.isNotNull()))
    none = F.array().cast("array<int>")
    kept = F.aggregate(ordered, none, lambda s, c: F.when(F.exists(s, lambda k: F.abs(k - c["i"]) < min_distance), s).otherwise(F.concat(s, F.array(c["i"]))))
    return F.sort_array(kept)


def runs(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Gaps and islands: maximal runs of equal values: keys, run, value, first, last, n."""
    w = Window.partitionBy(*key).orderBy(order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    numbered = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return numbered.groupBy(*key, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
