"""Decoders, streaming and tokeniser queries. SQL is given where it can say the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orpheon.operators import hmm as H
from orpheon.operators import tokens as K
from orpheon.plans.registry import Registry, table
from orpheon.streaming import online as S

Q = Registry()
FPS = 10.0


def _activations(spark, sf_dir, users: int | None = None):
    """A frame for each event: activation = value / 130 within (0.01, 0.99), in the user's order. users: only ids below it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events")
    if users is not None:
        e = e.where(F.col("user_id") < users)
    x = F.least(F.greatest(F.col("value") / 130, F.lit(0.01)), F.lit(0.99))
    return e.select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("frame"), x.alias("activation"))


def _series(frames):
    return frames.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "activation"))), lambda r: r["activation"]).alias("x"))


@Q.query("viterbi_discrete")
def viterbi_discrete(spark, sf_dir):
    """Hidden moods of users from their event types, under a fixed three-state model."""
    code = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", code.alias("o")))), lambda r: r["o"]).alias("obs"))
    model = ([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.0, 0.3, 0.7]], [[0.6, 0.3, 0.1], [0.2, 0.6, 0.2], [0.1, 0.2, 0.7]], [0.5, 0.3, 0.2])
    return e.select("user_id", H.decode_discrete(F.col("obs"), *model).alias("d")).select("user_id", "d.path", F.round("d.log_prob", 6).alias("log_prob"))


@Q.query("beat_tracking")
def beat_tracking(spark, sf_dir):
    return _series(_activations(spark, sf_dir)).select("key", H.beats_of(F.col("x"), FPS, min_bpm=60, max_bpm=200).alias("beats"))


@Q.query("tempo_by_count", "WITH f AS (SELECT user_id, least(greatest(value / 130, 0.01), 0.99) AS a FROM events WHERE user_id < 40) SELECT user_id AS key, round(sum((a >= 0.3)::INT) * 60 / (count(*) / 10.0::DOUBLE), 6) AS bpm FROM f GROUP BY user_id")
def tempo_by_count(spark, sf_dir):
    f = _activations(spark, sf_dir, 40)  # as the SQL has it
    return f.groupBy("key").agg(F.round(F.count_if(F.col("activation") >= 0.3) * 60 / (F.count("*") / FPS), 6).alias("bpm"))


@Q.query("tempo_by_spectrum")
def tempo_by_spectrum(spark, sf_dir):
    return _series(_activations(spark, sf_dir)).select("key", F.round(H.tempo_by_spectrum(F.col("x"), FPS), 6).alias("bpm"))


@Q.query("online_beat_tracking")
def online_beat_tracking(spark, sf_dir):
    """The online tracker over a stream of the events file; frames are numbered by event id."""
    e = S.read_events(spark, sf_dir)
    x = F.least(F.greatest(F.col("value") / 130, F.lit(0.01)), F.lit(0.99))
    frames = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("frame"), x.alias("activation"))
    return S.run_to_table(S.online_beats(frames, FPS, min_bpm=60, max_bpm=200), "append", "orpheon_online_beats")


@Q.query("windowed_stream_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_stream_counts(spark, sf_dir):
    counts = S.windowed_counts(S.read_events(spark, sf_dir).select("ts", "event_type", "value"), "ts", "event_type", "value")
    rows = S.run_to_table(counts, "complete", "orpheon_windowed_counts")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


def _scores(spark, sf_dir):
    """A small ABC tune for each part, from its words."""
    words = F.split("p_name", " ")
    body = F.concat(F.lit("|: "), F.element_at(words, 1), F.lit(" | "), F.element_at(words, -1), F.lit(" || z2 :|"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("X:1\nK:C\n"), body, F.lit("\n"), body).alias("abc"))


@Q.query("patch_tokens", "SELECT p_partkey, 8 AS n, ['X:1' || chr(10), 'K:C' || chr(10), '|: ' || string_split(p_name, ' ')[1] || ' |', ' ' || string_split(p_name, ' ')[-1] || ' ||', ' z2 :|' || chr(10), '|: ' || string_split(p_name, ' ')[1] || ' |', ' ' || string_split(p_name, ' ')[-1] || ' ||', ' z2 :|' || chr(10)] AS texts FROM part")
def patch_tokens(spark, sf_dir):
    return _scores(spark, sf_dir).select("p_partkey", K.tokenise(F.col("abc"), most=None).alias("patches")).select("p_partkey", F.size("patches").alias("n"), F.transform("patches", K.patch_text).alias("texts"))


@Q.query("bar_slices", "SELECT p_partkey, 'X:1' || chr(10) || 'K:C' || chr(10) || '|: ' || string_split(p_name, ' ')[1] || ' | ' || string_split(p_name, ' ')[-1] || ' || z2 :|' AS slice FROM part")
def bar_slices(spark, sf_dir):
    return _scores(spark, sf_dir).select("p_partkey", K.slice_bars(F.col("abc"), F.lit(2), F.lit(2)).alias("slice"))
