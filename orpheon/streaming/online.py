"""Structured Streaming: an online beat tracker with keyed state, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orpheon.operators.hmm import BeatModel, forward_step

STATE = "alpha array<double>, counter long, last_beat double"
BEATS = "key long, time double"


def online_beats(frames: DataFrame, fps: float, **how) -> DataFrame:
    """(key, time) of beats from a stream of (key, frame, activation); frames of a key come in order.

    One forward step a frame; a beat is given out where the likeliest state is a beat and at least 60 / max_bpm
    seconds have passed since the last. The state of a key is its forward vector, its frame count and its last beat,
    so a restart goes on where it stopped. Late frames are not reordered: a frame with a smaller number than one that
    was seen in an earlier batch is dropped."""
    model = BeatModel(fps, **how)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            alpha, counter, last = state.get
            alpha = np.array(alpha)
        else:
            alpha, counter, last = np.full(model.transitions.n, 1 / model.transitions.n), 0, -1e9
        rows = pd.concat(batches).sort_values("frame")
        rows = rows[rows["frame"] >= counter]
        found = []
        for frame, x in zip(rows["frame"].tolist(), rows["activation"].tolist(), strict=True):
            alpha = forward_step(model.transitions, model.column, alpha, model.densities(np.array([x]))[0])
            time = frame / fps
            if alpha.any() and model.column[int(alpha.argmax())] > 0 and time - last >= 60 / model.max_bpm:
                found.append(time)
                last = time
            counter = frame + 1
        state.update((alpha.tolist(), counter, last))
        yield pd.DataFrame({"key": [key[0]] * len(found), "time": found})

    return frames.groupBy("key").applyInPandasWithState(step, BEATS, STATE, "append", GroupStateTimeout.NoTimeout)


def offline_beats(frames: DataFrame, fps: float, **how) -> DataFrame:
    """The same from a table, for comparison: one forward pass for each key."""
    model = BeatModel(fps, **how)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        alpha, last, found = np.full(model.transitions.n, 1 / model.transitions.n), -1e9, []
        for frame, x in rows.sort_values("frame")[["frame", "activation"]].itertuples(index=False):
            alpha = forward_step(model.transitions, model.column, alpha, model.densities(np.array([x]))[0])
            if alpha.any() and model.column[int(alpha.argmax())] > 0 and frame / fps - last >= 60 / model.max_bpm:
                last = frame / fps
                found.append(last)
        return pd.DataFrame({"key": [key[0]] * len(found), "time": found})

    return frames.groupBy("key").applyInPandas(run, BEATS)


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling window and kind; rows later than the watermark are dropped."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there now and return its result."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, a file a trigger at most."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
