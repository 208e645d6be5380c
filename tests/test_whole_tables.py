"""Queries without SQL work on every user of the table, not on the first ids."""

import pyarrow.parquet as pq
import pytest

from orpheon.plans.catalog import CATALOG


def write_events(spark, folder, loud):
    rows = spark.sql(f"select id as event_id, id % 60 as user_id, 'click' as event_type, timestamp_ntz'2024-01-01' as ts, if({loud}, 130.0D, 1.0D) as value from range(4800)")
    pq.write_table(rows.toArrow(), folder / "events.parquet")


@pytest.mark.parametrize("name, key", [("beat_tracking", "key"), ("tempo_by_spectrum", "key"), ("window_records", "piece")])
def test_every_user_is_worked_on(spark, tmp_path, name, key):
    write_events(spark, tmp_path, "id div 60 % 8 = 0")
    rows = CATALOG.builders[name](spark, str(tmp_path))
    assert rows.select(key).distinct().count() == 60


def test_beat_evaluation_scores_every_user(spark, tmp_path):
    scores = []
    for name, loud in (("same", "id div 60 % 8 = 0"), ("late", "id div 60 % 8 = if(id % 60 < 50, 0, 4)")):  # the last ten users' beats stand between the references
        (tmp_path / name).mkdir()
        write_events(spark, tmp_path / name, loud)
        scores.append(CATALOG.builders["beat_evaluation"](spark, str(tmp_path / name)).collect())
    assert scores[0] != scores[1]


def test_online_tracker_gives_what_the_offline_one_gives_for_every_user(spark, tmp_path):
    from orpheon.plans.sequence_queries import FPS
    from orpheon.streaming.online import offline_beats

    write_events(spark, tmp_path, "id div 60 % 8 = 0")
    frames = spark.read.parquet(str(tmp_path / "events.parquet")).selectExpr("user_id as key", "event_id as frame", "least(greatest(value / 130, 0.01D), 0.99D) as activation")
    expected = {tuple(r) for r in offline_beats(frames, FPS, min_bpm=60, max_bpm=200).collect()}
    assert max(k for k, _ in expected) >= 40
    assert {tuple(r) for r in CATALOG.builders["online_beat_tracking"](spark, str(tmp_path)).collect()} == expected
