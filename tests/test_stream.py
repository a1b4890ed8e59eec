"""Feeds whose results are as long as the feed."""

import datetime as dt
import random

from plantlens.operators import spc
from plantlens.sources import tables
from plantlens.sources.tables import EVENT_SCHEMA
from plantlens.streaming import stream
from tests.test_quality_and_joins import event


def test_appended_rows_stay_off_the_driver(spark, tmp_path):
    rows = [event(i % 20, ts=dt.datetime(2024, 1, 1, i % 20)) for i in range(40)]
    spark.createDataFrame(rows, EVENT_SCHEMA).write.parquet(str(tmp_path / "feed"))
    feed = stream.read_stream(spark, str(tmp_path / "feed"), EVENT_SCHEMA)
    got = stream.run_appended(stream.dedupe(feed).select("event_id"), str(tmp_path / "out"))
    assert sorted(r.event_id for r in got.collect()) == sorted(f"E{i}" for i in range(20))
    assert got.inputFiles()


def test_held_readings_over_days_and_triggers(spark, tmp_path):
    rng = random.Random(3)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(400):
        value = rng.choice([25.0, 25.0, 25.0, 25.1, None])
        rows.append(event(i, ts=start + dt.timedelta(hours=7 * i), station_id=rng.choice(["S1", "S1", "S2", None]), feature_dim_mm=value))
    for i in range(0, 400, 100):  # a trigger each
        spark.createDataFrame(rows[i : i + 100], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = stream.read_stream(spark, str(tmp_path / "feed"), EVENT_SCHEMA, files=1)
    got = stream.run_held_readings(feed, str(tmp_path / "out")).collect()
    want, last = {}, {}
    for r in rows:
        a, b = last.get(r[3], (None, None))
        want[r[0]] = r[6] is not None and r[6] == a == b
        last[r[3]] = b, r[6]
    assert sum(want.values()) > 40
    assert len(got) == len(rows) and {r.event_id: r.held for r in got} == want
    assert len(list((tmp_path / "out" / "last").iterdir())) == 4


def test_updated_rows_over_triggers(spark, tmp_path):
    """A file a trigger: each station and day has one row, of all its events."""
    for k in range(3):
        rows = [event(10 * k + i, ts=dt.datetime(2024, 1, 1 + i % 2, 2 + k), station_id="S1", vision_result="FAIL" if i == k else "PASS") for i in range(4)]
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = stream.read_stream(spark, str(tmp_path / "feed"), EVENT_SCHEMA, files=1)
    got = stream.run_updated(stream.daily_fpy(feed), str(tmp_path / "out"), ["station_id", "start"])
    assert len(list((tmp_path / "out" / "rows").iterdir())) >= 3
    assert sorted((r.start.day, r.n, r.fails) for r in got.collect()) == [(1, 6, 2), (2, 6, 1)]


def test_days_are_judged_by_the_limits_stored_last(spark, tmp_path):
    """Limits are frozen and stored; files that come later are judged in the feed, and
    limits that are published between two runs hold from then on."""
    start = dt.datetime(2024, 1, 1, 7)
    day = lambda d, fails: [event(f"{d}-{i}", ts=start + dt.timedelta(days=d, minutes=i), station_id="S1", vision_result="FAIL" if i < fails else "PASS") for i in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, EVENT_SCHEMA)
    history = frame([r for d in range(21) for r in day(d, 2)])
    root, feed, out = str(tmp_path / "limits"), str(tmp_path / "feed"), str(tmp_path / "out")
    assert stream.freeze_limits(spc.daily_fpy(history), root)["n_rows"] == 1
    history.write.parquet(feed)
    run = lambda: {r.d.day: r.out_of_control for r in stream.run_phase2(stream.read_stream(spark, feed, EVENT_SCHEMA), root, out).collect()}
    assert run() == {}  # only the days of the baseline
    frame(day(21, 2) + day(22, 20)).write.mode("append").parquet(feed)
    assert run() == {22: False, 23: True}
    wide = spark.createDataFrame([("S1", 0.4, dt.date(2024, 1, 21))], "station_id string, pbar double, frozen_through date")
    tables.publish_mart(wide, root, "limits", "freeze")
    frame(day(23, 20)).write.mode("append").parquet(feed)
    assert run() == {22: False, 23: True, 24: False}


def test_late_rows_are_counted_and_state_is_freed(spark, tmp_path):
    """Rows behind the watermark are dropped and counted, one row a trigger; state
    holds no more than the delay."""
    start, path = dt.datetime(2024, 1, 1), str(tmp_path / "feed")
    hours = lambda a, b: [event(f"{h}", ts=start + dt.timedelta(hours=h)) for h in range(a, b)]
    deliveries = [hours(0, 100), hours(100, 200), [event(f"late{h}", ts=start + dt.timedelta(hours=h)) for h in (10, 150, 175, 176, 190)], hours(200, 300)]
    with stream.ProgressTable(spark, str(tmp_path / "progress"), ["late"]) as seen:
        for rows in deliveries:
            spark.createDataFrame(rows, EVENT_SCHEMA).write.mode("append").parquet(path)
            got = stream.run_appended(stream.dedupe(stream.read_stream(spark, path, EVENT_SCHEMA), "24 hours").select("event_id"), str(tmp_path / "out"), "late")
    rows = seen.rows().collect()
    # the mark is at hour 199 - 24 when the third delivery comes
    assert sum(r.dropped_rows for r in rows) == 3 and sum(r.input_rows for r in rows) == 305
    assert sorted(r.event_id for r in got.collect() if r.event_id.startswith("Elate")) == ["Elate176", "Elate190"]
    assert {r.query for r in rows} == {"late"} and max(r.state_rows for r in rows) < 200 and rows[-1].watermark
