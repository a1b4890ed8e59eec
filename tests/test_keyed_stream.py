"""Readings judged in order of time, in whatever order files bring them."""

import datetime as dt
import random

import pandas as pd
import pytest

from plantlens.sources.tables import EVENT_SCHEMA
from plantlens.streaming import keyed, stream
from tests.test_quality_and_joins import event

START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each has state and workers of its own in every trigger."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain(rows):
    """held by event id, by a loop over each station's rows in order."""
    held, last = {}, {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        one, two = last.get(r[3], (None, None))
        held[r[0]] = r[6] is not None and r[6] == one == two
        last[r[3]] = r[6], one
    return held | {r[0]: False for r in rows if r[1] is None}


def run(spark, path, deliveries, delay="10 hours", name="keyed"):
    with stream.ProgressTable(spark, f"{path}/progress", [name]) as seen:
        for rows in deliveries:
            spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/feed")
            feed = stream.read_stream(spark, f"{path}/feed", EVENT_SCHEMA, files=1)
            got = keyed.run_held_in_order(feed, f"{path}/out", delay, name=name)
    return got.collect(), seen.rows().collect()


def test_shuffled_files_one_a_trigger(spark, tmp_path):
    """Rows lie up to eight hours out of order between triggers; a null reading breaks a
    run, hours are empty, hold one row, or many at one instant."""
    rng, rows = random.Random(5), []
    for i in range(600):
        ts = START + dt.timedelta(minutes=rng.choice([5, 9, 31, 40]) * (i // 2))
        value = rng.choice([25.0, 25.0, 25.0, 25.1, None, float("nan")])
        rows.append(event(f"{i:04d}", ts=ts, station_id=rng.choice(["S1", "S1", "S1", "S2", None]), feature_dim_mm=value))
    rows += [event(f"n{i}", ts=None, station_id="S1", feature_dim_mm=25.0) for i in range(3)]
    at = lambda r: (r[1] or START) + dt.timedelta(minutes=rng.randrange(480))
    arrived = sorted(rows, key=at)
    assert arrived != rows
    end = event("end", ts=max(r[1] for r in rows if r[1]) + dt.timedelta(days=3), station_id="S9")
    got, progress = run(spark, str(tmp_path), [*[arrived[i : i + 202] for i in range(0, len(arrived), 202)], [end]])
    want = plain(rows)
    assert sum(want.values()) > 40
    assert sum(r.dropped_rows for r in progress) == 0
    assert len(got) == len(want) and {r.event_id: r.held for r in got} == want


def test_late_rows_are_dropped_and_state_is_freed(spark, tmp_path):
    """The mark is at hour 290 when the late rows come; state holds no more than the delay."""
    hours = lambda a, b: [event(f"{h}", ts=START + dt.timedelta(hours=h), station_id="S1", feature_dim_mm=25.0) for h in range(a, b)]
    late = [event(f"late{h}", ts=START + dt.timedelta(hours=h, minutes=30), station_id="S1", feature_dim_mm=24.9) for h in (10, 288, 295)]
    got, progress = run(spark, str(tmp_path), [hours(0, 301), late, hours(301, 401)], name="late-keyed")
    assert sum(r.dropped_rows for r in progress) == 2
    held = {r.event_id: r.held for r in got}
    assert len(got) == len(held) and "Elate10" not in held and held["Elate295"] is False
    # the late row stands between hours 295 and 296, so the run begins anew behind it
    assert [h for h in range(390) if not held[f"E{h}"]] == [0, 1, 296, 297]
    # buckets that ended before hour 400 - 10 are judged; one ending at the mark waits
    assert max(int(e[1:]) for e in held if e[1:].isdigit()) in (388, 389)
    assert progress[-1].state_rows < 100


def test_edges_settle_over_small_buckets():
    judge = lambda *parts: pd.concat([keyed.in_order(pd.DataFrame({"event_id": [f"{b}{i}" for i in range(len(p))], "ts": START, "v": p})).assign(bucket=b) for b, p in enumerate(parts)], ignore_index=True)
    rows = judge([1.0], [1.0], [1.0, 1.0, 1.0, 2.0], [2.0], [2.0, float("nan")])
    held, last = keyed.settle(rows, (None, None))
    assert held == [False, False, True, True, True, False, False, True, False]
    assert last[1] == 2.0 and pd.isna(last[0])


def test_readings_wait_in_lists_of_bounded_spans(spark, tmp_path):
    """State was one entry a reading, which crossed to Python one by one; now it is one a
    station and slice of a bucket, however many readings there are."""
    rows = [event(f"{i:04d}", ts=START + dt.timedelta(milliseconds=50 * i), station_id="S1", feature_dim_mm=25.0 + i % 7 // 4) for i in range(1500)]
    end = event("end", ts=START + dt.timedelta(days=3), station_id="S9")
    got, progress = run(spark, str(tmp_path), [rows[::-1], [end]], name="lists")
    assert progress[0].state_rows == 2  # slices of 37.5 s
    want = plain([*rows, end])
    assert {r.event_id: r.held for r in got} == {k: v for k, v in want.items() if k != "Eend"} and len(got) == 1500


def test_the_stream_of_timers_gives_the_same(spark, tmp_path):
    rng = random.Random(8)
    rows = [event(f"{i:03d}", ts=START + dt.timedelta(minutes=7 * i) if i % 40 else None, station_id="S1", feature_dim_mm=rng.choice([25.0, 25.0, 25.1])) for i in range(120)]
    rows.append(event("end", ts=START + dt.timedelta(days=9), station_id="S9"))
    spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/feed")
    feed = stream.read_stream(spark, f"{tmp_path}/feed", EVENT_SCHEMA)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, keyed.ROCKSDB)
    timers = stream.run_appended(keyed.held_in_order(feed, "10 hours"), f"{tmp_path}/timers").collect()
    spark.conf.set(provider, before)
    lists = keyed.run_held_in_order(feed, f"{tmp_path}/lists", "10 hours").collect()
    assert sorted(lists) == sorted(timers) and len(lists) == 120
