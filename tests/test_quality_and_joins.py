import datetime as dt
from collections import Counter

import pytest

from plantlens import policy as P
from plantlens.operators import condition, coverage, integrate, quality
from plantlens.functions import scalar
from plantlens.sources.tables import EVENT_SCHEMA
from pyspark.sql import functions as F


def event(i, **kw):
    base = {"event_id": f"E{i}", "ts": dt.datetime(2024, 1, 1, 8), "line_id": "LINE-A", "station_id": "S1", "part_number": "PN", "serial_number": f"SN-{i}", "feature_dim_mm": 25.0, "vision_result": "PASS", "defect_code": None, "cycle_time_s": 40.0, "inspection_pass": 1}
    return tuple((base | kw)[f.name] for f in EVENT_SCHEMA)


def test_every_rule_fires_once(spark):
    rows = [event(0), event(1, serial_number=" "), event(2), event(2), event(3, vision_result="MAYBE"), event(4, feature_dim_mm=-999.0), event(5, cycle_time_s=0.5), event(6, defect_code="X"), event(7, vision_result="FAIL")]
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    clean, found, report = quality.validate(df)
    assert Counter(r.rule for r in found.collect()) == {"required:serial_number": 1, "unique:event_id": 2, "allowed:vision_result": 1, "range:feature_dim_mm": 1, "range:cycle_time_s": 1, "consistency:C1": 1, "consistency:C2": 1}
    assert clean.count() == 8
    (r,) = report.collect()
    assert (r.n_rows, r.offending, r.dq_score) == (9, 7, round(1 - 7 / 9, 4))


def test_null_keys_are_repeated_and_no_rows_no_score(spark):
    df = spark.createDataFrame([event(0, event_id=None), event(1, event_id=None), event(2)], EVENT_SCHEMA)
    assert sorted(r.is_duplicate for r in quality.with_duplicates(df).collect()) == [False, True, True]
    (r,) = quality.score(df.limit(0)).collect()
    assert r.n_rows == 0 and r.dq_score is None


@pytest.mark.parametrize(("time", "day", "code"), [("00:00", 31, "C"), ("05:59", 31, "C"), ("06:00", 1, "A"), ("13:59", 1, "A"), ("14:00", 1, "B"), ("22:00", 1, "C"), ("23:59", 1, "C")])
def test_shift_boundaries(spark, time, day, code):
    df = spark.sql(f"SELECT timestamp_ntz'2024-01-01 {time}:00' ts")
    (r,) = df.select(scalar.production_day(F.col("ts")).alias("d"), scalar.shift_code(F.col("ts")).alias("c")).collect()
    assert (r.d.day, r.c) == (day, code)


def test_serial_spellings_and_rounding(spark):
    df = spark.sql("SELECT * FROM VALUES ('SN-s3-00-0142', 1.5625D), ('s3-00-0142', -1.5625D), (NULL, 0D) t(s, v)")
    rows = df.select(scalar.canonical_serial(F.col("s")).alias("s"), scalar.sql_round(F.col("v")).alias("v")).collect()
    assert [(r.s, r.v) for r in rows] == [("S3-00-0142", 1.563), ("S3-00-0142", -1.563), (None, 0.0)]


def ranges(spark, rows):
    return spark.createDataFrame([(w, "I", None, line, dt.date(2024, 1, a), dt.date(2024, 1, b)) for w, line, a, b in rows], "work_order_no string, item_no string, part_number string, line_id string, sched_start date, sched_end date")


def test_asof_picks_one_range_fans_out(spark):
    left = spark.createDataFrame([(i, "L", dt.date(2024, 1, d)) for i, d in enumerate([1, 2, 5, 9])] + [(9, None, dt.date(2024, 1, 5))], "event_id int, line_id string, date date")
    one = ranges(spark, [("A", "L", 2, 4), ("B", "L", 5, 7)])
    got = lambda df: sorted((r.event_id, r.work_order_no or "") for r in df.collect())
    want = [(0, ""), (1, "A"), (2, "B"), (3, ""), (9, "")]
    assert got(integrate.asof_bounded(left, one)) == want
    for f in (integrate.range_join, integrate.range_join_by_day):
        assert got(f(left, one, "line_id", "date", "sched_start", "sched_end")) == want
    both = ranges(spark, [("A", "L", 2, 7), ("B", "L", 5, 7)])
    assert got(integrate.asof_bounded(left, both)) == want
    assert len(integrate.range_join(left, both, "line_id", "date", "sched_start", "sched_end").collect()) == 6


def test_interval_is_half_open_and_equals_the_derived_key(spark):
    mes = spark.sql("SELECT '2024-01-01-A' shift_id, 'S1' station_id, timestamp_ntz'2024-01-01 06:00:00' shift_start_ts, timestamp_ntz'2024-01-01 14:00:00' shift_end_ts")
    times = ["05:59", "06:00", "13:59", "14:00", "22:00"]
    looks = spark.createDataFrame([event(i, ts=dt.datetime.fromisoformat(f"2024-01-01 {t}:00")) for i, t in enumerate(times)], EVENT_SCHEMA)
    assert [r.events for r in integrate.interval_join(mes, looks).collect()] == [2]
    assert [r.events for r in integrate.derived_key_join(mes, integrate.with_keys(looks)).collect()] == [2]


def test_escape_is_found_by_the_next_that_looks(spark):
    dims = {k: P.dim(spark, k) for k in ("dim_position", "dim_assignment", "dim_final")}
    got = {(r.station_id, r.mode): (r.found_kind, r.found_at) for r in coverage.discovery_points(dims["dim_position"], dims["dim_assignment"], dims["dim_final"]).collect()}
    assert got["S1", "DIM-OOS"] == ("station", "S2") and got["S3", "DIM-OOS"] == ("final_test", "FINAL-TEST") and got["S3", "SRF-SCR"] == ("customer", "CUSTOMER")
    assert len(got) == 27


def test_cost_claims(spark):
    dims = {k: P.dim(spark, k) for k in ("dim_position", "dim_assignment", "dim_final")}
    points = coverage.discovery_points(dims["dim_position"], dims["dim_assignment"], dims["dim_final"])
    (r,) = coverage.sensitivity(coverage.cost_sweep(points, coverage.sweep(spark, P.COST_SWEEP))).collect()
    assert (r.combos, r.c1_holds, r.c2_holds, r.c1_robust, r.c2_robust) == (81, 81, 6, True, False)


def test_longest_run_counts_records(spark):
    rows = [("S1", i, bool(b)) for i, b in enumerate([1, 1, 0, 1, 1, 1, 0])] + [("S2", 0, False)]
    got = condition.longest_run(spark.createDataFrame(rows, "s string, d int, bad boolean"), ["s"], "d", "bad").collect()
    assert [(r.s, r.longest_run) for r in got] == [("S1", 3)]


def test_asof_over_buckets_equals_the_plain_search(spark):
    import random

    rng = random.Random(3)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
    left = [(i, rng.choice("ab"), day()) for i in range(200)]
    right = [(rng.choice("abc"), day(), i) for i in range(40)]
    want = {}
    for i, k, t in left:
        fit = [(u, v) for q, u, v in right if q == k and u <= t]
        want[i] = max(fit)[1] if fit else None
    a, b = spark.createDataFrame(left, "i int, k string, t date"), spark.createDataFrame(right, "k string, u date, v int")
    for bucket in (F.to_date, lambda c: F.trunc(c, "month"), lambda c: F.trunc(c, "year")):
        got = integrate.asof_join(a, b, "k", "t", "u", ["u", "v"], bucket).collect()
        assert {r.i: r.v for r in got} == want and len(got) == 200


def test_parts_of_an_asof_join_grow_with_the_table(spark, sf_dir, monkeypatch):
    """The number of parts was the session's, whatever the table's size."""
    from plantlens import queries
    from plantlens.sources import tables

    before = sorted(queries.QUERIES["asof_volume"](spark, sf_dir).collect())
    monkeypatch.setattr(tables, "PART_BYTES", 4 << 10)
    parts = tables.parts_by_size(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = queries.QUERIES["asof_volume"](spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count(f", {parts}") >= 4
    assert sorted(df.collect()) == before
