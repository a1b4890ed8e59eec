import json

import pytest
from pyspark.sql import functions as F

from plantlens.sources import tables
from plantlens.sources.adapters import EXTRACTS, extract


def test_tolerant_scan_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text('event_id,ts,line_id,station_id,part_number,serial_number,feature_dim_mm,vision_result,defect_code,cycle_time_s,inspection_pass\nE1,2024-01-01 08:00:00,L,"S1",P,NULL,25.0,PASS,,40,1\nE2,not a time,L,S1,P,,x,PASS,,40,1\n')
    rows = {r.event_id: r for r in tables.scan_tolerant(spark, str(tmp_path)).collect()}
    assert rows["E1"].serial_number is None and rows["E1"].station_id == "S1" and rows["E1"][tables.CORRUPT] is None
    assert rows["E2"][tables.CORRUPT].startswith("E2") and rows["E2"].feature_dim_mm is None and rows["E2"].serial_number is None


def test_blank_work_order_needs_no_repair(spark, tmp_path):
    (tmp_path / "m.csv").write_text("shift_id,work_center,shift_code,shift_start_ts,shift_end_ts,wo_no,units_completed\nA,WC-01,A,2024-01-01 06:00:00,2024-01-01 14:00:00,100001,5\nB,WC-01,A,2024-01-01 06:00:00,2024-01-01 14:00:00,,5\n")
    assert sorted((r.shift_id, r.wo_no) for r in tables.scan_mixed(spark, str(tmp_path)).collect()) == [("A", "100001"), ("B", None)]


def test_missing_source_is_an_empty_table(spark, tmp_path):
    df = tables.optional_source(spark, str(tmp_path / "none"), "a long, b string")
    assert df.dtypes == [("a", "bigint"), ("b", "string")] and df.count() == 0


def test_marts_are_replaced_in_one_order(spark, tmp_path):
    path = str(tmp_path / "mart")
    for n in (5, 3):
        tables.write_mart(spark.range(n).select(F.lit("x").alias("s"), "id"), path, ["id", "s"])
    assert spark.read.parquet(path).columns == ["id", "s"] and spark.read.parquet(path).count() == 3
    tables.write_one_csv(spark.range(3), str(tmp_path / "csv"), ["id"])
    assert [f.read_text() for f in (tmp_path / "csv").glob("*.csv")] == ["id\n0\n1\n2\n"]


def test_tables_take_new_columns(spark):
    tables.write_table(spark.range(2), "plant_test", "mart")
    tables.write_table(spark.range(3).withColumn("more", F.lit(1)), "plant_test", "mart")
    assert spark.table("plant_test.mart").columns == ["id", "more"]
    spark.sql("DROP SCHEMA plant_test CASCADE")


def test_report_is_one_row_of_structs(spark, tmp_path):
    path = tmp_path / "report"
    tables.write_report({"a": spark.range(1), "b": spark.range(1).select(F.lit(2).alias("x"), F.lit(3).alias("y"))}, str(path))
    (line,) = [x for f in path.glob("*.json") for x in f.read_text().splitlines()]
    assert json.loads(line) == {"a": {"id": 0}, "b": {"x": 2, "y": 3}}


@pytest.mark.parametrize("name", list(EXTRACTS))
def test_extracts_grow_with_the_events(spark, name):
    small, large = (extract(spark, f"/root/testdata/{sf}", name).count() for sf in ("sf0.001", "sf0.01"))
    assert 0 < small <= large


def test_long_ids_stay_whole(spark, tmp_path):
    ids = [1, 999_999, 1_000_000, *range(10_000_000, 10_000_010), 123_456_789_012]
    one = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(1).drop("event_id")
    events = spark.createDataFrame([(i,) for i in ids], "event_id long").crossJoin(one)
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = extract(spark, str(tmp_path), "inspections").select("event_id", "serial_number").distinct().collect()
    assert sorted(r.event_id for r in rows) == sorted(f"EVT-{i:07d}" for i in ids)
    serials = [r.serial_number for r in rows if r.serial_number]
    assert len(set(serials)) == len(serials) == sum(i % 97 != 0 for i in ids)
    assert {s.rsplit("-", 1)[1] for s in serials} == {f"{i:06d}" for i in ids if i % 97}
