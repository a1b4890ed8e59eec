"""A plant of landed extracts and a policy read from files."""

import datetime as dt
import json

from plantlens import policy
from plantlens.plans.marts import Plant
from plantlens.sources import tables
from tests.test_quality_and_joins import event


def test_landed_extracts_of_another_plant(spark, tmp_path):
    day = dt.datetime(2025, 5, 5)
    rows = [event(i, ts=day + dt.timedelta(hours=7 + i), line_id="L1", station_id="X1", serial_number=None if i == 3 else f"SN-x-{i}", vision_result="FAIL" if i < 2 else "PASS", defect_code="BENT" if i < 2 else None) for i in range(6)]
    events = spark.createDataFrame(rows, tables.EVENT_SCHEMA)
    events.withColumn("ts", events.ts.cast("string")).write.option("header", True).csv(str(tmp_path / "inspections.csv"))
    (tmp_path / "erp_work_orders.csv").write_text("PROD_LINE,WORK_ORDER_NO,ITEM_NO,PLANNER_CD,SCHED_START_DT,SCHED_END_DT\nline one,WO-7,77,p,05/05/2025,05/06/2025\nline one,WO-8,77,p,05/09/2025,05/08/2025\n")
    (tmp_path / "mes_shift_log.csv").write_text("shift_id,work_center,shift_code,shift_start_ts,shift_end_ts,wo_no,units_completed\n2025-05-05-A,CELL,A,2025-05-05 06:00:00,2025-05-05 14:00:00,7,6\n")
    (tmp_path / "qms_ncr.csv").write_text("NCR_NO,SERIAL_NO,DEFECT_CATEGORY,SEVERITY,DISPOSITION\nN1,X-0,FORM,2,SCRAP\nN2,y-9,FORM,1,REWORK\n")
    dims = {
        "dim_line": [{"source_key": "line one", "canonical": "L1"}],
        "dim_work_center": [{"source_key": "CELL", "canonical": "X1"}],
        "dim_item": [{"source_key": "77", "canonical": "PN-77"}],
        "dim_category": [{"source_key": "FORM", "canonical": "BENT"}],
        "dim_mode": [{"mode": "BENT", "label": "Bent pin", "feature_ref": "F9", "basis": "geometry"}],
        "dim_position": [{"line_id": "L1", "station_id": "X1", "position": 1, "value_vu": 2.0}],
        "dim_assignment": [{"station_id": "X1", "mode": "BENT"}],
    }
    for name, values in dims.items():
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, values)))
    plant = Plant(spark, "/no/such/folder", tables.landed(spark, str(tmp_path)), policy.read_dims(spark, str(tmp_path)))
    assert [(r.station_id, r.n, r.fails) for r in plant.daily.collect()] == [("X1", 6, 2)]
    fact = {r.event_id: r for r in plant.fact.collect()}
    assert len(fact) == 6 and {r.work_order_no for r in fact.values()} == {"WO-7"} and {r.has_mes_shift for r in fact.values()} == {True}
    assert [(k, r.ncr_no) for k, r in fact.items() if r.ncr_no] == [("E0", "N1")]
    assert [(r.mode, r.state, r.detections) for r in plant.cov.collect()] == [("BENT", "COVERED", 2)]
    assert [r.inspection_events for r in plant.reconciled.collect()] == [6]
